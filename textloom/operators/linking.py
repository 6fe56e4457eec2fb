"""Resolving names to titles: a cascade of joins, and matches that use up what they match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import alignment, containment
from textloom.storage import broadcast_if_small, keep, shuffled


#: The two first characters that sources use one for the other, and the numerals that a shortened title may lack.
SWAPPED, SUFFIXES, CONTENT_SUFFIXES = "复与", ("一", "二"), ("一", "二", "三")
#: The least length of names and titles that match by containment.
LEAST_CONTAINED = 6


def swapped(name: Column) -> Column:
    """The name with its first character replaced by the one it is mixed up with; null for other beginnings."""
    a, b = SWAPPED
    rest = F.substr(name, F.lit(2))
    return F.when(name.startswith(a), F.concat(F.lit(b), rest)).when(name.startswith(b), F.concat(F.lit(a), rest))


def title_keys(titles: DataFrame) -> DataFrame:
    """(vol, kind, key, id): what each title (vol, ord, title, id) is looked up by; of equal keys of a volume the first title's counts.

    Kind m is the title and the title without parentheses, kind l the loose forms of both.
    """
    whole, bare = T.norm_link("title"), T.norm_link(T.strip_parens("title"))
    pair = lambda kind, i, key: F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("i"), key.alias("key"))
    each = titles.select("vol", "ord", "id", F.explode(F.array(pair("m", 0, whole), pair("m", 1, bare), pair("l", 0, T.loose(whole)), pair("l", 1, T.loose(bare)))).alias("k"))
    return each.groupBy("vol", "k.kind", "k.key").agg(F.min(F.struct("ord", "k.i", "id")).alias("f")).select("vol", "kind", "key", F.col("f.id").alias("id"), F.col("f.ord").alias("ord"), F.col("f.i").alias("i"))


def resolve(refs: DataFrame, titles: DataFrame) -> DataFrame:
    """refs (ref, vol, name) with id and tier of the title (vol, ord, title, id) that each names; nulls if unresolved.

    Tiers, the first that succeeds wins: 1 as it is, 2 its first character swapped, 3 and 4 the same without parentheses, 5 loose,
    6 and 7 loose with a numeral, 8 containment: of two texts of six characters or more, one ends with the other or the
    name's characters occur in the title in order; of several titles the first. All but the last tier are one equi-join; the last is for
    names that are still open.
    """
    keys = title_keys(titles)
    whole = T.norm_link("name")
    bare, thin = T.norm_link(T.strip_parens(whole)), T.loose(whole)
    ways = [("m", whole), ("m", swapped(whole)), ("m", bare), ("m", swapped(bare)), ("l", thin), *[("l", F.concat(thin, F.lit(s))) for s in SUFFIXES]]
    tried = refs.select("ref", "vol", F.explode(F.array(*[F.struct(F.lit(n + 1).alias("tier"), F.lit(kind).alias("kind"), key.alias("key")) for n, (kind, key) in enumerate(ways)])).alias("w"))
    hits = tried.select("ref", "vol", "w.*").join(keys.select("vol", "kind", "key", "id"), ["vol", "kind", "key"])
    direct = hits.groupBy("ref").agg(F.min(F.struct("tier", "id")).alias("f")).select("ref", "f.tier", "f.id")
    open_ = refs.join(direct, "ref", "left_anti").select("ref", "vol", whole.alias("name"))
    known = keys.where("kind = 'm' AND key <> ''").select("vol", (2 * F.col("ord") + F.col("i")).cast("long").alias("ord"), "id", F.col("key").alias("title"))
    near = containment.naming(open_, known, LEAST_CONTAINED).join(known.groupBy("vol", "ord").agg(F.min("id").alias("id")), ["vol", "ord"])
    contained = open_.join(near, ["vol", "name"]).select("ref", F.lit(len(ways) + 1).alias("tier"), "id")
    return refs.join(direct.unionByName(contained), "ref", "left")


def resolve_names(refs: DataFrame, titles: DataFrame) -> DataFrame:
    """refs (ref, name, first, second) with id: looked up in the first volume, then in the second, then by its loose form in all of them.

    A final "其" with numerals is no part of a name. The last way counts only if one title in all has that form. A name is looked up once
    for its two volumes, however many refs have it.
    """
    base = F.regexp_replace("name", "其[一二三四五六七八九十、，\\s]+$", "")
    few = refs.select("name", "first", "second").distinct().withColumn("__n", T.strip(base)).withColumn("ref", F.struct("name", "first", "second"))
    named = keep(few.select("ref", "__n"))
    sides = F.array(*[F.struct(F.lit(k).alias("way"), F.col(f"ref.{c}").alias("vol")) for k, c in enumerate(("first", "second"))])
    both = named.select("ref", F.explode(sides).alias("s"), F.col("__n").alias("name")).select(F.struct("ref", "s.way").alias("ref"), "s.vol", "name")
    # of equal titles of a volume the first counts, and whether a form has more than one id is seen by the least and the greatest
    once = keep(titles.groupBy("vol", "title").agg(F.min(F.struct("ord", "id")).alias("f"), F.min("id").alias("least"), F.max("id").alias("most")))
    looked = resolve(both, once.select("vol", "f.ord", "title", "f.id")).where("id IS NOT NULL").groupBy(F.col("ref.ref").alias("ref")).agg(F.min_by("id", "ref.way").alias("i1"))
    alone = once.groupBy(T.loose(T.norm_link("title")).alias("__k")).agg(F.min("least").alias("i2"), F.max("most").alias("most")).where("i2 = most").drop("most")
    out = named.withColumn("__k", T.loose(T.norm_link("__n"))).join(looked, "ref", "left").join(alone, "__k", "left")
    found = keep(out.select("ref.*", F.coalesce("i1", "i2").alias("__id")).where("__id IS NOT NULL"))
    held = broadcast_if_small(found.select(*[F.col(c).alias(f"__{c}") for c in ("name", "first", "second")], "__id"), 256)
    same = (F.col("name") == F.col("__name")) & F.col("first").eqNullSafe(F.col("__first")) & F.col("second").eqNullSafe(F.col("__second"))
    return refs.join(held, same, "left").select(*refs.columns, F.col("__id").alias("id"))


def set_links(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Segments (id, seg, src, srcId) with srcId as found (id, seg, srcId) has it, null where it has none, and changed.

    Writing the rows that changed, and no others, can be repeated: a second run changes nothing.
    """
    new = found.select("id", "seg", F.col("srcId").alias("__new"))
    out = segments.join(new, ["id", "seg"], "left")
    return out.select("id", "seg", "src", F.col("__new").alias("srcId"), (~F.col("srcId").eqNullSafe(F.col("__new"))).alias("changed"))


def consume(body: DataFrame, expected: DataFrame, key: str, order: str) -> DataFrame:
    """body with __other: the k-th row of a key meets the k-th expected one, so each is used once; null when used up."""
    w = Window.partitionBy(key).orderBy(order)
    nth = F.row_number().over(w)
    other = expected.select(F.col(key).alias("__key"), nth.alias("__k"), F.col(order).alias("__other"))
    left = body.withColumn("__n", nth)
    return left.join(other, (left[key] == other["__key"]) & (left["__n"] == other["__k"]), "left").drop("__key", "__k", "__n")


def unique_by_content(refs: DataFrame, titles: DataFrame, ref_text: str = "quote", body: str = "body", n: int = 20) -> DataFrame:
    """refs with id of the only title of equal loose form, or that with a numeral, whose body contains the quote's first n characters.

    Bodies are read once, for the stretches that quotes begin with; what is joined are those stretches, not bodies.
    """
    asked = refs.withColumns({"__f": T.loose(T.norm_link("name")), "__h": F.left(T.norm_link(ref_text), F.lit(n))})
    wanted = asked.where("__h <> ''").select("__f", "__h").distinct()
    ways = wanted.select("__f", "__h", F.explode(F.array(F.col("__f"), *[F.concat("__f", F.lit(s)) for s in CONTENT_SUFFIXES])).alias("__k"))
    known = titles.select(F.col("id").alias("__id"), T.loose(T.norm_link("title")).alias("__k"))
    places = alignment.find_pieces(wanted.select(F.col("__h").alias("piece")), titles.select(F.col("id").alias("__id"), T.norm_link(body).alias("__b")), "__id", "__b", first=True)
    # the one id is both the least and the greatest, so a text that all bodies have is a row a title and task
    inside = places.select(F.col("piece").alias("__h"), "__id").join(shuffled(known), "__id").groupBy("__k", "__h").agg(F.min("__id").alias("id"), F.max("__id").alias("__last"))
    hits = ways.join(shuffled(inside), ["__k", "__h"]).groupBy("__f", "__h").agg(F.min("id").alias("id"), F.max("__last").alias("__last")).where("id = __last").drop("__last")
    return asked.join(shuffled(hits), ["__f", "__h"], "left").select(*refs.columns, "id")
