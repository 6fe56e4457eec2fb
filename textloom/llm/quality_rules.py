"""Quality rules as a bitmask ledger: measure once, judge by any policy later.

Only DataFrame functions. Every rule is evaluated once for each document; the ledger keeps the measurements and one
bit for each failed rule. A policy is a versioned mask over those bits, so a new policy or an ablation rereads the
narrow ledger, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
#: Changes with any change of a rule's bit or condition; ledgers carry it, so that old bits are never read by new meanings.
RULESET = "1"
#: Rule name -> (bit, SQL condition over the measurements that means failure). A bit once given stays its rule's.
RULES = {
    "few_words": (0, "n_words < 10"),
    "repeated_words": (1, "100 * n_repeat_words > 20 * n_words"),
    "long_words": (2, "word_chars > 20 * n_words"),
    "short_words": (3, "word_chars < 2 * n_words"),
    "symbols": (4, "10 * n_symbols > 3 * n_words"),
    "repeated_lines": (5, "2 * n_dup_lines > n_lines and n_dup_lines >= 4"),
    "shouting": (6, "2 * n_upper > word_chars and n_words >= 20"),
    "no_letters": (7, "n_letters = 0"),
}
#: Version -> rules whose failure rejects.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "no_letters"],
    "v2": list(RULES),
}


def mask(policy: str, policies: dict[str, list[str]] = POLICIES) -> int:
    return sum(1 << RULES[r][0] for r in policies[policy])


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, although body refers to it within other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, n: int = 5) -> Column:
    """How many words lie in n-word windows found twice or more in the array, each word counted once.

    Windows are compared by a 64-bit hash. Sorting (hash, place) pairs takes n log n steps; texts without a
    repeated window, which are most, stop after one hash set.
    """

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(p, j)["h"] == F.get(p, i)["h"], F.lit(False))
            at = F.filter(F.transform(p, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda x: x.isNotNull())
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-n).alias("last"))
            return F.aggregate(F.sort_array(at), start, lambda a, x: F.struct((a["n"] + F.least(F.lit(n), x - a["last"])).alias("n"), x.alias("last")))["n"]

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, places))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) <= n, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policies: dict[str, list[str]] = POLICIES, policy: str = "v1") -> DataFrame:
    """id, measurements, fail_bits, ruleset, policy, base_failed and kept (by policy) for each row.

    A null text counts as one without words: it fails few_words. An empty table gives an empty ledger; repeated rows
    are measured each on its own; other columns of docs are neither read nor returned. Texts of any length are measured whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias(id_col), text.alias("__t"))
    words = F.array_remove(F.split("__t", WS), "")
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    squeezed = F.regexp_replace("__t", WS, "")
    measured = base.select(
        id_col,
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(squeezed).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("__t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("__t", r"\P{L}+", "")).cast("long").alias("n_letters"),
    ).select(id_col, "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_letters")
    bits = F.lit(0).cast("long")
    for k, condition in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return apply_policy(measured.withColumn("fail_bits", bits).withColumn("ruleset", F.lit(RULESET)), policy, policies)


def apply_policy(judged: DataFrame, policy: str = "v1", policies: dict[str, list[str]] = POLICIES) -> DataFrame:
    """A ledger, perhaps read from where it was stored, with policy, base_failed and kept: bits alone are read, no text.

    A row of another rule set has null for base_failed and kept, as its bits mean something else.
    """
    known = F.col("ruleset") == RULESET
    failed = lambda p: F.when(known, F.col("fail_bits").bitwiseAND(F.lit(mask(p, policies)).cast("long")) != 0)
    return judged.withColumn("policy", F.lit(policy)).withColumn("base_failed", failed("base")).withColumn("kept", ~F.col("base_failed") & ~failed(policy))


def write_ledger(judged: DataFrame, path: str) -> None:
    """The narrow ledger by rule set, for later policies and ablations; a rule set written again replaces its own part alone."""
    judged.drop("policy", "base_failed", "kept").write.partitionBy("ruleset").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def ablation(ledger_df: DataFrame, policy: str = "v1", policies: dict[str, list[str]] = POLICIES) -> DataFrame:
    """For each rule of a policy: how many rows fail it, fail it alone, and would be kept without it (one pass, no text).

    Rows of other rule sets are left out.
    """
    bits, whole = F.col("fail_bits").bitwiseAND(F.lit(mask(policy, policies)).cast("long")), F.lit(mask(policy, policies)).cast("long")
    sums = []
    for rule in policies[policy]:
        bit = F.lit(1 << RULES[rule][0]).cast("long")
        rest = F.lit(mask(policy, policies) & ~(1 << RULES[rule][0])).cast("long")
        sums += [F.count_if(bits.bitwiseAND(bit) != 0).alias(f"{rule}_n"), F.count_if(bits == bit).alias(f"{rule}_alone"), F.count_if(bits.bitwiseAND(rest) == 0).alias(f"{rule}_kept")]
    one = ledger_df.where(F.col("ruleset") == RULESET).agg(F.count("*").alias("rows"), F.bit_or(bits).alias("seen"), *sums).withColumn("mask", whole)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_n").alias("n_failed"), F.col(f"{r}_alone").alias("n_failed_alone"), F.col(f"{r}_kept").alias("n_kept_without")) for r in policies[policy]])
    return one.select(F.lit(policy).alias("policy"), "rows", F.explode(rows).alias("x")).select("policy", "rows", "x.*")
