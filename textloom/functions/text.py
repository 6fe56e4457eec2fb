"""Text functions as Column expressions: normalisation, numerals, tokens, clips, escapes, formats.

All run in the JVM. White space is Unicode white space throughout; lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"
# Character classes and word lists that results must agree on.
TITLE_MARKS = "《》「」『』〈〉"
SQUASHED = r"""(?U)[\s　，。、；：？！“”‘’"'（）()·．\.,：「」『』《》〈〉—\-–…\[\]【】〇]"""
MATCH_IGNORED = r"""(?U)[\s，。、；：！？「」『』“”"'‘’（）()【】\[\]．·—\-…]"""
CJK_BORDER = "一-鿿　-〿＀-￯‘’“”〝〞"
NUMERALS = "〇一二三四五六七八九"
TITLE_ENDS = "书序记论疏跋铭颂赞偈文说联词启示诀语录章约辞训诰诫规答问引状述志传缘起仪"
SENTENCE_END, SENTENCE_CLOSE = "。！？!?…", "」』）)】》”’"
FUNCTION_WORDS = ("的", "这", "吗", "呢", "啊", "们", "您", "已经", "因为", "所以", "就是", "什么")
STOP_WORDS = (
    "如何|怎[么麼样樣办辦]|为什[么麼]|為什[麼么]|什[么麼]|哪[些个個]|是否|可以|应该|應該|需要|这样|這樣|那样|那樣|时候|時候|意思|請問|请问|我们|我們|关于|關於|以及|还有|還有|或者|的话|的話|一下"
    "|呢|吗|嗎|了|啊|呀|吧|和|与|與|及|在|对|對|把|被|给|給|让|讓|向|往|从|從|по"
)
FOLLOW_UP = "它|他|她|这|那|上(面|述|文)|继续|再|还有|为什[么麽]|怎[么样]|出处|展开|具体|详细|例子|呢[？?]?$"
HARD = "区别|不同|对比|對比|比较|比較|异同|異同|关系|關係|为何|為何|界限|混滥|混濫|双修|雙修|与.{0,8}[的之]?(区别|不同|关系)"
SCOPED = "本篇|本文|此篇|这篇|這篇|此文|这封|這封|这段|這段|此段|上文|文中|这里|這裡|此处|此處|这一段|這一段"
TRANSLATION_MARK = "（白话）"
#: Every white space character, U+001C to U+001F included.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _re(x: Column | str, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(_c(x), pattern, to)


def strip(x: Column | str) -> Column:
    """Without white space at either end, of any kind."""
    return _re(x, r"(?U)^\s+|\s+$")


def squash_ws(x: Column | str) -> Column:
    """Without any white space."""
    return _re(x, WS)


def norm_title(x: Column | str) -> Column:
    """White space dropped, half-width parentheses made full-width: for comparing titles."""
    return F.translate(squash_ws(x), "()", "（）")


def norm_link(x: Column | str) -> Column:
    """White space, book-title marks and corner quotes dropped: for resolving references."""
    return _re(x, rf"(?U)[\s{TITLE_MARKS}]+")


def squash_punct(x: Column | str) -> Column:
    """White space and punctuation dropped, the zero numeral too: for aligning quotes."""
    return _re(x, SQUASHED)


def norm_match(x: Column | str) -> Column:
    """White space and punctuation dropped: for finding quotes in their sources."""
    return _re(x, MATCH_IGNORED)


def tidy(x: Column | str) -> Column:
    """Without the spaces between wide characters."""
    return _re(x, rf"(?<=[{CJK_BORDER}])[ \t 　]+(?=[{CJK_BORDER}])")


def strip_parens(x: Column | str) -> Column:
    """Without spans in full-width parentheses."""
    return _re(x, "（[^）]*）")


def loose(x: Column | str, honorific: str = "居士") -> Column:
    """Without separators, an honorific and final numerals."""
    return _re(F.replace(_re(x, "[、，,（）()]"), F.lit(honorific), F.lit("")), "[一二三四五六七八九十]+$")


def is_subsequence(short: Column | str, long: Column | str, least: int = 6) -> Column:
    """Whether the characters of short occur in long in this order, both ending alike; false for short ones."""
    s, t = _c(short), _c(long)
    state = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"))

    def step(a: Column, ch: Column) -> Column:
        hit = F.call_function("locate", ch, t, a["at"])
        return F.struct((hit + 1).alias("at"), (a["ok"] & (hit > 0)).alias("ok"))

    found = F.aggregate(F.split(s, ""), state, step)["ok"]
    return (F.length(s) >= least) & (F.right(s, F.lit(1)) == F.right(t, F.lit(1))) & found


def looks_like_title(x: Column | str, categories: str = "书|论|序|记|疏|跋") -> Column:
    """Whether the text, without parentheses and final numerals, ends as titles do."""
    base = _re(strip_parens(x), "[一二三四五六七八九十廿卅]+$")
    return (base != "") & ((F.instr(F.lit(TITLE_ENDS), F.right(base, F.lit(1))) > 0) | base.startswith("挽") | base.rlike(f"^({categories})[一二三四]?$"))


def let(value: Column, body) -> Column:
    """body(value), the value computed once for a row however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def num_to_cn(n: Column | str) -> Column:
    """1..99 in Chinese numerals."""
    digit = lambda d: F.substr(F.lit(NUMERALS), d.cast("int") + 1, F.lit(1))

    def written(n: Column) -> Column:
        tens, ones = F.floor(n / 10), n % 10
        long = F.concat(F.when(tens == 1, "").otherwise(digit(tens)), F.lit("十"), F.when(ones == 0, "").otherwise(digit(ones)))
        return F.when(n == 10, "十").when(n < 10, digit(n)).otherwise(long)

    return let(_c(n), written)


def cn_to_num(x: Column | str) -> Column:
    """Chinese numerals up to 99, with the short forms of 20 and 30; 0 if unknown."""
    single = lambda c, none: F.when((F.length(c) == 1) & (F.instr(F.lit(NUMERALS), c) > 0), F.instr(F.lit(NUMERALS), c) - 1).otherwise(none)

    def read(s: Column) -> Column:
        at = F.call_function("locate", F.lit("十"), s)
        a, b = F.substring_index(s, "十", 1), F.substr(s, at + 1)
        both = F.when(a == "", 1).otherwise(single(a, 1)) * 10 + F.when(b == "", 0).otherwise(single(b, 0))
        return F.when(s == "十", 10).when(at > 0, both).otherwise(single(s, 0))

    return let(F.replace(F.replace(_c(x), F.lit("廿"), F.lit("二十")), F.lit("卅"), F.lit("三十")), read)


def _words(x: Column | str) -> tuple[Column, Column, Column]:
    """(whether there are Han characters, the text with a space for all between its runs, tokens of a text with Han characters)."""
    # letters first, and no Han character lies below U+2E80: looking a script up takes longest
    plain = _re(F.coalesce(_c(x), F.lit("")), r"[^\p{L}\p{N}\p{IsHan}]+", " ")
    runs = F.array_remove(F.split(plain, " +"), "")
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    mixed = F.flatten(F.transform(runs, lambda t: F.when(~t.rlike(r"\p{IsHan}"), F.array(F.lower(t))).when(F.length(t) == 1, F.array(t)).otherwise(pairs(t))))
    return _c(x).rlike(r"[\x{2E80}-\x{10FFFF}&&\p{IsHan}]"), plain, mixed


def bigrams(x: Column | str) -> Column:
    """Tokens: runs of letters and digits in lower case; runs with Han characters as overlapping pairs; single ones as they are.

    Texts without Han characters, which need no look at each run, take one split.
    """
    han, plain, mixed = _words(x)
    return F.when(han, mixed).otherwise(F.array_remove(F.split(F.lower(plain), " +"), ""))


def spaced(x: Column | str) -> Column:
    """The tokens of bigrams as one text, a space between them, which costs less to hand to Python than an array."""
    han, plain, mixed = _words(x)
    return F.when(han, F.array_join(mixed, " ")).otherwise(F.trim(F.lower(plain)))


def lex_text(x: Column | str) -> Column:
    """Without translation markers."""
    return _re(_re(x, f"\n{TRANSLATION_MARK}", " "), f"^{TRANSLATION_MARK}")


def clean_key(x: Column | str, n: int = 80) -> Column:
    return F.left(squash_ws(F.coalesce(_c(x), F.lit(""))), F.lit(n))


def naive_terms(x: Column | str, most: int = 6) -> Column:
    """Distinct content words of a question, two characters or more, at most six."""
    plain = _re(_re(F.coalesce(_c(x), F.lit("")), r"[^\p{IsHan}\p{L}\p{N}]+", " "), STOP_WORDS, " ")
    return F.slice(F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda t: F.length(t) >= 2)), 1, most)


def source_type(volume: Column | str) -> Column:
    v = _c(volume)
    return F.when(v == "jx", "selected").when(v == "jy", "jiayan").otherwise("primary")


def source_priority(kind: Column | str) -> Column:
    k = F.coalesce(_c(kind), F.lit(""))
    return F.when(k == "primary", 0).when(k == "jiayan", 1).when(k == "selected", 2).otherwise(3)


def url_quote(x: Column | str) -> Column:
    """Percent-encoded, a space as %20."""
    return F.replace(F.url_encode(_c(x)), F.lit("+"), F.lit("%20"))


def article_path(article: Column | str, paragraph: Column | str | None = None) -> Column:
    query = F.lit("") if paragraph is None else F.when(_c(paragraph) >= 0, F.concat(F.lit("?p="), _c(paragraph).cast("string"))).otherwise("")
    return F.concat(F.lit("/a/"), url_quote(article), F.lit("/"), query)


def snippet(text: Column | str, keyword: Column | str, before: int = 22, after: int = 34) -> Column:
    """Context of the first occurrence on one line; empty where the keyword is not in the text."""
    t, k = _c(text), _c(keyword)
    at = F.call_function("locate", k, t)
    start = F.greatest(at - before, F.lit(1))
    body = F.replace(F.substr(t, start, at + F.length(k) + after - start), F.lit("\n"), F.lit(" "))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.lit("…"))).otherwise("")


def clean_text(x: Column | str) -> Column:
    """Without note numbers, white space collapsed."""
    return strip(_re(_re(F.coalesce(_c(x), F.lit("")), r"\[\d{1,3}\]"), WS, " "))


def clip(x: Column | str, n: int) -> Column:
    """clean_text cut to n characters, the last an ellipsis if any is cut."""
    t = clean_text(x)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(_re(F.left(t, F.lit(n - 1)), r"(?U)\s+$"), F.lit("…")))


def strip_source(x: Column | str) -> Column:
    """(body, src): a final citation in parentheses apart from its text; src is null without one."""
    src = F.regexp_extract(_c(x), r"(（《[^》]+》[^）]*）)(?U)\s*$", 1)
    body = F.when(src == "", _c(x)).otherwise(strip(_re(x, r"（《[^》]+》[^）]*）(?U)\s*$")))
    return F.struct(body.alias("body"), F.nullif(src, F.lit("")).alias("src"))


def html_escape(x: Column | str, quotes: bool = True) -> Column:
    out = _c(x)
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def add_refs(x: Column | str) -> Column:
    """Note numbers as superscripts."""
    return _re(x, r"\[(\d{1,3})\]", r"<sup>$1</sup>")


def mark_all(x: Column | str, keyword: str) -> Column:
    return F.replace(_c(x), F.lit(keyword), F.lit(f"<mark>{keyword}</mark>"))


def sentences(x: Column | str) -> Column:
    """Sentences with their end marks and closing quotes; line feeds end them too; those of symbols alone are dropped."""
    # no sentence has a line feed, so one after each end is where to cut: no step back over a line without an end
    cut = F.split(_re(F.coalesce(_c(x), F.lit("")), f"[{SENTENCE_END}][{SENTENCE_CLOSE}]*", "$0\n"), "\n")
    return F.transform(F.filter(cut, lambda s: s.rlike("[一-鿿A-Za-z0-9]")), lambda s: F.btrim(s, F.lit(SPACE)))


def marker_density(x: Column | str, words: tuple[str, ...] = FUNCTION_WORDS) -> Column:
    """Occurrences of the words for each character."""
    n = sum((F.length(_c(x)) - F.length(F.replace(_c(x), F.lit(w), F.lit("")))) / len(w) for w in words)
    return n / F.greatest(F.length(_c(x)), F.lit(1))


def first_difference(a: Column | str, b: Column | str) -> Column:
    """The least place (from 0) where the two differ; the shorter length if one begins with the other; null if equal."""
    x, y = _c(a), _c(b)
    short = F.least(F.length(x), F.length(y))
    same = F.array_position(F.zip_with(F.split(F.left(x, short), ""), F.split(F.left(y, short), ""), lambda p, q: p == q), False)
    return F.when(x == y, F.lit(None)).when(same > 0, same - 1).otherwise(short.cast("long"))


def line_blocks(x: Column | str) -> Column:
    """(kind, text) of each non-blank line: heading, num, bullet or para, without its mark."""

    def kind(s: Column) -> Column:
        h, n, b = r"^#{1,6}\s+", r"^\d+[.、)]\s*", r"^[-*•]\s+"
        what = F.when(s.rlike(h), "heading").when(s.rlike(n), "num").when(s.rlike(b), "bullet").otherwise("para")
        return F.struct(what.alias("kind"), F.regexp_replace(s, f"{h}|{n}|{b}", "").alias("text"))

    return F.transform(F.filter(F.transform(F.split(_c(x), "\n"), strip), lambda s: s != ""), kind)


def speakable(x: Column | str) -> Column:
    """Without citation numbers, emphasis and list marks."""
    return strip(_re(_re(_re(x, r"\[\d{1,2}\]"), r"[*#`>]+"), r"(?m)^\s*(?:[-•]|\d+[.、)])\s*"))


def json_body(x: Column | str) -> Column:
    """From the first { to the last }; null without both."""
    return F.nullif(F.regexp_extract(_c(x), r"(?s)(\{.*\})", 1), F.lit(""))


def bold_share(runs: Column | str) -> Column:
    """Share of non-blank characters that lie in bold runs: array<struct<text,bold>> -> double."""
    size = lambda keep: F.aggregate(_c(runs), F.lit(0), lambda a, r: a + F.when(keep(r), F.length(squash_ws(r["text"]))).otherwise(0))
    return F.coalesce(size(lambda r: r["bold"]) / F.nullif(size(lambda r: F.lit(True)), F.lit(0)), F.lit(0.0))


def clen(x: Column | str) -> Column:
    """Length without white space."""
    return F.length(squash_ws(x))
