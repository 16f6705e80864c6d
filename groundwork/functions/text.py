"""Text functions as Column expressions: whole texts in, no shuffle, no UDF.

Null counts as empty everywhere, unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import rules

#: Marks between sentences and blocks; both are control characters that normalising removes.
CUT, BLOCK = "\u0001", "\u0002"
# Compatibility characters with a one-character form, and ligatures.
_NARROW = {0xA0: " ", 0x2007: " ", 0x202F: " ", 0x3000: " ", **{0xFF01 + k: chr(0x21 + k) for k in range(94)}}
_WIDE = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "..."}
_ANY_WIDE = "(?=[^\\x00-\\x7f])[\u00a0\u2007\u202f\u3000\uff01-\uff5e" + "".join(_WIDE) + "]"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def let(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use(col)`` with ``col`` computed once, however often it is used: inside lambdas nothing shares
    common parts."""
    return F.element_at(F.transform(F.array(col), use), 1)


def folded(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], state: str, out: str) -> Column:
    """A fold over an array that appends: ``step(state, item)`` gives the next state and an array of
    outputs, and all outputs are joined. ``state`` and ``out`` (an array) are the types.

    The items are cut into about sqrt(n) pieces, so that appending copies n ** 1.5 references, not n ** 2."""
    both = f"struct<state:{state},out:{out}>"
    none = F.array().cast(out)

    def one(acc: Column, x: Column) -> Column:
        after, more = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], more.cast(out)).alias("out")).cast(both)

    def run(its: Column) -> Column:
        root = F.ceil(F.sqrt(F.size(its).cast("double"))).cast("int")
        cuts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(its) / root).cast("int") - 1), lambda k: F.slice(its, k * root + 1, root))
        piece = lambda acc, part: F.aggregate(part, F.struct(F.element_at(acc, -1)["state"].alias("state"), none.alias("out")).cast(both), one)
        parts = F.aggregate(cuts, F.array(F.struct(start.alias("state"), none.alias("out"))).cast(f"array<{both}>"), lambda acc, part: F.concat(acc, F.array(piece(acc, part))).cast(f"array<{both}>"))
        return F.when(F.size(its) > 0, F.flatten(F.transform(parts, lambda p: p["out"]))).otherwise(none)

    return let(items, run)


def counted(items: Column, key: Callable[[Column], Column], told: Callable[[Column, Column], Column]) -> Column:
    """``told(first, n)`` of each run of neighbours with equal keys, the n items of which begin with ``first``: of sorted
    items, each key once."""

    def run(its: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(its) - 1), lambda k: (k == 0) | (key(F.get(its, k)) != key(F.get(its, k - 1))))
        ends = lambda at: F.transform(at, lambda k, i: told(F.get(its, k), F.coalesce(F.get(at, i + 1), F.size(its)) - k))
        return let(F.when(F.size(its) > 0, starts).otherwise(F.array().cast("array<int>")), ends)

    return let(items, run)


def strip(col: Column) -> Column:
    """White space off both ends."""
    return F.btrim(col, F.lit(" \t\n\x0b\f\r"))


def nfkc(col: Column) -> Column:
    """Full compatibility normalisation, in Arrow batches (Spark has no function for it)."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(run, StringType())(col)


def _where(found: Callable[[Column], Column], change: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(found(x), change(x)).otherwise(x)


def normalise_ws(col: Column | str, full: bool = False) -> Column:
    """B1. Line ends, compatibility characters (``full``: all of NFKC by an Arrow UDF),
    control characters, hyphenated line breaks, runs of spaces, line ends and blank lines."""
    def narrowed(t: Column) -> Column:
        t = F.translate(t, "".join(map(chr, _NARROW)), "".join(_NARROW.values()))
        for wide, narrow in _WIDE.items():
            t = F.replace(t, F.lit(wide), F.lit(narrow))
        return t

    has = lambda *marks: lambda t: reduce(lambda a, b: a | b, (t.contains(m) for m in marks))
    put = lambda pattern, by: lambda t: F.regexp_replace(t, pattern, by)
    # each step runs only on texts that have what it changes, which costs a search, not a copy of the text
    steps = [
        (has("\r"), put("\r\n?", "\n")),
        (lambda t: F.lit(True), nfkc) if full else (lambda t: (F.octet_length(t) > F.length(t)) & t.rlike(_ANY_WIDE), narrowed),
        (lambda t: t.rlike(_CONTROL), put(_CONTROL, " ")),
        (has("-\n"), put(r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")),
        (has("\t", "  "), put("\t[ \t]*| [ \t]+", " ")),
        (has(" \n", "\n "), put(" \n ?|\n ", "\n")),
        (has("\n\n\n"), put("\n{3,}", "\n\n")),
    ]
    t = _text(col)
    for found, change in steps:
        t = change(t) if change is nfkc else let(t, _where(found, change))
    return F.btrim(t, F.lit(" \n"))


def strip_repeats(col: Column | str) -> Column:
    """B2. Five or more of one character become three."""
    return F.regexp_replace(_text(col), r"(.)\1{4,}", "$1$1$1")


def tokens(col: Column | str) -> Column:
    """B3. Lower-cased ASCII-initial tokens of two characters or more."""
    return F.transform(F.regexp_extract_all(_text(col), F.lit(rules.TOKEN), F.lit(0)), F.lower)


def content_tokens(col: Column | str) -> Column:
    """B4. Tokens of three characters or more that are no stop words."""
    return F.filter(tokens(col), lambda t: (F.length(t) > 2) & ~t.isin(*rules.STOP_WORDS))


def word_list(col: Column | str) -> Column:
    return F.filter(F.split(_text(col), r"\s+"), lambda w: w != "")


def word_count(col: Column | str) -> Column:
    """B5."""
    return F.size(word_list(col))


def estimate_tokens(col: Column | str) -> Column:
    """B6. One token for 3.6 characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(_text(col)) / 3.6)).cast("int")


def heading_of(col: Column) -> Column:
    """B7. The heading that a line is, or null."""

    def named(line: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(line, r"^#+\s*", ""), r"^[ .:\-]+|[ .:\-]+$", "")
        return F.when((F.length(line) > 0) & (F.length(line) <= 120), let(F.regexp_replace(bare, r"(?i)^\[?(?:\d+|[IVXLC]+)[.)]\s+", ""), lambda name: judged(line, name)))

    def judged(line: Column, name: Column) -> Column:
        plain = (F.length(line) <= 70) & (F.size(F.split(line, r"\s+")) <= 7) & ~line.rlike(r"[.,;:!?]$")
        found = F.lit(False)
        for k, pattern in enumerate(rules.HEADINGS):
            here = line.rlike(pattern)
            if k == 1:
                here &= name.rlike(rules.HEADINGS[6])
            if k in (1, 5, 6):
                here &= plain
            found |= here
        return F.when((F.length(name) >= 2) & found, name)

    return let(strip(col), named)


def is_boilerplate(col: Column) -> Column:
    """B8."""
    return strip(col).rlike(rules.BOILERPLATE)


def is_bullet(col: Column) -> Column:
    return col.rlike(rules.BULLET)


def strip_bullet(col: Column) -> Column:
    """B9."""
    return strip(F.regexp_replace(col, rules.BULLET_STRIP, ""))


def is_placeholder(col: Column) -> Column:
    """B10."""
    return col.rlike(rules.PLACEHOLDER)


def lines(col: Column | str) -> Column:
    return F.split(_text(col), "\n")


def sentence_array(normalised: Column) -> Column:
    """B11. Sentences of a normalised text, in order.

    Placeholders and headings are blocks of their own, a bullet opens a block that later
    lines join; blank lines do not. Blocks of more than two words are cut after
    ``. ! ? ।`` before a capital or digit. All of it happens inside the row.
    """

    def mark(line: Column) -> Column:
        return (
            F.when(is_placeholder(line), F.concat(F.lit(BLOCK), line, F.lit(BLOCK)))
            .when(is_bullet(line), F.concat(F.lit(BLOCK), F.regexp_replace(line, rules.BULLET_STRIP, "")))
            .when(heading_of(line).isNotNull(), F.concat(F.lit(BLOCK), line, F.lit(BLOCK)))
            .otherwise(line)
        )

    marked = F.array_join(F.transform(F.filter(F.split(normalised, "\n"), lambda x: x != ""), mark), " ")
    blocks = F.filter(F.transform(F.split(marked, BLOCK), strip), lambda b: b != "")
    cut = lambda b: F.split(F.regexp_replace(b, "([.!?।])\\s+([\"'“‘(\\[]?[A-Z0-9])", f"$1{CUT}$2"), CUT)
    parts = F.flatten(F.transform(blocks, lambda b: F.when(b.rlike(r"\S\s+\S+\s+\S"), cut(b)).otherwise(F.array(b))))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """B11 as rows: ``id, sent_no, sentence``."""
    return docs.select(id_col, F.posexplode(sentence_array(normalise_ws(text_col))).alias("sent_no", "sentence"))


def snippet(col: Column, limit: int = 220) -> Column:
    """B12. One line of at most ``limit`` characters."""
    cut = lambda flat: F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))
    return let(F.array_join(word_list(col), " "), cut)


def truncate_words(col: Column, most: Column | int) -> Column:
    """B13. The first words, with an ellipsis if there are more."""
    cut = lambda words: F.concat(F.regexp_replace(F.array_join(F.slice(words, F.lit(1), most if isinstance(most, Column) else F.lit(most)), " "), "[,;:]+$", ""), F.lit("…"))
    return let(col, lambda x: let(word_list(x), lambda words: F.when(F.size(words) <= most, x).otherwise(cut(words))))


# Characters whose capital is one character where Java's ``upper`` gives several.
_CAPITALS = {"ß": "ẞ", **{chr(k): t for k in range(0x1F80, 0x1FFD) if len(chr(k).upper()) > 1 and len(t := chr(k).title()) == 1}}


def _capital(char: Column) -> Column:
    """The capital of one character, as one character; itself if it has none."""
    return let(F.translate(char, "".join(_CAPITALS), "".join(_CAPITALS.values())), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))


def _capitals(col: Column) -> Column:
    """``upper`` that changes no lengths."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(col, ""), _capital), "")).otherwise(F.upper(col))


def _raised(col: Column) -> Column:
    return F.concat(_capital(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30))


def heading_case(col: Column) -> Column:
    """B14. Capitals longer than three become title case, else the first letter is raised."""

    def run(t: Column) -> Column:
        upper = (t == _capitals(t)) & (t != F.lower(t)) & (F.length(t) > 3)
        return F.when(upper, F.array_join(F.transform(F.split(F.lower(t), " "), _raised), " ")).otherwise(_raised(t))

    return let(strip(col), run)


def two_places(col: Column) -> Column:
    """A number with two decimals as C's printf writes it: rounded from its binary value (0.615 lies below the middle),
    real middles to even. Java rounds its shortest decimal form. For numbers below 8 in size."""
    unit = 1 << 60  # all bits of a number of 1/256 or more stand above 1 / unit; smaller ones round to 0

    def run(m: Column) -> Column:
        size = F.abs(m).cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
        whole, rest = F.call_function("div", size, F.lit(unit).cast("decimal(20,0)")), size % F.lit(unit).cast("decimal(20,0)")
        return let(F.struct(whole.alias("w"), rest.alias("r"), (m < 0).alias("minus")), told)

    def told(x: Column) -> Column:
        cents = let(x["w"] + F.when((x["r"] > unit >> 1) | ((x["r"] == unit >> 1) & (x["w"] % 2 == 1)), 1).otherwise(0), lambda n: F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0")))
        return F.concat(F.when(x["minus"], F.lit("-")).otherwise(""), cents)

    return F.when(F.abs(col) < 8, let((col * float(unit)).cast("long"), run)).otherwise(F.format_string("%.2f", col))


def term_df(units: DataFrame, group: str, unit: str, text_col: str) -> DataFrame:
    """B15. In how many units of a group each content term occurs."""
    terms = units.select(group, unit, F.explode(F.array_distinct(content_tokens(text_col))).alias("term"))
    return terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))


def idf(units: DataFrame, group: str, unit: str, text_col: str) -> DataFrame:
    """B16. ``1 + n / (1 + df)`` of each term of a group of n units."""
    n = units.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return term_df(units, group, unit, text_col).join(n, group).select(group, "term", "df", (1 + F.col("n") / (1 + F.col("df"))).alias("idf"))


def idf_list(units: Column) -> Column:
    """B15, B16 inside the row, for a group's units as an array of texts: structs ``term, df, idf`` by term. All terms of the
    group are sorted there and counted, so that none is shuffled."""
    terms = lambda all_: F.sort_array(F.flatten(F.transform(all_, lambda x: F.array_distinct(content_tokens(x)))))
    told = lambda first, df, n: F.struct(first.alias("term"), df.cast("long").alias("df"), (1 + n / (1 + df)).alias("idf"))
    return let(units, lambda own: counted(terms(own), lambda t: t, lambda first, df: told(first, df, F.size(own))))


def cosine(a: Column, b: Column) -> Column:
    """B17. Of two arrays over their common length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    total = lambda x, y: F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when((n > 0) & (norm > 0), total(a, b) / norm).otherwise(0.0)


def extract_all(col: Column | str, pattern: str) -> Column:
    """B18. All matches of a pattern."""
    return F.regexp_extract_all(_text(col), F.lit(pattern), F.lit(0))


MATCH = "array<struct<start:int,value:string>>"


def _placed(raw: Column) -> Column:
    """Of a struct of matches (``found``) and the gaps around them, the matches with their places: a match
    starts after the lengths of the gaps and matches before it."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        return start + F.length(x["value"]), F.array(F.struct(start.alias("start"), x["value"].alias("value")))

    pairs = F.zip_with(F.slice(raw["gaps"], F.lit(1), F.size(raw["found"])), raw["found"], lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))
    return folded(pairs, F.lit(0), step, "int", MATCH)


def _raw(col: Column, pattern: str) -> Column:
    return F.struct(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)).alias("found"), F.split(col, pattern, -1).alias("gaps"))


def find_all(col: Column, pattern: str) -> Column:
    """All matches of a pattern with their places (code points from 0). The pattern runs once on texts
    without one."""
    return F.when(col.rlike(pattern), let(_raw(col, pattern), _placed)).otherwise(F.array().cast(MATCH))


def find_rules(col: Column, patterns: list[str], gates: list[Column]) -> Column:
    """``find_all`` of many patterns: an array of structs ``rule`` (from 0), ``start``, ``value``, by rule and place.
    A pattern runs only where its gate holds."""
    hits = [F.when(gate & col.rlike(p), F.struct(F.lit(k).alias("rule"), _raw(col, p).alias("raw"))) for k, (p, gate) in enumerate(zip(patterns, gates, strict=True))]
    one = lambda r: F.transform(_placed(r["raw"]), lambda m: F.struct(r["rule"].alias("rule"), m["start"].alias("start"), m["value"].alias("value")))
    return F.flatten(F.transform(F.filter(F.array(*hits), lambda r: r.isNotNull()), one))
