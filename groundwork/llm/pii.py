"""Personal data by patterns, checksums and context; DataFrame functions only.

Patterns propose spans, checksums (octet range, Luhn, mod 97, digit counts) confirm
them, and words close to a span adjust its score: up where they speak for its kind, down
where they speak against personal data (order and version numbers, samples). Email, ip, card and
phone are base kinds, whose confirmed spans always count; a span of another kind (``iban``, and
``account``, bare digits without a checksum) counts only with a score of ``ACCEPT``, so that its context
decides. Positions are code points: a match starts after the lengths of all gaps and matches before it.

The patterns are written so that a run of characters is entered only at its start
(a look-behind, or the end of the last match) and never given back (possessive): they find
the same spans as the plain forms, in time linear in the text, without recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, let

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Compact, or in the printed form with single spaces between groups of four (the last one may be shorter).
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])"
#: A single space or hyphen between digits becomes this character, one for one.
JOINT = "\u0001"
CARD = rf"(?<![0-9{JOINT}])[0-9][0-9{JOINT}]{{12,}}+"

#: Account and identity numbers: digits, with single hyphens or spaces inside, and no checksum.
ACCOUNT = rf"(?<![0-9{JOINT}A-Za-z+.,:/_@-])[0-9][0-9{JOINT}]{{7,19}}+(?![0-9{JOINT}A-Za-z@_:/-]|[.,][0-9])"

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account")
#: Words that speak for a kind when they stand close to a span, before or after it.
CONTEXT = {
    "email": "mail|email|e-mail|contact|correo|courriel",
    "ip": "ip|host|server|address|adresse|client",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|cell|telefon|telefono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "account": "account|acct|passport|ssn|social security|identity|bank|konto|compte|cuenta|pasaporte|passeport",
}
#: Words that speak against personal data.
COUNTER = "order|invoice|version|build|release|isbn|serial|ticket|example|sample|test|dummy|bestellung|commande|pedido"
#: Score of a confirmed span before context: patterns with a checksum say more than those without.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.9, "account": 0.3}
CONTEXT_WINDOW, CONTEXT_BONUS, COUNTER_MALUS = 40, 0.2, 0.2
#: Least score of a span that is of no base kind.
ACCEPT = 0.5
MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "iban": "[IBAN]", "account": "[ACCOUNT]"}


def _joined_digits(text: Column) -> Column:
    """Digits with their single separators as one run each; length and places stay."""
    return F.regexp_replace(F.translate(text, JOINT, "\u0002"), r"(?<=[0-9])[ -](?=[0-9])", JOINT)


def _ip_ok(value: Column) -> Column:
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    number = lambda p: F.coalesce(F.when(F.ltrim(p, F.lit("0")) == "", F.lit(0)).otherwise(F.ltrim(p, F.lit("0")).try_cast("int")), F.lit(999)) <= 255
    return F.forall(F.split(value, r"\.", -1), lambda p: part(p) & number(p))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card_ok(value: Column) -> Column:
    return F.length(_digits(value)).between(13, 19) & F.coalesce(F.call_function("luhn_check", _digits(value)), F.lit(False))


def _phone_ok(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def _iban_ok(value: Column) -> Column:
    """Mod 97: country and check digits to the end, letters as 10 to 35, remainder 1."""
    value = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(value, 5, 34), F.substring(value, 1, 4))
    digits = F.split(moved, "(?!^)")
    code = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)))
    step = lambda acc, c: F.pmod(F.when(c.rlike("[A-Z]"), acc * 100).otherwise(acc * 10) + code(c), F.lit(97))
    return F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0), step) == 1


def _account_ok(value: Column) -> Column:
    """8 to 18 digits that are no card."""
    return F.length(_digits(value)).between(8, 18) & ~_card_ok(value)


_OK = {"email": lambda v: F.lit(True), "ip": _ip_ok, "card": _card_ok, "phone": _phone_ok, "iban": _iban_ok, "account": _account_ok}
_PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "account": ACCOUNT}
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"
_MATCH = "array<struct<start:bigint,end:bigint,value:string,near:string>>"


def _matches(kind: str, searched: Column) -> Column:
    """All matches of a kind and the gaps around them, unchecked; null where there is none."""
    pattern = _PATTERN[kind]
    found = F.regexp_extract_all(searched, F.lit(pattern), F.lit(0))
    gaps = F.split(searched, pattern, -1)
    return F.when(searched.rlike(pattern), F.struct(found.alias("found"), gaps.alias("gaps")))


def _placed(kind: str, raw: Column) -> Column:
    """The matches with their places (where each begins, given where the one before it ended) and the text
    around them: at most ``CONTEXT_WINDOW`` characters on each side, as far as the matches next to it."""
    found = raw["found"]
    before = F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))))
    near = F.zip_with(before, F.slice(raw["gaps"], F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).cast("bigint").alias("gap"), F.right(F.concat(m, g), F.lit(CONTEXT_WINDOW)).alias("near")))
    following = F.concat(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), F.array(F.lit("")))
    later = F.zip_with(F.slice(raw["gaps"], F.lit(2), F.size(found)), following, lambda g, m: F.left(F.concat(g, m), F.lit(CONTEXT_WINDOW)))
    near = F.zip_with(near, later, lambda n, a: F.struct(n["gap"].alias("gap"), F.concat(n["near"], F.lit("|"), a).alias("near")))
    items = F.zip_with(near, found, lambda n, m: F.struct(n["gap"].alias("gap"), n["near"].alias("near"), m.alias("value")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.length(x["value"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["near"].alias("near")))

    return F.when(raw.isNull(), F.array().cast(_MATCH)).otherwise(folded(items, F.lit(0).cast("bigint"), step, "bigint", _MATCH))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, text, spans``: confirmed spans of all kinds, by kind as listed
    in ``KINDS`` and start, with value and score.

    A span is a half-open range of code points. Null text counts as empty. Spans of different
    kinds may overlap, spans of one kind do not. Texts are read whole; the time for one with n matches grows
    as n ** 1.5 at most. Rows are independent (repeated rows and ids, null ids); other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_spans(rows)


def with_spans(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``spans`` (see ``find_spans``) for their column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [c for c in rows.columns if c != "spans"]
    # a cheap test per kind keeps most texts away from the patterns
    digit = text.rlike("[0-9]")
    rows = rows.withColumn("_joined", F.when(digit, _joined_digits(text)).otherwise(F.lit("")))
    sources = {
        "email": F.when(text.contains("@"), text).otherwise(F.lit("")),
        "ip": F.when(digit & text.contains("."), text).otherwise(F.lit("")),
        "card": F.col("_joined"),
        "phone": F.when(text.contains("+"), text).otherwise(F.lit("")),
        "iban": F.when(digit & text.rlike("[A-Z]{2}[0-9]{2}"), text).otherwise(F.lit("")),
        "account": F.when(F.col("_joined").rlike(f"[0-9{JOINT}]{{8}}") & F.lower(text).rlike(CONTEXT["account"]), F.col("_joined")).otherwise(F.lit("")),
    }
    for kind in KINDS:
        rows = rows.withColumn(f"_r_{kind}", _matches(kind, sources[kind]))
    for kind in KINDS:
        rows = rows.withColumn(f"_m_{kind}", _placed(kind, F.col(f"_r_{kind}")))

    def scored(kind: str) -> Column:
        said = lambda near, words: near.rlike(rf"(?i)(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")

        def rate(m: Column) -> Column:
            score = F.lit(PRIOR[kind]) + F.when(said(m["near"], CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0) - F.when(said(m["near"], COUNTER), COUNTER_MALUS).otherwise(0.0)
            value = F.translate(m["value"], JOINT, " ") if kind in ("card", "account") else m["value"]
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), value.alias("value"), F.round(score, 2).alias("score"))

        own = F.transform(F.filter(F.col(f"_m_{kind}"), lambda m: _OK[kind](m["value"])), rate)
        return (own if kind in BASE_KINDS else F.filter(own, lambda s: s["score"] >= ACCEPT)).cast(_SPAN)

    return rows.select(*(F.col(f"`{c}`") for c in columns), F.concat(*(scored(kind) for kind in KINDS)).alias("spans"))


def span_digest(spans: Column, kinds=KINDS) -> Column:
    """kind:start:end of the spans of ``kinds``, comma-joined in order."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans of each row."""
    found = find_spans(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(span_digest(F.col("spans"), BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        span_digest(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind's mask; overlapping spans become one
    mask, that of the span which starts first (then the longest)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))))
    mask = lambda kind: F.element_at(F.create_map(*(F.lit(x) for pair in MASK.items() for x in pair)), kind)
    kinds = "array<struct<start:bigint,end:bigint,mask:string>>"

    def first(at: Column, s: Column) -> tuple[Column, Column]:
        """Keep the span unless it starts inside those before it; lengthen the end reached."""
        one = F.array(F.struct(s["start"].alias("start"), (-s["minus"]).alias("end"), mask(s["kind"]).alias("mask"))).cast(kinds)
        return F.greatest(at, -s["minus"]), F.array(F.struct(F.greatest(at, -s["minus"]).alias("reach"), F.when(s["start"] >= at, one).otherwise(F.array().cast(kinds)).alias("one")))

    reached = folded(ordered, F.lit(0).cast("bigint"), first, "bigint", f"array<struct<reach:bigint,one:{kinds}>>")
    # a text is cut into blocks once; a piece is taken from the blocks that it lies in
    width = 1024
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / width).cast("int")), lambda k: F.substring(text, k * width + 1, width))

    def joined(bs: Column, steps: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            low = F.floor(a / width).cast("int")
            return F.substring(F.array_join(F.slice(bs, low + 1, F.floor(b / width).cast("int") - low + 1), ""), (a % width).cast("int") + 1, (b - a).cast("int"))

        ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(steps, lambda s: s["reach"]))
        masked = F.zip_with(F.slice(ends, F.lit(1), F.size(steps)), steps, lambda at, s: F.when(F.size(s["one"]) > 0, F.concat(piece(at, s["one"][0]["start"]), s["one"][0]["mask"])).otherwise(F.lit("")))
        return F.concat(F.array_join(masked, ""), piece(F.element_at(ends, -1), F.length(text).cast("bigint")))

    return F.when(F.size(spans) > 0, let(blocks, lambda bs: let(reached, lambda steps: joined(bs, steps)))).otherwise(text)


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with all confirmed spans masked; a null text stays null."""
    found = find_spans(docs, id_col, text_col)
    return found.select("doc_id", redacted(F.col("text"), F.col("spans")).alias("text"))
