"""Facts, topics, figures, entities and signals of each document, for a whole corpus at once.

Row-wise parts (indicators, dates, subject, ...) are expressions; parts that need term weights
work on one table of sentences and one of (document, sentence, term).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import rules
from ..functions.text import (
    content_tokens,
    counted,
    extract_all,
    heading_case,
    heading_of,
    let,
    normalise_ws,
    sentence_array,
    snippet,
    strip,
    strip_bullet,
    tokens,
    truncate_words,
    word_count,
)


def key_of(col: Column) -> Column:
    """Lower case, runs of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_]+", " "))


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentence_array(normalise_ws(text_col))).alias("sent_no", "sentence"))


def sentence_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sentences``: a row per document."""
    return docs.select(F.col(id_col).alias("doc_id"), sentence_array(normalise_ws(text_col)).alias("sentences"))


def sentence_terms(sentences: DataFrame) -> DataFrame:
    """``doc_id, sent_no, term, idf, max_idf`` for the distinct content terms of each sentence."""
    by = Window.partitionBy("doc_id")
    # all keys begin with the document: its sentences are dealt once, and windows do the rest
    rows = sentences.repartition("doc_id").withColumn("n", F.count(F.lit(1)).over(by))
    terms = rows.select("doc_id", "sent_no", "n", F.explode(F.array_distinct(content_tokens("sentence"))).alias("term"))
    df = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "term"))
    terms = terms.withColumn("idf", 1 + F.col("n") / (1 + df)).withColumn("max_idf", F.max("idf").over(by))
    return terms.select("doc_id", "term", "sent_no", "idf", "max_idf")


def score_sentences(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """F1. Idf mass over the root of the number of terms, less for short or long sentences, more
    for the first three; 0 without terms."""
    mass = terms.groupBy("doc_id", "sent_no").agg((F.sum("idf") / F.sqrt(F.count(F.lit(1)))).alias("mass"))
    length = F.when(word_count("sentence").between(8, 45), 1.0).otherwise(0.72)
    place = F.when(F.col("sent_no") == 0, 1.22).when(F.col("sent_no") < 3, 1.10).otherwise(1.0)
    return sentences.join(mass, ["doc_id", "sent_no"], "left").withColumn("score", F.round(F.coalesce("mass", F.lit(0.0)) * length * place, 9)).drop("mass")


def topics(scored: DataFrame, terms: DataFrame, most: int = 12) -> DataFrame:
    """F2. The terms with the most score-weighted idf mass, ties alphabetical."""
    mass = terms.join(scored.select("doc_id", "sent_no", "score"), ["doc_id", "sent_no"]).groupBy("doc_id", "term").agg(F.round(F.sum(F.col("score") * F.col("idf") / F.col("max_idf")), 6).alias("mass"))
    ranked = mass.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("mass"), "term"))).where(F.col("r") <= most)
    return ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]).alias("topics"))


#: Documents that Python weighs at once.
SLICE = 256
SCORED = "array<struct<sent_no:int,sentence:string,score:double>>"


def scored_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 12) -> DataFrame:
    """F1 and F2 in one pass: ``doc_id, body, sentences`` (number, text, score as ``score_sentences``), ``topics`` (as
    ``topics``). All weights are of one document, so they are summed beside its own row: no term is exploded or dealt."""
    step = docs.select(F.col(id_col).alias("doc_id"), normalise_ws(text_col).alias("body"))
    return _scored(step, most)


def _scored(step: DataFrame, most: int = 12) -> DataFrame:
    """``step`` (with ``body``) and ``sentences, topics``; its other columns pass through Python as they are, so that what
    stands above reads them and does not work them out again."""
    kept = step.columns
    step = step.withColumn("s", sentence_array(F.col("body")))
    step = step.select(*kept, "s", F.transform("s", word_count).alias("words"), F.transform("s", lambda x: F.array_distinct(content_tokens(x))).alias("terms"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            cut, scores, best = _weighed(batch.column("words"), batch.column("terms"), most)
            number = (np.arange(cut[-1]) - np.repeat(cut[:-1], np.diff(cut))).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(number), batch.column("s").flatten().cast(pa.string()), pa.array(scores)], names=["sent_no", "sentence", "score"])
            cols = [*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(cut), rows), best]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "sentences", "topics"])

    more = StructType.fromDDL(f"sentences {SCORED}, topics array<string>")
    return step.mapInArrow(weigh, StructType([*(step.schema[c] for c in kept), *more.fields]))


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    """``x``, not negative, to some decimals, halves up as SQL and C round them (numpy rounds them to even)."""
    unit = 10.0**places
    whole = np.floor(x * unit)
    return (whole + (x * unit - whole >= 0.5)) / unit


def _weighed(words: pa.ListArray, terms: pa.ListArray, most: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Of documents' word counts and distinct terms by sentence: where each document's sentences begin (and the last
    end), the scores of all sentences, and each document's topics."""
    sizes = lambda x: x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    docs, own = len(words), terms.flatten()
    n, held = sizes(words), sizes(own)
    cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    doc = np.repeat(np.arange(docs), n)
    place = np.arange(cut[-1]) - cut[doc]
    length = words.flatten().to_numpy(zero_copy_only=False)
    coded = own.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    rank = np.empty(len(known), np.int64)
    rank[sorted(range(len(known)), key=known.__getitem__)] = np.arange(len(known))
    sentence = np.repeat(np.arange(cut[-1]), held)
    key, at, df = np.unique(doc[sentence] * max(len(known), 1) + rank[coded.indices.to_numpy(zero_copy_only=False)], return_inverse=True, return_counts=True)
    of = key // max(len(known), 1)
    idf = 1 + n[of] / (1 + df)
    top = np.ones(docs)
    np.maximum.at(top, of, idf)
    share = np.bincount(sentence, idf[at], minlength=cut[-1]) / np.sqrt(np.maximum(held, 1))
    scores = _rounded(share * np.where((length >= 8) & (length <= 45), 1.0, 0.72) * np.where(place == 0, 1.22, np.where(place < 3, 1.10, 1.0)), 9)
    mass = _rounded(np.bincount(at, scores[sentence] * idf[at] / top[of[at]], minlength=len(key)), 6)
    by = np.lexsort((key, -mass, of))  # keys of a document stand in the order of its terms
    place = np.arange(len(by)) - np.searchsorted(of, of)  # ``of`` is sorted, and stays so
    by = by[place < most]
    names = [known[k] for k in np.argsort(rank)[key[by] % max(len(known), 1)].tolist()]
    ends = np.concatenate([[0], np.cumsum(np.bincount(of[by], minlength=docs))]).astype(np.int32)
    return cut, scores, pa.ListArray.from_arrays(pa.array(ends), pa.array(names, pa.string()))


def usable_sentences(sentences: Column, headings: Column, title: Column) -> Column:
    """F7 inside the row; ``title`` is the subject's key."""

    def ok(x: Column) -> Column:
        def run(key: Column) -> Column:
            text = x["sentence"]
            noise = (text == rules.SUPPRESSED) | F.array_contains(headings, key) | ((F.length(text) < 25) & ~text.rlike("[0-9]"))
            return ~noise & ~((title != "") & (key.startswith(title) | title.startswith(key)))

        return (x["score"] > 0) & let(key_of(x["sentence"]), run)

    return F.filter(sentences, ok)


def best_in_order(sentences: Column, most: int) -> Column:
    """The ``most`` best sentences, back in the order of the text."""
    best = F.slice(F.array_sort(F.transform(sentences, lambda x: F.struct((-x["score"]).alias("minus"), x["sent_no"].alias("sent_no"), x["sentence"].alias("sentence")))), 1, most)
    return F.array_sort(F.transform(best, lambda x: F.struct(x["sent_no"].alias("sent_no"), x["sentence"].alias("sentence"), (-x["minus"]).alias("score"))))


def row_summary(usable_: Column, most: int = 6) -> Column:
    """F8 inside the row."""
    return F.array_join(F.transform(best_in_order(usable_, most), lambda x: truncate_words(x["sentence"], 34)), " ")


def row_key_facts(best: Column) -> Column:
    """F9 inside the row, from the best sentences in order (a variable: it is read for each of them)."""
    fact = lambda x: F.struct(
        snippet(x["sentence"], 320).alias("text"), classify(x["sentence"]).alias("category"), F.round(x["score"], 4).alias("score"), x["sent_no"].alias("position"), x["sentence"].rlike(f"(?i){rules.NUMBER}").alias("has_number"),
    )
    once = lambda sign: F.filter(best, lambda x, i: F.array_position(sign, F.element_at(sign, i + 1)) == i + 1)
    return F.transform(let(F.transform(best, lambda x: F.substring(key_of(x["sentence"]), 1, 90)), once), fact)


def scored_knowledge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_knowledge`` with ``sentences, topics, summary, key_facts``: a row per document, without a shuffle."""
    rows = with_row_knowledge(docs.select(F.col(id_col).alias("doc_id"), normalise_ws(text_col).alias("body")))
    step = _scored(rows.withColumn("title", key_of(F.col("subject"))))
    both = lambda u: F.struct(row_summary(u).alias("summary"), let(best_in_order(u, 16), row_key_facts).alias("key_facts"))
    step = step.withColumn("_k", let(usable_sentences(F.col("sentences"), F.col("headings"), F.col("title")), both))
    return step.select(*(c for c in step.columns if c not in ("_k", "title")), "_k.summary", "_k.key_facts")


# What every match of an indicator has, by text and lower text: a pattern runs only on texts that have it.
_GATES = (
    lambda t, low: low.contains("cve-"),
    lambda t, low: low.contains("cwe-"),
    lambda t, low: t.contains("."),
    lambda t, low: t.rlike("[0-9a-f]{40}"),
    lambda t, low: t.rlike("[0-9a-f]{40}"),
    lambda t, low: low.contains("mitre att&ck"),
    lambda t, low: t.contains("T"),
)


def indicators(text: Column) -> Column:
    """F3."""
    none = F.array().cast("array<string>")

    def run(t: Column) -> Column:
        return let(F.lower(t), lambda low: F.concat(*(F.when(gate(t, low), extract_all(t, p)).otherwise(none) for p, gate in zip(rules.INDICATORS, _GATES, strict=True))))

    return F.slice(F.array_distinct(let(text, run)), 1, 25)


def dates(text: Column) -> Column:
    """F4."""
    found = F.transform(extract_all(text, f"(?i){rules.DATE}"), strip)
    return F.slice(F.array_distinct(F.filter(found, lambda d: d != "")), 1, 20)


def figures(text: Column, known: Column) -> Column:
    """F5. Numbers of three digits or more that are no part of an indicator; most digits first."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    values = F.transform(extract_all(text, f"(?i){rules.NUMBER}"), lambda v: strip(F.regexp_replace(strip(v), r"\.+$", "")))
    kept = F.filter(
        F.array_distinct(values),
        lambda v: (v != "") & ~v.rlike(r"^\d+[.)]?$") & (F.length(digits(v)) >= 3) & ~F.exists(known, lambda i: i.contains(v) | v.contains(i)),
    )
    order = lambda a, b: F.when(F.length(digits(a)) != F.length(digits(b)), F.length(digits(b)) - F.length(digits(a))).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.slice(F.array_sort(kept, order), 1, 25)


def subject(text: Column) -> Column:
    """F6. Of the first 12 lines: the first title-like one, else the first of 3 to 18 words
    without a full stop, else a snippet."""

    def named(first: Column) -> Column:
        titles = F.filter(first, lambda x: x.rlike(rules.TITLE_SIGNAL) & F.length(x).between(12, 220))
        plain = F.filter(first, lambda x: ~x.endswith(".") & let(word_count(x), lambda n: n.between(3, 18)))
        return F.coalesce(F.try_element_at(titles, F.lit(1)), F.try_element_at(plain, F.lit(1)))

    def run(t: Column) -> Column:
        found = let(F.transform(F.slice(F.split(t, "\n", 13), 1, 12), strip_bullet), named)
        return F.coalesce(found, let(snippet(t, 120), lambda rest: F.when(rest != "", rest)), F.lit("Untitled source"))

    return let(text, run)


def heading_keys(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.lower(heading_of(x))), lambda h: h.isNotNull()))


def classify(sentence: Column) -> Column:
    """F10."""
    return (
        F.when(sentence.rlike(rules.ACTION), "recommendation")
        .when(sentence.rlike(rf"{rules.PERCENT}(?:\b|(?<=%))"), "impact")
        .when(sentence.rlike(rules.COPULA) & sentence.rlike(f"(?i){rules.NUMBER}"), "finding")
        .when(sentence.rlike(rules.REPORTED), "finding")
        .when(sentence.rlike(f"(?i){rules.DATE}"), "timeline")
        .when(sentence.rlike(rules.SELF), "finding")
        .otherwise("context")
    )


def with_row_knowledge(step: DataFrame) -> DataFrame:
    """``step`` (with a column ``body``) and F3-F6, F15."""
    step = step.withColumn("indicators", indicators(F.col("body"))).withColumn("headings", heading_keys(F.col("body")))
    return step.withColumns({"dates": dates(F.col("body")), "figures": figures(F.col("body"), F.col("indicators")), "subject": subject(F.col("body")), "reading_level": reading_level(F.col("body"))})


def row_knowledge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """F3-F6, F15: what needs no term weights, one row per document."""
    rows = with_row_knowledge(docs.select(F.col(id_col).alias("doc_id"), normalise_ws(text_col).alias("body")))
    return rows.select("doc_id", "body", "indicators", "headings", "dates", "figures", "subject", "reading_level")


def usable(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """F7. Sentences with a score that are neither the title line nor noise."""
    joined = scored.where("score > 0").join(rows.select("doc_id", "headings", key_of(F.col("subject")).alias("title")), "doc_id")
    key = key_of(F.col("sentence"))
    noise = (F.col("sentence") == rules.SUPPRESSED) | F.array_contains("headings", key) | ((F.length("sentence") < 25) & ~F.col("sentence").rlike("[0-9]"))
    title = (F.col("title") != "") & (key.startswith(F.col("title")) | F.col("title").startswith(key))
    return joined.where(~noise & ~title).drop("headings", "title")


def _best(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "sent_no")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def _in_order(value: Column | str, order: str = "sent_no") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), (F.col(value) if isinstance(value, str) else value).alias("v")))), lambda s: s["v"])


def summary(rows: DataFrame, most: int = 6) -> DataFrame:
    """F8. The best sentences in text order, each of at most 34 words."""
    cut = _best(rows, most).withColumn("s", truncate_words(F.col("sentence"), 34))
    return cut.groupBy("doc_id").agg(F.array_join(_in_order("s"), " ").alias("summary"))


def key_facts(rows: DataFrame, most: int = 16) -> DataFrame:
    """F9. The best sentences in text order, the first of equal starts, with category and score."""
    best = _best(rows, most).withColumn("signature", F.substring(key_of(F.col("sentence")), 1, 90))
    once = best.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "signature").orderBy("sent_no"))).where("n = 1")
    fact = F.struct(
        snippet(F.col("sentence"), 320).alias("text"), classify(F.col("sentence")).alias("category"), F.round("score", 4).alias("score"),
        F.col("sent_no").alias("position"), F.col("sentence").rlike(f"(?i){rules.NUMBER}").alias("has_number"),
    )
    return once.withColumn("fact", fact).groupBy("doc_id").agg(_in_order("fact").alias("key_facts"))


def _first_lines(sentences: Column, found: Callable[[Column], Column], most: int, chars: int) -> Column:
    return F.transform(F.slice(F.filter(sentences, found), 1, most), lambda x: snippet(x, chars))


# Words of which every match of a signal's pattern has one: a pattern runs only on texts that have it.
_SIGNAL_MARKS = {
    "recommendation": ("recommend", "mitigation", "remediation", "next", "action"),
    "impact": ("impact", "consequence", "severity", "rating", "radius", "affected"),
    "finding": ("finding", "observed", "analysis", "evidence", "indicator", "detected"),
    "context": ("context", "background", "overview", "introduction", "scope", "document"),
    "timeline": ("timeline", "on", "reported", "subsequently", "then", "followed"),
}
_RISK_MARKS = ("critical", "severe", "risk", "urgent", "immediate", "outage", "breach", "exploit", "compromise", "attack", "day", "loss")


def _marked(low: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (low.contains(m) for m in marks))


def row_signals(sentences: Column, most: int = 4) -> Column:
    """F11 inside the row: map of family to its first sentences, by name; null without any."""

    def run(low: Column) -> Column:
        def own(name: str, pattern: str) -> Column:
            lines = _first_lines(sentences, lambda x: x.rlike(pattern), most, 260)
            return F.when(_marked(low, _SIGNAL_MARKS[name]), F.struct(F.lit(name).alias("signal"), lines.alias("sentences")))

        found = F.filter(F.array(*(own(name, p) for name, p in sorted(rules.SIGNALS.items()))), lambda e: e.isNotNull() & (F.size(e["sentences"]) > 0))
        return let(found, lambda entries: F.when(F.size(entries) > 0, F.map_from_entries(entries)))

    return let(F.lower(F.array_join(sentences, "\n")), run)


def section_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """F11. ``doc_id, signal, sentences``: the first sentences of each family."""
    rows = sentence_lists(docs, id_col, text_col)
    return rows.select("doc_id", F.explode(row_signals(F.col("sentences"), most)).alias("signal", "sentences"))


MENTIONS = "array<struct<name:string,mentions:bigint,sent_no:int>>"


def row_mentions(sentences: Column, headings: Column, known: Column, title: Column) -> Column:
    """F12, first half, inside the row: names of capitalised runs by name, with mentions and first sentence, before names inside
    other names are left out. ``known`` are the indicators, ``title`` is the subject's key."""

    def name_of(words: Column) -> Column:
        """Without stop words at either end; null if nothing is left."""
        good = F.transform(words, lambda w: (~F.lower(w).isin(*rules.STOP_WORDS)).cast("int"))

        def cut(g: Column) -> Column:
            first, after = F.array_position(g, 1).cast("int"), F.size(g) - F.array_position(F.reverse(g), 1).cast("int") + 2
            return F.when(first > 0, F.array_join(F.slice(words, F.greatest(first, F.lit(1)), F.greatest(after - first, F.lit(0))), " "))

        return let(good, cut)

    words = lambda run: F.filter(F.split(F.regexp_replace(run, r"^[ .,\-]+|[ .,\-]+$", ""), r"\s+"), lambda w: w != "")
    named = lambda x, i: F.transform(extract_all(x, rules.PROPER_NOUN), lambda run: F.struct(let(words(run), name_of).alias("name"), i.alias("sent_no")))
    found = lambda lines: F.sort_array(F.filter(F.flatten(F.transform(lines, named)), lambda m: m["name"].isNotNull()))

    def stands(m: Column, own: Column) -> Column:
        def run(low: Column) -> Column:
            fits = (F.size(F.split(m["name"], " ")) <= 4) & (F.length(m["name"]) >= 3) & ~low.isin(*rules.STOP_WORDS, *rules.NON_ENTITIES, *rules.MONTHS)
            clash = F.exists(own["known"], lambda i: i.contains(low) | low.contains(i))
            return fits & ~F.array_contains(own["headings"], low) & (low != own["title"]) & ~clash

        return let(F.lower(m["name"]), run)

    count = lambda first, n: F.struct(first["name"].alias("name"), n.cast("long").alias("mentions"), first["sent_no"].alias("sent_no"))
    # one struct, so that what each name is compared with is not worked out for each name
    own = F.struct(sentences.alias("lines"), headings.alias("headings"), F.transform(known, F.lower).alias("known"), title.alias("title"))
    return let(own, lambda own: F.filter(counted(found(own["lines"]), lambda m: m["name"], count).cast(MENTIONS), lambda m: stands(m, own)))


def row_entities(mentions: Column, sentences: Column, title: Column, most: int = 18) -> Column:
    """F12, F13 inside the row. Names by (mentions, name); one inside a kept name goes, a single word needs two
    mentions or capitals; at most ``most``."""
    capitals = lambda name: (name == F.upper(name)) & (name != F.lower(name))
    weighty = F.filter(mentions, lambda e: e["name"].contains(" ") | (e["mentions"] >= 2) | capitals(e["name"]))
    one = "struct<minus:bigint,name:string,sent_no:int,low:string>"
    ordered = F.sort_array(F.transform(weighty, lambda e: F.struct((-e["mentions"]).alias("minus"), e["name"].alias("name"), e["sent_no"].alias("sent_no"), F.lower(e["name"]).alias("low")).cast(one)))

    def step(acc: Column, e: Column) -> Column:
        new = (F.size(acc) < most) & ~F.exists(acc, lambda s: s["low"].contains(e["low"]))
        return F.when(new, F.concat(acc, F.array(e))).otherwise(acc).cast(f"array<{one}>")

    told = lambda e, own: F.struct(
        heading_case(e["name"]).alias("name"), (-e["minus"]).alias("mentions"), entity_kind(e["name"], own["title"]).alias("kind"), snippet(F.element_at(own["lines"], e["sent_no"] + 1), 160).alias("context"),
    )
    kept = F.aggregate(ordered, F.array().cast(f"array<{one}>"), step)
    return let(F.struct(kept.alias("kept"), sentences.alias("lines"), title.alias("title")), lambda own: F.transform(own["kept"], lambda e: told(e, own)))


def _before_mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What mentions are found in: ``doc_id, sentences, headings, indicators, title``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalise_ws(text_col).alias("body"))
    body = F.col("body")
    return rows.select("doc_id", sentence_array(body).alias("sentences"), heading_keys(body).alias("headings"), indicators(body).alias("indicators"), key_of(subject(body)).alias("title"))


# Rows are made from expressions, not from columns: Spark adds a filter to an exploded column, and works the column out twice.


def entity_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """F12, first half: ``doc_id, name, mentions, sent_no`` of all documents."""
    found = row_mentions(F.col("sentences"), F.col("headings"), F.col("indicators"), F.col("title"))
    return _before_mentions(docs, id_col, text_col).select("doc_id", F.inline(found))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 18) -> DataFrame:
    """``doc_id, name, mentions, kind, context``, those of a document in their order."""
    found = row_mentions(F.col("sentences"), F.col("headings"), F.col("indicators"), F.col("title"))
    return _before_mentions(docs, id_col, text_col).select("doc_id", F.inline(row_entities(found, F.col("sentences"), F.col("title"), most)))


def entity_kind(name: Column, title: Column) -> Column:
    """F13."""
    return (
        F.when(name.rlike(rules.TITLE_SIGNAL) | ((title != "") & title.contains(F.lower(name))), "document")
        .when(name.rlike(rules.ORGANISATION), "organisation")
        .when(name.rlike(rules.PRODUCT), "product")
        .otherwise("term")
    )


def objective(text: Column, advises: Column) -> Column:
    """F14. From the signals and the first 6000 characters (the limit is the operator's)."""
    low = F.lower(F.substring(text, 1, 6000))
    return F.when(advises, "advise").when(low.rlike(rules.URGENT), "escalate").when(low.rlike(rules.FINDINGS), "report").when(low.rlike(rules.AWARENESS), "awareness").otherwise("inform")


def reading_level(text: Column) -> Column:
    """F15. Technical if more than 9 % of the tokens have nine characters or more."""
    share = lambda words: F.size(F.filter(words, lambda w: F.length(w) >= 9)) / F.greatest(F.size(words), F.lit(1))
    return F.when(let(tokens(text), share) > 0.09, "technical").otherwise("general")


def row_risk_markers(sentences: Column, most: int = 6) -> Column:
    """F16 inside the row."""
    lines = _first_lines(sentences, lambda x: x.rlike(rules.RISK_WORD), most, 200)
    return let(F.lower(F.array_join(sentences, "\n")), lambda low: F.when(_marked(low, _RISK_MARKS), lines).otherwise(F.array().cast("array<string>")))


def risk_markers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 6) -> DataFrame:
    """F16 of the documents that have any."""
    rows = sentence_lists(docs, id_col, text_col)
    return rows.select("doc_id", F.explode(F.filter(F.array(row_risk_markers(F.col("sentences"), most)), lambda m: F.size(m) > 0)).alias("risk_markers"))


def build_knowledge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """F17. One row per document with all of the above, made inside its row: nothing is shuffled. Documents without
    sentences have empty lists."""
    rows = scored_knowledge(docs, id_col, text_col).withColumn("lines", F.transform("sentences", lambda x: x["sentence"])).withColumn("title", key_of(F.col("subject")))
    lines, title = F.col("lines"), F.col("title")
    found = let(row_mentions(lines, F.col("headings"), F.col("indicators"), title), lambda m: F.when(F.size(m) > 0, row_entities(m, lines, title)))
    rows = rows.withColumns({"entities": found, "section_signals": row_signals(lines), "risk_markers": row_risk_markers(lines)})
    advises = F.coalesce(F.map_contains_key("section_signals", "recommendation"), F.lit(False))
    return rows.select(
        "doc_id", "summary", "subject", "topics", F.when(F.size("key_facts") > 0, F.col("key_facts")).alias("key_facts"), "entities", "indicators", "dates", "figures",
        objective(F.col("body"), advises).alias("objective"), "reading_level", F.lit("deterministic").alias("build_mode"), "section_signals", "risk_markers",
    )


def bundle_view(knowledge: DataFrame) -> DataFrame:
    """F17, rebuilt view: sentences, signals and risks are taken from the key facts."""
    facts = F.coalesce("key_facts", F.array().cast("array<struct<text:string,category:string,score:double,position:int,has_number:boolean>>"))
    text = F.transform(facts, lambda f: f["text"])
    first = lambda pattern: F.slice(F.filter(text, lambda t: t.rlike(pattern)), 1, 4)
    signals = F.map_from_arrays(F.array(*map(F.lit, rules.SIGNALS)), F.array(*map(first, rules.SIGNALS.values())))
    return knowledge.drop("section_signals", "risk_markers").select("*", text.alias("sentences"), signals.alias("section_signals"), F.slice(F.filter(text, lambda t: t.rlike(rules.RISK_WORD)), 1, 6).alias("risk_markers"))
