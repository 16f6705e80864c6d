"""Sections, sentence packing, hard splits, folding and offsets of chunks.

The greedy steps are sequential inside one document and run as folds over the document's own
array of sentences; documents are independent of each other and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, folded, heading_of, is_boilerplate, let, normalise_ws, sentence_array, strip

TARGET, OVERLAP, TINY = 1100, 180, 40
_SECTION = "array<struct<heading:string,body:string>>"
_CHUNK = "array<struct<heading:string,text:string>>"


def section_array(normalised: Column) -> Column:
    """D1. Heading lines open sections and are dropped, as blank and boilerplate lines are; a
    text without any section is one section."""
    lines = F.filter(F.split(normalised, "\n"), lambda x: (x != "") & ~is_boilerplate(x))
    marked = F.transform(lines, lambda x: F.struct(heading_of(x).alias("heading"), x.alias("line")))
    # a heading becomes a cut, its name and an end mark; then one split makes the sections
    flat = F.array_join(F.transform(marked, lambda m: F.when(m["heading"].isNotNull(), F.concat(F.lit("\u0002"), m["heading"], F.lit("\u0003"))).otherwise(m["line"])), "\n")
    parts = F.transform(
        F.split(F.concat(F.lit("\u0003"), flat), "\u0002"),
        lambda p: F.struct(
            F.when(F.substring_index(p, "\u0003", 1) != "", F.substring_index(p, "\u0003", 1)).alias("heading"), strip(F.substring_index(p, "\u0003", -1)).alias("body")
        ),
    )
    found = F.filter(parts, lambda s: s["body"] != "").cast(_SECTION)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"), normalised.alias("body"))).cast(_SECTION)
    return let(found, lambda own: F.when(F.size(own) > 0, own).when(normalised != "", whole).otherwise(F.array().cast(_SECTION)))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """D1 as rows: ``id, sec_no, heading, body``."""
    return docs.select(id_col, F.posexplode(section_array(normalise_ws(text_col))).alias("sec_no", "s")).select(id_col, "sec_no", "s.heading", "s.body")


def pack_sentences(sentences: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """D2. Greedy packing up to ``target`` characters; a new chunk starts with the last sentences
    of the one before it, as far as they fit ``overlap`` (a third of the target at most)."""
    overlap = min(overlap, target // 3)
    now = "struct<parts:array<string>,size:int>"
    state = lambda parts, size: F.struct(parts.alias("parts"), size.alias("size")).cast(now)

    def tail(parts: Column) -> Column:
        begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("size"), F.lit(True).alias("open"))

        def step(acc: Column, s: Column) -> Column:
            n = acc["size"] + F.length(s)
            taken = F.struct(F.concat(F.array(s), acc["parts"]).alias("parts"), (n + 1).alias("size"), F.lit(True).alias("open"))
            return F.when(acc["open"] & (n <= overlap), taken).otherwise(F.struct(acc["parts"].alias("parts"), acc["size"].alias("size"), F.lit(False).alias("open")))

        return F.aggregate(F.reverse(parts), begin, step, lambda acc: state(acc["parts"], acc["size"]))

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        """A null ends the section."""
        s, n = x["s"], x["n"]
        full = (F.size(acc["parts"]) > 0) & (s.isNull() | (acc["size"] + n > target))
        after = F.when(full & s.isNotNull(), let(tail(acc["parts"]), lambda t: state(F.concat(t["parts"], F.array(s)), t["size"] + n + 1)))
        return after.otherwise(state(F.concat(acc["parts"], F.array(s)), acc["size"] + n + 1)), F.when(full, F.array(F.array_join(acc["parts"], " "))).otherwise(F.array().cast("array<string>"))

    start = state(F.array().cast("array<string>"), F.lit(0))
    sized = F.transform(F.concat(sentences, F.array(F.lit(None).cast("string"))), lambda s: F.struct(s.alias("s"), F.length(s).alias("n")))
    return folded(sized, start, step, now, "array<string>")


def hard_split(piece: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """D3. Pieces of ``target`` characters, each ``target - overlap`` after the one before."""
    step = target - min(overlap, target // 3)
    cuts = F.sequence(F.lit(0), F.greatest(F.length(piece) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(piece) > target, F.transform(cuts, lambda i: F.substring(piece, i + 1, F.lit(target)))).otherwise(F.array(piece))


def fold_tiny(chunks: Column, target: int = TARGET) -> Column:
    """D4. Pieces of fewer than 40 characters join the chunk before them if it stays within
    1.3 targets."""

    one = "struct<heading:string,text:string>"

    def step(last: Column, c: Column) -> tuple[Column, Column]:
        """``last`` is the open chunk (null before the first); a null ends the text."""
        joins = last.isNotNull() & (F.length(c["text"]) < TINY) & (F.length(last["text"]) + F.length(c["text"]) + 1 <= int(target * 1.3))
        glued = F.struct(last["heading"].alias("heading"), F.concat_ws(" ", last["text"], c["text"]).alias("text")).cast(one)
        joins = F.coalesce(joins, F.lit(False))
        return F.when(joins, glued).otherwise(c), F.when(last.isNotNull() & ~joins, F.array(last)).otherwise(F.array().cast(_CHUNK))

    return folded(F.concat(chunks, F.array(F.lit(None).cast(one))), F.lit(None).cast(one), step, one, _CHUNK)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """D1-D5. ``id, ordinal, heading, text, char_start, char_end, token_estimate``.

    Offsets come from a forward search of a chunk's first 80 characters in the normalised text
    (the last chunk's start if they are not found)."""
    step = docs.select(F.col(id_col), normalise_ws(text_col).alias("source"))

    def cut(section: Column) -> Column:
        body = section["body"]
        packed = pack_sentences(sentence_array(F.regexp_replace(body, "\n", " ")), target, overlap)
        pieces = F.when(F.length(body) <= target, F.array(F.regexp_replace(body, "\n", " "))).otherwise(F.flatten(F.transform(packed, lambda p: hard_split(p, target, overlap))))
        return F.transform(F.filter(pieces, lambda p: strip(p) != ""), lambda p: F.struct(section["heading"].alias("heading"), strip(p).alias("text")))

    step = step.withColumn("pieces", F.flatten(F.transform(section_array(F.col("source")), cut)).cast(_CHUNK)).withColumn("pieces", fold_tiny(F.col("pieces"), target))
    flat = F.regexp_replace("source", "\n", " ")

    def search(cursor: Column, c: Column) -> tuple[Column, Column]:
        found = F.call_function("locate", F.substring(c["text"], 1, 80), F.col("flat"), cursor + 1) - 1
        start = let(found, lambda at: F.when(at >= 0, at).otherwise(cursor))
        return start, F.array(start)

    step = step.withColumn("flat", flat).withColumn("starts", folded(F.col("pieces"), F.lit(0), search, "int", "array<int>"))
    rows = step.select(id_col, F.posexplode(F.arrays_zip("pieces", "starts")).alias("ordinal", "z"))
    return rows.select(
        id_col,
        "ordinal",
        F.col("z.pieces.heading").alias("heading"),
        F.col("z.pieces.text").alias("text"),
        F.col("z.starts").alias("char_start"),
        (F.col("z.starts") + F.length("z.pieces.text")).alias("char_end"),
        estimate_tokens(F.col("z.pieces.text")).alias("token_estimate"),
    )


def chunk_stats(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """D6."""
    return rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("text")).alias("chars"), F.sum("token_estimate").alias("tokens"))
