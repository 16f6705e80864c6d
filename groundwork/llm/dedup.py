"""Exact deduplication with a heavy-hitter split; DataFrame functions only.

Each text is hashed once and the digests are written. A Misra-Gries summary with a
fixed number of counters in each map task names the few digests that may be frequent; no digest
is shuffled for it. Their exact counts and winners are verified in one map-side aggregate and
broadcast, so no row of a frequent text is shuffled; the other digests use an ordinary
aggregate and join.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, written

#: Frequent digests kept, and counters of a summary. Spark's ``approx_top_k`` is the mergeable Misra-Gries
#: summary of frequent items: with T counters it misses at most 3.5 rows / T of a digest.
HEAVY, COUNTERS = 1024, 8192


def digest_of(text: Column) -> Column:
    """32 bytes of the text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def short_name(digest: Column) -> Column:
    """64 bits of a digest, for counting only."""
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


def frequent_digests(rows: DataFrame, column: str = "digest", heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """``name``: 64-bit names of at most ``heavy`` digests; every digest with more than rows / (heavy / 2)
    rows is among them. Counters are merged by blocks of tasks, then once more."""
    blocks = F.pmod(F.spark_partition_id(), F.lit(max(16, partitions(rows.sparkSession))))
    named = rows.select(short_name(F.col(column)).alias("name"), blocks.alias("block"))
    summaries = named.groupBy("block").agg(F.expr(f"approx_top_k_accumulate(name, {counters})").alias("s"))
    # grouped, as the combining aggregate has no state for an empty partition
    top = summaries.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {heavy})")).alias("x"))
    return top.select(F.col("x.item").alias("name")).where("name is not null")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=lambda text: text,
    keep: str = "max",
    heavy: int = HEAVY,
    counters: int = COUNTERS,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when ``normalise(text)`` is; null counts as empty, very long texts are hashed
    whole. Of equal texts the row with the largest id stays (``keep='min'``: the smallest; null
    ids lose, and have ``kept`` null). Rows with equal ids count each, share one ``keep_id`` and are
    kept together: ``distinct_texts`` keeps one row of each text. Empty in, empty out. Other
    columns are not read.
    """
    best = F.max if keep == "max" else F.min
    rows = written(docs.select(F.col(id_col).alias("doc_id"), digest_of(normalise(F.coalesce(F.col(text_col), F.lit("")))).alias("digest")), "digests")
    found = frequent_digests(rows, heavy=heavy, counters=counters)
    # at most ``heavy`` rows of 56 bytes: a proven bound for the two broadcasts
    winners = (
        rows.join(F.broadcast(found), short_name(F.col("digest")) == found["name"], "left_semi")
        .groupBy("digest")
        .agg(best("doc_id").alias("h_keep"), F.count(F.lit(1)).alias("h_size"))
    )
    marked = rows.join(F.broadcast(winners), "digest", "left")
    frequent = marked.where(F.col("h_size").isNotNull()).select("doc_id", "digest", F.col("h_keep").alias("keep_id"), F.col("h_size").alias("group_size"))
    rest = marked.where(F.col("h_size").isNull()).select("doc_id", "digest")
    sizes = rest.groupBy("digest").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    ordinary = rest.join(sizes, "digest").select("doc_id", "digest", "keep_id", "group_size")
    return frequent.unionByName(ordinary).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that agree in ``keys`` (null counts as a value) the one that comes first by all its columns. Only
    rows whose keys repeat are shuffled whole, and they are reduced before the shuffle."""
    columns = rows.columns
    again = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys)), "again")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    many = rows.join(again, same, "left_semi").groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")
    return rows.join(again, same, "left_anti").unionByName(many.select(*columns))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps: one for each text, also where ids repeat or are null."""
    best = exact_dedup(docs, id_col, text_col, **options).where("kept or keep_id is null").select(F.col("doc_id").alias("_keep"), "text_sha256").distinct()
    digest = F.lower(F.hex(digest_of(options.get("normalise", lambda t: t)(F.coalesce(F.col(text_col), F.lit(""))))))
    rows = docs.withColumn("_sha", digest)
    kept = rows.join(best, (F.col("_sha") == F.col("text_sha256")) & F.col(id_col).eqNullSafe(F.col("_keep")), "left_semi")
    return one_of_each(kept, ["_sha"]).select(*docs.columns)
