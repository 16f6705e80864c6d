"""Sharding by longest-processing-time scheduling; groups of equal texts stay together.

The ``bytes`` law: shard sizes as near equal as the groups allow. LPT hands the groups,
largest first, to the least-loaded shard (a heap). Groups of one size are alike, so Spark counts
the groups of each size and the heap deals the counts; sizes are told to ``significant`` bits
(with 12, sizes below 4096 are exact, larger ones to 1 in 2048 or better), which bounds what the driver sees
for any input: 2048 classes to an octave. Since larger classes stand for their mean, the true
loads are summed once all inexact classes are dealt, and the exact ones level them. ``significant=None``
is plain LPT on exact sizes; the driver then sees a row for each different size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import digest_of, frequent_digests, short_name
from .shared import ranked, written

#: Bits of a group's size that count, unless told otherwise.
SIGNIFICANT = 12
OVERHEAD = 16


def deal(loads: list[int], size: int, count: int, heap: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """LPT of ``count`` groups of one ``size``: (shard, how many) with the loads updated.

    Bulk form of popping the least-loaded shard ``count`` times: whole rounds in which
    every shard gets as many as level them, then one by one.
    """
    shards = len(loads)
    given = [0] * shards
    if count > 4 * shards:
        # the level that all but the last few groups reach
        low, high = min(loads), max(loads) + size * (count // shards + 1)
        while low < high:
            mid = (low + high + 1) // 2
            if sum(max(0, (mid - x) // size) for x in loads) <= count:
                low = mid
            else:
                high = mid - 1
        for s in range(shards):
            given[s] = max(0, (low - loads[s]) // size)
            loads[s] += given[s] * size
        count -= sum(given)
    heap[:] = [(x, s) for s, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count):
        load, s = heapq.heappop(heap)
        given[s] += 1
        loads[s] = load + size
        heapq.heappush(heap, (loads[s], s))
    return [(s, n) for s, n in enumerate(given) if n]


def size_class(size: str, significant: int | None = SIGNIFICANT) -> Column:
    """The column ``size`` to so many bits, as a number that orders like sizes; exact where no bit is lost."""
    if significant is None:
        return F.col(size).cast("long")
    lost = f"cast(greatest(length(bin({size})) - {significant}, 0) as int)"
    return F.expr(f"cast({lost} as bigint) * {1 << significant} + shiftright({size}, {lost})")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", significant: int | None = SIGNIFICANT) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 16; rows with equal texts
    (null and empty count as equal) share a shard. ``slot`` numbers a shard's rows from 0
    by a hash of the ids. ``law`` is always ``bytes``, so ``grown_shard`` is null. Rows with equal
    or null ids are rows of their own, with a slot each. Ties between groups go by digest. Other columns are not
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        digest_of(text).alias("digest"),
    )
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("total")).withColumn("class", size_class("total", significant)), "groups")
    # bound by the number of classes, whatever the input
    counts = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("sum")).collect()
    numbered = ranked(groups, ["class"], "digest", "number")
    exact = 1 << (62 if significant is None else significant)  # classes below hold one size each

    def dealt(part: DataFrame, shares: dict[int, list[tuple[int, int]]]) -> DataFrame:
        """Groups of each class by number: so many to the first shard, so many to the next."""
        bounds = {c: (np.cumsum([n for _, n in g]), np.array([s for s, _ in g], np.int16)) for c, g in shares.items()}
        table = spark.sparkContext.broadcast(bounds)  # size classes x shards numbers at most

        def place(kind: pd.Series, number: pd.Series) -> pd.Series:
            out = np.zeros(len(kind), np.int32)
            num, by = number.to_numpy(), kind.to_numpy()
            for c in np.unique(by):
                own = np.flatnonzero(by == c)
                ends, to = table.value[int(c)]
                out[own] = to[np.searchsorted(ends, num[own], "right")]
            return pd.Series(out)

        return part.withColumn("shard", F.pandas_udf(place, "int")("class", "number")).select("digest", "total", "shard")

    loads, heap, shares = [0] * shards, [], {}
    for r in sorted((r for r in counts if r["class"] >= exact), key=lambda r: -r["class"]):
        shares[r["class"]] = deal(loads, round(r["sum"] / r["n"]), r["n"], heap)
    placed = written(dealt(numbered.where(F.col("class") >= exact), shares), "large")
    loads, shares = [0] * shards, {}
    for r in placed.groupBy("shard").agg(F.sum("total").alias("load")).collect():
        loads[r["shard"]] = int(r["load"])
    for r in sorted((r for r in counts if r["class"] < exact), key=lambda r: -r["class"]):
        shares[r["class"]] = deal(loads, r["class"], r["n"], heap)
    placed = written(placed.unionByName(dealt(numbered.where(F.col("class") < exact), shares)).select("digest", "shard"), "placed")
    # the shards of frequent texts are broadcast (HEAVY rows at most), so that no join key is hot
    found = frequent_digests(rows)
    hot = placed.join(F.broadcast(found), short_name(F.col("digest")) == found["name"], "left_semi").withColumnRenamed("shard", "h_shard")
    marked = rows.join(F.broadcast(hot), "digest", "left")
    few = marked.where("h_shard is not null").withColumn("shard", F.col("h_shard"))
    rest = marked.where("h_shard is null").join(placed, "digest")
    columns = ["doc_id", "size", "text_crc32", "shard"]
    assigned = written(few.select(*columns).unionByName(rest.select(*columns)), "assigned")
    return ranked(assigned, ["shard"], "doc_id", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

