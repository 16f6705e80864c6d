"""Helpers for the operators: shared tables, ranks without one-task sorts, and
array views of Arrow text columns.

Operators take any column names (``id_col``, ``text_col``) and select what they
need first, so extra columns with clashing names never reach a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_root

# --------------------------------------------------------------------------
# tables in the folder that the whole cluster sees


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage so that a lost executor never repeats what stands above."""
    path = f"{shared_root(df.sparkSession)}/groundwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------
# ranks inside groups of any size


def ranked(df: DataFrame, keys: list[str], order: str, into: str) -> DataFrame:
    """Number the rows of each ``keys`` group from 0, gapless, with no task per group.

    A group is cut into slices (as many as shuffle partitions, 64 at least) by the hash of ``order`` (unique per row): rows
    are numbered inside (keys, slice), and each slice starts after the counts of
    the slices before it. The table of starts has groups x slices rows.
    """
    slices = max(64, partitions(df.sparkSession))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(order), F.lit(slices)).cast("int"))
    counts = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order))
    return (
        cut.withColumn("_within", within)
        .join(starts, [*keys, "_slice"])
        .withColumn(into, F.col("_start") + F.col("_within") - 1)
        .drop("_slice", "_within", "_start")
    )


# --------------------------------------------------------------------------
# ids that may be in a table

_BLOCK = 1 << 16


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each id in a bitmap."""
    first = mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([first >> np.uint64(64 - bits), mix(first) >> np.uint64(64 - bits)]).astype(np.int64)


def id_filter(ids: DataFrame, column: str, bits: int = 26):  # noqa: ANN201
    """A test for a column of longs: false only for ids that ``ids`` lacks (and nulls). Its bitmap of 2 ** ``bits`` bits (8 MB)
    is put together by blocks and broadcast; where it fills up, more ids pass, so it only ever spares a join work."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(zero_copy_only=False), bits))
            cut = np.flatnonzero(np.diff(at // _BLOCK, prepend=-1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[cut] // _BLOCK, pa.int32()), pa.array([x.tobytes() for x in np.split((at % _BLOCK).astype(np.uint16), cut[1:])] if len(cut) else [], pa.binary())], names=["block", "at"]
            )

    def fill(table: pa.Table) -> pa.Table:
        own = np.zeros(_BLOCK, bool)
        for x in table.column("at").to_pylist():
            own[np.frombuffer(x, np.uint16)] = True
        return pa.table({"block": table.column("block").slice(0, 1), "at": pa.array([np.packbits(own).tobytes()], pa.binary())})

    known = ids.select(F.col(column).cast("long")).where(F.col(column).isNotNull())
    bitmap = np.zeros(max(1 << bits, _BLOCK) // 8, np.uint8)
    for r in known.mapInArrow(mark, "block int, at binary").groupBy("block").applyInArrow(fill, "block int, at binary").collect():
        bitmap[r["block"] * _BLOCK // 8 : (r["block"] + 1) * _BLOCK // 8] = np.frombuffer(r["at"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    def test(own: pd.Series) -> pd.Series:
        at = _places(own.to_numpy(), bits)
        return pd.Series(((shared.value[at >> 3] << (at & 7).astype(np.uint8)) & 128).astype(bool).all(axis=0))

    passes = F.pandas_udf(test, "boolean")
    return lambda name: F.col(name).isNotNull() & passes(F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long")))


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


# --------------------------------------------------------------------------
# arrays over Arrow text


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` (one long row may hold more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets in them; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BASE = 0x2545F4914F6CDD1D
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.full(max(n, 1 << 16), base, np.uint64)
            known[0] = 1
            known = np.multiply.accumulate(known)
        _powers[base] = known
    return known[:n]


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of ``values[s:e]`` for each run, in one pass over the values."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=total[1:])
        back = powers(pow(base, -1, 1 << 64), len(values) + 1)[starts]
        return mix((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64) * _GOLD)


def word_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: starts and ends in ``raw``, and the
    place of each row's first word (one entry more than rows)."""
    word = ~SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = edges[edges > 0] - 1
    last[inner] = word[inner]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return run_hash(_BYTE[raw], starts, ends)


def take_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``data[s : s + n]`` over the runs."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return data[:0]
    return data[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]
