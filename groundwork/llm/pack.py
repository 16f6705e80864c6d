"""Best-fit packing by exact-complement hashing.

Packing looks only at lengths, and there are at most ``capacity`` of them. Spark
counts the pieces of each length; the planner works on that histogram (its size is
bound by the capacity, whatever the corpus holds) and returns patterns: a list of
lengths and how many sequences use it. Spark then numbers the pieces of each length
and looks up each number's sequence and offset in the patterns.

Planner: for a piece of length L the gap is capacity - L. An index of the sums of one, two
and three available lengths is looked up at the gap; a combination that fills it exactly is
consumed as often as the counts allow, and lengths that are used up leave the index. What
has no exact complement goes best-fit: the longest piece that still fits, again and again.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import ranked, slices, written

CAPACITY = 1024


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the ``.json`` tokenizer beside a rank file; they match anywhere in a text."""
    whole = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(whole):
        return {}
    with open(whole, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError("added tokens that strip or match whole words are not built")
    return {t["content"]: t["id"] for t in found}


def piece_table(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, append ``end_id`` and cut documents longer than
    ``capacity`` into pieces; the first piece takes the remainder, so that all
    others are full. Columns ``doc_id, piece, start, length, ids_crc32`` and ``ids``
    with ``keep_ids``. ``path`` holds the ranks of the vocabulary; its added tokens are
    read from the tokenizer of the same name beside it, if there is one."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    added = added_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text"):
            ids, at = enc.encode_added(batch.column("text").fill_null("").to_pylist(), added)
            doc = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for k in range(len(doc)):
                own = np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4")
                head = len(own) % capacity or capacity
                cuts = [0, *range(min(head, len(own)), len(own) + 1, capacity)]
                raw = own.tobytes()
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc[k], p, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), own[a:b] if keep_ids else None))
            if rows:
                d, p, a, n, c, x = zip(*rows, strict=True)
                cols = [pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array([v.astype(np.int32) for v in x], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)


class SumIndex:
    """Which of the lengths in ``left`` (length: count) add up to a sum, in ones, twos and threes.

    ``pairs[s]`` holds the larger lengths a of pairs (a, s - a); ``triples[s]`` the largest lengths
    a that some pair of sum s - a completes. Entries whose lengths are used up are dropped when met."""

    def __init__(self, left: dict[int, int], capacity: int):
        self.left, self.lengths = left, sorted(left, reverse=True)
        self.pairs: dict[int, list[int]] = {}
        for i, a in enumerate(self.lengths):
            for b in self.lengths[i:]:
                if a + b <= capacity:
                    self.pairs.setdefault(a + b, []).append(a)
        self.triples: dict[int, list[int]] = {}

    def _pairs(self, total: int) -> list[int]:
        found = self.pairs.get(total)
        if not found:
            return []
        if any(a not in self.left or total - a not in self.left for a in found):
            found = self.pairs[total] = [a for a in found if a in self.left and total - a in self.left]
        return found

    def _triples(self, total: int) -> list[int]:
        found = self.triples.get(total)
        if found is None:
            found = [a for a in self.lengths if 3 * a >= total > a]
        found = self.triples[total] = [a for a in found if a in self.left and self._pairs(total - a)]
        return found

    def find(self, total: int, used: list[int]) -> list[int] | None:
        """One to three lengths of sum ``total`` that the counts allow beside ``used``, fewest and longest first."""

        def enough(more: tuple[int, ...]) -> bool:
            return all(self.left.get(n, 0) >= more.count(n) + used.count(n) for n in more)

        if enough((total,)):
            return [total]
        for a in self._pairs(total):
            if enough((a, total - a)):
                return [a, total - a]
        for a in self._triples(total):
            for b in self._pairs(total - a):
                if b <= a and enough((a, b, total - a - b)):
                    return [a, b, total - a - b]
        return None


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths, times) patterns that use up ``counts``; each fits into ``capacity``.

    Every step uses up one length at least, or fills sequences with as many copies of
    one length as fit, so there are at most a few patterns per length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    index = SumIndex(left, capacity)
    out: list[tuple[list[int], int]] = []
    while left:
        longest = max(left)
        lengths, room = [longest], capacity - longest
        while room:
            # an exact complement of the gap, else the longest piece that fits
            found = index.find(room, lengths)
            if found is None:
                best = max((n for n in left if n <= room and left[n] > lengths.count(n)), default=None)
                if best is None:
                    break
                found = [best]
            lengths += found
            room -= sum(found)
        need = {n: lengths.count(n) for n in lengths}
        times = min(left[n] // k for n, k in need.items())
        out.append((sorted(lengths, reverse=True), times))
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` (from 0) and ``offset`` to ``pieces`` (unique ``doc_id, piece``
    with ``length``); offsets in a sequence are gapless from 0.

    ``pieces`` is read twice and should be a written table. Ties between equal lengths
    go by a hash of (doc_id, piece); equal rows take places of their own. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    # at most ``capacity`` rows reach the driver
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan_patterns(counts, capacity):
        offset = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            # pieces number seen .. seen + k * times - 1 of this length: k to a sequence
            slots.setdefault(n, []).append((seen.get(n, 0), k, sequence, offset, n))
            seen[n] = seen.get(n, 0) + k * times
            offset += n * k
        sequence += times
    # one entry per length of a pattern; patterns are bound by the capacity, not the corpus
    table = spark.sparkContext.broadcast({n: np.array(rows, np.int64) for n, rows in slots.items()})

    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        num, by = number.to_numpy(), length.to_numpy()
        for n in np.unique(by):
            own = np.flatnonzero(by == n)
            rows = table.value[int(n)]
            row = rows[np.searchsorted(rows[:, 0], num[own], "right") - 1]
            at = num[own] - row[:, 0]
            seq[own], off[own] = row[:, 2] + at // row[:, 1], row[:, 3] + (at % row[:, 1]) * n
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    numbered = ranked(pieces.withColumn("_key", F.xxhash64("doc_id", "piece")).withColumn("_key", F.struct("_key", "doc_id", "piece")), ["length"], "_key", "_number")
    return numbered.withColumn("_at", placed("length", "_number")).select(
        *[c for c in pieces.columns], F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset")
    )


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode, cut and pack ``docs``: one row per piece with its place.

    Null text counts as empty (one piece: the end id). Every row is a document of its own, also where
    ids repeat or are null; texts are encoded whole, however long. Other columns are not read. Empty in, empty out.
    """
    pieces = written(piece_table(docs, path, end_id, capacity, id_col, text_col, keep_ids), "pieces")
    return pack(pieces, capacity)


def default_ranks() -> str:
    import public_tokenizers

    # the rank form of the vocabulary in byte_bpe_50k.json
    return os.fspath(public_tokenizers.path("byte_bpe_50k.tiktoken"))
