"""Approximate nearest neighbours with a hash-prefix forest.

Each tree hashes a vector to a string of sign bits of random projections and keeps the
strings of a block of vectors in a sorted array. A query descends in every tree to its
longest matching prefix, whose length differs from tree to tree; then all trees ascend
together, one bit at a time from the longest match of any tree on: a tree takes part as soon
as the common level reaches its own match, and a shorter prefix is a wider slice of its
sorted array. The ascent ends when enough matches are in. Candidates are ranked by exact cosine.

Blocks of vectors have a bounded size and are dealt by a hash of the id. One task sorts a block's
forest once and streams all queries past it; each query's best of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import take_runs, written

#: Trees of a forest, and the bits of a string.
TREES, BITS = 256, 32
#: A query asks for ``EFFORT * n ** GROWTH`` matches in each tree of ``n`` vectors on average. For vectors at 60 degrees
#: two strings agree in a bit with 2/3, strangers with 1/2: the least work for a fixed recall grows as n ** 0.6.
EFFORT, GROWTH = 0.045, 0.6
BLOCK = 32_768
SEED = 20_011


def planes(dims: int, trees: int = TREES) -> np.ndarray:
    return np.random.default_rng((SEED, dims)).standard_normal((dims, trees * BITS)).astype(np.float32)


def codes(unit: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Trees x vectors: the sign bits of each tree's projections as one number, first bit on top."""
    trees = normals.shape[1] // BITS
    out = np.empty((trees, len(unit)), np.uint32)
    for a in range(0, len(unit), 2048):
        bits = np.packbits(unit[a : a + 2048].astype(np.float32) @ normals > 0, axis=1)
        out[:, a : a + 2048] = bits.reshape(-1, trees, BITS // 8).view(">u4")[:, :, 0].T
    return out


class Forest:
    """Sorted strings of one block of unit vectors, one array per tree."""

    def __init__(self, unit: np.ndarray, trees: int = TREES):
        self.normals = planes(unit.shape[1], trees)
        code = codes(unit, self.normals)
        order = np.argsort(code, axis=1, kind="stable")
        self.size, self.trees = len(unit), trees
        self.sorted = np.take_along_axis(code, order, axis=1)
        self.order = order.astype(np.int32).ravel()

    def descend(self, code: np.ndarray) -> np.ndarray:
        """Trees x queries: the length of the longest prefix that any string of the tree shares."""
        out = np.zeros(code.shape, np.int64)
        for t in range(self.trees):
            at = np.searchsorted(self.sorted[t], code[t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, self.size - 1)):
                apart = (self.sorted[t][near] ^ code[t]).astype(np.float64)
                out[t] = np.maximum(out[t], BITS - np.frexp(apart)[1])  # leading bits that agree
        return out

    def _slices(self, code: np.ndarray, level: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query the slice of strings that share ``level`` bits; empty where the longest match is shorter."""
        rest = ((np.uint64(1) << (BITS - level).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        low, high = np.zeros(code.shape, np.int64), np.zeros(code.shape, np.int64)
        for t in range(self.trees):
            q = np.flatnonzero(longest[t] >= level)
            low[t, q] = np.searchsorted(self.sorted[t], code[t, q] & ~rest[q], "left")
            high[t, q] = np.searchsorted(self.sorted[t], code[t, q] | rest[q], "right")
        return low, high

    def search(self, unit: np.ndarray, effort: float = EFFORT, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Slices (trees x queries) at the deepest common level with enough matches over all
        trees, of ``least`` vectors at least (or all that the forest has)."""
        code = codes(unit, self.normals)
        want = self.trees * min(self.size, max(1.0, effort * self.size**GROWTH))
        longest = self.descend(code)
        level = longest.max(axis=0)
        low, high = self._slices(code, level, longest)
        open_ = np.flatnonzero(((high - low).sum(axis=0) < want) & (level > 0))
        while len(open_):
            level[open_] -= 1
            a, b = self._slices(code[:, open_], level[open_], longest[:, open_])
            low[:, open_], high[:, open_] = a, b
            open_ = open_[((b - a).sum(axis=0) < want) & (level[open_] > 0)]
        # one slice of a tree holds distinct vectors; where the widest is too narrow, count over the trees
        for q in np.flatnonzero((high - low).max(axis=0) < least):
            while level[q] > 0 and len(self.candidates(low[:, q], high[:, q])) < least:
                level[q] -= 1
                low[:, [q]], high[:, [q]] = self._slices(code[:, [q]], level[[q]], longest[:, [q]])
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The distinct vectors of one query's slices, ascending."""
        own = np.flatnonzero(high > low)
        mark = np.zeros(self.size, bool)
        mark[take_runs(self.order, own * self.size + low[own], high[own] - low[own])] = True
        return np.flatnonzero(mark)


class Block:
    """A block of vectors (ascending ids) with its forest. Equal vectors are one entry of the
    forest; of their ids the k + 1 smallest can be among the best k of a query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, trees: int = TREES):
        _, of = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel(), return_inverse=True)
        order = np.argsort(of, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) != 0]))
        number = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
        own = order[number <= k]  # by entry, then id
        self.k, self.ids, self.vectors, self.of = k, ids[own], vectors[own], of[own]
        self.first = np.searchsorted(self.of, np.arange(len(start) + 1))
        self.norm = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.unit = self.vectors / self.norm[:, None]
        self.forest = Forest(self.unit[self.first[:-1]], trees)
        self.ranked = 0  # candidates looked at so far

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, effort: float = EFFORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best found for each query: (query id, id, cosine), ties to smaller ids."""
        norm = np.sqrt((queries * queries).sum(axis=1))
        unit = queries / norm[:, None]
        low, high = self.forest.search(unit, effort, self.k + 1)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for q in range(len(query_ids)):
            entry = self.forest.candidates(low[:, q], high[:, q])
            found = take_runs(np.arange(len(self.ids)), self.first[entry], self.first[entry + 1] - self.first[entry])
            found = found[self.ids[found] != query_ids[q]]
            self.ranked += len(found)
            if not len(found):
                continue
            rough = self.unit[found] @ unit[q]
            if len(found) > self.k:
                found = found[rough >= np.partition(rough, -self.k)[-self.k] - 1e-9]
            # the same sums for equal vectors wherever they stand, so that ties are ties
            score = (self.vectors[found] * queries[q]).sum(axis=1) / (self.norm[found] * norm[q])
            best = np.lexsort((self.ids[found], -score))[: self.k]
            out.append((np.full(len(best), query_ids[q]), self.ids[found[best]], score[best]))
        q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return q, v, s


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, effort: float = EFFORT) -> DataFrame:
    """The k nearest rows by cosine of each row whose id is divisible by ``every``.

    ``query_id, rank, vec_id, score``. Null or zero vectors, those with null or non-finite components, and
    null ids take no part; vectors of another dimension than the query are no candidates. Ties go to the smaller
    id. A query is never its own candidate (by id); of rows with equal ids the smallest vector counts.
    Other columns are not read. Empty in, empty out.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    table = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    table = table.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0))
    table = table.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    table = written(table.withColumn("dims", F.size("embedding")), "vectors")
    blocks = -(-table.count() // BLOCK) or 1

    base = table.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("query", F.lit(False))
    asked = table.where(F.col("vec_id") % every == 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("query", F.lit(True))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block and dimension, the block's vectors before its queries."""
        now, ids, vectors, block = None, [], [], None
        for batch in batches:
            of = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "dims", "query")], axis=1)
            cut = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1).tolist(), len(of)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if now != tuple(of[a, :2]):
                    now, ids, vectors, block = tuple(of[a, :2]), [], [], None
                own, matrix = part.column("vec_id").to_numpy(), _matrix(part.column("embedding"))
                if not of[a, 2]:
                    ids.append(own)
                    vectors.append(matrix)
                elif ids:
                    block = block or Block(np.concatenate(ids), np.concatenate(vectors), k, trees)
                    for c in range(0, len(own), 512):
                        q, v, s = block.nearest(own[c : c + 512], matrix[c : c + 512], effort)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    pairs = base.unionByName(asked).select("block", "dims", "query", "vec_id", "embedding")
    pairs = pairs.repartition(blocks, "block").sortWithinPartitions("block", "dims", "query", "vec_id")
    best = pairs.mapInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
