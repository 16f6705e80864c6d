"""Similarity join of word-shingle sets with signature trees.

Equal sets are one class, so copies never meet each other. A pair of classes with
similarity t or more shares k of its first shingles in any fixed order (the prefix
of n - ceil(t n) + k); the order here is by hash, with frequent shingles last, and k an
eighth of the size. Classes that share a prefix shingle form a list; a class that shares
fewer than k with any others leaves all lists.

1. Each list links its members to its smallest class of about their size. These few
   candidates are bounded by their signatures and verified on the whole sets. Lists whose
   members then stand in one component need no further work.
2. The other lists go (first for the likeliest partner of each member in its block, which joins
   most components, then for more and more partners of the members outside a list's largest
   component, until no possible pair between components is left) through signature trees: a leaf holds the bitmap of a set's
   hashes and its size, a node the OR of its children's bitmaps and their size
   range. Two nodes are traversed together only while the common bits, plus the
   hashes that a bitmap can hide, reach the overlap that their sizes call for, and
   while they hold different components. What is left is verified on the whole sets.

Lists longer than a block are cut into blocks, and pairs of blocks are dealt over the tasks. Only sets of
candidates are shuffled, and the filter that finds their documents is a bitmap of bounded size. Shingles
are 64-bit hashes of word hashes. The bounds of a round (partners of a member, three lists and one block in
the first, 4 000 000 pairs of a list) lose no link: rounds go on, the last without any bound, until
one leaves out nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, joined_labels
from .shared import LOWER, mix, partitions, slices, text_bytes, word_hashes, word_runs, written

SHINGLE, PERCENT = 5, 75
#: Frequent shingles put last: at most this many, 8 bytes each. Only the order depends on them.
FREQUENT = 1 << 15
SALTS = 16
BLOCK = 256
#: Bits of the filter that picks candidates' sets: 16 for each candidate, between these bounds (32 MB at
#: most); when it fills up, more sets are shuffled.
FILTER_LEAST, FILTER_MOST = 1 << 16, 1 << 28
_FOLD = [np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03), np.uint64(0xA24BAED4963EE407), np.uint64(0x9E6C63D0676A9A99), np.uint64(0xC2B2AE3D27D4EB4F)]


def shingle_sets(column: pa.Array, words: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than ``words`` give one."""
    raw, offsets = text_bytes(column)
    raw = LOWER[raw]
    starts, ends, first = word_runs(raw, offsets)
    h = word_hashes(raw, starts, ends)
    out = []
    with np.errstate(over="ignore"):
        n = max(len(h) - words + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled += h[k : k + n] * (_FOLD[k % len(_FOLD)] + np.uint64(2 * (k // len(_FOLD))))
        rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:  # the whole sequence, with its length
                part = np.uint64(b - a) * np.uint64(0x632BE59BD9B4E019)
                for k in range(b - a):
                    part += h[a + k] * _FOLD[k % len(_FOLD)]
                out.append(mix(np.array([part])))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(tokens: np.ndarray) -> np.ndarray:
    """Bitmap of a set: the next power of two of four times its size, 64 bits at least."""
    width = 64
    while width < 4 * len(tokens):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(tokens >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _common(n: int) -> int:
    """How many prefix shingles linked sets share at least, by the smaller size n."""
    return max(1, n // 8)


def _prefix_size(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + _common(n))


def _needed(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b: percent / (100 + percent) of the sum, rounded up."""
    return -(-(percent * (a + b)) // (100 + percent))


def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """Per document its set's size and class, once for each class of a task also its signature;
    per task lot the frequent shingles (``heavy``)."""
    schema = "doc_id long, n_shingles long, class long, bits binary, heavy binary, times binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["doc_id", "n_shingles", "class", "bits", "heavy", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, size, known = [], 0, set()

        def frequent() -> pa.RecordBatch | None:
            token, times = np.unique(np.concatenate(lot), return_counts=True)
            best = np.flatnonzero(times > 3)
            best = best[np.argsort(-times[best], kind="stable")[:4096]]
            if not len(best):
                return None
            row = (None, None, None, None, token[best].tobytes(), times[best].astype(np.int64).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), words)
            classes = [class_of(s) if len(s) else None for s in sets]
            fresh = []
            for name, s in zip(classes, sets, strict=True):
                fresh.append(name is not None and name not in known)
                if fresh[-1]:
                    known.add(name)
                    lot.append(s)
                    size += len(s)
            cols = (
                part.column("doc_id").cast(pa.int64()),
                [len(s) for s in sets],
                classes,
                [signature(s).tobytes() if new else None for s, new in zip(sets, fresh, strict=True)],
                [None] * len(sets),
                [None] * len(sets),
            )
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=names)
            if len(known) > 1_000_000:  # beyond that a task may ship a set again
                known.clear()
            if size > 2_000_000:
                if (row := frequent()) is not None:
                    yield row
                lot, size = [], 0
        if lot and (row := frequent()) is not None:
            yield row

    return docs.mapInArrow(run, schema)


def _frequent(summaries: DataFrame) -> np.ndarray:
    """At most FREQUENT shingles, sorted; a fixed bound on what the driver gets and sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token = np.frombuffer(b"".join(b.column("heavy").to_pylist()), np.int64)
            times = np.frombuffer(b"".join(b.column("times").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(times)], names=["token", "times"])

    rows = summaries.where("heavy is not null").select("heavy", "times").mapInArrow(run, "token long, times long")
    top = rows.groupBy("token").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT)
    return np.sort(np.array([r["token"] for r in top.select("token").collect()], np.int64).view(np.uint64))


def _is_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _prefix_lists(docs: DataFrame, heavy, buckets: int, words: int, percent: int) -> DataFrame:
    """Prefix shingles by hash range: rows of (bucket, shingles, their classes, sizes)."""
    schema = "bucket int, t binary, c binary, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_last = heavy.value
        token, owner, size, count = [], [], [], 0

        def flush() -> pa.RecordBatch:
            n = np.array([len(t) for t in token])
            t, c, s = np.concatenate(token), np.repeat(np.array(owner, np.int64), n), np.repeat(np.array(size, np.uint32), n)
            where = (t >> np.uint64(40)).astype(np.int64)
            hot = _is_in(rare_last, t)
            where[hot] += (mix(c[hot].view(np.uint64)) % np.uint64(SALTS)).astype(np.int64)  # a frequent shingle is split
            where %= buckets
            order = np.argsort(where, kind="stable")
            t, c, s, where = t[order], c[order], s[order], where[order]
            cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            cols = [[y.tobytes() for y in np.split(x, cut[1:])] for x in (t, c, s)]
            return pa.RecordBatch.from_arrays([pa.array(where[cut].tolist(), pa.int32()), *(pa.array(x, pa.binary()) for x in cols)], names=["bucket", "t", "c", "n"])

        known: set[int] = set()
        for part in slices(batches, "text"):
            for s in shingle_sets(part.column("text"), words):
                if not len(s) or (name := class_of(s)) in known:
                    continue
                if len(known) < 1_000_000:  # beyond that a task may ship a set again
                    known.add(name)
                hot = _is_in(rare_last, s)
                ordered = np.concatenate([s[~hot], s[hot]]) if hot.any() else s
                ordered = ordered[: _prefix_size(len(s), percent)]
                token.append(ordered)
                owner.append(name)
                size.append(len(s))
                count += len(ordered)
            if count > 1_000_000:
                yield flush()
                token, owner, size, count = [], [], [], 0
        if token:
            yield flush()

    return docs.mapInArrow(run, schema)


def _lists(heavy, ranges: int):
    """Reduce of one hash range: lists of two classes or more (of frequent shingles: all parts), and
    in rows without a shingle how many shared prefix shingles each class has here."""

    def reduce(table: pa.Table) -> pa.Table:
        rare_last = heavy.value
        t, c, n = (np.frombuffer(b"".join(table.column(k).to_pylist()), d) for k, d in (("t", np.uint64), ("c", np.int64), ("n", np.uint32)))
        order = np.lexsort((c, t))
        t, c, n = t[order], c[order], n[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])]) if len(t) else np.zeros(0, bool)
        t, c, n = t[new], c[new], n[new]
        cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(t)))
        hot = _is_in(rare_last, t[cut])
        shared = np.repeat(hot | (size > 1), size)
        # lists with the same members are one list
        with np.errstate(over="ignore"):
            mark = np.add.reduceat(mix(c.view(np.uint64)), cut) if len(cut) else np.zeros(0, np.uint64)
        _, first = np.unique(mark, return_index=True)
        once = np.zeros(len(cut), bool)
        once[first] = True
        keep = hot | ((size > 1) & once)
        offsets = np.concatenate([[0], np.cumsum(size[keep])])
        lists = pa.table(
            {
                "token": pa.array(t[cut][keep].view(np.int64)),
                "hot": pa.array(hot[keep]),
                "mark": pa.array(mark[keep].view(np.int64)),
                "classes": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c[np.repeat(keep, size)])),
                "range": pa.nulls(int(keep.sum()), pa.int32()),
                "c": pa.nulls(int(keep.sum()), pa.binary()),
                "n": pa.nulls(int(keep.sum()), pa.binary()),
            }
        )
        own, at, times = np.unique(c[shared], return_index=True, return_counts=True)
        sizes = n[shared][at]
        where = (mix(own.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        own, sizes, times, where = own[order], sizes[order], times[order], where[order]
        edge = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(own) else np.zeros(0, np.int64)
        split = lambda x: [y.tobytes() for y in np.split(x, edge[1:])] if len(edge) else []
        counts = np.stack([sizes, times], axis=1).astype(np.uint32) if len(own) else np.empty((0, 2), np.uint32)
        k = len(edge)
        rows = pa.table(
            {
                "token": pa.nulls(k, pa.int64()), "hot": pa.nulls(k, pa.bool_()), "mark": pa.nulls(k, pa.int64()), "classes": pa.nulls(k, pa.list_(pa.int64())),
                "range": pa.array(where[edge], pa.int32()), "c": pa.array(split(own), pa.binary()), "n": pa.array(split(counts), pa.binary()),
            }
        )
        return pa.concat_tables([lists, rows])

    return reduce


def _alive(percent: int):
    """Of a range of classes those with enough shared prefix shingles for a link, and their sizes."""

    def reduce(table: pa.Table) -> pa.Table:
        c = np.frombuffer(b"".join(table.column("c").to_pylist()), np.int64)
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint32).reshape(-1, 2).astype(np.int64)
        own, first, of = np.unique(c, return_index=True, return_inverse=True)
        total, size = np.bincount(of, weights=n[:, 1]), n[first, 0]
        least = np.maximum(1, -(-percent * size // 100) // 8)  # _common of the smallest partner
        keep = total >= least
        return pa.table({"class": pa.array(own[keep]), "size": pa.array(size[keep])})

    return reduce


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap, or rows of them, folded to ``words`` 64-bit words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _bound_pairs(percent: int):
    """Keep candidate pairs whose sizes and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            need = _needed(na, nb, percent)
            keep = np.minimum(na, nb) >= need
            for i in np.flatnonzero(keep).tolist():
                x, y = np.frombuffer(b.column("xa")[i].as_py(), np.uint64), np.frombuffer(b.column("xb")[i].as_py(), np.uint64)
                w = min(len(x), len(y))
                x, y = _fold(x, w), _fold(y, w)
                # hashes of one set whose bits the other lacks cannot be common
                most = min(na[i] - np.bitwise_count(x & ~y).sum(), nb[i] - np.bitwise_count(y & ~x).sum())
                keep[i] = most >= need[i]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


class SignatureTree:
    """Leaves ordered by size and bitmap; a level's nodes OR together ``FAN`` children."""

    FAN = 8

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, label: np.ndarray):
        hidden = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, hidden, label, label)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, hid, one, other = self.levels[-1]
            cut = np.arange(0, len(b), self.FAN)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(b, cut, axis=0),
                    np.minimum.reduceat(low, cut),
                    np.maximum.reduceat(high, cut),
                    np.maximum.reduceat(hid, cut),
                    np.minimum.reduceat(one, cut),
                    np.maximum.reduceat(other, cut),
                )
            )

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Child nodes of each node, and how many each has."""
        count = np.minimum(self.FAN, len(self.levels[level - 1][0]) - nodes * self.FAN)
        return np.repeat(nodes * self.FAN - (np.cumsum(count) - count), count) + np.arange(count.sum()), count


def tree_pairs(x: SignatureTree, y: SignatureTree, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leaf pairs that survive the dual traversal, in lots (``same``: of one tree, i < j),
    and the ratio of their largest possible overlap to the one that they need."""
    stack = [(len(x.levels) - 1, len(y.levels) - 1, np.array([0]), np.array([0]))]
    while stack:
        lx, ly, i, j = stack.pop()
        bx, lowx, highx, hidx, onex, otherx = x.levels[lx]
        by, lowy, highy, hidy, oney, othery = y.levels[ly]
        ok = (100 * highx[i] >= percent * lowy[j]) & (100 * highy[j] >= percent * lowx[i])
        ok &= ~((onex[i] == otherx[i]) & (oney[j] == othery[j]) & (onex[i] == oney[j]))  # one component already
        if same and lx == ly:
            ok &= i <= j if lx else i < j
        i, j = i[ok], j[ok]
        if len(i):
            common = np.bitwise_count(bx[i] & by[j]).sum(axis=1).astype(np.int64)
            ratio = (common + np.minimum(hidx[i], hidy[j])) / _needed(lowx[i], lowy[j], percent)
            ok = ratio >= 1
            i, j, ratio = i[ok], j[ok], ratio[ok]
        if not len(i):
            continue
        if not lx and not ly:
            yield i, j, ratio
            continue
        if lx >= ly:
            kids, n = x.children(lx, i)
            i, j, lx = kids, np.repeat(j, n), lx - 1
        else:
            kids, n = y.children(ly, j)
            i, j, ly = np.repeat(i, n), kids, ly - 1
        step = max(1, (1 << 20) // max(bx.shape[1], 1))
        stack += [(lx, ly, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]


def _best(pairs: np.ndarray, ratio: np.ndarray, most: int, asks: set[int]) -> tuple[np.ndarray, bool]:
    """The pairs that are among the ``most`` likeliest of one of their two members, of those in ``asks``; and
    whether a pair was left out."""
    keep = np.zeros(len(pairs), bool)
    for side in (0, 1):
        own = np.flatnonzero(np.isin(pairs[:, side], list(asks)))
        order = own[np.lexsort((-ratio[own], pairs[own, side]))]
        start = np.flatnonzero(np.concatenate([[True], np.diff(pairs[order, side]) != 0]))[: len(order)]
        number = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        keep[order[number < most]] = True
    return pairs[keep], not keep.all()


def _traverse(percent: int, most: int | None = None):
    """Dual traversals of the lists in one group: candidate pairs between components; with ``most`` only
    the likeliest of each member that is ``minor``, and a row of nulls where that leaves out pairs."""

    def one(c, n, label, block, bits, crossing) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words = np.array([len(b) // 8 for b in bits])
        for width in np.unique(words):
            # sets of this width, and the next one folded to it: linked sizes differ by less than 2
            sides = []
            for pick in (words == width, words == 2 * width):
                own = np.flatnonzero(pick)
                if len(own):
                    m = np.stack([_fold(np.frombuffer(bits[k], np.uint64), width) for k in own])
                    order = np.lexsort((m[:, 0], n[own]))
                    own, m = own[order], m[order]
                sides.append((own, m if len(own) else None))
            (p, pm), (q, qm) = sides
            blocks = [(p, pm, p, pm, True)] + ([(p, pm, q, qm, False)] if len(q) else [])
            for s, sm, t, tm, same in blocks:
                if crossing:  # only pairs across the two blocks
                    first, second = block[s] == crossing[0], block[t] == crossing[1]
                    runs = [(s[first], sm[first], t[second], tm[second])]
                    if not same:
                        first, second = block[s] == crossing[1], block[t] == crossing[0]
                        runs.append((s[first], sm[first], t[second], tm[second]))
                    same = False
                else:
                    runs = [(s, sm, t, tm)]
                for u, um, v, vm in runs:
                    if len(u) and len(v):
                        tu = SignatureTree(um, n[u], label[u])
                        tv = tu if same else SignatureTree(vm, n[v], label[v])
                        for i, j, ratio in tree_pairs(tu, tv, percent, same):
                            yield np.stack([np.minimum(c[u[i]], c[v[j]]), np.maximum(c[u[i]], c[v[j]])], axis=1), ratio

    def reduce(table: pa.Table) -> pa.Table:
        token, i, j = (table.column(k).to_numpy() for k in ("token", "i", "j"))
        c, n, label, block = (table.column(k).to_numpy() for k in ("class", "size", "label", "block"))
        minor = table.column("minor").to_numpy(zero_copy_only=False)
        bits = table.column("bits").to_pylist()
        order = np.lexsort((c, j, i, token))
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(token[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)]))
        found, open_ = [], False
        for own in np.split(order, cut[1:]):
            cross = (i[own[0]], j[own[0]])
            pairs, ratio = [], []
            for x, y in one(c[own], n[own], label[own], block[own], [bits[k] for k in own], cross if cross[0] != cross[1] else None):
                pairs.append(x)
                ratio.append(y)
                if most and sum(map(len, pairs)) > 4_000_000:
                    open_ = True
                    break
            if pairs:
                pairs = np.concatenate(pairs)
                if most:
                    pairs, cut_short = _best(pairs, np.concatenate(ratio), most, set(c[own[minor[own]]].tolist()))
                    open_ |= cut_short
                found.append(pairs)
            if len(found) > 1000:
                found = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        tail = [None] if open_ else []
        return pa.table({"a": pa.array([*pairs[:, 0].tolist(), *tail], pa.int64()), "b": pa.array([*pairs[:, 1].tolist(), *tail], pa.int64())})

    return reduce


def _filter_bits(names: DataFrame) -> np.ndarray:
    """A bitmap over the hashes of the column ``key``, packed; its size has a fixed bound."""
    parts, width = partitions(names.sparkSession), FILTER_LEAST
    count = names.count()
    while width < min(16 * count, FILTER_MOST):
        width *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(width, bool)
        for b in batches:
            bits[(mix(b.column(0).to_numpy().view(np.uint64)) % np.uint64(width)).astype(np.int64)] = True
        at = np.flatnonzero(bits.reshape(-1, 4096).any(axis=1))
        packed = np.packbits(bits.reshape(-1, 4096)[at], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([p.tobytes() for p in packed], pa.binary())], names=["k", "bits"])

    def join(table: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]))
        return pa.table({"k": table.column("k").slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})

    rows = names.select("key").coalesce(max(1, min(parts, 64))).mapInArrow(run, "k int, bits binary").groupBy("k").applyInArrow(join, "k int, bits binary")
    out = np.zeros((width // 4096, 512), np.uint8)
    for r in rows.collect():
        out[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _verified(docs: DataFrame, signs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough. Of each class the document with the
    smallest id (``signs.least``) is shingled again; no other text is."""
    spark = docs.sparkSession
    names = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    keys = written(names.join(signs, "class").select(F.col("least").alias("key")).where("key is not null"), "names")
    bits = spark.sparkContext.broadcast(_filter_bits(keys))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.uint64(8 * len(bits.value))
        for b in batches:
            key = b.column("doc_id")
            at = (mix(key.fill_null(0).to_numpy().view(np.uint64)) % width).astype(np.int64)
            wanted = (bits.value[at >> 3] >> (7 - (at & 7)) & 1 == 1) | key.is_null().to_numpy(zero_copy_only=False)
            for part in slices(iter([b.filter(pa.array(wanted))]), "text"):
                got = {class_of(s): s for s in shingle_sets(part.column("text"), words) if len(s)}
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in got.values()])]).astype(np.int32)
                flat = np.concatenate([*got.values(), np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["class", "tokens"])

    table = written(docs.mapInArrow(sets, "class long, tokens array<long>").join(names, "class", "left_semi").dropDuplicates(["class"]), "sets")
    left = table.select(F.col("class").alias("a"), F.col("tokens").alias("x"))
    right = table.select(F.col("class").alias("b"), F.col("tokens").alias("y"))
    # the larger class brings its set along: of a group's pairs that is mostly the member, not the one that all meet
    both = F.size(F.array_intersect("x", "y"))
    similar = 100 * both.cast("long") >= percent * (F.size("x") + F.size("y") - both).cast("long")
    return written(pairs.join(right, "b").join(left, "a").where(similar).select("a", "b"), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id``: near-duplicate groups; with ``links`` also ``n_links``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Two texts link when
    100 * |A & B| >= percent * |A | B|; ``component_id`` is the smallest id reachable
    by links. ``n_links`` counts the other rows that a row links with, equal texts included: for it the
    lists are traversed once more without regard to components, and the linked pairs of different texts,
    as many as the square of a group's size, are written and verified.
    Null, empty or blank texts have no shingles and stand alone; equal texts stand
    together. Rows with equal ids keep one row each. Other columns are not read.
    """
    spark = docs.sparkSession
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    summaries = written(_summaries(table, words), "summaries")
    rows = summaries.where("heavy is null").select("doc_id", "n_shingles", "class", "bits")
    frequent = spark.sparkContext.broadcast(_frequent(summaries))
    sizes = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = int(max(4 * partitions(spark), sizes // 4_000_000))

    ranges = max(16, partitions(spark))
    found = written(
        _prefix_lists(table, frequent, buckets, words, percent)
        .groupBy("bucket")
        .applyInArrow(_lists(frequent, ranges), "token long, hot boolean, mark long, classes array<long>, range int, c binary, n binary"),
        "lists",
    )
    alive = found.where("range is not null").select("range", "c", "n").groupBy("range").applyInArrow(_alive(percent), "class long, size long")
    # lists with the same members are one list; of frequent shingles they are parts and stay
    lists = found.where("not hot").dropDuplicates(["mark"]).select("token", "classes").unionByName(found.where("hot").select("token", "classes"))
    members = written(lists.select("token", F.explode("classes").alias("class")).join(alive, "class"), "members")
    signs = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("size"), F.first("bits", True).alias("bits"))
    signs = written(signs, "classes")

    # each member with the smallest class of its token and size step, and those of neighbouring steps
    step = F.floor(F.log("size") / F.log(F.lit(100 / percent))).cast("int")
    stepped = members.withColumn("step", step)
    leaders = stepped.groupBy("token", "step").agg(F.min("class").alias("a"))
    upper = leaders.select("token", (F.col("step") - 1).alias("step"), F.col("a").alias("b"))
    candidates = stepped.join(leaders, ["token", "step"]).where("a <> class").select("a", F.col("class").alias("b"))
    candidates = candidates.unionByName(leaders.join(upper, ["token", "step"]).where("a <> b").select("a", "b"))
    candidates = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def with_signs(pairs: DataFrame) -> DataFrame:
        x = signs.select(F.col("class").alias("a"), F.col("size").alias("na"), F.col("bits").alias("xa"))
        y = signs.select(F.col("class").alias("b"), F.col("size").alias("nb"), F.col("bits").alias("xb"))
        return pairs.join(x, "a").join(y, "b").mapInArrow(_bound_pairs(percent), "a long, b long")

    edges = _verified(table, signs, written(with_signs(candidates), "pairs"), words, percent)
    labels = components(edges)

    groups = int(max(4 * partitions(spark), members.count() // 20_000))

    def searched(labels: DataFrame | None, most: int | None, salt: int = 0) -> tuple[DataFrame, bool]:
        """Verified pairs of the lists' members between components, or of all members without ``labels``, and whether
        pairs were left out. With a ``salt``, members meet those of their own block only, in three lists at most.

        A list's largest component is told from its other members: only the latter need to meet
        anyone. Both are cut into blocks, and each pair of blocks is a unit of its own."""
        named = members.withColumn("label", F.col("class"))
        if labels is not None:
            named = members.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        parts = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("lead"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("mark"))
        # powers of two, so that lists of about the same members have the same blocks
        cut = lambda n: F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n / BLOCK, F.lit(1.0))))).cast("int")
        open_ = (
            parts.groupBy("token")
            .agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("members"), F.min("lead").alias("lead"), F.sum("mark").alias("mark"))
            .where("labels > 1")
            .withColumn("one", F.row_number().over(Window.partitionBy("mark", "members").orderBy("token")))
            .where("one = 1")
            .select("token", "lead", "major", "members", cut(F.col("most")).alias("ma"), cut(F.col("members") - F.col("most")).alias("mi"))
        )
        work = named.join(open_, "token")
        if salt:  # in this round, the longest lists of each member
            longest = Window.partitionBy("class").orderBy(F.desc("members"), "token")
            work = work.withColumn("r", F.row_number().over(longest)).where("r <= 3")
            block = F.pmod(F.xxhash64("class", F.lit(salt)), cut(F.col("members"))).cast("int")
            work = work.withColumn("minor", F.lit(True)).withColumn("block", block).withColumn("other", block)
        else:
            work, spread = work.withColumn("minor", F.col("label") != F.col("major")), F.xxhash64("class")
            work = work.withColumn("block", F.when(F.col("minor"), F.col("ma") + F.pmod(spread, "mi")).otherwise(F.pmod(spread, "ma")).cast("int"))
            work = work.withColumn("other", F.explode(F.sequence(F.when(F.col("minor"), F.lit(0)).otherwise(F.col("ma")), F.col("ma") + F.col("mi") - 1)))
        work = work.join(signs.select("class", "bits"), "class")
        work = work.select("token", "lead", "class", "size", "label", "minor", "bits", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        # lists of like members have the same smallest one: their pairs of the same two blocks are told once
        pairs = work.withColumn("group", F.pmod(F.xxhash64("lead", "i", "j"), F.lit(groups))).drop("lead").groupBy("group").applyInArrow(_traverse(percent, most), "a long, b long")
        pairs = written(pairs.distinct(), "pairs")
        return _verified(table, signs, pairs.where("a is not null"), words, percent), not pairs.where("a is null").isEmpty()

    # first the likeliest candidates of each member in its block, which joins most components; then of the members outside
    # a list's largest component, more and more of them until none is left out
    most, salt, more = 1, 1, True
    while more:
        found, cut_short = searched(labels, most, salt)
        labels = joined_labels(labels, found)
        more = most is not None and (cut_short or bool(salt))
        # where a round joins nothing, a somewhat larger one hardly does: the next has no bound
        most, salt = (2 if salt else None if most > 100 or found.isEmpty() else 8 * most) if more else None, 0

    named = signs.select(F.col("class").alias("node"), "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(best, "label").select(F.col("node").alias("class"), "component_id")
    out = ["doc_id", "n_shingles", "component_id"]
    alone = rows.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if links:
        out.append("n_links")
        times = written(rows.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("times")), "times")
        pairs = written(searched(None, None)[0], "links")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        other = both.join(times.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("times").alias("other"))
        degree = times.join(other, "class", "left").select("class", (F.col("times") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"))
        named = named.join(degree, "class")
        alone = alone.withColumn("n_links", F.lit(0).cast("long"))
    joined = rows.where("class is not null").select("doc_id", "n_shingles", "class").join(named, "class")
    return joined.select(*out).unionByName(alone)
