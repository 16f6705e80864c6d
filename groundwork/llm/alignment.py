"""Cross-tokenizer alignment by whitespace-token anchors.

Both tokenizers encode every whole text; their tokens' bytes are compared with the text.
Byte offsets where tokens of both end are shared ends; a shared end before tokens that both start
with the space mark is an anchor. Anchors cut a document into windows of token ids (about a word each), and
the alignment of a window depends on its ids alone: it is worked out once per id tuple and kept.

Links (pairs of overlapping tokens) are counted by id pair over the whole corpus: each document's
distinct pairs are written once, tasks add them up before the shuffle, and the documents are scored
against the table of counts. Up to ``table_rows`` pairs, the most frequent ones, are broadcast as
sorted arrays; what a document holds beyond them is joined by the pair.

Handling: a text that is null or empty, or whose joined token bytes differ from space + text, has no
tokens: zeros and an empty ``groups_sha256``. Special tokens' strings are plain text. Rows are
documents of their own: repeated rows and ids count as often as they stand there. Texts are read whole,
however long; other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder, encoder
from .shared import mix, run_hash, slices, take_runs, written

TABLE_ROWS = 2_000_000
_BITS = 20  # ids are below 2 ** 20
_MEMO = 200_000
_PARTIAL = 1 << 21


class Pieces:
    """A piece model and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = [self._bytes(k) for k in range(self.model.get_piece_size())]
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.marked = np.array([x[:1] == b" " for x in spelled], bool)

    def _bytes(self, k: int) -> bytes:
        piece = self.model.id_to_piece(k)
        return bytes([int(piece[1:-1], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts and each text's place in them."""
        ids = self.model.encode(texts, out_type=int, num_threads=1)
        at = np.cumsum([0, *map(len, ids)])
        return np.fromiter(chain.from_iterable(ids), np.int64, at[-1]), at

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return take_runs(self.flat, self.first[ids], self.lengths[ids])


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """One per Python worker."""
    return Pieces(path)


class Tokens:
    """The tokens of a batch of texts: ids, each text's place in them, byte ends over the batch."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, sizes: np.ndarray):
        self.ids, self.at = ids, at
        self.ends = np.cumsum(sizes[ids])

    @classmethod
    def of(cls, coder: Encoder | Pieces, texts: list[str]) -> tuple[Tokens, list[bytes]]:
        ids, at = coder.encode(texts)
        own, data = cls(ids.astype(np.int64), at, coder.lengths), coder.decode(ids).tobytes()
        cut = np.concatenate([[0], own.ends])[at].tolist()
        return own, [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def only(self, good: np.ndarray, sizes: np.ndarray) -> Tokens:
        """The tokens of the good texts; the others have none."""
        n = np.where(good, np.diff(self.at), 0)
        return Tokens(take_runs(self.ids, self.at[:-1], n), np.concatenate([[0], np.cumsum(n)]), sizes)


def tokenised(enc: Encoder, own: Pieces, texts: list[str]) -> tuple[Tokens, Tokens]:
    """Tokens of both, for the texts that both spell out byte for byte."""
    spaced = [" " + t for t in texts]
    (a, bytes_a), (b, bytes_b) = Tokens.of(enc, spaced), Tokens.of(own, texts)
    good = np.array([len(t) > 1 and x == y == t.encode() for t, x, y in zip(spaced, bytes_a, bytes_b, strict=True)], bool)
    return (a, b) if good.all() else (a.only(good, enc.lengths), b.only(good, own.lengths))


class Aligner:
    """Aligns windows of ids. What a window gives is kept by its id tuple: a sorted hash finds it, its ids
    are compared. New windows of a batch are worked out together."""

    #: What is kept of a window: flat values, and the end of each window's part.
    PARTS = ("ids_a", "ids_b", "text", "links")

    def __init__(self, enc: Encoder, own: Pieces):
        self.enc, self.own = enc, own
        self.marked_a = enc.flat[np.minimum(enc.first[:-1], len(enc.flat) - 1)] == 0x20
        # each id in decimal with the mark that follows it: a comma inside a group's side, a bar after A's, a semicolon after B's
        spelled = [f"{k}{mark}".encode() for mark in ",|;" for k in range(max(len(enc.lengths), len(own.lengths)))]
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.flat, self.begin = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.worked_out = 0
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.kept = {p: (np.empty(0, np.uint8 if p == "text" else np.int64), np.zeros(1, np.int64)) for p in self.PARTS}
        self.n_groups = np.empty(0, np.int64)

    def part(self, name: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A part of the windows numbered ``at``, and its size in each."""
        flat, ends = self.kept[name]
        size = ends[at + 1] - ends[at]
        return take_runs(flat, ends[at], size), size

    def work_out(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Text of groups, links and number of groups of windows (``n`` ids each; both sides spell the same bytes)."""
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        ends_a, ends_b = np.cumsum(self.enc.lengths[ids_a]), np.cumsum(self.own.lengths[ids_b])
        # between two neighbouring ends of either side one token of each overlaps: a link
        ends = np.union1d(ends_a, ends_b)
        links = ids_a[np.searchsorted(ends_a, ends)] << _BITS | ids_b[np.searchsorted(ends_b, ends)]
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        # groups as text: A's ids, then B's, group by group
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        mark_a = np.where(np.append(group_a[1:] != group_a[:-1], True), 1, 0)
        mark_b = np.where(np.append(group_b[1:] != group_b[:-1], True), 2, 0)
        before = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=len(shared)))])[group_a]
        until = np.cumsum(np.bincount(group_a, minlength=len(shared)))[group_b]
        width = len(self.sizes) // 3
        written_ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        written_ids[np.arange(len(ids_a)) + before] = mark_a * width + ids_a
        written_ids[np.arange(len(ids_b)) + until] = mark_b * width + ids_b
        text = take_runs(self.flat, self.begin[written_ids], self.sizes[written_ids])
        size = np.concatenate([[0], np.cumsum(self.sizes[written_ids])])
        stop = ends_a[last_a - 1]  # the byte where each window ends
        return {
            "ids_a": (ids_a, last_a), "ids_b": (ids_b, last_b), "text": (text, size[last_a + last_b]),
            "links": (links, np.searchsorted(ends, stop) + 1), "groups": (shared, np.searchsorted(shared, stop) + 1),
        }

    def _add(self, key: np.ndarray, found: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Keep new windows; their numbers."""
        number = len(self.n_groups) + np.arange(len(key))
        for p in self.PARTS:
            (flat, ends), (more, stop) = self.kept[p], found[p]
            self.kept[p] = np.concatenate([flat, more]), np.concatenate([ends, ends[-1] + stop])
        self.n_groups = np.concatenate([self.n_groups, np.diff(found["groups"][1], prepend=0)])
        order = np.argsort(key)
        where = np.searchsorted(self.keys, key[order])
        self.keys, self.place = np.insert(self.keys, where, key[order]), np.insert(self.place, where, number[order])
        self.worked_out += len(key)
        return number

    def batch(self, a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Each window's number in the memo, and each text's first window."""
        if len(self.keys) > _MEMO:
            self._forget()
        if not len(a.ids):
            return np.empty(0, np.int64), np.zeros(len(a.at), np.int64)
        place = np.searchsorted(b.ends, a.ends)  # both end with the batch, so every place is one
        last_a = np.flatnonzero(b.ends[place] == a.ends)  # tokens that end at a shared end
        last_b = place[last_a]
        after_a, after_b = np.minimum(last_a + 1, len(a.ids) - 1), np.minimum(last_b + 1, len(b.ids) - 1)
        anchor = self.marked_a[a.ids[after_a]] & self.own.marked[b.ids[after_b]]
        anchor |= np.isin(last_a + 1, a.at)  # a text's end
        end_a, end_b = last_a[anchor] + 1, last_b[anchor] + 1
        start_a, start_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
        key = mix(run_hash(mix(a.ids.astype(np.uint64)), start_a, end_a)) ^ run_hash(mix(b.ids.astype(np.uint64)), start_b, end_b)
        key, sample, of = np.unique(key, return_index=True, return_inverse=True)
        n_a, n_b = (end_a - start_a)[sample], (end_b - start_b)[sample]
        ids_a, ids_b = take_runs(a.ids, start_a[sample], n_a), take_runs(b.ids, start_b[sample], n_b)
        near = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        number = np.full(len(key), -1, np.int64)
        hit = np.flatnonzero(self.keys[near] == key) if len(self.keys) else np.empty(0, np.int64)
        if len(hit):  # kept windows have these very ids
            at, same = self.place[near[hit]], np.ones(len(hit), bool)
            for p, ids, n in (("ids_a", ids_a, n_a), ("ids_b", ids_b, n_b)):
                kept, size = self.part(p, at)
                own = take_runs(ids, (np.cumsum(n) - n)[hit], np.minimum(n[hit], size))
                kept = take_runs(kept, np.cumsum(size) - size, np.minimum(n[hit], size))
                some = np.minimum(n[hit], size)
                same &= (n[hit] == size) & np.logical_and.reduceat(own == kept, np.cumsum(some) - some)
            number[hit[same]] = at[same]
        new = np.flatnonzero(number < 0)
        if len(new):
            first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            found = self.work_out(take_runs(ids_a, first_a[new], n_a[new]), n_a[new], take_runs(ids_b, first_b[new], n_b[new]), n_b[new])
            number[new] = self._add(key[new], found)
        return number[of], np.searchsorted(end_a, a.at, "right")


@lru_cache(1)
def aligner(ranks: str, model: str) -> Aligner:
    """One per Python worker."""
    return Aligner(encoder(ranks), pieces(model))


def aligned(docs: DataFrame, ranks: str, model: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """Each document's alignment: ``row`` (a key), ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256``, its distinct
    linked id pairs as ``a, b, n`` (arrays; ``n`` counts links) and, with ``keep_groups``, ``groups`` as text."""
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>" + (", groups string" if keep_groups else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(ranks, model)
        for batch in slices(batches, "text"):
            texts = batch.column("text").fill_null("").to_pylist()
            a, b = tokenised(work.enc, work.own, texts)
            number, first = work.batch(a, b)
            text, size = work.part("text", number)
            cut = np.concatenate([[0], np.cumsum(size)])[first].tolist()
            text = text.tobytes()  # each window ends with a semicolon
            lines = [text[x : max(y - 1, x)] for x, y in zip(cut, cut[1:], strict=False)]
            groups = np.concatenate([[0], np.cumsum(work.n_groups[number])])[first]
            pairs, size = work.part("links", number)
            at = np.concatenate([[0], np.cumsum(size)])[first]
            row = np.repeat(np.arange(len(texts)), np.diff(at))
            order = np.lexsort((pairs, row))
            row, pairs = row[order], pairs[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pairs[1:] != pairs[:-1])])) if len(pairs) else np.empty(0, np.int64)
            n = np.diff(np.append(new, len(pairs)))
            cut = pa.array(np.searchsorted(row[new], np.arange(len(texts) + 1)), pa.int32())
            arrays = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (pairs[new] >> _BITS, pairs[new] & ((1 << _BITS) - 1), n)]
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in lines]
            counts = [pa.array(np.diff(x), pa.int64()) for x in (a.at, b.at, groups, at)]
            cols = [batch.column("row"), batch.column("doc_id"), *counts, pa.array(digests, pa.string()), *arrays]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n"]
            if keep_groups:
                cols.append(pa.array([x.decode() for x in lines], pa.string()))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a, b, links`` (over all rows of ``aligned``) and ``best``: no pair of this ``b`` has more."""

    def flush(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(of, np.concatenate(counts), len(key)).astype(np.int64)

    def told(key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key >> _BITS, pa.int32()), pa.array(key & ((1 << _BITS) - 1), pa.int32()), pa.array(count)], names=["a", "b", "links"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for batch in batches:
            a, b, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "n"))
            keys.append(a << _BITS | b)
            counts.append(n)
            held += len(a)
            if held > _PARTIAL:
                key, count = flush(keys, counts)
                if len(key) > _PARTIAL // 2:
                    yield told(key, count)
                    key, count = key[:0], count[:0]
                keys, counts, held = [key], [count], len(key)
        yield told(*flush(keys, counts))

    summed = rows.select("a", "b", "n").mapInArrow(add, "a int, b int, links long").groupBy("a", "b").agg(F.sum("links").alias("links"))
    return summed.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))  # at most one row per id of the other vocabulary


def scored(rows: DataFrame, counts: DataFrame, table_rows: int = TABLE_ROWS) -> DataFrame:
    """``rows`` with ``n_best`` and ``count_sum``; both tables are written ones."""
    spark = rows.sparkSession
    whole = counts.count() <= table_rows
    top = (counts if whole else counts.orderBy(F.desc("links"), "a", "b").limit(table_rows)).toArrow()
    key = top["a"].to_numpy().astype(np.int64) << _BITS | top["b"].to_numpy().astype(np.int64)
    order = np.argsort(key)
    table = spark.sparkContext.broadcast((key[order], top["links"].to_numpy()[order], np.asarray(top["best"])[order].astype(bool)))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<a:int,b:int,n:int>>"
    part = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, links, best = table.value
        for batch in batches:
            a, b, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "n"))
            size = batch.column("a").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            own, row = a << _BITS | b, np.repeat(np.arange(len(size)), size)
            place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            hit = known[place] == own if len(known) else np.zeros(len(own), bool)
            sums = [np.zeros(len(size), np.int64) for _ in range(2)]
            np.add.at(sums[0], row[hit], np.where(best[place[hit]], n[hit], 0))
            np.add.at(sums[1], row[hit], n[hit] * links[place[hit]])
            cut = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(size)))])
            rest = pa.StructArray.from_arrays([pa.array(x[~hit], pa.int32()) for x in (a, b, n)], fields=list(part))
            cols = [batch.column(c) for c in kept] + [pa.array(x) for x in sums] + [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rest)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "n_best", "count_sum", "rest"])

    found = rows.select(*kept, "a", "b", "n").mapInArrow(run, schema)
    if whole:
        return found.drop("rest")
    found = written(found, "scored")
    rare = found.select("row", F.inline("rest")).join(counts, ["a", "b"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum"))
    more = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
    return found.drop("rest").join(rare, "row", "left").select(*kept, more("n_best", "more_best"), more("count_sum", "more_sum"))


def align(docs: DataFrame, ranks: str, model: str, table_rows: int = TABLE_ROWS, **columns) -> DataFrame:
    """Align the tokens of a rank file (A) and a piece model (B) in every document: ``doc_id, n_a, n_b,
    n_groups, n_links, n_best, count_sum, groups_sha256``. Both files are read by the executors."""
    rows = written(aligned(docs, ranks, model, **columns), "aligned")
    counts = written(pair_counts(rows), "pairs")
    return scored(rows, counts, table_rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
