"""Benchmark decontamination: windows of normalised words in a broadcast hash set.

The benchmark's windows (ten consecutive words of an item, or all words of a shorter
one) are hashed, sorted and broadcast; every document is scanned once: its words are
hashed in one pass over its bytes, the hashes of its windows follow from running sums, a
bitmap turns most of them away, and what the sorted hashes keep is compared word by word.

A broadcast holds at most ``lot_bytes`` of windows. A larger benchmark is dealt into
lots, and the documents are scanned once per lot; the words that earlier lots hit and
their items travel with the row, so the result doesn't depend on the number of lots.

Handling: a null text has no words; an item or document without words hits nothing; texts are
read whole, however long. Documents are judged row by row: repeated rows and ids repeat their
results. Repeated items count once by their id; an item with a null id marks words but is not among
the items. Other columns are not read. No documents give no rows, no items give rows without hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import run_hash, slices, take_runs, text_bytes, word_hashes, word_runs, written

WINDOW = 10
LOT_BYTES = 64 << 20
_FILTER_BITS = 24
_VERIFY = 1 << 16

# words are runs of 0-9, a-z and everything beyond ASCII, after A-Z became a-z
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


class Words(NamedTuple):
    """The words of a batch of texts: their bytes, and the place of each row's first word."""

    raw: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        raw, offsets = text_bytes(column)
        raw = _FOLD[raw]
        starts, ends, first = word_runs(raw, offsets)
        return cls(raw, starts, ends - starts, first)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.raw, self.starts, self.starts + self.sizes)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words inside a row."""
        n = np.maximum(np.diff(self.first) - size + 1, 0)
        return np.arange(n.sum()) + np.repeat(self.first[:-1] - (np.cumsum(n) - n), n)

    def text(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and word sizes (a row per window) of the windows of ``size`` words at ``at``."""
        words = at[:, None] + np.arange(size)
        sizes = self.sizes[words]
        return take_runs(self.raw, self.starts[words].ravel(), sizes.ravel()), sizes


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of all items: ``words`` (joined by one space), ``item`` (the id as a string)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words.of(batch.column("text"))
            found: list[tuple[str, str]] = []
            for row, item in enumerate(batch.column("item").to_pylist()):
                a, b = words.first[row], words.first[row + 1]
                own = [words.raw[s : s + n].tobytes().decode() for s, n in zip(words.starts[a:b], words.sizes[a:b], strict=True)]
                found += {(" ".join(own[i : i + window]), item) for i in range(max(len(own) - window + 1, min(len(own), 1)))}
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([i for _, i in found], pa.string())], names=["words", "item"])

    texts = benchmark.selectExpr(f"cast(`{item_col}` as string) as item", f"`{text_col}` as text")
    return texts.mapInArrow(cut, "words string, item string").distinct()


class Table:
    """One lot of windows, sorted by hash within each size, with their items."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        self.items = sorted({i for _, i in pairs if i is not None})
        number = {i: k for k, i in enumerate(self.items)}
        texts = sorted({w for w, _ in pairs})
        place = {w: k for k, w in enumerate(texts)}
        words = Words.of(pa.array(texts, pa.string()))
        size = np.diff(words.first)
        key = run_hash(words.hashes(), words.first[:-1], words.first[1:])
        order = np.lexsort((key, size))
        rank = np.empty(len(texts), np.int64)
        rank[order] = np.arange(len(texts))
        self.words, self.at, self.keys, self.size = words, words.first[:-1][order], key[order], size[order]
        # the items of each window, as runs
        held = np.array(sorted({(int(rank[place[w]]), number[i]) for w, i in pairs if i is not None}), np.int64).reshape(-1, 2)
        self.item = held[:, 1]
        self.item_first = np.searchsorted(held[:, 0], np.arange(len(texts) + 1))
        self.sizes = [(int(n), *np.searchsorted(self.size, [n, n + 1]).tolist()) for n in np.unique(size)]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first words, windows of this table) of the windows that both hold."""
        hashes = words.hashes()
        for size, low, high in self.sizes:
            at = words.windows(size)
            key = run_hash(hashes, at, at + size)
            maybe = np.flatnonzero(self.filter[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            at, key, own = at[maybe], key[maybe], self.keys[low:high]
            place = np.searchsorted(own, key)
            while len(at):  # a second round only where two windows share a hash
                near = place < len(own)
                at, key, place = at[near], key[near], place[near]
                same = own[place] == key
                at, key, place = at[same], key[same], place[same]
                for k in range(0, len(at), _VERIFY):
                    a, b = at[k : k + _VERIFY], place[k : k + _VERIFY] + low
                    equal = self._equal(words, a, b, size)
                    yield size, a[equal], b[equal]
                place = place + 1

    def _equal(self, words: Words, at: np.ndarray, window: np.ndarray, size: int) -> np.ndarray:
        """Whether the words themselves are the same."""
        equal = np.zeros(len(at), bool)
        same = np.flatnonzero((words.sizes[at[:, None] + np.arange(size)] == self.words.sizes[self.at[window][:, None] + np.arange(size)]).all(axis=1))
        if len(same):
            (a, sizes), (b, _) = words.text(at[same], size), self.words.text(self.at[window[same]], size)
            ends = np.cumsum(sizes.sum(axis=1))
            equal[same] = np.logical_and.reduceat(a == b, ends - sizes.sum(axis=1))
        return equal


def lots(windows: DataFrame, lot_bytes: int = LOT_BYTES) -> Iterator[Table]:
    """The written windows as tables of about ``lot_bytes`` each; one at a time reaches the driver."""
    total = windows.agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64)).first()[0] or 0
    n = -(-total // lot_bytes)
    for k in range(n):
        own = windows if n == 1 else windows.where(F.pmod(F.xxhash64("words", "item"), F.lit(n)) == k)
        yield Table([(r["words"], r["item"]) for r in own.collect()])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_col: str = "text", lot_bytes: int = LOT_BYTES, keep_text: bool = False) -> DataFrame:
    """Scan every document for the benchmark's windows: ``doc_id, n_words, n_hit, items`` (sorted
    as strings) and, with ``keep_text``, ``text`` as it was and ``cleaned``: the text without the runs
    of hit words, each cut from the first character of its first word to the last of its last."""
    spark = docs.sparkSession
    windows = written(benchmark_windows(benchmark, window, item_col, bench_col), "windows")
    state = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text", "cast(null as binary) as hits", "cast(array() as array<string>) as items")
    carried = "doc_id long, text string, hits binary, items array<string>"
    report = "doc_id long, n_words long, n_hit long, items array<string>" + (", text string, cleaned string" if keep_text else "")

    def marker(shared, last: bool):  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table: Table | None = shared.value if shared else None
            for batch in slices(batches, "text"):
                words = Words.of(batch.column("text"))
                hit, items = _marked(batch, words, table)
                if not last:
                    packed = [np.packbits(hit[a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(packed, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "hits", "items"])
                    continue
                total = np.concatenate([[0], np.cumsum(hit)])
                cols = [batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array(np.diff(total[words.first]), pa.int64()), pa.array(items, pa.list_(pa.string()))]
                names = ["doc_id", "n_words", "n_hit", "items"]
                if keep_text:
                    cols += [batch.column("text"), pa.array(_cleaned(batch.column("text"), words, hit), pa.string())]
                    names += ["text", "cleaned"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

        return run

    before = None
    for table in lots(windows, lot_bytes):
        if before is not None:  # the rows with what the lots so far have hit
            state = written(state.mapInArrow(marker(before, False), carried), "scanned")
        before = spark.sparkContext.broadcast(table)
    return state.mapInArrow(marker(before, True), report)


def _marked(batch: pa.RecordBatch, words: Words, table: Table | None) -> tuple[np.ndarray, list[list[str]]]:
    """Hit words of a batch and the items of each row, with those of earlier lots."""
    edge = np.zeros(len(words.starts) + 1, np.int32)
    found = [np.empty((0, 2), np.int64)]
    for size, at, window in table.hits(words) if table else ():
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        row = np.searchsorted(words.first, at, "right") - 1
        found.append(np.unique(np.stack([row, window], axis=1), axis=0))
    hit = np.cumsum(edge[:-1]) > 0
    pairs = np.concatenate(found)
    n = table.item_first[pairs[:, 1] + 1] - table.item_first[pairs[:, 1]] if table else np.empty(0, np.int64)
    named = take_runs(table.item, table.item_first[pairs[:, 1]], n) if table else n
    items = [x or [] for x in batch.column("items").to_pylist()]
    own: dict[int, set[str]] = {}
    for row, item in np.unique(np.stack([np.repeat(pairs[:, 0], n), named], axis=1), axis=0).tolist():
        own.setdefault(row, set()).add(table.items[item])
    for row, new in own.items():
        items[row] = sorted(new.union(items[row]))
    for row, bits in enumerate(batch.column("hits").to_pylist()):
        if bits:
            a, b = words.first[row], words.first[row + 1]
            hit[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a)).astype(bool)
    return hit, items


def _cleaned(column: pa.Array, words: Words, hit: np.ndarray) -> list[str | None]:
    texts = column.to_pylist()
    _, offsets = text_bytes(column)
    for row in np.unique(np.searchsorted(words.first, np.flatnonzero(hit), "right") - 1).tolist():
        a, b, base = words.first[row], words.first[row + 1], offsets[row]
        change = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
        raw, out, at = texts[row].encode(), [], 0
        for s, e in zip(np.flatnonzero(change == 1) + a, np.flatnonzero(change == -1) + a - 1, strict=True):
            out.append(raw[at : words.starts[s] - base])
            at = int(words.starts[e] + words.sizes[e] - base)
        texts[row] = b"".join([*out, raw[at:]]).decode()
    return texts


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", **options) -> DataFrame:
    """``doc_id, text`` without what the benchmark holds: ``remove='spans'`` cuts the hit words out of
    the texts, ``remove='documents'`` leaves out every document with a hit."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    seen = scan(docs, benchmark, keep_text=True, **options)
    if remove == "documents":
        return seen.where("n_hit = 0").select("doc_id", "text")
    return seen.select("doc_id", F.col("cleaned").alias("text"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    seen = scan(docs, benchmark, **options)
    named = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return seen.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
