"""Substring deduplication with a log-structured fingerprint index.

A window is ``width`` consecutive words of one document. Each window has a
fingerprint: the smallest hash of the k-word runs in it. Equal windows have equal
fingerprints, and neighbouring windows mostly share one, so an index of
fingerprints is some twenty times smaller than one of windows.

The index is log-structured: every batch of documents (ascending ids) adds one
immutable run, sorted by fingerprint inside hash ranges. A new batch is merge-joined
with all runs; fingerprints met in two documents are flagged for both of them. When
runs pile up they are compacted into one that keeps the first document of each
fingerprint (the others were flagged when they came). Flagged windows are then
verified by 96 bits of their whole word sequence, and the smallest document id of
each sequence keeps it.

Nothing here grows with the number of copies: a fingerprint that many documents
of one map task share is shipped once for the task, and no pairs are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_filter, partitions, powers, mix, slices, take_runs, text_bytes, word_hashes, word_runs, written

WIDTH, GRAM = 50, 8
_BASE_W, _BASE_G, _BASE_V = 0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0xA24BAED4963EE407
_STEP = "kind int, bucket int, doc_id long, a binary, d binary"


def _rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``width`` values (runs over row borders included)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=total[1:])
        return mix((total[width:] - total[:-width]) * powers(pow(base, -1, 1 << 64), n))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Windows:
    """The windows of a chunk of rows: row, word position, fingerprint, word hashes."""

    def __init__(self, column: pa.Array, width: int, gram: int):
        raw, offsets = text_bytes(column)
        starts, ends, first = word_runs(raw, offsets)
        self.hashes = word_hashes(raw, starts, ends)
        counts = np.maximum(np.diff(first) - width + 1, 0)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.begin = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = self.begin + first[:-1][self.row]  # the window's first word in ``hashes``
        self.print = _sliding_min(_rolling(self.hashes, gram, _BASE_G), width - gram + 1)[self.at] if len(self.at) else np.empty(0, np.uint64)
        self.width = width

    def identity(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 further bits of each window's word sequence."""
        return _rolling(self.hashes, self.width, _BASE_W)[at], (_rolling(self.hashes, self.width, _BASE_V)[at] >> np.uint64(32)).astype(np.uint32)


def _by_run(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _rows(kind: int, bucket: list, doc: list, a: list, d: list) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.int32()), pa.array(bucket, pa.int32()), pa.array(doc, pa.int64()), pa.array(a, pa.binary()), pa.array(d, pa.binary())],
        names=["kind", "bucket", "doc_id", "a", "d"],
    )


def _per_document(doc: np.ndarray, value: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Rows of (doc_id, its values)."""
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    cut = _by_run(doc)
    parts = [x.tobytes() for x in np.split(value, cut[1:])] if len(cut) else []
    return _rows(kind, [None] * len(cut), doc[cut].tolist(), parts, [None] * len(cut))


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Chunks of a task in lots of about ``limit`` bytes, so that copies meet before the shuffle."""
    lot, size = [], 0
    for part in slices(batches, "text"):
        lot.append(part)
        size += part.nbytes
        if size >= limit:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def fingerprints(docs: DataFrame, buckets: int, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Step rows of a batch ``(doc_id, text)``: kind 0 flags fingerprints that a task's
    lot holds in two documents, kind 1 ships (fingerprint, first document) by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _gathered(batches, 16 << 20):
            prints, owners = [], []
            for part in lot:
                w = Windows(part.column("text"), width, gram)
                if len(w.at):
                    cut = np.flatnonzero(np.concatenate([[True], (w.print[1:] != w.print[:-1]) | (w.row[1:] != w.row[:-1])]))
                    prints.append(w.print[cut])
                    owners.append(part.column("doc_id").to_numpy(zero_copy_only=False)[w.row[cut]].astype(np.int64))
            if not prints:
                continue
            a, d = np.concatenate(prints), np.concatenate(owners)
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
            a, d = a[new], d[new]
            cut = _by_run(a)
            shared = np.repeat(np.diff(np.append(cut, len(a))) > 1, np.diff(np.append(cut, len(a))))
            if shared.any():
                yield _per_document(d[shared], a[shared])
            a, d = a[cut], d[cut]
            part = (a >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(part, kind="stable")
            a, d, part = a[order], d[order], part[order]
            cut = _by_run(part)
            yield _rows(1, part[cut].tolist(), [None] * len(cut), [x.tobytes() for x in np.split(a, cut[1:])], [x.tobytes() for x in np.split(d, cut[1:])])

    return docs.mapInArrow(run, _STEP)


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(table.column("a").to_pylist()), np.uint64)
    return a, np.frombuffer(b"".join(table.column("d").to_pylist()), np.int64)


def _merge(table: pa.Table) -> pa.Table:
    """One hash range: the new batch (kind 1) against the runs (kind 2, 3, ..., each sorted).

    Gives kind 0 flags for both sides of a match and kind 1, the batch's own run."""
    kinds = table.column("kind").to_numpy()
    bucket = int(table.column("bucket")[0].as_py())
    a, d = _entries(table.filter(pa.array(kinds == 1)))
    order = np.lexsort((d, a))
    a, d = a[order], d[order]
    cut = _by_run(a)
    size = np.diff(np.append(cut, len(a)))
    many = np.repeat(size > 1, size)
    flag_a, flag_d = [a[many]], [d[many]]
    for kind in np.unique(kinds[kinds > 1]):
        old_a, old_d = _entries(table.filter(pa.array(kinds == kind)))
        if not len(old_a) or not len(a):
            continue
        place = np.minimum(np.searchsorted(old_a, a), len(old_a) - 1)
        hit = old_a[place] == a
        flag_a += [a[hit], a[hit]]
        flag_d += [d[hit], old_d[place[hit]]]
    flag_a, flag_d = np.concatenate(flag_a), np.concatenate(flag_d)
    out = [_rows(1, [bucket], [None], [a[cut].tobytes()], [d[cut].tobytes()])]
    if len(flag_a):
        out.append(_per_document(flag_d, flag_a))
    return pa.Table.from_batches(out)


def _compact(table: pa.Table) -> pa.Table:
    """Runs of one hash range into one sorted run with the first document of each fingerprint."""
    a, d = _entries(table)
    order = np.lexsort((d, a))
    a, d = a[order], d[order]
    cut = _by_run(a)
    return pa.Table.from_batches([_rows(1, [int(table.column("bucket")[0].as_py())], [None], [a[cut].tobytes()], [d[cut].tobytes()])])


class FingerprintIndex:
    """The index: immutable runs in the shared folder. ``add`` takes batches whose
    document ids exceed all ids added before."""

    def __init__(self, spark, buckets: int | None = None, width: int = WIDTH, gram: int = GRAM, most_runs: int = 2):
        self.buckets = buckets or max(64, 4 * partitions(spark))
        self.width, self.gram, self.most_runs = width, gram, most_runs
        self.runs: list[DataFrame] = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch ``(doc_id, text)``; returns ``(doc_id, a)``: fingerprints flagged by it."""
        step = written(fingerprints(docs, self.buckets, self.width, self.gram), "prints")
        sides = step.where("kind = 1")
        for k, run in enumerate(self.runs):
            sides = sides.unionByName(run.withColumn("kind", F.lit(k + 2)))
        merged = written(sides.groupBy("bucket").applyInArrow(_merge, _STEP), "run")
        self.runs.append(merged.where("kind = 1"))
        if len(self.runs) > self.most_runs:
            self.compact()
        return step.where("kind = 0").unionByName(merged.where("kind = 0")).select("doc_id", "a")

    def compact(self) -> None:
        runs = self.runs[0]
        for run in self.runs[1:]:
            runs = runs.unionByName(run)
        self.runs = [written(runs.groupBy("bucket").applyInArrow(_compact, _STEP), "compacted")]


_FOUND = "bucket int, doc_id long, h binary, v binary, d binary, p binary"


def _found(bucket: list, doc: list, h: list, v: list, d: list, p: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((bucket, doc, h, v, d, p), kinds, strict=True)], names=["bucket", "doc_id", "h", "v", "d", "p"])


def _later(h, v, d, p) -> tuple[np.ndarray, ...]:
    """Sorted windows, and which of them have the same words in a smaller document."""
    order = np.lexsort((d, v, h))
    h, v, d, p = h[order], v[order], d[order], p[order]
    cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (v[1:] != v[:-1])]))
    return h, v, d, p, d > np.repeat(d[cut], np.diff(np.append(cut, len(h))))


def _positions(d: np.ndarray, p: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of (range of documents, documents, starts): one for each range, not each document."""
    part = (mix(d.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((p, d, part))
    d, p, part = d[order], p[order].astype(np.uint32), part[order]
    cut = _by_run(part)
    none = [None] * len(cut)
    split = lambda x: [y.tobytes() for y in np.split(x, cut[1:])] if len(cut) else []
    return _found(part[cut].tolist(), none, none, none, split(d), split(p))


def _starts(table: pa.Table) -> pa.Table:
    """All starts of a range of documents: one row for each document."""
    d = np.frombuffer(b"".join(table.column("d").to_pylist()), np.int64)
    p = np.frombuffer(b"".join(table.column("p").to_pylist()), np.uint32)
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    cut = _by_run(d)
    return pa.table({"doc_id": pa.array(d[cut], pa.int64()), "p": pa.array([x.tobytes() for x in np.split(p, cut[1:])] if len(cut) else [], pa.binary())})


def repeated_windows(flagged: DataFrame, buckets: int, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Verify: ``flagged`` has ``doc_id, text, prints``; returns ``(doc_id, p)``, the
    starts (uint32) of windows whose word sequence starts in a smaller document too."""
    ranges = max(16, partitions(flagged.sparkSession))  # of documents, for the way back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _gathered(batches, 16 << 20):
            found = []
            for part in lot:
                w = Windows(part.column("text"), width, gram)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                keep = np.zeros(len(w.at), bool)
                edge = np.searchsorted(w.row, np.arange(len(ids) + 1))
                for r, prints in enumerate(part.column("prints")):
                    want = np.unique(np.frombuffer(b"".join(prints.as_py()), np.uint64))
                    own = w.print[edge[r] : edge[r + 1]]
                    keep[edge[r] : edge[r + 1]] = want[np.minimum(np.searchsorted(want, own), len(want) - 1)] == own
                h, v = w.identity(w.at[keep])
                found.append((h, v, ids[w.row[keep]], w.begin[keep]))
            h, v, d, p, later = _later(*(np.concatenate(x) for x in zip(*found, strict=True)))
            if not len(h):
                continue
            if later.any():
                yield _positions(d[later], p[later], ranges)
            h, v, d, p = h[~later], v[~later], d[~later], p[~later]
            part = (h >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(part, kind="stable")
            h, v, d, p, part = (x[order] for x in (h, v, d, p, part))
            cut = _by_run(part)
            cols = [[y.tobytes() for y in np.split(x, cut[1:])] for x in (h, v, d, p.astype(np.uint32))]
            yield _found(part[cut].tolist(), [None] * len(cut), *cols)

    def reduce(table: pa.Table) -> pa.Table:
        cols = [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("h", np.uint64), ("v", np.uint32), ("d", np.int64), ("p", np.uint32))]
        _, _, d, p, later = _later(*cols)
        return pa.Table.from_batches([_positions(d[later], p[later], ranges)])

    step = written(flagged.mapInArrow(run, _FOUND), "windows")  # windows, and positions where h is null
    rest = step.where("h is not null").groupBy("bucket").applyInArrow(reduce, _FOUND)
    places = step.where("h is null").unionByName(rest).select("bucket", "d", "p")
    return places.groupBy("bucket").applyInArrow(_starts, "doc_id long, p binary")


def _cut(width: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw, offsets = text_bytes(part.column("text"))
            starts, ends, first = word_runs(raw, offsets)
            gone = np.zeros(len(starts), bool)
            for r, own in enumerate(part.column("starts")):
                if own.is_valid:
                    at = np.unique(np.frombuffer(own.as_py(), np.uint32)).astype(np.int64)
                    change = np.zeros(first[r + 1] - first[r] + 1, np.int64)
                    change[at] += 1
                    np.add.at(change, np.minimum(at + width, len(change) - 1), -1)
                    gone[first[r] : first[r + 1]] = np.cumsum(change[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])[first]
            s, n = starts[~gone], (ends - starts)[~gone] + 1
            padded = np.append(raw, np.uint8(0x20))
            text = take_runs(padded, s, n).copy()
            last = np.cumsum(n)
            text[last - 1] = 0x20
            edge = np.concatenate([[0], last])[first - removed]
            text = text.tobytes()
            kept = [text[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            cols = [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols.append(pa.array([k.decode("utf-8", "replace") for k in kept]))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, batches: int = 3, keep_text: bool = False) -> DataFrame:
    """Remove words covered by windows that a smaller document id holds too.

    Per row: ``doc_id, n_words, n_removed, kept_sha256`` (kept words joined by one
    space) and ``kept_text`` on request. Null or empty text has no words; texts of fewer
    than ``width`` words keep all. Windows that repeat in one document only stay. Rows
    with equal ids count as one document; rows with a null id keep all their words and are
    nobody's source. Texts are read whole, however long. The table is indexed in ``batches`` of ascending ids, as an
    incremental run would, in hash ranges of about 32 MB of text. Other columns are not read. Empty in, empty out.
    """
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index = FingerprintIndex(spark, max(64, 4 * partitions(spark), size >> 25), width, gram)
    cuts = table.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    flags = None
    bounds = [None, *sorted(set(cuts or [])), None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        batch = table
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        found = index.add(batch)
        flags = found if flags is None else flags.unionByName(found)
    # only texts that may have flags, and then only those that may have repeats, are dealt by id
    prints = written(flags.groupBy("doc_id").agg(F.collect_list("a").alias("prints")), "flags")
    flagged = table.where(id_filter(prints, "doc_id")("doc_id")).join(prints, "doc_id")
    starts = written(repeated_windows(flagged, index.buckets, width, gram), "repeats").withColumnRenamed("p", "starts")
    hit = id_filter(starts, "doc_id")("doc_id")
    cut = table.where(hit).join(starts, "doc_id", "left").select("doc_id", "text", "starts").unionByName(table.where(~hit).withColumn("starts", F.lit(None).cast("binary")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return cut.mapInArrow(_cut(width, keep_text), schema)
