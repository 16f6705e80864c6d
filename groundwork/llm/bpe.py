"""Byte-level BPE encoding and decoding over arrays.

Pre-tokenisation: every code point gets a class; where a token starts follows from
the classes of a few neighbours and from two facts that scans carry along: the
position of the last class change (a running maximum) and, for contractions, the
composition of small transition functions. No regular expression runs. The slices are
reduced to distinct ones, looked up in a cache, and the misses are merged together:
each round merges the lowest-ranked pair of every piece at once. Offsets of the
slices and of the ids are kept, so ids decode to the bytes of any row.

Pre-tokens of one chunk are told apart by a 64-bit hash of their code points.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import mix, run_hash, slices, take_runs

OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3
_CACHE_LIMIT, _LONG = 400_000, 200


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or other."""
    out = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(0x110000):
        out[point] = kinds.get(unicodedata.category(chr(point))[0], OTHER)
    # fixed values: the code points with the property White_Space
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def _scatter(points: np.ndarray) -> np.ndarray:
    """A 64-bit word for each code point."""
    return (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and each text's offset."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return points, offsets


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Boolean per code point: a pre-token starts here.

    The rules of the pattern: a run of letters, of numbers or of others is one token,
    with a preceding single U+0020 if there is one; white space that stays is one
    token, but its last character is split off before a non-space (and joins the next
    token if it is U+0020); ``'s 't 're 've 'm 'll 'd`` are tokens where a token can
    start with the quote.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    row_start = np.zeros(n, bool)
    row_start[offsets[:-1][offsets[:-1] < n]] = True
    row_end = np.zeros(n, bool)
    row_end[offsets[1:][offsets[1:] > 0] - 1] = True
    before = np.empty_like(kind)
    before[0] = kind[0]
    before[1:] = kind[:-1]
    change = (kind != before) | row_start

    space = kind == SPACE
    blank = points == 0x20
    next_solid = np.zeros(n, bool)  # the next character is in the same row and no space
    next_solid[:-1] = ~space[1:]
    next_solid &= ~row_end
    tail = space & next_solid  # the last space of a run, before a solid character
    carried = np.zeros(n, bool)  # the previous character is a U+0020 that leads this token
    carried[1:] = (tail & blank)[:-1]
    carried &= ~row_start
    start = (change & ~carried) | tail

    quotes = np.flatnonzero((points == 0x27) & ~row_end)
    if len(quotes):
        start = _contractions(points, kind, offsets, quotes, start, carried)
    return start


def _contractions(points, kind, offsets, quotes, start, carried) -> np.ndarray:
    """Splits at contractions. A quote opens one if a token can start there: it begins
    the run of others without a leading blank, or the character before it ends
    another contraction. The second case depends on the first, hence a scan: per
    quote a function of "the previous one fits" on {no, yes}."""
    limit = np.searchsorted(offsets, quotes, "right")
    room = offsets[limit] - quotes  # characters of the row from the quote on
    at = lambda k: points[np.minimum(quotes + k, len(points) - 1)]
    one, two = at(1), at(2)
    single = (room >= 2) & np.isin(one, [ord(c) for c in "stmd"])
    double = (room >= 3) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    length = np.where(double, 3, np.where(single, 2, 0))
    free = start[quotes] & ~carried[quotes] & (length > 0)
    # a quote right after the end of the previous contraction can open one too
    chained = np.zeros(len(quotes), bool)
    if len(quotes) > 1:
        chained[1:] = (quotes[:-1] + length[:-1] == quotes[1:]) & (length[:-1] > 0) & (length[1:] > 0)
    # step functions on {0: previous is none, 1: previous is one}: constant free, or identity where chained
    steps = np.stack([free, free | chained], axis=1).astype(np.int8)
    opens, shift = steps.copy(), 1
    while shift < len(opens):
        if not (opens[:, 0] != opens[:, 1]).any():
            break
        opens[shift:] = np.take_along_axis(opens[shift:], opens[:-shift], axis=1)
        shift *= 2
    opens = opens[:, 0].astype(bool)

    start = start.copy()
    size, at_quote = length[opens], quotes[opens]
    ends = at_quote + size
    row_last = offsets[np.searchsorted(offsets, at_quote, "right")]
    start[at_quote] = True
    start[at_quote + 1] = False
    start[(at_quote + 2)[size == 3]] = False
    inside = ends < row_last  # what follows starts a token of its own
    start[ends[inside]] = True
    return start


class Encoder:
    """Ranks, pair table and cache of one vocabulary; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        self._fill_table(keys, np.fromiter(pairs.values(), np.int64, len(pairs)))
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        # the cache: pieces by ascending hash, with their byte lengths and the place of their ids
        self.keys = np.empty(0, np.uint64)
        self.sizes, self.begin, self.count = (np.empty(0, np.int64) for _ in range(3))
        self.used, self.ids = np.empty(0, bool), np.empty(0, np.int32)

    def _fill_table(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, int(np.ceil(np.log2(len(keys) * 4))))
        self._shift = np.uint64(64 - bits)
        self._keys, self._values = np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.int64)
        slot = (mix(keys.astype(np.uint64)) >> self._shift).astype(np.int64)
        for key, value, s in zip(keys.tolist(), values.tolist(), slot.tolist(), strict=True):
            while self._keys[s] != -1:
                s += 1
            self._keys[s], self._values[s] = key, value
        full = self._keys != -1
        run = best = 0
        for x in full.tolist():
            run = run + 1 if x else 0
            best = max(best, run)
        self._probes = best + 1

    NONE = np.int64(1 << 40)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b merge to, NONE without one."""
        key = a << 20 | b
        slot = (mix(key.astype(np.uint64)) >> self._shift).astype(np.int64)
        out = np.where(self._keys[slot] == key, self._values[slot], self.NONE)
        open_ = np.flatnonzero((self._keys[slot] != key) & (self._keys[slot] != -1))
        for _ in range(self._probes):
            if not len(open_):
                break
            slot[open_] += 1
            now = self._keys[slot[open_]]
            hit = now == key[open_]
            out[open_[hit]] = self._values[slot[open_[hit]]]
            open_ = open_[~hit & (now != -1)]
        return out

    def merge(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces (their bytes concatenated) and the number of ids of each."""
        long = np.flatnonzero(lengths > _LONG)
        if not len(long):
            return self._merge_short(raw, lengths)
        ends = np.cumsum(lengths)
        short = np.flatnonzero(lengths <= _LONG)
        ids, counts = self._merge_short(take_runs(raw, (ends - lengths)[short], lengths[short]), lengths[short])
        parts: list = [None] * len(lengths)
        for k, x in zip(short, np.split(ids, np.cumsum(counts)[:-1]) if len(short) else [], strict=True):
            parts[k] = x
        for k in long:
            parts[k] = self._merge_long(raw[ends[k] - lengths[k] : ends[k]])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _merge_long(self, raw: np.ndarray) -> np.ndarray:
        """One long piece through a heap of (rank, place): n log n steps."""
        ids = self.byte_id[raw]
        rank = self.pair_rank(ids[:-1], ids[1:])
        heap = [(int(r), int(i)) for i, r in enumerate(rank) if r < self.NONE]
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(ids)
        after, before, token = list(range(1, n + 1)), list(range(-1, n - 1)), self.bytes_of
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.ranks.get(token[ids[i]] + token[ids[j]]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (new := self.ranks.get(token[ids[a]] + token[ids[after[a]]])) is not None:
                    heapq.heappush(heap, (new, a))
        return np.array([x for x in ids if x >= 0], np.int64)

    def _merge_short(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self.byte_id[raw]
        piece = np.repeat(np.arange(len(lengths)), lengths)
        done_ids, done_piece = [], []
        rank = np.full(len(ids), self.NONE)
        if len(ids) > 1:
            rank[:-1] = np.where(piece[1:] == piece[:-1], self.pair_rank(ids[:-1], ids[1:]), self.NONE)
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            counts = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            busy = np.repeat(least < self.NONE, counts)
            if not busy.all():
                done_ids.append(ids[~busy])
                done_piece.append(piece[~busy])
                ids, piece, rank = ids[busy], piece[busy], rank[busy]
                if not len(ids):
                    break
                keep = least < self.NONE
                least, counts = least[keep], counts[keep]
                first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            hit = rank == np.repeat(least, counts)
            where = np.flatnonzero(hit)
            of = piece[where]
            where = where[np.concatenate([[True], of[1:] != of[:-1]])]  # the leftmost in each piece
            ids[where] = rank[where]
            stay = np.ones(len(ids), bool)
            stay[where + 1] = False
            at = where - np.arange(len(where))  # where the merged ids stand after the removal
            ids, piece, rank = ids[stay], piece[stay], rank[stay]
            for place in (at, at[at > 0] - 1):
                ok = place + 1 < len(ids)
                right = np.where(ok, place + 1, place)
                same = ok & (piece[place] == piece[right])
                rank[place] = np.where(same, self.pair_rank(ids[place], ids[right]), self.NONE)
        if not done_ids:
            return np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
        ids, piece = np.concatenate(done_ids), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return ids[order], np.bincount(piece, minlength=len(lengths))

    def lookup(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each distinct piece in ``self.ids``: from the
        cache, or merged now and added. ``keys`` ascend."""
        if len(self.keys) > _CACHE_LIMIT:
            self._shrink()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        hit = (self.keys[place] == keys) & (self.sizes[place] == lengths) if len(self.keys) else np.zeros(len(keys), bool)
        self.used[place[hit]] = True
        begin, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        begin[hit], count[hit] = self.begin[place[hit]], self.count[place[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            ids, n = self.merge(take_runs(raw, starts[miss], lengths[miss]), lengths[miss])
            at = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            begin[miss], count[miss] = at, n
            new = miss if not len(self.keys) else miss[self.keys[place[miss]] != keys[miss]]
            where = np.searchsorted(self.keys, keys[new])
            for name, x in (("keys", keys[new]), ("sizes", lengths[new]), ("begin", begin[new]), ("count", count[new]), ("used", np.zeros(len(new), bool))):
                setattr(self, name, np.insert(getattr(self, name), where, x))
        return begin, count

    def _shrink(self) -> None:
        """Keep the pieces that were met again, or none if those are too many."""
        keep = self.used if 2 * self.used.sum() < _CACHE_LIMIT else np.zeros(len(self.keys), bool)
        self.ids = take_runs(self.ids, self.begin[keep], self.count[keep])
        self.keys, self.sizes, self.count = self.keys[keep], self.sizes[keep], self.count[keep]
        self.begin, self.used = np.cumsum(self.count) - self.count, np.zeros(len(self.keys), bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offset of each text's ids."""
        points, offsets = code_points(texts)
        start = np.flatnonzero(pretoken_starts(points, offsets))
        if not len(start):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        end = np.append(start[1:], len(points))
        key, sample, of = np.unique(run_hash(_scatter(points), start, end), return_index=True, return_inverse=True)
        raw = np.frombuffer("".join(texts).encode("utf-8", "replace"), np.uint8)
        if len(raw) == len(points):
            byte_at = np.arange(len(points) + 1)
        else:
            byte_at = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points >= 0x80) + ((points >= 0x800) & ((points < 0xD800) | (points > 0xDFFF))) + (points >= 0x10000), out=byte_at[1:])
        begin, count = self.lookup(key, raw, byte_at[start[sample]], byte_at[end[sample]] - byte_at[start[sample]])
        n = count[of]
        out = take_runs(self.ids, begin[of], n)
        return out, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, offsets)]

    def encode_added(self, texts: list[str], added: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the added tokens cut out of the texts before pre-tokenisation."""
        if not any(a in t for a in added for t in texts):
            return self.encode(texts)
        cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        split = [cut.split(t) for t in texts]
        ids, at = self.encode([x for parts in split for x in parts[::2]])
        out, sizes, k = [], [], 0
        for parts in split:
            size = 0
            for n, x in enumerate(parts):
                if n % 2:
                    own = np.array([added[x]], ids.dtype)
                else:
                    own = ids[at[k] : at[k + 1]]
                    k += 1
                out.append(own)
                size += len(own)
            sizes.append(size)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids."""
        return take_runs(self.flat, self.first[ids], self.lengths[ids])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a rank file; one per Python worker."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``
    and, with ``keep_ids``, ``ids`` (array of int) and ``offsets`` (the byte where each
    id starts in the decoded text).

    A null text counts as empty and has no ids; special tokens are ordinary text. Rows
    are independent of each other: repeated rows and ids give repeated results, an
    empty table an empty one. ``path`` is a rank file that the executors can read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, offsets array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text"):
            ids, at = enc.encode(batch.column("text").fill_null("").to_pylist())
            data = enc.decode(ids).tobytes()
            byte_ends = np.concatenate([[0], np.cumsum(enc.lengths[ids])])
            raw = ids.astype("<u4").tobytes()
            cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            cols = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(np.diff(at), pa.int64()),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in cuts]),
                pa.array([hashlib.sha256(data[byte_ends[a] : byte_ends[b]]).hexdigest() for a, b in cuts]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                begin = np.repeat(byte_ends[at[:-1]], np.diff(at))
                cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(byte_ends[:-1] - begin, pa.int32())))
                names += ["ids", "offsets"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)
