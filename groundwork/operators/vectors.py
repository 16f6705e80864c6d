"""Hashed feature vectors as long tables (unit, bucket, weight), and nearest dense vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import rules
from ..functions.text import tokens

DIMS = 512


def feature_hash(feature: Column, dims: int = DIMS) -> Column:
    """E1. Struct of bucket and sign, from eight hex digits of the md5 and the next one."""
    digest = F.md5(feature.cast("binary"))
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dims).cast("int")
    sign = F.when(F.substring(digest, 9, 1) >= "8", 1.0).otherwise(-1.0)
    return F.struct(bucket.alias("bucket"), sign.alias("sign"))


def features(units: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """E2. ``keys, feature, weight``: tokens and bigrams with (1 + ln tf), less for stop words
    and for features with an underscore."""
    words = units.select(*keys, tokens(text_col).alias("w"))
    both = words.select(*keys, F.explode(F.concat("w", F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, 1 << 30), lambda a, b: F.concat_ws("_", a, b)))).alias("feature"))
    counted = both.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("tf"))
    weight = (1 + F.log("tf")) * F.when(F.col("feature").isin(*rules.STOP_WORDS), 0.45).otherwise(1.0) * F.when(F.col("feature").contains("_"), 0.6).otherwise(1.0)
    return counted.select(*keys, "feature", weight.alias("weight"))


#: Units that become vectors at once.
UNITS = 256


#: Features that are hashed at once: their words stay in the cache.
HASHED = 4096
_SHIFTS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_PLACES = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)


def _md5(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of messages of one block each: 16 rows of words, a column per message."""
    start = [np.full(block.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        else:
            f = b ^ c ^ d if i < 48 else c ^ (b | ~d)
        f += a
        f += block[_PLACES[i // 16](i)]
        f += _SINES[i]
        low = f >> np.uint32(32 - _SHIFTS[i])
        f <<= np.uint32(_SHIFTS[i])
        f |= low
        f += b
        a, b, c, d = d, f, b, c
    return a + start[0], b + start[1]


def _hashes(features: pa.Array, lead: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """E1 of all features behind ``lead``: buckets and signs. Calls of hashlib, two for each feature, were most of the time of
    a vector; here a step of md5 is one numpy call for 4096 features. Features of more than one block go to hashlib."""
    features = features.cast(pa.binary())
    ends = np.frombuffer(features.buffers()[1], np.int32)[features.offset : features.offset + len(features) + 1].astype(np.int64)
    data = np.frombuffer(features.buffers()[2] or b"", np.uint8)
    word, sign = np.empty(len(features), np.uint32), np.empty(len(features), bool)
    for first in range(0, len(features), HASHED):
        cut = ends[first : first + HASHED + 1]
        size = np.diff(cut)
        block = np.zeros((len(size), 64), np.uint8)
        block[:, : len(lead)] = np.frombuffer(lead, np.uint8)
        long = size + len(lead) > 55
        own = np.where(long, 0, size)
        row = np.repeat(np.arange(len(size)), own)
        place = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
        block[row, place + len(lead)] = data[cut[row] + place]
        block[np.arange(len(size)), own + len(lead)] = 0x80
        words = block.view("<u4").astype(np.uint32)
        words[:, 14] = (own + len(lead)) * 8
        one, two = _md5(np.ascontiguousarray(words.T))
        for k in np.flatnonzero(long).tolist():
            one[k], two[k] = np.frombuffer(hashlib.md5(lead + features[first + k].as_py(), usedforsecurity=False).digest(), "<u4")[:2]
        word[first : first + HASHED], sign[first : first + HASHED] = one.byteswap(), two & 0x80
    return word.astype(np.int64) % dims, np.where(sign, 1.0, -1.0)


def _sums(words: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and signed sum of each bucket that a feature of the row's tokens falls into, by row and bucket."""
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), sizes)
    coded = words.flatten().cast(pa.string()).dictionary_encode()
    code, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    first = np.flatnonzero(row[1:] == row[:-1])
    pair, of = np.unique((code[first] << 32) + code[first + 1], return_inverse=True)
    both = pc.binary_join_element_wise(known.take(pa.array(pair >> 32)), known.take(pa.array(pair & 0xFFFFFFFF)), "_")
    named = pa.concat_arrays([known, both]).dictionary_encode()  # a token with an underscore may be a bigram's feature too
    place, features = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[len(known) :], named.dictionary
    own, tf = np.unique((np.concatenate([row, row[first]]) << 32) + np.concatenate([code, place[of]]), return_counts=True)
    row, feature = own >> 32, own & 0xFFFFFFFF
    having = lambda found, x: np.where(found.to_numpy(zero_copy_only=False), x, 1.0)
    factor = having(pc.is_in(features, pa.array(rules.STOP_WORDS)), 0.45) * having(pc.match_substring(features, "_"), 0.6)
    weight = (1 + np.log(tf)) * factor[feature]
    rows, xs = [], []
    for lead, half in ((b"", 1.0), (b"x", 0.5)):
        bucket, sign = _hashes(features, lead, dims)
        rows.append(row * dims + bucket[feature])
        xs.append(sign[feature] * weight * half)
    at, of = np.unique(np.concatenate(rows), return_inverse=True)
    return at // dims, at % dims, np.bincount(of, np.concatenate(xs), len(at))


def _unit_sums(words: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_sums`` scaled to length 1; rows of length 0 are left out."""
    row, bucket, x = _sums(words, dims)
    norm = np.sqrt(np.bincount(row, x * x, len(words)))[row]
    return row[norm > 0], bucket[norm > 0], x[norm > 0] / norm[norm > 0]


def vectors_of(words: pa.ListArray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of the hashed vectors of lists of tokens, by row and bucket; six places, halves away from 0."""
    row, bucket, x = _unit_sums(words, dims)
    return row, bucket, np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


def hashed(units: DataFrame, keys: list[str], text_col: str = "text", dims: int = DIMS, empty: bool = False) -> DataFrame:
    """E3, E4 as arrays: ``keys, buckets, ws`` of each unit, by bucket: signed sums over both buckets of each feature (E2), scaled to
    length 1 and rounded to six places. Made inside the task: no feature is shuffled. A unit without tokens has no row, or empty lists (``empty``)."""
    rows = units.select(*keys, tokens(text_col).alias("_words"))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, UNITS) for k in range(0, whole.num_rows, UNITS)):
                row, bucket, x = _unit_sums(batch.column("_words"), dims)
                ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(z)) for z in (bucket.astype(np.int32), x)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *lists], names=[*keys, "buckets", "ws"])

    schema = StructType([*(rows.schema[k] for k in keys), StructField("buckets", ArrayType(IntegerType())), StructField("ws", ArrayType(DoubleType()))])
    made = rows.mapInArrow(embed, schema)
    return (made if empty else made.where(F.size("buckets") > 0)).withColumn("ws", F.transform("ws", lambda x: F.round(x, 6)))


def hash_embed(units: DataFrame, keys: list[str], text_col: str = "text", dims: int = DIMS) -> DataFrame:
    """E3, E4. ``keys, bucket, w``: ``hashed`` as a long table."""
    return hashed(units, keys, text_col, dims).select(*keys, F.inline(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("ws").alias("w"))))


def dots(pairs: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``keys, out``: dot products of the sparse vectors ``buckets, ws`` and ``other_buckets, other_ws`` of each row, 0 where
    they share no bucket or one is null."""

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, UNITS) for k in range(0, whole.num_rows, UNITS)):
                at, w = [], []
                for lead in ("", "other_"):
                    lists = batch.column(f"{lead}buckets")
                    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    at.append((row << 32) + lists.flatten().to_numpy(zero_copy_only=False))
                    w.append(batch.column(f"{lead}ws").flatten().to_numpy(zero_copy_only=False))
                both, i, j = np.intersect1d(*at, assume_unique=True, return_indices=True)
                total = np.bincount(both >> 32, w[0][i] * w[1][j], batch.num_rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(total)], names=[*keys, out])

    rows = pairs.select(*keys, "buckets", "ws", "other_buckets", "other_ws")
    return rows.mapInArrow(dot, StructType([*(rows.schema[k] for k in keys), StructField(out, DoubleType())]))


def text_cosines(pairs: DataFrame, keys: list[str], one: str, other: str, out: str, dims: int = DIMS) -> DataFrame:
    """``keys, out``: cosine of the hashed vectors of two texts of each row (0 where one has no tokens), made inside the task."""
    words = lambda text: F.array_join(tokens(text), " ")
    rows = pairs.select(*keys, tokens(one).alias("_one"), words(other).alias("_other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, UNITS) for k in range(0, whole.num_rows, UNITS)):
                asked = batch.column("_other").cast(pa.string()).dictionary_encode()  # a run's query stands beside each of its chunks
                of = asked.indices.to_numpy(zero_copy_only=False)
                lists = pc.split_pattern(pc.if_else(pc.equal(asked.dictionary, ""), None, asked.dictionary), " ")
                (row, bucket, x), (r2, b2, y) = vectors_of(batch.column("_one"), dims), vectors_of(lists, dims)
                query = np.zeros((len(lists), dims))
                query[r2, b2] = y
                total = np.bincount(row, x * query[of[row], bucket], batch.num_rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(total)], names=[*keys, out])

    return rows.mapInArrow(run, StructType([*(rows.schema[k] for k in keys), StructField(out, DoubleType())]))


#: Texts that a provider gets at once.
BATCH = 64
_PROBE = "One short text to see whether this provider answers."


@dataclass(frozen=True)
class Provider:
    """A model of the user's: ``load()`` sets it up and returns a function from a list of texts to a matrix. It is
    called in Python workers, once in each; ``load`` has to be importable there."""

    name: str
    load: Callable[[], Callable[[list[str]], np.ndarray]]


_loaded: dict[str, Callable[[list[str]], np.ndarray]] = {}


def _encode(provider: Provider, texts: list[str]) -> np.ndarray:
    """The rows of the texts, 64 at a time, by the model of this worker."""
    if provider.name not in _loaded:
        _loaded[provider.name] = provider.load()
    parts = [np.asarray(_loaded[provider.name](texts[k : k + BATCH]), np.float64) for k in range(0, len(texts), BATCH)]
    return np.concatenate(parts) if parts else np.empty((0, 0))


def first_working(spark: SparkSession, providers: Sequence[Provider]) -> Provider | None:
    """The first provider, in the order given, that loads and answers in an executor; None if none does. One
    provider serves a whole job, so that vectors of different models never meet."""
    for provider in providers:

        def probe(batches: Iterator[pa.RecordBatch], own: Provider = provider) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                try:
                    found = _encode(own, [_PROBE])
                    ok = found.ndim == 2 and len(found) == 1 and bool(np.isfinite(found).all())
                except Exception:  # any fault of a user's model means the next provider
                    ok = False
                yield pa.RecordBatch.from_arrays([pa.array([ok])], names=["ok"])

        if spark.range(0, 1, 1, 1).mapInArrow(probe, "ok boolean").first()["ok"]:
            return provider
    return None


def provided(units: DataFrame, keys: list[str], text_col: str, provider: Provider) -> DataFrame:
    """``keys, bucket, w`` of a provider's vectors, scaled to length 1 and rounded to six places; zero vectors and null
    texts (which count as empty) that give one have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _encode(provider, batch.column("_text").to_pylist())
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True)) if m.size else np.ones((len(m), 1))
            m = np.round(m / np.where(norm > 0, norm, 1), 6)
            row, bucket = np.nonzero(m)
            at = pa.array(row)
            cols = [batch.column(k).take(at) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bucket.astype(np.int32)), pa.array(m[row, bucket])], names=[*keys, "bucket", "w"])

    rows = units.select(*keys, F.coalesce(text_col, F.lit("")).alias("_text"))
    return rows.mapInArrow(run, StructType([*(rows.schema[k] for k in keys), StructField("bucket", IntegerType()), StructField("w", DoubleType())]))


def embed_table(units: DataFrame, keys: list[str], text_col: str = "text", provider: str | Callable | Sequence[Provider] = "auto", dims: int = DIMS) -> DataFrame:
    """E5. ``provider`` is ``hashing`` (or ``auto``, which is the same without models), an Arrow UDF from text to array of
    double, or a list of providers: the first that works, else hashing."""
    if callable(provider):
        dense = units.select(*keys, provider(F.coalesce(text_col, F.lit(""))).alias("v"))
        return dense.select(*keys, F.posexplode("v").alias("bucket", "w")).where("w <> 0")
    if not isinstance(provider, str):
        found = first_working(units.sparkSession, provider)
        return hash_embed(units, keys, text_col, dims) if found is None else provided(units, keys, text_col, found)
    if provider not in ("auto", "hashing"):
        raise ValueError(f"unknown provider {provider!r}")
    return hash_embed(units, keys, text_col, dims)


def dense(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """One map of bucket to weight per unit."""
    return vectors.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "w")))).alias("v"))


def map_dot(a: Column, b: Column) -> Column:
    """Dot product of two sparse maps."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


#: Queries that are broadcast at once, and rows that meet them at once (64 MB of scores).
QUERIES, ROWS = 8192, 1024


class _Nearest:
    """The best ``k`` rows of each query so far, nearest first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score, self.at = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        new = self.vectors @ vectors.T
        new[self.ids[:, None] == ids[None, :]] = -np.inf
        most = min(self.k, new.shape[1])
        least = np.maximum(np.partition(new, -most, axis=1)[:, -most], self.score[:, -1])
        for q in np.flatnonzero(new.max(axis=1) >= self.score[:, -1]).tolist():
            near = np.flatnonzero(new[q] >= least[q])
            score, at = np.concatenate([self.score[q], new[q, near]]), np.concatenate([self.at[q], ids[near]])
            best = np.lexsort((at, -score))[: self.k]
            self.score[q], self.at[q] = score[best], at[best]

    def told(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.at[row, place]), pa.array(self.score[row, place])], names=["query_id", "neighbour_id", "score"])


def _unit(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors of length 1) of the rows of each dimension."""
    size = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(size).tolist():
        own = batch.filter(pa.array(size == dims))
        m = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        yield dims, own.column("id").to_numpy(zero_copy_only=False), m / np.sqrt((m * m).sum(axis=1))[:, None]


def knn(base: DataFrame, k: int, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", queries: int = QUERIES) -> DataFrame:
    """E14. Exact nearest rows by cosine of each row whose id is divisible by ``every``.

    Queries are broadcast in lots of at most about ``queries``; the rows stream past each lot, and a task tells each query's
    best ``k`` only, so no row is copied or dealt. Null or zero vectors, and those
    with null or non-finite components, take no part; only vectors of the query's dimension are candidates.
    """
    x = F.col("v")
    rows = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda e: e != 0))
    asked = rows.where(F.col("id") % every == 0)
    lots = -(-asked.count() // queries) or 1
    schema, found = "query_id long, neighbour_id long, score double", None
    for lot in range(lots):
        own = asked if lots == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(lots)) == lot)
        shared = base.sparkSession.sparkContext.broadcast([x for b in own.toArrow().to_batches() for x in _unit(b)])

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            of: dict[int, list[_Nearest]] = {}
            for dims, ids, m in shared.value:
                of.setdefault(dims, []).append(_Nearest(ids, m, k))
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    for dims, ids, m in _unit(batch.slice(start, ROWS)):
                        for nearest in of.get(dims, ()):
                            nearest.meet(ids, m)
            for all_ in of.values():
                yield from (n.told() for n in all_)

        part = rows.mapInArrow(meet, schema)
        found = part if found is None else found.unionByName(part)
    found = found.withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "score")
