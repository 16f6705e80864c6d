"""Language identification by a string kernel with Nyström landmarks.

Kernel of two texts: the mean over n of |G_n(x) & G_n(z)| / sqrt(|G_n(x)| |G_n(z)|),
where G_n is the set of letter n-grams that occur (presence, not counts), n = 1 to 3.
Landmark texts Z span the feature space: phi(x) = K(x, Z) K(Z, Z)^-1/2. One ridge
regression per language on phi separates it from the rest.

All that follows the presence vectors is linear, so the landmarks' presence, the
whitening and the regression weights multiply out to one matrix (n-grams x languages);
a batch is scored by one product of its sparse presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bpe import LETTER, classes, code_points
from .shared import mix, slices

ORDERS = (1, 2, 3)
BITS = 18
#: Bound of the sample that the model is fitted on: rows per language, and landmarks among them.
PER_LANGUAGE, LANDMARKS = 300, 50
#: Languages that are learned at most: the most frequent labels, ties by name.
LANGUAGES = 200
RIDGE = 1e-2
UNDETERMINED = "und"


def gram_sets(texts: list[str]) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """For each text and order the sorted distinct n-gram slots; and its number of letters.

    Letters are lower-cased; every run of other characters is one space, and the text
    has a space at either end."""
    points, offsets = code_points([t.lower() for t in texts])
    letter = classes()[points] == LETTER if len(points) else np.zeros(0, bool)
    letters = np.concatenate([[0], np.cumsum(letter)])[offsets]
    flags = np.zeros(1 << BITS, bool)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        keep = letter[a:b]
        chars = np.where(keep, points[a:b], 32).astype(np.uint64)
        stay = keep.copy()
        stay[1:] |= keep[:-1]  # of a run of others, the first
        chars = np.concatenate([[np.uint64(32)], chars[stay], [np.uint64(32)]])
        own = []
        for n in ORDERS:
            m = len(chars) - n + 1
            if m <= 0:
                own.append(np.empty(0, np.int64))
                continue
            key = chars[:m].copy()
            for k in range(1, n):
                key = (key << np.uint64(21)) | chars[k : k + m]
            slot = (mix(key + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
            if m < 2000:
                own.append(np.unique(slot))
            else:
                flags[slot] = True
                found = np.flatnonzero(flags)
                flags[found] = False
                own.append(found)
        out.append(own)
    return out, np.diff(letters)


class Model:
    """Languages, and the matrix from n-gram slots to their scores."""

    def __init__(self, languages: list[str], row_of: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.row_of, self.weights, self.bias = languages, row_of, weights, bias

    def scores(self, sets: list[list[np.ndarray]]) -> np.ndarray:
        """Texts x languages: the sparse presence matrix of the batch times the weights."""
        out = np.tile(self.bias, (len(sets), 1))
        for k in range(len(ORDERS)):
            slots = [s[k] for s in sets]
            sizes = np.array([len(s) for s in slots])
            flat = np.concatenate(slots) if len(slots) else np.empty(0, np.int64)
            rows = self.row_of[k][flat]
            text = np.repeat(np.arange(len(sets)), sizes)[rows >= 0]
            rows = rows[rows >= 0]
            if len(rows):
                cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                out[text[cut]] += np.add.reduceat(self.weights[rows], cut, axis=0) / np.sqrt(sizes[text[cut]])[:, None] / len(ORDERS)
        return out


def _presence(sets: list[list[np.ndarray]], k: int, row_of: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros((len(sets), rows), np.float32)
    for i, s in enumerate(sets):
        r = row_of[s[k]]
        out[i, r[r >= 0]] = 1 / np.sqrt(max(len(s[k]), 1))
    return out


def fit(samples: list[tuple[str, list[np.ndarray]]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on (language, gram sets), in a fixed order."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return Model([], np.full((len(ORDERS), 1 << BITS), -1, np.int32), np.zeros((0, 0), np.float32), np.zeros(0))
    chosen: list[int] = []
    for lang in languages:
        chosen += [i for i, (name, _) in enumerate(samples) if name == lang][:landmarks]
    marks, sets = [samples[i][1] for i in chosen], [s for _, s in samples]
    row_of = np.full((len(ORDERS), 1 << BITS), -1, np.int32)
    base, parts = 0, []
    kernel = np.zeros((len(sets), len(marks)))
    for k in range(len(ORDERS)):
        vocabulary = np.unique(np.concatenate([m[k] for m in marks]))
        local = np.full(1 << BITS, -1, np.int32)
        local[vocabulary] = np.arange(len(vocabulary))
        row_of[k][vocabulary] = base + np.arange(len(vocabulary))
        base += len(vocabulary)
        z = _presence(marks, k, local, len(vocabulary))
        parts.append(z)
        for a in range(0, len(sets), 128):
            kernel[a : a + 128] += _presence(sets[a : a + 128], k, local, len(vocabulary)) @ z.T / len(ORDERS)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ whiten
    target = np.array([[1.0 if name == lang else -1.0 for lang in languages] for name, _ in samples])
    center, bias = phi.mean(axis=0), target.mean(axis=0)
    x = phi - center
    # each language counts the same, however many rows it has
    share = np.array([1 / sum(name == other for other, _ in samples) for name, _ in samples])[:, None]
    solved = np.linalg.solve((x * share).T @ x + ridge * np.eye(x.shape[1]) / x.shape[1], (x * share).T @ (target - bias))
    to_landmarks = whiten @ solved
    weights = np.concatenate([z.T @ to_landmarks for z in parts]).astype(np.float32)
    return Model(languages, row_of, weights, bias - center @ solved)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` rows of each language, by a hash of the id: thinned
    first by the language's count, so that no language is sorted whole."""
    # one number per language, ``LANGUAGES`` at most; the texts themselves are not shuffled before they are thinned
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    share = counts.select(F.col("lang"), F.least(F.lit(1.0), 2.0 * per_language / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    thin = labelled.join(F.broadcast(share), "lang").where(draw < F.col("share"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id")
    return thin.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("lang", "doc_id", "text")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Fit on ``(doc_id, text, lang)``: grams are taken on the executors, the driver gets
    ``per_language`` rows of gram slots for each language."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets, letters = gram_sets(part.column("text").fill_null("").to_pylist())
            cols = [part.column("lang"), part.column("doc_id"), pa.array(letters, pa.int64())]
            cols.append(pa.array([np.concatenate([x + (k << BITS) for k, x in enumerate(s)]).astype(np.int32).tobytes() for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "doc_id", "letters", "grams"])

    rows = _sample(labelled, per_language).mapInArrow(grams, "lang string, doc_id long, letters long, grams binary").where("letters > 0").collect()
    samples = []
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        flat = np.frombuffer(r["grams"], np.int32).astype(np.int64)
        samples.append((r["lang"], [flat[flat >> BITS == k] & ((1 << BITS) - 1) for k in range(len(ORDERS))]))
    return fit(samples, landmarks)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned; else the language
    with the highest regression value, ties to the first name; the score maps -1..1 to 0..1.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_language(rows, model).select("doc_id", "lang_pred", "score")


def with_language(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``rows`` with ``lang_pred`` and ``score`` beside all their columns (columns of these names are
    replaced), so that no join brings them back."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c not in ("lang_pred", "score")]
    rows = rows.select(*(F.col(f"`{c}`") for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in slices(batches, text_col):
            sets, letters = gram_sets(part.column(text_col).fill_null("").to_pylist())
            if m.languages:
                value = m.scores(sets)
                best = value.argmax(axis=1)
                known = letters > 0
                names = [m.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip((value.max(axis=1) + 1) / 2, 0, 1), 0.0)
            else:
                names, score = [UNDETERMINED] * len(sets), np.zeros(len(sets))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the labelled rows that are not held out; rows without id, text or label teach nothing."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return train(rows.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull()))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the labelled rows that are not held out and predict every row:
    ``doc_id, held_out, lang_pred, score``. Texts are read whole, however long. Repeated rows and
    ids are predicted each; a null id is not held out and teaches nothing. Other columns are not read. An
    empty table gives an empty result."""
    found = predict(docs, learned(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
