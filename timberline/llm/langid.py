"""Language identification: averaged hashed subword embeddings with a linear softmax.

Character n-grams of a text (across words, with all but letters as one space) are hashed into buckets;
the text is the average of their embeddings, and a linear softmax over that gives the languages.
Embeddings and weights are trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows. A calibration part of the sample sets the softmax temperature and the score below which a
prediction is rejected. Since averaging and the output layer are linear, prediction uses one small table
of bucket scores per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import filter_rows, map_arrow, texts_of

UNDETERMINED = "und"
BUCKETS = 1 << 16
DIMENSIONS = 16
SIZES = (1, 2, 3, 4)
#: Labelled rows of each language in the training sample (about; taken by hash over all labelled rows).
SAMPLE_ROWS = 600
#: Bits of the hash by which rows are chosen.
HASH_BITS = 48
#: Code points of the window that a training row gives, at a place set by its hash.
SAMPLE_CHARS = 3000
EPOCHS = 6
RATE = 0.5
#: Every CALIBRATE-th row of the sample calibrates and does not train.
CALIBRATE = 5
#: Share of rightly predicted calibration texts that rejection may lose.
LOST = 0.001
#: Code points that are hashed at once.
SLICE = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x30000)], bool)


_IS_LETTER: list[np.ndarray] = []


def normal_points(text: str) -> np.ndarray:
    """Lower-case code points with each run of other characters than letters as one space; empty if there are no letters."""
    if not _IS_LETTER:
        _IS_LETTER.append(_letters())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _IS_LETTER[0][np.minimum(points, len(_IS_LETTER[0]) - 1)]
    if not letter.any():
        return np.zeros(0, np.uint64)
    out = np.where(letter, points, 32).astype(np.uint64)
    keep = letter | np.concatenate(([True], letter[:-1]))
    return np.concatenate(([32], out[keep], [32])).astype(np.uint64)


def buckets_of(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, in slices."""
    for at in range(0, len(points), SLICE):
        part = points[at : at + SLICE + max(SIZES) - 1]
        h = np.zeros(len(part), np.uint64)
        for size in range(1, max(SIZES) + 1):
            if len(part) < size:
                break
            h = (h[: len(part) - size + 1] ^ part[size - 1 :]) * _MIX
            h ^= h >> np.uint64(29)
            if size in SIZES:
                yield ((h[:SLICE] * _MIX) >> _SHIFT).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str | None) -> np.ndarray | None:
        points = normal_points(text) if text else np.zeros(0, np.uint64)
        if not len(points) or not self.languages:
            return None
        total, n = np.zeros(len(self.languages)), 0
        for b in buckets_of(points):
            total += self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether the prediction is rejected."""
        z = self.logits(text)
        if z is None:
            return UNDETERMINED, 0.0, True
        p = _softmax(z / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    points = normal_points(text)
    if not len(points):
        return None
    found, counts = np.unique(np.concatenate(list(buckets_of(points))), return_counts=True)
    return found, (counts / counts.sum()).astype(np.float32)


def train(rows: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """Trains and calibrates on (text, language) pairs; their order matters only through the seed."""
    rows = sorted((t, lang) for t, lang in rows)
    languages = sorted({lang for _, lang in rows})
    c = len(languages)
    if not c:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = [rows[i] for i in order[::CALIBRATE]]
    learn = [rows[i] for k, i in enumerate(order) if k % CALIBRATE] or held
    samples = []
    for text, lang in learn:
        cut = int(rng.integers(0, max(1, len(text) - 20)))
        for t in (text, text[cut : cut + int(rng.integers(15, 200))]):
            if f := _features(t):
                samples.append((*f, languages.index(lang)))
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w = np.zeros((DIMENSIONS, c), np.float32)
    b = np.zeros(c, np.float32)
    # Frequent languages must not pull the bias: each language weighs the same.
    share = np.bincount([y for _, _, y in samples], minlength=c) / max(1, len(samples))
    weight = 1 / np.maximum(share * c, 1e-9)
    steps, step = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            ids, freq, y = samples[i]
            rate = RATE * (1 - step / steps) * min(weight[y], 4.0)
            step += 1
            x = freq @ e[ids]
            g = _softmax(x @ w + b)
            g[y] -= 1
            back = w @ g
            w -= rate * np.outer(x, g)
            b -= 0.1 * rate * g
            # An average spreads its gradient thinly over many embeddings; the factor keeps their pace near the weights'.
            e[ids] -= (rate * 20 * freq)[:, None] * back
    model = LanguageModel(languages, (e @ w).astype(np.float32), b.astype(np.float64))
    return _calibrated(model, held)


def _calibrated(model: LanguageModel, held: list[tuple[str, str]]) -> LanguageModel:
    """Sets the temperature of least log loss, and the threshold that loses at most LOST of the right predictions."""
    scored = [(z, model.languages.index(lang)) for text, lang in held if (z := model.logits(text)) is not None]
    if not scored:
        return model
    z, y = np.stack([s[0] for s in scored]), np.array([s[1] for s in scored])

    def loss(t: float) -> float:
        s = z / t
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
    s = z / model.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    if len(right):
        # Never above an even chance against all other languages together.
        model.threshold = float(min(right[int(LOST * len(right))] * 0.9, 0.5))
    return model


def training_sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """About SAMPLE_ROWS (window, language) pairs of each language, chosen by hash from all rows with text and language.

    At most twice as many are taken for each language together, those with the least hashes, so that many rows
    with one id and length cannot make the sample grow.
    """
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(11), F.col(id_col), F.length(text_col)).alias("h"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    # The share of each language as a bound on a hash of HASH_BITS bits: fine enough for any number of rows.
    bounds = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << HASH_BITS, -(-(SAMPLE_ROWS << HASH_BITS) // n)))))
    chosen = usable.withColumn("place", F.pmod("h", F.lit(1 << HASH_BITS))).where(F.col("place") < F.element_at(bounds, F.col("lang")))
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1)).cast("bigint")).cast("int")
    window = chosen.select("place", F.col("text").substr(start + 1, F.lit(SAMPLE_CHARS)).alias("text"), "lang")
    return [(r["text"], r["lang"]) for r in window.orderBy("place", "lang", "text").limit(2 * SAMPLE_ROWS * len(counts)).collect()]


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id, lang_pred, score, rejected), a row per input row; only the text is looked at.

    Texts that are null or have no letter are ``und`` with score 0 and rejected, as all are if nothing was
    learned. Repeated rows stay, equal texts get equal results, and other columns are dropped.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = broadcast.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in texts_of(batch, "_text"):
                for i, text in enumerate(texts, at):
                    lang, score, rejected = known.predict(text)
                    yield {"_id": ids[i], "lang_pred": lang, "score": score, "rejected": rejected}

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_arrow(narrow, rows, f"_id {kind}, lang_pred string, score double, rejected boolean", 2000).withColumnRenamed("_id", id_col)


def drop_rejected(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The documents whose prediction is not rejected, with all their columns, whatever their names.

    Null, empty and letterless texts go. Equal texts stay or go alike, repeated rows and null ids stay by their
    texts; a very long text is judged as a whole. An empty table gives an empty one.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bool]]]:
        for batch in batches:
            yield batch, [not broadcast.value.predict(t)[2] for _, texts in texts_of(batch, text_col) for t in texts]

    return filter_rows(docs, keep)


def held_out(id_col: str = "doc_id"):
    """The documents that no model learns from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
