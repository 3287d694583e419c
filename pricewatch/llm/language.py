"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, every code point that is no letter becomes a space, and the 1- to 3-grams are
hashed. Term frequencies are relative to the text's n-grams, so a score is the mean over its
n-grams of idf times weight. Document frequencies are counted over all training rows. The weights
are fitted by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a bounded
sample (``sample_rows``, shared evenly by the languages, chosen by a hash of the id), most weights
end at zero. A part of the sample that takes no step calibrates one temperature.

Every row is predicted from its whole text. Null text or text without a letter: ``und``, score 0.
Rows with null language take no part in training; with no training rows everything is ``und``.
Repeated rows get equal predictions; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.common import bucket, release_memory, sliced

UNDETERMINED = "und"
GRAMS = 3
DIMENSIONS = 1 << 15
#: Mean tf-idf values are small; this brings them to the size of one.
SCALE = 50.0
#: Code points handled at once.
_BLOCK = 1 << 20

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once per process."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, 32 for all that are no letters; empty if it has none."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = _letters()[codes]
    return np.where(letters, codes, 32).astype(np.uint32) if letters.any() else np.zeros(0, dtype=np.uint32)


def gram_blocks(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams of the text, in blocks."""
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    for first in range(0, len(codes), _BLOCK):
        block = codes[first : first + _BLOCK + GRAMS - 1].astype(np.uint64) + np.uint64(1)
        own = min(_BLOCK, len(codes) - first)
        rolling = np.zeros(len(block), dtype=np.uint64)
        for n in range(1, GRAMS + 1):
            length = len(block) - n + 1
            if length <= 0:
                break
            rolling = rolling[:length] * np.uint64(0x110003) + block[n - 1 :]
            yield ((rolling[:own] * multiplier) >> shift).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
        total, sums = 0, np.zeros(len(self.languages))
        for grams in gram_blocks(codes):
            total += len(grams)
            sums += table[grams].sum(axis=0, dtype=np.float64)
        return sums * (SCALE / total) + self.bias

    def table(self) -> np.ndarray:
        return (self.idf[:, None] * self.weights).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in sliced(batches, "text"):
        for text in batch.column("text").to_pylist():
            seen = np.zeros(DIMENSIONS, dtype=bool)
            for grams in gram_blocks(letter_codes(text)):
                seen[grams] = True
            counts += seen
            docs += 1
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(counts[used], docs))], names=["feature", "docs"]
    )


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        features, values = [], []
        for text in batch.column("text").to_pylist():
            counts = np.zeros(DIMENSIONS, dtype=np.int64)
            for grams in gram_blocks(letter_codes(text)):
                counts += np.bincount(grams, minlength=DIMENSIONS)
            used = np.flatnonzero(counts)
            features.append(used.astype(np.int32))
            values.append((counts[used] * (SCALE / max(1, counts.sum()))).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("lang"), pa.array(features, pa.list_(pa.int32())),
             pa.array(values, pa.list_(pa.float32()))],
            names=["key", "lang", "features", "values"],
        )


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, dimensions: int, epochs: int = 4,
    alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal steps over the rows (features, values, class): (weights, bias)."""
    z, n = np.zeros((dimensions + 1, classes)), np.zeros((dimensions + 1, classes))

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, shrunk / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for features, values, label in rows:
            at = np.append(features, dimensions)  # the last row is the bias
            x = np.append(values, 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1
            gradient = x[:, None] * error[None, :]
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / alpha
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    fitted = weights(slice(None))
    return fitted[:-1], fitted[-1]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of least negative log likelihood, by golden-section search in the logarithm.

    Targets are smoothed by one error in the number of rows plus two, so that rows without an error
    do not drive the temperature to zero.
    """
    if not len(labels):
        return 1.0
    error = 1 / (len(labels) + 2)

    def loss(log_t: float) -> float:
        p = np.log(np.maximum(softmax(logits / np.exp(log_t)), 1e-300))
        true = p[np.arange(len(labels)), labels]
        other = (p.sum(axis=1) - true) / max(1, p.shape[1] - 1)
        return float(-((1 - error) * true + error * other).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, sample_rows: int = 3000, **penalties: float) -> Model:
    """Model of the rows (doc_id, text, lang) with a language."""
    rows = docs.where("lang is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(DIMENSIONS), np.zeros((DIMENSIONS, 0)), np.zeros(0))
    frequency = {
        r["feature"]: r["docs"]
        for r in rows.select("text").mapInArrow(_frequency_batches, "feature long, docs long")
        .groupBy("feature").agg(F.sum("docs").alias("docs")).collect()  # at most DIMENSIONS + 1 rows
    }
    total = frequency.pop(-1, 0)
    df = np.zeros(DIMENSIONS)
    df[list(frequency)] = list(frequency.values())
    idf = np.log((1 + total) / (1 + df))

    share = F.lit(None)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, min(1.0, sample_rows / len(languages) / n)).otherwise(share)
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))  # equal rows are one, whatever their number
    sample = rows.withColumn("key", key).where(F.col("key") < share * (1 << 40)).dropDuplicates(["key", "lang"])
    sample = sample.select("key", "lang", "text").mapInArrow(
        _sample_batches, "key long, lang string, features array<int>, values array<float>"
    ).toArrow().sort_by([("key", "ascending"), ("lang", "ascending")])
    place = {name: i for i, name in enumerate(languages)}
    examples = []
    for lang, features, values in zip(*(sample.column(c) for c in ("lang", "features", "values"))):
        at = np.array(features.values.to_numpy(zero_copy_only=False))
        examples.append((at, values.values.to_numpy(zero_copy_only=False) * idf[at], place[lang.as_py()]))
    fit = [e for i, e in enumerate(examples) if i % 5]
    held = examples[::5]
    weights, bias = ftrl(fit or held, len(languages), DIMENSIONS, **penalties)
    logits = np.array([x @ weights[at] + bias for at, x, _ in held]).reshape(len(held), len(languages))
    temperature = best_temperature(logits, np.array([c for _, _, c in held], dtype=int))
    return Model(languages, idf, weights, bias, temperature)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in sliced(batches, "text"):
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                codes = letter_codes(text)
                if not len(codes) or not model.languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                p = softmax(model.logits(codes, table) / model.temperature)
                names.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )
        del table
        release_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2: rows that training never sees."""
    return bucket(id_col, 4) == 2
