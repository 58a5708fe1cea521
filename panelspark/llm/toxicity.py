"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

Method: a text's features are its words, its pairs of neighbouring words and its pairs with one or two words skipped,
each hashed to one of 2**BITS coordinates and counted once a text. Follow-the-regularised-leader keeps two sums a
coordinate: its own learning rate falls with the squared gradients that it has seen, and the L1 term leaves a coordinate
at exactly zero until its sum of gradients is large. What is not zero is a few thousand coordinates: two small arrays,
sent to every task, in which all whole texts are scored as arrays, with no shuffle.

Words are runs of letters, case folded for A to Z and U+00C0 to U+00DE, so that "Word!!" and "word" are one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import hashing as H
from panelspark.llm.common import groups_of, mapped, text_buffer
from panelspark.llm.repeats import word_hashes

#: Coordinates as a power of two, and the words that lie between the two of a skip-gram at most.
BITS, SKIPS = 20, 2
#: Rate, its offset and the two penalties; passes over the learning rows.
ALPHA, BETA, L1, L2, PASSES = 3.0, 1.0, 12.0, 0.1, 6
#: How much more a row of label 1, the rarer one, teaches.
RARER = 2.0
#: Labelled rows of each class that learning reads at most, and the longest text among them, in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 20_000
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Weights:
    """The coordinates that are not zero, in order, their weights, and the constant term."""

    at: np.ndarray
    value: np.ndarray
    bias: float


def folded(data: np.ndarray) -> np.ndarray:
    """Letters in lower case, all else as blanks; bytes of longer characters are letters."""
    out = _FOLD[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[after] += 0x20
    return out


def features(data: np.ndarray, bounds: np.ndarray, bits: int = BITS, skips: int = SKIPS) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of every word, pair and skip-gram of some texts, repeats included."""
    _, _, words, at = word_hashes(folded(data), bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    low = np.uint64((1 << bits) - 1)
    docs, grams = [doc], [H.mix(words) & low]
    for gap in range(1, skips + 2):
        same = doc[gap:] == doc[:-gap]
        pair = H.mix(words[:-gap] * np.uint64(2 * gap + 1) + H.mix(words[gap:]))
        docs.append(doc[gap:][same])
        grams.append(pair[same] & low)
    return np.concatenate(docs), np.concatenate(grams).astype(np.int64)


def of_each(data: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Each text's coordinates, once each."""
    doc, gram = features(data, bounds, bits)
    keys = np.unique((doc << bits) | gram)
    cuts = np.searchsorted(keys, np.arange(1, len(bounds) - 1) << bits)
    return np.split(keys & ((1 << bits) - 1), cuts)


def learn(rows: list[np.ndarray], marks: list[int], passes: int = PASSES, seed: int = 7, bits: int = BITS) -> Weights:
    """Weights after some passes over the rows, each time in another order. Without both marks the constant alone says
    the only mark; without rows it is 0."""
    none = np.zeros(0, np.int64)
    if len(set(marks)) < 2:
        return Weights(none, none.astype(np.float64), 0.0 if not marks else (4.0 if marks[0] else -4.0))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    share = sum(marks) / len(marks)
    bias, squares = float(np.log(share / (1 - share))), 0.0
    order = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - marks[i]) * (RARER if marks[i] else 1.0)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at], n[at] = zi + g - sigma * w, ni + g * g
            squares += g * g
            bias -= ALPHA / (BETA + squares**0.5) * g
    kept = np.flatnonzero(np.abs(z) > L1)
    return Weights(kept, weights(z[kept], n[kept]), bias)


def scores(w: Weights, data: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Each text's probability. A feature counts once a text; those of weight zero are dropped before they are sorted."""
    n = len(bounds) - 1
    total = np.zeros(n)
    table = np.zeros(1 << bits, bool)
    table[w.at] = True
    for i, j in groups_of(bounds):
        doc, gram = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], bits)
        live = table[gram]
        keys = np.unique((doc[live] << bits) | gram[live])
        total[i:j] = np.bincount(keys >> bits, w.value[np.searchsorted(w.at, keys & ((1 << bits) - 1))], minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(total + w.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "toxic", rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> Weights:
    """Learn from at most ``rows`` labelled documents of each label, chosen by a hash of the id among the labels that
    ``learn_from`` (over _id) selects; chosen texts of more than ``most`` bytes teach nothing.

    Both bounds are parameters of the model: they bound what is sent to find the texts and what reaches the driver.
    Scores are probabilities at the labels' shares in that sample, with label 1 counting ``RARER`` times. Null ids and labels other than 0 and 1 teach
    nothing. A repeated label is one, an id with both labels teaches both; of documents that share an id the least text
    teaches, a null text nothing. Without labels, or without documents, the score is 0.5 everywhere."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_label")).where(learn_from & F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    texts, made = [], []
    for label in (0, 1):
        chosen = marks.where(F.col("_label") == label).distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)
        whole = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text")).where(F.octet_length("_text") <= most)
        got = whole.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text")).collect()
        got.sort(key=lambda r: r["_id"])
        texts += [r["_text"].encode() for r in got]
        made += [label] * len(got)
    coordinates: list[np.ndarray] = []
    sizes = np.cumsum([0, *map(len, texts)])
    for i, j in groups_of(sizes):
        coordinates += of_each(np.frombuffer(b"".join(texts[i:j]), np.uint8), sizes[i : j + 1] - sizes[i])
    return learn(coordinates, made)


def score(docs: DataFrame, weights: Weights, text_col: str = "text", out: str = "_score") -> DataFrame:
    """All columns of docs and ``out``, the probability of label 1; it takes the place of a column of that name. A
    null text scores as an empty one, repeated rows alike, and an empty table gives none."""
    return mapped(docs, text_col, lambda texts: [pa.array(scores(weights, *text_buffer(texts)), pa.float64())], [T.StructField(out, T.DoubleType())])


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity; a fifth of the labels is held out."""
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != 0)
    out = score(docs.select(F.col("doc_id").alias("_id"), "text"), weights)
    return out.select(F.col("_id").alias("doc_id"), F.coalesce(fold == 0, F.lit(True)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
