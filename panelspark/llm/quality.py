"""Quality classifier: a byte-level convolutional network in NumPy.

Method: bytes are embedded, learned filters run over overlapping chunks that cover the whole document, each
filter is max-pooled within its chunk, and the chunks' pooled values are combined (mean and maximum over the
document) into one probability. It is trained on the driver with Adam from a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import groups_of, mapped, text_buffer

#: Labelled rows of each class that training reads at most, and the longest text among them, in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 1200, 20_000
#: Bytes in a chunk and from one chunk to the next; filter width and step in bytes.
CHUNK, HOP, WIDTH, STEP = 128, 96, 16, 4
EMBED, FILTERS = 6, 32
EPOCHS, RATE, BATCH = 8, 0.01, 32
_PLACES = (CHUNK - WIDTH) // STEP + 1


def chunked(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks[n, CHUNK], document of each): overlapping chunks that cover each document, the last padded with
    zero bytes; an empty document has one chunk of padding."""
    size = np.diff(bounds)
    n = np.maximum(1, -(-np.maximum(size - CHUNK, 0) // HOP) + 1)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = (bounds[:-1][doc] + k * HOP)[:, None] + np.arange(CHUNK)
    inside = at < bounds[1:][doc][:, None]
    padded = np.concatenate((data, np.zeros(1, np.uint8)))
    return np.where(inside, padded[np.minimum(at, len(data))], 0), doc


def start_weights(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    return {"E": f(256, EMBED, scale=0.5), "W": f(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), "b": np.zeros(FILTERS, np.float32), "v": f(2 * FILTERS, scale=0.1), "c": np.zeros(1, np.float32)}


def _columns(embedded: np.ndarray) -> np.ndarray:
    """Each filter place's bytes, side by side."""
    n = len(embedded)
    view = np.lib.stride_tricks.sliding_window_view(embedded.reshape(n, -1), WIDTH * EMBED, axis=1)[:, :: STEP * EMBED]
    return view.reshape(n * _PLACES, WIDTH * EMBED)


def pooled(w: dict[str, np.ndarray], chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(maximum, place of it) of each filter in each chunk, before the rectifier, which keeps their order."""
    z = (_columns(w["E"][chunks]) @ w["W"]).reshape(len(chunks), _PLACES, FILTERS)
    place = z.argmax(axis=1)
    return np.take_along_axis(z, place[:, None], axis=1)[:, 0] + w["b"], place


def _combine(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1))
    size = np.diff(np.concatenate((head, [len(doc)])))
    return np.concatenate((np.add.reduceat(h, head, axis=0) / size[:, None], np.maximum.reduceat(h, head, axis=0)), axis=1), size


def scores(w: dict[str, np.ndarray], data: np.ndarray, bounds: np.ndarray, most: int = 2048) -> np.ndarray:
    """Each document's probability. Only one batch of chunks is in memory, whatever a document's length."""
    n = len(bounds) - 1
    total, top, count = np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros(n)
    for i, j in groups_of(bounds, most * HOP):
        step = most * HOP
        if j == i + 1 and bounds[j] - bounds[i] > step + CHUNK:  # a long document, in stretches that share chunks' overlap
            parts = [(s, min(s + step + CHUNK - HOP, bounds[j])) for s in range(bounds[i], bounds[j] - (CHUNK - HOP), step)]
        else:
            parts = None
        for a, b in parts or [(0, 0)]:
            d, e = (data[a:b], np.array([0, b - a])) if parts else (data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            chunks, doc = chunked(d, e)
            h = np.maximum(pooled(w, chunks)[0], 0)
            head = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1))
            at = i + doc[head]
            total[at] += np.add.reduceat(h, head, axis=0)
            top[at] = np.maximum(top[at], np.maximum.reduceat(h, head, axis=0))
            count[at] += np.diff(np.concatenate((head, [len(doc)])))
    x = np.concatenate((total / np.maximum(count, 1)[:, None], top), axis=1)
    return 1 / (1 + np.exp(-np.clip(x @ w["v"] + w["c"][0], -30, 30)))


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights by Adam on the logistic loss. Without both labels the network stays untrained with its bias at the only label."""
    w = start_weights(seed)
    y_all = np.array(labels, np.float32)
    if not len(y_all) or y_all.min() == y_all.max():
        w["v"][:] = 0
        w["c"][:] = 0 if not len(y_all) else (4 if y_all[0] else -4)
        return w
    r = np.random.default_rng(seed)
    share = y_all.mean()
    w["c"][0] = np.log(share / (1 - share))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    t = 0
    per_epoch = -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            part = order[s : s + BATCH]
            data = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
            bounds = np.concatenate(([0], np.cumsum([len(texts[i]) for i in part])))
            chunks, doc = chunked(data, bounds)
            raw, place = pooled(w, chunks)
            h = np.maximum(raw, 0)
            x, size = _combine(h, doc)
            p = 1 / (1 + np.exp(-np.clip(x @ w["v"] + w["c"][0], -30, 30)))
            dz = ((p - y_all[part]) / len(part)).astype(np.float32)
            dx = dz[:, None] * w["v"]
            top = x[:, FILTERS:]
            dh = (dx[:, :FILTERS] / size[:, None])[doc] + np.where(h == top[doc], dx[:, FILTERS:][doc], 0)
            dh = (dh * (raw > 0)).astype(np.float32)
            # only the pooled place of each filter has a gradient
            at = (place * STEP)[:, :, None] + np.arange(WIDTH)
            codes = chunks[np.arange(len(chunks))[:, None, None], at]
            emb = w["E"][codes].reshape(len(chunks), FILTERS, WIDTH * EMBED)
            dw = np.einsum("nf,nfk->kf", dh, emb, optimize=True)
            de_flat = (dh[:, :, None] * w["W"].T[None]).reshape(-1, EMBED)
            flat = codes.reshape(-1)
            de = np.stack([np.bincount(flat, de_flat[:, e], minlength=256) for e in range(EMBED)], axis=1).astype(np.float32)
            grad = {"E": de, "W": dw, "b": dh.sum(axis=0), "v": x.T @ dz, "c": np.array([dz.sum()])}
            t += 1
            rate = RATE * (1 - (t - 1) / (epochs * per_epoch))
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> dict[str, np.ndarray]:
    """Train on at most ``rows`` labelled documents of each label, chosen by a hash of the id among the labels that
    ``learn`` (over _id) selects; chosen texts of more than ``most`` bytes are left out.

    Both bounds are parameters of the model, not of the data it scores: they also bound what is broadcast to find
    the texts and what reaches the driver. The intercept is moved to the labels' shares among all labels given, so
    that scores are probabilities there. Null ids and labels other than 0 and 1 teach nothing. A repeated label is
    one; of documents that share an id the least text teaches. Without labels the score is 0.5 everywhere. An empty
    table of documents teaches nothing either."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")).where(learn & F.col("_label").isin(0, 1))
    share = {r["_label"]: r["n"] for r in marks.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in sorted(share):
        part = marks.where(F.col("_label") == label).distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    got = []
    if chosen is not None:
        text = F.col("text").cast("string")
        whole = docs.select(F.col("doc_id").alias("_id"), text.alias("_text")).where(F.octet_length("_text") <= most)
        got = whole.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    got.sort(key=lambda r: (r["_id"], r["_text"], r["_label"]))
    texts, marked = [r["_text"].encode() for r in got], [r["_label"] for r in got]
    w = train(texts, marked)
    ones = sum(marked)
    if 0 < ones < len(marked):
        w["c"] = w["c"] + np.float32(np.log(share[1] / share[0]) - np.log(ones / (len(marked) - ones)))
    return w


def score(docs: DataFrame, weights: dict[str, np.ndarray], text_col: str = "text", out: str = "_score") -> DataFrame:
    """All columns of docs and ``out``, the probability of label 1; it takes the place of a column of that name. A
    null text scores as an empty one, repeated rows alike, and an empty table gives none."""
    return mapped(docs, text_col, lambda texts: [pa.array(scores(weights, *text_buffer(texts)), pa.float64())], [T.StructField(out, T.DoubleType())])


def fold() -> Column:
    return F.crc32(F.col("_id").cast("string").cast("binary")) % 5


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality; a fifth of the labels is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold() != 0)
    out = score(docs.select(F.col("doc_id").alias("_id"), "text"), weights)
    return out.select(F.col("_id").alias("doc_id"), F.coalesce(fold() == 0, F.lit(True)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))
