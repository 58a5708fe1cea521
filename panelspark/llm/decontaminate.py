"""Benchmark decontamination: find training passages that contain a test item.

Method: BM25 inverted index of the test items with block-max WAND. Every document is read in overlapping
passages long enough that each item lies wholly in one. A passage's terms are looked up in the index; items are
walked in order by WAND, whole blocks are skipped when their maxima cannot reach the threshold, and every item
whose score reaches the given share of the score that the item has with itself is retrieved. A retrieved item
counts only if the passage holds enough of its question and of its answer, word run by word run.

The corpus is only streamed. Items up to a bound of bytes are one index that each executor has whole; beyond it they are dealt
into shards of about half that size, with the counts and lengths of all items, and the documents are streamed once for each.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import hashing as H
from panelspark.llm.common import groups_of, mapped, materialize, text_buffer
from panelspark.llm.repeats import word_hashes

#: BM25's constants; the share of an item's own score that retrieves it; words in a compared run of a question and
#: of an answer; the share of runs of each that must be found; items in a block; blocks in the first bound; bytes
#: of items that are sent to executors at a time.
K1, B, SHARE, QUESTION_RUN, ANSWER_RUN, OVERLAP, BLOCK, COARSE, MOST_BYTES = 1.2, 0.75, 0.6, 3, 2, 0.5, 4, 64, 64 << 20


def plain(data: np.ndarray) -> np.ndarray:
    """Bytes with case folded in Latin letters and with blanks for all ASCII but letters and digits."""
    low = H.lower_ascii(data)
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = low + (accented.view(np.uint8) << 5)
    kept = (low >= 128) | (low >= 97) & (low <= 122) | (low >= 48) & (low <= 57)
    return np.where(kept, low, 32).astype(np.uint8)


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(plain(data), np.array([0, len(data)]))[2]


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last line, or in one line the last sentence; alone it is both."""
    lines = [x for x in text.strip().split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    return text, text


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k consecutive words; of a shorter text, of all of it."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    out = []
    for s in range(0, len(words) - k + 1, H.BATCH):
        out.append(H.gram_hashes(H.prefix_sums(words[s : s + H.BATCH + k - 1]), k))
    return np.unique(np.concatenate(out))


@dataclass
class Whole:
    """What an index of some items has to know of all: their number, mean and greatest length, and for the terms of these
    items, in order, in how many items they are."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    counts: np.ndarray


class Index:
    """Impacts of terms in items: BM25, divided by the item's own score, so that one threshold fits all items."""

    def __init__(self, items: list[tuple[int, str]], whole: Whole | None = None):
        items = sorted((i, t) for i, t in items)
        held = [(i, _words(t), split_item(t)) for i, t in items]
        held = [x for x in held if len(x[1])]
        self.ids = [x[0] for x in held]
        sized = lambda words, k: (runs(words, k), max(1, min(k, len(words))))
        self.question = [sized(_words(x[2][0]), QUESTION_RUN) for x in held]
        self.answer = [sized(_words(x[2][1]), ANSWER_RUN) for x in held]
        self.longest = max([len(x[1]) for x in held], default=0)
        self.lengths = [len(x[1]) for x in held]
        counts = [np.unique(x[1], return_counts=True) for x in held]
        self.terms, frequency = np.unique(np.concatenate([c[0] for c in counts]), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0))
        n, mean = len(held), float(np.mean(self.lengths)) if held else 1.0
        of_all = n
        if whole is not None and held:
            of_all, mean, self.longest = whole.n, whole.mean, whole.longest
            frequency = whole.counts[np.searchsorted(whole.terms, self.terms)]
        idf = np.log(1 + (of_all - frequency + 0.5) / (frequency + 0.5))
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for d, (t, c) in enumerate(counts):
            at = np.searchsorted(self.terms, t)
            impact = idf[at] * c * (K1 + 1) / (c + K1 * (1 - B + B * self.lengths[d] / mean))
            for a, s in zip(at.tolist(), (impact / impact.sum()).tolist()):
                postings[a].append((d, s))
        self.docs = [[d for d, _ in p] for p in postings]
        self.impacts = [[s for _, s in p] for p in postings]
        self.most = np.array([max(p) for p in self.impacts])
        self.blocks = [{} for _ in postings]
        for k, (docs, impacts) in enumerate(zip(self.docs, self.impacts)):
            for d, s in zip(docs, impacts):
                b = d // BLOCK
                self.blocks[k][b] = max(self.blocks[k].get(b, 0.0), s)

        # a last row for words that are no term
        self.coarse = np.zeros((len(self.terms) + 1, max(1, min(COARSE, -(-n // BLOCK)))))
        for k, (docs, impacts) in enumerate(zip(self.docs, self.impacts)):
            for d, s in zip(docs, impacts):
                c = d * self.coarse.shape[1] // n
                self.coarse[k, c] = max(self.coarse[k, c], s)

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: every item (by place) whose summed impact over the distinct terms reaches the threshold."""
        found, low = [], threshold - 1e-9
        cursors = [[self.docs[t][0], 0, t] for t in terms]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= low:
                    pivot = k
                    break
            if pivot < 0:
                break
            d = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == d:
                pivot += 1
            block = d // BLOCK
            limit = sum(self.blocks[c[2]].get(block, 0.0) for c in cursors[: pivot + 1])
            if limit < low:  # nothing before the block's end, or before the next cursor, can reach it
                target = min((block + 1) * BLOCK, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else (block + 1) * BLOCK)
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == d:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    score += self.impacts[c[2]][c[1]]
                if score >= low:
                    found.append((d, score))
                target, moved = d + 1, cursors[: pivot + 1]
            else:
                target, moved = d, [c for c in cursors[:pivot] if c[0] < d]
            for c in moved:
                docs = self.docs[c[2]]
                c[1] = bisect_left(docs, target, c[1])
                c[0] = docs[c[1]] if c[1] < len(docs) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def check(self, item: int, words: np.ndarray) -> bool:
        """Whether a stretch of words holds enough of the item's question and of its answer."""
        for part, size in (self.question[item], self.answer[item]):
            if len(part) and np.isin(part, runs(words, size), assume_unique=True).mean() < OVERLAP:
                return False
        return True


_INDEX: dict[str, Index] = {}


def index_of(key: str, items: list[tuple[int, str]], whole: Whole | None = None) -> Index:
    """A worker's index of these items: made once, not once for each task. Only the last is held."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = Index(items, whole)
    return _INDEX[key]


def _finder(items: list[tuple[int, str]], share: float, whole: Whole | None = None) -> Callable[[pa.Array], list[pa.Array]]:
    told = hashlib.blake2b(repr(items).encode()).hexdigest()

    def passages(index: Index, v: np.ndarray, wb: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
        """(document, first word, end, terms) of the passages that some block's maxima let reach the threshold."""
        at = np.searchsorted(index.terms, v)
        at[at == len(index.terms)] = 0
        known = index.terms[at] == v
        at[~known] = len(index.terms)
        # the text is cut into hops; a passage is a hop and the next
        n = np.diff(wb)
        hops = -(-n // index.longest)
        doc = np.repeat(np.arange(len(n)), hops)
        start = wb[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(hops) - hops, hops)) * index.longest
        bound = np.add.reduceat(index.coarse[at], start, axis=0)
        paired = np.concatenate((doc[1:] == doc[:-1], [False]))
        bound[:-1][paired[:-1]] += bound[1:][paired[:-1]]
        whole = paired | (np.concatenate(([True], doc[1:] != doc[:-1])))
        for p in np.flatnonzero(whole & (bound.max(axis=1) >= share - 1e-6)):
            a = int(start[p])
            b = int(min(a + 2 * index.longest, wb[doc[p] + 1]))
            terms = np.unique(at[a:b][known[a:b]])
            if index.coarse[terms].sum(axis=0).max() >= share - 1e-6:
                yield int(doc[p]), a, b, terms.tolist()

    def find(texts: pa.Array) -> list[pa.Array]:
        index = index_of(told, items, whole)
        data, bounds = text_buffer(texts)
        found: list[dict[int, float]] = [{} for _ in range(len(texts))]
        for i, j in groups_of(bounds) if index.longest else ():
            _, _, v, wb = word_hashes(plain(data[bounds[i] : bounds[j]]), bounds[i : j + 1] - bounds[i])
            if not len(v):
                continue
            for doc, a, b, terms in passages(index, v, wb):
                for item, score in index.retrieve(terms, share):
                    if index.check(item, v[a:b]):
                        found[i + doc][item] = max(score, found[i + doc].get(item, 0.0))
        rows = [[index.ids[k] for k in sorted(f)] for f in found]
        best = [min(1.0, max(f.values())) if f else 0.0 for f in found]
        return [pa.array(rows, pa.list_(pa.int64())), pa.array(best, pa.float64())]

    return find


def find_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: tuple[str, str] = ("_items", "_best")) -> DataFrame:
    """All columns of docs, and ``out``: ids of the test items found in the document, rising, and the best share of an
    item's own score. They take the place of columns of those names.

    Null or empty texts hold no item; null or empty items, or items without id, are found nowhere. Equal items are
    all found. Repeated documents are judged each. An empty table of either kind finds nothing. Items of over ``MOST_BYTES``
    together are searched shard by shard; what is found does not depend on their number."""
    some = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    size = some.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    new = [T.StructField(out[0], T.ArrayType(T.LongType())), T.StructField(out[1], T.DoubleType())]
    if size <= MOST_BYTES:
        told = [(r["i"], r["t"]) for r in some.collect()]
        return mapped(docs, text_col, _finder(told, share), new)
    return _by_shards(docs, some, -(-2 * size // MOST_BYTES), share, text_col, new)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, term, length): each item's distinct terms, and on the first of them its number of words."""
    for batch in batches:
        for shard, text in zip(batch.column("shard").to_pylist(), batch.column("t").to_pylist()):
            words = _words(text)
            terms = np.unique(words)
            length = np.zeros(len(terms), np.int64)
            length[:1] = len(words)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), shard, np.int64)), pa.array(terms.view(np.int64)), pa.array(length)], ["shard", "term", "length"])


def _by_shards(docs: DataFrame, some: DataFrame, shards: int, share: float, text_col: str, new: list[T.StructField]) -> DataFrame:
    some = materialize(some.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards))), "items")
    terms = materialize(some.mapInArrow(_terms, "shard long, term long, length long"), "terms")
    lengths = terms.where("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")).first()
    counts = materialize(terms.groupBy("term").agg(F.count("*").alias("n")), "counts")
    items, best = (f.name for f in new)
    rest = [c for c in docs.columns if c not in (items, best)]
    found = docs.select(*rest).withColumns({items: F.array().cast("array<bigint>"), best: F.lit(0.0)})
    more = ["_shard_items", "_shard_best"]
    while set(more) & set(rest):
        more = [m + "_" for m in more]
    for shard in range(shards):
        told = [(r["i"], r["t"]) for r in some.where(F.col("shard") == shard).collect()]
        own = counts.join(terms.where(F.col("shard") == shard).select("term").distinct(), "term").toPandas()
        term = own["term"].to_numpy().view(np.uint64)
        order = np.argsort(term)
        whole = Whole(lengths["n"], float(lengths["mean"] or 1.0), lengths["longest"] or 0, term[order], own["n"].to_numpy()[order])
        here = mapped(found, text_col, _finder(told, share, whole), [T.StructField(more[0], new[0].dataType), T.StructField(more[1], new[1].dataType)])
        # written, so that the driver holds one shard
        found = materialize(here.select(*rest, F.sort_array(F.concat(items, more[0])).alias(items), F.greatest(best, more[1]).alias(best)), "found")
    return found


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The benchmark items in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.size("_items").cast("long").alias("n_items"), F.array_join(F.transform("_items", lambda x: x.cast("string")), ",").alias("items"), F.col("_best").alias("score"))
