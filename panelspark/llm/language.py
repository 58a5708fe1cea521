"""Language identification by rank-order profiles.

Method: out-of-place distance. A language's profile is the ranking of its most frequent character n-grams
over all learning texts; a document has the same kind of ranking, and the distance is the sum over the
document's n-grams of how far their ranks are apart, with a fixed penalty for n-grams that the profile lacks.
The nearest profile wins. N-grams have one to three characters and lie within words, blanks at word ends
included. Counting is a few array passes over each batch of whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import sliced

#: Characters in one array pass; n-grams in a profile and in a document's ranking.
BATCH_CHARS, RANKED = 1 << 19, 300
UNKNOWN = "und"
_BLANK, _SYMBOL_BITS = 1, 12
_symbols: np.ndarray | None = None


def symbols() -> np.ndarray:
    """The symbol of each code point up to U+FFFF, 0 for no letter: code points up to U+07FF have their own,
    the others share 2,048. Case is folded beforehand."""
    global _symbols
    if _symbols is None:
        code = np.arange(0x10000)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
        _symbols = np.where(letter, np.where(code < 0x800, code, 0x800 + (code * 40503 >> 4) % 0x800), 0).astype(np.uint64)
    return _symbols


def _to_symbols(chars: np.ndarray) -> np.ndarray:
    out = symbols()[np.minimum(chars, 0xFFFF)]
    for i in np.flatnonzero(chars > 0xFFFF):
        out[i] = 0x800 + (int(chars[i]) * 40503 >> 4) % 0x800 if chr(chars[i]).isalpha() else 0
    return out


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count), in order, of all n-grams of some texts."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in low])
    chars = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
    sym = _to_symbols(chars)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), size)
    letter = sym > 0
    keep = letter.copy()  # of blanks only the first after a word stays
    keep[1:] |= letter[:-1]
    sym, doc = np.where(letter, sym, np.uint64(_BLANK))[keep], doc[keep]
    if not len(sym):
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64)
    # every document ends in a blank, so the symbol before a document's first is a blank too
    before = np.concatenate(([np.uint64(_BLANK)], sym[:-1]))
    before2 = np.concatenate((np.full(1, _BLANK, np.uint64), before[:-1]))
    bits, blank = np.uint64(_SYMBOL_BITS), np.uint64(_BLANK)
    word = sym != blank
    two = word | (before != blank)
    three = before != blank
    top = doc << np.uint64(3 * _SYMBOL_BITS)
    pair = (before << bits) | sym
    keys = np.concatenate(((top | sym)[word], (top | pair)[two], (top | (before2 << (bits + bits)) | pair)[three]))
    keys.sort()
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    key = keys[head]
    low_bits = np.uint64((1 << (3 * _SYMBOL_BITS)) - 1)
    return key >> np.uint64(3 * _SYMBOL_BITS), key & low_bits, np.diff(np.concatenate((head, [len(keys)])))


def ranking(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, most: int = RANKED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, rank from 0) of each text's most frequent n-grams, ties to the smaller n-gram."""
    if not len(doc):
        return doc.astype(np.int64), gram, count
    big = np.uint64((1 << 40) - 1)
    order = np.argsort((doc << np.uint64(40)) | (big - count.astype(np.uint64)), kind="stable")
    d = doc[order].astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(d)) + 1))
    rank = np.arange(len(d)) - np.repeat(first, np.diff(np.concatenate((first, [len(d)]))))
    top = rank < most
    return d[top], gram[order][top], rank[top]


def _chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts for one array pass; a long text comes alone."""
    held, at, total = [], [], 0
    for i, t in enumerate(texts):
        if held and total + len(t) > BATCH_CHARS:
            yield at, held
            held, at, total = [], [], 0
        held.append(t)
        at.append(i)
        total += len(t)
    if held:
        yield at, held


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram, count), summed over what a task reads in one go."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str, gram: np.ndarray, count: np.ndarray) -> None:
        if lang in sums:
            gram, count = np.concatenate((sums[lang][0], gram)), np.concatenate((sums[lang][1], count))
        unique, where = np.unique(gram, return_inverse=True)
        sums[lang] = unique, np.bincount(where, count).astype(np.int64)

    for batch in sliced(batches, 1000):
        langs = batch.column("_lang").to_pylist()
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        for lang in set(langs):
            mine = [t for t, x in zip(texts, langs) if x == lang]
            grams, counts = [], []
            for _, part in _chunks(mine):
                _, gram, count = gram_counts(part)
                grams.append(gram)
                counts.append(count)
            add(lang, np.concatenate(grams), np.concatenate(counts))
        if sum(len(g) for g, _ in sums.values()) > 2_000_000:
            yield from _tell(sums)
            sums.clear()
    yield from _tell(sums)


def _tell(sums: dict) -> Iterator[pa.RecordBatch]:
    for lang, (gram, count) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(count)], ["lang", "gram", "n"])


def learn_profiles(texts: DataFrame, ranked: int = RANKED) -> dict[str, list[int]]:
    """Each language's n-grams, most frequent first, from all rows of (_lang, _text) with a language.

    What reaches the driver is ``ranked`` n-grams for each language, whatever the input's size."""
    counts = texts.where(F.col("_lang").isNotNull()).mapInArrow(_counter, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranked)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def distances(texts: list[str], profiles: dict[str, list[int]], ranked: int = RANKED) -> np.ndarray:
    """Mean out-of-place distance of each text to each language, as a share of the penalty; NaN without letters."""
    grams = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
    table = np.full((len(grams) + 1, len(profiles)), -1, np.int64)
    for k, p in enumerate(profiles.values()):
        table[np.searchsorted(grams, np.array(p, np.uint64)), k] = np.arange(len(p))
    out = np.full((len(texts), len(profiles)), np.nan)
    for at, part in _chunks(texts):
        doc, gram, rank = ranking(*gram_counts(part), ranked)
        if not len(doc):
            continue
        i = np.searchsorted(grams, gram)
        i[(i == len(grams)) | (grams[np.minimum(i, len(grams) - 1)] != gram)] = len(grams)
        place = table[i]
        off = np.where(place < 0, ranked, np.abs(place - rank[:, None]))
        head = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1))
        size = np.diff(np.concatenate((head, [len(doc)])))
        out[np.array(at)[doc[head]]] = np.add.reduceat(off, head, axis=0) / (size * ranked)[:, None]
    return out


def _predictor(profiles: dict[str, list[int]]) -> Callable:
    langs = list(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            far = distances([t or "" for t in batch.column("_text").to_pylist()], profiles) if langs else np.zeros((batch.num_rows, 0))
            lang, score = [], []
            for row in far:
                if not len(row) or np.isnan(row[0]):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                best = int(np.argmin(row))
                near = np.exp(-20 * (row - row[best]))
                lang.append(langs[best])
                score.append(float(1 / near.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_held"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["_id", "_held", "lang", "score"])

    return run


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_id, _held, lang, score) for every document: the nearest of the languages learned from the rows that
    ``learn`` selects, and a softmax of the distances. _held says that a row was not selected.

    A text that is null or has no letter is ``und`` with score 0, as is every text where no language was learned.
    Rows with a null language teach nothing. An empty table gives none, other columns are left. Ties go to the language first in alphabetical order. Ids may be null
    or repeat: each row is judged alone."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(learn, F.lit(False)).alias("_learn"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    profiles = learn_profiles(rows.where("_learn").select("_lang", "_text"))
    schema = T.StructType([rows.schema["_id"], T.StructField("_held", T.BooleanType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.select("_id", (~F.col("_learn")).alias("_held"), "_text").mapInArrow(_predictor(profiles), schema)


def op6_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language; a third of them is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    out = identify(docs, fold != 1)
    return out.select(F.col("_id").alias("doc_id"), F.col("_held").alias("held_out"), F.col("lang").alias("lang_pred"), "score")
