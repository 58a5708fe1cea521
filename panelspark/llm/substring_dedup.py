"""Substring dedup: remove every word that lies in a long word sequence which also starts elsewhere.

Method: suffix automata of reference shards, streamed for matching statistics. The reference is the corpus
itself, so its shards cannot all be broadcast to all documents: that work would grow with the square of the
corpus. Instead the text is cut at content-defined anchors (see ``repeats``) and each piece is sent to the one
shard that can hold its matches, named by its anchor's hash. A shard builds the automaton of its distinct
pieces, each state with the number of its occurrences, and streams every piece through it: the matching
statistic of a word is the longest sequence that ends there and occurs twice. Spans where it reaches the
threshold are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import buckets, keyed, sliced, tidied
from panelspark.llm.repeats import bucket_of, covered, repeated_windows, with_hits, word_hashes

#: Pieces in one automaton. A larger group has several, and every piece is streamed through all of them. Words of pieces
#: in a shard, about.
SHARD, SHARD_WORDS = 20_000, 1 << 20


class SuffixAutomaton:
    """Of several sequences, each with a weight; ``count`` is the weighted number of occurrences of a state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.next[q].copy(), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], weight: int) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
            else:
                new = self._state(length[last] + 1, {}, 0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = new
            count[last] += weight

    def finish(self) -> None:
        """Occurrences of a state are also occurrences of its suffixes."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def matches(self, sequence: list[int], least: int, times: int) -> list[bool]:
        """For each window of ``least`` items, whether it occurs so many times: the matching statistic at its
        end, cut off at the window's length, so that one state follows the stream."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        out, v, have = [], 0, 0
        for c in sequence:
            while v and c not in nxt[v]:
                v = link[v]
                have = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                have += 1
                if have > least:
                    have = least
                while length[link[v]] >= have and v:
                    v = link[v]
            else:
                have = 0
            out.append(have == least and count[v] >= times)
        return out[least - 1 :]


def shard_masks(pieces: list[tuple[list[int], int]], window: int, shard: int = SHARD) -> list[list[bool]]:
    """For each distinct piece (sequence, weight) of one group, which of its windows occur twice in the group."""
    parts = [pieces[k : k + shard] for k in range(0, len(pieces), shard)]
    found: list[list[bool]] = [[False] * max(0, len(s) - window + 1) for s, _ in pieces]
    for k, part in enumerate(parts):
        machine = SuffixAutomaton()
        for s, weight in part:
            machine.add(s, weight)
        machine.finish()
        for i, (s, _) in enumerate(pieces):
            own = i // shard == k
            for j, hit in enumerate(machine.matches(s, window, 2 if own else 1)):
                if hit:
                    found[i][j] = True
    return found


_PIECES = "bucket int, gram long, cls long, multi boolean, words binary"


def _pieces(window: int, n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text, anchors in zip(batch.column("_text"), batch.column("anchors").to_pylist()):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                _, _, values, _ = word_hashes(data, np.array([0, len(data)]))
                rows += [(a["gram"], a["cls"], a["multi"], values[a["first"] : a["last"] + window].tobytes()) for a in anchors]
            if rows:
                gram, cls, multi, words = zip(*rows)
                g = np.array(gram, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket_of(g.view(np.uint64), n_buckets)), pa.array(g), pa.array(cls, pa.int64()), pa.array(multi), pa.array(words, pa.binary())], ["bucket", "gram", "cls", "multi", "words"])

    return run


def _shards(window: int, gram: int) -> Callable:
    width = window - gram + 1

    def run(table: pa.Table) -> pa.Table:
        rows = sorted({(g, c): (m, w) for g, c, m, w in zip(*(table.column(x).to_pylist() for x in ("gram", "cls", "multi", "words")))}.items())
        out, i = [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0][0] == rows[i][0][0]:
                j += 1
            pieces = [(np.frombuffer(w, "<u8").tolist(), 2 if m else 1) for _, (m, w) in rows[i:j]]
            for (key, _), hit in zip(rows[i:j], shard_masks(pieces, window)):
                if any(hit):
                    full = np.zeros(width, bool)
                    full[: len(hit)] = hit
                    out.append((*key, np.packbits(full).tobytes()))
            i = j
        gram_c, cls_c, mask = zip(*out) if out else ((), (), ())
        return pa.table({"gram": pa.array(gram_c, pa.int64()), "cls": pa.array(cls_c, pa.int64()), "mask": pa.array(mask, pa.binary())})

    return run


def _resolver(window: int, gram: int) -> Callable[[DataFrame, list[bytes], int], DataFrame]:
    def resolve(parts: DataFrame, _: list[bytes], volume: int) -> DataFrame:
        n = max(buckets(parts.sparkSession), -(-volume // SHARD_WORDS))
        return parts.mapInArrow(tidied(_pieces(window, n)), _PIECES).groupBy("bucket").applyInArrow(_shards(window, gram), "gram long, cls long, mask binary")

    return resolve


def _cut(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept, size, gone = [], [], []
            for text, hits in zip(batch.column("_text"), batch.column("hits").to_pylist()):
                words = (text.as_py() or "").encode().split()
                cover = covered(hits, len(words), window)
                size.append(len(words))
                gone.append(0 if cover is None else int(cover.sum()))
                kept.append(b" ".join(words if cover is None else compress(words, (~cover).tolist())))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], ["_id", "_th", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, n_words, n_removed, kept): each document without the words covered by a sequence of ``window``
    words that also starts anywhere else, in another document or in the same.

    Words are runs of characters other than space and U+0009 to U+000D, unchanged; kept words are joined by one
    space. Null or empty texts have no words; texts with fewer words than the window stay whole. Repeated rows
    count as different documents. Sequences are judged on the input. An empty table gives an empty result. Other columns
    are left, whatever their names.
    """
    gram = max(1, window // 3 + 1)
    rows = keyed(docs, id_col, text_col)
    hits = repeated_windows(rows, "word", window, gram, _resolver(window, gram))
    schema = T.StructType([rows.schema["_id"], T.StructField("_th", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return with_hits(rows, hits).mapInArrow(tidied(_cut(window)), schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The 35-word contract over all documents."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), 35)
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT k, unnest(range(1, len(words) - 33)) AS p, words FROM w
), h AS (
  SELECT k, p, md5_number(array_to_string(words[p:p + 34], ' ')) AS h FROM s
), r AS (
  SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1
), g AS (
  SELECT k, list(p ORDER BY p) AS starts FROM r GROUP BY k
), u AS (
  SELECT w.k, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w
), c AS (
  SELECT u.k, u.p, u.word, max(r.p) OVER (PARTITION BY u.k ORDER BY u.p) AS last FROM u LEFT JOIN r ON r.k = u.k AND r.p = u.p
), o AS (
  SELECT k, count(*) AS n_words, count(*) FILTER (WHERE last IS NOT NULL AND p < last + 35) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE last IS NULL OR p >= last + 35), '') AS kept FROM c GROUP BY k
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o ON w.k = o.k
"""
