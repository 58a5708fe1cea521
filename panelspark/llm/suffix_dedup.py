"""Suffix-array dedup: remove every byte that lies in a long string which also starts elsewhere.

Method: common-prefix-aware distributed merge sort. The suffixes that are sorted are those at anchors (see
``repeats``), which is enough to see every repeat of the wanted length. Each task sorts its suffixes into a
run, cuts it at the sort ranges and sends it front-coded: common prefix length with the suffix before, then
the rest. A task for each range merges the runs with a loser tree that keeps every loser's common prefix
with the winner, so that no byte is compared twice. The merged order with its common prefix lengths is a
(sparse) suffix array with its LCP array. A window that starts o bytes before its anchor is repeated if
another suffix in the same LCP interval of depth window - o has the same o bytes to its left, which an equal
sort of the reversed left contexts tells.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import buckets, keyed, sliced, tidied
from panelspark.llm.repeats import covered, repeated_windows, with_hits

#: Bytes of suffixes that a task sorts at once; beyond it, it starts another run.
RUN_BYTES = 48 << 20
#: Bytes of pieces in a sort range, about.
RANGE_BYTES = 8 << 20
_ARRAYS = {"lcp": "<u4", "tail": "<u4", "left": "<u4", "gram": "<i8", "cls": "<i8", "multi": "u1", "low": "<u4", "n": "<u4"}
_RUN = "range int, run long, " + ", ".join(f"{x} binary" for x in (*_ARRAYS, "tails", "lefts"))


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of a and b, known to be start at least."""
    n = min(len(a), len(b))
    while start < n:
        stop = min(n, start + 64)
        x, y = a[start:stop], b[start:stop]
        if x != y:
            diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return start + (8 * (stop - start) - diff.bit_length()) // 8
        start = stop
    return n


class LoserTree:
    """Merge of sorted runs of (lcp with the item before in the run, string, payload), yielding the same of the whole.

    ``known[k]`` is the common prefix length of run k's item with the last winner. Of two items the one with
    the longer known prefix is the smaller; only if both are equal are bytes compared, from there on."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.runs = runs
        self.item: list = [None] * self.size
        self.known = [-1] * self.size
        for k, run in enumerate(runs):
            self._next(k, run, first=True)
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _next(self, k: int, run: Iterator, first: bool = False) -> None:
        got = next(run, None)
        if got is None:
            self.item[k], self.known[k] = None, -1
        else:
            self.item[k], self.known[k] = got, 0 if first else got[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows its common prefix with the winner."""
        ka, kb = self.known[a], self.known[b]
        if ka > kb:
            return a, b
        if kb > ka:
            return b, a
        if ka < 0:
            return a, b
        x, y = self.item[a][1], self.item[b][1]
        h = common_prefix(x, y, ka)
        if h == len(x) and (h < len(y) or a <= b) or h < len(x) and h < len(y) and x[h] < y[h]:
            self.known[b] = h
            return a, b
        self.known[a] = h
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        w, self.loser[node] = self._play(a, b)
        return w

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.item[self.winner] is not None:
            k = self.winner
            got = self.item[k]
            yield self.known[k], got[1], got[2]
            self._next(k, self.runs[k])
            node, w = (k + self.size) >> 1, k
            while node:
                w, self.loser[node] = self._play(w, self.loser[node])
                node >>= 1
            self.winner = w


def front_code(items: list[tuple]) -> list[bytes]:
    """Columns of a sorted run of (suffix, left, gram, cls, multi, low, n)."""
    lcp, tails, before = [], [], b""
    for x in items:
        h = common_prefix(before, x[0])
        lcp.append(h)
        tails.append(x[0][h:])
        before = x[0]
    cols = [lcp, [len(t) for t in tails], [len(x[1]) for x in items], *([x[k] for x in items] for k in range(2, 7))]
    return [*(np.array(c, kind).tobytes() for c, kind in zip(cols, _ARRAYS.values())), b"".join(tails), b"".join(x[1] for x in items)]


def decode(row: dict) -> Iterator[tuple[int, bytes, tuple]]:
    a = {k: np.frombuffer(row[k], kind).tolist() for k, kind in _ARRAYS.items()}
    before, t, left, tails, lefts = b"", 0, 0, row["tails"], row["lefts"]
    for h, tail, m, *rest in zip(*a.values()):
        before = before[:h] + tails[t : t + tail]
        yield h, before, (lefts[left : left + m], *rest)
        t += tail
        left += m


def _runs(window: int, cuts: list[bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, items, held = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, items, held
            items.sort(key=lambda x: x[0])
            marks = [bisect_right(cuts, x[0]) for x in items]
            rows, i = [], 0
            while i < len(items):
                j = bisect_right(marks, marks[i], i)
                rows.append([marks[i], base + made, *front_code(items[i:j])])
                i = j
            made, items, held = made + 1, [], 0
            types = [pa.int32(), pa.int64(), *[pa.binary()] * (len(_ARRAYS) + 2)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["range", "run", *_ARRAYS, "tails", "lefts"])

        for batch in sliced(batches):
            for text, anchors in zip(batch.column("_text"), batch.column("anchors").to_pylist()):
                data = text.as_buffer()
                for a in anchors:
                    at, first, last = a["at"], a["first"], a["last"]
                    items.append((data[at : last + window].to_pybytes(), data[first:at].to_pybytes()[::-1], a["gram"], a["cls"], a["multi"], at - last, last - first + 1))
                    held += last + window - first + 200
                if held > RUN_BYTES:
                    yield flush()
        if items:
            yield flush()

    return run


def lcp_windows(merged: Iterator[tuple[int, bytes, tuple]], window: int, gram: int) -> tuple[list, np.ndarray]:
    """([(gram, cls)], repeated[piece, window of the piece]) from suffixes in merged order."""
    lcp, left, keys, weight, low, count = [], [], [], [], [], []
    seen: set = set()
    owed = 1 << 62  # the lcp with the suffix before that was kept
    for h, _, (l, g, c, multi, lo, n) in merged:
        owed = min(owed, h)
        if (g, c) in seen:
            continue
        if not lcp or owed < gram:
            seen.clear()
        seen.add((g, c))
        lcp.append(owed if lcp else 0)
        owed = 1 << 62
        left.append(l)
        keys.append((g, c))
        weight.append(2 if multi else 1)
        low.append(lo)
        count.append(n)
    total = len(keys)
    width = window - gram + 1
    hit = np.zeros((total, width), bool)
    if not total:
        return keys, hit
    lcp_a, weight_a, low_a, count_a = np.array(lcp), np.array(weight), np.array(low), np.array(count)
    group = np.cumsum(lcp_a < gram)
    order = sorted(range(total), key=lambda i: (group[i], left[i]))
    left_lcp = np.zeros(total, np.int64)
    for r in range(1, total):
        a, b = order[r - 1], order[r]
        left_lcp[r] = common_prefix(left[a], left[b]) if group[a] == group[b] else -1
    left_lcp[0] = -1
    order_a = np.array(order)
    high_a = low_a + count_a - 1
    for o in range(int(low_a.min()), int(high_a.max()) + 1):
        part = np.flatnonzero((low_a <= o) & (o <= high_a))
        if not len(part):
            continue
        block = np.cumsum(lcp_a < window - o)
        side = np.empty(total, np.int64)
        side[order_a] = np.cumsum(left_lcp < o)
        _, inverse = np.unique(block[part] * (total + 1) + side[part], return_inverse=True)
        some = np.bincount(inverse, weight_a[part])[inverse] > 1
        found = part[some]
        hit[found, high_a[found] - o] = True  # the window that starts at first + k has o = high - k
    return keys, hit


def _merge(window: int, gram: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["run"])
        keys, hit = lcp_windows(iter(LoserTree([decode(r) for r in rows])), window, gram)
        some = np.flatnonzero(hit.any(axis=1))
        masks = np.packbits(hit[some], axis=1)
        return pa.table({"gram": pa.array([keys[i][0] for i in some], pa.int64()), "cls": pa.array([keys[i][1] for i in some], pa.int64()), "mask": pa.array([m.tobytes() for m in masks], pa.binary())})

    return run


def _resolver(window: int, gram: int) -> Callable[[DataFrame, list[bytes], int], DataFrame]:
    def resolve(parts: DataFrame, probes: list[bytes], volume: int) -> DataFrame:
        n = max(buckets(parts.sparkSession, 2), -(-volume // RANGE_BYTES))
        probes = sorted(set(probes))  # a text with many copies has one say
        cuts = sorted({probes[len(probes) * k // n] for k in range(1, n)}) if probes else []
        return parts.mapInArrow(tidied(_runs(window, cuts)), _RUN).groupBy("range").applyInArrow(_merge(window, gram), "gram long, cls long, mask binary")

    return resolve


def _cut(window: int, columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept, size, gone, spans = [], [], [], []
            for text, hits in zip(batch.column("_text"), batch.column("hits").to_pylist()):
                buf = text.as_buffer()
                data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
                cover = covered(hits, len(data), window)
                size.append(len(data))
                if cover is None:
                    kept.append(data.tobytes())
                    gone.append(0)
                    spans.append([])
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], cover.view(np.int8), [0]))))
                kept.append(data[~cover].tobytes())
                gone.append(int(cover.sum()))
                spans.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[0::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], [*columns, "n_bytes", "n_removed", "spans", "kept"])

    return run


def dedup_suffixes(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> DataFrame:
    """(_id, _th, n_bytes, n_removed, spans, kept), and _rest if wanted (see ``keyed``): each document without the bytes covered by a string of
    ``window`` bytes that also starts anywhere else, in another document or in the same.

    Null or empty texts have no bytes and stay empty; texts shorter than the window stay whole. Repeated
    rows count as different documents, so each loses what the other has too. Overlapping repeats count, and
    strings are judged on the input. An empty table gives an empty result. ``kept`` is binary, as a cut may fall inside a
    character. Other columns are left, or stand in ``_rest``, so that their names do not matter.
    """
    gram = max(1, window // 3)
    rows = keyed(docs, id_col, text_col, rest)
    hits = repeated_windows(rows.select("_id", "_th", "_text"), "byte", window, gram, _resolver(window, gram))
    own = [c for c in rows.columns if c != "_text"]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    schema = T.StructType([*(rows.schema[c] for c in own), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    return with_hits(rows, hits).mapInArrow(tidied(_cut(window, own)), schema)


def text_of(kept: str):
    """The kept bytes as text; what is left of a character that was cut apart is dropped."""

    @F.pandas_udf(T.StringType())
    def decode(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return decode(F.col(kept))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The 400-byte contract over all documents."""
    out = dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 400)
    return out.select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(lower(hex(encode(text))), '') AS x FROM documents
), h AS (
  SELECT k, p, md5_number(substr(x, 2 * p + 1, 800)) AS h FROM (SELECT k, x, unnest(range(0, length(x) // 2 - 399)) AS p FROM w)
), r AS (
  SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1
), i AS (
  SELECT k, p, lag(p) OVER (PARTITION BY k ORDER BY p) AS before FROM r
), j AS (
  SELECT k, p, sum(CASE WHEN before IS NULL OR p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) AS run FROM i
), v AS (
  SELECT k, run, min(p) AS a, max(p) + 400 AS b FROM j GROUP BY k, run
), y AS (
  SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS e FROM v
), z AS (
  SELECT w.k, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM y JOIN w ON y.k = w.k GROUP BY w.k
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM w LEFT JOIN z ON w.k = z.k
"""
