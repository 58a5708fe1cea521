"""Exact repeats of a fixed length in a corpus of any size: the part that substring and suffix-array dedup share.

A window is ``window`` consecutive units (bytes or words) of one document. A window is repeated if the same
sequence also starts at any other place. Comparing all windows would move one key for each unit of text, so
each window is first given to its anchor, its smallest gram by hash: equal windows have equal anchors at
equal offsets, wherever they stand. An anchor and its windows make one *piece*, the text from the first of
its windows to the end of the last. The steps, each written to the shared folder:

1. ``index``: anchors of all documents as packed arrays, about one for 100 bytes.
2. ``flags``: only anchors whose gram occurs twice can have repeated windows. Grams are counted in hash
   buckets; what travels is one key per distinct gram and piece of a block, what returns is three bits. Equal
   pieces are found here too and one of each is elected, so that a text with a million copies is sent once.
3. ``pieces``: the elected pieces' content.
4. a resolver (suffix merge or automaton) decides which windows of each elected piece are repeated.
5. ``spans``: decisions go back to all occurrences of a piece and are gathered by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import hashing as H
from panelspark.llm.common import buckets, drop_table, files_for, groups_of, keyed, materialize, sliced, text_buffer, tidied

#: Anchors in one packed row.
BLOCK = 200_000
#: Anchors of the input for each file of the tables that follow.
FILE_ANCHORS = 10_000
#: Bytes of each probe from which sort ranges are chosen, probes of each block, and probes that the driver gets, about.
PROBE_BYTES, PROBES, MOST_PROBES = 48, 16, 200_000


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, hashes, bounds in words), also where a text or a word is longer than one hash table."""
    start, stop, at = H.words_of(data, bounds)
    if len(data) <= H.BATCH:
        return start, stop, H.span_hashes(H.prefix_sums(H.byte_values(data)), start, stop), at
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(stop, start[i] + H.BATCH, "right"))
        if j <= i:  # one word longer than a batch: always hashed in this way
            out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        p = H.prefix_sums(H.byte_values(data[start[i] : stop[j - 1]]))
        out[i:j] = H.span_hashes(p, start[i:j] - start[i], stop[i:j] - start[i])
        i = j
    return start, stop, out, at


def segments(values: np.ndarray, bounds: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, values, bounds): long documents in overlapping parts, so that hash tables stay small; each
    window lies in exactly one part."""
    if len(values) <= H.BATCH:
        yield 0, values, bounds
        return
    step = H.BATCH
    for s in range(0, max(1, len(values) - window + 1), step):
        part = values[s : s + step + window - 1]
        yield s, part, np.array([0, len(part)])


def _indexer(unit: str, window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, total, made
            ids = pa.concat_arrays([x[0] for x in held])
            shift, docs = 0, []
            for x in held:
                docs.append(x[2] + shift)
                shift += len(x[0])
            cols = [np.concatenate([x[k] for x in held]) for k in range(3, 8)]
            cls = cols[4]
            probe = [y for x in held for y in x[8]]
            probe = probe[:: max(1, len(probe) // PROBES)][:PROBES]
            row = [pa.array([base + made], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.ListArray.from_arrays([0, len(ids)], pa.concat_arrays([x[1] for x in held]))]
            row += [pa.array([c.astype(k).tobytes()], pa.binary()) for c, k in zip([np.concatenate(docs), *cols[:3], cols[3], cls], ["<u4", "<u4", "<u4", "<u4", "<u8", "<u8"])]
            row.append(pa.array([probe], pa.list_(pa.binary())))
            held, total, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays(row, ["blob", "ids", "ths", "doc", "at", "first", "last", "gram", "cls", "probe"])

        for batch in batches:
            data, bounds = text_buffer(batch.column("_text"))
            for i, j in groups_of(bounds):
                d, b = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                if unit == "word":
                    _, _, v, vb = word_hashes(d, b)
                else:
                    v, vb = (H.byte_values(d) if len(d) <= H.BATCH else None), b
                for off, part, pb in segments(v, vb, window) if v is not None else _byte_segments(d, window):
                    p = H.prefix_sums(part)
                    at, first, last = H.anchors(p, pb, window, gram)
                    if not len(at):
                        continue
                    doc = np.searchsorted(pb[1:], first, "right")
                    own = pb[doc] - off
                    grams, cls = H.span_hashes(p, at, at + gram), H.span_hashes(p, first, last + window)
                    probes = []
                    if unit == "byte":
                        for k in {len(at) // 3, 2 * len(at) // 3}:
                            s = off + at[k]
                            probes.append(d[s : s + PROBE_BYTES].tobytes())
                    held.append((batch.column("_id").slice(i, j - i), batch.column("_th").slice(i, j - i), doc, at - own, first - own, last - own, grams, cls, probes))
                    total += len(at)
                    if total >= BLOCK:
                        yield flush()
        if held:
            yield flush()

    return run


def _byte_segments(data: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for s in range(0, max(1, len(data) - window + 1), H.BATCH):
        part = H.byte_values(data[s : s + H.BATCH + window - 1])
        yield s, part, np.array([0, len(part)])


def _pairs(gram: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the distinct (gram, piece) pairs: (first index of each, pair of each anchor, count of each)."""
    order = np.lexsort((np.arange(len(gram)), cls, gram))
    g, c = gram[order], cls[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]))) if len(g) else np.zeros(0, bool)
    pair = np.empty(len(gram), np.int64)
    pair[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return order[heads], pair, np.diff(np.concatenate((heads, [len(g)])))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Hash range of a key, rising with it."""
    return ((keys >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int32)


def _keys(n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for r in batch.to_pylist():
                gram, cls = np.frombuffer(r["gram"], "<u8"), np.frombuffer(r["cls"], "<u8")
                head, _, count = _pairs(gram, cls)
                g, c, many = gram[head], cls[head], (count > 1).astype(np.uint8)
                b = bucket_of(g, n_buckets)
                cut = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)])) if len(b) else np.zeros(1, int)
                rows = [(int(b[x]), r["blob"], g[x:y].tobytes(), c[x:y].tobytes(), many[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "blob", "gram", "cls", "many"])

    return run


def _flags(table: pa.Table) -> pa.Table:
    """For each key of each block: 1 its gram occurs elsewhere, 2 its piece is sent from here, 4 the piece occurs elsewhere."""
    blobs = np.array(table.column("blob").to_pylist(), np.int64)
    read = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    grams, classes, many = read("gram", "<u8"), read("cls", "<u8"), read("many", "u1")
    sizes = np.array([len(x) for x in grams])
    g, c, m = np.concatenate(grams), np.concatenate(classes), np.concatenate(many)
    src = np.repeat(blobs, sizes)
    order = np.lexsort((src, c, g))
    sg, sc, w = g[order], c[order], 1 + m[order].astype(np.int64)
    new_g = np.concatenate(([True], sg[1:] != sg[:-1]))
    new_c = new_g | np.concatenate(([True], sc[1:] != sc[:-1]))
    total = lambda new: np.add.reduceat(w, np.flatnonzero(new))[np.cumsum(new) - 1]
    flag = np.where(total(new_g) > 1, 1 + 2 * new_c + 4 * (total(new_c) > 1), 0).astype(np.uint8)
    out = np.empty(len(g), np.uint8)
    out[order] = flag
    ends = np.cumsum(sizes)
    return pa.table({"blob": pa.array(blobs), "bucket": table.column("bucket"), "flags": pa.array([out[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary())})


_OCC = ["at", "first", "last", "gram", "cls", "sent", "multi"]


def _occurrences(id_type: pa.DataType) -> Callable:
    def run(blob: pa.Table, flags: pa.Table) -> pa.Table:
        out = []
        for r in blob.to_pylist():
            gram, cls = np.frombuffer(r["gram"], "<u8"), np.frombuffer(r["cls"], "<u8")
            head, pair, _ = _pairs(gram, cls)
            parts = sorted(zip(flags.column("bucket").to_pylist(), flags.column("flags").to_pylist()))
            f = np.frombuffer(b"".join(x for _, x in parts), "u1")
            mine = f[pair]
            sent = np.zeros(len(gram), bool)
            sent[head] = f & 2 > 0
            keep = np.flatnonzero(mine & 1)
            num = lambda name: np.frombuffer(r[name], "<u4")[keep].astype(np.int64)
            doc = num("doc")
            out.append(pa.table({"_id": pa.array(r["ids"], id_type).take(pa.array(doc)), "_th": pa.array(np.array(r["ths"], np.int64)[doc]), "at": num("at"), "first": num("first"), "last": num("last"), "gram": gram[keep].view(np.int64), "cls": cls[keep].view(np.int64), "sent": sent[keep], "multi": (mine[keep] & 4) > 0}))
        return pa.concat_tables(out)

    return run


def same(a: DataFrame, b: DataFrame):
    """Null-safe equality of row keys."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])


def repeated_windows(docs: DataFrame, unit: str, window: int, gram: int, resolve: Callable[[DataFrame, list[bytes], int], DataFrame]) -> DataFrame:
    """(_id, _th, hits): for each document with repeated windows, an array of (first, mask); bit k of the mask
    (most significant first) says that the window that starts at first + k is repeated.

    ``docs`` has _id, _th, _text (see ``keyed``). ``resolve`` gets the elected pieces' documents
    (_id, _th, _text, anchors), probes for sort ranges and the pieces' size in units; it returns (gram, cls, mask).
    """
    spark = docs.sparkSession
    id_type = docs.schema["_id"].dataType
    blob_schema = T.StructType([T.StructField("blob", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("ths", T.ArrayType(T.LongType())), *(T.StructField(n, T.BinaryType()) for n in ("doc", "at", "first", "last", "gram", "cls")), T.StructField("probe", T.ArrayType(T.BinaryType()))])
    index = materialize(docs.mapInArrow(tidied(_indexer(unit, window, gram)), blob_schema), "anchors")
    n = buckets(spark)
    files = files_for(spark, index.agg(F.coalesce(F.sum(F.octet_length("gram")), F.lit(0))).first()[0] // 8, FILE_ANCHORS)
    keys = index.select("blob", "gram", "cls").mapInArrow(tidied(_keys(n)), "bucket int, blob long, gram binary, cls binary, many binary")
    flags = keys.groupBy("bucket").applyInArrow(_flags, "blob long, bucket int, flags binary")
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([T.StructField("_id", id_type), T.StructField("_th", T.LongType()), *(T.StructField(x, T.BooleanType() if x in ("sent", "multi") else T.LongType()) for x in _OCC)])
    occ = materialize(index.drop("probe").groupBy("blob").cogroup(flags.groupBy("blob")).applyInArrow(_occurrences(to_arrow_type(id_type)), schema), "occurrences", 8, files)
    probes = _probes(index) if unit == "byte" else []
    volume = occ.where("sent").agg(F.coalesce(F.sum(F.col("last") - F.col("first") + window), F.lit(0))).first()[0]
    drop_table(index)
    sent = occ.where("sent").groupBy("_id", "_th").agg(F.collect_list(F.struct("at", "first", "last", "gram", "cls", "multi")).alias("anchors"))
    masks = materialize(resolve(docs.join(sent, same(docs, sent)).select(docs["_id"], docs["_th"], docs["_text"], "anchors"), probes, volume), "masks", files=files)
    hits = occ.select("_id", "_th", "first", "gram", "cls").join(masks, ["gram", "cls"])
    out = materialize(hits.groupBy("_id", "_th").agg(F.collect_list(F.struct("first", "mask")).alias("hits")), "spans", files=files)
    drop_table(occ)
    drop_table(masks)
    return out


def _probes(index: DataFrame) -> list[bytes]:
    """Beginnings of suffixes from all packed rows, or from a hash sample of the rows where there are too many for the
    driver. They choose the bounds of sort ranges and nothing else."""
    share = MOST_PROBES / (PROBES * max(1, index.count()))
    some = index if share >= 1 else index.where(F.pmod(F.xxhash64("blob"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return [bytes(r[0]) for r in some.select(F.explode("probe")).collect()]


def covered(hits: list[dict] | None, n: int, window: int) -> np.ndarray | None:
    """Which of a document's n units lie in a repeated window; None if there is none."""
    if not hits:
        return None
    first = np.array([h["first"] for h in hits], np.int64)
    width = len(hits[0]["mask"])
    bits = np.unpackbits(np.frombuffer(b"".join(h["mask"] for h in hits), np.uint8).reshape(len(hits), width), axis=1)
    row, k = np.nonzero(bits)
    step = np.zeros(n + 1, np.int32)
    start = np.unique(first[row] + k)
    step[start] = 1
    seen = np.cumsum(step)
    seen[window:] -= np.concatenate(([0], np.cumsum(step)))[1 : n + 2 - window]
    return seen[:n] > 0


def with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    return docs.join(hits, same(docs, hits), "left").select(*(docs[c] for c in docs.columns), "hits")

