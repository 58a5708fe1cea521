"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.75 or more.

Method: PartEnum signatures. Sets are put in size bands. In a band the shingle domain is dealt into parts by
hash; a signature is one part's content. Two sets of sizes a and b with similarity t differ in at most
(1 - t) / (1 + t) * (a + b) shingles, hence in that many parts, and there are more parts, so similar sets of one band share
all of their other signatures; a part without shingles has a signature as well. Each set keeps only as many of its rarest signatures as still leave one in common.

Not all documents need signatures: three quarters of a linked set's shingles also occur in its partner. A first pass
counts all shingles, in hash buckets and as 40 bits of their hashes, and leaves out documents of which too few occur
twice. Shingles that share these bits can only keep a document in, so no link is lost.
Equal sets are one node, and copies are never expanded into pairs. Nodes that share signatures, directly or over
others, are gathered into clusters, each set sent once, and compared there by their whole sets. A cluster beyond a
bound of work is not gathered: its signatures' nodes are first compared to one of them; then, where a signature
still has several components, its nodes are compared in blocks, which finds every link that could join two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import hashing as H
from panelspark.llm.common import buckets, drop_table, files_for, groups_of, keyed, materialize, sliced, text_buffer, tidied
from panelspark.llm.components import components
from panelspark.llm.repeats import bucket_of, same, word_hashes

#: Words in a shingle; similarity in hundredths; keys in one packed row.
WORDS, PERCENT, BLOCK = 5, 75, 400_000
#: Sizes up to which each shingle is a part of its own; parts of larger bands, as a share of the largest size.
SINGLE, PARTS = 63, 0.4
#: Comparisons of a node with a shingle that one task makes for a cluster; cells of a dense block.
WORK, CELLS = 1 << 31, 1 << 24
#: Sets that the rows of one file are about; nodes in a block of a signature whose cluster no task holds.
FILE_SETS, BLOCK_NODES = 2000, 512
_U = np.uint64


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), sorted and distinct. Fewer words than a shingle has are one shingle together."""
    _, _, v, wb = word_hashes(H.lower_ascii(data), bounds)
    docs, out = [], []
    n = np.diff(wb)
    for s in range(0, max(1, len(v)), H.BATCH):
        part = v[s : s + H.BATCH + words - 1]
        p = H.prefix_sums(part)
        at = np.arange(max(0, len(part) - words + 1))
        doc = np.searchsorted(wb, s + at, "right") - 1
        ok = s + at + words <= wb[doc + 1]
        docs.append(doc[ok])
        out.append(H.span_hashes(p, at[ok], at[ok] + words))
    short = np.flatnonzero((n > 0) & (n < words))
    for d in short:
        p = H.prefix_sums(v[wb[d] : wb[d + 1]])
        docs.append(np.array([d]))
        out.append(H.span_hashes(p, np.array([0]), np.array([n[d]])))
    doc, h = np.concatenate(docs), np.concatenate(out)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _index(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, total = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, total
            cat = lambda k, t: np.concatenate([x[k] for x in held]).astype(t).tobytes()
            h = np.concatenate([x[5] for x in held])
            ids, ths = pa.concat_arrays([x[0] for x in held]), pa.concat_arrays([x[1] for x in held])
            row = [pa.array([base + made]), pa.ListArray.from_arrays([0, len(ids)], ids), pa.ListArray.from_arrays([0, len(ids)], ths)]
            row += [pa.array([b], pa.binary()) for b in (cat(2, "<u4"), cat(3, "<u8"), cat(4, "<u8"), (h >> _U(24)).astype("<u4").tobytes(), (h >> _U(56)).astype("u1").tobytes())]
            made, held, total = made + 1, [], 0
            return pa.RecordBatch.from_arrays(row, ["blob", "ids", "ths", "n", "set1", "set2", "low", "top"])

        for batch in batches:
            data, bounds = text_buffer(batch.column("_text"))
            for i, j in groups_of(bounds):
                doc, h = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words)
                n = np.bincount(doc, minlength=j - i)
                ends = np.concatenate(([0], np.cumsum(n)))
                sums = [np.concatenate(([_U(0)], np.cumsum(x)))[ends] for x in (h, H.mix(h + _U(77)))]
                held.append((batch.column("_id").slice(i, j - i), batch.column("_th").slice(i, j - i), n, np.diff(sums[0]), np.diff(sums[1]), h))
                total += len(h) + (j - i)
                if total >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    return run


def _split(n_buckets: int, column: str) -> Callable:
    """(bucket, blob, keys, many): the distinct keys of each packed row, by hash range; many: more than once in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 8):
            for blob, data in zip(batch.column("blob").to_pylist(), batch.column(column).to_pylist()):
                keys, count = np.unique(np.frombuffer(data, "<u8"), return_counts=True)
                b = bucket_of(keys, n_buckets)
                cut = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)])) if len(b) else np.zeros(1, int)
                many = np.minimum(count, 255).astype("u1")
                rows = [(int(b[x]), blob, keys[x:y].tobytes(), many[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "blob", "keys", "many"])

    return run


def _count(table: pa.Table) -> pa.Table:
    """How often each key occurs in all packed rows, up to 255."""
    keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
    many = np.concatenate([np.frombuffer(x, "u1") for x in table.column("many").to_pylist()])
    size = [len(k) for k in keys]
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.minimum(np.bincount(where, many), 255).astype("u1")[where]
    ends = np.cumsum(size)
    return pa.table({"blob": table.column("blob"), "bucket": table.column("bucket"), "counts": pa.array([total[e - s : e].tobytes() for s, e in zip(size, ends)], pa.binary())})


def key_counts(blobs: DataFrame, column: str) -> DataFrame:
    """(blob, bucket, counts) for the distinct keys of each packed row, in order by bucket."""
    n = buckets(blobs.sparkSession)
    split = blobs.select("blob", column).mapInArrow(tidied(_split(n, column)), "bucket int, blob long, keys binary, many binary")
    return split.groupBy("bucket").applyInArrow(_count, "blob long, bucket int, counts binary")


def counts_of(row_keys: np.ndarray, counts: pa.Table) -> np.ndarray:
    """The counts of a packed row's keys, in the row's own order."""
    parts = sorted(zip(counts.column("bucket").to_pylist(), counts.column("counts").to_pylist()))
    got = np.frombuffer(b"".join(x for _, x in parts), "u1")
    return got[np.unique(row_keys, return_inverse=True)[1]] if len(row_keys) else got


def _told_apart(row: dict, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a packed row of shingles, rising: (low 32 bits, first key of each bucket and the end, how often
    each occurs in the row, which of them each shingle is)."""
    top, low = np.frombuffer(row["top"], "u1").astype(_U), np.frombuffer(row["low"], "<u4")
    keys, which, count = np.unique((top << _U(32)) | low, return_inverse=True, return_counts=True)
    return keys.astype("<u4"), np.searchsorted(bucket_of(keys << _U(24), n_buckets), np.arange(n_buckets + 1)), count, which


def _asked(n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for r in batch.to_pylist():
                low, cut, count, _ = _told_apart(r, n_buckets)
                some = np.flatnonzero(np.diff(cut)).tolist()
                spans = [(int(cut[b]), int(cut[b + 1])) for b in some]
                cols = [some, [r["blob"]] * len(some), [low[x:y].tobytes() for x, y in spans], [np.packbits(count[x:y] > 1).tobytes() for x, y in spans]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "blob", "low", "many"])

    return run


def _twice(table: pa.Table) -> pa.Table:
    """For each packed row's keys of one bucket, which occur twice in the bucket."""
    low = [np.frombuffer(x, "<u4") for x in table.column("low").to_pylist()]
    size = np.array([len(x) for x in low])
    many = np.concatenate([np.unpackbits(np.frombuffer(m, "u1"), count=n) for m, n in zip(table.column("many").to_pylist(), size.tolist())])
    keys = np.concatenate(low)
    order = np.argsort(keys, kind="stable")
    same_as_next = keys[order][1:] == keys[order][:-1]
    found = many > 0
    found[order[1:][same_as_next]] = True
    found[order[:-1][same_as_next]] = True
    ends = np.cumsum(size)
    return pa.table({"blob": table.column("blob"), "bucket": table.column("bucket"), "twice": pa.array([np.packbits(found[e - s : e]).tobytes() for s, e in zip(size, ends)], pa.binary())})


def _supported(id_type: pa.DataType, percent: int, n_buckets: int) -> Callable:
    def run(blob: pa.Table, told: pa.Table) -> pa.Table:
        bits, out = dict(zip(told.column("bucket").to_pylist(), told.column("twice").to_pylist())), []
        for r in blob.to_pylist():
            n = np.frombuffer(r["n"], "<u4").astype(np.int64)
            low, cut, _, which = _told_apart(r, n_buckets)
            twice = np.zeros(len(low), np.int64)
            for b, data in bits.items():
                twice[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(data, "u1"), count=int(cut[b + 1] - cut[b]))
            found = np.bincount(np.repeat(np.arange(len(n)), n), twice[which], minlength=len(n))
            node = np.stack((np.frombuffer(r["set1"], ">u8"), np.frombuffer(r["set2"], ">u8")), axis=1).tobytes()
            out.append(pa.table({"_id": pa.array(r["ids"], id_type), "_th": pa.array(r["ths"], pa.int64()), "n": pa.array(n), "node": pa.array([node[16 * i : 16 * i + 16] for i in range(len(n))], pa.binary()), "near": pa.array((n > 0) & (100 * found >= percent * n))}))
        return pa.concat_tables(out)

    return run


def _sets(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column("_text"))
            for i, j in groups_of(bounds):
                doc, h = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words)
                n = np.bincount(doc, minlength=j - i)
                ends = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), pa.array(n, pa.int64()), pa.array([h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["node", "n", "shingles"])

    return run


def differences(n: int, percent: int) -> int:
    """Most shingles in which a set of size n can differ from one that it is linked with."""
    return n * (100 - percent) // percent


def signatures(shingles: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """A set's signatures in its own band and, if it can be linked with a set of the next, in that one too."""
    n, out = len(shingles), []
    own = n.bit_length() - 1
    for band in (own, own + 1):
        if band > own and n * 100 < percent << band:
            break
        largest = (2 << band) - 1
        parts = int(PARTS * largest)
        mark = H.mix(np.array([band], _U) + _U(1000))
        if largest <= SINGLE or parts - differences(n, percent) < 1:
            out.append(H.mix(shingles ^ mark))
            continue
        part = ((shingles >> _U(20)) % _U(parts)).astype(np.int64)
        total = np.zeros(parts, _U)
        np.add.at(total, part, H.mix(shingles))
        # a part that both lack is equal content too, else few parts in use would be no guarantee
        out.append(H.mix((total ^ mark) + H.mix(np.arange(parts, dtype=_U) + mark)))
    return out


def _signed(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, total = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, total
            rows = [(node, n, s) for node, n, sets in held for s in sets]
            row = [[base + made], [[r[0] for r in rows]], [[r[1] for r in rows]], [[len(r[2]) for r in rows]], [np.concatenate([r[2] for r in rows]).tobytes()]]
            made, held, total = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], ["blob", "nodes", "n", "sizes", "key"])

        for batch in sliced(batches):
            for node, n, data in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "shingles"))):
                sets = signatures(np.frombuffer(data, "<u8"), percent)
                held.append((node, n, sets))
                total += sum(map(len, sets))
                if total >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    return run


def _rarest(percent: int) -> Callable:
    def run(blob: pa.Table, counts: pa.Table) -> pa.Table:
        sigs, nodes, sizes = [], [], []
        for r in blob.to_pylist():
            keys = np.frombuffer(r["key"], "<u8")
            count = counts_of(keys, counts)
            end = 0
            for node, n, size in zip(r["nodes"], r["n"], r["sizes"]):
                k, c = keys[end : end + size], count[end : end + size]
                end += size
                kept = np.lexsort((k, c))[: differences(n, percent) + 1]
                some = k[kept[c[kept] > 1]]
                sigs.append(some)
                nodes += [node] * len(some)
                sizes.append(np.full(len(some), n))
        return pa.table({"sig": pa.array(np.concatenate(sigs).view(np.int64)), "node": pa.array(nodes, pa.binary()), "n": pa.array(np.concatenate(sizes), pa.int64())})

    return run


def _linked(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(tidied(_linked(percent)), "a binary, b binary")


def cluster_roots(nodes: list[bytes], sets: list[np.ndarray], percent: int = PERCENT) -> list[bytes]:
    """The least node of each node's component, from comparing all pairs of sets by their shared shingles."""
    g = len(nodes)
    parent = list(range(g))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(g), size)
    _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[where] > 1
    owner, where = owner[shared], np.cumsum(count > 1)[where[shared]] - 1
    width = int(where.max()) + 1 if len(where) else 0
    step = min(2048, max(1, CELLS // max(1, width)))
    starts = np.searchsorted(owner, np.arange(g + 1))
    for i in range(0, g if width else 0, step):
        n = min(step, g - i)
        rows = np.zeros((n, width), np.float32)
        part = slice(starts[i], starts[i + n])
        rows[owner[part] - i, where[part]] = 1
        for j in range(0, i + 1, step):
            m = min(step, g - j)
            if j == i:
                other = rows
            else:
                other = np.zeros((m, width), np.float32)
                part = slice(starts[j], starts[j + m])
                other[owner[part] - j, where[part]] = 1
            both = (rows @ other.T).astype(np.int64)
            x, y = np.nonzero((100 + percent) * both >= percent * (size[i : i + n, None] + size[None, j : j + m]))
            for a, b in zip((x + i).tolist(), (y + j).tolist()):
                if a != b:
                    a, b = find(a), find(b)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
    return [nodes[find(k)] for k in range(g)]


def _clustered(percent: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(dict(zip(table.column("node").to_pylist(), table.column("shingles").to_pylist())).items())
        nodes = [r[0] for r in rows]
        return pa.table({"node": pa.array(nodes, pa.binary()), "root": pa.array(cluster_roots(nodes, [np.frombuffer(r[1], "<u8") for r in rows], percent), pa.binary())})

    return run


def _in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join all linked nodes of each signature's (sig, node, n, root), though not every link.

    A signature's nodes are dealt into blocks by size and hash. Linked sizes differ by a factor that puts them into the
    same or the next class of sizes, so each block meets those of its class and the next; two blocks are one task's small
    cluster. Blocks that are all one component already are left out. No pair of nodes is written but links."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.001 * 100 / percent))).alias("class")
    rows = rows.select("sig", "node", "root", size_class)
    parts = rows.groupBy("sig", "class").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("parts"))
    placed = rows.join(parts, ["sig", "class"]).select("sig", "class", "node", "root", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    blocks = parts.select("sig", "class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = blocks.select(F.col("sig").alias("sig2"), F.col("class").alias("class2"), F.col("part").alias("part2"))
    meets = (F.col("sig") == F.col("sig2")) & (((F.col("class") == F.col("class2")) & (F.col("part") <= F.col("part2"))) | (F.col("class") + 1 == F.col("class2")))
    both = blocks.join(other, meets).withColumn("task", F.xxhash64("sig", "class", "part", "class2", "part2"))
    sides = both.select("task", "sig", "class", "part").unionByName(both.select("task", "sig", F.col("class2").alias("class"), F.col("part2").alias("part"))).distinct()
    held = placed.join(sides, ["sig", "class", "part"]).select("task", "node", "root")
    open_tasks = held.groupBy("task").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("task")
    met = held.join(open_tasks, "task").select("task", "node").distinct().join(sets.select("node", "shingles"), "node")
    found = met.groupBy("task").applyInArrow(_clustered(percent), "node binary, root binary")
    return found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def _large_cluster_roots(kept: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of clusters that no task holds."""
    links = materialize(verified(first, sets, percent), "links")
    roots = materialize(components(links), "roots")
    rooted = kept.join(roots, "node", "left").select("sig", "node", "n", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("sig")
    rest = materialize(rooted.join(several, "sig"), "open")
    more = materialize(_in_blocks(rest, sets, percent).unionByName(links), "links")
    for table in (links, rest, roots):
        drop_table(table)
    return components(more)


def join_similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", work: int = WORK) -> DataFrame:
    """(_id, _th, n, component): each document, the size of its set and the least id that its links reach.

    Words are lower-cased in A-Z only. A null or empty text, or one without words, has an empty set and no link.
    Repeated rows are linked with each other. Null ids take part and give no name: a component of rows with
    null ids only has a null component. Ties cannot occur. An empty table gives an empty result. Other columns are left,
    whatever their names."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["_id"].dataType
    binary = lambda *names: [T.StructField(n, T.BinaryType()) for n in names]
    schema = T.StructType([T.StructField("blob", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("ths", T.ArrayType(T.LongType())), *binary("n", "set1", "set2", "low", "top")])
    index = materialize(rows.mapInArrow(tidied(_index(words)), schema), "shingles")
    schema = T.StructType([rows.schema["_id"], T.StructField("_th", T.LongType()), T.StructField("n", T.LongType()), *binary("node"), T.StructField("near", T.BooleanType())])
    width = buckets(spark)
    twice = index.select("blob", "low", "top").mapInArrow(tidied(_asked(width)), "bucket int, blob long, low binary, many binary").groupBy("bucket").applyInArrow(_twice, "blob long, bucket int, twice binary")
    seen = materialize(index.groupBy("blob").cogroup(twice.groupBy("blob")).applyInArrow(_supported(to_arrow_type(id_type), percent, width), schema), "documents", 8, files_for(spark, index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0], FILE_SETS))
    drop_table(index)
    near = seen.where("near")
    count = near.count()
    set_files = files_for(spark, count, FILE_SETS)
    nodes = near.groupBy("node").agg(F.min(F.struct("_id", "_th")).alias("k")).select("node", F.col("k._id").alias("_id"), F.col("k._th").alias("_th"))
    sets = materialize(rows.join(nodes, same(rows, nodes)).select("node", "_text").mapInArrow(tidied(_sets(words)), "node binary, n long, shingles binary"), "sets", files=set_files)
    signed = materialize(sets.mapInArrow(tidied(_signed(percent)), "blob long, nodes array<binary>, n array<long>, sizes array<long>, key binary"), "signatures")
    kept = signed.groupBy("blob").cogroup(key_counts(signed, "key").groupBy("blob")).applyInArrow(_rarest(percent), "sig long, node binary, n long")
    kept = materialize(kept.distinct(), "kept", 8, set_files)
    drop_table(signed)
    leader = kept.groupBy("sig").agg(F.min("node").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m")
    first = materialize(kept.join(leader, "sig").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct(), "first", files=set_files)
    clusters = components(first).withColumnRenamed("root", "cluster")
    clusters = materialize(clusters.join(sets.groupBy("node").agg(F.max("n").alias("n")), "node"), "clusters", files=set_files)
    sizes = clusters.groupBy("cluster").agg((F.count("*") * F.sum("n") > work).alias("large"))
    clusters = clusters.join(sizes, "cluster")
    all_roots = clusters.where("not large").join(sets.select("node", "shingles"), "node").groupBy("cluster").applyInArrow(_clustered(percent), "node binary, root binary")
    large = materialize(clusters.where("large").select("node"), "large", files=set_files)
    if large.head(1):
        fits = kept.join(large, "node", "left_semi")
        all_roots = all_roots.unionByName(_large_cluster_roots(fits, first.join(large.withColumnRenamed("node", "a"), "a", "left_semi"), sets, percent))
    all_roots = materialize(all_roots, "roots", 256, set_files)
    named = near.join(all_roots, "node", "left").select("_id", "_th", "n", F.coalesce("root", "node").alias("root"))
    # written first, so that the join below is of plain exchanges, which are split where one component is very large
    names = materialize(named.groupBy("root").agg(F.min("_id").alias("component")), "names", files=set_files)
    found = named.join(names, "root").select("_id", "_th", "n", "component")
    return found.unionByName(seen.where("not near").select("_id", "_th", "n", F.col("_id").alias("component")))


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    """The component of every document at five words and 0.75."""
    out = join_similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT k, md5_number(array_to_string(words[p:p + 4], ' ')) AS h FROM (SELECT k, words, unnest(range(1, greatest(2, len(words) - 3))) AS p FROM w WHERE len(words) > 0)
), n AS (
  SELECT k, count(*) AS n FROM s GROUP BY k
), e AS (
  SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.h = b.h AND a.k < b.k GROUP BY a.k, b.k
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE n.k = a.k) + (SELECT n FROM n WHERE n.k = b.k) - count(*))
), l AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT k AS a, k AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(x.doc_id) FROM r JOIN w x ON r.b = x.k WHERE r.a = w.k) AS component_id FROM w LEFT JOIN n ON w.k = n.k
"""
