from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from panelspark.llm import jaccard
from panelspark.llm.components import components


def by_force(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(lower).encode().split()
        sets.append(frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize(("work", "block"), [(jaccard.WORK, 512), (0, 512), (0, 2)])
def test_components_by_brute_force(documents, document_list, monkeypatch, work, block):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    got = Counter((r["_id"], r["n"], r["component"]) for r in jaccard.join_similar(documents, work=work).collect())
    assert got == by_force(document_list)


def test_blocks_join_what_a_signature_links(spark, monkeypatch):
    """Sets under one signature, of sizes at the limit and beyond, are joined as all pairs would join them."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 4)
    r = np.random.default_rng(7)
    base, sets = r.integers(0, 1 << 62, 64).astype(np.uint64), {}
    for k in range(40):
        n = int(r.integers(3, 64))
        own = np.concatenate((base[:n], r.integers(0, 1 << 62, int(r.integers(0, 6))).astype(np.uint64)))
        sets[f"{k:02d}".encode()] = np.sort(own)
    rows = spark.createDataFrame([(5, k, len(v), k) for k, v in sets.items()], "sig long, node binary, n long, root binary")
    table = spark.createDataFrame([(k, v.tobytes()) for k, v in sets.items()], "node binary, shingles binary")
    found = [(bytes(x.a), bytes(x.b)) for x in jaccard._in_blocks(rows, table, 75).collect()]
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    def joined(pairs):
        label.update({k: k for k in sets})
        for a, b in pairs:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
        return {k: find(k) for k in sets}

    linked = lambda a, b: 175 * len(np.intersect1d(a, b)) >= 75 * (len(a) + len(b))
    want = joined((a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b]))
    assert joined(found) == want and len(set(want.values())) < 30


def test_empty_table(no_documents):
    assert jaccard.join_similar(no_documents).collect() == []


def test_similar_sets_share_a_kept_signature():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 7, 8, 15, 40, 63, 64, 90, 127, 128, 200, 500):
        for _ in range(20):
            a = r.integers(0, 2**63, n).astype(np.uint64)
            most = n // 7  # so many of either side may differ
            drop, add = r.integers(0, most + 1, 2)
            b = np.concatenate((a[drop:], r.integers(0, 2**63, add).astype(np.uint64)))
            both = n - drop
            if 100 * both >= 75 * (n + len(b) - both):
                prefix = lambda x: {int(s) for sigs in jaccard.signatures(np.sort(x)) for s in np.sort(sigs)[: jaccard.differences(len(x), 75) + 1]}
                assert prefix(a) & prefix(b)


def test_sets_in_few_parts_still_share_a_signature():
    """Hashes that put all shingles into one part: what both lack is then all that is equal."""
    r = np.random.default_rng(8)
    for n in (70, 100, 127, 200, 250, 1000):
        band = n.bit_length() - 1
        parts = int(jaccard.PARTS * ((2 << band) - 1))
        low = lambda k: (np.uint64(parts) * r.integers(0, 1 << 30, k).astype(np.uint64) + np.uint64(3)) << np.uint64(20)  # noqa: B023, E731
        a = np.unique(low(n))
        b = np.unique(np.concatenate((a[: len(a) * 6 // 7], low(len(a) // 8))))
        if len(a).bit_length() != len(b).bit_length():
            continue
        prefix = lambda x: {int(s) for s in np.sort(jaccard.signatures(x)[0])[: jaccard.differences(len(x), 75) + 1]}
        assert len(np.unique((a >> np.uint64(20)) % np.uint64(parts))) == 1 and prefix(a) & prefix(b)


def test_support_is_counted_exactly():
    r = np.random.default_rng(2)
    for n_buckets in (1, 8, 300):
        rows = []
        for blob in range(4):
            h = r.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2)
            h = np.concatenate((h, h[:5] if blob == 0 else [], rows[0][1][10:20] if blob else [])).astype(np.uint64)
            rows.append((blob, h))
        packed = [{"blob": b, "low": (h >> np.uint64(24)).astype("<u4").tobytes(), "top": (h >> np.uint64(56)).astype("u1").tobytes()} for b, h in rows]
        asked = pa.Table.from_batches(list(jaccard._asked(n_buckets)(iter([pa.RecordBatch.from_pylist(packed)]))))
        told = {}
        for b in set(asked.column("bucket").to_pylist()):
            for x in jaccard._twice(asked.filter(pa.compute.equal(asked.column("bucket"), b))).to_pylist():
                told[x["blob"], x["bucket"]] = x["twice"]
        every = np.concatenate([h for _, h in rows])
        for row, (blob, h) in zip(packed, rows):
            low, cut, _, which = jaccard._told_apart(row, n_buckets)
            bits = np.concatenate([np.unpackbits(np.frombuffer(told[blob, b], "u1"), count=int(cut[b + 1] - cut[b])) for b in range(n_buckets) if cut[b + 1] > cut[b]])
            assert bits[which].tolist() == [int((every == x).sum() > 1) for x in h]


def test_components_of_a_long_path(spark):
    edges = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(60)] + [(b"x", b"x"), (b"y", b"z")]
    got = {bytes(r["node"]): bytes(r["root"]) for r in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {f"{i:03d}".encode(): b"000" for i in range(61)} | {b"y": b"y", b"z": b"y"}
