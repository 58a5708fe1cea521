"""The prefix trie, closed itemsets and toxicity against slow versions, on odd tables."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from panelspark.llm import itemsets, prefix_trie, toxicity

SMALL = "/root/testdata/sf0.001"


# prefix trie


def slow_trie(conversations):
    """{(depth, conv_id): (parent, n_convs, n_children, n_leaves, saved, ends)} of {conv: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    words = lambda path: len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0

    def rolled(path):
        below = [rolled(k) for k in kids[path]]
        return sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[path]) - 1) * words(path)

    out = {}
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(conversations[c]) == len(path)))
        out[len(path), min(cs)] = (min(members[path[:-1]]) if path else None, len(cs), len(kids[path]), *rolled(path), ends)
    return out


def slow_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own[c].append((turn is not None, turn or 0, key, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def conversation_rows():
    r = random.Random(4)
    rows = []
    for c in [*range(0, 70), 1003, 1007, -5, -21]:
        for t in range(r.randrange(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "d  e\tf", "é"])))
    for c in range(200, 260):  # copies
        rows += [(c, t, "user", f"copy {t}") for t in range(4)]
    rows += [(300, t, "user", "long") for t in range(500)]  # an endless one
    rows += [(41, None, "user", "null first"), (41, None, "user", "null first"), (41, 0, "user", "tie"), (None, 1, "user", "lost"), (None, None, None, None)]
    return [(*x, "clash", 7, 8) for x in rows]


TURNS = "conv_id long, turn long, role string, text string, key string, conv int, words int"


def test_trie_against_slow_version(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 40)
    rows = conversation_rows()
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, TURNS).repartition(5).write.parquet(f"{folder}/conversations.parquet")
    got = {(r["depth"], r["conv_id"]): tuple(r)[2:] for r in prefix_trie.op11_prefix_trie(spark, folder).select("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}
    want = {k: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for k, v in slow_trie(slow_rebuilt(rows)).items()}
    assert got == want


def test_trie_of_few(spark):
    turns = spark.createDataFrame([], TURNS)
    trie = prefix_trie.build(*prefix_trie.rebuilt(turns))
    assert trie.nodes.collect() == [] and prefix_trie.end_digests(trie.ends).collect() == []
    one = spark.createDataFrame([(4, 1, "user", "x y", "", 0, 0)], TURNS)
    assert len(prefix_trie.build(*prefix_trie.rebuilt(one)).nodes.collect()) in (1, 2)
    own = prefix_trie.ordered(one)
    both = prefix_trie.build(own, spark.createDataFrame([(4,), (9,)], "conv long"))
    assert sorted(tuple(r) for r in both.nodes.select("depth", "conv_id", "n_convs", "n_children", "n_leaves").collect()) == [(0, 4, 2, 1, 1), (1, 4, 1, 0, 1)]
    assert sorted(tuple(r) for r in both.ends.select("depth", "conv_id", "conv").collect()) == [(0, 4, 9), (1, 4, 4)]


# itemsets


def slow_itemsets(lines, least=2, share=5000, confidence=10):
    held = defaultdict(set)
    for sale, item in lines:
        if sale is not None and item is not None:
            held[sale].add(item)
    total = len(held)
    count = Counter()
    for basket in held.values():
        for n in range(1, len(basket) + 1):
            count.update(combinations(sorted(basket), n))
    live = {x: n for x, n in count.items() if n >= least and n * share >= total}
    out = {}
    for x, n in live.items():
        if any(len(y) == len(x) + 1 and m == n and set(x) < set(y) for y, m in live.items()):
            continue
        rules = [(c, live[tuple(i for i in x if i != c)], live[(c,)]) for c in x if len(x) > 1]
        out[x] = n, [(c, a, s) for c, a, s in rules if 100 * n >= confidence * a and n * total > a * s]
    return out


def sale_rows():
    r = random.Random(6)
    rows = [(s, i) for s in range(60) for i in r.sample(range(9), r.randrange(1, 5)) if r.random() < 0.9]
    rows += [(s, i) for s in range(100, 130) for i in (20, 21, 22, 5)]  # equal supports
    rows += [(500, i) for i in range(12)] + [(0, 3), (0, 3), (None, 4), (7, None), (None, None)]
    return rows


@pytest.mark.parametrize("work", [4_000_000, 40, 1])
@pytest.mark.parametrize("always", [False, True])
def test_itemsets_against_all_subsets(spark, monkeypatch, work, always):
    """Small, heavy and doubly heavy databases; an item of every basket."""
    monkeypatch.setattr(itemsets, "WORK", work)
    lines = sale_rows()
    if always:
        lines += [(s, 99) for s in {s for s, i in lines if s is not None and i is not None}]
    df = spark.createDataFrame([(*x, 1, "x") for x in lines], "sale_id long, item_id long, rank int, items string").repartition(3)
    rows, items, total, needed = itemsets.baskets(df, "sale_id", "item_id", 2, 5000)
    found = itemsets.with_rules(rows, items, itemsets.closed_itemsets(rows, items, total, needed), total, 10).collect()
    assert len(found) == len({tuple(r["ids"]) for r in found})
    assert {tuple(r["ids"]): (r["support"], [tuple(x) for x in r["rules"]]) for r in found} == slow_itemsets(lines)


def test_itemsets_of_nothing(spark):
    for lines in ([], [(1, None)], [(1, 2), (2, 3)]):
        rows, items, total, needed = itemsets.baskets(spark.createDataFrame(lines, "sale_id long, item_id long"), "sale_id", "item_id", 8, 5000)
        assert itemsets.with_rules(rows, items, itemsets.closed_itemsets(rows, items, total, needed), total, 10).collect() == []


def test_counting_in_slices(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "WORK", 7)
    r = random.Random(2)
    sets = [sorted(r.sample(range(8), r.randrange(1, 6))) for _ in range(200)]
    rows = spark.createDataFrame([(s, r.randrange(1, 9)) for s in sets], "items array<int>, weight long")
    asked = [list(x) for n in (1, 2, 3) for x in combinations(range(8), n)]
    got = itemsets.supports(rows, spark.createDataFrame([(a,) for a in asked], "items array<int>"), spark.createDataFrame([(i,) for i in range(8)], "rank int")).collect()
    data = [tuple(x) for x in rows.collect()]
    assert {tuple(g["items"]): g["support"] for g in got} == {tuple(a): sum(w for s, w in data if set(a) <= set(s)) for a in asked}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 7), min_size=1), min_size=1, max_size=20))
def test_closed_sets_are_found_once(sets):
    items = np.array([i for s in sets for i in sorted(s)], np.int32)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found = []
    every = set.intersection(*sets)
    for f in sorted(set().union(*sets) - every):
        inside = np.isin(rows, rows[items == f])
        found += [tuple(x) for x, _ in itemsets.closed_sets(np.ones(len(sets), np.int64), items[inside], rows[inside], frozenset(every), f, 1)]
    want = {tuple(sorted(set.intersection(*part))) for n in range(1, len(sets) + 1) for part in combinations(sets, n)} if len(sets) < 9 else {tuple(sorted(x)) for x in _closures(sets)}
    assert sorted(found) == sorted(w for w in want if set(w) != every)


def _closures(sets):
    known = {frozenset(s) for s in sets}
    while True:
        more = known | {a & b for a in known for b in known}
        if more == known:
            return known
        known = more


# toxicity


def slow_features(text, bits, skips):
    data = text.encode()
    fold = {c: c + 32 for c in range(65, 91)}
    words, word = [], b""
    for i, c in enumerate(data):
        c = fold.get(c, c)
        if c >= 128 and i and data[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97:
            c += 32
        if c >= 128 or 97 <= c <= 122:
            word += bytes([c])
        elif word:
            words.append(word)
            word = b""
    words += [word] if word else []
    return [("1", w) for w in words] + [(g, words[i], words[i + g]) for g in range(1, skips + 2) for i in range(len(words) - g)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("aB é'ÉßA0_.!中\t\n", max_size=30), min_size=1, max_size=4))
def test_features_are_words_and_pairs(texts):
    raw = [t.encode() for t in texts]
    doc, gram = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    names = [[*slow_features(t, 20, 2)] for t in texts]
    assert [int((doc == d).sum()) for d in range(len(texts))] == [len(n) for n in names]
    seen = {}
    for d, n in enumerate(names):
        got = Counter(gram[doc == d].tolist())
        assert sum(got.values()) == len(n) and len(got) <= len(set(n))
        for name in n:
            seen.setdefault(name, None)
    alone = lambda t: set(toxicity.of_each(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist())
    for d, t in enumerate(texts):
        assert alone(t) == set(gram[doc == d].tolist())


def test_learning_against_slow_version(monkeypatch):
    """The same updates, one coordinate after another."""
    monkeypatch.setattr(toxicity, "L1", 0.5)
    r = random.Random(3)
    rows = [np.array(sorted(r.sample(range(64), 9))) for _ in range(40)]
    marks = [int(5 in x or r.random() < 0.1) for x in rows]
    got = toxicity.learn(rows, marks, passes=2, bits=6)
    z, n, order = [0.0] * 64, [0.0] * 64, np.random.default_rng(7)
    share = sum(marks) / len(marks)
    bias, squares = np.log(share / (1 - share)), 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else (np.sign(z[i]) * toxicity.L1 - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(2):
        for k in order.permutation(40):
            w = {i: weight(i) for i in rows[k]}
            g = (1 / (1 + np.exp(-(sum(w.values()) + bias))) - marks[k]) * (toxicity.RARER if marks[k] else 1)
            for i in rows[k]:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
            squares += g * g
            bias -= toxicity.ALPHA / (toxicity.BETA + squares**0.5) * g
    want = {i: weight(i) for i in range(64) if abs(z[i]) > toxicity.L1}
    assert want and got.at.tolist() == list(want) and np.allclose(got.value, list(want.values())) and np.isclose(got.bias, bias)


def test_long_texts_score_whole(monkeypatch):
    w = toxicity.Weights(np.sort(np.unique(toxicity.features(np.frombuffer(b"bad word", np.uint8), np.array([0, 8]))[1])), np.ones(3), -1.0)
    score = lambda t: toxicity.scores(w, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
    long = b"fine " * 300_000
    assert score(long + b"Bad, WORD!") == score(b"bad bad word") > score(long) == score(b"") == pytest.approx(1 / (1 + np.e))


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(marks[r["doc_id"]], r["score"], r["predicted"]) for r in toxicity.op13_toxicity(spark, folder).where("held_out").collect() if r["doc_id"] in marks]
    bad, good = [x for x in got if x[0] == 1], [x for x in got if x[0] == 0]
    assert sum(x[2] for x in bad) >= 0.75 * len(bad) and sum(x[2] for x in good) <= 0.01 * len(good)


def test_toxicity_of_odd_tables(spark, documents, no_documents):
    labels = spark.createDataFrame([(0, 1), (1, 0), (0, 1), (5, 1), (None, 1), (6, None), (7, 5)], "doc_id long, toxic int")
    w = toxicity.fit(documents, labels, F.lit(True))
    got = toxicity.score(documents, w)
    assert sorted(got.columns) == sorted(documents.columns) and got.count() == documents.count() and got.where("_score between 0 and 1").count() == got.count()
    same = got.where("text is null or text = ''").select("_score").distinct().collect()
    assert len(same) == 1
    for docs, none in ((no_documents, labels), (documents, labels.where("false"))):
        empty = toxicity.fit(docs, none, F.lit(True))
        assert toxicity.score(documents, empty).where("_score = 0.5").count() == documents.count()
    assert toxicity.score(no_documents, w).collect() == []
