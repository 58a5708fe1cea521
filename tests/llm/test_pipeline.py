import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_jaccard import by_force
from test_repeats import kept_by_force

import corpus_pipeline as P
from panelspark import storage
from panelspark.llm import chat, decontaminate, language, packing, quality
from panelspark.llm.packing import tokenizer_at

SMALL = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, tmp_path):
    """Every stage on the documents of its predecessor, against slow versions of what it should keep."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    weights = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), quality.fold() != 0)
    before = docs.collect()
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        now = docs.collect()
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns, name
        if name == "quality classifier":
            want = {r.doc_id for r in before if one_score(weights, r.text) >= P.KEEP}
            assert {r.doc_id for r in now} == want and 0 < len(want) < len(before)
        elif name == "n-gram Jaccard join":
            of = {i: c for i, _, c in by_force([(r.doc_id, r.text) for r in before])}
            assert {r.doc_id for r in now} == {i for i, c in of.items() if i == c}
        elif name == "suffix-array dedup":
            raw = [r.text.encode() for r in before]
            want = {r.doc_id: bytes(b).decode("utf-8", "ignore") for r, b in zip(before, kept_by_force(raw, P.REPEAT))}
            assert {r.doc_id: r.text for r in now} == want and all(r.n_chars == len(r.text) for r in now)
            assert any(len(want[r.doc_id]) < len(r.text) for r in before)
        elif name == "benchmark decontamination":
            items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            held = {r.doc_id for r in before if any(" ".join(i.split()).lower() in " ".join(r.text.split()).lower() for i in items)}
            left = {r.doc_id for r in now}
            assert not held & left and left <= {r.doc_id for r in before} and len(left) >= 0.95 * (len(before) - len(held))
        else:
            tokens = Counter()
            for r in now:
                tokens[r.doc_id] += r.length
            whole = tokenizer_at(public_tokenizers.path("word_bpe_49k.json")).whole
            assert tokens == {r.doc_id: len(e.ids) + 1 for r, e in zip(before, whole.encode_batch([r.text or "" for r in before], add_special_tokens=False))}
        before = now


def one_score(w, text):
    """The network on one text, chunk by chunk."""
    data = list((text or "").encode())
    total, top, n = np.zeros(quality.FILTERS), np.zeros(quality.FILTERS), 0
    at = 0
    while True:
        chunk = (data[at : at + quality.CHUNK] + [0] * quality.CHUNK)[: quality.CHUNK]
        best = np.full(quality.FILTERS, -np.inf)
        for s in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP):
            best = np.maximum(best, w["E"][chunk[s : s + quality.WIDTH]].reshape(-1) @ w["W"])
        h = np.maximum(best + w["b"], 0)
        total, top, n = total + h, np.maximum(top, h), n + 1
        if at + quality.CHUNK >= len(data):
            break
        at += quality.HOP
    return 1 / (1 + np.exp(-np.clip(np.concatenate((total / n, top)) @ w["v"] + w["c"][0], -30, 30)))


def test_scores_by_brute_force(spark, documents):
    weights = quality.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"), quality.fold() != 0)
    for r in quality.score(documents, weights, out="p").select("text", "p").collect():
        assert abs(r.p - one_score(weights, r.text)) < 1e-4


def test_run_deletes_what_it_wrote(spark):
    before = set(storage._WRITTEN)
    assert P.run(spark, SMALL).count() > 0
    assert set(storage._WRITTEN) == before


def test_stages_take_edge_cases(spark, documents):
    """Null and repeated ids, null, empty and long texts, and columns of a caller's own with an operator's names."""
    rows = documents.select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("_items"), F.lit("b").alias("_best"), "_score", "_id", "_th" if "_th" in documents.columns else F.lit(2).alias("_th"))
    kept = P.keep_quality(spark, rows, SMALL)
    assert kept.columns == rows.columns and {r._score for r in kept.collect()} <= {r._score for r in rows.collect()}
    one = P.one_of_each(spark, rows, SMALL)
    ids = [r["doc_id"] for r in one.collect() if r["doc_id"] is not None]
    assert one.columns == rows.columns and len(ids) == len(set(ids))
    cut = P.cut_repeats(spark, rows, SMALL)
    found = cut.collect()
    assert cut.columns == rows.columns and len(found) == rows.count() and sum(r["text"] is None for r in found) == rows.where("text is null").count()
    assert all(r["n_chars"] == len(r["text"] or "") for r in found)
    clean = P.drop_leaks(spark, rows, SMALL)
    assert clean.columns == rows.columns and clean.count() == rows.count() and {r._items for r in clean.collect()} == {1}
    packed = P.pack_sequences(spark, rows, SMALL)
    assert Counter(r.doc_id for r in packed.where("start = 0").collect()) == Counter(r.doc_id for r in rows.collect())


def test_stages_take_empty_tables(spark):
    none = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 0")
    for name, stage in P.STAGES:
        assert stage(spark, none, SMALL).collect() == [], name


def test_classifier_takes_odd_labels(spark, documents, no_documents):
    labels = spark.createDataFrame([(0, 1), (0, 1), (None, 0), (1, 0), (2, None), (3, 7), (4, 0), (5, 1)], "doc_id long, quality int").withColumn("_id", F.lit("own"))
    every = F.lit(True)
    one, two = (quality.fit(d, labels, every) for d in (documents, documents.repartition(5)))
    assert all((one[k] == two[k]).all() for k in one)
    for d, marks in ((no_documents, labels), (documents, labels.limit(0)), (documents, labels.where("quality = 1"))):
        scores = [r.p for r in quality.score(documents, quality.fit(d, marks, every), out="p").collect()]
        assert len(set(scores)) == 1 and 0 <= scores[0] <= 1
    assert quality.score(no_documents, one).collect() == []


def test_language_of_long_and_repeated_texts(spark, monkeypatch):
    r = random.Random(2)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwölf", "boxer", "jagen"]}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    long = text("bb", 60_000)
    assert len(long) > language.BATCH_CHARS or language.BATCH_CHARS > 300_000
    rows = [(i, text(k, 40), k) for i in range(12) for k in words] + [(90, long, None), (90, long, None), (None, "", "aa"), (91, "123", "bb"), (92, None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_lang", F.lit("own"))
    got = [(x._id, x.lang) for x in language.identify(docs, F.col("doc_id") < 10).collect()]
    assert Counter(got)[(90, "bb")] == 2 and {(None, "und"), (91, "und"), (92, "und")} <= set(got)
    assert language.identify(docs.limit(0), F.lit(True)).collect() == []


def test_leaks_by_brute_force(spark):
    """Documents that hold an item word for word are found with it; documents that share no run of words are not."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(r.randrange(9, 40)))) for i in range(30)]
    docs, want = [], {}
    for d in range(80):
        parts = [" ".join(word() for _ in range(r.randrange(0, 120))) for _ in range(3)]
        held = r.sample(items, r.choice((0, 0, 1, 2)))
        for k, (_, t) in enumerate(held):
            parts.insert(2 * k + 1, t.upper() if d % 2 else t)
        docs.append((d, " ".join(parts)))
        want[d] = sorted(i for i, _ in held)
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), out=("found", "best"))
    assert {x.doc_id: x.found for x in found.collect()} == want


def test_endless_dialogues(spark, monkeypatch):
    """Any number of turns is one row, also where all lack a number and where a dialogue is spread over tasks."""
    monkeypatch.setattr(chat.chains, "SHORT", 100)
    turns = [(1, i, "ab"[i % 2], f"t{i}") for i in range(600)] + [(2, None, "abc"[i % 3], f"y{i % 7}") for i in range(500)] + [(3, 0, "system", "s"), (None, 1, "a", "x")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("own")).repartition(4)
    got = {(r.conv_id, r.speaker): r for r in chat.rotate(rows).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {(1, "a"): 600, (1, "b"): 600, (2, "a"): 500, (2, "b"): 500, (2, "c"): 500, (None, "a"): 1}
    for (conv, who), r in got.items():
        mine = sorted((t is None, t or 0, role, x) for c, t, role, x in turns if c == conv)
        want = "".join(f"<|{'assistant' if role == who else 'user:' + role}|>\n{x}<|end|>\n" for _, _, role, x in mine)
        assert r.text == want
        spans = [tuple(map(int, s.split("-"))) for s in r.mask.split(";")]
        assert [r.text[a:b] for a, b in spans] == [f"{x}<|end|>" for _, _, role, x in mine if role == who]
    assert chat.rotate(rows.limit(0)).collect() == []


def test_packing_keeps_own_columns_out(spark, documents):
    assert packing.pack(documents, public_tokenizers.path("word_bpe_49k.json")).columns == ["_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
