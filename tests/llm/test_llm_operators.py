import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import assert_same, connected

from panelspark.llm import chat, decontaminate, language, packing, quality, queries, topk, warc
from panelspark.storage import shared_folder

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), connected(SMALL), queries.ORACLE_SQL[name])


# packing


def test_packing_round_trip(documents, document_list):
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter((i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in document_list)
    rows = packing.pack(documents, WORDS, capacity=512).collect()
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[(r["_id"], r["doc_tokens"])].append((r["start"], bytes(r["ids"])))
        assert r["length"] == len(r["ids"]) // 4 > 0
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 512
    tokens = sum(len(b) // 4 * n for (_, b), n in want.items())
    assert sum(r["length"] for r in rows) == tokens
    assert len(sequences) * 512 < 1.1 * tokens
    once = {k for k, n in Counter((i, len(b)) for i, b in want.elements()).items() if n == 1}
    for i, b in want:
        if (i, len(b)) in once:
            assert b"".join(x for _, x in sorted(parts[(i, len(b) // 4)])) == b


def test_packing_empty(no_documents):
    assert packing.pack(no_documents, WORDS).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.text("aB é'sÉß0_.!<|endoftext|>中́Σς \t\n²", max_size=50))
def test_words_are_tokenised_as_texts(text):
    t = packing.tokenizer_at(WORDS)
    data = np.frombuffer(text.encode(), np.uint8)
    assert t.encode(data, np.array([0, len(data)]))[0].tolist() == t.whole.encode(text, add_special_tokens=False).ids


def test_long_texts_and_words_are_tokenised_as_texts(monkeypatch):
    """Texts, and words, over a batch; a worker that remembers next to nothing; empty texts between others."""
    monkeypatch.setattr(packing.H, "BATCH", 300)
    r = random.Random(3)
    t = packing.WordTokenizer(WORDS)
    t.known = packing.Known(40)
    texts = [" ".join(r.choice(["été", "Don't", "a_b", "42,7", "中文", "×÷", "plain" + str(r.randrange(99))]) for _ in range(n)) for n in (0, 1, 400, 0, 0, 30, 3)]
    texts += ["x" * 1000, "y" * 299 + " z", "", "ab " * 200 + "é" * 700 + " c", "  \t " * 200]
    raw = [x.encode() for x in texts]
    ids, bounds = t.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.ids for e in t.whole.encode_batch(texts, add_special_tokens=False)]


def test_known_pieces_are_kept_and_forgotten():
    known, r = packing.Known(1000), np.random.default_rng(1)
    for _ in range(60):
        keys = np.unique(r.integers(1, 4000, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        new = keys[known.find(keys) < 0]
        if known.forget(len(new)):
            new = keys[known.find(keys) < 0]
        known.add(new, np.repeat((new >> np.uint64(40)).astype(np.uint32), 2), np.full(len(new), 2))
        assert known.count <= 1000 and known.count == np.count_nonzero(known.keys)
        slots = known.find(new)
        assert (known.find(keys) >= 0).all() and (slots >= 0).all() and (known.tokens(slots) == np.repeat((new >> np.uint64(40)).astype(np.uint32), 2)).all()
        known.met[slots[::3]] = True


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 7))
def test_differencing_places_all(sizes, windows):
    place = packing.differencing(sizes, windows)
    assert len(place) == len(sizes) and set(place) <= set(range(windows))
    sums = np.bincount(place, sizes, minlength=windows)
    assert sums.max() - sums.min() <= max(sizes)


# WARC


def test_warc_round_trip(spark):
    body = "ü" * 600
    rows = [(1, "http://a/ b", body), (2, None, body), (3, "u", body + "x"), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (2, "v", body), (None, "w", body), (None, None, None)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, _id int")
    folder = f"{shared_folder(spark)}/warc-test"
    manifest = warc.write_warc(pages, folder, 3, roll_bytes=300)
    assert manifest.count() > 1
    got = Counter((r["page_id"], bytes(r["payload"]).decode() if r["payload"] is not None else None, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(manifest, folder, with_payload=True).collect())
    revisit = lambda i: (i, None, 1200, "revisit", 2)
    response = lambda i, t: (i, t, len(t.encode()), "response", None)
    assert got == Counter([revisit(1), response(2, body), response(2, body), revisit(None), response(3, body + "x"), response(4, "short"), response(5, "short"), response(6, ""), response(7, ""), response(None, "")])


def test_warc_is_deterministic_and_detects_damage(spark):
    one = warc.build_record(1, "u", b"abc", None, False)
    assert one == warc.build_record(1, "u", b"abc", None, False) and warc.parse_record(one)["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(one.replace(b"abc", b"abd"))


def test_warc_writes_equal_files_for_equal_tables(spark):
    r = np.random.default_rng(5)
    rows = [(int(i) if i % 9 else None, f"u{i}", "".join(map(chr, r.integers(97, 123, int(r.integers(0, 1500)))))) for i in r.integers(-(2**62), 2**62, 400)]
    rows += [(i, "same", rows[3][2]) for i in (5, 5, 7)] + rows[:4]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = []
    for k, table in enumerate((pages.repartition(1), pages.repartition(7, "url"))):
        folder = f"{shared_folder(spark)}/warc-equal-{k}"
        manifest = warc.write_warc(table, folder, 4, roll_bytes=40_000)
        told.append(sorted(map(tuple, manifest.collect())))
        ids = [x.page_id for x in warc.read_warc(manifest, folder).collect()]
        assert len(ids) == len(rows)
    assert told[0] == told[1] and len({x[0] for x in told[0]}) == 4 and sum(x[3] for x in told[0]) == len(rows)
    sizes = [sum(x[3] for x in told[0] if x[0] == k) for k in range(4)]
    assert max(sizes) < 2.5 * len(rows) / 4


def test_warc_empty(spark):
    folder = f"{shared_folder(spark)}/warc-empty"
    manifest = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder, 2)
    assert warc.read_warc(manifest, folder).collect() == []


# top-k


@pytest.mark.parametrize("size", [32 << 20, 3000])
def test_top_k_by_brute_force(spark, monkeypatch, size):
    """In one pass and in several."""
    monkeypatch.setattr(topk, "PASS_BYTES", size)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2 if size < 9999 else 1024)
    r = np.random.default_rng(2)
    vectors = [(i, r.integers(-9, 9, 70 if i % 5 else 64).tolist()) for i in range(300)] + [(300, None), (301, [2**40] * 64), (302, []), (None, [1]), (7, [5] * 64)]
    df = spark.createDataFrame(vectors, "vec_id long, _vec array<long>").repartition(5)
    got = defaultdict(list)
    for x in topk.exact_top_k(df, F.col("vec_id") % 50 == 0, 10).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    valid = [(i, v) for i, v in vectors if i is not None and v is not None]
    for q, v in valid:
        if q % 50 == 0:
            scored = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w in valid if i != q), key=lambda s: (-s[0], s[1]))[:10]
            assert got.pop(q) == [(i, s) for s, i in scored]
    assert not got


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, _vec array<long>")
    assert topk.exact_top_k(df, F.lit(True)).collect() == []


# chat


def test_chat_edges(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|end|>"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, None, None, "late"), (2, 0, "system", "alone"), (None, 0, "ann", "x")]
    got = chat.rotate(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, speaker int")).collect()
    assert {(r["conv_id"], r["speaker"]) for r in got} == {(1, "ann"), (1, "bob"), (None, "ann")}
    ann = next(r for r in got if r["conv_id"] == 1 and r["speaker"] == "ann")
    assert ann["text"] == "<|system|>\nrules<|end|>\n" + "<|assistant|>\nhi < |end|><|end|>\n" * 2 + "<|user:bob|>\n<|end|>\n<|user:unknown|>\nlate<|end|>\n" and ann["n_turns"] == 5
    assert [ann["text"][int(a) : int(b)] for a, b in (s.split("-") for s in ann["mask"].split(";"))] == ["hi < |end|><|end|>"] * 2
    assert sum(r["n_turns"] for r in got if r["speaker"] == "bob") == 5


# language and quality


def test_language_edges(spark, documents, no_documents):
    texts = [("the cat and the hat on the mat", "en"), ("der hund und die katze im haus", "de")] * 3
    rows = [(i, t, g) for i, (t, g) in enumerate(texts)] + [(10, "the rat", None), (11, None, "en"), (12, "12 !? 3", "de"), (13, "", "en"), (None, "und die maus", None)]
    got = {r["_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 4).collect()}
    assert [got[i]["lang"] for i in (4, 5, 10, 11, 12, 13, None)] == ["en", "de", "en", "und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["_held"] and not got[0]["_held"]
    assert language.identify(no_documents, F.lit(True)).collect() == []
    assert {r["lang"] for r in language.identify(documents, F.lit(False)).collect()} == {"und"}


def test_language_by_brute_force(spark):
    """Profiles, ranks, distances and predictions against loops over characters."""
    r = random.Random(21)
    alphabets = {"aa": "abcd é", "bb": "bcde ñ", "cc": "xyz a中"}
    make = lambda g, n: "".join(r.choice(alphabets[g]) for _ in range(n))
    rows = [(i, make(g, r.randrange(5, 200)), g) for i, g in enumerate(["aa", "bb", "cc"] * 25)] + [(90, "1234 !", "aa"), (91, None, "bb"), (92, "ABCD Éé", None)]

    def grams(text):
        text = "".join(c.lower() if c.isalpha() else " " for c in text)
        out = Counter()
        for word in text.split():
            w = f" {word} "
            for k in (1, 2, 3):
                out.update(x for x in (w[i : i + k] for i in range(len(w) - k + 1)) if x.strip())
        return out

    def code(gram):  # the order among equals is that of the symbols
        return sum((1 if c == " " else int(language._to_symbols(np.array([ord(c)], np.uint32))[0])) << (12 * (len(gram) - 1 - k)) for k, c in enumerate(gram))

    ranked = lambda counts, n: sorted(counts, key=lambda g: (-counts[g], code(g)))[:n]
    most = 40
    profiles = {}
    for g in alphabets:
        total = Counter()
        for i, t, lang in rows:
            if lang == g and i % 4 != 1:
                total += grams(t or "")
        profiles[g] = ranked(total, most)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = language.learn_profiles(df.where("doc_id % 4 <> 1").select(F.col("lang").alias("_lang"), F.col("text").alias("_text")), most)
    assert {g: list(map(int, p)) for g, p in learned.items()} == {g: [code(x) for x in p] for g, p in profiles.items()}
    texts = [t or "" for _, t, _ in rows]
    got = language.distances(texts, learned, most)
    for t, row in zip(texts, got):
        own = ranked(grams(t), most)
        if not own:
            assert np.isnan(row).all()
            continue
        want = [sum(abs(p.index(x) - k) if x in p else most for k, x in enumerate(own)) / (len(own) * most) for p in (profiles[g] for g in learned)]
        assert np.allclose(row, want)


def test_gram_counts_by_brute_force():
    text = "Ab, c ÀB\nç中文 𐐷x"
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    want = Counter(g for w in words for k in (1, 2, 3) for p in range(len(w) + 3 - k) if (g := f" {w} "[p : p + k]) != " ")
    doc, gram, count = language.gram_counts(["", text, "12"])
    assert set(doc.tolist()) == {1} and sorted(count.tolist()) == sorted(want.values())


def test_held_out_language(spark):
    rows = language.op6_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out and lang is not null")
    assert rows.where("lang_pred = lang").count() / rows.count() > 0.98


def test_quality_edges(documents, no_documents, document_list):
    w = quality.start_weights()
    rows = quality.score(documents, w).collect()
    assert len(rows) == len(document_list) and all(0 <= r["_score"] <= 1 for r in rows) and "_text" in rows[0].asDict()
    assert quality.score(no_documents, w).collect() == []
    data = np.frombuffer(b"ab" * 5000, np.uint8)
    assert np.isclose(quality.scores(w, data, np.array([0, len(data)]), most=4), quality.scores(w, data, np.array([0, len(data)])))[0]
    one = quality.train([b"x"], [1])
    assert quality.scores(one, np.zeros(0, np.uint8), np.array([0, 0]))[0] > 0.5 and quality.scores(quality.train([], []), data, np.array([0, 9]))[0] == 0.5


def test_chunks_cover_every_byte():
    for n in (0, 1, quality.CHUNK, quality.CHUNK + 1, quality.CHUNK + quality.HOP, 1000):
        data = np.arange(n).astype(np.uint8) % 255 + 1
        chunks, doc = quality.chunked(data.astype(np.uint8), np.array([0, n]))
        assert len(doc) >= 1 and all((k // quality.HOP) < len(chunks) or k < len(chunks) * quality.HOP + quality.CHUNK for k in range(n))
        assert (chunks > 0).sum() >= n


def test_held_out_quality(spark):
    rows = quality.op7_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


# decontamination


def test_leaks(spark, documents, no_documents, document_list):
    long = next(t for i, t in document_list if t and len(t.split()) > 5000)
    cut = " ".join(long.split()[7000:7040])
    items = spark.createDataFrame([(1, cut + ". " + " ".join(long.split()[7040:7050]), 0), (2, "quite other words than any of these. none at all.", 0), (3, None, 0), (4, "", 0), (None, cut, 0), (5, cut + ". " + " ".join(long.split()[7040:7050]), 0)], "item_id long, text string, doc_id int")
    got = decontaminate.find_leaks(documents, items).collect()
    assert len(got) == len(document_list) and [r["_items"] for r in got if r["_items"]] == [[1, 5]]
    assert decontaminate.find_leaks(no_documents, items).collect() == []
    assert all(r["_items"] == [] for r in decontaminate.find_leaks(documents, items.where("item_id > 99")).collect())


def test_leaks_do_not_depend_on_shards(spark, monkeypatch):
    """Items beyond the bound are searched shard by shard, with the statistics of all."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(2, 6)))
    items = [(i, " ".join(word() for _ in range(r.randrange(9, 30))) + ". " + word() + " " + word()) for i in range(60)] + [(60, ""), (None, "a b"), (61, None)]
    docs = []
    for d in range(90):
        parts = [word() for _ in range(r.randrange(0, 150))]
        for _, t in r.sample(items[:60], r.choice((0, 0, 1, 2))):
            at = r.randrange(len(parts) + 1)
            words = t.split()
            parts[at:at] = words if d % 3 else words[: len(words) * 3 // 4] + words[-2:]
        docs.append((d, " ".join(parts) if d else None, "x"))
    df = spark.createDataFrame(docs, "doc_id long, text string, _shard_items string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    whole = {x["doc_id"]: (x["_items"], round(x["_best"], 9), x["_shard_items"]) for x in decontaminate.find_leaks(df, tests).collect()}
    assert sum(bool(v[0]) for v in whole.values()) > 30
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 900)
    got = decontaminate.find_leaks(df, tests)
    assert {x["doc_id"]: (x["_items"], round(x["_best"], 9), x["_shard_items"]) for x in got.collect()} == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcde ", min_size=1, max_size=40), min_size=1, max_size=20), st.text("abcde ", max_size=60), st.sampled_from([0.05, 0.2, 0.5, 0.9]))
def test_wand_retrieves_all(items, query, share):
    index = decontaminate.Index(list(enumerate(items)))
    terms = [int(np.searchsorted(index.terms, w)) for w in np.unique(decontaminate._words(query)) if w in index.terms]
    scores = Counter()
    for t in terms:
        for d, s in zip(index.docs[t], index.impacts[t]):
            scores[d] += s
    assert {d for d, _ in index.retrieve(terms, share)} == {d for d, s in scores.items() if s >= share - 1e-9}


def test_queries_have_their_columns(spark):
    assert zlib.crc32(b"") == 0
    want = {"op1": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op9": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, "op7": {"doc_id", "held_out", "score", "predicted"}}
    for name, q in queries.QUERIES.items():
        if name.split("_")[0] in want:
            assert want[name.split("_")[0]] <= set(q(spark, SMALL).columns)


# session


def test_queries_leave_the_session_as_it_was(spark):
    before = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.sessionState().conf().getAllConfs())
    before = dict(before)
    for name in ("op1_substring_dedup", "op2_warc", "op3_jaccard", "op5_decontaminate", "op10_topk"):
        queries.QUERIES[name](spark, SMALL).count()
    after = dict(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.sessionState().conf().getAllConfs()))
    assert after == before


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(0, 6), st.integers(1, 5), st.booleans())
def test_max_score_by_brute_force(seed, rows, dims, k, signed):
    r = np.random.default_rng(seed)
    cells, q = (r.integers(-9 if signed else 0, 10, s) for s in ((rows, dims), (dims,)))
    ids = r.permutation(rows * 2)[:rows]
    want = sorted(((-int(c @ q), int(i)) for i, c in zip(ids, cells) if i != ids[0]))[:k]
    lists = topk.Lists(np.array([ids[0]], "<i8").tobytes(), dims, q.astype("<i8").tobytes(), k)
    cut = rows // 3
    for a, b in ((0, cut), (cut, rows)):
        if b > a:
            lists.meet(ids[a:b], cells[a:b])
    assert [(-s, i) for i, s in zip(lists.best[0][0].tolist(), lists.best[0][1].tolist())] == want
    for step in (1, 4):
        got = topk.max_score(q, int(ids[0]), ids, cells, cells.max(axis=0), cells.min(axis=0), k, step=step)
        assert [(-s, i) for i, s in zip(got[0].tolist(), got[1].tolist())] == want
