import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import hashing as H
from panelspark.llm import repeats, substring_dedup, suffix_dedup


def kept_by_force(units, window):
    seen = Counter(tuple(u[p : p + window]) for u in units for p in range(len(u) - window + 1))
    out = []
    for u in units:
        reach, keep = 0, []
        for p in range(len(u)):
            if p + window <= len(u) and seen[tuple(u[p : p + window])] > 1:
                reach = p + window
            if p >= reach:
                keep.append(u[p])
        out.append(keep)
    return out


def test_bytes_by_brute_force(documents, document_list):
    raw = [(t or "").encode() for _, t in document_list]
    want = Counter((i, len(b), len(b) - len(k), bytes(k)) for (i, _), b, k in zip(document_list, raw, kept_by_force(raw, 400)))
    got = Counter((r["_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.dedup_suffixes(documents, 400).collect())
    assert got == want and any(k[2] for k in want)


def test_spans_are_maximal_runs(documents):
    for r in suffix_dedup.dedup_suffixes(documents, 400).collect():
        spans = [(s["start"], s["stop"]) for s in r["spans"]]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_words_by_brute_force(documents, document_list):
    split = [(t or "").encode().split() for _, t in document_list]
    want = Counter((i, len(w), len(w) - len(k), b" ".join(k).decode()) for (i, _), w, k in zip(document_list, split, kept_by_force(split, 35)))
    got = Counter((r["_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(documents, 35).collect())
    assert got == want and any(k[2] for k in want)


def test_empty_tables(no_documents):
    assert suffix_dedup.dedup_suffixes(no_documents).collect() == [] and substring_dedup.dedup_substrings(no_documents).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=5), st.integers(4, 12))
def test_anchors_give_each_window_once(texts, window):
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(int)
    gram = window // 2
    p = H.prefix_sums(H.byte_values(data))
    at, first, last = H.anchors(p, bounds, window, gram)
    starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert starts == [s for a, b in zip(bounds, bounds[1:]) for s in range(a, b - window + 1)]
    place = {}
    for a, f, e in zip(at, first, last):
        for s in range(f, e + 1):
            assert place.setdefault(data[s : s + window].tobytes(), a - s) == a - s  # equal windows, equal offsets


def test_automaton_finds_repeated_windows():
    r = random.Random(2)
    for _ in range(60):
        pieces = list({tuple(r.randrange(3) for _ in range(r.randrange(1, 14))): 1 for _ in range(6)})
        weights = [r.choice((1, 2)) for _ in pieces]
        seen = Counter()
        for p, w in zip(pieces, weights):
            for k in range(len(p) - 3):
                seen[p[k : k + 4]] += w
        want = [[seen[p[k : k + 4]] > 1 for k in range(len(p) - 3)] for p in pieces]
        for shard in (2, 100):
            assert substring_dedup.shard_masks([(list(p), w) for p, w in zip(pieces, weights)], 4, shard) == want


def test_loser_tree_merges_with_known_prefixes():
    r = random.Random(4)
    for n in (1, 2, 3, 5, 8):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(9))) for _ in range(r.randrange(12))) for _ in range(n)]

        def coded(run):
            before = b""
            for s in run:
                yield suffix_dedup.common_prefix(before, s), s, None
                before = s

        merged = list(suffix_dedup.LoserTree([coded(run) for run in runs]))
        assert [s for _, s, _ in merged] == sorted(s for run in runs for s in run)
        assert all(h == suffix_dedup.common_prefix(a[1], s) for a, (h, s, _) in zip(merged, merged[1:]))


def test_words_longer_than_a_hash_table():
    data = np.frombuffer(b"a " + b"b" * (H.BATCH + 5) + b" c " + b"d e " * H.BATCH, np.uint8)
    start, stop, h, bounds = repeats.word_hashes(data, np.array([0, len(data)]))
    assert len(h) == 3 + 2 * H.BATCH and bounds.tolist() == [0, len(h)]
    assert h[0] == repeats.word_hashes(np.frombuffer(b"a", np.uint8), np.array([0, 1]))[2][0] and len(set(h[3:].tolist())) == 2
