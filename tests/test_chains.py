"""Chains, packing folds and slices against loops over rows, with short groups and with long ones that are spread."""

import random

import numpy as np
import pytest

from panelspark.operators import chains, folds, slicing as S


@pytest.fixture(params=["short", "long"])
def spread(request, monkeypatch):
    """Groups of over 5 rows are long, blocks have few rows."""
    if request.param == "long":
        monkeypatch.setattr(chains, "SHORT", 5)
        monkeypatch.setattr(chains, "BLOCK", 40)


def text_rows():
    r = random.Random(9)
    sizes = {1: [400, 600, 1, 1200, 5] + [1] * 60, 2: [r.choice([0, 1, 90, 300, 999, 1000, 1001, 1491, 1492, 1500, 2000]) for _ in range(150)], 3: [1495], 4: [1491, 0, 0], None: [0] * 90 + [None, 800, 300], 5: [1492, 1], 6: [1500, 1500, 0]}
    return [(c, i, "x", n) for c, ns in sizes.items() for i, n in enumerate(ns)]


def slow_outer(ns):
    out, batch, chars, items = [], 0, 0, 0
    for n in ns:
        if items and (chars + (n or 0) > 1000 or items >= 25):
            batch, chars, items = batch + 1, 0, 0
        out.append(batch)
        chars, items = chars + (n or 0), items + 1
    return out


def slow_inner(ns):
    out, batch, chars, some = [], 0, 0, False
    for n in ns:
        n = n or 0
        if chars + n + 9 > 1500:
            batch, chars = batch + some, n
        else:
            chars += n + 9
        some = True
        out.append(batch)
    return out


def slow_groups(images):
    out, group, total, first = [], 0, 0, 0
    for w, h in images:
        first = first or w
        total += int(h * (first / w))
        out.append(group)
        if total >= 8000:
            group, total, first = group + 1, 0, 0
    return out


def by_chapter(rows, slow):
    groups = {}
    for c, i, *x in rows:
        groups.setdefault(c, []).append((i, x))
    return {(c, i): b for c, g in groups.items() for (i, _), b in zip(sorted(g), slow([x for _, x in sorted(g)]))}


@pytest.mark.parametrize("fold, slow", [(folds.outer_batches, slow_outer), (folds.inner_batches, slow_inner)])
def test_batches(spark, spread, fold, slow):
    rows = text_rows()
    df = spark.createDataFrame(rows, "chapter_id long, pos long, text string, n int").repartition(3)
    got = fold(df)
    assert got.columns == [*df.columns, "batch_no"]
    assert {(r.chapter_id, r.pos): r.batch_no for r in got.collect()} == by_chapter(rows, lambda g: slow([x[1] for x in g]))
    assert fold(df.limit(0)).collect() == []


def test_stacks_of_images(spark, spread):
    r = random.Random(5)
    rows = [("a", i, r.choice([700, 800, 900]), r.randrange(300, 2100)) for i in range(120)] + [("b", i, 800, 40) for i in range(260)] + [("c", 0, 700, 9000), ("c", 1, 100, 5)]
    df = spark.createDataFrame(rows, "chapter_id string, idx long, w int, h int").repartition(3)
    assert {(x.chapter_id, x.idx): x.group_no for x in folds.merge_groups(df).collect()} == by_chapter(rows, slow_groups)


def test_a_long_chain_has_few_rounds(spark, monkeypatch):
    """No group is one row, and rounds are the digits of the chain's length."""
    monkeypatch.setattr(chains, "SHORT", 100)
    made = []
    whole = chains.materialize
    monkeypatch.setattr(chains, "materialize", lambda df, name: made.append(name) or whole(df, name))
    steps = spark.range(1, 5001).selectExpr("1 AS c", "id AS place", "id + 1 + id % 3 AS next")
    got = sorted((r.place, r.k) for r in chains.reached(steps, ["c"]).collect())
    want, at = [], 1
    while at <= 5000:
        want.append(at)
        at += 1 + at % 3
    assert got == [(p, k) for k, p in enumerate(want)] and made.count("jumps") <= len(want).bit_length() + 1


def cut_strip(std: np.ndarray, edge: np.ndarray, forbidden: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, stop, how) of each slice of a strip."""
    h = len(std)
    if h <= S.MOST:
        return [(0, h, "whole")]
    safe = (std < S.STD) & (edge < S.EDGE) & ~forbidden
    run = np.concatenate(([0], np.cumsum(safe)))
    ok = np.flatnonzero(run[S.GAP:] - run[:-S.GAP] == S.GAP)
    score = 100 * edge + std + 1e6 * forbidden
    out, start = [], 0

    def last_gap(lo: int, hi: int) -> int | None:
        if hi - lo < S.GAP:
            return None
        k = np.searchsorted(ok, hi - S.GAP, "right") - 1
        return int(ok[k]) + S.GAP // 2 if k >= 0 and ok[k] > lo else None

    while h - start > S.MOST:
        aim = min(start + S.TARGET, h)
        up, down = max(start + S.LEAST, aim - S.REACH), min(start + S.MOST, aim + S.REACH)
        for how, lo, hi in (("near", up, down), ("up", start + S.LEAST, up), ("down", down, min(start + S.MOST, h))):
            cut = last_gap(lo, hi)
            if cut is not None:
                break
        else:
            lo, hi = min(start + S.TARGET, h - 1), min(start + S.MOST, h)
            how, cut = "force", lo + int(np.argmin(score[lo:hi]))
        out.append((start, cut, how))
        start = cut
    return [*out, (start, h, "tail")]


def strips():
    r = np.random.default_rng(3)
    for page, (h, calm, bad) in enumerate([(1, 0.9, 0), (1800, 0.5, 0), (1801, 1.0, 0), (1801, 0.0, 0), (6000, 0.97, 0.01), (5200, 0.5, 0.01), (4000, 0.99, 0.001), (9000, 0.985, 0)]):
        std = np.where(r.random(h) < calm, 1.0, 9.0 + r.integers(0, 3, h))
        yield page, std, np.where(r.random(h) < 0.01, 0.5, 0.0), r.random(h) < bad


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK", 2500)
    monkeypatch.setattr(chains, "SHORT", 5500)
    data = list(strips())
    rows = [(p, y, float(s[y]), float(e[y]), bool(f[y])) for p, s, e, f in data for y in range(len(s))]
    df = spark.createDataFrame(rows, "page_id long, y int, row_std double, edge_density double, forbidden boolean").repartition(4)
    got = {}
    for r in sorted(S.slices(df).collect(), key=lambda r: (r.page_id, r.part)):
        got.setdefault(r.page_id, []).append((r.y1, r.y2, r.how))
    for p, s, e, f in data:
        assert got[p] == cut_strip(s, e, f)
        assert got[p][0][0] == 0 and got[p][-1][1] == len(s) and all(b - a <= 1800 for a, b, _ in got[p])
    assert {h for g in got.values() for *_, h in g} >= {"whole", "near", "force", "tail"}
