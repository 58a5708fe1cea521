"""One test for each finding of the third round."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import chains
from panelspark.storage import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f2_rows_of_a_long_chain_are_not_broadcast(spark, monkeypatch):
    """Rows meet rows by merging, though the written tables are small; a long chain is walked in blocks, not in rounds over all rows."""
    monkeypatch.setattr(chains, "SHORT", 30)
    monkeypatch.setattr(chains, "BLOCK", 50)
    r, made, whole = random.Random(1), [], chains.materialize
    monkeypatch.setattr(chains, "materialize", lambda df, name: made.append(name) or whole(df, name))
    after = {c: [p + r.randrange(1, 30) for p in range(1, 1500)] for c in ("a", None)}
    rows = [(c, p, n, str(p)) for c, ns in after.items() for p, n in enumerate(ns, 1)]
    steps = materialize(spark.createDataFrame(rows, "c string, place long, next long, how string"), "rows")
    got = chains.reached(steps, ["c"], more=["how"])
    want = set()
    for c, ns in after.items():
        at, k = 1, 0
        while at < 1500:
            want.add((c, at, ns[at - 1], str(at), k))
            at, k = ns[at - 1], k + 1
    assert {(x.c, x.place, x.next, x.how, x.k) for x in got.collect()} == want
    assert made.count("left") < 5 and "jumps" not in made
    assert "Broadcast" not in plan(chains.numbered(steps, steps.select("c", "place", "next", F.lit(0).alias("k")), ["c"], "no"))


def test_f3_text_is_wrapped_in_few_steps(spark):
    """A text of 20,000 words at all sizes; surrogate pairs are one character; odd boxes."""
    from panelspark.operators import layout

    widths = [340 + 60 * (code % 7) for code in range(0x180)]
    rows = [(1, "abc de fghij " * 7000, 300.0, 50.0, 40), (2, "\U0001f600\U0001f600 x\x1cy", 20.0, 900.0, 20), (3, "a b", None, 90.0, 20), (4, "a b", 50.0, None, 20), (5, "a b", 50.0, 50.0, None), (6, "ab cd", 0.0, 1.0, 10)]
    df = spark.createDataFrame(rows, "k int, t string, w double, h double, s int").repartition(1)
    got = {x.k: (x.f["size"], x.f["lines"]) for x in df.select("k", layout.fit_text(F.col("t"), F.col("w"), F.col("h"), F.col("s"), widths).alias("f")).collect()}
    assert got[1][0] == 8 and " ".join(got[1][1]) == rows[0][1].strip()
    assert got[2] == (20, ["\U0001f600-", "\U0001f600", "x-", "\x1cy"])
    assert got[3] == (20, ["a", "b"]) and got[4] == (8, ["a b"]) and got[5] == (None, []) and got[6] == (8, ["a-", "b", "c-", "d"])


def test_f7_rows_of_a_page_are_not_written_out(spark):
    """Bands are the rows that lines forbid, in any order and with lines of no height, and are as few as lines at most."""
    from panelspark.operators import slicing as S

    r = random.Random(4)
    lines = [(p, y, y + r.choice([0, 5, 30, 90])) for p in (1, 2, None) for y in (r.randrange(3000) for _ in range(60))] + [(7, 0, 0), (8, 90, 80), (9, 5_000_000, 9_000_000)]
    df = spark.createDataFrame(lines, "page_id long, y1 int, y2 int").repartition(3)
    bands = {}
    for x in S.forbidden_bands(df).collect():
        bands.setdefault(x.page_id, []).append((x.first, x.last))
    want = {}
    for p in (1, 2, None, 7, 8):
        own = [(a, b) for q, a, b in lines if q == p]
        want[p] = {y for a, b in own for y in range(max(0, a - 25), min(max(b for _, b in own), b + 25))}
    for p, rows in want.items():
        assert sum(b - a + 1 for a, b in bands.get(p, [])) == len(rows) and {y for a, b in bands.get(p, []) for y in range(a, b + 1)} == rows
    assert bands[9] == [(4_999_975, 8_999_999)]
    got = S.forbidden_rows(df.where("page_id = 1")).collect()
    assert len(got) == len(want[1]) and {x.y for x in got} == want[1]


def test_f9_slants_are_not_groups_of_columns(spark):
    """Slants of drawn strokes and of noise like a loop's; the plan has no table of columns by angle."""
    import numpy as np

    from panelspark.operators import raster

    g, rows, want = np.random.default_rng(5), [], {}
    for k in range(30):
        if k % 3:
            y, x = np.nonzero(g.random((9 + k, 20)) < 0.3)
        else:
            y = np.arange(40)
            x = (30 - np.tan(np.radians(k - 15)) * y).astype(int)
        rows += [(k, int(b), int(a)) for b, a in zip(y, x)]
        score = {a: int((np.unique(np.trunc(x + float(np.tan(np.radians(a))) * y), return_counts=True)[1] ** 2).sum()) for a in raster.ANGLES}
        want[k] = min(a for a in score if score[a] == max(score.values()))
    rows += [(99, 1, x) for x in range(15)]
    random.Random(2).shuffle(rows)
    found = raster.slant(spark.createDataFrame(rows, "img_id long, y int, x int").repartition(3))
    assert {x.img_id: x.slant for x in found.collect()} == want | {99: 0}
    assert raster.slant(spark.createDataFrame([], "img_id long, y int, x int")).collect() == []
    assert "Generate explode" not in plan(found)


def test_f5_stroke_rows_are_dealt_by_image_and_number(spark):
    """Rows that grow from few bytes are not gathered into few tasks; distances, percentiles and flags share one dealing."""
    from panelspark.operators import raster

    pixels = spark.createDataFrame([(k, y, x, (k * y + 3 * x) % 200) for k in range(5) for y in range(8) for x in range(8)], "img_id long, y int, x int, g int")
    sizes = pixels.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    strokes = raster.stroke_width(raster.ink(pixels), sizes)
    assert len({x.img_id for x in strokes.collect()}) == strokes.count() > 0
    assert "REPARTITION_BY_NUM" in plan(strokes)


def shuffled_records(spark):
    """Records that all stages so far have written to shuffles."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("block", [16_384, 2_500])
def test_f4_rows_of_strips_are_not_shuffled(spark, monkeypatch, block):
    """Rows are packed before they are dealt, in strips of one block and of several; null, NaN and zero scores keep their order."""
    from panelspark.operators import slicing as S

    monkeypatch.setattr(chains, "BLOCK", block)
    odd = {1: {1500: None, 1400: 0.0}, 2: {1400: -0.0, 1350: 0.0}, 3: {y: float("nan") for y in range(1300, 1799)}, 4: {1600: -5.0, 1700: None}, None: {}}
    rows = [(p, y, odd[p].get(y, 9.0), 0.5, y > 2000) for p in odd for y in range(1900)] + [(9, y, 1.0, 0.0, y % 1300 < 100) for y in range(9000)]
    df = spark.createDataFrame(rows, "page_id long, y int, row_std double, edge_density double, forbidden boolean").coalesce(2)
    df = materialize(df, "rows")
    before = set(shuffled_records(spark))
    got = sorted(S.slices(df).collect(), key=lambda r: (r.page_id or 0, r.part))
    assert [r.y2 for r in got if r.page_id != 9] == [1300, 1900, 1500, 1900, 1350, 1900, 1799, 1900, 1700, 1900]
    ends = [(r.y1, r.y2, r.how) for r in got if r.page_id == 9]
    assert ends[0] == (0, 1425 + 12, "near") and ends[-1][1] == 9000 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    moved = sum(n for s, n in shuffled_records(spark).items() if s not in before)
    assert 0 < moved < len(rows) / 10 or block < 9000
    with pytest.raises(IndexError):
        S.slices(df.limit(0)).collect()[0]


def test_f8_pages_are_closed_where_they_are_dealt(spark, monkeypatch):
    """Pages within a stretch need no rounds of stars, longer ones need them for what links their stretches; many links in one
    stretch are held back as a forest. Clusters are those of a union-find either way."""
    from panelspark.operators import bubbles as B

    r = random.Random(8)
    links = [(p, *sorted(r.sample(range(90), 2))) for p in range(6) for _ in range(70 - 8 * p)] + [(9, i, i + 1) for i in range(300)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for p, a, b in links:
        a, b = sorted((top((p, a)), top((p, b))))
        root[b] = a
    want = {x: top(x)[1] for x in list(root)}
    df = spark.createDataFrame(links, "page_id long, a int, b int").repartition(3)
    rounds, whole = [], B.components
    monkeypatch.setattr(B, "components", lambda pairs: rounds.append(1) or whole(pairs))
    for stretch, held, many in [(4096, 200_000, 0), (4096, 5, 0), (32, 5, 1)]:
        monkeypatch.setattr(B, "STRETCH", stretch)
        monkeypatch.setattr(B, "HELD", held)
        rounds.clear()
        got = B.closure(df).collect()
        assert len(got) == len(want) and {(x.page_id, x.line_no): x.cluster for x in got} == want and len(rounds) == many
    assert B.closure(df.limit(0)).collect() == []


def test_f8_cleaned_text_is_what_it_was(spark):
    """Cleaning by fewer patterns equals the step by step rule, for all white space and characters of two units."""
    from panelspark.functions import text as X

    r, blank = random.Random(5), "".join(map(chr, [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x180E, 0x200B, 0x1C, 0]))
    rows = [("".join(r.choice(blank + "      |[]{}aBzßıéİ9.,!?'\"~-(;:)\U0001f600") for _ in range(r.randrange(25))),) for _ in range(5000)] + [(None,)]
    raw = F.col("raw")
    slow = X.collapse(X.strip(F.regexp_replace(F.upper(F.translate(raw, "|[]{}", "IIIII")), X.KEPT, "")))
    noise = slow.rlike(X.NOISE) & (F.length(slow) < 6)
    df = spark.createDataFrame(rows, "raw string")
    assert df.where(~X.clean_line(raw).eqNullSafe(slow) | ~X.is_noise(slow).eqNullSafe(noise)).count() == 0
    assert df.where(~X.has_letters(raw, 3).eqNullSafe(F.length(X.letters(raw)) > 2)).count() == 0
