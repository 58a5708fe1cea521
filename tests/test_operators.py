import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark import api, config, storage
from panelspark.functions import text as X
from panelspark.operators import archive, bubbles, folds, kernels, layout, raster, routing
from panelspark.operators import components as graph
from panelspark.sources import files, html, registry

LINE = "page_id long, line_no int, raw_text string, x1 int, y1 int, x2 int, y2 int, angle double, is_italic boolean, is_bold boolean"


def lines(spark, rows):
    return spark.createDataFrame([(1, i, "WORD", *r, False, False) for i, r in enumerate(rows)], LINE)


@pytest.mark.parametrize(
    ("second", "linked"),
    [
        ((0, 30, 100, 50, 0.0), True),  # a gap of 10 rows is allowed
        ((0, 37, 100, 57, 0.0), False),  # 17 is more than 0.8 of the height
        ((0, 36, 100, 56, 0.0), True),
        ((0, 25, 100, 51, 0.0), True),  # heights 20 and 26: a ratio of exactly 1.3
        ((0, 25, 100, 52, 0.0), False),
        ((0, 25, 100, 45, 12.0), True),
        ((0, 25, 100, 45, 12.5), False),
        ((60, 25, 160, 45, 0.0), False),  # centres are exactly 0.6 of the width apart
        ((59, 25, 159, 45, 0.0), True),
    ],
)
def test_merge_rule_at_its_limits(spark, second, linked):
    found = bubbles.edges(lines(spark, [(0, 0, 100, 20, 0.0), second])).collect()
    assert [(r.a, r.b) for r in found] == ([(0, 1)] if linked else [])


def test_closure_is_transitive_within_a_page(spark):
    column = [(0, 25 * i, 100, 25 * i + 20, 0.0) for i in range(40)] + [(0, 9000, 100, 9020, 0.0)]
    rows = lines(spark, column)
    both = rows.unionByName(rows.withColumn("page_id", F.lit(2).cast("long")))
    got = {(r.page_id, r.line_no, r.cluster) for r in bubbles.clusters(both).collect()}
    assert got == {(p, i, 0) for p in (1, 2) for i in range(40)} | {(p, 40, 40) for p in (1, 2)}


def by_union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        if x is not None and y is not None and x != y:
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("hubs", [None, 4])
@pytest.mark.parametrize("case", ["random", "path", "star", "empty"])
def test_components_by_union_find(spark, monkeypatch, case, hubs):
    """With hubs of a quarter of all edges, too, whose edges are not dealt out by key."""
    if hubs:
        monkeypatch.setattr(graph, "HUBS", hubs)
        monkeypatch.setattr(graph, "HUB_EDGES", 1)
    rng = random.Random(7)
    path = rng.sample(range(90), 90)
    star = [(40, i) for i in range(80)] + [(i, i + 100) for i in range(0, 80, 3)]
    pairs = {"random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "path": list(zip(path, path[1:])), "star": star * 2, "empty": []}[case]
    pairs += [(3, 3), (None, 1), (2, None)]
    got = [tuple(r) for r in graph.components(spark.createDataFrame(pairs, "a int, b int")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == by_union_find(pairs)


def test_closure_does_not_depend_on_partitions(spark):
    rows = lines(spark, [(0, 25 * (i % 7) + 400 * (i // 7), 100, 25 * (i % 7) + 400 * (i // 7) + 20, 0.0) for i in range(35)])
    one, many = (sorted(map(tuple, bubbles.clusters(rows.repartition(n, "line_no")).collect())) for n in (1, 5))
    assert one == many


def test_folds_keep_order_and_limits(spark):
    sizes = [400, 600, 1, 1200, 5] + [1] * 30
    texts = spark.createDataFrame([(1, i, "x", n) for i, n in enumerate(sizes)], "chapter_id long, pos long, text string, n int")
    got = [r.batch_no for r in folds.outer_batches(texts).orderBy("pos").collect()]
    assert got == sorted(got) and got[:5] == [0, 0, 1, 2, 3]
    for b in set(got):
        mine = [n for n, k in zip(sizes, got) if k == b]
        assert len(mine) <= 25 and (len(mine) == 1 or sum(mine) <= 1000)
    inner = [r.batch_no for r in folds.inner_batches(texts).orderBy("pos").collect()]
    assert inner == sorted(inner) and len(inner) == len(sizes)


def test_requests_never_split_again(spark):
    sizes = [990, 5, 5] + [40] * 25
    texts = spark.createDataFrame([(1, i, "x", n) for i, n in enumerate(sizes)], "chapter_id long, pos long, text string, n int")
    outer = folds.outer_batches(texts).select(F.col("batch_no").alias("chapter_id"), "pos", "text", "n")
    assert {r.batch_no for r in folds.inner_batches(outer).collect()} == {0}


def test_routing_numbers_blocks_over_pages(spark):
    rows = spark.createDataFrame([(1, p, b, "BAM!" if b == 1 else "TWO WORDS") for p in range(3) for b in range(3)], "chapter_id long, page_no long, block_no long, text string")
    got = routing.numbered(routing.routed(rows, routing.SOUNDS)).orderBy("page_no", "block_no").collect()
    assert [r.sound for r in got[:3]] == [None, "DUAG", None]
    assert [r.ai_index for r in got] == [0, None, 1, 2, None, 3, 4, None, 5]


def test_answers(spark):
    row = spark.createDataFrame([("1. a: b\n130495848\n 2) Terjemahan: c ", "x\n\ny", "")], "a string, b string, c string")
    got = row.select(X.extract_answers(F.col("a")), X.verified_answers(F.col("b"), F.lit(2)), X.verified_answers(F.col("c"), F.lit(1)), X.verified_answers(F.col("b"), F.lit(3))).first()
    assert list(got) == [["a: b", "c"], ["x", "y"], None, None]


def test_uniform_and_sparse_images(spark):
    rows = [(1, y, x, 7) for y in range(4) for x in range(4)] + [(2, y, x, 0 if (y, x) == (1, 1) else 200) for y in range(4) for x in range(4)]
    pixels = spark.createDataFrame(rows, "img_id long, y int, x int, g int")
    assert [tuple(r) for r in raster.otsu(pixels).collect()] == [(2, 0)]
    assert [tuple(r) for r in raster.slant(raster.ink(pixels)).collect()] == [(2, 0)]
    assert {tuple(r) for r in raster.styles(pixels).collect()} == {(1, False, False), (2, False, False)}


def test_ink_distances_by_brute_force(spark):
    """Thick strokes, a row and a column without background, shapes at the border."""
    r = np.random.default_rng(3)
    images = [r.random((9, 11)) < 0.8, r.random((12, 7)) < 0.97, np.pad(np.ones((9, 9), bool), 1), np.eye(6, dtype=bool) | True]
    images[3][2:4, :] = False
    rows = [(k, int(y), int(x)) for k, g in enumerate(images) for y, x in zip(*np.nonzero(g))]
    sizes = spark.createDataFrame([(k, *g.shape) for k, g in enumerate(images)], "img_id long, h int, w int")
    got = {(d.img_id, d.y, d.x): d.straight + d.diagonal * 2**0.5 for d in raster.ink_distances(spark.createDataFrame(rows, "img_id long, y int, x int"), sizes).collect()}
    assert set(got) == set(rows)
    for k, y, x in rows:
        ways = [(abs(a - y), abs(b - x)) for a, b in zip(*np.nonzero(~images[k]))]
        assert abs(got[k, y, x] - min(max(w) - min(w) + min(w) * 2**0.5 for w in ways)) < 1e-9


def slow_colors(rgb, most_rounds=40):
    """(text colour, stroke colour) by loops over pixels."""
    rgb = np.asarray(rgb, float)
    if len(rgb) < 3:
        return [0, 0, 0], [255, 255, 255]
    best = None
    for restart in range(3):
        bits, share = raster.starts(restart)
        one = rgb[bits % len(rgb)]
        gap = np.cumsum(((rgb - one) ** 2).sum(axis=1))
        if gap[-1] == 0:
            return [0, 0, 0], [255, 255, 255]
        centers = [one, rgb[np.flatnonzero(gap >= gap[-1] * share)[0]]]
        for _ in range(most_rounds):
            off = np.stack([((rgb - c) ** 2).sum(axis=1) for c in centers])
            label, near = off.argmin(axis=0), off.min(axis=0)
            new = [rgb[label == k].mean(axis=0) if (label == k).any() else rgb[near.argmax()] for k in (0, 1)]
            counts, inertia = [max(1, int((label == k).sum())) for k in (0, 1)], round(near.sum(), 3)
            moved = sum(np.abs(a - b).sum() for a, b in zip(new, centers))
            centers = new
            if moved < 0.01:
                break
        if best is None or inertia < best[0]:
            best = inertia, centers, counts
    _, centers, counts = best
    pair = [np.floor(c + 0.5).astype(int).tolist() for c in centers]
    if sum(abs(a - b) for a, b in zip(*pair)) < 50:
        return [0, 0, 0], [255, 255, 255]
    return (pair[0], pair[1]) if counts[0] <= counts[1] else (pair[1], pair[0])


def test_two_colours(spark):
    r = np.random.default_rng(3)
    images = [[[10, 20, 30]] * 5 + [[200, 210, 220]] * 20, [[9, 9, 9]] * 30, [[9, 9, 9]] * 2, [[0, 0, 0], [255, 255, 255], [255, 255, 255]], [[5, 5, 5]] * 3 + [[9, 9, 9]]]
    images += [np.concatenate((r.normal(60, 9, (r.integers(3, 40), 3)), r.normal(190, 9, (r.integers(3, 40), 3)))).clip(0, 255).astype(int).tolist() for _ in range(12)]
    images += [r.integers(0, 255, (r.integers(3, 90), 3)).tolist() for _ in range(12)]
    rows = [(k, i // 7, i % 7, *p) for k, image in enumerate(images) for i, p in enumerate(image)]
    got = {x.img_id: (x.text_rgb, x.stroke_rgb) for x in raster.colors(spark.createDataFrame(rows, "img_id long, y int, x int, r int, gr int, b int").repartition(3)).collect()}
    for k, image in enumerate(images):
        assert got[k] == tuple(",".join(map(str, c)) for c in slow_colors(image)), k


def test_large_images_are_read_on_a_grid(spark):
    r = np.random.default_rng(9)
    rgb = np.where((np.arange(100) % 4 == 0)[:, None], r.integers(0, 60, (100, 3)), r.integers(180, 255, (100, 3)))
    rows = [(1, k // 10, k % 10, *map(int, rgb[k])) for k in range(100)]
    pixels = spark.createDataFrame(rows, "img_id long, y int, x int, r int, gr int, b int").repartition(3)
    got = raster.colors(pixels, most=25).first()
    some = np.array([c[3:] for c in rows if c[1] % 4 == 0 and c[2] % 4 == 0])
    want = slow_colors(some)
    assert (got.text_rgb, got.stroke_rgb) == tuple(",".join(map(str, c)) for c in want) and len(some) == 9


def slow_lines(text, room, size, widths):
    """Greedy lines, letter by letter."""
    wide = lambda x: sum(widths[ord(c)] if ord(c) < len(widths) else layout.USUAL for c in x) * size
    lines, line = [], ""
    for word in text.split():
        if wide(word) <= room:
            both = f"{line} {word}" if line else word
            if wide(both) <= room:
                line = both
            else:
                lines, line = [*lines, line], word
            continue
        lines, line = ([*lines, line] if line else lines), ""
        while wide(word) > room and len(word) > 1:
            n = max((i for i in range(1, len(word)) if wide(word[:i] + "-") <= room), default=1)
            lines, word = [*lines, word[:n] + "-"], word[n:]
        line = word
    return [*lines, line] if line else lines


def slow_fit(text, w, h, start, widths):
    words, size, lines = text.split(), start, []
    if not words:
        return start, []
    while size > 8:
        gap = size * 0.7 + int(size * 0.45)
        if len(words) == 1:
            stroke = max(2, int(size * 0.08))
            wide = sum(widths[ord(c)] if ord(c) < len(widths) else layout.USUAL for c in words[0])
            if wide * size / 1000 + 2 * stroke <= w * 1.5 and gap + 2 * stroke <= h * 1.2:
                return size, words
            size -= 2
            continue
        lines = slow_lines(text, w * 950.0, size, widths)
        if len(lines) * gap <= h * 0.95:
            break
        size -= 1
    return size, lines


def test_text_is_fitted_like_letter_by_letter(spark):
    r = random.Random(8)
    widths = [r.choice([250, 400, 520, 900]) for _ in range(256)]
    rows = [("", 50.0, 20.0, 30), ("one", 50.0, 40.0, 30), ("enormouslylongword", 10.0, 9.0, 12), ("a b", 1.0, 1.0, 9), ("a b", 100.0, 100.0, 8), ("word", 10.0, 10.0, 7), (None, 9.0, 9.0, 20), ("中文字 字", 30.0, 60.0, 25)]
    for _ in range(250):
        text = "".join(r.choice(["a", "b", "W", "i", " ", " ", "é", "\t", "-", "ß"]) for _ in range(r.randrange(0, 70)))
        rows.append((text, float(r.randrange(1, 300)), float(r.randrange(1, 150)), r.randrange(7, 45)))
    df = spark.createDataFrame(rows, "t string, w double, h double, s int").repartition(4)
    for x in df.select("*", layout.fit_text(F.col("t"), F.col("w"), F.col("h"), F.col("s"), widths).alias("f")).collect():
        assert (x.f["size"], x.f["lines"]) == slow_fit(x.t or "", x.w, x.h, x.s, widths), x


def test_html_of_bad_pages():
    tree = html.Tree('<p>x<b>y<script>var t="</p><a href=no>"</script><a href="/a?b=1">one <i>two</a><a>none</a><img data-src="q.jpg">')
    found = [(tree.elements[k].tag, tree.elements[k].attrs, tree.text(k)) for k in tree.select("a, img")]
    assert found == [("a", {"href": "/a?b=1"}, "one two"), ("a", {}, "none"), ("img", {"data-src": "q.jpg"}, "")]
    assert html.Tree(None).select("a") == [] and html.Tree("</p><br/></i>").select("*") == [0]


@pytest.mark.parametrize(
    ("selector", "ids"),
    [("div", "ad"), ("#b", "b"), (".x.y", "c"), ("div > p", "be"), ("div p", "bce"), ("div.k span", "f"), ("p > span, section p", "cf"), ('[title*="mid"]', "e"), ("section > .x", "c"), ("div > span", "")],
)
def test_selectors(selector, ids):
    tree = html.Tree('<div id=a><p id=b></p><section><p id=c class="y x z"></p></section></div><div id=d class="j k"><p id=e title="amidst"><span id=f></span></p></div>')
    assert "".join(tree.elements[k].attrs["id"] for k in tree.select(selector)) == ids


def test_selectors_that_cannot_be_read():
    for bad in ("a:first", "", "a,", "a + b"):
        with pytest.raises(ValueError):
            html.Tree("<a>").select(bad)


@settings(max_examples=80, deadline=None)
@given(st.text("abc,/é中", max_size=30), st.lists(st.integers(0, 9), max_size=4))
def test_unscrambling_undoes_swaps(plain, keys):
    chars = list(plain)
    for key in keys:
        for i in range(key, len(chars)):
            if i % 2:
                chars[i - key], chars[i] = chars[i], chars[i - key]
    mixed, places = "".join(map(str, keys)) + "".join(chars), tuple(range(len(keys)))
    assert html.unscramble_list([mixed, mixed], [places, (99,)]) == [plain if keys else mixed, mixed]


def test_unscrambling_cuts_places_in_their_order(spark):
    rows = spark.createDataFrame([("a1b0c", [3, 1]), ("ab", [0]), (None, [0]), ("1", None), ("x00y", [1, 2, 1])], "t string, p array<int>")
    got = [r[0] for r in rows.select(html.unscramble("t", "p")).collect()]
    assert got == ["abc", "ab", None, None, "xy"] or got[0] == html.unscramble_list(["a1b0c"], [(3, 1)])[0] and got[1:] == ["ab", None, None, "xy"]


def test_scripts_are_decoded(spark):
    coded = html.SCRIPT_HEAD + "p" * (240 - len(html.SCRIPT_HEAD)) + "x104yy233Z20013" + "!" * 59
    got = spark.createDataFrame([(coded,), ("plain",), (None,), (html.SCRIPT_HEAD,)], "s string").select(html.decoded_script("s")).collect()
    assert [r[0] for r in got] == ["hé中", "plain", None, ""]


# kernels


def slow_square(image, y, x, reach):
    h, w = image.shape
    return [image[min(h - 1, max(0, y + a)), min(w - 1, max(0, x + b))] for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]


@pytest.fixture(scope="module")
def pictures():
    r = np.random.default_rng(8)
    smooth = (np.add.outer(np.sin(np.arange(40) / 5), np.cos(np.arange(30) / 3)) * 60 + 128).astype(np.uint8)
    return [r.integers(0, 256, (17, 23)).astype(np.uint8), smooth, np.zeros((5, 9), np.uint8), np.full((1, 1), 7, np.uint8), np.kron(r.integers(0, 2, (6, 5)), np.full((7, 6), 200)).astype(np.uint8)]


def test_median_and_dilation_by_brute_force(pictures):
    for p in pictures:
        h, w = p.shape
        assert (kernels.median3(p) == [[sorted(slow_square(p, y, x, 1))[4] for x in range(w)] for y in range(h)]).all()
        assert (kernels.dilate(p, 5, 2) == [[p[max(0, y - 4) : y + 5, max(0, x - 4) : x + 5].max() for x in range(w)] for y in range(h)]).all()


def test_canny_by_brute_force(pictures):
    for p in pictures:
        h, w = p.shape
        grad = {}
        for y in range(h):
            for x in range(w):
                s = [int(v) for v in slow_square(p, y, x, 1)]
                grad[y, x] = s[2] + 2 * s[5] + s[8] - s[0] - 2 * s[3] - s[6], s[6] + 2 * s[7] + s[8] - s[0] - 2 * s[1] - s[2]
        power = lambda y, x: sum(map(abs, grad.get((y, x), (0, 0))))  # noqa: E731, B023
        ridge = set()
        for (y, x), (dx, dy) in grad.items():
            a, b = abs(dx), abs(dy) * 32768
            if b < a * 13573:
                one, two, firm = (y, x - 1), (y, x + 1), False
            elif b > a * 13573 + a * 65536:
                one, two, firm = (y - 1, x), (y + 1, x), False
            else:
                s = -1 if (dx < 0) != (dy < 0) else 1
                one, two, firm = (y - 1, x - s), (y + 1, x + s), True
            m = power(y, x)
            if m > 30 and m > power(*one) and (m > power(*two) if firm else m >= power(*two)):
                ridge.add((y, x))
        found = {q for q in ridge if power(*q) > 100}
        todo = list(found)
        while todo:
            y, x = todo.pop()
            new = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & ridge - found
            found |= new
            todo += new
        assert set(zip(*np.nonzero(kernels.canny(p, 30, 100)))) == found


def test_holes_are_filled():
    ring = np.zeros((9, 11), bool)
    ring[2:7, 2:8] = True
    ring[3:6, 3:7] = False
    ring[4, 4] = True
    want = ring.copy()
    want[2:7, 2:8] = True
    assert (kernels.filled(ring) == want).all()
    ring[2, 4] = False  # a gap lets the background in
    assert (kernels.filled(ring) == ring).all()
    cross = np.zeros((5, 5), bool)
    cross[[1, 2, 2, 3], [2, 1, 3, 2]] = True
    assert kernels.filled(cross).sum() == 5  # corners close a hole


def test_resizing_and_contrast(pictures):
    for p in pictures:
        assert (kernels.resize(p, *p.shape) == p).all()
        flat = np.full(p.shape, 90, np.uint8)
        assert (kernels.resize(flat, 2 * len(p), 7) == 90).all()
        out = kernels.equalize(p)
        assert out.shape == p.shape and out.dtype == np.uint8
    assert np.ptp(kernels.equalize(pictures[1] // 8).astype(int)) > np.ptp(pictures[1] // 8)
    wide = kernels.resize(pictures[1], 80, 60).astype(int)
    assert np.abs(wide[::2, ::2] - pictures[1]).max() < 12


def test_crops_and_masks(pictures):
    p = pictures[0]
    assert kernels.crop(p, -3, 2, 5, 99).shape == (15, 5) and kernels.crop(p, 9, 9, 3, 3).size == 0
    assert not kernels.text_mask(p, [(0, 0, -9, 3)]).any() and kernels.text_mask(p, [(4, 4, 12, 12)])[0:17, 20:].sum() == 0
    rgb = np.stack([p, p, p], axis=2)
    assert (kernels.gray(rgb) == p).all() and (kernels.gray(p) == p).all()


def test_images_without_pixels(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1, bytearray()), (2, None, None, None, None), (3, 1, 2, 1, bytearray(b"ab"))], kernels.IMAGE)
    assert {(r.img_id, r.h, r.w) for r in kernels.each_image(rows, kernels.median3).collect()} == {(1, 0, 0), (3, 1, 2)}
    assert kernels.row_activity(rows).count() == 1 and kernels.pixels(rows).count() == 2


def test_safe_names(spark):
    row = spark.createDataFrame([("  a/b  c\td:" + "z" * 200,)], "s string")
    got = row.select(X.safe_title(F.col("s")), X.safe_chapter(F.col("s")), X.zero_filled(F.lit(1234)), X.zero_filled(F.lit(7))).first()
    assert got[0].startswith("a_b  c\td_z") and got[1].startswith("a_b c d_z") and len(got[0]) == 100 and tuple(got)[2:] == ("1234", "007")


# settings, files, sites, named functions


def test_settings_take_what_is_there():
    class Given:
        URLMANGA = ["a", " ", "b"]
        FONT_PATH = "f"
        OTHER = 1

    got = config.Settings.of(Given)
    assert got.listed == ("a", "b") and got.direct == () and got.fonts()["sfx"] == "f/sound.ttf" and got.outer_texts == 25
    assert config.Settings.of(object()) == config.Settings()
    read = config.Recognizer.of({"Global": {"text_score": 0.7, "new": 1}, "Det": {"box_thresh": 1}})
    assert read.text_score == 0.7 and read.min_height == 30 and read.sections == {"Global": {"new": 1}, "Det": {"box_thresh": 1}}


def test_sizes_from_first_bytes():
    assert files.size_of(b"") is None and files.size_of(b"\xff\xd8\xff\xd9") is None and files.size_of(b"\x89PNG\r\n\x1a\n") is None
    extended = b"RIFF....WEBPVP8X" + bytes(8) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")
    lossless = b"RIFF....WEBPVP8L" + bytes(5) + ((99) | (49 << 14)).to_bytes(4, "little") + bytes(9)
    assert files.size_of(extended) == (640, 480) and files.size_of(lossless) == (100, 50)


def test_sites_by_domain(spark):
    sites = registry.Registry().add(registry.link_site("one", ("one.example",), "https://one.example"), registry.table_site("two", ("two.example", "deux.example"), "read.example"))
    assert sites.site_of("HTTPS://WWW.Deux.example/x").name == "two" and sites.site_of("https://none") is None
    urls = spark.createDataFrame([(1, "https://one.example/m"), (2, "https://two.example/m"), (3, "https://none/m")], "page_id long, url string")
    text = {1: '<p class="list-group"><a href="/c">x</a></p><img class="d-block" src="i.png">', 2: '<table id="chapter_table"><tbody><tr><td><a class="chico" href="/chapter/1">N</a></td></tr></tbody></table>', 3: "<a>"}
    landed = lambda u: u.join(spark.createDataFrame(list(text.items()), "page_id long, html string"), "page_id")
    assert {tuple(r) for r in sites.read("chapter_list", urls, landed).collect()} == {(1, 0, "https://one.example/c", "Unknown_Chapter"), (2, 0, "https://read.example/chapter/1", "N")}
    assert [tuple(r) for r in sites.read("page_list", urls, landed).collect()] == [(1, 0, "https://one.example/i.png")]
    with pytest.raises(ValueError):
        registry.Registry().add(registry.Site("none", ()))


def test_named_functions(spark):
    rows = lines(spark, [(0, 0, 100, 20, 0.0), (0, 30, 100, 50, 0.0), (0, 67, 100, 87, 0.0)])
    got = {r.line_no: (r.cluster, r.rank, r.block_no) for r in api.cluster_boxes(rows).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 1, 0), 2: (2, 0, 1)}
    assert len({r.cluster for r in api.cluster_boxes(rows.drop("angle"), max_gap_px=17).collect()}) == 1
    assert len({r.cluster for r in api.cluster_boxes(rows, max_size_ratio=-1, max_gap_px=-5, max_gap_ratio=-1).collect()}) == 3  # limits are clamped
    size = lambda *a, **k: api.estimate_font_size(*(F.lit(float(x)) for x in a), **k)
    row = spark.range(1).select(size(0, 0, 100, 50), size(5, 1, 0, 50), size(4, 1, 400, 50), size(60, 9, 100, 50), size(60, 9, 100, 50, base_font_size=F.lit(500.0)), api.safe_padding(F.lit(100.0)), api.safe_padding(F.lit(-3.0), stroke_ratio=2.0)).first()
    assert row[:2] == (45.0, 8.0) and abs(row[2] - 50 * 0.95 / 1.2) < 1e-9 and row[3] == row[4]
    best, fits = row[3], lambda s: -(-60 // 1) and np.ceil(60 / max(95 / (0.52 * s), 1)) * 1.2 * s <= 47.5
    assert fits(best) and not fits(best * 1.0001)
    assert tuple(row[5]) == (30.0,) * 4 and tuple(row[6]) == (15.0,) * 4


def test_named_functions_take_limits(spark):
    r = np.random.default_rng(4)
    ink = [(1, y, x, 20 if 3 <= y < 9 and 2 <= x < 14 and r.random() < 0.8 else 230) for y in range(12) for x in range(16)]
    pixels = spark.createDataFrame(ink, "img_id long, y int, x int, g int")
    assert api.analyze(pixels, bold_ink_density=2.0, bold_stroke_ratio=9.0).first().is_bold is False and api.analyze(pixels, bold_ink_density=0.1).first().is_bold is True
    rgb = spark.createDataFrame([(1, y, x, *((10, 0, 0) if x < 2 else (200, 210, 220))) for y in range(4) for x in range(6)], "img_id long, y int, x int, r int, gr int, b int")
    assert api.detect_colors(rgb).first()[1:] == ("10,0,0", "200,210,220") and api.detect_colors(rgb, min_contrast=1e4).first()[1:] == ("0,0,0", "255,255,255")


def test_failed_units_are_kept_apart(spark):
    good, bad = files.split_failed(spark.range(5), F.when(F.col("id") > 2, "large"))
    assert good.count() == 3 and [r.problem for r in bad.collect()] == ["large", "large"]


def test_pages_by_partition(spark, tmp_path):
    for n in (3, 2):
        archive.write_pages(spark.createDataFrame([("t", "c1", i) for i in range(n)], "title string, chapter string, i int"), f"file://{tmp_path}/out")
    archive.write_pages(spark.createDataFrame([("t", "c2", 9)], "title string, chapter string, i int"), f"file://{tmp_path}/out")
    assert sorted((r.chapter, r.i) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("c1", 0), ("c1", 1), ("c2", 9)]


def test_scratch_tables_are_deleted(spark):
    kept = storage.materialize(spark.range(3), "kept")
    with storage.scratch(spark):
        gone = storage.materialize(spark.range(3), "gone")
        assert gone.count() == 3
    assert kept.count() == 3 and not any("gone" in p for p in storage._WRITTEN)
    storage.drop_table(kept)
    with pytest.raises(Exception, match="kept"):
        kept.count()


# decryption


def test_decryption_gives_the_published_vectors(spark):
    """The CBC examples of NIST SP 800-38A for keys of 128, 192 and 256 bits."""
    text = "6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411e5fbc1191a0a52eff69f2445df4f9b17ad2b417be66c3710"
    sealed = {
        "2b7e151628aed2a6abf7158809cf4f3c": "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b273bed6b8e3c1743b7116e69e222295163ff1caa1681fac09120eca307586e1a7",
        "8e73b0f7da0e6452c810f32b809079e562f8ead2522c6b7b": "4f021db243bc633d7178183a9fa071e8b4d9ada9ad7dedf4e5e738763f69145a571b242012fb7ae07fa9baac3df102e008b0e27988598881d920a9e64f5615cd",
        "603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4": "f58c4c04d6e5f1ba779eabfb5f7bfbd69cfc4e967edb808d679f777bc6702c7d39f23369a9d9bacfa530e26304231461b2eb05e2c39be9fcda6c19078c6a9d1b",
    }
    iv = "000102030405060708090a0b0c0d0e0f"
    rows = [(key, iv, x[: 32 * n], text[: 32 * n]) for key, x in sealed.items() for n in (1, 2, 4)]
    rows += [("2b7e", iv, "00" * 16, None), (rows[0][0], "00", "00" * 16, None), (rows[0][0], iv, "00" * 15, None), (rows[0][0], iv, "", None), (None, iv, "00" * 16, None), (rows[0][0], iv, None, None)]
    df = spark.createDataFrame(rows, "k string, v string, x string, want string")
    got = df.select(F.lower(F.hex(html.decrypted_bytes(F.unhex("x"), F.unhex("k"), F.unhex("v")))).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_encoded_pages_find_their_scripts(spark):
    key, iv = "2b7e151628aed2a6abf7158809cf4f3c", "000102030405060708090a0b0c0d0e0f"
    sealed = spark.sql(f"SELECT base64(substring(aes_encrypt(concat(encode('a.jpg,,b.jpg', 'utf-8'), x'00000000'), unhex('{key}'), 'CBC', 'PKCS', unhex('{iv}')), 17, 16))").first()[0]
    script = f'var key = CryptoJS.enc.Hex.parse("{key}");var iv = CryptoJS.enc.Hex.parse("{iv}");'
    lists = f"<script>var imgsrcs = '{sealed}';</script>"
    file = '<script src="/j/chapter.js"></script>'
    pages = [(1, file + lists), (2, lists + "<script src='/j/chapter.js'></script><script src='/j/other/chapter.js'></script>"), (3, lists), (4, file), (5, lists + '<script src="/gone/chapter.js"></script>'), (6, lists + '<script src="/keyless/chapter.js"></script>'), (7, file + "<script>imgsrcs</script>" + lists), (8, None)]
    scripts = spark.createDataFrame([("https://h/j/chapter.js", script), ("https://h/j/chapter.js", script), ("https://h/keyless/chapter.js", "var iv"), ("https://h/none/chapter.js", None)], "url string, script string")
    got = html.encoded_pages(spark.createDataFrame([(i, "https://h/p", x) for i, x in pages], "page_id long, url string, html string"), scripts).collect()
    assert sorted(tuple(r) for r in got) == [(p, i, u) for p in (1, 2) for i, u in ((0, "a.jpg"), (2, "b.jpg"))]


def test_sites_are_discovered(spark, tmp_path, monkeypatch):
    folder = tmp_path / "found_sites"
    folder.mkdir()
    (folder / "__init__.py").write_text("")
    (folder / "b_two.py").write_text("DOMAINS = ['two.example', 'one.example']\nfrom panelspark.sources import html\npage_list = html.images\n")
    (folder / "a_one.py").write_text("DOMAINS = ('one.example',)\n")
    (folder / "c_none.py").write_text("x = 1\n")
    (folder / "d_broken.py").write_text("raise RuntimeError('broken')\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning) as told:
        sites = registry.discover("found_sites")
    assert sorted(str(w.message).split()[2] for w in told) == ["c_none", "d_broken"]
    assert sites.site_of("http://one.example/").name == "b_two" and sites.site_of("http://two.example/").chapter_list is None
    urls = spark.createDataFrame([(1, "http://two.example/a"), (2, "http://else/")], "page_id long, url string")
    landed = lambda u: u.withColumn("html", F.lit("<img class='d-block' src='/i.png'>"))
    assert [tuple(r) for r in sites.read("page_list", urls, landed).collect()] == [(1, 0, "http://two.example/i.png")]
    assert sites.read("chapter_list", urls, landed).collect() == []


def test_settings_are_read_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("Global:\n    text_score: 0.7\n    model_root_dir: null\nDet:\n    engine:\n        threads: -1\n")
    read = config.Recognizer.read(spark, f"file://{tmp_path}/c.yaml")
    assert read.text_score == 0.7 and read.min_height == 30 and read.sections == {"Global": {"model_root_dir": None}, "Det": {"engine": {"threads": -1}}}
    (tmp_path / "e.yaml").write_text("")
    assert config.Recognizer.read(spark, f"file://{tmp_path}/e.yaml") == config.Recognizer.of({})
