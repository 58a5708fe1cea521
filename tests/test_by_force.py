"""Queries that SQL cannot express, against slow versions of their rules over whole small tables."""

import math

import numpy as np
import pytest

from panelspark.functions import text as X
from panelspark.operators import kernels, raster
from panelspark.plans import imaging, kernels as plans, records
from panelspark.sources import landed as L

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiles(spark):
    found = {}
    for r in L.tiles(spark, SMALL).collect():
        found.setdefault(r.img_id, np.zeros((8, 8), int))[r.y, r.x] = r.g
    return found


@pytest.fixture(scope="module")
def strips(spark):
    found = {}
    for r in L.strips(spark, SMALL).collect():
        found.setdefault(r.img_id, {})[r.y, r.x] = r.g
    return {k: np.array([[v[y, x] for x in range(64)] for y in range(len(v) // 64)], np.uint8) for k, v in found.items()}


def threshold(g):
    best, at = 0.0, None
    for t in range(256):
        low, high = g[g <= t], g[g > t]
        if len(low) and len(high):
            score = len(low) * len(high) * (low.mean() - high.mean()) ** 2
            if score > best + 1e-9:
                best, at = score, t
    return at


def inked(g):
    t = threshold(g)
    if t is None:
        return None
    dark = g <= t
    return dark if dark.sum() <= g.size // 2 else ~dark


def stroke(ink):
    """Twice the 60th index percentile of the least path lengths to the background."""
    far = np.full(ink.shape, np.inf)
    far[~ink] = 0
    for _ in range(ink.size):
        before = far.copy()
        for y, x in zip(*np.nonzero(ink)):
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (a or b) and 0 <= y + a < 8 and 0 <= x + b < 8:
                        far[y, x] = min(far[y, x], far[y + a, x + b] + math.hypot(a, b))
        if (before == far).all():
            break
    d = sorted(far[ink])
    return 2 * d[min(int(len(d) * 0.6), len(d) - 1)]


def test_stroke_width(spark, tiles):
    got = {r.img_id: r.stroke for r in imaging.stroke_width(spark, SMALL).collect()}
    want = {k: stroke(inked(g)) for k, g in tiles.items() if inked(g) is not None}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_style_flags(spark, tiles):
    got = {r.img_id: (r.is_italic, r.is_bold) for r in imaging.style_flags(spark, SMALL).collect()}
    assert set(got) == set(tiles)
    for k, g in tiles.items():
        ink = inked(g)
        if ink is None or ink.sum() < 16:
            assert got[k] == (False, False)
            continue
        y, x = np.nonzero(ink)
        scores = {}
        for a in range(-24, 25):
            column = np.trunc(x + math.tan(math.radians(a)) * y).astype(int)
            scores[a] = sum(int((column == c).sum()) ** 2 for c in set(column.tolist()))
        slant = min(a for a in scores if scores[a] == max(scores.values()))
        run = longest = 0
        for row in ink.any(axis=1):
            run = run + 1 if row else 0
            longest = max(longest, run)
        ratio = stroke(ink) / longest if longest > 1 else 0
        density = ink.sum() / max(1, (np.ptp(y) + 1) * (np.ptp(x) + 1))
        assert got[k] == (abs(slant) >= 10, ratio >= 0.15 or density >= 0.4)


def test_whole_image_queries(spark, strips):
    active = {(r.img_id, r.y): (r.row_std, r.edge_density) for r in plans.row_activity(spark, SMALL).collect()}
    assert len(active) == sum(map(len, strips.values()))
    masks = {r.img_id: r.total for r in plans.text_masks(spark, SMALL).collect()}
    ready = {r.img_id: (r.h, r.w) for r in plans.prepared(spark, SMALL).collect()}
    for k, g in strips.items():
        edges = kernels.canny(g, 30, 100)
        for y in range(len(g)):
            assert active[k, y][0] == pytest.approx(g[y].astype(float).std(), abs=1e-5) and active[k, y][1] == pytest.approx(edges[y].mean(), abs=1e-8)
        assert masks[k] == kernels.text_mask(g, [(2, 2, 30, 12), (20, 5, 50, 14), (60, 3, 62, 4)]).sum()
        assert ready[k] == (2 * len(g), 128)


def test_separator_is_the_settings_own():
    from panelspark.config import Settings

    assert Settings().separator == X.SEPARATOR


def test_counter_generator_gives_the_published_numbers():
    source = raster.Mixer(1234567)
    assert [source.bits() for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]
    assert all(0 <= raster.Mixer(s).unit() < 1 for s in range(50))
