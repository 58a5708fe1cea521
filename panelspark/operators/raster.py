"""Raster operators over pixels in long form (img_id, y, x, g), and kernels that need a whole small image.

Aggregations stay in SQL form: their partial sums are small whatever the number of pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shear angles tried in degrees, least ink, percentile and style limits.
ANGLES, LEAST_INK, PERCENTILE, ITALIC_DEG, BOLD_RATIO, BOLD_DENSITY = range(-24, 25), 16, 0.60, 10, 0.15, 0.40


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img_id", "g").agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(img_id, threshold): the gray level with the greatest variance between classes, the least of equals. Images
    of one gray level have none. The window runs over an image's histogram: 256 rows at most."""
    h = histogram(pixels)
    w = Window.partitionBy("img_id")
    up = w.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("img_id", "g", F.sum("n").over(up).cast("double").alias("wb"), F.sum(F.col("g") * F.col("n")).over(up).cast("double").alias("sb"), F.sum("n").over(w).cast("double").alias("total"), F.sum(F.col("g") * F.col("n")).over(w).cast("double").alias("all"))
    wf = F.col("total") - F.col("wb")
    diff = F.col("sb") / F.col("wb") - (F.col("all") - F.col("sb")) / wf
    h = h.where(wf > 0).withColumn("var", F.col("wb") * wf * diff * diff)
    return h.where("var > 0").groupBy("img_id").agg(F.max_by("g", F.struct("var", -F.col("g"))).alias("threshold"))


def ink(pixels: DataFrame) -> DataFrame:
    """The pixels of the minority class: the dark ones if they are at most half."""
    counted = pixels.join(otsu(pixels), "img_id")
    dark = counted.groupBy("img_id").agg(F.max("threshold").alias("threshold"), (F.count_if(F.col("g") <= F.col("threshold")) <= F.floor(F.count("*") / 2)).alias("dark_ink"))
    return pixels.join(dark, "img_id").where((F.col("g") <= F.col("threshold")) == F.col("dark_ink")).select("img_id", "y", "x")


def ink_box(inked: DataFrame) -> DataFrame:
    dy, dx = F.max("y") - F.min("y") + 1, F.max("x") - F.min("x") + 1
    return inked.groupBy("img_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.count("*").alias("n_ink"), (F.count("*") / F.greatest(dy * dx, F.lit(1))).alias("density"))


def longest_run(inked: DataFrame) -> DataFrame:
    """The most consecutive rows with ink: islands of y minus the row's number."""
    rows = inked.select("img_id", "y").distinct()
    island = F.col("y") - F.row_number().over(Window.partitionBy("img_id").orderBy("y"))
    return rows.withColumn("island", island).groupBy("img_id", "island").agg(F.count("*").alias("n")).groupBy("img_id").agg(F.max("n").alias("line_height"))


def _slants(ids: np.ndarray, y: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Of n images the shear angle whose column profile is the most peaked. ``ids`` are the images of the points, in order."""
    best, score = np.zeros(n, np.int32), np.full(n, -1)
    for angle in ANGLES:
        column = (x + float(np.tan(np.radians(angle))) * y).astype(np.int64)
        low = column.min(initial=0)
        cell, counts = np.unique(ids * (column.max(initial=0) - low + 1) + column - low, return_counts=True)
        own = cell // (column.max(initial=0) - low + 1)
        sums = np.zeros(n, np.int64)
        np.add.at(sums, own, counts.astype(np.int64) ** 2)
        best, score = np.where(sums > score, angle, best), np.maximum(score, sums)
    return np.where(np.bincount(ids, minlength=n) < LEAST_INK, 0, best).astype(np.int32)


def slant(inked: DataFrame) -> DataFrame:
    """The shear angle whose column profile is the most peaked; the least of equals; 0 with little ink.

    An image's ink is one row, and rows come in Arrow batches, in which columns are counted angle by angle: what a task holds is a
    batch's points. Columns of all angles as groups would be many times the ink, all in one task's table."""
    rows = inked.groupBy("img_id").agg(F.collect_list(F.struct("y", "x")).alias("points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("points")
            flat, ends = points.flatten(), np.asarray(points.offsets)
            y, x = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "x"))
            found = _slants(np.repeat(np.arange(batch.num_rows), np.diff(ends)), y, x, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("img_id"), pa.array(found, pa.int32())], ["img_id", "slant"])

    return rows.mapInArrow(run, T.StructType([rows.schema["img_id"], T.StructField("slant", T.IntegerType())]))


def row_stats(pixels: DataFrame) -> DataFrame:
    """Per pixel row: population deviation and the share of pixels that differ from their left neighbour by over 50."""
    left = F.lag("g").over(Window.partitionBy("img_id", "y").orderBy("x"))
    edge = F.coalesce(F.abs(F.col("g") - left) > 50, F.lit(False))
    return pixels.withColumn("edge", edge).groupBy("img_id", "y").agg(F.stddev_pop("g").alias("row_std"), (F.count_if("edge") / F.count("*")).alias("edge_density"))


def ink_distances(inked: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img_id, y, x, straight, diagonal) of ink: the steps of a shortest way to the nearest pixel without ink, where a diagonal
    step is as long as the square root of 2; the border is no background.

    In each row the nearest background pixel is a running maximum from either side. Of all rows only those can be nearer
    that are no farther up or down than that pixel, so a pixel looks at as many rows as its stroke is wide, not at all."""
    rows = inked.select("img_id", "y", "x", F.lit(True).alias("ink"))
    grid = sizes.select("img_id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), "w", "h")
    grid = grid.select("img_id", "y", "h", "w", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    all_ = grid.join(rows, ["img_id", "y", "x"], "left").withColumn("bare", F.when(F.col("ink").isNull(), F.col("x")))
    row = Window.partitionBy("img_id", "y").orderBy("x")
    left = F.col("x") - F.max("bare").over(row.rowsBetween(Window.unboundedPreceding, 0))
    right = F.min("bare").over(Window.partitionBy("img_id", "y").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("x")
    across = all_.withColumn("across", F.least(left, right)).select("img_id", "y", "x", "h", "w", "ink", "across")
    reach = F.coalesce("across", F.col("h") + F.col("w"))
    look = across.where("ink").select("img_id", "y", "x", F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - reach), F.least(F.col("h") - 1, F.col("y") + reach))).alias("row"))
    near = across.where("across is not null").select("img_id", F.col("y").alias("row"), "x", "across")
    met = look.join(near, ["img_id", "row", "x"])
    up = F.abs(F.col("y") - F.col("row"))
    way = F.struct((F.greatest("across", up) - F.least("across", up) + F.least("across", up) * F.lit(2**0.5)).alias("far"), (F.greatest("across", up) - F.least("across", up)).alias("straight"), F.least("across", up).alias("diagonal"))
    # by number, as few bytes are many rows here and would be gathered into few tasks; what follows goes by image too
    met = met.repartition(int(inked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "img_id")
    return met.groupBy("img_id", "y", "x").agg(F.min(way).alias("way")).select("img_id", "y", "x", "way.straight", "way.diagonal")


def stroke_width(inked: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img_id, stroke): twice the 60th index percentile of ink distances. They are counted by length first: there are few
    lengths, however many pixels."""
    far = F.col("straight") + F.col("diagonal") * F.lit(2**0.5)
    counts = ink_distances(inked, sizes).groupBy("img_id", far.alias("far")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("img_id").orderBy("far").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy("img_id"))
    place = F.least((total * PERCENTILE).cast("long"), total - 1)
    return counts.withColumns({"upto": upto, "place": place}).where("upto > place").groupBy("img_id").agg((2 * F.min("far")).alias("stroke"))


def styles(pixels: DataFrame, italic_deg: float = ITALIC_DEG, bold_ratio: float = BOLD_RATIO, bold_density: float = BOLD_DENSITY) -> DataFrame:
    """(img_id, is_italic, is_bold) from slant, stroke, line height and density; images without enough ink have neither."""
    sizes = pixels.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    inked = ink(pixels)
    found = ink_box(inked).join(slant(inked), "img_id").join(longest_run(inked), "img_id").join(stroke_width(inked, sizes), "img_id")
    enough = F.col("n_ink") >= LEAST_INK
    ratio = F.when(F.col("line_height") > 1, F.col("stroke") / F.col("line_height")).otherwise(0.0)
    return sizes.join(found, "img_id", "left").select("img_id", F.coalesce(enough & (F.abs("slant") >= italic_deg), F.lit(False)).alias("is_italic"), F.coalesce(enough & ((ratio >= bold_ratio) | (F.col("density") >= bold_density)), F.lit(False)).alias("is_bold"))


class Mixer:
    """The 64-bit counter generator whose constants are fixed values; doubles are in [0, 1)."""

    ADD, ONE, TWO, MASK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1

    def __init__(self, seed: int):
        self.state = seed & self.MASK

    def bits(self) -> int:
        self.state = z = (self.state + self.ADD) & self.MASK
        z = (z ^ (z >> 30)) * self.ONE & self.MASK
        z = (z ^ (z >> 27)) * self.TWO & self.MASK
        return z ^ (z >> 31)

    def unit(self) -> float:
        return (self.bits() >> 11) / (1 << 53)


def starts(restart: int) -> tuple[int, float]:
    """The whole number that chooses a restart's first pixel and the share of the squared distances that chooses its second."""
    source = Mixer(Mixer.ADD ^ ((restart + 1) * Mixer.ONE))
    return source.bits(), source.unit()


def two_means(rgb: np.ndarray, rounds: int = 40, restarts: int = 3) -> tuple[np.ndarray, list[int]]:
    """(centres, pixels of each) of the best of some restarts of two-means over pixels in order. The first centre is chosen by
    number, the second by share of the squared distances to the first; a mean that has no pixel is set to the one farthest from
    its own. Restarts that are equal to a thousandth are equal, so that the order of sums does not matter."""
    best: tuple[float, np.ndarray, list[int]] | None = None
    for restart in range(max(1, restarts)):
        bits, share = starts(restart)
        first = rgb[bits % len(rgb)]
        upto = np.cumsum(((rgb - first) ** 2).sum(axis=1))
        second = rgb[min(int(np.searchsorted(upto, upto[-1] * share)), len(rgb) - 1)] if upto[-1] > 0 else first
        centres, counts, inertia = np.stack((first, second)), [0, 0], 0.0
        for _ in range(max(1, rounds)):
            off = ((rgb[None] - centres[:, None]) ** 2).sum(axis=2)
            label, near = off[0] > off[1], off.min(axis=0)
            means = [rgb[label == k].mean(axis=0) if (label == k).any() else rgb[near.argmax()] for k in (False, True)]
            counts, inertia = [max(1, int((label == k).sum())) for k in (False, True)], round(float(near.sum()), 3)
            moved = np.abs(np.stack(means) - centres).sum()
            centres = np.stack(means)
            if moved < 0.01:
                break
        if best is None or inertia < best[0]:
            best = inertia, centres, counts
    assert best is not None
    return best[1], best[2]


def color_pair(rgb: np.ndarray, rounds: int = 40, restarts: int = 3, contrast: float = 50.0) -> tuple[list[int], list[int]]:
    """(text colour, stroke colour): the rarer mean is the text's; black on white where both are too near or few pixels."""
    if len(rgb) >= 3:
        centres, counts = two_means(rgb.astype(np.float64), rounds, restarts)
        pair = np.floor(centres + 0.5).clip(0, 255).astype(int)
        if np.abs(pair[0] - pair[1]).sum() >= contrast:
            text = 0 if counts[0] <= counts[1] else 1
            return pair[text].tolist(), pair[1 - text].tolist()
    return [0, 0, 0], [255, 255, 255]


def colors(pixels: DataFrame, most: int = 20_000, rounds: int = 40, restarts: int = 3, contrast: float = 50.0) -> DataFrame:
    """(img_id, text_rgb, stroke_rgb) of (img_id, y, x, r, gr, b).

    Images of more than ``most`` pixels are read on a grid of that stride in both directions, which is the operator's own
    rule: so an image is one row with an array of less than twice ``most`` pixels, and rows come in Arrow batches. Two-means
    as a fold of Catalyst gives the same pairs and takes several times as long."""
    n = pixels.groupBy("img_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("stride"))
    some = pixels.join(n, "img_id").where((F.col("y") % F.col("stride") == 0) & (F.col("x") % F.col("stride") == 0))
    rows = some.groupBy("img_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "r", "gr", "b"))).alias("points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("points")
            flat, ends = points.flatten(), np.asarray(points.offsets) - points.offsets[0].as_py()
            rgb = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("r", "gr", "b")], axis=1) if len(flat) else np.zeros((0, 3))
            pairs = [color_pair(rgb[a:b], rounds, restarts, contrast) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("img_id"), *(pa.array([",".join(map(str, p[k])) for p in pairs], pa.string()) for k in (0, 1))], ["img_id", "text_rgb", "stroke_rgb"])

    return rows.mapInArrow(run, T.StructType([rows.schema["img_id"], T.StructField("text_rgb", T.StringType()), T.StructField("stroke_rgb", T.StringType())]))
