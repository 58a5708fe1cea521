"""Queries over whole images: what prepares pages for recognition and masks their text."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import kernels as K
from panelspark.sources import landed as L


def _images(spark, d):
    return K.from_pixels(L.strips(spark, d))


def _digest(images):
    """An image's size and two sums over its pixels, which tell places apart."""
    place = (F.col("y") * 1000 + F.col("x")).cast("long")
    return K.pixels(images).groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.sum("g").alias("total"), F.sum(place * F.col("g")).alias("weighted"))


def crop(spark, d):
    k = F.col("img_id")
    boxed = _images(spark, d).withColumns({"x1": (k % 7 - 3).cast("int"), "y1": (k % 5 - 2).cast("int"), "x2": (20 + k % 60).cast("int"), "y2": (6 + k % 20).cast("int")})
    return _digest(K.each_image(boxed, K.crop, "x1", "y1", "x2", "y2"))


def median_blur(spark, d):
    return K.pixels(K.each_image(_images(spark, d), K.median3))


def dilate(spark, d):
    """Dark pixels, widened twice by squares of five."""
    return _digest(K.each_image(_images(spark, d), lambda g: K.dilate((g < 40).astype("uint8"), 5, 2)))


def stack(spark, d):
    """Four images each, below each other."""
    return _digest(K.stacked(_images(spark, d).withColumn("strip", F.floor(F.col("img_id") / 4)), "strip", "img_id"))


def row_slice(spark, d):
    images = _images(spark, d)
    cuts = images.select("img_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part")).withColumns({"y1": F.col("part") * 6 - 2, "y2": F.col("part") * 6 + 4})
    parts = K.row_slices(images, cuts).where("h > 0").withColumn("img_id", F.col("img_id") * 10 + F.col("part"))
    return _digest(parts)


def prepared(spark, d):
    """An image as it goes to recognition: twice the size, equalised, smoothed."""
    ready = K.each_image(_images(spark, d), lambda g: K.median3(K.equalize(K.resize(g, 2 * g.shape[0], 2 * g.shape[1]))))
    return ready.select("img_id", "h", "w", F.crc32("data").alias("crc32"))


def row_activity(spark, d):
    return K.row_activity(_images(spark, d)).select("img_id", "y", F.round("row_std", 6).alias("row_std"), F.round("edge_density", 9).alias("edge_density"))


def text_masks(spark, d):
    """Masked pixels of each image for two boxes that overlap."""
    return _digest(K.each_image(_images(spark, d), lambda g: K.text_mask(g, [(2, 2, 30, 12), (20, 5, 50, 14), (60, 3, 62, 4)])))


QUERIES = {f.__name__: f for f in (crop, median_blur, dilate, stack, row_slice, prepared, row_activity, text_masks)}
_V = L.with_views("fx_strips")
_DIGEST = "CAST(max(y) + 1 AS INT) AS h, CAST(max(x) + 1 AS INT) AS w, CAST(sum(g) AS BIGINT) AS total, CAST(sum((y * 1000 + x) * g) AS BIGINT) AS weighted"
ORACLE = {
    "crop": f"{_V}, c AS (SELECT img_id, y - greatest(0, img_id % 5 - 2) AS y, x - greatest(0, img_id % 7 - 3) AS x, g FROM fx_strips WHERE y >= img_id % 5 - 2 AND y < 6 + img_id % 20 AND x >= img_id % 7 - 3 AND x < 20 + img_id % 60) SELECT img_id, {_DIGEST} FROM c GROUP BY img_id",
    "median_blur": f"""{_V}, m AS (SELECT img_id, max(y) AS h FROM fx_strips GROUP BY img_id),
n AS (SELECT s.img_id, y, x, greatest(0, least(h, y + dy)) AS ny, greatest(0, least(63, x + dx)) AS nx FROM fx_strips s JOIN m ON s.img_id = m.img_id, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx))
SELECT n.img_id, CAST(n.y AS INT) AS y, CAST(n.x AS INT) AS x, CAST(quantile_disc(s.g, 0.5 ORDER BY s.g) AS INT) AS g FROM n JOIN fx_strips s ON s.img_id = n.img_id AND s.y = n.ny AND s.x = n.nx GROUP BY n.img_id, n.y, n.x""",
    "dilate": f"""{_V}, a AS (SELECT img_id, y, x, max(CASE WHEN g < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY img_id, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS g FROM fx_strips),
b AS (SELECT img_id, y, x, max(g) OVER (PARTITION BY img_id, x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS g FROM a) SELECT img_id, {_DIGEST} FROM b GROUP BY img_id""",
    "stack": f"""{_V}, m AS (SELECT img_id, max(y) + 1 AS h FROM fx_strips GROUP BY img_id), o AS (SELECT img_id, coalesce(sum(h) OVER (PARTITION BY img_id // 4 ORDER BY img_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM m),
c AS (SELECT s.img_id // 4 AS img_id, y + off AS y, x, g FROM fx_strips s JOIN o ON s.img_id = o.img_id) SELECT img_id, {_DIGEST} FROM c GROUP BY img_id""",
    "row_slice": f"{_V}, c AS (SELECT img_id * 10 + part AS img_id, y - greatest(0, part * 6 - 2) AS y, x, g FROM fx_strips, (VALUES (0), (1), (2)) p(part) WHERE y >= part * 6 - 2 AND y < part * 6 + 4) SELECT img_id, {_DIGEST} FROM c GROUP BY img_id",
}
