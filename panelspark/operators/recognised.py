"""Recognised lines: a recogniser's results in either shape, as rows with box, tilt and height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a recogniser reads pages at so many times their size.
SCALE = 2


def paired(results: DataFrame) -> DataFrame:
    """(page_id, pos, box, text) from either ``boxes`` and ``texts``, two arrays zipped to the shorter, or ``pairs``, an array of
    structs (box, text). A null array has no lines. Boxes are arrays of points (x, y)."""
    if "pairs" in results.columns:
        pairs = F.transform("pairs", lambda p: F.struct(p["box"].alias("box"), p["text"].alias("text")))
    else:
        n = F.least(F.size("boxes"), F.size("texts"))
        pairs = F.when(F.col("boxes").isNotNull() & F.col("texts").isNotNull(), F.arrays_zip(F.slice("boxes", 1, n).alias("box"), F.slice("texts", 1, n).alias("text")))
    rest = [c for c in results.columns if c not in ("pairs", "boxes", "texts")]
    rows = results.select(*rest, F.posexplode(pairs).alias("pos", "pair"))
    return rows.select(*rest, "pos", F.col("pair.box").alias("box"), F.col("pair.text").alias("text"))


def geometry(lines: DataFrame, width: Column, height: Column) -> DataFrame:
    """With x1, y1, x2, y2, angle and true_height in place of ``box``; boxes of fewer than four points drop.

    Points go from the upper left round by the right. The box is that of all points at the page's own size, cut to whole
    pixels toward zero and to the page; the angle is that of the upper side in degrees; the true height is the mean length of
    the left and the right side."""
    p = lambda k: F.get("box", F.lit(k))
    x, y = F.transform("box", lambda q: q["x"] / SCALE), F.transform("box", lambda q: q["y"] / SCALE)
    side = lambda a, b: F.hypot((p(b)["x"] - p(a)["x"]) / SCALE, (p(b)["y"] - p(a)["y"]) / SCALE)
    whole = {
        "x1": F.greatest(F.lit(0), F.array_min(x).cast("int")), "y1": F.greatest(F.lit(0), F.array_min(y).cast("int")),
        "x2": F.least(width, F.array_max(x).cast("int")), "y2": F.least(height, F.array_max(y).cast("int")),
        "angle": F.degrees(F.atan2(p(1)["y"] - p(0)["y"], p(1)["x"] - p(0)["x"])), "true_height": (side(0, 3) + side(1, 2)) / 2,
    }
    return lines.where(F.size("box") >= 4).withColumns(whole).drop("box")
