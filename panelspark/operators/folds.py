"""Packing folds: each row's pack depends on all before it in its group. They are chains of pack starts (see ``chains``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import chains

_KEYS = ["chapter_id"]


def outer_batches(texts: DataFrame, most_chars: int = 1000, most_items: int = 25) -> DataFrame:
    """batch_no: a batch closes before a text that would exceed the characters, or when it is full."""
    short = chains.is_short(texts, _KEYS)
    rows = chains.placed(texts, _KEYS, ["pos", "text"], "n", short)
    return _numbered(texts, rows, chains.limited(rows, _KEYS, most_chars, most_chars, most_items, "n", short), short)


def inner_batches(texts: DataFrame, most_chars: int = 1500, mark: int = 9) -> DataFrame:
    """batch_no within requests: each text costs its separator too, but for the first after a flush."""
    short = chains.is_short(texts, _KEYS)
    rows = chains.placed(texts.withColumn("_cost", F.coalesce("n", F.lit(0)) + mark), _KEYS, ["pos", "text"], "_cost", short)
    # the separator that a batch's first text does not cost is room; a chapter's first text costs it
    steps = chains.limited(rows, _KEYS, most_chars + mark, most_chars, most_chars // mark + 2, "_cost", short)
    return _numbered(texts, rows, steps, short)


def merge_groups(images: DataFrame, target: int = 8000) -> DataFrame:
    """group_no: images are stacked, scaled to the group's first width, until their heights reach the target."""
    short = chains.is_short(images, _KEYS)
    rows = chains.placed(images, _KEYS, ["idx"], short=short)
    scaled = lambda first, x: (x["h"] * F.try_divide(first["w"].cast("double"), x["w"])).cast("long")
    return _numbered(images, rows, chains.filled(rows, _KEYS, target, scaled, ["w", "h"], short), short, "group_no")


def _numbered(given: DataFrame, rows: DataFrame, steps: DataFrame, short: bool, out: str = "batch_no") -> DataFrame:
    return chains.numbered(rows, chains.reached(steps, _KEYS, short=short), _KEYS, out).select(*given.columns, out)
