"""The native functions by their own names and defaults, each over a table instead of one image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators import bubbles, layout, raster


def cluster_boxes(lines: DataFrame, max_size_ratio: float = 1.3, max_gap_px: float = 10.0, max_gap_ratio: float = 0.8, max_overlap_ratio: float = 2.0, max_angle_diff_deg: float = 12.0, center_ratio: float = 0.6) -> DataFrame:
    """(page_id, line_no, cluster, rank, block_no) of (page_id, line_no, x1, y1, x2, y2[, angle]); a missing angle is 0."""
    rows = lines if "angle" in lines.columns else lines.withColumn("angle", F.lit(0.0))
    rule = bubbles.MergeRule(max_size_ratio, max_gap_px, max_gap_ratio, max_overlap_ratio, max_angle_diff_deg, center_ratio)
    return bubbles.ranked(bubbles.members(rows, rule=rule))


def analyze(pixels: DataFrame, italic_threshold_deg: float = 10.0, bold_stroke_ratio: float = 0.15, bold_ink_density: float = 0.40) -> DataFrame:
    """(img_id, is_italic, is_bold) of (img_id, y, x, g)."""
    return raster.styles(pixels, italic_threshold_deg, bold_stroke_ratio, bold_ink_density)


def estimate_font_size(text_len: Column, num_words: Column, box_w: Column, box_h: Column, base_font_size: Column | None = None, max_font_size: float = 150.0, min_font_size: float = 8.0, char_width_ratio: float = 0.52, line_height_ratio: float = 1.2, width_limit: float = 0.95, height_limit: float = 0.95, single_word_width_factor: float = 1.5) -> Column:
    """The greatest size that fits a box, between ``min_font_size`` and a base: the given one or 0.9 of the box's height, within
    the least and the greatest size. A single word may be wider than the box by a factor; a room has 4 pixels a side at
    least. Without text it is the base, without a box the least size."""
    least, most, advance, leading = (F.lit(float(x)) for x in (min_font_size, max_font_size, char_width_ratio, line_height_ratio))
    base = F.least(F.greatest(base_font_size if base_font_size is not None else box_h * 0.9, least), most)
    room_w = F.greatest(box_w * width_limit * F.when(num_words <= 1, single_word_width_factor).otherwise(1.0), F.lit(4.0))
    room_h = F.greatest(box_h * height_limit, F.lit(4.0))
    whole = F.ceil(text_len / F.greatest(room_w / (advance * base), F.lit(1.0))) * leading * base <= room_h
    return F.when((box_w <= 0) | (box_h <= 0), least).when((text_len == 0) | whole, base).otherwise(layout.largest_fit(text_len, room_w, room_h, least, base, advance, leading))


def safe_padding(font_size: Column, min_padding: float = 15.0, padding_ratio: float = 0.3, stroke_ratio: float = 0.0) -> Column:
    """A struct (l, r, t, b) of equal margins."""
    size = F.greatest(font_size, F.lit(0.0))
    margin = F.greatest(size * padding_ratio + size * max(0.0, stroke_ratio), F.lit(min_padding))
    return F.struct(*(margin.alias(k) for k in "lrtb"))


def detect_colors(pixels: DataFrame, max_iter: int = 40, restarts: int = 3, min_contrast: float = 50.0) -> DataFrame:
    """(img_id, text_rgb, stroke_rgb) of (img_id, y, x, r, gr, b)."""
    return raster.colors(pixels, rounds=max_iter, restarts=max(1, restarts), contrast=min_contrast)
