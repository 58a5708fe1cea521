"""Queries over the named functions of the API, at other limits than their defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import api
from panelspark.functions import text as X
from panelspark.operators.bubbles import written_lines
from panelspark.plans.dialog import RANKED_SQL, members_sql
from panelspark.plans.imaging import styles_sql
from panelspark.sources import landed as L


def named_clusters(spark, d):
    return api.cluster_boxes(written_lines(L.text_lines(spark, d)), max_size_ratio=1.2, max_gap_px=24.0)


def named_styles(spark, d):
    return api.analyze(L.tiles(spark, d), italic_threshold_deg=14.0, bold_stroke_ratio=0.3, bold_ink_density=0.5)


def named_sizes(spark, d):
    """Font sizes between 9 and 40 and the margins that follow from them."""
    rows = L.text_lines(spark, d)
    box_w, box_h = ((F.col(f"{c}2") - F.col(f"{c}1")).cast("double") for c in "xy")
    size = api.estimate_font_size(F.length("raw_text").cast("double"), F.size(X.words(F.col("raw_text"))), box_w, box_h * 4, max_font_size=40.0, min_font_size=9.0)
    sized = rows.select("page_id", "line_no", size.alias("size"))
    return sized.select("page_id", "line_no", F.round("size", 6).alias("font_size"), F.round(api.safe_padding(F.col("size"), min_padding=4.0, stroke_ratio=0.1)["l"], 6).alias("padding"))


_SIZES = r""", b AS (
  SELECT page_id, line_no, length(raw_text)::DOUBLE AS n, greatest((x2 - x1) * 0.95::DOUBLE * CASE WHEN len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda w: w <> '')) <= 1 THEN 1.5::DOUBLE ELSE 1 END, 4) AS w,
    greatest((y2 - y1) * 4 * 0.95::DOUBLE, 4) AS h, least(greatest((y2 - y1) * 4 * 0.9::DOUBLE, 9), 40) AS base, x2 <= x1 OR y2 <= y1 AS no_box FROM fx_lines
), s AS (
  SELECT *, list_reduce(list_transform(range(1, 65), lambda i: {'lo': 0::DOUBLE, 'hi': 0::DOUBLE, 'best': 0::DOUBLE}),
    lambda a, i: CASE WHEN ceil(n / greatest(w / ((a.lo + a.hi) * 0.5::DOUBLE * 0.52::DOUBLE), 1)) * 1.2::DOUBLE * ((a.lo + a.hi) * 0.5::DOUBLE) <= h
      THEN {'lo': (a.lo + a.hi) * 0.5::DOUBLE, 'hi': a.hi, 'best': (a.lo + a.hi) * 0.5::DOUBLE} ELSE {'lo': a.lo, 'hi': (a.lo + a.hi) * 0.5::DOUBLE, 'best': a.best} END,
    {'lo': 9::DOUBLE, 'hi': base, 'best': 9::DOUBLE}).best AS halved FROM b
), f AS (
  SELECT page_id, line_no, CASE WHEN no_box THEN 9 WHEN n = 0 OR ceil(n / greatest(w / (0.52::DOUBLE * base), 1)) * 1.2::DOUBLE * base <= h THEN base ELSE halved END AS size FROM s
) SELECT page_id, line_no, round(size, 6) AS font_size, round(greatest(size * 0.3::DOUBLE + size * 0.1::DOUBLE, 4), 6) AS padding FROM f"""

QUERIES = {f.__name__: f for f in (named_clusters, named_styles, named_sizes)}
ORACLE = {
    "named_clusters": members_sql(size_ratio=1.2, gap=24.0) + RANKED_SQL,
    "named_styles": styles_sql(14.0, 0.3, 0.5),
    "named_sizes": L.with_views("fx_lines", recursive=True) + _SIZES,
}
