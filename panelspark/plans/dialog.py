"""Queries over text lines: cleaning, clustering into bubbles, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import text as X
from panelspark.operators import bubbles as B
from panelspark.sources import landed as L


def clean_ocr_text(spark, d):
    return L.text_lines(spark, d).select("page_id", "line_no", X.clean_line(F.col("raw_text")).alias("text"))


def numeric_noise_filter(spark, d):
    ids = L.table(spark, d, "events").select(F.lit(-1).cast("long").alias("page_id"), F.col("event_id").alias("line_no"), F.col("event_id").cast("string").alias("raw_text"))
    lines = L.text_lines(spark, d).select("page_id", F.col("line_no").cast("long").alias("line_no"), "raw_text")
    return B.kept_lines(lines.unionByName(ids)).select("page_id", "line_no", "text")


def safe_names(spark, d):
    rows = L.table(spark, d, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return rows.select("page_id", X.safe_title(title).alias("title"), X.safe_chapter(title).alias("chapter"))


def word_counts(spark, d):
    rows = L.text_lines(spark, d)
    return rows.select("page_id", "line_no", F.size(X.words(F.col("raw_text"))).cast("long").alias("n_words"), F.length("raw_text").cast("long").alias("n_chars"), F.length(X.letters(F.col("raw_text"))).cast("long").alias("n_capitals"))


def merge_edges(spark, d):
    return B.edges(B.written_lines(L.text_lines(spark, d)))


def connected_components(spark, d):
    return B.clusters(B.written_lines(L.text_lines(spark, d)))


def _members(spark, d):
    return B.members(B.written_lines(L.text_lines(spark, d)))


def bubble_order(spark, d):
    return B.ranked(_members(spark, d))


def dialog_bubbles(spark, d):
    rows = B.in_page_order(B.bubbles(_members(spark, d)))
    return rows.select("page_id", "block_no", "text", "x1", "y1", "x2", "y2", F.round("line_height", 6).alias("line_height"), F.round("angle", 6).alias("angle"), "is_italic", "is_bold", "n_lines")


_KEPT = r"""fx_kept AS (SELECT * FROM fx_clean WHERE NOT (regexp_full_match(text, '[O0-9\s.,!?''"~-]+') AND length(text) < 6) AND text <> '')"""


def _edges_sql(size_ratio: float = 1.3, gap: float = 10.0) -> str:
    """Pairs of lines that belong together, at the given limits."""
    return f"""fx_edges AS (
  SELECT a.page_id, a.line_no AS a, b.line_no AS b FROM fx_kept a JOIN fx_kept b ON a.page_id = b.page_id AND a.line_no < b.line_no
  WHERE greatest(a.y2 - a.y1, b.y2 - b.y1)::DOUBLE / greatest(least(a.y2 - a.y1, b.y2 - b.y1), 1) <= {size_ratio}::DOUBLE
    AND abs(a.angle - b.angle) <= 12 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) >= -5
    AND abs((a.x1 + a.x2) * 0.5::DOUBLE - (b.x1 + b.x2) * 0.5::DOUBLE) < greatest(a.x2 - a.x1, b.x2 - b.x1, 1) * 0.6::DOUBLE
    AND least(a.y2, b.y2) - greatest(a.y1, b.y1) >= -greatest({gap}::DOUBLE, 0.8::DOUBLE * greatest(least(a.y2 - a.y1, b.y2 - b.y1), 1))
    AND least(a.y2, b.y2) - greatest(a.y1, b.y1) <= 2.0::DOUBLE * greatest(least(a.y2 - a.y1, b.y2 - b.y1), 1))"""


_CLOSED = """fx_reach AS (
  SELECT page_id, line_no, line_no AS seen FROM fx_kept
  UNION
  SELECT r.page_id, r.line_no, e.o FROM fx_reach r JOIN (SELECT page_id, a AS i, b AS o FROM fx_edges UNION ALL SELECT page_id, b, a FROM fx_edges) e ON r.page_id = e.page_id AND r.seen = e.i
), fx_cluster AS (SELECT page_id, line_no, min(seen) AS cluster FROM fx_reach GROUP BY ALL)"""
_BASE = L.with_views("fx_lines", "fx_clean", recursive=True) + f",\n{_KEPT},\n{_edges_sql()}"


def members_sql(**limits: float) -> str:
    """The views up to fx_members, the lines with their cluster and centre, at the given limits."""
    base = L.with_views("fx_lines", "fx_clean", recursive=True) + f",\n{_KEPT},\n{_edges_sql(**limits)}"
    return f"{base},\n{_CLOSED},\nfx_members AS (SELECT k.*, cluster, (y1 + y2) / 2.0::DOUBLE AS cy FROM fx_kept k JOIN fx_cluster c ON k.page_id = c.page_id AND k.line_no = c.line_no)"


#: Places of lines in clusters and of clusters in pages, after ``members_sql``.
RANKED_SQL = """, h AS (SELECT page_id, cluster, min(y1) AS y1, avg(cy) AS cy, min(line_no) AS first_line FROM fx_members GROUP BY page_id, cluster), g AS (SELECT page_id, cluster, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1, cy, first_line) - 1 AS INT) AS block_no FROM h)
SELECT m.page_id, m.line_no, m.cluster, CAST(row_number() OVER (PARTITION BY m.page_id, m.cluster ORDER BY cy, line_no) - 1 AS INT) AS rank, block_no FROM fx_members m JOIN g ON m.page_id = g.page_id AND m.cluster = g.cluster"""

_MEMBERS = members_sql()

QUERIES = {f.__name__: f for f in (clean_ocr_text, numeric_noise_filter, safe_names, word_counts, merge_edges, connected_components, bubble_order, dialog_bubbles)}
ORACLE = {
    "clean_ocr_text": L.with_views("fx_lines", "fx_clean") + " SELECT page_id, line_no, text FROM fx_clean",
    "numeric_noise_filter": "WITH " + L.SQL["fx_lines"].replace("fx_lines AS (", "fx_own AS (", 1) + ", fx_lines AS (SELECT page_id, line_no::BIGINT AS line_no, raw_text FROM fx_own UNION ALL SELECT -1, event_id, event_id::VARCHAR FROM events),\n" + L.SQL["fx_clean"] + f",\n{_KEPT} SELECT page_id, line_no, text FROM fx_kept",
    "safe_names": r"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS t FROM pages)
SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(t, '[^a-zA-Z0-9_\-\s]', '_', 'g'), '^\s+', ''), '\s+$', ''), 100) AS title,
       left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '[^a-zA-Z0-9 _.\-]', '_', 'g'), '^\s+', ''), '\s+$', ''), 100) AS chapter FROM t""",
    "word_counts": L.with_views("fx_lines") + r" SELECT page_id, line_no, len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda w: w <> '')) AS n_words, length(raw_text) AS n_chars, length(regexp_replace(raw_text, '[^A-Z]', '', 'g')) AS n_capitals FROM fx_lines",
    "merge_edges": _BASE + " SELECT page_id, a, b FROM fx_edges",
    "connected_components": f"{_BASE},\n{_CLOSED} SELECT page_id, line_no, cluster FROM fx_cluster",
    "bubble_order": _MEMBERS + RANKED_SQL,
    "dialog_bubbles": _MEMBERS + """, b AS (
  SELECT page_id, cluster, string_agg(text, ' ' ORDER BY cy, line_no) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg((y2 - y1)::DOUBLE), 6) AS line_height,
         round(avg(angle), 6) AS angle, bool_or(is_italic) AS is_italic, bool_or(is_bold) AS is_bold, count(*) AS n_lines, avg(cy) AS cy, min(line_no) AS first_line FROM fx_members GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1, cy, first_line) - 1 AS INT) AS block_no, text, x1, y1, x2, y2, line_height, angle, is_italic, is_bold, n_lines
FROM b WHERE length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2""",
}
