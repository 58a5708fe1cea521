"""Queries over records as they arrive: recogniser results, failures, masks, samples, archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import text as X
from panelspark.operators import archive as K, recognised as N
from panelspark.sources import files as P, landed as L


def ocr_adapter(spark, d):
    """A recogniser's two arrays, boxes and texts, zipped to the shorter; boxes of fewer than four points drop."""
    rows = L.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.split("text", "\n").alias("texts"))
    boxes = F.transform(F.sequence(F.lit(0), F.greatest(F.size("texts") - 2, F.lit(0))), lambda i: F.transform(F.sequence(F.lit(1), F.when(i % 7 == 3, 3).otherwise(4)), lambda p: p * 10 + i))
    n = F.least(F.size("texts"), F.size("boxes"))
    pairs = F.arrays_zip(F.slice("boxes", 1, n).alias("box"), F.slice("texts", 1, n).alias("text"))
    got = rows.withColumn("boxes", boxes).select("page_id", F.posexplode(pairs).alias("pos", "m"))
    return got.where(F.size("m.box") >= 4).select("page_id", "pos", F.array_min("m.box").alias("low"), F.array_max("m.box").alias("high"), F.col("m.text").alias("text"))


def failed_pages(spark, d):
    """Blank urls and pages without links drop; what is left counts by host."""
    rows = L.table(spark, d, "pages").where(X.strip(F.col("url")) != "").withColumn("n_links", F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), F.lit(1))))
    return rows.where("n_links > 0").groupBy(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("n_pages"), F.sum("n_links").alias("n_links"))


def mask_union(spark, d):
    """The union of two masks of each tile, pixel by pixel: dark pixels and a diagonal band."""
    tiles = L.tiles(spark, d)
    dark = tiles.select("img_id", "y", "x", (F.col("g") < 100).cast("int").alias("mask"))
    band = tiles.select("img_id", "y", "x", (F.abs(F.col("x") - F.col("y")) <= 1).cast("int").alias("mask"))
    both = dark.unionByName(band).groupBy("img_id", "y", "x").agg(F.max("mask").alias("mask"))
    return both.groupBy("img_id").agg(F.sum("mask").alias("n_masked"))


def dark_counts(spark, d):
    return L.tiles(spark, d).groupBy("img_id").agg(F.count_if(F.col("g") <= 128).alias("dark"), F.count_if(F.col("g") > 128).alias("light"), F.sum("g").alias("weighted"))


def default_projection(spark, d):
    """Records with missing keys: an event's parsed properties with defaults, and a map looked up with a default."""
    rows = L.table(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    names = F.create_map(F.lit("click"), F.lit("tap"), F.lit("error"), F.lit("fault"))
    return rows.select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("other")).alias("kind"), F.left(F.concat_ws("/", "event_type", "props"), F.lit(12)).alias("head"))


def chapter_archives(spark, d):
    """Each chapter's page names as one zip, read back."""
    rows = L.image_info(spark, d).select("chapter_id", F.concat(F.lit("page_"), X.zero_filled(F.col("idx")), F.lit(".txt")).alias("name"), F.concat_ws("x", "w", "h").cast("binary").alias("content"))
    return K.read_archives(K.archives(rows)).select("chapter_id", "pos", "name", F.decode("content", "utf-8").alias("content"))


def _quads(spark, d):
    """Each line's slanted quadrilateral at twice its size; every seventh lacks a point, every eleventh is null."""
    rows = L.text_lines(spark, d)
    x1, y1, x2, y2, up = (F.col(c).cast("double") * 2 for c in ("x1", "y1", "x2", "y2", "angle"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quad = F.array(point(x1 - 90, y1 + 0.5), point(x2, y1 + up), point(x2 + 1, y2 + up), point(x1, y2))
    k = F.col("line_no") + F.col("page_id")
    return rows.select("page_id", "line_no", F.when(k % 11 != 0, F.slice(quad, 1, F.when(k % 7 == 0, 3).otherwise(4))).alias("box"), F.col("raw_text").alias("text"))


def ocr_polygons(spark, d):
    """Box, tilt and height of recognised quadrilaterals, from results in both shapes: pages with even numbers have two
    arrays, the boxes' one longer; others have pairs."""
    both = F.array_sort(F.collect_list(F.struct("line_no", "box", "text")))
    pages = _quads(spark, d).groupBy("page_id").agg(both.alias("all"))
    even = pages.where("page_id % 2 = 0").select("page_id", F.concat(F.transform("all", lambda m: m["box"]), F.array(F.get("all", F.lit(0))["box"])).alias("boxes"), F.transform("all", lambda m: m["text"]).alias("texts"))
    odd = pages.where("page_id % 2 = 1").select("page_id", F.transform("all", lambda m: F.struct(m["box"], m["text"])).alias("pairs"))
    got = N.geometry(N.paired(even).unionByName(N.paired(odd)), F.lit(500), F.lit(2000))
    return got.select("page_id", "pos", "x1", "y1", "x2", "y2", F.round("angle", 6).alias("angle"), F.round("true_height", 6).alias("true_height"), F.length("text").alias("n_chars"))


def path_parts(spark, d):
    """Paths made of urls, with names that have several endings, none, or only one."""
    path = F.concat(F.lit("/out/"), F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""), F.element_at(F.array(F.lit(""), F.lit("/a.b.jpg"), F.lit("/__x.py"), F.lit("/.rc"), F.lit("/n.py")), (F.col("page_id") % 5 + 1).cast("int")))
    rows = L.table(spark, d, "pages").select("page_id", path.alias("path"))
    plugin = P.plugin_files(rows).select(F.col("page_id").alias("own"))
    return rows.join(plugin, rows["page_id"] == plugin["own"], "left").select("page_id", P.basename(F.col("path")).alias("base"), P.folder(F.col("path")).alias("folder"), P.stem(F.col("path")).alias("stem"), P.ending(F.col("path")).alias("ending"), F.col("own").isNotNull().alias("plugin"))


def image_headers(spark, d):
    """Sizes of images of four kinds from their first bytes; files of no kind drop."""
    rows = L.image_info(spark, d).withColumn("path", F.concat_ws("/", "chapter_id", "idx"))
    big = lambda c, n: F.lpad(F.hex(F.col(c)), 2 * n, "0")
    little = lambda c: F.concat(F.substring(big(c, 2), 3, 2), F.substring(big(c, 2), 1, 2))
    body = F.element_at(F.array(
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big("w", 4), big("h", 4), F.lit("0802")), F.concat(F.lit("474946383961"), little("w"), little("h"), F.lit("00")),
        F.concat(F.lit("FFD8FFE00010" + "4A" * 14 + "FFDB0004AAAAFFC0001108"), big("h", 2), big("w", 2), F.lit("03")),
        F.concat(F.lit("52494646" + "00" * 4 + "5745425056503820" + "00" * 7 + "9D012A"), little("w"), little("h"), F.lit("00")), F.lit("00FF"),
    ), (F.col("idx") % 5 + 1).cast("int"))
    return P.image_sizes(rows.select("path", F.unhex(body).alias("content")))


def quarantine(spark, d):
    """Answers in quarantine by what is wrong with them."""
    rows = L.texts(spark, d).withColumn("n", F.length("text"))
    good, bad = P.split_failed(rows, F.when(F.col("text").isNull() | (X.strip(F.col("text")) == ""), "empty").when(F.col("n") > 1000, "too long"))
    return good.groupBy().agg(F.count("*").alias("n")).select(F.lit("good").alias("problem"), "n").unionByName(bad.groupBy("problem").agg(F.count("*").alias("n")))


def downloads(spark, d):
    """Pages whose download left a file, in order; failed ones have no path."""
    rows = L.image_info(spark, d).withColumn("path", F.when(F.col("idx") % 6 != 0, F.concat(F.lit("raw/"), X.zero_filled(F.col("idx")), F.lit(".jpg"))))
    good, _ = P.split_failed(rows, F.when(F.col("path").isNull(), "no file"))
    return good.select("chapter_id", "idx", "path")


def merged_defaults(spark, d):
    """What a block falls back on: its own height where the first is missing, its own text where no translation is."""
    rows = L.text_lines(spark, d).withColumns({"orig_line_height": F.when(F.col("line_no") % 3 != 0, F.col("y2") - F.col("y1") + 2), "translated_text": F.when(F.col("line_no") % 4 != 0, F.lower("raw_text"))})
    return rows.select("page_id", "line_no", F.coalesce("orig_line_height", F.col("y2") - F.col("y1")).alias("line_height"), F.coalesce(F.nullif("translated_text", F.lit("")), "raw_text").alias("shown"))


QUERIES = {f.__name__: f for f in (ocr_adapter, failed_pages, mask_union, dark_counts, default_projection, chapter_archives, ocr_polygons, path_parts, image_headers, quarantine, downloads, merged_defaults)}
ORACLE = {
    "ocr_adapter": """WITH t AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS pos, len(string_split(text, chr(10))) AS n FROM documents)
SELECT page_id, pos, CAST(10 + pos AS INT) AS low, CAST(40 + pos AS INT) AS high, text FROM t WHERE pos <= greatest(n - 2, 0) AND pos % 7 <> 3""",
    "failed_pages": """WITH p AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, len(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS n FROM pages WHERE trim(url) <> '') SELECT host, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_links FROM p WHERE n > 0 GROUP BY host""",
    "mask_union": L.with_views("fx_tiles") + " SELECT img_id, CAST(sum(CASE WHEN g < 100 OR abs(x - y) <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_masked FROM fx_tiles GROUP BY img_id",
    "dark_counts": L.with_views("fx_tiles") + " SELECT img_id, count(*) FILTER (WHERE g <= 128) AS dark, count(*) FILTER (WHERE g > 128) AS light, CAST(sum(g) AS BIGINT) AS weighted FROM fx_tiles GROUP BY img_id",
    "chapter_archives": L.with_views("fx_images") + """, n AS (SELECT chapter_id, 'page_' || CASE WHEN idx < 1000 THEN lpad(idx::VARCHAR, 3, '0') ELSE idx::VARCHAR END || '.txt' AS name, w || 'x' || h AS content FROM fx_images)
SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY name) - 1 AS pos, name, content FROM n""",
    "ocr_polygons": L.with_views("fx_lines") + """, q AS (SELECT *, page_id + line_no AS k, x1 * 2.0::DOUBLE - 90 AS ax, y1 * 2.0::DOUBLE + 0.5::DOUBLE AS ay, x2 * 2.0::DOUBLE AS bx, y1 * 2.0::DOUBLE + angle * 2 AS b_y, x2 * 2.0::DOUBLE + 1 AS cx, y2 * 2.0::DOUBLE + angle * 2 AS cy, x1 * 2.0::DOUBLE AS dx, y2 * 2.0::DOUBLE AS dy FROM fx_lines)
SELECT page_id, line_no AS pos, CAST(greatest(0, trunc(least(ax, bx, cx, dx) / 2)) AS INT) AS x1, CAST(greatest(0, trunc(least(ay, b_y, cy, dy) / 2)) AS INT) AS y1,
       CAST(least(500, trunc(greatest(ax, bx, cx, dx) / 2)) AS INT) AS x2, CAST(least(2000, trunc(greatest(ay, b_y, cy, dy) / 2)) AS INT) AS y2, round(degrees(atan2(b_y - ay, bx - ax)), 6) AS angle,
       round((sqrt(((dx - ax) / 2) * ((dx - ax) / 2) + ((dy - ay) / 2) * ((dy - ay) / 2)) + sqrt(((cx - bx) / 2) * ((cx - bx) / 2) + ((cy - b_y) / 2) * ((cy - b_y) / 2))) / 2, 6) AS true_height, CAST(length(raw_text) AS INT) AS n_chars
FROM q WHERE k % 11 <> 0 AND k % 7 <> 0""",
    "path_parts": r"""WITH p AS (SELECT page_id, '/out/' || regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || ['', '/a.b.jpg', '/__x.py', '/.rc', '/n.py'][page_id % 5 + 1] AS path FROM pages),
b AS (SELECT page_id, path, parse_filename(path) AS base, regexp_replace(path, '/[^/]*$', '') AS folder FROM p)
SELECT page_id, base, folder, CASE WHEN base = '.rc' OR base NOT LIKE '%.%' THEN base ELSE regexp_replace(base, '\.[^.]*$', '') END AS stem,
       CASE WHEN base = '.rc' OR base NOT LIKE '%.%' THEN '' ELSE regexp_extract(base, '\.[^.]*$') END AS ending, page_id % 5 = 4 AS plugin FROM b""",
    "image_headers": L.with_views("fx_images") + " SELECT chapter_id || '/' || idx AS path, w, h FROM fx_images WHERE idx % 5 <> 4",
    "downloads": L.with_views("fx_images") + " SELECT chapter_id, idx, 'raw/' || CASE WHEN idx < 1000 THEN lpad(idx::VARCHAR, 3, '0') ELSE idx::VARCHAR END || '.jpg' AS path FROM fx_images WHERE idx % 6 <> 0",
    "quarantine": r"""WITH t AS (SELECT CASE WHEN text IS NULL OR regexp_full_match(text, '\s*') THEN 'empty' WHEN length(text) > 1000 THEN 'too long' END AS problem FROM conversations)
SELECT 'good' AS problem, count(*) FILTER (WHERE problem IS NULL) AS n FROM t UNION ALL SELECT problem, count(*) FROM t WHERE problem IS NOT NULL GROUP BY problem""",
    "merged_defaults": L.with_views("fx_lines") + " SELECT page_id, line_no, CASE WHEN line_no % 3 <> 0 THEN y2 - y1 + 2 ELSE y2 - y1 END AS line_height, CASE WHEN line_no % 4 <> 0 AND raw_text <> '' THEN lower(raw_text) ELSE raw_text END AS shown FROM fx_lines",
    "default_projection": """SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), -1) AS k, CASE event_type WHEN 'click' THEN 'tap' WHEN 'error' THEN 'fault' ELSE 'other' END AS kind, left(concat_ws('/', event_type, props), 12) AS head FROM events""",
}
