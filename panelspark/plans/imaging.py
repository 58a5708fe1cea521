"""Queries over pixels, strips and boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import text as X
from panelspark.operators import archive as K, chains as C, layout as Y, raster as R, slicing as S
from panelspark.sources import landed as L


def gray_histogram(spark, d):
    return R.histogram(L.tiles(spark, d))


def otsu(spark, d):
    return R.otsu(L.tiles(spark, d))


def ink_bbox_density(spark, d):
    return R.ink_box(R.ink(L.tiles(spark, d))).withColumn("density", F.round("density", 9))


def longest_run(spark, d):
    return R.longest_run(R.ink(L.tiles(spark, d)))


def slant(spark, d):
    return R.slant(R.ink(L.tiles(spark, d)))


def row_stats(spark, d):
    return R.row_stats(L.tiles(spark, d)).select("img_id", "y", F.round("row_std", 6).alias("row_std"), F.round("edge_density", 9).alias("edge_density"))


def stroke_width(spark, d):
    pixels = L.tiles(spark, d)
    sizes = pixels.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return R.stroke_width(R.ink(pixels), sizes).select("img_id", F.round("stroke", 4).alias("stroke"))


def style_flags(spark, d):
    return R.styles(L.tiles(spark, d))


def color_pair(spark, d):
    rows = L.table(spark, d, "embeddings").select(F.col("vec_id").alias("img_id"), "embedding", F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("i"))
    gray = lambda k: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * F.get("embedding", (F.col("i") + k) % F.size("embedding")).cast("double")))).cast("int")
    return R.colors(rows.select("img_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), gray(0).alias("r"), gray(21).alias("gr"), gray(42).alias("b")))


def grayscale(spark, d):
    rows = L.tiles(spark, d)
    return rows.select("img_id", "y", "x", F.round(0.299 * F.col("g") + 0.587 * (255 - F.col("g")) + 0.114 * F.col("x")).cast("int").alias("gray"))


def safe_gap(spark, d):
    return S.safe_starts(L.row_profile(spark, d)).where("gap_ok").select("page_id", "y")


def forbidden_rows(spark, d):
    bands = S.forbidden_bands(L.text_lines(spark, d))
    return bands.groupBy("page_id").agg(F.sum((F.col("last") - F.col("first") + 1).cast("long")).alias("n_rows"), F.min("first").alias("first"), F.max("last").alias("last"))


def smart_slice(spark, d):
    return S.slices(L.row_profile(spark, d)).select("page_id", "part", "y1", "y2")


def stacked_offsets(spark, d):
    """The y offset at which each image of a chapter would be stacked, unscaled."""
    before = Window.partitionBy("chapter_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = L.image_info(spark, d)
    name = F.concat(F.lit("page_"), X.zero_filled(F.row_number().over(Window.partitionBy("chapter_id").orderBy("idx"))), F.lit(".webp"))
    return rows.select("chapter_id", "idx", F.coalesce(F.sum("h").over(before), F.lit(0)).alias("y_offset"), name.alias("file_name"))


def archive_members(spark, d):
    """The list of each chapter's archive, its members in name order, and how many they are."""
    named = stacked_offsets(spark, d).select("chapter_id", F.col("file_name").alias("member"))
    placed = C.placed(named, ["chapter_id"], ["member"], short=C.is_short(named, ["chapter_id"]))
    return K.listings(placed)


def font_size(spark, d):
    rows = L.text_lines(spark, d)
    size = Y.font_size(F.length("raw_text"), (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double") * 4, 10.0, 150.0)
    return rows.select("page_id", "line_no", F.round(size, 6).alias("font_size"))


def safe_padding(spark, d):
    rows = L.text_lines(spark, d)
    size = F.col("y2") - F.col("y1") + F.col("line_no") % 120
    stroke = Y.stroke_of(size, F.size(X.words(F.col("raw_text"))) <= 1)
    return rows.select("page_id", "line_no", stroke.alias("stroke"), F.round(Y.padding(size, stroke), 6).alias("padding"))


#: A width table by rule for the characters up to U+017F: what it lacks has the usual advance.
WIDTHS = [340 + 60 * (code % 7) for code in range(0x180)]


def word_wrap(spark, d):
    rows = L.text_lines(spark, d).where("raw_text <> ''")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id", "line_no")
    got = Y.fit_text(F.col("raw_text"), (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double") * 3, F.lit(40), WIDTHS)
    return rows.select("page_id", "line_no", got.alias("f")).select("page_id", "line_no", F.col("f.size").alias("font_size"), F.size("f.lines").alias("n_lines"), F.array_join("f.lines", "\n").alias("text"))


def geometry(spark, d):
    """Angle and true height of each line's slanted quadrilateral, and its box at half scale, clamped to a page."""
    rows = L.text_lines(spark, d)
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), F.col("angle") * 2
    h = (F.col("y2") - F.col("y1")).cast("double")
    return rows.select("page_id", "line_no", F.round(F.degrees(F.atan2(dy, dx)), 6).alias("tilt"), F.round((F.hypot(dy / 4, h) + F.hypot(dy / 4, h + 1)) / 2, 6).alias("true_height"), F.greatest(F.lit(0), (F.col("x1") / 2).cast("int")).alias("left"), F.least(F.lit(400), (F.col("x2") / 2).cast("int")).alias("right"), F.floor((F.col("x1") - F.col("x2")) / 2).cast("int").alias("shift"))


_OTSU = L.with_views("fx_tiles") + """, fx_hist AS (SELECT img_id, g, count(*) AS n FROM fx_tiles GROUP BY img_id, g),
fx_cum AS (SELECT img_id, g, sum(n) OVER u::DOUBLE AS wb, sum(g * n) OVER u::DOUBLE AS sb, sum(n) OVER (PARTITION BY img_id)::DOUBLE AS total, sum(g * n) OVER (PARTITION BY img_id)::DOUBLE AS s
  FROM fx_hist WINDOW u AS (PARTITION BY img_id ORDER BY g ROWS UNBOUNDED PRECEDING)),
fx_otsu AS (SELECT img_id, g AS threshold FROM (SELECT img_id, g, row_number() OVER (PARTITION BY img_id ORDER BY wb * (total - wb) * (sb / wb - (s - sb) / (total - wb)) * (sb / wb - (s - sb) / (total - wb)) DESC, g) AS k
  FROM fx_cum WHERE total > wb) WHERE k = 1),
fx_ink AS (SELECT t.img_id, y, x FROM fx_tiles t JOIN (SELECT t.img_id, threshold, count(*) FILTER (WHERE g <= threshold) <= count(*) // 2 AS dark FROM fx_tiles t JOIN fx_otsu o ON t.img_id = o.img_id GROUP BY t.img_id, threshold) o
  ON t.img_id = o.img_id WHERE (g <= threshold) = dark)"""
_STROKE = _OTSU + """, fx_bare AS (SELECT t.img_id, t.y, t.x FROM fx_tiles t ANTI JOIN fx_ink i ON t.img_id = i.img_id AND t.y = i.y AND t.x = i.x),
fx_far AS (SELECT i.img_id, i.y, i.x, min(greatest(abs(i.y - b.y), abs(i.x - b.x)) - least(abs(i.y - b.y), abs(i.x - b.x)) + least(abs(i.y - b.y), abs(i.x - b.x)) * sqrt(2::DOUBLE)) AS d
  FROM fx_ink i JOIN fx_bare b ON i.img_id = b.img_id GROUP BY ALL),
fx_stroke AS (SELECT img_id, 2 * list_sort(list(d))[least(CAST(trunc(count(*) * 0.6::DOUBLE) AS INT), count(*) - 1) + 1] AS stroke FROM fx_far GROUP BY img_id)"""
_LINE = L.with_views("fx_lines")


def styles_sql(italic: float = 10.0, ratio: float = 0.15, density: float = 0.4) -> str:
    """Flags at the given limits."""
    return _STROKE + f""", a AS (SELECT CAST(unnest(range(-24, 25)) AS INT) AS deg), c AS (SELECT img_id, deg, CAST(trunc(x + tan(radians(deg)) * y) AS INT) AS col, count(*) AS c FROM fx_ink, a GROUP BY ALL),
s AS (SELECT img_id, deg, sum(c * c) AS score FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY score DESC, deg) AS k FROM s),
b AS (SELECT img_id, count(*) AS n, count(*)::DOUBLE / greatest((max(y) - min(y) + 1) * (max(x) - min(x) + 1), 1) AS density FROM fx_ink GROUP BY img_id),
r AS (SELECT DISTINCT img_id, y FROM fx_ink), i AS (SELECT img_id, y - row_number() OVER (PARTITION BY img_id ORDER BY y) AS island FROM r), l AS (SELECT img_id, max(n) AS line FROM (SELECT img_id, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY img_id)
SELECT t.img_id, coalesce(b.n >= 16 AND abs(k.deg) >= {italic}, false) AS is_italic, coalesce(b.n >= 16 AND (CASE WHEN l.line > 1 THEN z.stroke / l.line ELSE 0 END >= {ratio}::DOUBLE OR b.density >= {density}::DOUBLE), false) AS is_bold
FROM (SELECT DISTINCT img_id FROM fx_tiles) t LEFT JOIN b ON t.img_id = b.img_id LEFT JOIN k ON t.img_id = k.img_id AND k.k = 1 LEFT JOIN l ON t.img_id = l.img_id LEFT JOIN fx_stroke z ON t.img_id = z.img_id"""


QUERIES = {f.__name__: f for f in (gray_histogram, otsu, ink_bbox_density, longest_run, slant, row_stats, stroke_width, style_flags, color_pair, grayscale, safe_gap, forbidden_rows, smart_slice, stacked_offsets, archive_members, font_size, safe_padding, word_wrap, geometry)}
ORACLE = {
    "gray_histogram": _OTSU + " SELECT img_id, g, n FROM fx_hist",
    "otsu": _OTSU + " SELECT img_id, threshold FROM fx_otsu",
    "ink_bbox_density": _OTSU + " SELECT img_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS n_ink, round(count(*)::DOUBLE / greatest((max(y) - min(y) + 1) * (max(x) - min(x) + 1), 1), 9) AS density FROM fx_ink GROUP BY img_id",
    "longest_run": _OTSU + ", r AS (SELECT DISTINCT img_id, y FROM fx_ink), i AS (SELECT img_id, y - row_number() OVER (PARTITION BY img_id ORDER BY y) AS island FROM r), c AS (SELECT img_id, island, count(*) AS n FROM i GROUP BY ALL) SELECT img_id, max(n) AS line_height FROM c GROUP BY img_id",
    "slant": _OTSU + """, a AS (SELECT CAST(unnest(range(-24, 25)) AS INT) AS deg), c AS (SELECT img_id, deg, CAST(trunc(x + tan(radians(deg)) * y) AS INT) AS col, count(*) AS c FROM fx_ink, a GROUP BY ALL),
s AS (SELECT img_id, deg, sum(c * c) AS score, sum(c) AS n FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY score DESC, deg) AS k FROM s)
SELECT img_id, CASE WHEN n < 16 THEN 0 ELSE deg END AS slant FROM k WHERE k = 1""",
    "row_stats": L.with_views("fx_tiles") + ", e AS (SELECT *, coalesce(abs(g - lag(g) OVER (PARTITION BY img_id, y ORDER BY x)) > 50, false) AS e FROM fx_tiles) SELECT img_id, y, round(stddev_pop(g), 6) AS row_std, round(count(*) FILTER (WHERE e)::DOUBLE / count(*), 9) AS edge_density FROM e GROUP BY img_id, y",
    "color_pair": L.with_views("fx_tiles", recursive=True) + ", seeds(k, bits, share) AS (VALUES " + ", ".join(f"({k}, {R.starts(k)[0]}::HUGEINT, {R.starts(k)[1]!r}::DOUBLE)" for k in range(3)) + """),
p AS (SELECT a.img_id, a.y * 8 + a.x AS spot, a.g::DOUBLE AS r, b.g::DOUBLE AS gr, c.g::DOUBLE AS b FROM fx_tiles a
  JOIN fx_tiles b ON a.img_id = b.img_id AND b.y * 8 + b.x = (a.y * 8 + a.x + 21) % 64 JOIN fx_tiles c ON a.img_id = c.img_id AND c.y * 8 + c.x = (a.y * 8 + a.x + 42) % 64),
one AS (SELECT p.*, k, share FROM p, seeds WHERE spot = CAST(bits % 64 AS INT)),
gap AS (SELECT one.img_id, one.k, one.share, p.spot, p.r, p.gr, p.b, sum((p.r - one.r) ** 2 + (p.gr - one.gr) ** 2 + (p.b - one.b) ** 2) OVER w AS upto, sum((p.r - one.r) ** 2 + (p.gr - one.gr) ** 2 + (p.b - one.b) ** 2) OVER (PARTITION BY one.img_id, one.k) AS total
  FROM one JOIN p ON one.img_id = p.img_id WINDOW w AS (PARTITION BY one.img_id, one.k ORDER BY p.spot)),
two AS (SELECT img_id, k, arg_min(r, spot) AS r, arg_min(gr, spot) AS gr, arg_min(b, spot) AS b FROM gap WHERE upto >= total * share AND total > 0 GROUP BY img_id, k),
m AS (
  SELECT one.img_id, one.k, 0 AS n, one.r AS ar, one.gr AS ag, one.b AS ab, two.r AS br, two.gr AS bg, two.b AS bb, 0::HUGEINT AS na, 0::HUGEINT AS nb, 0::DOUBLE AS inertia, false AS done FROM one JOIN two ON one.img_id = two.img_id AND one.k = two.k
  UNION ALL
  SELECT img_id, k, n + 1, nar, nag, nab, nbr, nbg, nbb, ca, cb, s, abs(nar - ar) + abs(nag - ag) + abs(nab - ab) + abs(nbr - br) + abs(nbg - bg) + abs(nbb - bb) < 0.01 FROM (
    SELECT img_id, k, n, ar, ag, ab, br, bg, bb, sum(f) AS ca, sum(1 - f) AS cb, sum(least(da, db)) AS s, sum(r * f) / sum(f) AS nar, sum(gr * f) / sum(f) AS nag, sum(b * f) / sum(f) AS nab,
           sum(r * (1 - f)) / sum(1 - f) AS nbr, sum(gr * (1 - f)) / sum(1 - f) AS nbg, sum(b * (1 - f)) / sum(1 - f) AS nbb
    FROM (SELECT m.*, p.r, p.gr, p.b, da, db, CASE WHEN da <= db THEN 1 ELSE 0 END AS f FROM m JOIN p ON m.img_id = p.img_id AND NOT m.done AND m.n < 40,
          LATERAL (SELECT (p.r - ar) ** 2 + (p.gr - ag) ** 2 + (p.b - ab) ** 2 AS da, (p.r - br) ** 2 + (p.gr - bg) ** 2 + (p.b - bb) ** 2 AS db))
    GROUP BY img_id, k, n, ar, ag, ab, br, bg, bb)
), last AS (SELECT *, row_number() OVER (PARTITION BY img_id, k ORDER BY n DESC) AS z FROM m), best AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY round(inertia, 3), k) AS y FROM last WHERE z = 1),
c AS (SELECT img_id, [floor(ar + 0.5::DOUBLE)::INT, floor(ag + 0.5::DOUBLE)::INT, floor(ab + 0.5::DOUBLE)::INT] AS a, [floor(br + 0.5::DOUBLE)::INT, floor(bg + 0.5::DOUBLE)::INT, floor(bb + 0.5::DOUBLE)::INT] AS b, na <= nb AS first FROM best WHERE y = 1),
d AS (SELECT *, abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3]) >= 50 AS fine FROM c)
SELECT i.img_id, CASE WHEN fine THEN array_to_string(CASE WHEN first THEN a ELSE b END, ',') ELSE '0,0,0' END AS text_rgb, CASE WHEN fine THEN array_to_string(CASE WHEN first THEN b ELSE a END, ',') ELSE '255,255,255' END AS stroke_rgb
FROM (SELECT DISTINCT img_id FROM fx_tiles) i LEFT JOIN d ON i.img_id = d.img_id""",
    "stroke_width": _STROKE + " SELECT img_id, round(stroke, 4) AS stroke FROM fx_stroke",
    "style_flags": styles_sql(),
    "grayscale": L.with_views("fx_tiles") + " SELECT img_id, y, x, CAST(round(0.299::DOUBLE * g + 0.587::DOUBLE * (255 - g) + 0.114::DOUBLE * x) AS INT) AS gray FROM fx_tiles",
    "safe_gap": L.with_views("fx_rows") + ", w AS (SELECT *, min(CASE WHEN row_std < 3.5 AND edge_density < 0.015 AND NOT forbidden THEN 1 ELSE 0 END) OVER f AS m, count(*) OVER f AS c FROM fx_rows WINDOW f AS (PARTITION BY page_id ORDER BY y ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)) SELECT page_id, y FROM w WHERE m = 1 AND c = 25",
    "forbidden_rows": _LINE + ", p AS (SELECT page_id, max(y2) AS h FROM fx_lines GROUP BY page_id), r AS (SELECT DISTINCT l.page_id, unnest(range(greatest(0, y1 - 25), least(h, y2 + 25))) AS y FROM fx_lines l JOIN p ON l.page_id = p.page_id) SELECT page_id, count(*) AS n_rows, CAST(min(y) AS INT) AS first, CAST(max(y) AS INT) AS last FROM r GROUP BY page_id",
    "smart_slice": L.with_views("fx_rows", recursive=True) + """, w AS (
  SELECT *, CASE WHEN min(CASE WHEN row_std < 3.5 AND edge_density < 0.015 AND NOT forbidden THEN 1 ELSE 0 END) OVER f = 1 AND count(*) OVER f = 25 THEN y + 12 END AS ok,
         100 * edge_density + row_std + CASE WHEN forbidden THEN 1e6 ELSE 0 END AS score, max(y) OVER (PARTITION BY page_id) + 1 AS h
  FROM fx_rows WINDOW f AS (PARTITION BY page_id ORDER BY y ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)
), n AS (
  SELECT page_id, y, h, CASE WHEN h - y <= 1800 THEN h ELSE coalesce(
           max(ok) OVER (PARTITION BY page_id ORDER BY y ROWS BETWEEN 1151 FOLLOWING AND 1425 FOLLOWING),
           max(ok) OVER (PARTITION BY page_id ORDER BY y ROWS BETWEEN 601 FOLLOWING AND 1125 FOLLOWING),
           max(ok) OVER (PARTITION BY page_id ORDER BY y ROWS BETWEEN 1451 FOLLOWING AND 1775 FOLLOWING),
           arg_min(y, struct_pack(s := score, y := y)) OVER (PARTITION BY page_id ORDER BY y ROWS BETWEEN 1300 FOLLOWING AND 1799 FOLLOWING)) END AS cut FROM w
), c AS (
  SELECT page_id, 0 AS part, y AS y1, cut AS y2, h FROM n WHERE y = 0
  UNION ALL
  SELECT n.page_id, part + 1, n.y, n.cut, n.h FROM c JOIN n ON n.page_id = c.page_id AND n.y = c.y2 WHERE c.y2 < c.h
) SELECT page_id, CAST(part AS INT) AS part, y1, y2 FROM c""",
    "stacked_offsets": L.with_views("fx_images") + " SELECT chapter_id, idx, CAST(coalesce(sum(h) OVER (PARTITION BY chapter_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y_offset, 'page_' || CASE WHEN row_number() OVER (PARTITION BY chapter_id ORDER BY idx) < 1000 THEN lpad((row_number() OVER (PARTITION BY chapter_id ORDER BY idx))::VARCHAR, 3, '0') ELSE (row_number() OVER (PARTITION BY chapter_id ORDER BY idx))::VARCHAR END || '.webp' AS file_name FROM fx_images",
    "archive_members": L.with_views("fx_images") + ", k AS (SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY idx) AS k FROM fx_images), f AS (SELECT chapter_id, 'page_' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END || '.webp' AS f FROM k) SELECT chapter_id, string_agg(f, ',' ORDER BY f) AS members, count(*) AS n FROM f GROUP BY chapter_id",
    "font_size": L.with_views("fx_lines", recursive=True) + """, b AS (
  SELECT page_id, line_no, length(raw_text) AS n, (x2 - x1)::DOUBLE AS w, (y2 - y1)::DOUBLE * 4 AS h FROM fx_lines
), s AS (
  SELECT page_id, line_no, list_reduce(range(1, 65), lambda a, i: a, NULL) AS z, list_reduce(list_transform(range(1, 65), lambda i: {'lo': 0::DOUBLE, 'hi': 0::DOUBLE, 'best': 0::DOUBLE}),
    lambda a, i: CASE WHEN ceil(n / greatest(w * 0.95::DOUBLE / ((a.lo + a.hi) * 0.5::DOUBLE * 0.52::DOUBLE), 1)) * 1.2::DOUBLE * ((a.lo + a.hi) * 0.5::DOUBLE) <= h * 0.95::DOUBLE
      THEN {'lo': (a.lo + a.hi) * 0.5::DOUBLE, 'hi': a.hi, 'best': (a.lo + a.hi) * 0.5::DOUBLE} ELSE {'lo': a.lo, 'hi': (a.lo + a.hi) * 0.5::DOUBLE, 'best': a.best} END,
    {'lo': 10::DOUBLE, 'hi': 150::DOUBLE, 'best': 10::DOUBLE}) AS r FROM b
) SELECT page_id, line_no, round(r.best, 6) AS font_size FROM s""",
    "safe_padding": _LINE + r""", s AS (SELECT page_id, line_no, y2 - y1 + line_no % 120 AS f, len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda w: w <> '')) <= 1 AS one FROM fx_lines),
k AS (SELECT *, CAST(CASE WHEN one THEN greatest(2, trunc(f * 0.08::DOUBLE)) ELSE greatest(1, trunc(f * 0.05::DOUBLE)) END AS INT) AS stroke FROM s) SELECT page_id, line_no, stroke, round(greatest(f * 0.3::DOUBLE + f * stroke, 15.0::DOUBLE), 6) AS padding FROM k""",
    "word_wrap": L.with_views("fx_lines", recursive=True) + r""", l AS (
  SELECT page_id, line_no, list_filter(regexp_split_to_array(raw_text, '\s+'), lambda w: w <> '') AS ws, (x2 - x1)::DOUBLE AS w, (y2 - y1)::DOUBLE * 3 AS h FROM fx_lines WHERE raw_text <> ''
), c AS (
  SELECT page_id, line_no, k, word, list_transform(range(0, length(word) + 1), lambda n: coalesce(list_sum(list_transform(string_split(left(word, n), ''), lambda x: CASE WHEN x = '' THEN 0 WHEN unicode(x) < 384 THEN 340 + 60 * (unicode(x) % 7) ELSE 520 END)), 0)::BIGINT) AS upto
  FROM (SELECT page_id, line_no, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM l)
), u AS (SELECT page_id, line_no, sum(upto[len(upto)]) AS total FROM c GROUP BY page_id, line_no),
s AS ( -- a line is no longer than the room, as two characters always fit; sizes at which the words alone need too many lines are left out
  SELECT z.* FROM (SELECT page_id, line_no, w * 950 AS room, h, len(ws) AS n, unnest(range(9, 41)) AS size FROM l WHERE len(ws) > 1) z JOIN u ON z.page_id = u.page_id AND z.line_no = u.line_no
  WHERE z.size = 9 OR total * z.size <= room * floor(h * 0.95::DOUBLE / (z.size * 0.7::DOUBLE + trunc(z.size * 0.45::DOUBLE)))
), r AS (
  SELECT page_id, line_no, size, 1::BIGINT AS k, 0::BIGINT AS p, []::VARCHAR[] AS lines, NULL::VARCHAR AS line, 0::BIGINT AS width, room, n FROM s
  UNION ALL
  SELECT page_id, line_no, size, CASE WHEN cut IS NULL THEN k + 1 ELSE k END, CASE WHEN cut IS NULL THEN 0 ELSE p + cut END,
         CASE WHEN cut IS NOT NULL THEN list_append(CASE WHEN line IS NULL THEN lines ELSE list_append(lines, line) END, substr(word, p + 1, cut) || '-')
              WHEN p > 0 OR line IS NULL OR (width + 580 + rest) * size <= room THEN lines ELSE list_append(lines, line) END,
         CASE WHEN cut IS NOT NULL THEN NULL WHEN p > 0 OR line IS NULL OR (width + 580 + rest) * size > room THEN substr(word, p + 1) ELSE line || ' ' || word END,
         CASE WHEN cut IS NOT NULL THEN 0 WHEN p > 0 OR line IS NULL OR (width + 580 + rest) * size > room THEN rest ELSE width + 580 + rest END, room, n
  FROM (
    SELECT r.*, c.word, c.upto[len(c.upto)] - c.upto[r.p + 1] AS rest,
           CASE WHEN (c.upto[len(c.upto)] - c.upto[r.p + 1]) * r.size > r.room AND length(c.word) - r.p > 1
                THEN greatest(1, len(list_filter(range(1, length(c.word) - r.p), lambda i: (c.upto[r.p + i + 1] - c.upto[r.p + 1] + 520) * r.size <= r.room))) END AS cut
    FROM r JOIN c ON r.page_id = c.page_id AND r.line_no = c.line_no AND r.k = c.k
  )
), t AS (
  SELECT s.page_id, s.line_no, s.size, list_append(r.lines, r.line) AS lines, len(r.lines) + 1 AS m, (len(r.lines) + 1) * (s.size * 0.7::DOUBLE + trunc(s.size * 0.45::DOUBLE)) <= s.h * 0.95::DOUBLE AS fits
  FROM s JOIN r ON s.page_id = r.page_id AND s.line_no = r.line_no AND s.size = r.size AND r.k = s.n + 1
), best AS (SELECT page_id, line_no, coalesce(max(size) FILTER (WHERE fits), 9) AS size, bool_or(fits) AS fits FROM t GROUP BY page_id, line_no),
one AS (
  SELECT l.page_id, l.line_no, c.word, max(z.size) FILTER (WHERE c.upto[len(c.upto)] * z.size / 1000 + 2 * greatest(2, trunc(z.size * 0.08::DOUBLE)) <= l.w * 1.5::DOUBLE
           AND z.size * 0.7::DOUBLE + trunc(z.size * 0.45::DOUBLE) + 2 * greatest(2, trunc(z.size * 0.08::DOUBLE)) <= l.h * 1.2::DOUBLE) AS size
  FROM l JOIN c ON l.page_id = c.page_id AND l.line_no = c.line_no, (SELECT unnest(range(10, 41, 2)) AS size) z WHERE len(l.ws) = 1 GROUP BY ALL
)
SELECT b.page_id, b.line_no, CAST(CASE WHEN b.fits THEN b.size ELSE 8 END AS INT) AS font_size, CAST(t.m AS INT) AS n_lines, array_to_string(t.lines, chr(10)) AS text FROM best b JOIN t ON b.page_id = t.page_id AND b.line_no = t.line_no AND b.size = t.size
UNION ALL SELECT page_id, line_no, CAST(coalesce(size, 8) AS INT), CASE WHEN size IS NULL THEN 0 ELSE 1 END, CASE WHEN size IS NULL THEN '' ELSE word END FROM one
UNION ALL SELECT page_id, line_no, 40, 0, '' FROM l WHERE len(ws) = 0""",
    "geometry": _LINE + ", g AS (SELECT *, (x2 - x1)::DOUBLE AS dx, angle * 2 AS dy, (y2 - y1)::DOUBLE AS h FROM fx_lines) SELECT page_id, line_no, round(degrees(atan2(dy, dx)), 6) AS tilt, round((sqrt((dy / 4) * (dy / 4) + h * h) + sqrt((dy / 4) * (dy / 4) + (h + 1) * (h + 1))) / 2, 6) AS true_height, CAST(greatest(0, trunc(x1 / 2)) AS INT) AS left, CAST(least(400, trunc(x2 / 2)) AS INT) AS right, CAST(floor((x1 - x2) / 2) AS INT) AS shift FROM g",
}
