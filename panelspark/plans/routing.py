"""Queries over blocks, texts and replies: routing, batching, answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import text as X
from panelspark.operators import archive as K, folds, routing as R
from panelspark.sources import landed as L
from panelspark.storage import new_folder

#: The event types stand for sound words here.
WORDS = {"CLICK": "KLIK", "ERROR": "GALAT"}


def sfx_route(spark, d):
    return R.routed(L.blocks(spark, d), WORDS).select("chapter_id", "page_no", "block_no", "text", "sound")


def sound_words(spark, d):
    """The fixed dictionary's words in several spellings, doubled, and a word that it does not have."""
    words = F.array(*(F.lit(w) for w in [*sorted(R.SOUNDS), "HELLO"]))
    k = F.col("p_partkey")
    word = F.element_at(words, (k % 9 + 1).cast("int"))
    text = F.when(k % 4 == 0, F.concat(F.lower(word), F.lit("!! "))).when(k % 4 == 1, F.concat(F.lit(' "'), word, F.lit('"'))).when(k % 4 == 2, F.concat(word, F.lit(" "), word)).otherwise(F.concat(F.left(word, F.lit(2)), F.lit("-"), F.substr(word, F.lit(3))))
    rows = L.table(spark, d, "part").select(k.alias("block_no"), text.alias("text"))
    return R.routed(rows, R.SOUNDS).select("block_no", "text", "sound")


def ai_index(spark, d):
    return R.numbered(R.routed(L.blocks(spark, d), WORDS)).select("chapter_id", "page_no", "block_no", "ai_index")


def reattach(spark, d):
    rows = R.numbered(R.routed(L.blocks(spark, d), WORDS))
    # the queue has no answer for short words, which keep their own text
    answers = rows.where("sound is null and length(text) > 5").select("chapter_id", "ai_index", F.concat(F.lit("T:"), F.lower("text")).alias("answer"))
    return R.reattached(rows, answers).select("chapter_id", "page_no", "block_no", "translated")


def lone_word_pages(spark, d):
    rows = L.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chapter_id"), F.col("l_suppkey").alias("page_no"), F.col("l_linenumber").alias("block_no"), F.when(F.col("l_quantity") > 25, F.concat_ws(" ", "l_returnflag", "l_linestatus")).otherwise(F.col("l_returnflag")).alias("text"))
    return R.without_lone_words(rows).groupBy("chapter_id", "page_no").agg(F.count("*").alias("n_blocks"))


def domain_dispatch(spark, d):
    return R.dispatched(L.table(spark, d, "pages").select("page_id", "url"), [("example.com", "com"), ("example.net", "net"), ("example", "other")]).select("page_id", "module")


def target_union(spark, d):
    pages = L.table(spark, d, "pages")
    listed = pages.select(F.col("page_id").alias("pos"), F.parse_url("url", F.lit("HOST")).alias("url"))
    direct = pages.select(F.col("page_id").alias("pos"), F.concat(F.regexp_extract("url", r"/([a-z]+)/", 1), F.lit(".example.com")).alias("url"))
    return R.target_union(listed, direct)


def font_roles(spark, d):
    rows = L.text_lines(spark, d)
    n = F.size(X.words(F.col("raw_text")))
    return rows.select("page_id", "line_no", R.font_role(n, F.col("y2") - F.col("y1") + n * 30, F.col("is_bold"), F.col("is_italic")).alias("role"))


def font_files(spark, d):
    """The font file of each role where two of four files are there."""
    rows = font_roles(spark, d)
    files = {"normal": "f/n.ttf", "bold": "f/b.ttf", "italic": "f/i.ttf", "sfx": "f/s.ttf"}
    return rows.select("page_id", "line_no", R.font_file(F.col("role"), files, ["f/n.ttf", "f/s.ttf"]).alias("font"))


def typeset_filter(spark, d):
    rows = L.text_lines(spark, d)
    h = F.col("y2") - F.col("y1")
    keep = R.typeset_kept(F.size(X.words(F.col("raw_text"))), h * 3.0, F.col("angle"), F.length("raw_text") * 0.4, F.col("x2") - F.col("x1"), h)
    return rows.where(keep).select("page_id", "line_no")


def _texts(spark, d):
    return L.texts(spark, d).withColumn("n", F.length("text"))


def batch_outer(spark, d):
    return folds.outer_batches(_texts(spark, d)).select("chapter_id", "pos", "batch_no")


def batch_inner(spark, d):
    return folds.inner_batches(_texts(spark, d)).select("chapter_id", "pos", "batch_no")


def prompt_text(spark, d):
    """Each request's prompt. A request is bounded in items and characters, so its texts are one small array."""
    batches = folds.outer_batches(_texts(spark, d))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    body = F.array_join(F.transform(ordered, lambda m: m["text"]), f"\n{X.SEPARATOR}\n")
    head = "INSTRUCTION: Translate.\n\nATURAN PENTING: Keep the separator.\n\nTEKS SUMBER:\n\n"
    return batches.groupBy("chapter_id", "batch_no").agg(F.concat(F.lit(head), body).alias("prompt"), F.count("*").alias("n_texts"))


def merge_groups(spark, d):
    rows = folds.merge_groups(L.image_info(spark, d))
    first = Window.partitionBy("chapter_id", "group_no").orderBy("idx")
    scaled = rows.withColumn("w0", F.first("w").over(first)).withColumn("scaled_h", (F.col("h") * (F.col("w0") / F.col("w"))).cast("long"))
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    return scaled.select("chapter_id", "idx", "group_no", "scaled_h", F.coalesce(F.sum("scaled_h").over(before), F.lit(0)).alias("y_offset"))


def _replies(spark, d):
    """Per chapter, its texts as an answer in one of three shapes: with separators, as lines, cut short."""
    items = F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("text", "\n", " ").alias("t"))))
    rows = L.texts(spark, d).groupBy("chapter_id").agg(items.alias("m"))
    numbered = F.transform("m", lambda m: F.concat((m["pos"] + 1).cast("string"), F.lit(". "), m["t"]))
    kind = F.col("chapter_id") % 3
    reply = F.when(kind == 0, F.array_join(numbered, f"\n{X.SEPARATOR}\n")).when(kind == 1, F.array_join(numbered, "\n")).otherwise(F.array_join(F.slice(numbered, 1, F.greatest(F.size("m") - 1, F.lit(1))), f"\n{X.SEPARATOR}\n"))
    return rows.select("chapter_id", reply.alias("reply"), F.size("m").alias("expected"), F.transform("m", lambda m: m["t"]).alias("source"))


def clean_answers(spark, d):
    rows = L.texts(spark, d).withColumn("raw", F.when(F.col("pos") % 3 == 0, F.concat((F.col("pos") + 1).cast("string"), F.lit(") "), F.col("text"))).when(F.col("pos") % 3 == 1, F.concat(F.lit(" Terjemahan: "), F.col("text"))).otherwise(F.concat(F.lit("Note: "), F.col("text"))))
    return rows.select("chapter_id", "pos", X.clean_answer(F.col("raw")).alias("answer"))


def extract_answers(spark, d):
    return _replies(spark, d).select("chapter_id", F.posexplode(X.extract_answers(F.col("reply"))).alias("k", "answer"))


def verify_answers(spark, d):
    got = X.verified_answers(F.col("reply"), F.col("expected"))
    return _replies(spark, d).select("chapter_id", got.isNotNull().alias("verified"), F.coalesce(F.size(got), F.lit(-1)).alias("n_answers"))


def fallback_chain(spark, d):
    """Four attempts: the main service twice, then two others, each with an answer for some chapters only."""
    units = _replies(spark, d)
    joined = lambda x: F.array_join(x, f"\n{X.SEPARATOR}\n")
    main = units.select("chapter_id", "reply")

    def some(rest: int, change):
        told = units.select("chapter_id", joined(F.transform("source", change)).alias("reply"))
        return lambda left: left.where(F.col("chapter_id") % 4 == rest).select("chapter_id").join(told, "chapter_id")

    attempts = [lambda left: left.select("chapter_id").join(main, "chapter_id"), some(0, F.upper), some(1, F.lower), some(2, lambda t: F.concat(F.lit("T "), t))]
    return R.attempted(units, "chapter_id", attempts).select("chapter_id", "attempt", F.posexplode("answers").alias("k", "answer"))


def _log(spark, d, entry):
    """A chapter's log: the queue in order as a JSON array, written to files that follow one another, and read back."""
    rows = R.numbered(R.routed(L.blocks(spark, d), WORDS)).where("sound is null").select("chapter_id", "ai_index", entry.alias("entry"))
    folder = new_folder(spark, "log")
    K.write_ordered(K.log_lines(rows, "chapter_id", "ai_index", "entry"), "chapter_id", folder)
    return K.read_ordered(spark, folder, "chapter_id", "line").withColumnRenamed("line", "log")


def ai_log_json(spark, d):
    return _log(spark, d, F.col("text"))


def ai_output_json(spark, d):
    """The answers in the queue's order."""
    return _log(spark, d, F.concat(F.lit("T:"), F.lower("text")))


_ROUTED = L.with_views("fx_blocks") + """, fx_routed AS (SELECT *, CASE text WHEN 'CLICK' THEN 'KLIK' WHEN 'ERROR' THEN 'GALAT' END AS sound FROM fx_blocks),
fx_numbered AS (SELECT *, CASE WHEN sound IS NULL THEN CAST(sum(CASE WHEN sound IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY chapter_id ORDER BY page_no, block_no ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) END AS ai_index FROM fx_routed)"""
_TEXTS = """WITH RECURSIVE fx_texts AS (SELECT conv_id AS chapter_id, turn AS pos, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations)"""
_OUTER = _TEXTS + """, fx_fold AS (
  SELECT chapter_id, pos, text, k, 0::BIGINT AS batch_no, n AS chars, 1 AS items FROM fx_texts WHERE k = 1
  UNION ALL
  SELECT t.chapter_id, t.pos, t.text, t.k, CASE WHEN f.chars + t.n > 1000 OR f.items >= 25 THEN f.batch_no + 1 ELSE f.batch_no END,
         CASE WHEN f.chars + t.n > 1000 OR f.items >= 25 THEN t.n ELSE f.chars + t.n END, CASE WHEN f.chars + t.n > 1000 OR f.items >= 25 THEN 1 ELSE f.items + 1 END
  FROM fx_fold f JOIN fx_texts t ON t.chapter_id = f.chapter_id AND t.k = f.k + 1)"""
_STRIP = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def _answer(x: str) -> str:
    bare = rf"regexp_replace({_STRIP.format(x=x)}, '^\d+[.\)]\s*', '')"
    rest = _STRIP.format(x=f"substr({bare}, instr({bare}, ':') + 1)")
    return f"CASE WHEN instr({bare}, ':') > 0 AND contains(lower(split_part({bare}, ':', 1)), 'terjemah') THEN {rest} ELSE {bare} END"


_REPLIES = r"""WITH r AS (
  SELECT chapter_id, list(t ORDER BY pos, t) AS source, list((pos + 1)::VARCHAR || '. ' || t ORDER BY pos, t) AS items
  FROM (SELECT conv_id AS chapter_id, turn AS pos, replace(text, chr(10), ' ') AS t FROM conversations) GROUP BY chapter_id
), fx_replies AS (
  SELECT chapter_id, source, CAST(len(source) AS INT) AS expected,
         CASE chapter_id % 3 WHEN 0 THEN array_to_string(items, chr(10) || '130495848' || chr(10)) WHEN 1 THEN array_to_string(items, chr(10))
              ELSE array_to_string(items[1:greatest(len(items) - 1, 1)], chr(10) || '130495848' || chr(10)) END AS reply FROM r
), fx_parts AS (
  SELECT *, CASE WHEN contains(reply, '130495848') THEN string_split(reply, '130495848') ELSE list_filter(string_split(reply, chr(10)), lambda v: trim(v) <> '') END AS raw FROM fx_replies
), fx_found AS (SELECT *, list_filter(list_transform(raw, lambda v: """ + _answer("v") + r"""), lambda v: v <> '' OR NOT contains(reply, '130495848')) AS answers FROM fx_parts
), fx_lines2 AS (SELECT *, list_transform(list_filter(string_split(reply, chr(10)), lambda v: trim(v) <> '' AND NOT contains(v, '130495848')), lambda v: """ + _answer("v") + r""") AS plain FROM fx_found
), fx_verified AS (SELECT *, CASE WHEN len(answers) = expected THEN answers WHEN len(plain) = expected THEN plain END AS got FROM fx_lines2)"""

_LOG = " SELECT chapter_id, '[' || chr(10) || string_agg('    ' || to_json({x})::VARCHAR, ',' || chr(10) ORDER BY ai_index) || chr(10) || ']' || chr(10) AS log FROM fx_numbered WHERE sound IS NULL GROUP BY chapter_id"
QUERIES = {f.__name__: f for f in (sfx_route, sound_words, ai_index, reattach, lone_word_pages, domain_dispatch, target_union, font_roles, font_files, typeset_filter, batch_outer, batch_inner, prompt_text, merge_groups, clean_answers, extract_answers, verify_answers, fallback_chain, ai_log_json, ai_output_json)}
_WORDS = r"len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda w: w <> ''))"
ORACLE = {
    "sound_words": """WITH w AS (SELECT p_partkey AS block_no, ['BAM', 'DROP', 'SHOCKED', 'SIGH', 'SLAP', 'SPRING', 'UHH', 'WHOOSH', 'HELLO'][p_partkey % 9 + 1] AS w, ['DUAG', 'JATUH', 'KAGET', 'HAHH', 'PLAK', 'SPRING', 'EHH', 'WUSSS', NULL][p_partkey % 9 + 1] AS s FROM part)
SELECT block_no, CASE block_no % 4 WHEN 0 THEN lower(w) || '!! ' WHEN 1 THEN ' "' || w || '"' WHEN 2 THEN w || ' ' || w ELSE left(w, 2) || '-' || substr(w, 3) END AS text, CASE WHEN block_no % 4 <> 2 THEN s END AS sound FROM w""",
    "font_files": L.with_views("fx_lines") + f" SELECT page_id, line_no, CASE WHEN {_WORDS} <= 1 AND y2 - y1 + {_WORDS} * 30 > 50 THEN 'f/s.ttf' ELSE 'f/n.ttf' END AS font FROM fx_lines",
    "sfx_route": _ROUTED + " SELECT chapter_id, page_no, block_no, text, sound FROM fx_routed",
    "ai_index": _ROUTED + " SELECT chapter_id, page_no, block_no, ai_index FROM fx_numbered",
    "reattach": _ROUTED + " SELECT chapter_id, page_no, block_no, coalesce(sound, CASE WHEN length(text) > 5 THEN 'T:' || lower(text) END, text) AS translated FROM fx_numbered",
    "lone_word_pages": """WITH b AS (SELECT l_orderkey AS chapter_id, l_suppkey AS page_no, CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS w FROM lineitem)
SELECT chapter_id, page_no, count(*) AS n_blocks FROM b GROUP BY chapter_id, page_no HAVING NOT (count(*) = 1 AND max(w) <= 1)""",
    "domain_dispatch": "SELECT page_id, CASE WHEN contains(lower(url), 'example.com') THEN 'com' WHEN contains(lower(url), 'example.net') THEN 'net' WHEN contains(lower(url), 'example') THEN 'other' END AS module FROM pages",
    "target_union": """WITH l AS (SELECT page_id AS pos, regexp_extract(url, '://([^/?#]+)', 1) AS url FROM pages), x AS (SELECT page_id AS pos, regexp_extract(url, '/([a-z]+)/', 1) || '.example.com' AS url FROM pages)
SELECT 0 AS part, pos, url FROM l WHERE trim(url) <> '' UNION ALL SELECT 1, min(pos), url FROM x WHERE trim(url) <> '' AND url NOT IN (SELECT url FROM l WHERE url IS NOT NULL) GROUP BY url""",
    "font_roles": L.with_views("fx_lines") + f" SELECT page_id, line_no, CASE WHEN {_WORDS} <= 1 AND y2 - y1 + {_WORDS} * 30 > 50 THEN 'sfx' WHEN is_bold THEN 'bold' WHEN is_italic THEN 'italic' ELSE 'normal' END AS role FROM fx_lines",
    "typeset_filter": L.with_views("fx_lines") + f" SELECT page_id, line_no FROM fx_lines WHERE NOT ({_WORDS} <= 1 AND trunc((y2 - y1) * 3.0::DOUBLE * 0.9::DOUBLE) > 50 AND abs(angle) > 5) AND length(raw_text) * 0.4::DOUBLE <= 120 AND x2 - x1 >= 6 AND y2 - y1 >= 6",
    "batch_outer": _OUTER + " SELECT chapter_id, pos, batch_no FROM fx_fold",
    "batch_inner": _TEXTS + """, fx_fold AS (
  SELECT chapter_id, pos, k, 0::BIGINT AS batch_no, CASE WHEN n + 9 > 1500 THEN n ELSE n + 9 END AS chars FROM fx_texts WHERE k = 1
  UNION ALL
  SELECT t.chapter_id, t.pos, t.k, CASE WHEN f.chars + t.n + 9 > 1500 THEN f.batch_no + 1 ELSE f.batch_no END, CASE WHEN f.chars + t.n + 9 > 1500 THEN t.n ELSE f.chars + t.n + 9 END
  FROM fx_fold f JOIN fx_texts t ON t.chapter_id = f.chapter_id AND t.k = f.k + 1) SELECT chapter_id, pos, batch_no FROM fx_fold""",
    "prompt_text": _OUTER + """ SELECT chapter_id, batch_no, 'INSTRUCTION: Translate.' || chr(10) || chr(10) || 'ATURAN PENTING: Keep the separator.' || chr(10) || chr(10) || 'TEKS SUMBER:' || chr(10) || chr(10) || string_agg(text, chr(10) || '130495848' || chr(10) ORDER BY pos, text) AS prompt, count(*) AS n_texts FROM fx_fold GROUP BY chapter_id, batch_no""",
    "merge_groups": L.with_views("fx_images", recursive=True) + """, i AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY idx) AS k FROM fx_images), f AS (
  SELECT chapter_id, idx, k, 0::BIGINT AS group_no, w AS w0, CAST(h AS BIGINT) AS scaled_h, CAST(h AS BIGINT) AS total FROM i WHERE k = 1
  UNION ALL
  SELECT i.chapter_id, i.idx, i.k, CASE WHEN f.total >= 8000 THEN f.group_no + 1 ELSE f.group_no END, CASE WHEN f.total >= 8000 THEN i.w ELSE f.w0 END,
         CASE WHEN f.total >= 8000 THEN i.h ELSE CAST(trunc(i.h * (f.w0::DOUBLE / i.w)) AS BIGINT) END, CASE WHEN f.total >= 8000 THEN i.h ELSE f.total + CAST(trunc(i.h * (f.w0::DOUBLE / i.w)) AS BIGINT) END
  FROM f JOIN i ON i.chapter_id = f.chapter_id AND i.k = f.k + 1)
SELECT chapter_id, idx, group_no, scaled_h, CAST(coalesce(sum(scaled_h) OVER (PARTITION BY chapter_id, group_no ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y_offset FROM f""",
    "clean_answers": "WITH t AS (SELECT conv_id AS chapter_id, turn AS pos, CASE turn % 3 WHEN 0 THEN (turn + 1)::VARCHAR || ') ' || text WHEN 1 THEN ' Terjemahan: ' || text ELSE 'Note: ' || text END AS raw FROM conversations) SELECT chapter_id, pos, " + _answer("raw") + " AS answer FROM t",
    "extract_answers": _REPLIES + " SELECT chapter_id, CAST(generate_subscripts(answers, 1) - 1 AS INT) AS k, unnest(answers) AS answer FROM fx_found",
    "verify_answers": _REPLIES + " SELECT chapter_id, got IS NOT NULL AS verified, CAST(coalesce(len(got), -1) AS INT) AS n_answers FROM fx_verified",
    "fallback_chain": _REPLIES + ", c AS (SELECT *, list_transform(source, lambda v: " + _answer("v") + ") AS own FROM fx_verified), z AS (SELECT chapter_id, CASE WHEN got IS NOT NULL THEN 1 WHEN chapter_id % 4 < 3 THEN chapter_id % 4 + 2 END AS attempt, CASE WHEN got IS NOT NULL THEN got WHEN chapter_id % 4 = 0 THEN list_transform(source, lambda v: upper(replace(" + _STRIP.format(x="v") + ", 'ß', 'SS'))) WHEN chapter_id % 4 = 1 THEN list_transform(source, lambda v: lower(" + _STRIP.format(x="v") + ")) WHEN chapter_id % 4 = 2 THEN list_transform(source, lambda v: " + _STRIP.format(x="'T ' || v") + ") ELSE source END AS a FROM c) SELECT chapter_id, CAST(attempt AS INT) AS attempt, CAST(generate_subscripts(a, 1) - 1 AS INT) AS k, unnest(a) AS answer FROM z",
    "ai_output_json": _ROUTED + _LOG.format(x="'T:' || lower(text)"),
    "ai_log_json": _ROUTED + _LOG.format(x="text"),
}
