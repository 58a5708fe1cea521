"""Landed tables in the shapes that the operators read: text lines, tiles, images, strips, texts and replies.

Each is a deterministic view of whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw_text"))
    block = F.floor(F.col("line_no") / 4)
    x1 = 40 + (block % 2) * 260
    y1 = F.col("line_no") * 26 + block * 30
    return docs.select(
        "page_id", "line_no", "raw_text", x1.cast("int").alias("x1"), y1.cast("int").alias("y1"),
        (x1 + 60 + F.length("raw_text") % 200).cast("int").alias("x2"), (y1 + 18 + (F.col("page_id") * 7 + F.col("line_no") * 3) % 7).cast("int").alias("y2"),
        F.when((F.col("page_id") + F.col("line_no")) % 11 == 0, 15.0).otherwise(0.0).alias("angle"),
    ).withColumns({"is_italic": F.col("angle") > 10, "is_bold": F.col("line_no") % 5 == 0})


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("i", "v"))
    gray = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * F.col("v").cast("double"))))
    return rows.select("img_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), gray.cast("int").alias("g"))


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images of 16 rows, one for each vector, and 64 columns."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("img_id"), (F.col("vec_id") % 16).alias("k"), "embedding")
    first = rows.groupBy("img_id").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    rows = rows.join(first, "img_id").select("img_id", (F.array_position("ks", F.col("k")) - 1).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("img_id", "y", "x", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * F.col("v").cast("double")))).cast("int").alias("g"))


def image_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_brand").alias("chapter_id"), F.col("p_partkey").alias("idx"), (700 + F.col("p_size") % 3 * 100).cast("int").alias("w"), (400 + F.col("p_partkey") % 1700).cast("int").alias("h"))


def row_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y = F.col("page_id"), F.col("y")
    # few bytes become many rows, so strips are dealt before they are written out
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    rows = pages.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), 1499 + (k * 37) % 4000)).alias("y"))
    calm = (y + 97 * k) % 700 < 45
    return rows.select(
        "page_id", "y", F.when(calm, 1.0).otherwise(20.0 + (y * 31) % 17).alias("row_std"),
        F.when(calm, 0.0).otherwise(0.05 + ((y * 7) % 13) * 0.01).alias("edge_density"), ((y + 53 * k) % 900 < (k % 4) * 260).alias("forbidden"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter_id"), F.col("turn").alias("pos"), "text")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("chapter_id"), F.floor(F.col("event_id") / 8).alias("page_no"), (F.col("event_id") % 8).alias("block_no"), F.upper("event_type").alias("text"))


#: The same views for the SQL side.
SQL = {
    "fx_lines": """fx_lines AS (
  SELECT doc_id AS page_id, pos AS line_no, line AS raw_text, CAST(40 + ((pos // 4) % 2) * 260 AS INT) AS x1,
         CAST(pos * 26 + (pos // 4) * 30 AS INT) AS y1, CAST(40 + ((pos // 4) % 2) * 260 + 60 + (length(line) % 200) AS INT) AS x2,
         CAST(pos * 26 + (pos // 4) * 30 + 18 + ((doc_id * 7 + pos * 3) % 7) AS INT) AS y2,
         CASE WHEN (doc_id + pos) % 11 = 0 THEN 15.0 ELSE 0.0 END::DOUBLE AS angle,
         (doc_id + pos) % 11 = 0 AS is_italic, pos % 5 = 0 AS is_bold
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS pos FROM documents))""",
    "fx_clean": r"""fx_clean AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(replace(translate(raw_text, '|[]{}', 'IIIII'), 'ß', 'SS')),
         '[^A-Z0-9\s.,!?''"~-]', '', 'g'), '^\s+', ''), '\s+$', ''), '\s+', ' ', 'g') AS text FROM fx_lines)""",
    "fx_tiles": """fx_tiles AS (
  SELECT vec_id AS img_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x,
         CAST(least(255, greatest(0, floor(128 + 400 * embedding[i]::DOUBLE))) AS INT) AS g
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))""",
    "fx_strips": """fx_strips AS (
  SELECT vec_id // 16 AS img_id, CAST(dense_rank() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS INT) AS y, CAST(i - 1 AS INT) AS x,
         CAST(least(255, greatest(0, floor(128 + 400 * embedding[i]::DOUBLE))) AS INT) AS g
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))""",
    "fx_images": """fx_images AS (
  SELECT p_brand AS chapter_id, p_partkey AS idx, CAST(700 + (p_size % 3) * 100 AS INT) AS w, CAST(400 + p_partkey % 1700 AS INT) AS h FROM part)""",
    "fx_rows": """fx_rows AS (
  SELECT page_id, y, CASE WHEN (y + 97 * page_id) % 700 < 45 THEN 1.0::DOUBLE ELSE 20.0::DOUBLE + (y * 31) % 17 END AS row_std,
         CASE WHEN (y + 97 * page_id) % 700 < 45 THEN 0.0::DOUBLE ELSE 0.05::DOUBLE + ((y * 7) % 13) * 0.01::DOUBLE END AS edge_density,
         (y + 53 * page_id) % 900 < (page_id % 4) * 260 AS forbidden
  FROM (SELECT s_suppkey AS page_id, unnest(range(0, 1500 + (s_suppkey * 37) % 4000)) AS y FROM supplier))""",
    "fx_texts": "fx_texts AS (SELECT conv_id AS chapter_id, turn AS pos, text FROM conversations)",
    "fx_blocks": "fx_blocks AS (SELECT user_id AS chapter_id, event_id // 8 AS page_no, event_id % 8 AS block_no, upper(event_type) AS text FROM events)",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(SQL[n] for n in names)
