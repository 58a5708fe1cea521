"""Chat formatting with perspective rotation.

Method: every participant of a dialogue is once the assistant. For each of them the whole dialogue is
rendered, their turns as assistant, those of others as users by name, with the character spans of the
assistant's own words as the training mask. It is all DataFrame functions. A dialogue is a table of segments, one for each
turn, whose starts are a running sum; an endless dialogue is range-sorted over many tasks, and its starts are sums
within a range plus those of earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators import chains


def _clean(x: Column) -> Column:
    """Marker strings in a text are broken up, so that no text can open or close a turn."""
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def segments(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, pos, start, text, mask): for every participant and turn, the turn as rendered from their side.

    Participants are the dialogue's non-null roles but ``system``, whose turns stay system turns. A turn is
    ``<|assistant|>``, ``<|user:NAME|>`` or ``<|system|>``, a line break, the text, ``<|end|>`` and a line break. ``pos`` counts from 1,
    ``start`` is the turn's place in the whole text, in characters. ``mask`` is the span "start-stop" of the assistant's words
    and end mark in the whole text, null for others' turns. Turns are ordered by turn, role and text; those without number
    come last; ties and repeated rows stay. A null text is empty; a null role is the user ``unknown``. A dialogue without
    participant has no perspective and gives no row. An empty table gives none; other columns are ignored."""
    role, turn = F.col(role_col).cast("string"), F.col(turn_col).cast("long")
    rows = turns.select(F.col(conv_col).alias("conv_id"), turn.isNull().alias("late"), turn.alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), role.isNotNull().alias("named"), _clean(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words"))
    people = rows.where("named and role <> 'system'").select("conv_id", F.col("role").alias("speaker")).distinct()
    both = chains.joined(rows, people, ["conv_id"])
    own = F.col("role") == F.col("speaker")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("role") == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), _clean(F.col("role")), F.lit("|>\n")))
    both = both.withColumn("head", F.length(head)).withColumn("text", F.concat(head, F.col("words"), F.lit("<|end|>\n"))).withColumn("size", F.length("text"))
    key, order = ["conv_id", "speaker"], ["late", "turn", "role", "words"]
    placed = chains.placed(both, key, order, "size", chains.is_short(both, key))
    span = F.concat((F.col("before") + F.col("head")).cast("string"), F.lit("-"), (F.col("before") + F.col("size") - 1).cast("string"))
    return placed.select(*key, F.col("place").alias("pos"), F.col("before").alias("start"), "text", F.when(own, span).alias("mask"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, n_turns, text, mask): the ``segments`` of each perspective joined in order, whatever their
    number; ``mask`` lists the spans. A dialogue that does not fit a row has to be read as segments."""
    said = segments(turns, conv_col, turn_col, role_col, text_col)
    whole = F.expr("listagg(text) WITHIN GROUP (ORDER BY pos)")
    spans = F.coalesce(F.expr("listagg(mask, ';') WITHIN GROUP (ORDER BY pos)"), F.lit(""))
    return said.groupBy("conv_id", "speaker").agg(F.count("*").alias("n_turns"), whole.alias("text"), spans.alias("mask"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), m AS (
  SELECT t.conv_id, speaker, turn, role, body,
         CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user:' || role || '|>' || chr(10) END AS head,
         row_number() OVER (PARTITION BY t.conv_id, speaker ORDER BY turn, role, body) AS k
  FROM t JOIN s ON t.conv_id = s.conv_id
), o AS (
  SELECT *, head || body || '<|end|>' || chr(10) AS seg,
         coalesce(sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id, speaker ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift
  FROM m
)
SELECT conv_id, speaker, CAST(count(*) AS BIGINT) AS n_turns, string_agg(seg, '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(CAST(shift + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(shift + length(head) + length(body) + 7 AS BIGINT) AS VARCHAR), ';' ORDER BY k)
                FILTER (WHERE role = speaker), '') AS mask
FROM o GROUP BY conv_id, speaker
"""
