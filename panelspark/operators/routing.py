"""Routing of text blocks: sound words by dictionary, all others to a numbered queue, and answers back to blocks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import text as X
from panelspark.storage import materialize

#: Sound words and their translations.
SOUNDS = {"DROP": "JATUH", "BAM": "DUAG", "WHOOSH": "WUSSS", "SLAP": "PLAK", "SIGH": "HAHH", "UHH": "EHH", "SPRING": "SPRING", "SHOCKED": "KAGET"}


def without_lone_words(blocks: DataFrame) -> DataFrame:
    """Pages whose only block has at most one word lose it."""
    lone = blocks.groupBy("chapter_id", "page_no").agg(F.count("*").alias("n"), F.max(F.size(X.words(F.col("text")))).alias("most")).where("n = 1 and most <= 1")
    return blocks.join(lone, ["chapter_id", "page_no"], "left_anti")


def routed(blocks: DataFrame, sounds: dict[str, str]) -> DataFrame:
    """With ``sound``, the dictionary's answer for a block of one word, else null. The dictionary is a literal map."""
    entries = [F.lit(x) for pair in sorted(sounds.items()) for x in pair]
    up = F.upper("text")
    found = F.try_element_at(F.create_map(*entries), X.letters(up))
    return blocks.withColumn("sound", F.when(F.size(X.words(up)) == 1, found))


def numbered(rows: DataFrame) -> DataFrame:
    """With ``ai_index``: the place of each queued block among the chapter's queued blocks, in page and block order.

    A running count over a whole chapter would make one task of the largest chapter. Pages are counted first; the
    running sum goes over pages, and blocks are numbered within their page."""
    queued = F.col("sound").isNull().cast("long")
    pages = rows.groupBy("chapter_id", "page_no").agg(F.sum(queued).alias("n"))
    before = Window.partitionBy("chapter_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = pages.select("chapter_id", "page_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("chapter_id", "page_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("k", F.sum(queued).over(inside)).join(offset, ["chapter_id", "page_no"])
    return out.withColumn("ai_index", F.when(F.col("sound").isNull(), F.col("k") + F.col("offset") - 1)).drop("k", "offset")


def reattached(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """With ``translated``: the dictionary's answer, else the queue's at that index, else the block's own text."""
    given = answers.select("chapter_id", "ai_index", "answer")
    return rows.join(given, ["chapter_id", "ai_index"], "left").withColumn("translated", F.coalesce("sound", "answer", "text"))


def dispatched(urls: DataFrame, domains: list[tuple[str, str]]) -> DataFrame:
    """With ``module``: that of the first domain that occurs in the lower-cased url. Domains are a short literal list."""
    chain: Column = F.lit(None).cast("string")
    for domain, module in reversed(domains):
        chain = F.when(F.contains(F.lower("url"), F.lit(domain)), F.lit(module)).otherwise(chain)
    return urls.withColumn("module", chain)


def target_union(listed: DataFrame, direct: DataFrame) -> DataFrame:
    """(pos, url): listed chapters with their repeats, then direct ones that were not seen, each once, in order."""
    clean = lambda df: df.withColumn("url", X.strip(F.col("url"))).where(F.col("url") != "")
    new = clean(direct).groupBy("url").agg(F.min("pos").alias("pos")).join(clean(listed).select("url"), "url", "left_anti")
    return clean(listed).select(F.lit(0).alias("part"), "pos", "url").unionByName(new.select(F.lit(1).alias("part"), "pos", "url"))


def font_role(words: Column, size: Column, bold: Column, italic: Column) -> Column:
    return F.when((words <= 1) & (size > 50), "sfx").when(bold, "bold").when(italic, "italic").otherwise("normal")


def font_file(role: Column, files: dict[str, str], present: list[str]) -> Column:
    """The file of a role's font; that of the normal one where the role's is not among those ``present``."""
    chain: Column = F.lit(files["normal"])
    for name, path in files.items():
        if path in present:
            chain = F.when(role == name, F.lit(path)).otherwise(chain)
    return chain


def typeset_kept(words: Column, line_height: Column, angle: Column, estimate: Column, box_w: Column, box_h: Column) -> Column:
    """Blocks that are set: no tilted large sound word, no giant text, no tiny box."""
    tilted = (words <= 1) & ((line_height * 0.9).cast("int") > 50) & (F.abs(angle) > 5)
    return ~tilted & (estimate <= 120) & (box_w >= 6) & (box_h >= 6)


def attempted(units: DataFrame, key: str, attempts: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(key, attempt, answers) of (key, expected, source): the answers of the first attempt, from 1, whose reply has as many as
    expected; the source's texts, with a null attempt, where none has.

    An attempt is a function of the units that are still open, with columns (key, reply) as its result. What it replies is
    written before it is judged: an attempt may be a paid call, and is made once for each unit that all before it
    left open. Units without a reply stay open; of several replies to one unit the first that is verified, by text, counts."""
    left, done = units.select(key, "expected", "source"), []
    for number, attempt in enumerate(attempts, 1):
        replies = materialize(attempt(left).select(key, "reply"), "replies")
        judged = left.join(replies, key).withColumn("answers", X.verified_answers(F.col("reply"), F.col("expected"))).where("answers is not null")
        judged = materialize(judged.groupBy(key).agg(F.min_by("answers", "reply").alias("answers")), "answers")
        done.append(judged.select(key, F.lit(number).alias("attempt"), "answers"))
        left = materialize(left.join(judged, key, "left_anti"), "open")
    done.append(left.select(key, F.lit(None).cast("int").alias("attempt"), F.col("source").alias("answers")))
    return reduce(DataFrame.unionByName, done)
