"""Prefix trie of conversations, built level by level.

Method: level-synchronous construction. A node is a distinct sequence of first turns. At each depth the conversations that
still share their node with another meet their next turn, are grouped by (parent node, turn), and the group's smallest
conversation names the new node. A conversation that is alone in its node is live no more: the rest of its path is a chain
whose nodes follow from its turns. Then, level by level in reverse, nodes are joined to the sums of their children, which
rolls up leaves and savings. There are as many levels as the longest beginning that two conversations share, however long
single conversations are. Each level is a table in the shared folder; the driver sees one count a level.

Turns are told apart by the SHA-256 of role and text, so that a text is read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from panelspark.llm.common import files_for, materialize

#: Rows of a level in one file; bytes of joined ids in one row on their way to a node's digest.
FILE_ROWS, RUN_BYTES = 50_000, 1 << 20
_WORD = r"[^\x20\x09-\x0D]+"
_NONE = hashlib.sha256(b"").hexdigest()


@dataclass
class Trie:
    """nodes: (depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), a node named by its depth and
    smallest conversation. ends: (depth, conv_id, conv), each conversation at the node where it ends."""

    nodes: DataFrame
    ends: DataFrame


def ordered(turns: DataFrame) -> DataFrame:
    """(conv, pos, key, words) of (conv_id, turn, role, text): places from 1, the digest of role and text, and the words of
    the text. Turns go by number, null first, ties by digest; equal rows stay, each in a place of its own. A null role
    or text is empty; rows without conv_id are left out; other columns are ignored.

    Rows are range-sorted, so that one endless conversation is spread over tasks. A place is the number within a range
    plus the rows of that conversation in earlier ranges, which are not zero for as many conversations as there are ranges."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("salt"))
    rows = materialize(rows, "turns")
    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["conv", F.asc_nulls_first("turn"), "key"]
    dealt = materialize(rows.repartitionByRange(width, *place, "salt").withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("conv", "range").agg(F.count("*").alias("n")).withColumn("shift", F.sum("n").over(before)).where("shift > 0").select("conv", "range", "shift")
    own = F.row_number().over(Window.partitionBy("conv", "range").orderBy(*place[1:])).cast("long")
    return dealt.withColumn("own", own).join(shift, ["conv", "range"], "left").select("conv", (F.col("own") + F.coalesce("shift", F.lit(0))).alias("pos"), "key", "words")


def build(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of (conv, pos, key, words), places from 1 without gaps, and (conv), every conversation once, those
    without turns too. Without conversations there is no node, not even the root."""
    spark = turns.sparkSession
    size = turns.groupBy("conv").agg(F.max("pos").alias("len"))
    convs = materialize(convs.join(size, "conv", "left").select("conv", F.coalesce("len", F.lit(0)).cast("long").alias("len")), "convs")
    first = convs.agg(F.min("conv").alias("least"), F.count("*").alias("n")).first()
    none = F.lit(None).cast("long")
    levels = [convs.select("conv", none.alias("parent"), F.lit(first["least"]).cast("long").alias("node"), F.lit(first["n"]).cast("long").alias("n"), F.lit(0).cast("long").alias("words"), "len")]
    rows = first["n"] if first["n"] > 1 else 0
    counts = [1]  # of rows in a level, at most
    while rows:
        depth = len(levels)
        live = levels[-1].where((F.col("n") > 1) & (F.col("len") >= depth)).select("conv", F.col("node").alias("parent"), "len")
        met = live.join(turns.where(F.col("pos") == depth).select("conv", "key", "words"), "conv")
        groups = met.groupBy("parent", "key").agg(F.min("conv").alias("node"), F.count("*").alias("n"))
        seen = Observation()
        level = met.join(groups, ["parent", "key"]).select("conv", "parent", "node", "n", "words", "len").observe(seen, F.count_if(F.col("n") > 1).alias("live"))
        levels.append(materialize(level, "level", files=files_for(spark, rows, FILE_ROWS)))
        counts.append(rows)
        rows = seen.get["live"]
    return Trie(_rolled_up(spark, turns, levels, counts), _ends(levels))


def _rolled_up(spark, turns: DataFrame, levels: list[DataFrame], counts: list[int]) -> DataFrame:
    done: list[DataFrame] = []
    below = None
    for depth in reversed(range(len(levels))):
        nodes = levels[depth].where(F.col("conv") == F.col("node")).select(F.lit(depth).cast("long").alias("depth"), F.col("node").alias("conv_id"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "words", "len")
        if below is None:
            nodes = nodes.withColumns({"c": F.lit(None).cast("long"), "v": F.lit(None).cast("long"), "s": F.lit(None).cast("long")})
        else:
            sums = below.groupBy("parent_conv_id").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("v"), F.sum("saved_tokens").alias("s")).withColumnRenamed("parent_conv_id", "conv_id")
            nodes = nodes.join(sums, "conv_id", "left")
        goes_on = ((F.col("n_convs") == 1) & (F.col("len") > depth)).cast("long")  # alone: a chain hangs below
        saved = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("s", F.lit(0))
        below = nodes.select("depth", "conv_id", "parent_conv_id", "n_convs", F.coalesce("c", goes_on).alias("n_children"), F.coalesce("v", F.lit(1)).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))
        below = materialize(below, "rolled", files=files_for(spark, counts[depth], FILE_ROWS))
        done.append(below)
    alone = None
    for depth, level in enumerate(levels):
        part = level.where((F.col("n") == 1) & (F.col("len") > depth)).select("conv", F.lit(depth).alias("top"), "len")
        alone = part if alone is None else alone.unionByName(part)
    chains = turns.select("conv", "pos").join(alone, "conv").where(F.col("pos") > F.col("top"))
    one = F.lit(1).cast("long")
    out = chains.select(F.col("pos").alias("depth"), F.col("conv").alias("conv_id"), F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), (F.col("pos") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    for part in done:
        out = out.unionByName(part)
    return out


def _ends(levels: list[DataFrame]) -> DataFrame:
    out = None
    for depth, level in enumerate(levels):
        here = level.where((F.col("len") == depth) | (F.col("n") == 1))
        part = here.select(F.col("len").alias("depth"), F.when(F.col("len") == depth, F.col("node")).otherwise(F.col("conv")).alias("conv_id"), "conv")
        out = part if out is None else out.unionByName(part)
    return out


def _runs(most: int):
    """Sorted (depth, conv_id, conv) -> (depth, conv_id, first, ids): stretches of one node's ids, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, out = None, [], 0, []

        def close() -> None:
            nonlocal held, size
            if held:
                out.append((*at, int(held[0]), ",".join(held).encode()))
            held, size = [], 0

        def told() -> pa.RecordBatch:
            cols = list(zip(*out)) or [(), (), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["depth", "conv_id", "first", "ids"])

        for batch in batches:
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, node) != at or size > most:
                    close()
                    at = depth, node
                held.append(str(conv))
                size += len(held[-1]) + 1
            if len(out) > 5000 or sum(len(x[3]) for x in out) > 8 * most:
                yield told()
        close()
        yield told()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in order -> (depth, conv_id, ends_sha256), one state at a time."""
    at, state, out = None, None, []
    for batch in batches:
        for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "ids"))):
            if (depth, node) != at:
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids)
        yield _told(out)
    if at is not None:
        out.append((*at, state.hexdigest()))
        yield _told(out)


def _told(out: list) -> pa.RecordBatch:
    cols = list(zip(*out)) or [(), (), ()]
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["depth", "conv_id", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256): SHA-256 of each node's ending conversations, ascending, joined by commas.

    The digest of a long list is sequential. Ranges of the sorted ids are joined to stretches by many tasks; what one task
    does for one node is to hash its stretches in order, one at a time."""
    width = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["depth", "conv_id", "conv"]
    runs = ends.select(*order).repartitionByRange(width, *order).sortWithinPartitions(*order).mapInArrow(_runs(RUN_BYTES), "depth long, conv_id long, first long, ids binary")
    return runs.repartition(width, "depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first").mapInArrow(_digests, "depth long, conv_id long, ends_sha256 string")


def _head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of every conversation c begun anew: the first h turns of c - c % 20, then its own after its first h."""
    own = materialize(ordered(turns), "ordered")
    size = own.groupBy("conv").agg(F.max("pos").alias("n"))
    convs = size.select("conv", (F.col("conv") - F.col("conv") % 20).alias("base"), _head(F.col("conv")).alias("h"))
    convs = convs.join(size.select(F.col("conv").alias("base"), "n"), "base", "left").withColumn("k", F.least("h", F.coalesce("n", F.lit(0))))
    convs = materialize(convs.select("conv", "base", "h", "k"), "begun")
    heads = own.where(F.col("pos") <= 3).select(F.col("conv").alias("base"), "pos", "key", "words")
    begun = convs.join(heads, "base").where(F.col("pos") <= F.col("h")).select("conv", "pos", "key", "words")
    kept = own.where(F.col("pos") > _head(F.col("conv"))).join(convs.where("k < h").select("conv", (F.col("h") - F.col("k")).alias("gone")), "conv", "left")
    # the first h places are another's; where that has fewer turns, all after it move up
    kept = kept.select("conv", (F.col("pos") - F.coalesce("gone", F.lit(0))).alias("pos"), "key", "words")
    return materialize(begun.unionByName(kept), "rebuilt"), convs.select("conv")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    turns, convs = rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    trie = build(turns, convs)
    digests = end_digests(trie.ends)
    out = trie.nodes.join(digests, ["depth", "conv_id"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))


OP11_SQL = r"""
WITH RECURSIVE b(i) AS (SELECT unnest(range(256))),
bits AS (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM b),
tbl AS (SELECT list(v ORDER BY i) AS t FROM bits),
o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos, k, words
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)
), n AS (SELECT c, max(pos) AS n FROM o GROUP BY c),
h AS (
  SELECT c, c - c % 20 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                         lambda s, x: xor(t[(xor(s, x) % 256) + 1], s // 256)), 4294967295) % 4 AS h
  FROM n, tbl
), k AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(n.n, 0)) AS k FROM h LEFT JOIN n ON h.base = n.c),
r AS (
  SELECT k.c, o.pos AS d, o.k, o.words FROM k JOIN o ON k.base = o.c AND o.pos <= k.h
  UNION ALL SELECT k.c, o.pos - k.h + k.k, o.k, o.words FROM k JOIN o ON k.c = o.c AND o.pos > k.h
), p AS (
  SELECT c, d, words, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM k
), m AS (SELECT c, max(d) AS last FROM p GROUP BY c),
g AS (
  SELECT d, path, min(p.c) AS conv_id, count(*) AS n, any_value(words) AS words,
         coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE m.last = d), '') AS ends
  FROM p JOIN m ON p.c = m.c GROUP BY d, path
), kids AS (SELECT d - 1 AS d, left(path, 64 * (d - 1)) AS path, count(*) AS n FROM g WHERE d > 0 GROUP BY 1, 2),
up AS (
  SELECT a.d, left(x.path, 64 * a.d) AS path, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.words) AS saved
  FROM g x LEFT JOIN kids ON x.d = kids.d AND x.path = kids.path, LATERAL (SELECT unnest(range(x.d + 1)) AS d) a GROUP BY 1, 2
)
SELECT CAST(g.conv_id AS BIGINT) AS conv_id, CAST(g.d AS BIGINT) AS depth, CAST(parent.conv_id AS BIGINT) AS parent_conv_id, CAST(g.n AS BIGINT) AS n_convs,
       CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(up.leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN up ON g.d = up.d AND g.path = up.path
LEFT JOIN kids ON g.d = kids.d AND g.path = kids.path
LEFT JOIN g parent ON g.d = parent.d + 1 AND left(g.path, 64 * (g.d - 1)) = parent.path
"""
