"""Dialog bubbles: text lines linked by geometry, their transitive closure, and one row for each cluster."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.text import clean_line, has_letters, is_noise
from panelspark.operators.components import components
from panelspark.storage import materialize

#: Fixed value: how far lines may miss each other from the side.
SIDE_PX = -5.0
#: Height of a band by which a page's lines are dealt.
BAND = 256
#: Lines of a stretch of a page that is closed in one task; links that are held back there before they become a forest.
STRETCH, HELD = 4096, 200_000


@dataclass(frozen=True)
class MergeRule:
    """Limits within which two lines belong together; the defaults are fixed values. Ratios of sizes are 1 at least, all
    others 0."""

    max_size_ratio: float = 1.3
    max_gap_px: float = 10.0
    max_gap_ratio: float = 0.8
    max_overlap_ratio: float = 2.0
    max_angle_diff_deg: float = 12.0
    center_ratio: float = 0.6

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            object.__setattr__(self, name, max(1.0 if name == "max_size_ratio" else 0.0, float(value)))


def kept_lines(lines: DataFrame) -> DataFrame:
    """Lines with their cleaned ``text``, without noise and empty ones. The text is generated, not projected: a filter on a
    projected column would be written out in terms of the raw text and clean it once for each mention."""
    cleaned = lines.select("*", F.explode(F.array(clean_line(F.col("raw_text")))).alias("text"))
    return cleaned.where(~is_noise(F.col("text")) & (F.col("text") != ""))


def written_lines(lines: DataFrame) -> DataFrame:
    """The kept lines, without their raw text, as a written table: clustering reads them several times, and cleaning is what costs most."""
    return materialize(kept_lines(lines).drop("raw_text"), "lines")


def edges(lines: DataFrame, rule: MergeRule = MergeRule()) -> DataFrame:
    """(page_id, a, b): pairs of lines, a before b, that belong together.

    Linked lines are near in height, so lines are joined by page and band of the page, not by page alone: the
    work on one long page grows with its length. A pair is kept in the first band that both reach."""
    h = F.col("y2") - F.col("y1")
    reach = F.greatest(F.lit(rule.max_gap_px), rule.max_gap_ratio * F.greatest(h, F.lit(1)))
    box = lines.select("page_id", "line_no", "x1", "y1", "x2", "y2", "angle", F.floor((F.col("y1") - reach) / BAND).alias("lo"), F.floor((F.col("y2") + reach) / BAND).alias("hi"))
    box = box.select("*", F.explode(F.sequence("lo", "hi")).alias("band"))
    a, b = box.alias("a"), box.alias("b")
    c = F.col
    height = lambda s: c(f"{s}.y2") - c(f"{s}.y1")
    width = lambda s: c(f"{s}.x2") - c(f"{s}.x1")
    center = lambda s: (c(f"{s}.x1") + c(f"{s}.x2")) * 0.5
    low = F.greatest(F.least(height("a"), height("b")), F.lit(1)).cast("double")
    overlap = F.least(c("a.y2"), c("b.y2")) - F.greatest(c("a.y1"), c("b.y1"))
    side = F.least(c("a.x2"), c("b.x2")) - F.greatest(c("a.x1"), c("b.x1"))
    linked = (
        (c("a.page_id") == c("b.page_id")) & (c("a.band") == c("b.band")) & (c("a.line_no") < c("b.line_no")) & (c("a.band") == F.greatest(c("a.lo"), c("b.lo")))
        & (F.greatest(height("a"), height("b")) / low <= rule.max_size_ratio) & (F.abs(c("a.angle") - c("b.angle")) <= rule.max_angle_diff_deg) & (side >= SIDE_PX)
        & (F.abs(center("a") - center("b")) < F.greatest(width("a"), width("b"), F.lit(1)) * rule.center_ratio)
        & (overlap >= -F.greatest(F.lit(rule.max_gap_px), rule.max_gap_ratio * low)) & (overlap <= rule.max_overlap_ratio * low)
    )
    # the bands make rows that no estimate of the lines' size knows of, so neither side is broadcast
    return a.join(b.hint("merge"), linked).select(c("a.page_id").alias("page_id"), c("a.line_no").alias("a"), c("b.line_no").alias("b"))


def clusters(lines: DataFrame, rule: MergeRule = MergeRule()) -> DataFrame:
    """(page_id, line_no, cluster): the least line of each line's cluster; lines without a link stand alone."""
    return members(lines, rule).select("page_id", "line_no", "cluster")


def _forest(links: pa.Table) -> pa.Table:
    """(page_id, line_no, cluster): each line with a link, and the least line that links lead to."""
    pages = pc.dictionary_encode(links.column("page_id").combine_chunks())
    page, ends = pages.indices.to_numpy().astype(np.int64), [links.column(c).to_numpy().astype(np.int64) for c in ("a", "b")]
    least = min(int(e.min()) for e in ends) if len(page) else 0
    span = max(int(e.max()) for e in ends) - least + 1 if len(page) else 1
    nodes, at = np.unique(np.concatenate([page * span + e - least for e in ends]), return_inverse=True)
    a, b = at[: len(page)], at[len(page) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        hung = root.copy()
        np.minimum.at(hung, root[a], low)
        np.minimum.at(hung, root[b], low)
        while (hung[hung] != hung).any():
            hung = hung[hung]
        root = hung[root]
    number = links.schema.field("a").type
    lines = [pa.array(x % span + least).cast(number) for x in (nodes, nodes[root])]
    return pa.table([pages.dictionary.take(pa.array(nodes // span)), *lines], ["page_id", "line_no", "cluster"])


def _closed(batches: Iterator[pa.RecordBatch], stretch: int, held: int) -> Iterator[pa.RecordBatch]:
    """Links in order of page and stretch -> ``_forest`` of the links inside stretches, each stretch as a whole, and the links between
    stretches as they are, with ``far``."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        links = pa.Table.from_batches([batch])
        of = pc.floor(pc.divide(links.column("a").cast("double"), stretch))
        far = pc.not_equal(of, pc.floor(pc.divide(links.column("b").cast("double"), stretch)))
        for got in links.filter(far).to_batches():
            yield pa.record_batch([got.column("page_id"), got.column("b"), got.column("a"), pa.repeat(True, got.num_rows)], ["page_id", "line_no", "cluster", "far"])
        links, of = links.append_column("of", of).filter(pc.invert(far)), None
        links = links if rest is None else pa.concat_tables([rest, links])
        if not links.num_rows:
            continue
        last = links.slice(links.num_rows - 1)
        same = pc.and_(pc.equal(links.column("page_id"), last.column("page_id")[0]), pc.equal(links.column("of"), last.column("of")[0]))
        done, rest = links.filter(pc.invert(same)), links.filter(same)
        if rest.num_rows > held:
            trees = _forest(rest)
            trees = trees.filter(pc.not_equal(trees.column("line_no"), trees.column("cluster")))
            rest = pa.table([trees.column("page_id"), trees.column("cluster"), trees.column("line_no"), pa.repeat(last.column("of")[0], trees.num_rows)], links.schema)
        if done.num_rows:
            yield from _near(done)
    if rest is not None and rest.num_rows:
        yield from _near(rest)


def _near(links: pa.Table) -> Iterator[pa.RecordBatch]:
    trees = _forest(links)
    return iter(trees.append_column("far", pa.repeat(False, trees.num_rows)).combine_chunks().to_batches())


def closure(links: DataFrame) -> DataFrame:
    """(page_id, line_no, cluster) of lines with a link: the least line that its links lead to.

    Stretches of a page's lines are closed where they are dealt, in Arrow batches. What links between stretches join is closed as
    one graph of the stretches' clusters, so that no page is closed in one task."""
    stretch, held, count = STRETCH, HELD, Observation()
    of = F.floor(F.col("a") / stretch)
    dealt = links.repartition("page_id", of).sortWithinPartitions("page_id", of)
    kind = {f.name: f.dataType for f in links.schema}
    out = T.StructType([T.StructField("page_id", kind["page_id"]), T.StructField("line_no", kind["a"]), T.StructField("cluster", kind["a"]), T.StructField("far", T.BooleanType())])
    table = materialize(dealt.mapInArrow(lambda batches: _closed(batches, stretch, held), out).observe(count, F.count_if("far").alias("n")), "closed")
    near, far = table.where(~F.col("far")).drop("far"), table.where("far").drop("far")
    if not count.get["n"]:
        return near
    ends = far.select("page_id", "line_no").unionByName(far.select("page_id", F.col("cluster").alias("line_no"))).distinct()
    near = near.unionByName(ends.join(near, ["page_id", "line_no"], "left_anti").withColumn("cluster", F.col("line_no")))
    node = lambda end, name: near.select("page_id", F.col("line_no").alias(end), F.struct("page_id", F.col("cluster").alias("line_no")).alias(name))
    met = far.withColumnsRenamed({"line_no": "_b", "cluster": "_a"}).join(node("_a", "a"), ["page_id", "_a"]).join(node("_b", "b"), ["page_id", "_b"])
    tops = components(met.select("a", "b")).select(F.col("node.page_id").alias("page_id"), F.col("node.line_no").alias("cluster"), F.col("root.line_no").alias("top"))
    return near.join(tops, ["page_id", "cluster"], "left").select("page_id", "line_no", F.coalesce("top", "cluster").alias("cluster"))


def members(lines: DataFrame, rule: MergeRule = MergeRule()) -> DataFrame:
    """All columns of the lines with their cluster and, for the order inside it, their centre ``cy``."""
    labelled = lines.join(closure(edges(lines, rule)), ["page_id", "line_no"], "left")
    return labelled.withColumns({"cluster": F.coalesce("cluster", "line_no"), "cy": (F.col("y1") + F.col("y2")) / 2})


def bubbles(members: DataFrame) -> DataFrame:
    """One row for each cluster with more than two letters. Texts are joined in reading order within the aggregate; lines
    are dealt out by page, so that the page's order needs no second shuffle."""
    ordered = F.sort_array(F.collect_list(F.struct("cy", "line_no", "text")))
    rows = members.repartition("page_id").groupBy("page_id", "cluster").agg(
        F.array_join(F.transform(ordered, lambda m: m["text"]), " ").alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.avg((F.col("y2") - F.col("y1")).cast("double")).alias("line_height"), F.avg("angle").alias("angle"), F.bool_or("is_italic").alias("is_italic"), F.bool_or("is_bold").alias("is_bold"),
        F.count("*").alias("n_lines"), F.avg("cy").alias("cy"), F.min("line_no").alias("first_line"),
    )
    return rows.where(has_letters(F.upper("text"), 3))


def ranked(members: DataFrame) -> DataFrame:
    """(page_id, line_no, cluster, rank, block_no): each line's place in its cluster, and its cluster's in the page. All of
    it runs over lines dealt out by page once."""
    group = Window.partitionBy("page_id", "cluster")
    rows = members.repartition("page_id").select("page_id", "line_no", "cluster", "cy", F.min("y1").over(group).alias("top"), F.avg("cy").over(group).alias("mid"), F.min("line_no").over(group).alias("first_line"), (F.row_number().over(group.orderBy("cy", "line_no")) - 1).alias("rank"))
    return rows.select("page_id", "line_no", "cluster", "rank", (F.dense_rank().over(Window.partitionBy("page_id").orderBy("top", "mid", "first_line")) - 1).alias("block_no"))


def in_page_order(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("page_id").orderBy("y1", "cy", "first_line")
    return rows.withColumn("block_no", F.row_number().over(order) - 1)


