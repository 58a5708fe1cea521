"""Chains: rows reached from a group's first row by stepping from each row to its successor.

Packing folds depend on all that came before, but where the next pack starts follows from where this one starts. So every
row gets its successor at once, from a bounded stretch of rows behind it, and what remains is to find the rows that a walk
from the first row meets. A short group is walked in one row, as a fold over its successors. A long one is walked block by
block: where a walk leaves a block is found for all blocks at once, what is left is a chain of the few places at which blocks are
entered, and each block is then walked from its own entry, so that one group of any length is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.storage import materialize

#: Rows of a group that is walked in one row at most; rows of a block in which rows look ahead.
SHORT, BLOCK = 8192, 16_384


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", on: list[tuple[str, str]] = ()) -> DataFrame:
    """left with right's other columns, where keys are equal, null like null, and the pairs of columns in ``on`` too. A join by
    pairs too is one of rows with rows: these are merged, as written tables are small and their rows in a broadcast are not."""
    named = right.withColumnsRenamed({k: f"_of_{k}" for k in [*keys, *(b for _, b in on)]})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col(a) == F.col(f"_of_{b}") for a, b in on]
    named = named.hint("merge") if on else named
    out = left.join(named, reduce(lambda x, y: x & y, same), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"_of_{k}" for k in keys), *(f"_of_{b}" for _, b in on))


def is_short(rows: DataFrame, keys: list[str]) -> bool:
    """Whether no group has more than ``SHORT`` rows; then a group may be a window's partition and one row's array."""
    return (rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= SHORT


def placed(rows: DataFrame, keys: list[str], order: list[str], size: str | None = None, short: bool = False) -> DataFrame:
    """With ``place``, from 1 in each group by ``order``, and ``before``, the sum of ``size`` over earlier rows.

    Unless all groups are short, rows are range-sorted by group and order. A place is then a count within the range plus the
    counts of the group's earlier ranges; there are no more of those than ranges, whatever the input's size. A null size
    counts 0."""
    measure = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else F.lit(0).cast("long")
    inside = Window.partitionBy(*keys).orderBy(*order)
    if short:
        return rows.withColumns({"place": F.row_number().over(inside).cast("long"), "before": F.sum(measure).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - measure})
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.withColumn("_size", measure).repartitionByRange(width, *keys, *order).withColumn("_range", F.spark_partition_id()), "placed")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.sum("_size").alias("_s"))
    shift = total.withColumns({"_n": F.sum("_n").over(earlier), "_s": F.sum("_s").over(earlier)}).where("_n > 0")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    own = dealt.withColumns({"_own": F.row_number().over(inside).cast("long"), "_sum": F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")})
    met = joined(own, shift, [*keys, "_range"], "left")
    return met.select(*rows.columns, (F.col("_own") + F.coalesce("_n", F.lit(0))).alias("place"), (F.col("_sum") + F.coalesce("_s", F.lit(0))).alias("before"))


def ahead(rows: DataFrame, place: str, reach: int, short: bool = False) -> DataFrame:
    """Rows with ``block``, where the ``reach`` rows behind each block are also rows of that block, and ``is_own``, false
    for these copies. What looks ahead that far is then a window over a group's block instead of the whole group. Short
    groups are one block."""
    if short:
        return rows.withColumns({"block": F.lit(0).cast("long"), "is_own": F.lit(True)})
    at = lambda x: F.floor(x / BLOCK).cast("long")
    own = at(F.col(place))
    many = F.explode(F.sequence(F.greatest(F.lit(0), at(F.col(place) - reach)), own))
    return rows.withColumn("block", many).withColumn("is_own", F.col("block") == own)


def limited(rows: DataFrame, keys: list[str], most: int, first: int, reach: int, size: str, short: bool = False) -> DataFrame:
    """(keys, place, next) of ``placed`` rows: the first later row with which the sizes from this row on exceed ``most``
    (``first`` for a group's first row), and ``reach`` rows on at the latest."""
    after = F.col("before") + F.coalesce(F.col(size).cast("long"), F.lit(0))
    rows = ahead(rows.select(*keys, "place", "before", after.alias("after")), "place", reach, short)
    block = Window.partitionBy(*keys, "block")
    rows = rows.withColumns({"total": F.max("after").over(block), "end": F.max("place").over(block)})

    def until(n: int) -> Column:
        # the last row that starts within n; where all of the block ends within n, the row behind it
        return F.when(F.col("total") <= F.col("before") + n, F.col("end") + 1).otherwise(F.max("place").over(block.orderBy("before").rangeBetween(0, n)))

    fit = until(most) if first == most else F.when(F.col("place") == 1, until(first)).otherwise(until(most))
    return rows.withColumn("next", F.greatest(F.col("place") + 1, F.least(F.col("place") + reach, fit))).where("is_own").select(*keys, "place", "next")


def filled(rows: DataFrame, keys: list[str], target: int, total: Callable[[Column, Column], Column], values: list[str], short: bool = False, look: int = 16) -> DataFrame:
    """(keys, place, next) of ``placed`` rows: the row after the first at which the sum of ``total(this row, row)`` reaches
    ``target``, else the row after the last.

    Each row looks at some rows ahead; those that do not reach the target look four times as far, until none is left."""
    done, left = None, rows.select(*keys, "place").withColumn("open", F.lit(True))
    while True:
        near = ahead(rows.select(*keys, "place", F.struct(*values).alias("v")), "place", look, short)
        by = Window.partitionBy(*keys, "block").orderBy("place")
        seen = near.withColumn("many", F.collect_list("v").over(by.rowsBetween(0, look - 1))).where("is_own")
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
        step = lambda a, v: F.when(a["sum"] >= target, a).otherwise(F.struct((a["sum"] + F.coalesce(total(F.col("v"), v), F.lit(0))).alias("sum"), (a["n"] + 1).alias("n")))
        walked = seen.withColumn("a", F.aggregate("many", start, step)).select(*keys, "place", (F.col("place") + F.col("a.n")).alias("next"), ((F.col("a.sum") < target) & (F.size("many") == look)).alias("open"))
        if done is not None:
            walked = joined(walked, left, keys, "left_semi", [("place", "place")])
        count = Observation()
        walked = materialize(walked.observe(count, F.count_if("open").alias("n")), "walked")
        closed = walked.where(~F.col("open")).drop("open")
        done = closed if done is None else done.unionByName(closed)
        if not count.get["n"]:
            return done
        left, look = walked.where("open"), look * 4


def reached(steps: DataFrame, keys: list[str], first: int = 1, short: bool = False, more: list[str] = ()) -> DataFrame:
    """(keys, place, next, k) and the steps' columns ``more``, of the rows that a walk from each group's row ``first`` meets;
    ``k`` counts from 0."""
    steps = steps.select(*keys, F.col("place").cast("long").alias("place"), F.col("next").cast("long").alias("next"), *more)
    if short:
        return _walked(steps, keys, first, more)
    steps = materialize(steps, "steps")
    long = steps.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > SHORT)
    few = _walked(joined(steps, long.drop("n"), keys, "left_anti"), keys, first, more)
    return few.unionByName(walked_by_block(joined(steps, long.drop("n"), keys, "left_semi"), keys, first))


def _walked(steps: DataFrame, keys: list[str], first: int, more: list[str]) -> DataFrame:
    step = F.struct("place", "next", *more)
    kind = steps.select(F.array(step).alias("a")).schema["a"].dataType
    walk = F.aggregate(
        F.sort_array(F.collect_list(step)),
        F.struct(F.lit(first).cast("long").alias("at"), F.array().cast(kind).alias("met")),
        lambda a, x: F.when(x["place"] == a["at"], F.struct(x["next"].alias("at"), F.array_append(a["met"], x).alias("met"))).otherwise(a),
        lambda a: a["met"],
    )
    return steps.groupBy(*keys).agg(walk.alias("met")).select(*keys, F.posexplode("met").alias("k", "x")).select(*keys, *(f"x.{c}" for c in ("place", "next", *more)), F.col("k").cast("long").alias("k"))


def walked_by_block(steps: DataFrame, keys: list[str], first: int) -> DataFrame:
    """The walk over blocks: each block's rows get the place at which a walk from them leaves the block. Only places that some
    walk enters are steps of the next level, over blocks eight times as wide, until a group has few. From there the entries go
    back down, and each block is walked once, from its own entry."""
    levels, width, rows = [], BLOCK, steps.withColumn("_n", F.lit(1).cast("long"))
    while True:
        rows = rows.withColumn("_block", F.floor(F.col("place") / width))
        out = T.StructType([*(f for f in rows.schema if f.name in [*keys, "place"]), T.StructField("next", T.LongType()), T.StructField("_n", T.LongType())])
        left = materialize(_by_block(rows.select(*keys, "_block", "place", "next", "_n"), keys, _left, out), "left")
        levels.append(rows)
        entered = left.select(*keys, "next").distinct().withColumnRenamed("next", "place")
        start = F.col("place") == first
        rows = joined(left.where(~start), entered, keys, "left_semi", [("place", "place")]).unionByName(left.where(start))
        rows, width = materialize(rows, "entered"), width * 8
        if is_short(rows, keys):
            break
    upto = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    met = _walked(rows, keys, first, ["_n"]).select(*keys, "place", (F.sum("_n").over(upto) - F.col("_n")).alias("k"))
    for rows in reversed(levels):
        width //= 8
        entry = met.select(*keys, F.floor(F.col("place") / width).alias("_block"), F.col("place").alias("_entry"), F.col("k").alias("_k"))
        out = T.StructType([*(f for f in rows.schema if f.name not in ("_block", "_n")), T.StructField("k", T.LongType())])
        met = _by_block(joined(rows, entry, [*keys, "_block"]), keys, _met, out)
    return met


def _by_block(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], out: T.StructType) -> DataFrame:
    names = out.names
    return rows.groupBy(*keys, "_block").applyInArrow(lambda table: run(table).select(names), out)


def _ordered(table: pa.Table) -> tuple[pa.Table, list[int], list[int]]:
    """A block in order of places, the row that each leads to, the number of rows where it leads out, and steps to there."""
    table = table.sort_by("place")
    place, after = (table.column(c).to_numpy() for c in ("place", "next"))
    to = np.searchsorted(place, after)
    inside = np.append(place, -1)[to] == after
    return table, np.where(inside, to, len(place)).tolist(), table.column("_n").to_pylist()


def _left(table: pa.Table) -> pa.Table:
    """Each row with the place behind its block to which a walk from it leads, and with the steps to there."""
    table, to, n = _ordered(table)
    after, rows = table.column("next").to_pylist(), len(to)
    for i in range(rows - 1, -1, -1):
        if to[i] < rows:
            after[i], n[i] = after[to[i]], n[i] + n[to[i]]
    for name, got in (("next", after), ("_n", n)):
        table = table.set_column(table.schema.get_field_index(name), name, pa.array(got, pa.int64()))
    return table


def _met(table: pa.Table) -> pa.Table:
    """The rows that a walk from the block's entry meets."""
    table, to, n = _ordered(table)
    at, k = table.column("place").to_pylist().index(table.column("_entry")[0].as_py()), table.column("_k")[0].as_py()
    rows, steps = [], []
    while at < len(to):
        rows.append(at)
        steps.append(k)
        at, k = to[at], k + n[at]
    return table.take(pa.array(rows, pa.int64())).append_column("k", pa.array(steps, pa.int64()))


def numbered(rows: DataFrame, starts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``placed`` rows with the number of the stretch that they are in."""
    spread = starts.select(*keys, F.explode(F.sequence("place", F.col("next") - 1)).alias("place"), F.col("k").alias(out))
    return joined(rows, spread, keys, on=[("place", "place")])
