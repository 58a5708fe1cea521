"""Connected components of a graph that only the cluster can hold: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelspark.storage import collect_garbage, drop_table, materialize

#: A hub is an end of more than one in so many edges, so there are fewer hubs than this; in tables of fewer edges than the
#: second figure no end is worth being told apart.
HUBS, HUB_EDGES = 1_000, 10_000
#: Edges in one file of a round's table.
FILE_ROWS = 5_000


def _least(edges: DataFrame, key: str) -> DataFrame:
    """(key, least): the least of the smaller neighbours of each node that has any; combined before the shuffle."""
    return edges.groupBy(F.col("hi").alias(key)).agg(F.min("lo").alias("least"))


def _met(edges: DataFrame, key: str, count: int) -> DataFrame:
    """(hi, lo, least): the edges with what ``_least`` has for one of their ends, null where it has nothing.

    The edges of a hub stay where they are and meet a broadcast table of under ``HUBS`` rows; only the others are dealt out by
    the key, of which none then has more than one edge in ``HUBS``."""
    least = _least(edges, key)
    if count < HUB_EDGES:
        return edges.join(least, key, "left").select("hi", "lo", "least")
    hubs = F.broadcast(edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * HUBS > count).select(key))
    of_hubs = F.broadcast(least.join(hubs, key, "left_semi"))
    hot = edges.join(hubs, key, "left_semi").join(of_hubs, key, "left")
    rest = edges.join(hubs, key, "left_anti").join(least, key, "left")
    return hot.select("hi", "lo", "least").unionByName(rest.select("hi", "lo", "least"))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Each node's greater neighbours are hung on the least node around it."""
    return _met(edges, "lo", count).select("hi", F.coalesce("least", "lo").alias("lo")).distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Each node and its smaller neighbours are hung on the least of these."""
    moved = _met(edges, "hi", count).where(F.col("lo") != F.col("least")).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(_least(edges, "hi").withColumnRenamed("least", "lo")).distinct()


def _written(edges: DataFrame, most: int | None) -> tuple[DataFrame, int, tuple]:
    """The table as written, how many edges it has, and a digest of them, both observed while it is written."""
    spark, seen = edges.sparkSession, Observation()
    if most is not None:
        edges = edges.coalesce(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // FILE_ROWS))))
    hashes = F.xxhash64("hi", "lo"), F.hash("lo", "hi")
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), *(F.bit_xor(h).alias(f"x{k}") for k, h in enumerate(hashes))), "edges")
    found = seen.get
    count = found.get("n") or 0
    if count >= HUB_EDGES:
        collect_garbage(spark)
    return table, count, (count, found.get("x0"), found.get("x1"))


def components(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b) pairs of any type with an order, structs too -> (node, root): the least node of each node's component.

    Nodes without a pair are left out; nulls, loops and repeated pairs do no harm, and no pair gives no row. Each round is written
    to the shared folder; rounds grow with the logarithm of the longest path. No task holds a component. Who knows that there are
    ``most`` pairs saves files in the first round."""
    edges = pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, count, state = _written(edges, most)
    while count:
        if count < HUB_EDGES:
            new, now, digest = _written(_small_star(_large_star(edges, count), count), count)
        else:
            large, between, _ = _written(_large_star(edges, count), count)
            new, now, digest = _written(_small_star(large, between), between)
            drop_table(large)
        drop_table(edges)
        edges, count, done, state = new, now, digest == state, digest
        if done:
            break
    roots = edges.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
