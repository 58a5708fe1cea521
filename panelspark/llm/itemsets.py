"""Closed frequent itemsets of baskets, and their association rules.

Method: prefix-preserving closure extension. Items are ranked by support, the rarest first. A closed set P with core c is
extended by an item f > c outside it: the closure of P + f is the intersection of the baskets that hold it, and it counts
only if it adds no item below f. So every closed set has exactly one parent, is found once, and none has to be kept
to tell duplicates. The search is depth-first over occurrence lists that each step delivers to its extensions.

Distribution. Baskets are reduced to frequent items, equal ones are one row with a weight. A basket is shipped to the
tasks that hold one of its items as first extension: once to a task, not once an item, so that a basket of w items costs
w times the number of tasks at most. Such a conditional database is searched in its task. One whose rows have more
than ``WORK`` items is heavy: its extensions are counted by the cluster, it is closed from those counts, and its
extensions are conditional databases of their own, shipped in the next round, or heavy again. Because the rarest item is
first, the most frequent items have the fewest extensions.

Bounds. There are at most (items in a basket, on average) / (least share) frequent items, whatever the input's size: 5000
times the mean basket at a share of 1 in 5000. Their table is all that is ranked in one place or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import materialize, sliced, tidied

#: Items in the rows of a conditional database that one task searches; more is heavy. Tasks get about as much together.
WORK = 4_000_000


def baskets(lines: DataFrame, basket_col: str, item_col: str, least: int, share: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(rows, items, B, needed): rows (items, weight) of equal baskets reduced to frequent items as ascending ranks, items
    (rank, item, support), the number of all baskets, and the support that counts: ``least`` and B / ``share`` at least.

    Lines without basket or item are left out, repeats are one, other columns are ignored, whatever their names. An empty
    table has no basket. No basket is gathered before its rare items are gone."""
    pairs = lines.select(F.col(basket_col).cast("long").alias("basket"), F.col(item_col).cast("long").alias("item")).dropna().distinct()
    pairs = materialize(pairs, "pairs")
    n = pairs.agg(F.count_distinct("basket")).first()[0]
    needed = max(least, -(-n // share))
    frequent = pairs.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= needed)
    items = materialize(frequent.withColumn("rank", F.row_number().over(Window.orderBy("support", "item"))), "items", files=1)
    kept = pairs.join(items.select("item", "rank"), "item").groupBy("basket").agg(F.sort_array(F.collect_list("rank")).alias("items"))
    return materialize(kept.groupBy("items").agg(F.count("*").alias("weight")), "baskets"), items, n, needed


class Database:
    """Weighted baskets as flat arrays. ``lists`` are the baskets of each item, in order."""

    def __init__(self, bounds: np.ndarray, items: np.ndarray, weights: np.ndarray):
        self.bounds, self.items, self.weights = bounds, items, weights
        self.row = np.repeat(np.arange(len(weights)), np.diff(bounds))

    def lists(self) -> dict[int, np.ndarray]:
        return dict(delivered(self.items, self.row))

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, row) of all cells of some rows, rows in order."""
        size = self.bounds[rows + 1] - self.bounds[rows]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bounds[rows], size)
        return self.items[at], self.row[at]


def delivered(items: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each item and its rows."""
    order = np.argsort(items, kind="stable")
    items, rows = items[order], rows[order]
    cuts = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1]))) if len(items) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(items)]):
        yield int(items[a]), rows[a:b]


def closed_sets(weights: np.ndarray, items: np.ndarray, rows: np.ndarray, prefix: frozenset[int], core: int, needed: int) -> Iterator[tuple[list[int], int]]:
    """(items, support) of the closure of prefix + core and of all that extends it, where prefix is kept.

    ``items`` and ``rows`` are the cells of the baskets that hold prefix and core. The stack holds, for each level of the
    search, the cells of the set that is being extended and the extensions left; it is never deeper than a set is long."""
    stack: list[tuple] = []

    def enter(items: np.ndarray, rows: np.ndarray, prefix: frozenset[int], core: int) -> tuple[list[int], int] | None:
        order = np.argsort(items, kind="stable")
        items, rows = items[order], rows[order]
        head = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
        found, support = items[head], np.add.reduceat(weights[rows], head)
        here = int(support[np.searchsorted(found, core)])
        closure = found[support == here]
        if any(int(i) < core and int(i) not in prefix for i in closure):
            return None
        closed = frozenset(closure.tolist())
        live = support >= needed
        size = np.diff(np.concatenate((head, [len(items)])))
        kept = np.repeat(live, size)  # items that are rare here are rare in every extension
        items, rows = items[kept], rows[kept]
        head, found = np.concatenate(([0], np.cumsum(size[live])))[:-1], found[live]
        ends = np.concatenate((head[1:], [len(items)]))
        later = [k for k in range(len(found)) if found[k] > core and int(found[k]) not in closed]
        if later:
            by_row = np.argsort(rows, kind="stable")
            stack.append((items[by_row], rows[by_row], closed, iter([(int(found[k]), rows[head[k] : ends[k]]) for k in later])))
        return closure.tolist(), here

    first = enter(items, rows, prefix, core)
    if first is None:
        return
    yield first
    while stack:
        items, rows, closed, later = stack[-1]
        nxt = next(later, None)
        if nxt is None:
            stack.pop()
            continue
        f, occurs = nxt
        inside = occurs[np.minimum(np.searchsorted(occurs, rows), len(occurs) - 1)] == rows
        found = enter(items[inside], rows[inside], closed, f)
        if found is not None:
            yield found


def _cells(batches: list[pa.RecordBatch], name: str = "items") -> tuple[np.ndarray, np.ndarray]:
    flat = [b.column(name) for b in batches]
    sizes = np.concatenate([np.diff(np.asarray(c.offsets)) for c in flat])
    return np.concatenate(([0], np.cumsum(sizes))), np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in flat]).astype(np.int32)


def _told(sets: list[tuple[list[int], int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in sets], pa.list_(pa.int32())), pa.array([n for _, n in sets], pa.int64())], ["items", "support"])


def _of_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each task number together, as they come sorted."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        tasks = batch.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(tasks)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if tasks[a] != at and held:
                yield held
                held = []
            at = tasks[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _searcher(needed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _of_one_task(batches):
            base = Database(*_cells(held), np.concatenate([b.column("weight").to_numpy() for b in held]))
            to, heads = _cells(held, "heads")
            of = np.repeat(np.arange(len(base.weights)), np.diff(to))
            # a conditional database is a prefix and the item that extends it
            prefixes: dict[tuple, int] = {}
            number = np.array([prefixes.setdefault(tuple(p), len(prefixes)) for b in held for p in b.column("prefix").to_pylist()])
            known, found = list(prefixes), []
            for key, rows in delivered(number[of] * (1 << 32) + heads, of):
                found += closed_sets(base.weights, *base.cells(rows), frozenset(known[key >> 32]), key & 0xFFFFFFFF, needed)
                if len(found) > 5000:
                    yield _told(found)
                    found = []
            if found:
                yield _told(found)

    return run


def _deal(volume: int, width: int) -> int:
    """Tasks for so many items in all: about WORK in one, and no fewer than the shuffle is wide."""
    return max(width, -(-volume // WORK))


def closed_itemsets(rows: DataFrame, items: DataFrame, total: int, needed: int) -> DataFrame:
    """(items, support): every closed set of ranks with a support of ``needed`` at least, each once; a written table.

    ``rows`` and ``items`` are those of ``baskets``, ``total`` the number of all baskets. An item of every basket belongs to
    every set. Without frequent items there is none."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = []
    always = sorted(r["rank"] for r in items.where(F.col("support") == total).select("rank").collect())
    kind = "array<int>"
    if always:
        found.append(spark.createDataFrame([(always, total)], f"items {kind}, support long"))
    # the volume of each first extension
    volume = rows.select(F.size("items").alias("w"), F.explode("items").alias("f")).groupBy("f").agg(F.sum("w").alias("volume"))
    volume = materialize(volume.where(~F.col("f").isin(always) if always else F.lit(True)), "volumes", files=1)
    heavy = sorted(r["f"] for r in volume.where(F.col("volume") > WORK).select("f").collect())  # of the frequent items, so bounded
    tasks = _deal(volume.agg(F.coalesce(F.sum("volume"), F.lit(0))).first()[0], width)
    literal = lambda ranks: F.array(*map(F.lit, ranks)).cast(kind)
    light = F.array_except("items", literal(always + heavy))
    task = lambda f: F.pmod(F.hash(f), F.lit(tasks))
    shared = rows.withColumn("light", light).where(F.size("light") > 0)
    shared = shared.select("items", "weight", "light", F.explode(F.array_distinct(F.transform("light", task))).alias("task"))
    shipped = shared.select("task", literal(always).alias("prefix"), F.filter("light", lambda f: task(f) == F.col("task")).alias("heads"), "items", "weight")
    parts = [shipped]
    state = None
    if heavy:
        state = rows.select("items", "weight", F.explode(F.array_intersect("items", literal(heavy))).alias("f")).select(literal(always).alias("prefix"), F.col("f").alias("core"), "items", "weight")
    while state is not None:
        state = materialize(state, "heavy")
        more, small, state, tasks = _resplit(state, needed, tasks)
        found.append(more)
        parts.append(small)
    met = parts[0]
    for part in parts[1:]:
        met = met.unionByName(part)
    schema = T.StructType([T.StructField("items", T.ArrayType(T.IntegerType())), T.StructField("support", T.LongType())])
    searched = met.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(tidied(_searcher(needed)), schema)
    for part in found:
        searched = searched.unionByName(part)
    return materialize(searched, "closed")


def _resplit(state: DataFrame, needed: int, used: int) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """Heavy databases (prefix, core, items, weight) -> their closed sets, their small extensions' databases as shipped rows,
    the heavy ones of the extensions, or None, and the task numbers that are now used."""
    key = ["prefix", "core"]
    cells = state.select(*key, "weight", F.size("items").alias("w"), F.explode("items").alias("i"))
    counts = materialize(cells.groupBy(*key, "i").agg(F.sum("weight").alias("support"), F.sum("w").alias("volume")).where(F.col("support") >= needed), "counts")
    own = counts.where(F.col("i") == F.col("core")).select(*key, F.col("support").alias("here"))
    closure = counts.join(own, key).where(F.col("support") == F.col("here")).groupBy(*key).agg(F.sort_array(F.collect_list("i")).alias("closure"), F.first("here").alias("here"))
    kept = materialize(closure.where(~F.exists(F.array_except("closure", "prefix"), lambda i: i < F.col("core"))), "closures")
    later = counts.join(kept, key).where((F.col("i") > F.col("core")) & ~F.array_contains("closure", F.col("i")))
    later = materialize(later.select(*key, F.col("i").alias("f"), "closure", "volume", (F.col("volume") > WORK).alias("big")), "extensions")
    n = later.agg(F.count_if("big"), F.coalesce(F.sum(F.when(~F.col("big"), F.col("volume"))), F.lit(0))).first()
    own_tasks = _deal(n[1], 1)
    rows = state.select(*key, "items", "weight", F.explode(F.filter("items", lambda i: i > F.col("core"))).alias("f")).join(later, [*key, "f"])
    small = rows.where(~F.col("big")).select((F.pmod(F.hash("closure", "f"), F.lit(own_tasks)) + used).alias("task"), F.col("closure").alias("prefix"), F.array("f").alias("heads"), "items", "weight")
    big = rows.where("big").select(F.col("closure").alias("prefix"), F.col("f").alias("core"), "items", "weight")
    return kept.select(F.col("closure").alias("items"), F.col("here").alias("support")), small, big if n[0] else None, used + own_tasks


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each task its baskets, then the sets to count in them, as a stream."""
    held: list[pa.RecordBatch] = []
    at, base, lists, mine = None, None, {}, {}
    for batch in sliced(batches, 5000):
        tasks, kinds = batch.column("task").to_numpy(), batch.column("kind").to_numpy()
        where = tasks.astype(np.int64) * 2 + kinds
        cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if tasks[a] != at:
                at, held, base = tasks[a], [], None
            if kinds[a] == 0:
                held.append(part)
                continue
            if base is None and held:
                base = Database(*_cells(held), np.concatenate([h.column("weight").to_numpy() for h in held]))
                to, heads = _cells(held, "heads")
                lists, mine, held = base.lists(), dict(delivered(heads, np.repeat(np.arange(len(base.weights)), np.diff(to)))), []
            sets, counts = part.column("items").to_pylist(), []
            for items in sets:
                rows = mine.get(items[0]) if base is not None else None
                for i in items[1:]:
                    other = lists.get(i) if rows is not None and len(rows) else None
                    rows = None if other is None else rows[other[np.minimum(np.searchsorted(other, rows), len(other) - 1)] == rows]
                counts.append(0 if rows is None else int(base.weights[rows].sum()))
            yield _told(list(zip(sets, counts)))


def supports(rows: DataFrame, asked: DataFrame, known: DataFrame) -> DataFrame:
    """(items, support) of the sets of ranks in ``asked``, each once, counted in the baskets of their rarest item.

    ``known`` has the frequent items' rank. Baskets of an item beyond ``WORK`` are dealt to several tasks, each of which counts its share."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = asked.select(F.get("items", F.lit(0)).alias("rank")).distinct()
    size = rows.select(F.size("items").alias("w"), F.explode("items").alias("rank")).groupBy("rank").agg(F.sum("w").alias("volume"))
    # of the frequent items, so bounded
    slices = {r["rank"]: -(-r["volume"] // WORK) for r in size.join(first, "rank").join(known.select("rank"), "rank").collect()}
    entries = [F.lit(x) for pair in sorted(slices.items()) for x in pair]
    table = F.create_map(*entries).cast("map<int,int>") if entries else F.expr("map(0, 1)")
    tasks = max(width, sum(slices.values()) // 4)
    number = lambda f, k: F.pmod(F.hash(f, k), F.lit(tasks))
    share = lambda f: number(f, F.pmod(F.hash("items"), F.element_at(table, f)))
    mine = rows.withColumn("mine", F.filter("items", lambda f: F.map_contains_key(table, f))).where(F.size("mine") > 0)
    sent = mine.select("items", "weight", "mine", F.explode(F.array_distinct(F.transform("mine", share))).alias("task"))
    sent = sent.select("task", F.lit(0).alias("kind"), "items", "weight", F.filter("mine", lambda f: share(f) == F.col("task")).alias("heads"))
    rarest = F.get("items", F.lit(0))
    # slices that share a task are asked there once
    every = F.array_distinct(F.transform(F.sequence(F.lit(0), F.element_at(table, rarest) - 1), lambda k: number(rarest, k)))
    sets = asked.select("items", F.explode(every).alias("task")).select("task", F.lit(1).alias("kind"), "items", F.lit(0).cast("long").alias("weight"), F.lit(None).cast("array<int>").alias("heads"))
    met = sent.unionByName(sets).repartition(tasks, "task").sortWithinPartitions("task", "kind")
    return met.mapInArrow(tidied(_answers), "items array<int>, support long").groupBy("items").agg(F.sum("support").alias("support"))


def with_rules(rows: DataFrame, items: DataFrame, closed: DataFrame, total: int, confidence: int) -> DataFrame:
    """(ids, support, rules) of closed sets of ranks: the items' own ids, ascending, and rules as structs (c, a, s).

    Leaving out an item c of support s gives a rule if the set has ``confidence`` percent of the rest's support a at least,
    and more than the product of a and s over ``total`` lets expect. The rest is often closed or one item and known; what is
    not is counted in the baskets."""
    known = closed.where(F.size("items") > 1).select(F.col("items").alias("rest"), F.col("support").alias("a"))
    known = known.unionByName(items.select(F.array("rank").alias("rest"), F.col("support").alias("a")))
    each = closed.select("items", "support", F.explode("items").alias("rank")).withColumn("rest", F.array_remove("items", F.col("rank")))
    asked = each.where(F.size("rest") > 1).join(known, "rest", "left_anti").select(F.col("rest").alias("items")).distinct()
    seen = Observation()
    asked = materialize(asked.observe(seen, F.count("*").alias("n")), "asked")
    if seen.get["n"]:
        known = known.unionByName(materialize(supports(rows, asked, items), "counted").select(F.col("items").alias("rest"), F.col("support").alias("a")))
    full = each.join(items.select("rank", "item", F.col("support").alias("s")), "rank").join(known, "rest", "left")
    rule = (100 * F.col("support") >= confidence * F.col("a")) & (F.col("support") * F.lit(total) > F.col("a") * F.col("s"))
    rules = F.when(rule, F.struct(F.col("item").alias("c"), "a", "s"))
    return full.groupBy("items").agg(F.first("support").alias("support"), F.sort_array(F.collect_list("item")).alias("ids"), F.sort_array(F.collect_list(rules)).alias("rules")).select("ids", "support", "rules")


def op12_itemsets(spark, sf_dir: str) -> DataFrame:
    """Closed itemsets of all sales with their rules."""
    rows, items, total, needed = baskets(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"), "sale_id", "item_id", 8, 5000)
    found = with_rules(rows, items, closed_itemsets(rows, items, total, needed), total, 10)
    told: Column = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", *(r[k].cast("string") for k in ("c", "a", "s")))), ";")
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"))))["c"]
    return found.select(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("items"), F.size("ids").cast("long").alias("n_items"), "support", F.size("rules").cast("long").alias("n_rules"), best.alias("best_item"), F.sha2(told, 256).alias("rules_sha256"))


OP12_SQL = """
WITH RECURSIVE p AS (SELECT DISTINCT sale_id AS t, item_id AS i FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
b AS (SELECT count(DISTINCT t) AS n FROM p),
o AS (SELECT i, list(t) AS ts, count(*) AS s FROM p GROUP BY i HAVING count(*) >= 8 AND count(*) * 5000 >= (SELECT n FROM b)),
q AS (SELECT p.t, p.i FROM p JOIN o ON p.i = o.i),
r AS (
  SELECT [i] AS x, i AS top, ts FROM o
  UNION ALL
  SELECT list_append(u.x, q.i), q.i, list(q.t)
  FROM (SELECT x, top, unnest(ts) AS t FROM r) u JOIN q ON u.t = q.t AND q.i > u.top
  GROUP BY u.x, q.i HAVING count(*) >= 8 AND count(*) * 5000 >= (SELECT n FROM b)
), f AS (SELECT x, CAST(len(ts) AS BIGINT) AS support FROM r),
e AS (SELECT x, support, c, list_filter(x, lambda y: y <> c) AS rest FROM (SELECT x, support, unnest(x) AS c FROM f) WHERE len(x) > 1),
c AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.rest = f.x AND e.support = f.support)),
rules AS (
  SELECT e.x, e.c, a.support AS a, CAST(o.s AS BIGINT) AS s FROM e JOIN f a ON e.rest = a.x JOIN o ON o.i = e.c, b
  WHERE 100 * e.support >= 10 * a.support AND e.support * b.n > a.support * o.s
), g AS (
  SELECT x, count(*) AS n, arg_min(c, (a, c)) AS best, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS told FROM rules GROUP BY x
)
SELECT array_to_string(c.x, ',') AS items, CAST(len(c.x) AS BIGINT) AS n_items, c.support, CAST(coalesce(g.n, 0) AS BIGINT) AS n_rules, g.best AS best_item, sha256(coalesce(g.told, '')) AS rules_sha256
FROM c LEFT JOIN g ON c.x = g.x
"""
