"""Slicing of tall strips at calm rows, as a chain of slices: each row's cut follows from the rows ahead of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators import chains
from panelspark.storage import materialize

#: Target, least and greatest height of a slice, rows of a gap, reach of the near search.
TARGET, LEAST, MOST, GAP, REACH = 1300, 600, 1800, 25, 150
STD, EDGE, MARGIN = 3.5, 0.015, 25
#: How a slice ends, in order of preference; the last two are strips' ends.
WAYS = ["near", "up", "down", "force", "whole", "tail"]


def is_safe(std: Column, edge: Column, forbidden: Column) -> Column:
    return (std < STD) & (edge < EDGE) & ~forbidden


def safe_starts(rows: DataFrame) -> DataFrame:
    """With ``gap_ok``: this row and the next 24 exist and are safe."""
    ahead = Window.partitionBy("page_id").orderBy("y").rowsBetween(0, GAP - 1)
    safe = is_safe(F.col("row_std"), F.col("edge_density"), F.col("forbidden"))
    return rows.withColumn("gap_ok", (F.min(safe.cast("int")).over(ahead) == 1) & (F.count("*").over(ahead) == GAP))


def forbidden_bands(lines: DataFrame) -> DataFrame:
    """(page_id, first, last): stretches of rows within the margin of any text line, clipped to the page, that do not meet another
    of their page. A line adds what lies behind the end of all that start before it, so that lines are sorted and no row
    of a page is written out."""
    page = Window.partitionBy("page_id")
    ends = lines.groupBy("page_id", F.greatest(F.lit(0), F.col("y1") - MARGIN).alias("start")).agg(F.max("y2").alias("low"))
    before = page.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bands = ends.select("page_id", "start", F.max("low").over(before).alias("above"), "low", F.max("low").over(page).alias("h"))
    stop = F.least(F.col("h"), F.col("low") + MARGIN)
    bands = bands.select("page_id", F.greatest("start", F.when(F.col("above").isNotNull(), F.least(F.col("h"), F.col("above") + MARGIN))).alias("first"), (stop - 1).alias("last"))
    return bands.where(F.col("first") <= F.col("last"))


def forbidden_rows(lines: DataFrame) -> DataFrame:
    """(page_id, y): rows within the margin of any text line, each once."""
    return forbidden_bands(lines).select("page_id", F.explode(F.sequence("first", "last")).alias("y"))


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows as one row for each page and block that a batch has rows of: places, scores and safety, in order of places and
    compressed. The rows behind a block that it looks at are rows of that block too."""
    codec = pa.Codec("zstd")
    for batch in batches:
        pages = pc.dictionary_encode(batch.column("page_id"), null_encoding="encode")
        page, place = pages.indices.to_numpy(), batch.column("place").to_numpy()
        # scores as integers of the same order: null first, then numbers, NaN last
        score, known = pc.fill_null(batch.column("score"), 0.0).to_numpy() + 0.0, batch.column("score").is_valid().to_numpy(zero_copy_only=False)
        bits = score.view(np.int64)
        bits = np.where(np.isnan(score), np.iinfo(np.int64).max, np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))
        bits = np.where(known, bits, np.iinfo(np.int64).min)
        safe = pc.fill_null(batch.column("safe"), False).to_numpy(zero_copy_only=False).astype(np.uint8)
        low = np.maximum(0, (place - MOST - 1) // width)
        many = np.maximum(0, place // width - low + 1)
        at = np.repeat(np.arange(len(place)), many)
        block = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        order = np.lexsort((place[at], block, page[at]))
        at, block = at[order], block[order]
        ends = np.flatnonzero(np.append((np.diff(page[at]) != 0) | (np.diff(block) != 0), True)) + 1 if len(at) else np.zeros(0, np.int64)
        starts = np.append(0, ends)[:-1]
        packs = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            own = at[a:b]
            packs.append(codec.compress(np.diff(place[own], prepend=0).tobytes() + bits[own].tobytes() + safe[own].tobytes(), asbytes=True))
        first = pa.array(at[starts], pa.int64())
        yield pa.record_batch([batch.column("page_id").take(first), pa.array(block[starts], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(packs, pa.binary())], ["page_id", "block", "n", "rows"])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, scores and safety of a block's rows, in order of places."""
    codec, parts = pa.Codec("zstd"), ([], [], [])
    for n, packed in zip(table.column("n").to_pylist(), table.column("rows").to_pylist()):
        raw = codec.decompress(packed, decompressed_size=17 * n, asbytes=True)
        parts[0].append(np.cumsum(np.frombuffer(raw, np.int64, n)))
        parts[1].append(np.frombuffer(raw, np.int64, n, 8 * n))
        parts[2].append(np.frombuffer(raw, np.uint8, n, 16 * n))
    place, score, safe = (np.concatenate(p) for p in parts)
    order = np.argsort(place, kind="stable")
    return place[order], score[order], safe[order].astype(np.int64)


def _last_gaps(place: np.ndarray, safe: np.ndarray) -> np.ndarray:
    """For each row the place of the last gap that starts there or before, -1 if none does."""
    run = np.append(0, np.cumsum(safe))
    starts = np.full(len(place), -1)
    whole = np.flatnonzero(run[GAP:] - run[:-GAP] == GAP)
    starts[whole] = place[whole]
    return np.maximum.accumulate(starts)


def _cuts(place: np.ndarray, score: np.ndarray, gaps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where slices that start at the rows ``at`` end, and by which of ``WAYS``: in the middle of the last gap of a stretch ahead, at
    the least score of the last stretch, or at the strip's end."""
    after, way = np.full(len(at), place[-1] + 1), np.where(place[at] == 0, WAYS.index("whole"), WAYS.index("tail"))
    left = np.flatnonzero(at + MOST < len(place))
    up, down = TARGET - REACH, TARGET + REACH
    for k, (low, high) in enumerate([(up, down), (LEAST, up), (down, MOST)]):
        found = gaps[at[left] + high - GAP]
        hit = found > place[at[left]] + low
        after[left[hit]], way[left[hit]] = found[hit] + GAP // 2, k
        left = left[~hit]
    for a in range(0, len(left), 1024):
        some = left[a : a + 1024]
        first = at[some] + TARGET
        least = np.lib.stride_tricks.sliding_window_view(score, MOST - TARGET)[first].argmin(1)
        after[some], way[some] = place[first + least], WAYS.index("force")
    return after, way


def _sliced(table: pa.Table, width: int) -> pa.Table:
    """The slices of a strip that is one block, with their numbers ``k``; else where a slice from each of the block's rows ends."""
    block, (place, score, safe) = table.column("block")[0].as_py(), _unpacked(table)
    gaps, at, k = _last_gaps(place, safe), [], None
    if block == 0 and place[-1] < width:
        here = 0
        while here < len(place) and place[here] == (after[0] if at else 0):
            at.append(here)
            after, _ = _cuts(place, score, gaps, np.array([here]))
            here = int(np.searchsorted(place, after[0]))
        k = np.arange(len(at))
    at = np.flatnonzero(place // width == block) if k is None else np.array(at, np.int64)
    after, way = _cuts(place, score, gaps, at)
    columns = [pa.repeat(table.column("page_id")[0], len(at)), pa.array(place[at]), pa.array(after), pa.array(WAYS).take(pa.array(way)), pa.nulls(len(at), pa.int64()) if k is None else pa.array(k)]
    return pa.table(columns, ["page_id", "place", "next", "how", "k"])


def slices(rows: DataFrame) -> DataFrame:
    """(page_id, part, y1, y2, how): slices that tile each strip, whose rows are numbered from 0. A strip of no more than
    1800 rows stays whole.

    All rules look at a bounded stretch ahead, so rows are dealt by page and block, each block with the rows behind it that it
    looks at. They are packed before they are dealt, and dealt once. A strip of one block is sliced there; of longer ones
    each row gets the end of the slice that starts there, and the walk over these goes block by block."""
    width, spark = chains.BLOCK, rows.sparkSession
    score = 100 * F.col("edge_density") + F.col("row_std") + F.when(F.col("forbidden"), 1e6).otherwise(0.0)
    safe = is_safe(F.col("row_std"), F.col("edge_density"), F.col("forbidden"))
    page = T.StructField("page_id", rows.schema["page_id"].dataType)
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    plain = rows.select("page_id", F.col("y").cast("long").alias("place"), score.cast("double").alias("score"), safe.alias("safe")).where(F.col("place").isNotNull())
    packed = plain.mapInArrow(lambda batches: _packed(batches, width), T.StructType([page, *long("block", "n"), T.StructField("rows", T.BinaryType())]))
    # few bytes are many rows, so they are not gathered into few tasks
    dealt = packed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id", "block")
    out, many = T.StructType([page, *long("place", "next"), T.StructField("how", T.StringType()), *long("k")]), Observation()
    cut = dealt.groupBy("page_id", "block").applyInArrow(lambda table: _sliced(table, width), out)
    cut = materialize(cut.observe(many, F.count_if(F.col("k").isNull()).alias("n")), "cuts")
    found = cut.where(F.col("k").isNotNull())
    if many.get["n"]:
        found = found.unionByName(chains.walked_by_block(cut.where(F.col("k").isNull()).drop("k"), ["page_id"], 0))
    return found.select("page_id", F.col("k").cast("int").alias("part"), F.col("place").alias("y1"), F.col("next").alias("y2"), "how")
