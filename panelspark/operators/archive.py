"""Archives and logs of any length: a file is a table of segments in order, made by all tasks, and a sink that keeps the order.

A zip file is the members' own headers and data, one after another, then a directory that says where each begins. Members are
deflated as rows. Where each begins is a running sum over the members' sizes alone, and the directory is made of those sums, so
that no task holds an archive. Large archives have the wide form of the directory.
"""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators import chains
from panelspark.storage import materialize

#: Fixed values of the format: flag of names in UTF-8, method, date (1980-01-01), bytes of a member's header without its name,
#: members and bytes from which on the wide form is needed, and what the narrow form then says.
UTF8_NAMES, DEFLATED, DATE, LOCAL, WIDE_ROWS, WIDE, ELSEWHERE = 0x800, 8, 0x21, 30, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF


def little_endian(x: Column, n: int) -> Column:
    """The n low bytes of a whole number, lowest first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(x.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n))))


def _fields(*pairs: tuple[object, int]) -> Column:
    return F.concat(*(little_endian(x if isinstance(x, Column) else F.lit(x), n) for x, n in pairs))


#: Bytes of members that are in memory as rows at a time, but for one that is larger.
HELD = 8 << 20


def _squeezed(content: bytes | None) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    return squeeze.compress(content or b"") + squeeze.flush()


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content = batch.column("content")
        step = max(1, batch.num_rows * HELD // max(1, content.nbytes))
        for k in range(0, batch.num_rows, step):
            rows = batch.slice(k, step)
            data = [_squeezed(c.as_py()) for c in rows.column("content")]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(data, pa.binary())], [*rows.schema.names, "data"])


def segments(members: DataFrame) -> DataFrame:
    """(chapter_id, start, bytes) of (chapter_id, name, content): each chapter's archive, cut into its members and the parts of
    its directory, in order of ``start``. Members stand in order of their names, with fixed times, so that equal
    input gives equal bytes; names that repeat stay. A null content is empty; chapters without members have no archive."""
    rows = members.select("chapter_id", F.coalesce(F.col("name"), F.lit("")).alias("name"), F.col("content").cast("binary").alias("content"), F.monotonically_increasing_id().alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("data", T.BinaryType())])
    packed = rows.mapInArrow(_deflated, schema)
    empty = F.to_binary(F.lit(""), F.lit("utf-8"))
    packed = materialize(packed.select("chapter_id", "row", "name", F.crc32(F.coalesce("content", empty)).alias("crc"), F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"), F.octet_length("data").alias("packed"), "data"), "packed")
    name = F.encode("name", "utf-8")
    length = F.octet_length(name)
    about = packed.drop("data").withColumn("span", LOCAL + length + F.col("packed"))
    placed = materialize(chains.placed(about, ["chapter_id"], ["name", "row"], "span", chains.is_short(about, ["chapter_id"])), "members")
    common = ((UTF8_NAMES, 2), (DEFLATED, 2), (0, 2), (DATE, 2), (F.col("crc"), 4), (F.col("packed"), 4), (F.col("size"), 4), (length, 2))
    local = F.concat(_fields((0x04034B50, 4), (20, 2), *common, (0, 2)), name, F.col("data"))
    own = chains.joined(placed, packed.select("chapter_id", "row", "data"), ["chapter_id"], on=[("row", "row")])
    first = own.select("chapter_id", F.col("before").alias("start"), local.alias("bytes"))

    far = F.col("before") >= WIDE
    narrow = lambda x: F.when(x >= WIDE, ELSEWHERE).otherwise(x)
    wide = F.when(far, _fields((1, 2), (8, 2), (F.col("before"), 8))).otherwise(empty)
    entry = F.concat(_fields((0x02014B50, 4), (45, 2), (F.when(far, 45).otherwise(20), 2), *common), _fields((F.when(far, 12).otherwise(0), 2), (0, 2), (0, 2), (0, 2), (0, 4), (narrow(F.col("before")), 4)), name, wide)
    entries = placed.select("chapter_id", "place", "span", entry.alias("bytes")).withColumn("long", F.octet_length("bytes"))
    listed = chains.placed(entries.withColumnRenamed("place", "of"), ["chapter_id"], ["of"], "long", chains.is_short(entries, ["chapter_id"]))
    ends = entries.groupBy("chapter_id").agg(F.count("*").alias("n"), F.sum("span").alias("at"), F.sum("long").alias("listed"))
    second = chains.joined(listed.select("chapter_id", "before", "bytes"), ends, ["chapter_id"]).select("chapter_id", (F.col("before") + F.col("at")).alias("start"), "bytes")

    n, at, size = F.col("n"), F.col("at"), F.col("listed")
    large = (n >= WIDE_ROWS) | (at >= WIDE) | (size >= WIDE)
    record = _fields((0x06064B50, 4), (44, 8), (45, 2), (45, 2), (0, 4), (0, 4), (n, 8), (n, 8), (size, 8), (at, 8))
    finder = _fields((0x07064B50, 4), (0, 4), (at + size, 8), (1, 4))
    rows = F.when(n >= WIDE_ROWS, ELSEWHERE & 0xFFFF).otherwise(n)
    closing = _fields((0x06054B50, 4), (0, 2), (0, 2), (rows, 2), (rows, 2), (narrow(size), 4), (narrow(at), 4), (0, 2))
    third = ends.select("chapter_id", (at + size).alias("start"), F.concat(F.when(large, F.concat(record, finder)).otherwise(empty), closing).alias("bytes"))
    return first.unionByName(second).unionByName(third)


def archives(members: DataFrame) -> DataFrame:
    """(chapter_id, archive): the segments of each chapter joined, for archives that fit a row."""
    return segments(members).groupBy("chapter_id").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY start)").alias("archive"))


def listings(placed: DataFrame) -> DataFrame:
    """(chapter_id, members, n) of (chapter_id, place, member) with places from 1: each chapter's members in order, joined by
    commas, and how many there are. Stretches of ``chains.BLOCK`` places are joined first, so that what meets in a
    chapter's row is few texts, not all members; for lists that fit a row."""
    stretch = F.floor((F.col("place") - 1) / chains.BLOCK).alias("stretch")
    parts = placed.groupBy("chapter_id", stretch).agg(F.expr("listagg(member, ',') WITHIN GROUP (ORDER BY place)").alias("part"), F.count("*").alias("n"))
    return parts.groupBy("chapter_id").agg(F.expr("listagg(part, ',') WITHIN GROUP (ORDER BY stretch)").alias("members"), F.sum("n").alias("n"))


def read_archives(archived: DataFrame) -> DataFrame:
    """(chapter_id, pos, name, content) of (chapter_id, archive), in the directory's order, checksums verified. A null archive
    has no members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chapter, data in zip(batch.column("chapter_id"), batch.column("archive")):
                if not data.is_valid:
                    continue
                held: list[tuple[int, str, bytes]] = []

                def told(held: list, chapter=chapter, kind=batch.schema.field("chapter_id").type) -> pa.RecordBatch:
                    pos, names, contents = zip(*held)
                    held.clear()
                    return pa.RecordBatch.from_arrays([pa.array([chapter.as_py()] * len(pos), kind), pa.array(pos, pa.int64()), pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["chapter_id", "pos", "name", "content"])

                size = 0
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for pos, info in enumerate(z.infolist()):
                        held.append((pos, info.filename, z.read(info)))
                        size += len(held[-1][2])
                        if size > HELD or len(held) >= 5000:
                            yield told(held)
                            size = 0
                if held:
                    yield told(held)

    kind = archived.schema["chapter_id"].dataType.simpleString()
    return archived.select("chapter_id", "archive").mapInArrow(run, f"chapter_id {kind}, pos long, name string, content binary")


def log_lines(rows: DataFrame, key: str, index: str, text: str) -> DataFrame:
    """(key, start, line) of a JSON array of texts for each key, by ``index`` from 0 without gaps: an entry is a line of its own,
    the brackets belong to the first and the last line. A null text is null."""
    last = rows.groupBy(key).agg(F.max(index).alias("last"))
    met = chains.joined(rows.select(key, F.col(index).alias("start"), F.col(text).alias("entry")), last, [key])
    told = F.to_json(F.array(F.col("entry")), {"ignoreNullFields": "false"})
    line = F.concat(F.when(F.col("start") == 0, "[\n").otherwise(""), F.lit("    "), F.substring(told, 2, F.length(told) - 2), F.when(F.col("start") == F.col("last"), "\n]").otherwise(","), F.lit("\n"))
    return met.select(key, "start", line.alias("line"))


def write_ordered(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """Write (key, start, ...) as files that follow one another, and return the manifest (key, file, first, last, n_rows).

    Rows are range-sorted by key and start, so that a key of any length has as many files as it needs and short ones share
    one. The manifest is written last: what is not in it is not part of the sink, whatever tasks were tried twice."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = f"{folder}/data-{uuid.uuid4().hex}"
    rows.repartitionByRange(width, key, "start").sortWithinPartitions(key, "start").write.parquet(data)
    files = spark.read.schema(rows.schema).parquet(data).groupBy(key, F.col("_metadata.file_path").alias("file")).agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count("*").alias("n_rows"))
    files.write.mode("append").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def read_ordered(spark: SparkSession, folder: str, key: str, what: str) -> DataFrame:
    """(key, what): the sink's rows of each key joined in order, for keys whose text or bytes fit a row."""
    manifest = read_manifest(spark, folder)
    files = [r["file"] for r in manifest.select("file").distinct().collect()]  # as many as the writer had tasks
    rows = spark.read.parquet(*files) if files else None
    if rows is None:
        return manifest.select(key, F.lit(None).cast("string").alias(what))
    return rows.groupBy(key).agg(F.expr(f"listagg({what}) WITHIN GROUP (ORDER BY start)").alias(what))


def write_pages(rows: DataFrame, folder: str) -> None:
    """Rows under title=.../chapter=.../, replacing those partitions only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("title", "chapter").parquet(folder)
