"""WARC archives from a table of pages, and back.

Method: deterministic sharded writer. Records are range-sorted, each range is written as gzip members, one for each
record, and another file is started when the compressed size reaches a limit. Bounds of ranges come from a sample chosen
by the records' own hashes, so that equal tables give equal files however they are partitioned. Headers and digests are
made anew from the payload. Tasks write under temporary names and report what they wrote; the driver then
renames exactly the reported files, so that files of failed or repeated attempts never count, and writes
the manifest. Equal payloads are stored once: other records revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import drop_table, materialize
from panelspark.storage import new_folder

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "shard int, roll int, path string, records long, bytes long, digest string"


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, revisit_of: int | None, is_revisit: bool) -> bytes:
    """One record, uncompressed. A revisit has the HTTP head and no payload."""
    digest = _sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", _sha1(block)), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if is_revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", _record_id(revisit_of, digest)))
        fields.append(("X-Refers-To-Page", str(revisit_of)))
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one uncompressed record, with its payload's length and digest as they are found."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    if _sha1(block) != field["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {field['WARC-Record-ID']} does not match")
    out = {"record_type": field["WARC-Type"], "url": field.get("WARC-Target-URI"), "page_id": int(field["X-Page-Id"]) if "X-Page-Id" in field else None}
    if out["record_type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "refers_to": None, "payload": payload}
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return out | {"payload_bytes": int(field["X-Payload-Length"]), "payload_digest": digest, "refers_to": int(field["X-Refers-To-Page"]), "payload": None}


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file:{folder.removeprefix('file:')}")


def _writer(folder: str, roll_bytes: int, level: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        files, root = _open(folder)
        place = posixpath.join(root, "_temporary_names", attempt)
        shard, roll, records, size, out, sha, done = -1, 0, 0, 0, None, None, []

        def close() -> None:
            nonlocal out, roll, records, size
            out.close()
            done.append((shard, roll, posixpath.join("_temporary_names", attempt, f"{shard:06d}-{roll:06d}"), records, size, sha.hexdigest()))
            out, roll, records, size = None, roll + 1, 0, 0

        for batch in batches:
            for own, page, url, payload, refers, revisit in zip(batch.column("_shard").to_pylist(), *(batch.column(c) for c in ("_id", "_url", "_payload", "_refers", "_revisit"))):
                if own != shard:
                    if out is not None:
                        close()
                    shard, roll = own, 0
                if out is None:
                    files.create_dir(place, recursive=True)
                    out, sha = files.open_output_stream(posixpath.join(place, f"{shard:06d}-{roll:06d}"), compression=None), hashlib.sha1()
                coder = zlib.compressobj(level, wbits=31)
                data = coder.compress(build_record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py(), revisit.as_py())) + coder.flush()
                out.write(data)
                sha.update(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "roll", "path", "records", "bytes", "digest"])

    return run


#: Records of the sample for each range, about.
PER_RANGE = 50


def _sort_key(digest: Column) -> Column:
    """Bytes that sort as the page ids do, null first, and then as the digests."""
    page = F.col("_id")
    shifted = F.unhex(F.lpad(F.hex(page.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(F.when(page.isNull(), F.unhex(F.lit("00" * 9))).otherwise(F.concat(F.unhex(F.lit("01")), shifted)), F.unhex(digest))


def _bounds(rows: DataFrame, shards: int) -> list[bytes]:
    """The first keys of all ranges but the first, from a hash sample of keys; about PER_RANGE times ``shards`` reach the
    driver, whatever the input's size."""
    keys = rows.select("_key").distinct()
    share = min(1.0, PER_RANGE * shards / max(1, rows.count()))
    some = keys.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    got = sorted(bytes(r[0]) for r in some.collect())
    return sorted({got[len(got) * k // shards] for k in range(1, shards)}) if got else []


def _range_of(bounds: list[bytes]):
    @F.pandas_udf(T.IntegerType())
    def find(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(bounds, bytes(k)))

    return find


def write_warc(pages: DataFrame, folder: str, shards: int, roll_bytes: int = 1 << 30, least: int = 1000, level: int = 6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page to ``folder`` and return the manifest (shard, roll, path, records, bytes, digest).

    The payload is the html in UTF-8; null is empty. Among equal payloads of at least ``least`` bytes, those with
    the largest page id are responses (rows that repeat that id, each), all others revisit it; where no row of
    the group has an id, all are responses. Ids or urls may be null: the record then has no such field. An empty
    table gives an empty manifest and no file. The manifest's rows are one for each file, never for records."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("_payload"))
    rows = rows.withColumn("_digest", F.sha1("_payload"))
    large = rows.where(F.octet_length("_payload") >= least)
    groups = materialize(large.groupBy("_digest").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1 and _keep is not null").drop("_n"), "payloads")
    size = F.octet_length("_payload")
    marked = rows.join(groups, (rows["_digest"] == groups["_digest"]) & (size >= least), "left").select("_id", "_url", "_payload", rows["_digest"], "_keep")
    marked = marked.withColumn("_revisit", F.col("_keep").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_keep"))).withColumn("_refers", F.when(F.col("_revisit"), F.col("_keep")))
    # the digest splits ranges of rows without an id; a record that stands in the table many times over makes one range large
    bounds = _bounds(rows.select(_sort_key(F.col("_digest")).alias("_key")), shards)
    ranged = marked.withColumn("_shard", _range_of(bounds)(_sort_key(F.col("_digest")))).repartitionById(shards, "_shard").sortWithinPartitions("_shard", "_id", "_digest", "_url")
    told = materialize(ranged.select("_shard", "_id", "_url", "_payload", "_refers", "_revisit").mapInArrow(_writer(folder, roll_bytes, level), _MANIFEST), "manifest", 500)
    drop_table(groups)
    return _commit(spark, told, folder)


def _commit(spark: SparkSession, told: DataFrame, folder: str) -> DataFrame:
    """Give the reported files their final names, then write the manifest; files of other attempts are deleted."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    files = root.getFileSystem(conf)
    named = []
    for r in told.orderBy("shard", "roll").toLocalIterator():
        name = f"records-{r['shard']:06d}-{r['roll']:06d}.warc.gz"
        if not files.rename(path(root, r["path"]), path(root, name)):
            raise OSError(f"cannot rename {r['path']} to {name}")
        named.append((r["shard"], r["roll"], name, r["records"], r["bytes"], r["digest"]))
    files.delete(path(root, "_temporary_names"), True)
    files.mkdirs(root)
    out = files.create(path(root, "_manifest.json.tmp"), True)
    out.write(bytearray(json.dumps([dict(zip(("shard", "roll", "path", "records", "bytes", "digest"), x)) for x in named]).encode()))
    out.close()
    files.rename(path(root, "_manifest.json.tmp"), path(root, "_manifest.json"))
    drop_table(told)
    return spark.createDataFrame(named, _MANIFEST)


_RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked."""
    unzip, parts, data = zlib.decompressobj(wbits=31), [], b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        parts.append(unzip.decompress(data))
        data = b""
        if unzip.eof:
            yield b"".join(parts)
            data, unzip, parts = unzip.unused_data, zlib.decompressobj(wbits=31), []
    if any(parts):
        raise ValueError("the file ends inside a record")


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the files in a manifest: (page_id, url, payload_bytes, payload_digest, record_type, refers_to)
    and, if wanted, payload. Every block's digest is checked; a record that does not match fails the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                held = []
                with files.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for raw in members(stream):
                        held.append(parse_record(raw))
                        if len(held) == 500:
                            yield table(held)
                            held = []
                if held:
                    yield table(held)

    names = [f.name for f in _RECORD.fields] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def table(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], t) for n, t in zip(names, kinds)], names)

    schema = T.StructType(_RECORD.fields + [T.StructField("payload", T.BinaryType())] * with_payload)
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n, "path").mapInArrow(run, schema)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Archive all pages in the shared folder and read the archives back."""
    folder = new_folder(spark, "warc")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, shards)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT digest, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY digest
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN g.keep IS NULL OR g.keep = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.keep IS NOT NULL AND g.keep <> p.page_id THEN g.keep END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND p.n >= 1000
"""
