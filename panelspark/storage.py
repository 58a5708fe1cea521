"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has written and not yet deleted.
_WRITTEN: dict[str, None] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, to be deleted by ``delete`` or at the end of ``scratch``."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = None
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: this cuts the lineage, and a lost
    executor costs no recomputation of what stands before."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.pop(path, None)


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once all that reads it is written itself."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        for written in [w for w in _WRITTEN if w.rpartition("/")[2] == path.rpartition("/")[2]] or [path]:
            delete(df.sparkSession, written)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """On leaving, delete the intermediate tables that were written inside. Results are lazy and read some of them, so
    write or collect a result before leaving."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            delete(spark, path)


def collect_garbage(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect garbage, which is when Spark deletes the shuffle files of finished steps."""
    spark._jvm.System.gc()
