"""Files by path: parts of a path, which files count, and the size of an image from its first bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def folder(path: Column) -> Column:
    """All before the last slash; the root keeps its own."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("")), F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")))


def stem(path: Column) -> Column:
    """The last part without its ending; a name that starts with dots keeps them."""
    return F.regexp_extract(basename(path), r"^(\.*[^.]*(?:\.[^.]*)*?)(?:\.[^.]*)?$", 1)


def ending(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def plugin_files(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Python files that are no private ones."""
    name = basename(F.col(path_col))
    return paths.where(F.endswith(name, F.lit(".py")) & ~F.startswith(name, F.lit("__")))


def size_of(head: bytes) -> tuple[int, int] | None:
    """(w, h) of a PNG, GIF, JPEG or lossy, lossless or extended WebP from its bytes; None if it is none of them."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        if head[12:16] == b"VP8X":
            return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
        if head[12:16] == b"VP8L":
            bits = int.from_bytes(head[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if head[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", head[26:30])
            return w & 0x3FFF, h & 0x3FFF
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head) and head[at] == 0xFF:
            kind = head[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h
            at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD9 else 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None


def image_sizes(files: DataFrame, most: int = 1 << 16) -> DataFrame:
    """(path, w, h) of (path, content), from the first ``most`` bytes, in which a header lies; what cannot be read drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, s) for p, s in zip(batch.column("path").to_pylist(), (size_of(c.as_py() or b"") for c in batch.column("head"))) if s]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), *(pa.array([s[k] for _, s in found], pa.int32()) for k in (0, 1))], ["path", "w", "h"])

    return files.select("path", F.substring("content", 1, most).alias("head")).mapInArrow(run, "path string, w int, h int")


def split_failed(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows in quarantine): ``problem`` says what is wrong with a row, or is null. Failed units are kept with a
    reason instead of stopping a run."""
    told = rows.withColumn("problem", problem)
    return told.where("problem is null").drop("problem"), told.where("problem is not null")
