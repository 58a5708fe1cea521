"""Archives, logs and attempts: files of any length in order, and calls that are made once."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from panelspark.operators import archive, chains, routing
from panelspark.storage import new_folder


def joined(segments):
    parts = {}
    for r in segments.collect():
        parts.setdefault(r.chapter_id, []).append((r.start, bytes(r.bytes)))
    out = {}
    for c, rows in parts.items():
        rows.sort()
        assert all(a + len(x) == b for (a, x), (b, _) in zip(rows, rows[1:]))  # no gap, no overlap
        out[c] = b"".join(x for _, x in rows)
    return out


@pytest.mark.parametrize("form", ["narrow", "wide"])
def test_archives_are_read_by_others(spark, monkeypatch, form):
    """One archive a chapter, however many members; spread groups; both forms of the directory."""
    monkeypatch.setattr(chains, "SHORT", 50)
    if form == "wide":
        monkeypatch.setattr(archive, "WIDE_ROWS", 2)
        monkeypatch.setattr(archive, "WIDE", 60)
    rows = [("a", f"p{i:04d}.txt", bytes([i % 256]) * (i % 37)) for i in range(700)] + [("b", "é/中.txt", b"x" * 100_000), ("b", "empty", b""), ("b", "null", None), (None, "n", b"lone")]
    df = spark.createDataFrame(rows, "chapter_id string, name string, content binary").repartition(5)
    files = joined(archive.segments(df))
    assert set(files) == {"a", "b", None}
    for chapter, data in files.items():
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            want = sorted((n, c or b"") for k, n, c in rows if k == chapter)
            assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == want
    assert archive.segments(df.limit(0)).collect() == []
    back = archive.read_archives(archive.archives(df))
    assert sorted((r.chapter_id or "", r.name, bytes(r.content)) for r in back.collect()) == sorted((k or "", n, c or b"") for k, n, c in rows)


def test_archives_of_over_65535_members(spark):
    df = spark.range(66_000).select(F.lit(1).alias("chapter_id"), F.format_string("%06d", "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    with zipfile.ZipFile(io.BytesIO(joined(archive.segments(df))[1])) as z:
        assert len(z.namelist()) == 66_000 and z.read("065999") == b"65999"


def test_logs_are_json_in_order(spark):
    rows = [(c, i, t) for c, n in ((1, 3000), (2, 1), (3, 40)) for i, t in enumerate([f'{i} "q" \\ é\n' if i % 3 else None for i in range(n)])]
    df = spark.createDataFrame(rows, "c long, i long, t string").repartition(3)
    folder = new_folder(spark, "log")
    manifest = archive.write_ordered(archive.log_lines(df, "c", "i", "t"), "c", folder)
    told = sorted((r.c, r.first, r.last, r.n_rows) for r in manifest.collect())
    assert {c: sum(n for k, *_, n in told if k == c) for c in (1, 2, 3)} == {1: 3000, 2: 1, 3: 40}
    assert sum(k == 1 for k, *_ in told) > 1 and all(a[2] + 1 == b[1] for a, b in zip(told, told[1:]) if a[0] == b[0])
    logs = {r.c: r.line for r in archive.read_ordered(spark, folder, "c", "line").collect()}
    for c, text in logs.items():
        want = [t for k, _, t in sorted(rows, key=lambda r: (r[0], r[1])) if k == c]
        assert json.loads(text) == want and text == json.dumps(want, ensure_ascii=False, indent=4) + "\n"


def test_attempts_are_made_for_open_units_only(spark):
    units = spark.createDataFrame([(i, 2, ["s", str(i)]) for i in range(6)], "u long, expected int, source array<string>")
    asked = []

    def attempt(replies):
        def call(left):
            asked.append(sorted(r.u for r in left.collect()))
            return spark.createDataFrame([(u, r) for u, r in replies], "u long, reply string")

        return call

    got = routing.attempted(units, "u", [attempt([(0, "a\nb"), (1, "a"), (2, ""), (3, None)]), attempt([(1, "c\nd"), (1, "b\nc"), (0, "x\ny")]), attempt([]), attempt([(2, "1. e\n2. f"), (9, "g\nh")])])
    assert {r.u: (r.attempt, r.answers) for r in got.collect()} == {0: (1, ["a", "b"]), 1: (2, ["b", "c"]), 2: (4, ["e", "f"]), 3: (None, ["s", "3"]), 4: (None, ["s", "4"]), 5: (None, ["s", "5"])}
    assert asked == [[0, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [2, 3, 4, 5], [2, 3, 4, 5]]
