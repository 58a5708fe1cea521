"""One test for each finding of the fourth round."""

import pytest

from panelspark.operators import chains
from panelspark.plans import imaging


@pytest.mark.parametrize("short", [8192, 50])
def test_f1_an_archive_is_listed_whole(spark, monkeypatch, tmp_path, short):
    """One row for each archive with all its members and their number, in name order, beyond the 500 that once were a part and
    beyond page 1000; lists of many stretches, of one member, of a null chapter."""
    monkeypatch.setattr(chains, "SHORT", short)
    monkeypatch.setattr(chains, "BLOCK", 40)
    sizes = {"a": 1300, "b": 1, "c": 40, "d": 81, None: 600}
    rows = [(c, 7 * i + 3, i % 5) for c, n in sizes.items() for i in range(n)]
    spark.createDataFrame(rows, "p_brand string, p_partkey long, p_size int").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    got = imaging.archive_members(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(sizes)
    for x in got:
        want = sorted(f"page_{i:03d}.webp" for i in range(1, sizes[x.chapter_id] + 1))
        assert x.members.split(",") == want and x.n == len(want)
