"""Connected components of a written table of pairs, by the library's own operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelspark.operators.components import components as by_stars


def components(pairs: DataFrame) -> DataFrame:
    """(a, b) pairs, a written table -> (node, root): the least node of each node's component; nodes without a pair are left out."""
    return by_stars(pairs, pairs.count())
