"""Rows of all pairs of the items of two lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of the inner and of the outer list that become rows at a time.
INNER, OUTER = 512, 8


def pairs(lists: DataFrame, outer: str, inner: str, outer_item: str, inner_item: str) -> DataFrame:
    """A row for each pair of items of the lists ``outer`` and ``inner`` of a row, with its other columns; the inner items follow one
    another behind each outer one. Spark holds all rows that one row becomes until they are taken (a million from two lists of a
    thousand); so lists are cut into pieces, which a sort parts from what makes rows of them."""
    rest = [c for c in lists.columns if c not in (outer, inner)]
    cut = lists.withColumn("_number", F.monotonically_increasing_id())
    for name, at, size in ((outer, "_outer", OUTER), (inner, "_inner", INNER)):
        cut = cut.withColumn(at, F.explode(F.sequence(F.lit(1), F.greatest(F.size(name), F.lit(1)), F.lit(size)))).withColumn(name, F.slice(name, F.col(at), size))
    cut = cut.sortWithinPartitions("_number", "_inner", "_outer").select(*rest, outer, inner)
    each = cut.select(*rest, inner, F.explode(outer).alias(outer_item))
    return each.select(*rest, outer_item, F.explode(inner).alias(inner_item))
