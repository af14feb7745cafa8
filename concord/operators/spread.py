"""Partitions whose number follows the rows, so that what a task holds doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task sorts, joins or aggregates at once; fixed value.
ROWS = 200_000


def parts(*inputs: DataFrame, rows: int = 0) -> int:
    """How many partitions of about so many rows (ROWS, if 0) the largest of the inputs fills; counting reads no columns."""
    return max(1, *(-(-df.count() // (rows or ROWS)) for df in inputs))


def dealt(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Rows by a hash of columns to n partitions, which stay as they are: adaptive execution merges none of them."""
    return df.repartition(n, *by)
