"""Places in a total order, and pages deep in it, without one task that sees all rows."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are looked at for each range, to place its ends.
_SAMPLE = 32


@dataclass(frozen=True)
class Ranges:
    """Ranges of rows in an order: the first keys of all but the first range, and how many rows come before each range; at last all rows."""

    order: tuple[str, ...]
    cuts: tuple[tuple, ...]
    before: tuple[int, ...]

    def place(self, df: DataFrame) -> Column:
        """The number of a row's range: how many cuts aren't above it, by halves, so a row takes as many comparisons as the number of ranges has bits."""
        types = [df.schema[c].dataType for c in self.order]
        cuts = [F.struct(*[F.lit(v).cast(kind).alias(c) for c, v, kind in zip(self.order, cut, types, strict=True)]) for cut in self.cuts]
        own = F.struct(*self.order)

        def among(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(cuts[middle] <= own, among(middle + 1, high)).otherwise(among(low, middle))

        return among(0, len(cuts))


def ranges(df: DataFrame, order: list[str], *, rows_per_range: int = 1_000_000, most: int = 256) -> Ranges:
    """Ends and sizes of ranges of about rows_per_range rows (of more, where `most` ranges wouldn't do), from the order's columns alone.

    The driver gets some _SAMPLE keys a range, chosen by their hash, and then a count for
    each range.  Rows that agree in all columns of the order share a range, so these should tell all rows apart.
    """
    keys = df.select(*order)
    n = keys.count()
    parts = max(1, min(most, -(-n // rows_per_range)))
    cuts: list[tuple] = []
    if parts > 1:
        step = max(1, n // (_SAMPLE * parts))
        some = keys.where(F.pmod(F.xxhash64(*order), F.lit(step)) == 0).distinct()
        found = [tuple(r) for r in some.orderBy(*order).collect()]
        cuts = list(dict.fromkeys(found[i * len(found) // parts] for i in range(1, parts))) if found else []
    bare = Ranges(tuple(order), tuple(cuts), ())
    sizes = {r["_p"]: r["n"] for r in keys.select(bare.place(keys).alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Ranges(tuple(order), tuple(cuts), (0, *accumulate(sizes.get(i, 0) for i in range(len(cuts) + 1))))


def ranked(df: DataFrame, order: list[str], *, place: str = "place", **options) -> DataFrame:
    """Add each row's place, from 1, in ascending order (nulls first): its place in its own range, and the rows of the ranges before. Each range is sorted by itself. options: see ranges()."""
    r = ranges(df, order, **options)
    base = F.get(F.array(*[F.lit(b).cast("long") for b in r.before]), F.col("_p"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return df.withColumn("_p", r.place(df)).withColumn(place, base + within).drop("_p")


def running(df: DataFrame, order: list[str], amount: str, name: str, **options) -> DataFrame:
    """Add the running total of a whole number in an order that tells all rows apart: within ranges, from the totals of the ranges before (one number each). options: see ranges()."""
    r = ranges(df, order, **options)
    own = df.withColumn("_p", r.place(df))
    sums = {x["_p"]: x["s"] for x in own.groupBy("_p").agg(F.coalesce(F.sum(amount), F.lit(0)).alias("s")).collect()}
    base = (0, *accumulate(sums.get(i, 0) for i in range(len(r.cuts) + 1)))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return own.withColumn(name, F.get(F.array(*[F.lit(b).cast("long") for b in base]), F.col("_p")) + within).drop("_p")


def page(df: DataFrame, order: list[str], offset: int, size: int, **options) -> tuple[DataFrame, bool]:
    """(rows offset to offset + size in order, whether there are more).

    Only the ranges that the page lies in are sorted; of the others a scan gets the
    ends of the first column as a filter.  Counts of ranges tell whether there is more.
    """
    r = ranges(df, order, **options)
    first = min(bisect_right(r.before, offset), len(r.before) - 1) - 1
    last = max(first, min(bisect_right(r.before, max(offset, offset + size - 1)), len(r.before) - 1) - 1)
    own = df.withColumn("_p", r.place(df)).where(F.col("_p").between(first, last)).drop("_p")
    lead = order[0]
    if first > 0 and r.cuts[first - 1][0] is not None:
        own = own.where(F.col(lead) >= F.lit(r.cuts[first - 1][0]).cast(df.schema[lead].dataType))
    if last < len(r.cuts) and r.cuts[last][0] is not None:
        own = own.where(F.col(lead).isNull() | (F.col(lead) <= F.lit(r.cuts[last][0]).cast(df.schema[lead].dataType)))
    return own.orderBy(*order).offset(offset - r.before[first]).limit(size), r.before[-1] > offset + size
