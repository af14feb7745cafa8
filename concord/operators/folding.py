"""Several changes of one object in a batch: each is compared with what the ones before it have left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import dealt, parts


def folded_fields(changes: DataFrame, stored: DataFrame, key: list[str], *, width: int = 10_000, n: int = 0) -> DataFrame:
    """Add previous, changed and written to the fields of changes (key, field, seq, value, checksum, writable).

    A field of a change is compared with what the target holds by then: the last earlier
    value of the batch that could be written, else the stored one (key, field, value, checksum), else nothing.  It is changed
    if the checksums differ, and written if it is changed and writable; what isn't written leaves the target as it is.
    seq tells an object's changes apart.

    The value before a row is the last writable one, whether it was itself written or was there already,
    so no loop is needed.  An object with very many changes is cut by seq to pieces of `width`:
    each piece is a window of its own, and what it starts from is the last value of the pieces before, of which there is one row each.
    There are n partitions, by default as many as the number of rows asks for.
    """
    on = [*key, "field"]
    n = n or parts(changes, stored)
    tip = F.when(F.col("writable"), F.struct("value", "checksum"))
    own = dealt(changes.withColumn("_piece", F.floor(F.col("seq") / width)), n, [*on, "_piece"])
    pieces = own.groupBy(*on, "_piece").agg(F.max_by(F.struct("value", "checksum"), F.when(F.col("writable"), F.col("seq"))).alias("_end"))
    # what is stored comes before all pieces
    held = stored.select(*on, F.lit(None).cast("long").alias("_piece"), F.struct("value", "checksum").alias("_end"), F.lit(0).alias("_own"))
    ends = dealt(held.unionByName(pieces.withColumn("_own", F.lit(1))), n, on)
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*on).orderBy("_own", "_piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt(ends.withColumn("_start", before).where("_own = 1").drop("_end", "_own"), n, [*on, "_piece"])
    within = F.last(tip, ignorenulls=True).over(Window.partitionBy(*on, "_piece").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    out = own.withColumn("_within", within).join(starts, [*on, "_piece"], "left").withColumn("_was", F.coalesce("_within", "_start"))
    changed = F.col("_was").isNull() | ~F.col("_was.checksum").eqNullSafe(F.col("checksum"))
    out = out.withColumns({"previous": F.col("_was.value"), "changed": changed, "written": changed & F.col("writable")})
    return out.drop("_piece", "_within", "_start", "_was")


def folded_records(fields: DataFrame, stored: DataFrame, key: list[str], *, n: int = 0) -> DataFrame:
    """key, seq, outcome, n_changes, n_writes of every change, from folded_fields(): the first write to an object of which nothing is stored creates it; others are written, unchanged, or skipped where nothing could be written. n: as in folded_fields(); counting fields folds them once more."""
    n = n or parts(fields)
    records = dealt(fields.select(*key, "seq", "changed", "written"), n, [*key, "seq"]).groupBy(*key, "seq").agg(F.count_if("changed").alias("n_changes"), F.count_if("written").alias("n_writes"))
    first = fields.where("written").groupBy(*key).agg(F.min("seq").alias("seq"))
    # one row for each object that is created, so an object with very many changes is not one key of a join
    creates = first.join(stored.select(*key).distinct(), key, "left_anti").withColumn("_creates", F.lit(True))
    out = records.join(dealt(creates, n, [*key, "seq"]), [*key, "seq"], "left")
    outcome = F.when(F.col("_creates"), "created").when(F.col("n_writes") > 0, "written").when(F.col("n_changes") == 0, "unchanged").otherwise("skipped")
    return out.select(*key, "seq", outcome.alias("outcome"), "n_changes", "n_writes")
