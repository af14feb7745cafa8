"""Keeping a state of checksums from a stream of observed rows, with a feed of changes and a position that is held back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.diffs import last_change
from ..operators.history import upsert
from ..operators.snapshots import snapshot_changes
from ..plans.state import State
from .offsets import decoded, encoded

STATE = "key string, checksum string, seq long"
HELD = "key string, checksum string, seq long, terminal boolean"
POSITION = "stream string, token string"
BUCKETS = 64


def bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))


def position_of(state: State, stream: str) -> int | None:
    """How far the stream has been taken in, or null: from the start."""
    rows = state.table("positions", POSITION).where(F.col("stream") == stream).select("token").take(1)
    return decoded(rows[0]["token"], stream) if rows else None


def follow(observed: DataFrame, state: State, checkpoint: str, *, stream: str = "objects", once: bool = True) -> StreamingQuery:
    """Fold a stream of observations (key, checksum, seq; a null checksum: deleted) into state, batch by batch.

    Of a batch's observations of a key only the last counts.  What a batch changes is
    written to feed/batch=N beside the state (key, change, checksum, was), then the state is
    committed with the batch's id; a replayed batch writes the same feed, or nothing if it was committed.

    Where observations have a column terminal, those from the first seq that isn't terminal on are held back
    with the state and taken up again with the next batch; one that comes again as terminal takes
    the place of the one held.  The stream's position is the last seq taken in.  Where it can't be read, or is
    another stream's, the state counts as empty, and what is observed is told as new.
    State lies in BUCKETS buckets of keys; a batch rewrites those that it touches.
    """

    def fold(batch: DataFrame, number: int) -> None:
        now = state.current()
        if now["batch"] is not None and number <= now["batch"]:
            return
        known = position_of(state, stream) is not None or not now["tables"]
        before = state.table("objects", STATE) if known else state.spark.createDataFrame([], STATE)
        held = state.table("held", HELD) if known else state.spark.createDataFrame([], HELD)
        fresh = batch if "terminal" in batch.columns else batch.withColumn("terminal", F.lit(True))
        fresh = fresh.select("key", "checksum", "seq", "terminal")
        # of an observation that was held and comes again the new one counts
        rows = held.join(fresh.select("key", "seq"), ["key", "seq"], "left_anti").unionByName(fresh).persist()
        try:
            stop, last = rows.agg(F.min(F.when(~F.col("terminal"), F.col("seq"))), F.max("seq")).first()
            taken = rows if stop is None else rows.where(F.col("seq") < stop)
            waiting = rows.limit(0) if stop is None else rows.where(F.col("seq") >= stop)
            latest = last_change(taken.drop("terminal"), ["key"], ["seq"]).select("key", "checksum", "seq")
            touched = sorted(r[0] for r in bucketed(latest).select("bucket").distinct().collect())  # BUCKETS at most
            own = bucketed(before).where(F.col("bucket").isin(touched)).drop("bucket")
            # a late observation doesn't undo what is stored
            latest = latest.join(own.select("key", F.col("seq").alias("_s")), "key", "left").where(F.col("_s").isNull() | (F.col("seq") >= F.col("_s"))).drop("_s")
            seen = own.join(latest.select("key"), "key", "left_semi")
            gone = latest.where(F.col("checksum").isNull()).select("key")
            changes = snapshot_changes(latest.where(F.col("checksum").isNotNull()), seen, "key")
            changes.write.mode("overwrite").parquet(f"{state.folder}/feed/batch={number}")
            after = bucketed(upsert(own, latest, ["key"], ["seq"]).join(gone, "key", "left_anti"))
            reached = position_of(state, stream) if known else None
            top = taken.agg(F.max("seq")).first()[0] if stop is not None else last
            reached = max((x for x in (reached, top) if x is not None), default=None)
            token = [(stream, encoded(stream, reached))] if reached is not None else []
            tables = {"objects": after, "held": waiting, "positions": state.spark.createDataFrame(token, POSITION)}
            state.commit(tables, number, {"objects": touched if known else list(range(BUCKETS))})
        finally:
            rows.unpersist()

    writer = observed.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
