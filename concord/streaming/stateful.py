"""The comparison of snapshots as a stateful operator: Spark keeps state, timers and positions in the query's own checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

CHANGE = "key string, change string, checksum string, was string, seq long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Without this a query with timers would go on with empty batches for ever, and never end.
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
#: The only provider that has timers and lists.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Comparison(StatefulProcessor):
    """For each key: what was last taken in (seq, checksum; a deletion has none and stays known), and the observations held back.

    Observations are taken in by seq.  One that isn't terminal holds itself and all later ones of its key
    until it comes again as terminal, or hold_ms have passed: then it is given up, and what waited behind it goes on.
    One whose seq isn't above the last taken in is late and changes nothing, so neither a replay nor a late row undoes state.
    """

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "seq long, checksum string")
        self.held = handle.getListState("held", "seq long, checksum string, terminal boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._go_on(key[0], {r.seq: (r.checksum, bool(r.terminal)) for r in rows}, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first = min((seq for seq, _, terminal in self.held.get() if not terminal), default=None)
        if first is not None:
            yield Row(key=key[0], change="given_up", checksum=None, was=None, seq=first)
            yield from self._go_on(key[0], {first: None}, timerValues)

    def _go_on(self, key: str, fresh: dict, timer_values) -> Iterator[Row]:
        waiting = {seq: (checksum, terminal) for seq, checksum, terminal in self.held.get()} | fresh
        last, was = self.taken.get() if self.taken.exists() else (None, None)
        moved = False
        for seq in sorted(waiting):
            if waiting[seq] is None:  # given up
                del waiting[seq]
                continue
            checksum, terminal = waiting[seq]
            if last is not None and seq <= last:
                if seq < last or checksum != was:
                    yield Row(key=key, change="late", checksum=checksum, was=was, seq=seq)
            elif not terminal:
                break
            else:
                if checksum != was:
                    yield Row(key=key, change="deleted" if checksum is None else "upsert", checksum=checksum, was=was, seq=seq)
                last, was, moved = seq, checksum, True
            del waiting[seq]
        if moved:
            self.taken.update((last, was))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if waiting:
            self.held.put([(seq, *waiting[seq]) for seq in sorted(waiting)])
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.hold_ms)
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def compared(observed: DataFrame, *, hold_s: int = 3600) -> DataFrame:
    """Stream of CHANGE rows (upsert, deleted, late, given_up) of a stream of observations (key, checksum, seq, and terminal, if not all are); a null checksum is a deletion.

    Null keys are left out.  Every observation of a key passes through its one task, one after the other, as its state asks.
    """
    rows = observed if "terminal" in observed.columns else observed.withColumn("terminal", F.lit(True))
    rows = rows.where(F.col("key").isNotNull() & F.col("seq").isNotNull()).select("key", "checksum", F.col("seq").cast("long").alias("seq"), F.coalesce("terminal", F.lit(True)).alias("terminal"))
    return rows.groupBy("key").transformWithState(Comparison(hold_s * 1000), CHANGE, "Append", "ProcessingTime")


def follow_changes(observed: DataFrame, feed: str, checkpoint: str, *, hold_s: int = 3600, once: bool = True) -> StreamingQuery:
    """Write compared() to a Parquet feed, each change once: the position, the state and the feed's commits are the query's.

    once: take in what is there and end; what is held for too long is then given up with the next
    batch that has rows.  Otherwise batches run by the minute, rows or not, and give up in time.
    """
    spark = observed.sparkSession
    writer = compared(observed, hold_s=hold_s).writeStream.format("parquet").option("path", feed).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    # a query takes the session's settings as they are when it starts
    settings = {_PROVIDER: _ROCKSDB} | ({_EMPTY_BATCHES: "false"} if once else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current(spark: SparkSession, feed: str) -> DataFrame:
    """key, checksum, seq of every object that is there, from the feed: the last change of each key."""
    changes = spark.read.schema(CHANGE).parquet(feed).where(F.col("change").isin("upsert", "deleted"))
    return changes.groupBy("key").agg(F.max_by("checksum", "seq").alias("checksum"), F.max("seq").alias("seq")).where(F.col("checksum").isNotNull())
