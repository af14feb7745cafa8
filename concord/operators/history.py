"""Run history: issues, pages, streaks, health, and checks on recorded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running

#: Upper bounds of the cycle-duration histogram in seconds; fixed values.
BUCKETS = (0.1, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300, 600, 1200)
SEVERITY = ("ok", "skipped", "partial", "failed")


def reportable(outcome: Column, holds: Column, unresolved: Column) -> Column:
    return holds | outcome.isin("orphaned", "failed") | (F.coalesce(F.size(unresolved), F.lit(0)) > 0)


def keyset_page(rows: DataFrame, order: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """A page of `size` rows in descending order of columns, after a cursor, and one row more to tell whether there is a next page.

    The limit is taken in each partition before any row is moved.
    """
    if after is not None:
        before = F.lit(False)
        for i, c in enumerate(order):  # (a, b) < (x, y), written out so that the scan can use it
            same = F.lit(True)
            for d, v in zip(order[:i], after[:i], strict=True):
                same &= F.col(d) == F.lit(v)
            before |= same & (F.col(c) < F.lit(after[i]))
        rows = rows.where(before).where(F.col(order[0]) <= F.lit(after[0]))
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(size + 1)


def failure_streaks(runs: DataFrame, by: str, order: list[str], failed: str, degraded_at: int = 3) -> DataFrame:
    """by, streak (failures since the last success), degraded: without a sort, as runs after the last success are counted."""
    at = F.struct(*order)
    last_good = runs.groupBy(by).agg(F.max(F.when(~F.col(failed), at)).alias("good"))
    after = runs.join(last_good, by).where(F.col(failed) & (F.col("good").isNull() | (at > F.col("good")))).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return last_good.select(by).join(after, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("streak"), (F.coalesce("n", F.lit(0)) >= degraded_at).alias("degraded"))


def worst_status(runs: DataFrame, by: str, status: str) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col(status))
    return runs.groupBy(by).agg(F.max_by(status, rank).alias("worst"), F.count(F.lit(1)).alias("n_runs"), F.bool_or(F.col(status) == "failed").alias("any_failed"))


def bucket(value: Column, bounds: tuple = BUCKETS) -> Column:
    """The least bound that isn't below value, as text; +Inf above all."""
    out = F.lit("+Inf")
    for b in reversed(bounds):
        out = F.when(value <= b, F.lit(f"{b:g}")).otherwise(out)
    return out


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert(stored: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """stored with the last of changes for each key in place of its row, unless that is later in order; of equal ones the change counts. Both have the same columns. An aggregate, so frequent keys are combined first."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    last = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order, "_new")).alias("_last"))
    return last.select(*[c if c in key else F.col(f"_last.`{c}`") for c in stored.columns])


def advanced(watermarks: DataFrame, runs: DataFrame) -> DataFrame:
    """Watermarks (pair, endpoint, entity_type, token, status, run_at) after runs: the latest run of each counts; a null token keeps the one there was."""
    key = ["pair", "endpoint", "entity_type"]
    last = runs.groupBy(*key).agg(F.max_by(F.struct("token", "status", "run_at"), "run_at").alias("_new"))
    old = watermarks.select(*key, F.struct("token", "status", "run_at").alias("_old"))
    both = old.join(last, key, "full_outer")
    newer = F.col("_old").isNull() | (F.col("_new.run_at") >= F.col("_old.run_at"))
    pick = lambda c: F.when(F.col("_new").isNotNull() & newer, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
    token = F.when(F.col("_new").isNotNull() & newer, F.coalesce("_new.token", "_old.token")).otherwise(F.col("_old.token")).alias("token")
    return both.select(*key, token, pick("status"), pick("run_at"))


def conflicts(bindings: DataFrame, key: list[str], owner: str) -> DataFrame:
    """Keys that several owners claim: what a unique constraint would refuse."""
    return bindings.groupBy(*key).agg(F.count_distinct(owner).alias("n_owners")).where("n_owners > 1")


def orphans(bindings: DataFrame, presence: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """key, finding (resolved, still_missing, newly_missing, present, inconclusive): presence has here (null: the check failed, never a miss)."""
    open_ = log.where(F.col("resolved_at").isNull()).select(key, F.lit(True).alias("open"))
    checked = bindings.select(key).join(presence.select(key, "here", F.lit(True).alias("asked")), key, "left").join(open_, key, "left")
    is_open = F.coalesce("open", F.lit(False))
    finding = (
        F.when(F.col("here").isNull(), "inconclusive").when(F.col("here") & is_open, "resolved").when(F.col("here"), "present").when(is_open, "still_missing").otherwise("newly_missing")
    )
    return checked.select(key, finding.alias("finding"))


def record_missing(log: DataFrame, sightings: DataFrame, key: str) -> DataFrame:
    """Fold sightings (key, at) into the log (key, first_missing_at, last_missing_at, resolved_at): the first time stays, the last moves on, and the row is open again."""
    new = sightings.groupBy(key).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    both = log.join(new, key, "full_outer")
    return both.select(
        key,
        F.coalesce("first_missing_at", "lo").alias("first_missing_at"),
        F.coalesce(F.greatest("last_missing_at", "hi"), "hi", "last_missing_at").alias("last_missing_at"),
        F.when(F.col("hi").isNull(), F.col("resolved_at")).alias("resolved_at"),
    )


def record_orphans(log: DataFrame, sightings: DataFrame, key: list[str]) -> DataFrame:
    """record_missing with hints: native_key and last_seen_at of the latest sighting that has them, else what the log has. sightings: key, at, native_key, last_seen_at."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"_{c}")
    new = sightings.groupBy(*key).agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"), latest("native_key"), latest("last_seen_at"))
    both = log.join(new, key, "full_outer")
    return both.select(
        *key, F.coalesce("_native_key", "native_key").alias("native_key"), F.coalesce("_last_seen_at", "last_seen_at").alias("last_seen_at"),
        F.coalesce("first_missing_at", "_lo").alias("first_missing_at"), F.coalesce(F.greatest("last_missing_at", "_hi"), "_hi", "last_missing_at").alias("last_missing_at"),
        F.when(F.col("_hi").isNull(), F.col("resolved_at")).alias("resolved_at"),
    )


def resolved(log: DataFrame, seen: DataFrame, key: list[str], now: Column) -> DataFrame:
    """The log with resolved_at and last_seen_at set to now for open orphans that were seen again."""
    again = seen.select(*key).distinct().withColumn("_again", F.lit(True))
    both = log.join(again, key, "left")
    hit = F.coalesce("_again", F.lit(False)) & F.col("resolved_at").isNull()
    return both.withColumns({"resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")), "last_seen_at": F.when(hit, now).otherwise(F.col("last_seen_at"))}).drop("_again")


def rechecked(log: DataFrame, bindings: DataFrame, presence: DataFrame, key: list[str]) -> DataFrame:
    """key, finding of open orphans that have a binding: resolved, still_missing, or inconclusive where the check failed or wasn't made."""
    open_ = log.where(F.col("resolved_at").isNull()).select(*key).join(bindings.select(*key), key, "left_semi")
    told = open_.join(presence.select(*key, "here"), key, "left")
    return told.select(*key, F.when(F.col("here").isNull(), "inconclusive").when(F.col("here"), "resolved").otherwise("still_missing").alias("finding"))


def orphan_digest(log: DataFrame, by: str, now: Column) -> DataFrame:
    """by, n_open, n_tentative (seen missing once), n_confirmed, longest_s: open orphans only."""
    open_ = log.where(F.col("resolved_at").isNull())
    tentative = F.col("last_missing_at") <= F.col("first_missing_at")
    return open_.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_open"), F.count_if(tentative).alias("n_tentative"), F.count_if(~tentative).alias("n_confirmed"), F.max(F.unix_timestamp(now) - F.unix_timestamp("first_missing_at")).alias("longest_s")
    )


def orphan_advisories(log: DataFrame, now: Column, *, confirm_after_s: int = 0) -> DataFrame:
    """Add confidence (tentative, confirmed), missing_for_s and checked_ago_s (whole seconds) to open orphans.

    confirmed: seen missing again, at least confirm_after_s after the first time, and more than once.
    """
    seconds = lambda a, b: F.unix_seconds(a) - F.unix_seconds(b)
    first, last = F.col("first_missing_at"), F.col("last_missing_at")
    confirmed = (last > first) & (seconds(last, first) >= confirm_after_s)
    open_ = log.where(F.col("resolved_at").isNull())
    return open_.withColumns({"confidence": F.when(confirmed, "confirmed").otherwise("tentative"), "missing_for_s": seconds(now, first), "checked_ago_s": seconds(now, last)})


def run_issues(items: DataFrame, orphan_log: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Items with kind (dataset_refs, owners, orphan, other), their sorted unresolved fields (as many as an entity has at most), and first_missing_at of orphans.

    Orphans join on the whole key, entity type included.
    """
    fields = unresolved.groupBy("item_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    log = orphan_log.select("neutral_id", "endpoint", "entity_type", "first_missing_at")
    out = items.join(fields, "item_id", "left").join(log, ["neutral_id", "endpoint", "entity_type"], "left")
    kind = F.when(F.array_contains("fields", "dataset_refs"), "dataset_refs").when(F.array_contains("fields", "owners"), "owners").when(F.col("outcome") == "orphaned", "orphan").otherwise("other")
    return out.withColumn("kind", kind).withColumn("first_missing_at", F.when(F.col("outcome") == "orphaned", F.col("first_missing_at")))


def row_audit(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, was, now: a row for each field that really changed; fields that new lacks are left alone."""
    def long(df, name):
        return df.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields if f in df.columns])))

    return long(new, "now").join(long(old, "was"), [key, "field"]).where(~F.col("now").eqNullSafe(F.col("was"))).select(key, "field", "was", "now")


def ready(tasks: DataFrame) -> DataFrame:
    """id, ready: pending tasks (id, status, deps) whose dependencies are all done; an unknown dependency isn't."""
    needs = tasks.select("id", F.explode("deps").alias("dep"))
    state = tasks.select(F.col("id").alias("dep"), (F.col("status") == "done").alias("done"))
    met = needs.join(state, "dep", "left").groupBy("id").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("met"))
    return tasks.join(met, "id", "left").select("id", ((F.col("status") == "pending") & F.coalesce("met", F.lit(True))).alias("ready"))


def board(tasks: DataFrame) -> DataFrame:
    """package, n_tasks, n_ready, next_ready (the ready task of least number) of tasks (id, number, package, status, deps)."""
    told = tasks.join(ready(tasks), "id")
    return told.groupBy("package").agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if("ready").alias("n_ready"), F.min_by("id", F.when(F.col("ready"), F.col("number"))).alias("next_ready"))


def violations(pairs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """pair, problem of every pair whose source or target is missing, disabled, the same, or has the wrong role; all problems of a pair are told."""
    e = endpoints
    s, t = e.select(F.col("name").alias("source"), F.col("role").alias("sr"), F.col("enabled").alias("se")), e.select(F.col("name").alias("target"), F.col("role").alias("tr"), F.col("enabled").alias("te"))
    j = pairs.join(s, "source", "left").join(t, "target", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("sr").isNull(), "source_missing"), F.when(F.col("tr").isNull(), "target_missing"),
        F.when(F.col("sr") == "target", "source_is_target"), F.when(F.col("tr") == "source", "target_is_source"),
        F.when(F.col("source") == F.col("target"), "same_endpoint"), F.when(~F.col("se"), "source_disabled"), F.when(~F.col("te"), "target_disabled"),
    ))
    return j.select("pair", F.explode(problems).alias("problem"))


def within_limits(files: DataFrame, order: str, size: str, *, most_bytes: int, total_bytes: int) -> DataFrame:
    """Files in order whose size and running total stay within limits, with their running total. Totals run within ranges of the order, from what the ranges before hold (see ranks.py)."""
    own = files.where(F.col(size) <= most_bytes)
    return running(own, [order], size, "running").where(F.col("running") <= total_bytes)
