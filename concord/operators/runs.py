"""Recording runs: one row a run, what there is to report of its records, and readings of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

from .diffs import OUTCOMES
from .history import SEVERITY, reportable

#: Exit codes and the message of runs that were never closed; fixed values.
EXIT_OK, EXIT_INCOMPLETE, EXIT_UNREACHABLE = 0, 1, 3
STALE = "the process that ran it is gone"
HEALTH = ("healthy", "degraded", "unhealthy")
KEPT = ("run_id", "pair", "entity_type", "dry_run", "started_at")


def started(runs: DataFrame) -> DataFrame:
    """New runs (run_id, pair, entity_type, dry_run, started_at) as rows of the run table: running, nothing counted yet."""
    zero = [F.lit(0).cast("long").alias(f"n_{o}") for o in OUTCOMES]
    none = [F.lit(None).cast(t).alias(n) for n, t in (("finished_at", "timestamp"), ("duration_s", "double"))]
    return runs.select(*KEPT, F.lit("running").alias("status"), *none, *zero, F.lit(0).cast("long").alias("read"), F.lit(0).cast("long").alias("errors"), F.array().cast("array<string>").alias("quarantined"))


def transitions(runs: DataFrame, closings: DataFrame) -> DataFrame:
    """run_id, problem of closings that are not allowed: unknown_run, already_finished, closed_twice. A run leaves `running` once."""
    state = runs.select("run_id", F.col("status").alias("_status"))
    asked = closings.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")).join(state, "run_id", "left")
    problem = F.when(F.col("_status").isNull(), "unknown_run").when(F.col("_status") != "running", "already_finished").when(F.col("_n") > 1, "closed_twice")
    return asked.withColumn("problem", problem).where("problem is not null").select("run_id", "problem")


def finished(runs: DataFrame, reports: DataFrame, records: DataFrame, errors: DataFrame) -> DataFrame:
    """The run table after reports (run_id, status, finished_at): counts come from records and errors, and nowhere else.

    records: run_id, outcome, was_read; errors: run_id, kind, endpoint, fatal.  Other runs stay as they are; see transitions() for what is refused.
    """
    counts = records.groupBy("run_id").agg(*[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES], F.count_if("was_read").alias("read"))
    failed = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("errors"), F.array_sort(F.collect_set(F.when(F.col("kind").isin("AuthError", "TransientError"), F.col("endpoint")))).alias("quarantined"))
    told = reports.select("run_id", F.col("status").alias("_to"), F.col("finished_at").alias("_at")).join(counts, "run_id", "left").join(failed, "run_id", "left")
    new = told.columns[3:]
    closed = runs.drop("finished_at", "duration_s", *new).join(told, "run_id", "left")
    open_ = (F.col("status") == "running") & F.col("_to").isNotNull()
    old = runs.select("run_id", F.struct(*[F.col(c) for c in runs.columns if c != "run_id"]).alias("_old"))
    names = [c for c in runs.columns if c not in KEPT]
    zero = {c: F.lit(0).cast("long") for c in new if c != "quarantined"} | {"quarantined": F.array().cast("array<string>")}
    fresh = {"status": F.col("_to"), "finished_at": F.col("_at"), "duration_s": (F.unix_micros("_at") - F.unix_micros("started_at")) / 1e6} | {c: F.coalesce(F.col(c), zero[c]) for c in new}
    both = closed.join(old, "run_id")
    return both.select(*KEPT, *[F.when(open_, fresh[c]).otherwise(F.col(f"_old.{c}")).alias(c) for c in names])


def reaped(runs: DataFrame, now: Column, older_than_s: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, errors): runs left running (for longer than older_than_s, if given) are failed at now, with an error each."""
    stale = F.col("status") == "running"
    if older_than_s is not None:
        stale &= F.unix_micros("started_at") < F.unix_micros(now) - older_than_s * 1_000_000
    errors = runs.where(stale).select("run_id", F.lit("RunReaped").alias("kind"), F.lit(None).cast("string").alias("endpoint"), F.lit(STALE).alias("message"), F.lit(True).alias("fatal"))
    after = runs.withColumns({
        "status": F.when(stale, "failed").otherwise(F.col("status")), "finished_at": F.when(stale, now).otherwise(F.col("finished_at")),
        "errors": F.col("errors") + stale.cast("long"), "duration_s": F.when(~stale, F.col("duration_s")),
    })
    return after, errors


def run_items(records: DataFrame, source_endpoint: Column) -> DataFrame:
    """Reportable records as items: item_id (of the run and key), run_id, native_key, outcome, reason, held_watermark, endpoint (of orphans), unresolved."""
    kept = records.where(reportable(F.col("outcome"), F.col("holds"), F.col("unresolved")))
    item = F.sha2(F.concat_ws("|", "run_id", "native_key"), 256)
    return kept.select(item.alias("item_id"), "run_id", "native_key", "outcome", "reason", F.col("holds").alias("held_watermark"), F.when(F.col("outcome") == "orphaned", source_endpoint).alias("endpoint"), "unresolved")


def item_fields(items: DataFrame) -> DataFrame:
    """item_id, field: a row for each field of an item that the target left out."""
    return items.select("item_id", F.explode("unresolved").alias("field"))


def issue_counts(runs: DataFrame, items: DataFrame, errors: DataFrame) -> DataFrame:
    """run_id, issues_recorded (items and errors), has_issues, swept_stale (closed because its process was gone) for every run."""
    found = items.groupBy("run_id").agg(F.count(F.lit(1)).alias("_items"))
    failed = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("_errors"), F.bool_or(F.col("kind") == "RunReaped").alias("swept_stale"))
    both = runs.select("run_id").join(found, "run_id", "left").join(failed, "run_id", "left")
    n = F.coalesce("_items", F.lit(0)) + F.coalesce("_errors", F.lit(0))
    return both.select("run_id", n.alias("issues_recorded"), (n > 0).alias("has_issues"), F.coalesce("swept_stale", F.lit(False)).alias("swept_stale"))


def filtered(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have the values given; None asks for nothing. Conditions reach the scan."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column).isin(*value) if isinstance(value, list | tuple | set) else F.col(column) == F.lit(value))
    return rows


def proposals_of(proposals: DataFrame, *, status: str | None = None, decision: str | None = None, needs_human: bool = False) -> DataFrame:
    """Proposals by status and decision; needs_human: proposed or ambiguous ones that nobody has decided."""
    out = filtered(proposals, status=status, decision=decision)
    return filtered(out, status=("proposed", "ambiguous"), decision="pending") if needs_human else out


def held(records: DataFrame) -> DataFrame:
    """Every record that holds the position back."""
    return records.where("holds")


def held_by(records: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """by, n_held, held_by: records that hold the position back, how many, and the first `most` of their keys; held() has all."""
    rows = held(records)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("native_key"))
    first = rows.withColumn("_r", rank).where(F.col("_r") <= most).groupBy(*by).agg(F.array_sort(F.collect_list("native_key")).alias("held_by"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_held")).join(first, by)


def exit_code(runs: DataFrame) -> DataFrame:
    """One row, exit_code and worst: an endpoint that couldn't be reached outweighs records that failed; no runs are fine."""
    code = F.when(F.size("quarantined") > 0, EXIT_UNREACHABLE).when(F.col("status").isin("partial", "failed") | (F.col("errors") > 0) | (F.col("n_failed") > 0), EXIT_INCOMPLETE).otherwise(EXIT_OK)
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    return runs.agg(F.coalesce(F.max(code), F.lit(EXIT_OK)).alias("exit_code"), F.coalesce(F.max_by("status", rank), F.lit("ok")).alias("worst"))


def overall_health(components: DataFrame) -> DataFrame:
    """One row, healthy and n_degraded: all components are healthy or degraded; none at all is healthy. components: name, health, reason."""
    return components.agg(F.coalesce(F.bool_and(F.col("health") != "unhealthy"), F.lit(True)).alias("healthy"), F.count_if(F.col("health") == "degraded").alias("n_degraded"))


def health_problems(components: DataFrame) -> DataFrame:
    """name, problem: reports that say something unknown, or are not healthy and don't say why."""
    blank = F.coalesce(strip(F.col("reason")), F.lit("")) == ""
    problem = F.when(~F.coalesce(F.col("health").isin(*HEALTH), F.lit(False)), "unknown_health").when((F.col("health") != "healthy") & blank, "no_reason")
    return components.withColumn("problem", problem).where("problem is not null").select("name", "problem")


def quarantined(components: DataFrame) -> DataFrame:
    """Endpoints that are left out: unhealthy ones; degraded ones go on."""
    return components.where(F.col("health") == "unhealthy").select("name", "reason")


def display_bucket(outcome: Column) -> Column:
    """create, update, no_op or other."""
    return F.when(outcome == "created", "create").when(outcome == "written", "update").when(outcome.isin("unchanged", "no_op"), "no_op").otherwise("other")


def unresolved_kinds(records: DataFrame) -> DataFrame:
    """native_key, kind (dataset_member, owner): a record counts once for each kind, however often a field is named."""
    kinds = F.array_compact(F.array(F.when(F.array_contains("unresolved", "dataset_refs"), "dataset_member"), F.when(F.array_contains("unresolved", "owners"), "owner")))
    return records.select("native_key", F.explode(kinds).alias("kind"))


def plan_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, no_changes (nothing would be created or written), any_failed (of some run no plan could be made)."""
    return runs.groupBy(*by).agg(F.bool_and((F.col("n_created") == 0) & (F.col("n_written") == 0)).alias("no_changes"), F.bool_or(F.col("status") == "failed").alias("any_failed"))


def explanation(decision: Column, decided_by: Column, label: Column, undetermined: Column) -> Column:
    """Why an object is in or out, in one line; label: of the rule or override that decided."""
    verb = F.concat(decision, F.lit("d by "))
    reason = F.when(decided_by == "default", F.concat(verb, F.lit("default (no rule matched)"))).otherwise(F.concat(verb, label))
    n = F.size(undetermined)
    return F.when(n > 0, F.concat(reason, F.lit("; "), n.cast("string"), F.lit(" undetermined: "), F.array_join(undetermined, "; "))).otherwise(reason)
