"""Field diffs shaped by what a target accepts, policies that withhold, and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .manifests import supported_or_raise

#: Reasons that hold a position back; fixed values.
HELD = ("no_source_envelopes", "unconfirmed_target_binding", "no_target_binding", "capability_refused", "target_not_found", "conflict_unresolved")


def _on(key: str, *sides: DataFrame) -> list[str]:
    """What identifies a field: key, entity_type where all sides have it, and field."""
    return [key, *(["entity_type"] if all("entity_type" in s.columns for s in sides) else []), "field"]


def changed_fields(source: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Fields of source whose checksum isn't the stored one (missing or null counts as changed): key, entity_type, field, value, checksum, previous, revision if stored has it.

    Objects of two entity types may have the same key, so where both sides have entity_type it belongs to the key.
    A fresh value always has a checksum; one that hasn't raises.
    """
    on = _on(key, source, stored)
    revision = F.col("revision") if "revision" in stored.columns else F.lit(None).cast("string")
    old = stored.select(*on, F.col("value").alias("previous"), F.col("checksum").alias("old"), revision.alias("revision"))
    fresh = F.when(F.col("checksum").isNull(), F.raise_error(F.concat(F.lit("no checksum of fresh field "), "field")).cast("string")).otherwise(F.col("checksum"))
    new = source.select(key, *[c for c in ("entity_type",) if c in source.columns], "field", "value", fresh.alias("checksum"))
    differs = F.col("old").isNull() | ~F.col("checksum").eqNullSafe(F.col("old"))
    return new.join(old, on, "left").where(differs).drop("old")


def field_diff(changed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add action (patch, replace or drop) and reason to changed fields (entity_type, field, ...) by the target's manifest; see manifests.py.

    An entity type that the manifest doesn't support raises.
    """
    m = manifest.select("entity_type", "field", "mode", "partial_update", "path_allowed")
    out = supported_or_raise(changed, manifest).join(m, ["entity_type", "field"], "left")
    reason = F.when(F.col("mode").isNull(), "undeclared").when(F.col("mode") == "ro", "read_only").when(F.col("mode") == "na", "not_applicable")
    reason = reason.when(F.col("path_allowed") == F.lit(False), "no_update_path")
    action = F.when(F.col("reason").isNotNull(), "drop").when(F.col("partial_update"), "patch").otherwise("replace")
    return out.withColumn("reason", reason).withColumn("action", action).drop("mode", "partial_update", "path_allowed")


def diff_summary(diff: DataFrame, key: str, cap: int) -> DataFrame:
    """key, operations, requests (operations / cap, rounded up), exceeds_cap, expected_revision (the only one of changed fields, else null), ambiguous_revision."""
    least, most = F.col("_least"), F.col("_most")
    kept = diff.where("action <> 'drop'").groupBy(key).agg(F.count(F.lit(1)).alias("operations"), F.min("revision").alias("_least"), F.max("revision").alias("_most"))
    ambiguous = F.coalesce(least < most, F.lit(False))
    n = F.col("operations")
    return kept.select(key, n, F.ceil(n / cap).alias("requests"), (n > cap).alias("exceeds_cap"), F.when(least == most, least).alias("expected_revision"), ambiguous.alias("ambiguous_revision"))


def withheld(diff: DataFrame, live: DataFrame, stored: DataFrame, key: str, mode: Column, *, activation_opt_in: bool = False) -> DataFrame:
    """Add withheld (null, activation or manual_edit) to changed fields.

    status stays unless activation is opted in.  Where mode is preserve_local and a value was
    stored, a field whose live checksum isn't the stored one was edited by hand and stays.
    A field that isn't live any more isn't withheld.
    """
    on_live, on_stored = _on(key, diff, live), _on(key, diff, stored)
    now = live.select(*on_live, F.col("checksum").alias("live_sum"))
    then = stored.select(*on_stored, F.col("checksum").alias("stored_sum"))
    why = F.when((F.col("field") == "status") & F.lit(not activation_opt_in), "activation")
    why = why.when((mode == "preserve_local") & F.col("stored_sum").isNotNull() & F.col("live_sum").isNotNull() & ~F.col("live_sum").eqNullSafe(F.col("stored_sum")), "manual_edit")
    return diff.join(now, on_live, "left").join(then, on_stored, "left").withColumn("withheld", why).drop("live_sum", "stored_sum")


def outcome(facts: dict[str, Column], *, create: bool, dry_run: bool) -> Column:
    """A struct of outcome, reason and holds for a record; facts: boolean columns by name, the first that holds decides.

    selected, deleted, bound, has_envelopes, target (none, unconfirmed, confirmed), creatable, has_changes, all_withheld, reply (written, no_op,
    not_found, conflict, refused; null in a dry run).
    """

    def result(name, reason=None):
        return F.struct(F.lit(name).alias("outcome"), F.lit(reason).cast("string").alias("reason"), F.lit(reason in HELD).alias("holds"))

    f = facts
    ladder = (
        F.when(~f["selected"], result("filtered", "not_selected"))
        .when(f["deleted"] & ~f["bound"], result("skipped", "deleted_unknown_object"))
        .when(f["deleted"], result("orphaned"))
        .when(~f["has_envelopes"], result("skipped", "no_source_envelopes"))
        .when(f["target"] == "unconfirmed", result("skipped", "unconfirmed_target_binding"))
    )
    if not create:
        ladder = ladder.when(f["target"] == "none", result("skipped", "no_target_binding"))
    ladder = ladder.when((f["target"] == "none") & ~f["creatable"], result("skipped", "capability_refused")).when(f["target"] == "none", result("created"))
    ladder = ladder.when(~f["has_changes"], result("unchanged")).when(f["all_withheld"], result("skipped", "nothing_to_write"))
    if dry_run:
        return ladder.otherwise(result("written"))
    for reply, reason in (("not_found", "target_not_found"), ("conflict", "conflict_unresolved"), ("refused", "capability_refused")):
        ladder = ladder.when(f["reply"] == reply, result("skipped", reason))
    return ladder.when(f["reply"] == "no_op", result("no_op")).otherwise(result("written"))


OUTCOMES = ("created", "written", "unchanged", "no_op", "skipped", "filtered", "orphaned", "failed")


def outcome_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """A counter for each outcome, writes (created and written), and held, for each group."""
    counts = [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES]
    return records.groupBy(*by).agg(*counts, F.count_if(F.col("outcome").isin("created", "written")).alias("writes"), F.count_if("holds").alias("held"))


def committable(pages: DataFrame, by: list[str], page: str, terminal: str, mark: str) -> DataFrame:
    """by, committable: the mark of the last page such that it and all earlier ones are terminal; null if the first isn't.

    The first page that isn't terminal is an aggregate, so no group is sorted.
    """
    bad = pages.groupBy(*by).agg(F.min(F.when(~F.col(terminal), F.col(page))).alias("bad"))
    fine = pages.join(bad, by).where(F.col("bad").isNull() | (F.col(page) < F.col("bad"))).groupBy(*by).agg(F.max_by(mark, page).alias("committable"))
    return bad.select(*by).join(fine, by, "left")


def last_change(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of several changes of one object only the last is planned: no row but it, with n_changes. An aggregate, so frequent keys are combined first."""
    rest = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"), F.count(F.lit(1)).alias("n_changes"))
    return last.select(*[c if c in key else F.col(f"_last.`{c}`") for c in changes.columns], "n_changes")


def activation(status: Column, *, opt_in: bool, managed_space: Column, supported: Column | None = None) -> Column:
    """activate, or why not: gates in order status, opt-in, managed space, and whether the target can activate at all."""
    gate = F.when(~F.coalesce(F.lower(status) == "active", F.lit(False)), "none").when(F.lit(not opt_in), "not_opted_in").when(managed_space.isNull(), "no_managed_space")
    return (gate if supported is None else gate.when(~F.coalesce(supported, F.lit(False)), "unsupported")).otherwise("activate")
