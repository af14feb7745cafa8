"""One reconciliation cycle as one lazy plan: select, resolve, diff, withhold, decide."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diffs import changed_fields, field_diff, outcome, withheld


@dataclass(frozen=True)
class Options:
    create: bool = False
    dry_run: bool = True
    activation_opt_in: bool = False
    preserve: tuple[str, ...] = ()  # fields whose edits by hand stay
    policies: tuple[Callable[[DataFrame], DataFrame], ...] = ()  # each may set withheld where it is still null


def plan_cycle(changes: DataFrame, source: DataFrame, stored: DataFrame, live: DataFrame, manifest: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(records, writes): an outcome for each changed object, and the fields to write.

    changes: key, entity_type, selected, deleted, bound, target, and reply in a run; source, stored, live:
    envelopes (key, entity_type, field, value, checksum).  A target can create what it can write some
    field of.  A policy gets the diff with its column withheld.  A dry run is an action on this plan; a run is the same plan and a sink.
    """
    mode = F.when(F.col("field").isin(*options.preserve), "preserve_local").otherwise("source_wins") if options.preserve else F.lit("source_wins")
    diff = field_diff(changed_fields(source, stored, "key"), manifest)
    diff = withheld(diff, live, stored, "key", mode, activation_opt_in=options.activation_opt_in)
    for policy in options.policies:
        diff = policy(diff)
    kept = F.col("action") != "drop"
    per = diff.groupBy("key", "entity_type").agg(F.count_if(kept).alias("n_changes"), F.count_if(kept & F.col("withheld").isNull()).alias("n_writes"), F.array_sort(F.collect_set(F.when(F.col("reason").isNotNull(), F.concat_ws(":", "field", "reason")))).alias("dropped"))
    has = source.select("key", "entity_type").distinct().withColumn("has_envelopes", F.lit(True))
    can = manifest.groupBy("entity_type").agg(F.bool_or(F.col("supported") & (F.col("mode") == "rw")).alias("creatable"))
    joined = changes.join(per, ["key", "entity_type"], "left").join(has, ["key", "entity_type"], "left").join(can, "entity_type", "left")
    joined = joined.na.fill({"n_changes": 0, "n_writes": 0, "has_envelopes": False, "creatable": False})
    reply = F.col("reply") if "reply" in changes.columns else F.lit("written")
    facts = {
        "selected": F.col("selected"), "deleted": F.col("deleted"), "bound": F.col("bound"), "has_envelopes": F.col("has_envelopes"), "target": F.col("target"), "creatable": F.col("creatable"),
        "has_changes": F.col("n_changes") > 0, "all_withheld": F.col("n_writes") == 0, "reply": reply,
    }
    records = joined.withColumn("_o", outcome(facts, create=options.create, dry_run=options.dry_run)).select("key", "entity_type", "_o.*", (F.col("selected") & ~F.col("deleted")).alias("was_read"), "n_changes", "n_writes", "dropped")
    writes = diff.where(kept & F.col("withheld").isNull()).join(records.where(F.col("outcome").isin("written", "created")).select("key", "entity_type"), ["key", "entity_type"], "left_semi")
    return records, writes.select("key", "entity_type", "field", "action", "value", "previous", "checksum", "revision")
