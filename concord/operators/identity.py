"""Matching objects of two catalogs by identity or natural key, with ambiguity reported instead of guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

KEY = ("endpoint", "entity_type", "tenant_id", "native_key")


def resolve(objects: DataFrame, bindings: DataFrame) -> DataFrame:
    """Add neutral_id (null: unbound) by endpoint, entity type, tenant and native key; names never count."""
    return objects.join(bindings.select(*KEY, "neutral_id"), list(KEY), "left")


def counterpart(objects: DataFrame, bindings: DataFrame, endpoint: str) -> DataFrame:
    """Add target_key and target (none, unconfirmed, confirmed) at an endpoint; an unconfirmed key isn't given."""
    b = bindings.where(F.col("endpoint") == endpoint).select("neutral_id", "entity_type", F.col("native_key").alias("_key"), "confirmed")
    out = objects.join(b, ["neutral_id", "entity_type"], "left")
    state = F.when(F.col("_key").isNull(), "none").when(F.col("confirmed"), "confirmed").otherwise("unconfirmed")
    return out.withColumn("target", state).withColumn("target_key", F.when(F.col("target") == "confirmed", F.col("_key"))).drop("_key", "confirmed")


def propose(source: DataFrame, target: DataFrame, bound: DataFrame, name: str, by: list[str], most: int = 20) -> DataFrame:
    """source_id, status (bound, proposed, ambiguous, unmatched), candidates (the `most` least target ids in order), n_candidates (all of them).

    source, target: id, the normal name, and further key columns `by` (parent path, entity type);
    bound: source_id, target_id.  Bound targets are no candidates; an empty name matches nothing.
    Candidates are grouped before the join, so a name that many have costs one row on each side, and
    cut to what a person can look at before they are listed; candidates() has every one as a row.
    """
    free = target.join(bound.select(F.col("target_id").alias("id")), "id", "left_anti").where(F.col(name) != "")
    rank = F.row_number().over(Window.partitionBy(name, *by).orderBy("id"))
    listed = free.withColumn("_r", rank).where(F.col("_r") <= most).groupBy(name, *by).agg(F.array_sort(F.collect_list("id")).alias("candidates"))
    grouped = free.groupBy(name, *by).agg(F.count(F.lit(1)).cast("int").alias("_n")).join(listed, [name, *by])
    s = source.withColumnRenamed("id", "source_id").join(bound.select("source_id", F.lit(True).alias("_bound")).distinct(), "source_id", "left").join(grouped, [name, *by], "left")
    n = F.when(F.col("_bound"), 0).otherwise(F.coalesce("_n", F.lit(0)))
    status = F.when(F.col("_bound"), "bound").when(F.col("n") == 0, "unmatched").when(F.col("n") == 1, "proposed").otherwise("ambiguous")
    return s.withColumn("n", n).select("source_id", status.alias("status"), F.when(F.col("n") > 0, F.col("candidates")).alias("candidates"), F.col("n").alias("n_candidates"))


def candidates(source: DataFrame, target: DataFrame, bound: DataFrame, name: str, by: list[str]) -> DataFrame:
    """source_id, target_id: every candidate of every source that isn't bound, whatever their number; what propose() lists the first of, and what chosen() checks."""
    free = target.join(bound.select(F.col("target_id").alias("id")), "id", "left_anti").where(F.col(name) != "").withColumnRenamed("id", "target_id")
    open_ = source.withColumnRenamed("id", "source_id").join(bound.select("source_id"), "source_id", "left_anti")
    return open_.select("source_id", name, *by).join(free.select("target_id", name, *by), [name, *by]).select("source_id", "target_id")


def chosen(choices: DataFrame, source: DataFrame, target: DataFrame, bound: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Add is_candidate to choices (source_id, target_id): whether the target is one of all candidates of the source. Only the chosen pairs are looked up, so no group is listed for it."""
    ids = lambda df, c: df.withColumnRenamed("id", c)
    free = ids(target, "target_id").join(bound.select("target_id"), "target_id", "left_anti").select("target_id", F.col(name).alias("_n"), F.struct(*by).alias("_b"))
    open_ = ids(source, "source_id").join(bound.select("source_id"), "source_id", "left_anti").select("source_id", F.col(name).alias("_m"), F.struct(*by).alias("_c"))
    both = choices.join(open_, "source_id", "left").join(free, "target_id", "left")
    fits = (F.col("_n") == F.col("_m")) & (F.col("_n") != "") & (F.col("_b") == F.col("_c"))
    return both.select(*choices.columns, F.coalesce(fits, F.lit(False)).alias("is_candidate"))


def merge_review(fresh: DataFrame, reviewed: DataFrame) -> DataFrame:
    """proposal_id, fingerprint, decision, superseded: a decision lasts if the candidates are the same or it was applied; else it is pending again, and kept as superseded.

    fresh: proposal_id, fingerprint; reviewed: also decision, applied.  Proposals that are no longer made stay only if applied.
    """
    old = reviewed.select("proposal_id", F.col("fingerprint").alias("was"), "decision", "applied")
    both = fresh.join(old, "proposal_id", "full_outer").where(F.col("fingerprint").isNotNull() | F.col("applied"))
    stays = F.col("applied") | F.col("fingerprint").eqNullSafe(F.col("was"))
    stays = F.coalesce(stays, F.lit(False))
    return both.select(
        "proposal_id",
        F.coalesce("fingerprint", "was").alias("fingerprint"),
        F.when(stays, F.col("decision")).otherwise("pending").alias("decision"),
        F.when(~stays & (F.col("decision") != "pending"), F.col("decision")).alias("superseded"),
    )


def bound_after(bindings: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(bindings, refused) after new ones (KEY, neutral_id, confirmed), of which one row for an object and endpoint counts.

    A native key that another object holds, before or among the new ones, is refused.  A
    binding of the same object and endpoint moves to its new key; confirmed_at is set once and stays.
    """
    rest = ("endpoint", "entity_type", "neutral_id")
    held = bindings.select(*KEY, F.col("neutral_id").alias("_holder"))
    claims = new.groupBy(*KEY).agg(F.min("neutral_id").alias("_first"), F.max("neutral_id").alias("_last"))
    asked = new.join(held, list(KEY), "left").join(claims, list(KEY))
    refused = (F.col("_holder").isNotNull() & (F.col("_holder") != F.col("neutral_id"))) | (F.col("_first") < F.col("_last"))
    fine = asked.where(~refused).groupBy(*rest).agg(F.max(F.struct("tenant_id", "native_key", "confirmed")).alias("_new"))
    both = bindings.select(*rest, F.struct("tenant_id", "native_key", "confirmed_at").alias("_old")).join(fine, list(rest), "full_outer")
    after = both.select(
        *rest, *[F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")).alias(c) for c in ("tenant_id", "native_key")],
        F.coalesce("_old.confirmed_at", F.when(F.col("_new.confirmed"), now)).alias("confirmed_at"),
    )
    return after, asked.where(refused).select(*KEY, "neutral_id")


def confirmed_after(bindings: DataFrame, refs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(bindings, unknown): confirmed_at set for refs (neutral_id, endpoint, entity_type) where it was not; refs without a binding are told."""
    on = ["neutral_id", "endpoint", "entity_type"]
    asked = refs.select(*on).distinct()
    after = bindings.join(asked.withColumn("_asked", F.lit(True)), on, "left")
    at = F.coalesce("confirmed_at", F.when(F.col("_asked"), now))
    return after.withColumn("confirmed_at", at).drop("_asked"), asked.join(bindings, on, "left_anti")


def confirm(decisions: DataFrame, bindings: DataFrame, *, order: str = "neutral_id") -> DataFrame:
    """Add result to decisions (neutral_id, target_key, status, chosen), which are taken one after the other by `order`: bound, already_bound, conflict, needs_choice.

    bindings: neutral_id, native_key of the target endpoint.  An ambiguous proposal needs a
    chosen candidate.  A target is given once: a decision that finds its object or its target bound, before
    or by an earlier decision, is already_bound if both are the same, else a conflict.

    What is bound before is one join.  Others go in rounds: of those that are left, each that is the first
    for its object and for its target binds, and decides all others of that object or
    target.  That gives what one after the other gives; a round decides all but chains of decisions
    each of which waits for the one before, so most batches take two.
    """
    key = F.coalesce("chosen", F.when(F.col("status") == "proposed", F.col("target_key")))
    own = bindings.select("neutral_id", F.col("native_key").alias("_own"))
    held = bindings.select(F.col("native_key").alias("_key"), F.col("neutral_id").alias("_holder"))
    out = decisions.withColumn("_key", key).join(own, "neutral_id", "left").join(held, "_key", "left")
    result = (
        F.when(F.col("_key").isNull(), "needs_choice")
        .when(F.col("_own").eqNullSafe(F.col("_key")), "already_bound")
        .when(F.col("_own").isNotNull() | F.col("_holder").isNotNull(), "conflict")
    )
    columns = decisions.columns
    state = checkpointed(out.select(F.struct(*columns).alias("row"), F.col("neutral_id").alias("n"), F.col("_key").alias("k"), F.struct(order, "neutral_id", "_key").alias("o"), result.alias("result")))
    done = state.where(F.col("result").isNotNull())
    left = state.where(F.col("result").isNull())
    while not left.isEmpty():
        first = lambda c: left.groupBy(c).agg(F.min("o").alias(f"_{c}"))  # noqa: B023, E731
        asked = left.join(first("n"), "n").join(first("k"), "k")
        wins = (F.col("o") == F.col("_n")) & (F.col("o") == F.col("_k"))
        won = asked.where(wins).select("n", "k").distinct()
        # a decision that was made twice binds once
        again = F.row_number().over(Window.partitionBy("n", "k").orderBy(F.xxhash64("row"))) > 1
        bound = asked.where(wins).withColumn("result", F.when(again, "already_bound").otherwise("bound"))
        rest = asked.where(~wins).join(won.select("n", F.col("k").alias("_nk")), "n", "left").join(won.select("k", F.col("n").alias("_kn")), "k", "left")
        rest = rest.withColumn("result", F.when(F.col("_nk") == F.col("k"), "already_bound").when(F.col("_nk").isNotNull() | F.col("_kn").isNotNull(), "conflict"))
        now = checkpointed(bound.select(*state.columns).unionAll(rest.select(*state.columns)))
        done = done.unionAll(now.where(F.col("result").isNotNull()))
        left = now.where(F.col("result").isNull())
    return done.select("row.*", "result")


def neutral_id(endpoint: Column, entity_type: Column, tenant: Column, native_key: Column) -> Column:
    """A neutral id made from the identity itself, so a repeated task or a replay mints the same."""
    h = F.sha2(F.concat_ws("\x1f", endpoint, entity_type, tenant, native_key), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
