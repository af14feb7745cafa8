"""Correlating people, and resolving references to datasets and owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order that has no ties: an aggregate, so a frequent key is combined before it is shuffled."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[c if c in key else F.col(f"_first.`{c}`") for c in rows.columns])


def correlate(source: DataFrame, target: DataFrame) -> DataFrame:
    """email, source_party, target_party, role, side (both, source, target): parties (party, email, role, pos) matched by e-mail.

    The first party of an address counts on each side; the source's role wins.  Parties
    without an address match nobody; unmatched() returns them.
    """
    a = first_of(source.where(F.col("email").isNotNull()), ["email"], ["pos"]).select("email", F.col("party").alias("source_party"), F.col("role").alias("ra"))
    b = first_of(target.where(F.col("email").isNotNull()), ["email"], ["pos"]).select("email", F.col("party").alias("target_party"), F.col("role").alias("rb"))
    side = F.when(F.col("source_party").isNull(), "target").when(F.col("target_party").isNull(), "source").otherwise("both")
    return a.join(b, "email", "full_outer").select("email", "source_party", "target_party", F.coalesce("ra", "rb").alias("role"), side.alias("side"))


def unmatched(source: DataFrame, target: DataFrame) -> DataFrame:
    """side, email, party, name, role, label, reason of parties (party, name, email, role, pos) that match nobody on the other side.

    no_match: the first party of an address that the other side lacks.  no_email: parties without
    an address, the first of those equal in name, id and role.  label names a party by the least that tells it: name, else id, else address.
    """
    label = F.coalesce("name", F.col("party").cast("string"), "email", F.lit("<unnamed>"))

    def of(own: DataFrame, other: DataFrame, side: str) -> DataFrame:
        addressed = first_of(own.where(F.col("email").isNotNull()), ["email"], ["pos"]).join(other.where(F.col("email").isNotNull()).select("email"), "email", "left_anti")
        bare = first_of(own.where(F.col("email").isNull()), ["name", "party", "role"], ["pos"])
        columns = [F.lit(side).alias("side"), "email", "party", "name", "role", label.alias("label")]
        return addressed.select(*columns, F.lit("no_match").alias("reason")).unionByName(bare.select(*columns, F.lit("no_email").alias("reason")))

    return of(source, target, "source").unionByName(of(target, source, "target"))


def resolve_datasets(members: DataFrame, bindings: DataFrame, items: DataFrame) -> DataFrame:
    """member, target_id, how (binding, name), status (resolved, not_found, ambiguous) of members (member, name).

    First by binding (member, target_id); else by exact name among items (name, id): one item
    with an id resolves it.
    """
    named = items.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("by_name"))
    out = members.join(bindings.select("member", F.col("target_id").alias("bound")), "member", "left").join(named, "name", "left")
    status = F.when(F.col("bound").isNotNull() | ((F.col("n") == 1) & F.col("by_name").isNotNull()), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("not_found")
    out = out.withColumn("status", status)
    done = F.col("status") == "resolved"
    return out.select("member", F.when(done, F.coalesce("bound", "by_name")).alias("target_id"), F.when(done, F.when(F.col("bound").isNotNull(), "binding").otherwise("name")).alias("how"), "status")


def resolve_owners(owners: DataFrame, users: DataFrame) -> DataFrame:
    """Owners (pos, email, role) with user_id and status (resolved, not_found, ambiguous, no_email) by distinct users of an address."""
    ids = users.groupBy("email").agg(F.min("user_id").alias("_least"), F.max("user_id").alias("_most"))
    out = owners.join(ids, "email", "left")
    several = F.col("_least") < F.col("_most")
    status = F.when(F.col("email").isNull(), "no_email").when(F.col("_least").isNull(), "not_found").when(several, "ambiguous").otherwise("resolved")
    return out.withColumn("status", status).withColumn("user_id", F.when(F.col("status") == "resolved", F.col("_least"))).drop("_least", "_most")


def best_role(entries: DataFrame, user: str, role: str, pos: str, priority: list[str]) -> DataFrame:
    """user, role, first_pos: each user's role of highest priority, the earliest of equals."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(role)), F.lit(0)), F.lit(len(priority) + 1))
    return entries.groupBy(user).agg(F.min_by(role, F.struct(rank, F.col(pos))).alias("role"), F.min(pos).alias("first_pos"))


def all_or_nothing(refs: DataFrame, bindings: DataFrame, by: str, most: int = 100) -> DataFrame:
    """by, all_bound, refs (the first `most` distinct bound ids in order, null if any reference isn't bound), n_bound (distinct), n_refs; refs: by, ref; bindings: ref, bound.

    Ids are ranked and cut in tasks before lists are made, so no list grows with its key.
    """
    pairs = refs.join(bindings, "ref", "left").groupBy(by, "bound").agg(F.count(F.lit(1)).alias("n"))  # both branches take it from one exchange
    out = pairs.groupBy(by).agg(F.bool_and(F.col("bound").isNotNull()).alias("all_bound"), F.count("bound").alias("n_bound"), F.sum("n").alias("n_refs"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("bound"))
    first = pairs.where(F.col("bound").isNotNull()).select(by, "bound").withColumn("_r", rank).where(F.col("_r") <= most).groupBy(by).agg(F.array_sort(F.collect_list("bound")).alias("ids"))
    return out.join(first, by, "left").select(by, "all_bound", F.when(F.col("all_bound"), F.col("ids")).alias("refs"), "n_bound", "n_refs")


def capped(ids, most: int = 100):
    """The first `most` ids, and how many are left out."""
    return F.slice(ids, 1, most), F.greatest(F.size(ids) - most, F.lit(0))
