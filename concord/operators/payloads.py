"""What a run would send to a target, and what it keeps of the reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .spread import dealt, parts

#: Where a field goes in a target's document; fixed values.
PATHS = {"name": "/name", "description": "/description", "documentation": "/readMe", "tags": "/tags", "dataset_refs": "/datasetIds", "owners": "/keyContacts"}
TEXTS = ("name", "description", "documentation")
MAX_REFS = 100


def filled(text: Column) -> Column:
    """text, or null if it is blank."""
    return F.when(strip(text) != "", text)


def listed_members(members: DataFrame, key: str = "key") -> DataFrame:
    """key, refs and consumable (lists for create_bodies) and n_refs, n_resolved, n_distinct, n_consumable (counts of all), of each product that has members.

    members: key, ref (resolved id, null if there is none), consumable (boolean; null: nothing is said, which is not consumable).
    Of a product's distinct ids, in order, the first MAX_REFS + 1 are listed; ids are ranked and cut in tasks before lists are made, so no list grows with its product.
    """
    said = F.coalesce("consumable", F.lit(False))
    ids = members.groupBy(key, "ref").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(said).alias("_fit"), F.count_if(said).alias("_said"))
    counts = ids.groupBy(key).agg(
        F.sum("_n").alias("n_refs"), F.coalesce(F.sum(F.when(F.col("ref").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_resolved"), F.count("ref").alias("n_distinct"), F.sum("_said").alias("n_consumable")
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy("ref"))
    first = ids.where(F.col("ref").isNotNull()).select(key, "ref", "_fit").withColumn("_r", rank).where(F.col("_r") <= MAX_REFS + 1)
    first = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", F.col("ref").cast("string").alias("ref"), "_fit"))).alias("_ids"))
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(F.transform(c, lambda x: x["ref"]), none)
    first = first.withColumnRenamed(key, "_key")
    return counts.join(first, counts[key].eqNullSafe(first["_key"]), "left").select(key, text("_ids").alias("refs"), text(F.filter("_ids", lambda x: x["_fit"])).alias("consumable"), "n_refs", "n_resolved", "n_distinct", "n_consumable")


def create_bodies(products: DataFrame, space: str, key: str = "key") -> DataFrame:
    """key, body (JSON), written (fields, sorted), skipped (field: why) for products that are to be created.

    products: name, description, documentation, tags (array of texts), refs (array of resolved ids), n_refs
    (members named), consumable (ids, null if nothing is said), contacts (array of struct), n_owners, placement.
    Optional keys are left out rather than sent empty.  At most MAX_REFS distinct references are sent, and
    of the consumable ones only those that are sent.  Where lists are cut already (see listed_members), n_resolved,
    n_distinct and n_consumable say how many there are; without these columns the lists are taken to be whole.
    """
    refs = F.array_distinct("refs")
    told_of = lambda name, c: F.coalesce(name, c) if name in products.columns else c
    sent = F.slice(refs, 1, MAX_REFS)
    consumable = F.filter(F.array_distinct("consumable"), lambda x: F.array_contains(sent, x))
    some = lambda c: F.when(F.size(c) > 0, c)
    parts = {
        "name": F.col("name"), "spaceId": F.lit(space), "description": filled(F.col("description")), "readMe": filled(F.col("documentation")), "tags": some(F.col("tags")),
        "datasetIds": some(sent), "apiConsumableDatasetIds": some(consumable), "keyContacts": some(F.col("contacts")),
    }
    told = {"name": F.lit(True), "description": parts["description"].isNotNull(), "documentation": parts["readMe"].isNotNull(), "tags": F.size("tags") > 0, "dataset_refs": F.size(sent) > 0, "owners": F.size("contacts") > 0, "placement": F.col("placement") == space}
    fewer = lambda n, field, why: F.when(n > 0, F.concat(F.lit(f"{field}: "), n.cast("string"), F.lit(f" {why}")))
    skipped = F.array_compact(F.array(
        fewer(F.col("n_refs") - told_of("n_resolved", F.size("refs")), "dataset_refs", "not resolved"), fewer(told_of("n_distinct", F.size(refs)) - MAX_REFS, "dataset_refs", "beyond the cap"),
        fewer(F.when(F.col("consumable").isNotNull(), told_of("n_consumable", F.size("consumable"))) - F.size(consumable), "dataset_refs", "consumable but not sent"), fewer(F.col("n_owners") - F.size("contacts"), "owners", "not matched"),
        F.when(F.col("placement") != space, F.lit("placement: ignored")),
    ))
    return products.select(
        key, F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])).alias("body"),
        F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in told.items()]))).alias("written"), skipped.alias("skipped"),
    )


def json_text(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.when(text.isNull(), "null").otherwise(F.substr(listed, F.lit(2), F.length(listed) - 2))


def operations(writes: DataFrame, key: str = "key") -> DataFrame:
    """key, field, path, value (JSON text) for fields to write; a list that came to nothing though something was asked for is left out.

    writes: key, field, value (texts as they are, lists as JSON), and n_asked where lists were resolved.  Each is a full replace.
    A field that has no path raises.
    """
    paths = F.create_map(*[x for f, p in PATHS.items() for x in (F.lit(f), F.lit(p))])
    path = F.coalesce(F.try_element_at(paths, F.col("field")), F.raise_error(F.concat(F.lit("no path for field "), F.col("field"))).cast("string"))
    asked = F.col("n_asked") if "n_asked" in writes.columns else F.lit(0)
    value = F.when(F.col("field").isin(*TEXTS), json_text(F.col("value"))).otherwise(F.coalesce("value", F.lit("null")))
    kept = writes.where(F.col("field").isin(*TEXTS) | ~((F.coalesce(asked, F.lit(0)) > 0) & F.coalesce(F.col("value"), F.lit("[]")).isin("[]")))
    return kept.select(key, "field", path.alias("path"), value.alias("value"))


def still_needed(ops: DataFrame, current: DataFrame, key: str = "key") -> DataFrame:
    """Operations that the target's document doesn't provably carry already: current has key, path, value (JSON text); only equal text counts."""
    held = current.select(key, "path", "value")
    return ops.join(held, [key, "path", "value"], "left_anti")


def patches(ops: DataFrame, revisions: DataFrame, key: str = "key") -> DataFrame:
    """key, patch (JSON, operations in order of path), n_operations, if_match; an object has at most as many operations as there are paths."""
    line = F.concat(F.lit('{"op":"replace","path":"'), F.col("path"), F.lit('","value":'), F.col("value"), F.lit("}"))
    listed = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    made = ops.groupBy(key).agg(listed.alias("lines"), F.count(F.lit(1)).alias("n_operations"))
    text = F.concat(F.lit("["), F.array_join(F.transform("lines", lambda x: x["line"]), ","), F.lit("]"))
    return made.join(revisions.select(key, "if_match"), key, "left").select(key, text.alias("patch"), "n_operations", "if_match")


def persisted(diff: DataFrame, replies: DataFrame, key: str = "key") -> DataFrame:
    """Envelopes to keep after a run: key, field, value, checksum, revision (the target's), last_synced_at.

    replies: key, outcome (written, created, no_op, or anything else), written_fields, revision, at.  A target that
    says no_op holds the whole diff; one that wrote holds what it names, or the whole diff if it names nothing; any other keeps nothing.
    """
    named = F.coalesce(F.size("written_fields"), F.lit(0)) > 0
    all_ = (F.col("outcome") == "no_op") | (F.col("outcome").isin("written", "created") & ~named)
    told = replies.select(key, "outcome", "written_fields", F.col("revision").alias("_revision"), "at")
    kept = diff.join(told, key).where(all_ | (F.col("outcome").isin("written", "created") & F.array_contains("written_fields", F.col("field"))))
    return kept.select(key, "field", "value", "checksum", F.col("_revision").alias("revision"), F.col("at").alias("last_synced_at"))


def last_synced(envelopes: DataFrame, by: list[str]) -> DataFrame:
    """by, last_synced_at: the latest of an object's fields; null if none was ever synced."""
    return envelopes.groupBy(*by).agg(F.max("last_synced_at").alias("last_synced_at"))


def after_conflict(sent: DataFrame, live: DataFrame, revisions: DataFrame, key: list[str], *, n: int = 0) -> DataFrame:
    """Add action and revision to fields that were sent (key, field, value, checksum) and met a conflict.

    live: the target as read again (key, field, checksum); revisions: its new revision (key, revision).
    already: the target holds the value by now; resend: it doesn't, and goes again, guarded by the new revision;
    unguarded: there is no revision to guard it with, so the conflict stays.  No field is added, and which side is right isn't decided here.
    There are n partitions, by default as many as the largest input's number of rows asks for.
    """
    n = n or parts(sent, live, revisions)
    on = [*key, "field"]
    now = live.select(*on, F.col("checksum").alias("_live"))
    out = dealt(sent, n, on).join(dealt(now, n, on), on, "left")
    out = dealt(out, n, key).join(dealt(revisions.select(*key, "revision"), n, key), key, "left")
    action = F.when(F.col("revision").isNull(), "unguarded").when(F.col("_live").eqNullSafe(F.col("checksum")), "already").otherwise("resend")
    return out.withColumn("action", action).drop("_live")


def recovered(replies: DataFrame, fields: DataFrame, retried: DataFrame, key: list[str]) -> DataFrame:
    """key, outcome, revision, n_resent, n_already of every object that was sent: one recovery, never a second.

    replies: key, reply; fields: after_conflict() of those that met a conflict; retried: the reply
    to what went again (key, reply).  An object all of whose fields are there by now is a no-op under
    its new revision; without a revision, or after another conflict, it is conflict_unresolved.
    """
    per = fields.groupBy(*key).agg(F.max("revision").alias("revision"), F.count_if(F.col("action") == "resend").alias("n_resent"), F.count_if(F.col("action") == "already").alias("n_already"))
    out = replies.join(per, key, "left").join(retried.select(*key, F.col("reply").alias("_again")), key, "left").na.fill({"n_resent": 0, "n_already": 0})
    met = F.col("reply") == "conflict"
    solved = F.when(F.col("revision").isNull(), "conflict_unresolved").when(F.col("n_resent") == 0, "no_op").when(F.coalesce(F.col("_again"), F.lit("conflict")) == "conflict", "conflict_unresolved").otherwise(F.col("_again"))
    return out.select(*key, F.when(met, solved).otherwise(F.col("reply")).alias("outcome"), "revision", "n_resent", "n_already")
