"""Comparing snapshots: what is new, changed or gone, and values field by field."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import UNORDERED, canonical_json, checksum, faithful_json, json_projections


def snapshot_changes(fresh: DataFrame, before: DataFrame, key: str, sum_col: str = "checksum") -> DataFrame:
    """key, change (upsert or deleted), checksum, was: rows that are new, changed or gone; equal ones are left out.

    One row a key on either side.  A missing checksum before counts as changed.
    """
    a = fresh.select(F.col(key).alias("k"), F.col(sum_col).alias("now"), F.lit(True).alias("here"))
    b = before.select(F.col(key).alias("k"), F.col(sum_col).alias("was"), F.lit(True).alias("there"))
    both = a.join(b, "k", "full_outer")
    change = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull() | F.col("was").isNull() | ~F.col("now").eqNullSafe(F.col("was")), "upsert")
    return both.withColumn("change", change).where("change is not null").select(F.col("k").alias(key), "change", F.col("now").alias("checksum"), "was")


def multiset_digest(item: Column) -> Column:
    """An aggregate: SHA-256 of how many items (texts) there are and of four sums, of halves of two 60-bit pieces of each item's SHA-256.

    Equal multisets have equal digests whatever their order, and partial sums combine, so no list is
    made however many items a group has. The sums fit 64 bits up to 2**33 items.
    """
    h = F.sha2(item, 256)
    pieces = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(2)]
    sums = [F.coalesce(F.sum(half), F.lit(0)).cast("string") for x in pieces for half in (x.bitwiseAND((1 << 30) - 1), F.shiftright(x, 30))]
    return F.sha2(F.concat_ws("|", F.count(item).cast("string"), *sums), 256)


def membership_fingerprint(parents: DataFrame, members: DataFrame, key: str, member: str, payload: Column) -> DataFrame:
    """key, n_members, fingerprint: of the parent's payload and the multiset of its members' ids; parents without members have the digest of none."""
    listed = members.groupBy(key).agg(multiset_digest(F.col(member).cast("string")).alias("ids"), F.count(F.lit(1)).alias("n"))
    joined = parents.select(key, payload.alias("payload")).join(listed, key, "left")
    none = F.sha2(F.lit("0|0|0|0|0"), 256)
    return joined.select(key, F.coalesce("n", F.lit(0)).alias("n_members"), checksum(F.concat_ws("|", "payload", F.coalesce("ids", none))).alias("fingerprint"))


def json_envelopes(entities: DataFrame, key: str, fields: dict[str, Column], **provenance: Column) -> DataFrame:
    """key, field, value (faithful JSON, what is written), canonical, checksum, and provenance columns: a row for each field given as JSON text.

    The order of arrays counts or not by the field's name.  Provenance: source_endpoint, revision, last_modified_at and the like.
    A text without a canonical form raises; json_envelopes_or_faults keeps it to its object.
    """
    parts = F.array(*[
        F.struct(F.lit(name).alias("field"), faithful_json(text).alias("value"), canonical_json(text, sort_arrays=order_free(name)).alias("canonical")) for name, text in fields.items()
    ])
    rows = entities.select(key, *[c.alias(n) for n, c in provenance.items()], F.inline(parts))
    return rows.withColumn("checksum", checksum(F.col("canonical")))


def json_envelopes_or_faults(entities: DataFrame, key: str, fields: dict[str, Column], **provenance: Column) -> DataFrame:
    """json_envelopes, and fault (why a field's text has no canonical form; then it has no value, canonical text or checksum) and object_fault.

    object_fault is the first fault of the object's fields in the given order, as field:fault, on all
    its rows: an object with one is left out of a cycle whole (sound_envelopes), since fields that are merely
    absent would be taken for unchanged.  No shuffle; each text is read once.
    """
    own = [f"_json{i}" for i in range(len(fields))]
    read = entities.select(F.col(key).alias("_key"), *[c.alias(f"_of_{n}") for n, c in provenance.items()], *[json_projections(t, sort_arrays=order_free(n)).alias(c) for c, (n, t) in zip(own, fields.items(), strict=True)])
    faults = [F.when(F.col(f"{c}.fault").isNotNull(), F.concat(F.lit(f"{n}:"), F.col(f"{c}.fault"))) for c, n in zip(own, fields, strict=True)]
    whole = F.coalesce(*faults, F.lit(None)).alias("object_fault")  # a generated column: a filter on it isn't pushed below the generator, where it would read the texts again
    parts = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{c}.faithful").alias("value"), F.col(f"{c}.canonical").alias("canonical"), F.col(f"{c}.fault").alias("fault"), whole) for c, n in zip(own, fields, strict=True)])
    rows = read.select(F.col("_key").alias(key), *[F.col(f"_of_{n}").alias(n) for n in provenance], F.inline(parts))
    return rows.withColumn("checksum", F.when(F.col("fault").isNull(), checksum(F.col("canonical"))))  # null text has a checksum, a fault has none


def sound_envelopes(rows: DataFrame) -> DataFrame:
    """Rows of json_envelopes_or_faults of objects without a fault, as json_envelopes has them."""
    return rows.where(F.col("object_fault").isNull()).drop("fault", "object_fault")


def order_free(field: str) -> bool:
    """Whether a field's arrays are sets; see canonical.ordered for columns."""
    return re.sub(r"(?<!^)(?=[A-Z])", "_", field).lower() in UNORDERED


def envelopes(entities: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """key, field, value, checksum: a row for each field; value: canonical text. One pass, no shuffle."""
    parts = F.array(*[F.struct(F.lit(name).alias("field"), text.alias("value")) for name, text in fields.items()])
    return entities.select(key, F.inline(parts)).withColumn("checksum", checksum(F.col("value")))


def set_fingerprint(items: DataFrame, by: str, line: Column) -> DataFrame:
    """by, n, fingerprint: the multiset digest of the group's lines."""
    return items.groupBy(by).agg(F.count(F.lit(1)).alias("n"), multiset_digest(line).alias("fingerprint"))


def reconcile(have: DataFrame, want: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key, action: added, removed, updated or kept, of two sets of named fingerprints; a null fingerprint in want can't be read and is kept."""
    a, b = have.select(F.col(key).alias("k"), F.col(fingerprint).alias("h"), F.lit(1).alias("in_h")), want.select(F.col(key).alias("k"), F.col(fingerprint).alias("w"), F.lit(1).alias("in_w"))
    action = F.when(F.col("in_h").isNull(), "added").when(F.col("in_w").isNull(), "removed").when(F.col("w").isNotNull() & ~F.col("w").eqNullSafe(F.col("h")), "updated").otherwise("kept")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), action.alias("action"))
