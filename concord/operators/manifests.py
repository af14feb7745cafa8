"""What a connector declares: a table of capabilities, one row a field of an entity type.

Columns: entity_type, supported, field, mode (rw, ro, na), partial_update, path_allowed (null: no
paths declared), normalized (the target keeps a lossy form).  A manifest is configuration of
some dozens of rows; joins leave it to Spark to broadcast it by its size.  What isn't
declared is never writable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "entity_type string, supported boolean, field string, mode string, partial_update boolean, path_allowed boolean, normalized boolean"
#: The field that each kind of matcher needs, and the entity type of each scope of rules; fixed values.
MATCHER_FIELD = {"tag": "tags", "owner": "owners"}
SCOPE_TYPE = {"object": "data_product", "dataset": "dataset"}


def capabilities(fields: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add supports, offered (readable in some form), is_writable, full_replace to (entity_type, field) rows; all false where nothing is declared."""
    types = manifest.groupBy("entity_type").agg(F.bool_or("supported").alias("_supported"))
    declared = manifest.select("entity_type", "field", F.col("mode").alias("_mode"), F.col("partial_update").alias("_partial"))
    known = fields.join(types, "entity_type", "left").join(declared, ["entity_type", "field"], "left")
    fine = lambda c: F.coalesce(F.col("_supported") & c, F.lit(False))
    return known.withColumns({
        "supports": fine(F.lit(True)), "offered": fine(F.col("_mode") != "na"), "is_writable": fine(F.col("_mode") == "rw"),
        "full_replace": fine((F.col("_mode") == "rw") & ~F.col("_partial")),
    }).drop("_supported", "_mode", "_partial")


def supported_or_raise(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """rows as they are; one of an entity type that the manifest doesn't support raises, as its diff would silently be empty."""
    types = manifest.groupBy("entity_type").agg(F.bool_or("supported").alias("_supported"))
    name = F.coalesce("entity_type", F.lit("null"))
    refusal = F.raise_error(F.concat(F.lit("entity type is not supported: "), name)).cast("string")
    checked = F.when(F.coalesce("_supported", F.lit(False)), F.col("entity_type")).otherwise(refusal)
    return rows.join(types, "entity_type", "left").withColumn("entity_type", checked).drop("_supported")


def capability_matrix(manifests: DataFrame) -> DataFrame:
    """One row for each connector and entity type: supported, and its fields as field:mode in order of name; manifests also has connector."""
    line = F.concat_ws(":", "field", F.concat(F.col("mode"), F.when(~F.col("partial_update"), F.lit("!")).otherwise("")))
    # a connector declares some dozens of fields for a type
    rows = manifests.groupBy("connector", "entity_type").agg(F.bool_or("supported").alias("supported"), F.array_sort(F.collect_list(F.struct("field", line.alias("line")))).alias("fields"))
    return rows.withColumn("fields", F.array_join(F.transform("fields", lambda x: x["line"]), ","))


def matcher_availability(wanted: DataFrame, endpoints: DataFrame, manifests: DataFrame) -> DataFrame:
    """Add state (available, unavailable, unknown) to (endpoint, scope, kind) rows of matchers.

    endpoints: endpoint, read (whether its manifest could be read); manifests: also endpoint.
    A glob needs no field; without a manifest nothing is known; what isn't declared, or is na, can't be matched.
    """
    need = F.create_map(*[x for k, v in MATCHER_FIELD.items() for x in (F.lit(k), F.lit(v))])
    kind = F.create_map(*[x for k, v in SCOPE_TYPE.items() for x in (F.lit(k), F.lit(v))])
    rows = wanted.withColumns({"field": F.try_element_at(need, F.col("kind")), "entity_type": F.try_element_at(kind, F.col("scope"))})
    declared = manifests.select("endpoint", "entity_type", "field", (F.col("supported") & (F.col("mode") != "na")).alias("_fits"))
    known = rows.join(endpoints.select("endpoint", "read"), "endpoint", "left").join(declared, ["endpoint", "entity_type", "field"], "left")
    state = F.when(F.col("field").isNull(), "available").when(~F.coalesce("read", F.lit(False)), "unknown").when(F.coalesce("_fits", F.lit(False)), "available").otherwise("unavailable")
    return known.withColumn("state", state).drop("read", "_fits", "field", "entity_type")


def survived(written: DataFrame, read: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Add survived to written values (key, entity_type, field, value): what is read back is equal, or, of a field that the target normalises, not empty."""
    lossy = manifest.select("entity_type", "field", F.coalesce("normalized", F.lit(False)).alias("_lossy"))
    back = read.select(key, "entity_type", "field", F.col("value").alias("_back"))
    both = written.join(back, [key, "entity_type", "field"], "left").join(lossy, ["entity_type", "field"], "left")
    substance = F.col("_back").isNotNull() & ~F.col("_back").isin("", "[]", "{}", "null")
    same = F.when(F.coalesce("_lossy", F.lit(False)), substance).otherwise(F.col("_back").eqNullSafe(F.col("value")))
    return both.withColumn("survived", same).drop("_back", "_lossy")


def writable(mode: Column) -> Column:
    return F.coalesce(mode == "rw", F.lit(False))
