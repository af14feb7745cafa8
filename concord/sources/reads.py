"""Reading snapshots: listings with a cursor, reads of single objects as filters, pages and samples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import glob_matches, literal_catalogs
from ..operators.snapshots import snapshot_changes
from .catalogs import tags_of

CURSOR = "key string, checksum string, tenant_id string, full_name string"


def decoded(cursor: DataFrame | None, spark: SparkSession) -> DataFrame:
    """A cursor's rows (key, checksum, tenant_id, full_name); one that is missing or of other columns counts as empty, so everything is listed anew."""
    names = [f.split()[0] for f in CURSOR.split(", ")]
    if cursor is None or not set(names) <= set(cursor.columns):
        return spark.createDataFrame([], CURSOR)
    return cursor.select(*[F.col(n).cast("string").alias(n) for n in names]).where(F.col("key").isNotNull())


def list_changed(fresh: DataFrame, cursor: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(changes, next cursor) of a whole scan against the last: key, change, checksum, was, tenant_id, full_name.

    A deleted row carries what the cursor knew of it.  A listing is always complete, so the next cursor is the scan itself.
    """
    before = decoded(cursor, fresh.sparkSession)
    now = decoded(fresh, fresh.sparkSession)
    changes = snapshot_changes(now.select("key", "checksum"), before.select("key", "checksum"), "key")
    names = lambda df, p: df.select("key", F.col("tenant_id").alias(f"{p}t"), F.col("full_name").alias(f"{p}f"))
    told = changes.join(names(now, "a"), "key", "left").join(names(before, "b"), "key", "left")
    return told.select("key", "change", "checksum", "was", F.coalesce("at", "bt").alias("tenant_id"), F.coalesce("af", "bf").alias("full_name")), now


def in_order(changes: DataFrame) -> DataFrame:
    """Upserts, then deletions, each by key in order of code points."""
    return changes.orderBy(F.col("change") == "deleted", "key")


def target_listing(objects: DataFrame, space: str, entity_types: Iterable[str]) -> DataFrame:
    """A target's objects (entity_type, placement, ...) of one space; a target has no cursor, so all are listed each time."""
    return objects.where((F.col("placement") == space) & F.col("entity_type").isin(*entity_types))


def matching_schemas(schemas: DataFrame, patterns: list[str]) -> DataFrame:
    """Schemas (catalog_name, schema_name) that any pattern catalog.schema matches, each once; catalogs that are named without wildcards reach the scan."""
    if not patterns:
        return schemas.limit(0)
    named = literal_catalogs(patterns)
    rows = schemas.where(F.col("catalog_name").isin(*named)) if len(named) == len({p.split(".")[0] for p in patterns}) else schemas
    hit = F.lit(False)
    for p in patterns:
        hit |= F.coalesce(glob_matches(F.concat_ws(".", "catalog_name", "schema_name"), p), F.lit(False))
    return rows.where(hit).dropDuplicates(["catalog_name", "schema_name"])


def tags_of_catalogs(spark: SparkSession, rows: DataFrame | None, table: str, catalogs: list[str]) -> DataFrame | None:
    """Tags of several catalogs in one scan; null if there is no table to read (as opposed to no tags)."""
    if rows is None:
        return None
    return tags_of(spark, rows, table, list(dict.fromkeys(catalogs)))


def read_entities(objects: DataFrame, refs: DataFrame, supported: Iterable[str]) -> DataFrame:
    """Add found to references (entity_type, native_key), with the columns of objects; one of a type that isn't supported raises.

    Many reads are one join, and a single one is the same join with one row.
    """
    ok = F.coalesce(F.col("entity_type").isin(*supported), F.lit(False))
    refusal = F.raise_error(F.concat(F.lit("no reads of entity type "), F.coalesce("entity_type", F.lit("null")))).cast("string")
    asked = refs.withColumn("entity_type", F.when(ok, F.col("entity_type")).otherwise(refusal))
    there = objects.withColumn("found", F.lit(True))
    return asked.join(there, ["entity_type", "native_key"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def product_members(schemas: DataFrame, tables: DataFrame, refs: DataFrame, patterns: list[str]) -> DataFrame:
    """full_name, table_id: every table of the referred schemas that lie in the patterns' scope, a row each."""
    scope = matching_schemas(schemas, patterns).select(F.concat_ws(".", "catalog_name", "schema_name").alias("full_name"))
    asked = refs.select("full_name").distinct().join(scope, "full_name", "left_semi")
    return tables.select(F.concat_ws(".", "catalog_name", "schema_name").alias("full_name"), "table_id").join(asked, "full_name", "left_semi")


def read_products(schemas: DataFrame, tables: DataFrame, refs: DataFrame, patterns: list[str], listed: int = 20, most: int | None = None) -> DataFrame:
    """Data products of referred schemas (full_name): found, n_datasets, and the first `listed` of their tables' ids in order; product_members() has all as rows.

    Schemas out of the patterns' scope aren't found.  A product of over `most` tables raises: nothing is cut off.
    """
    scope = matching_schemas(schemas, patterns).withColumn("full_name", F.concat_ws(".", "catalog_name", "schema_name")).select("full_name", F.lit(True).alias("found"))
    asked = refs.join(scope, "full_name", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    own = tables.select(F.concat_ws(".", "catalog_name", "schema_name").alias("full_name"), "table_id").join(asked.where("found").select("full_name"), "full_name", "left_semi")
    # the limit is taken in tasks before rows are shuffled (a window's group limit), so lists stay short
    rank = F.row_number().over(Window.partitionBy("full_name").orderBy("table_id"))
    first = own.withColumn("_r", rank).where(F.col("_r") <= listed).groupBy("full_name").agg(F.array_sort(F.collect_list("table_id")).alias("datasets"))
    n = F.count(F.lit(1))
    if most is not None:
        n = F.when(n > most, F.raise_error(F.lit(f"a product of over {most} datasets")).cast("long")).otherwise(n)
    counted = own.groupBy("full_name").agg(n.alias("n_datasets")).join(first, "full_name")
    out = asked.join(counted, "full_name", "left")
    return out.withColumns({"n_datasets": F.coalesce("n_datasets", F.lit(0)), "datasets": F.when(F.col("found"), F.coalesce("datasets", F.array().cast("array<string>")))})


def all_entities(changes: DataFrame, objects: DataFrame) -> DataFrame:
    """Every object that a listing from the start names and that can be read: no deletions, and nothing that is gone by now."""
    return changes.where(F.col("change") != "deleted").select(F.col("key").alias("native_key")).join(objects, "native_key")


def binding_of(bindings: DataFrame, *, endpoint: str, entity_type: str, tenant_id: str, native_key: str) -> DataFrame:
    """The binding of one native key, or no row."""
    return bindings.where((F.col("endpoint") == endpoint) & (F.col("entity_type") == entity_type) & (F.col("tenant_id") == tenant_id) & (F.col("native_key") == native_key))


def bindings_of(bindings: DataFrame, *, endpoint: str | None = None, entity_type: str | None = None, tenant_id: str | None = None, confirmed_only: bool = False) -> DataFrame:
    """Bindings by any of these, in order of endpoint, entity type, tenant and native key."""
    for name, value in (("endpoint", endpoint), ("entity_type", entity_type), ("tenant_id", tenant_id)):
        if value is not None:
            bindings = bindings.where(F.col(name) == value)
    return (bindings.where("confirmed") if confirmed_only else bindings).orderBy("endpoint", "entity_type", "tenant_id", "native_key")


def examined(candidates: DataFrame, order: list[str], most: int) -> tuple[DataFrame, bool]:
    """(the first `most` candidates in order, whether that cut any off): a preview looks at no more. Whether there are more takes any `most` + 1 rows, in no order."""
    return candidates.orderBy(*order).limit(most), candidates.limit(most + 1).count() > most


def all_nodes(schemas: DataFrame, datasets: DataFrame) -> DataFrame:
    """A source's tree as one table: schemas first, then datasets (level 0, 1)."""
    return schemas.withColumn("level", F.lit(0)).unionByName(datasets.withColumn("level", F.lit(1)), allowMissingColumns=True)
