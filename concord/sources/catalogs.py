"""Source and target catalog exports as neutral entities.

Exports are tables of JSON documents or columns with nested types.  A missing key
(silent: leave alone) and an explicit null (empty: clear) stay apart as SQL null and
variant null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import asset_type, owner_party, party_role, strip
from ..operators.identity import neutral_id

#: Keys of a raw schema or table that have fields of their own; fixed values.
MAPPED = ("catalog_name", "schema_name", "name", "full_name", "comment", "owner", "schema_id", "table_id", "metastore_id", "table_type", "columns")


def key_state(document: Column, key: str) -> Column:
    """absent, null, empty or value, of a key of JSON text."""
    v = F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant")
    text = F.try_variant_get(F.try_parse_json(document), f"$.{key}", "string")
    return F.when(v.isNull(), "absent").when(F.is_variant_null(v), "null").when(strip(text) == "", "empty").otherwise("value")


def tags_of(spark: SparkSession, rows: DataFrame, table: str, catalog: str | list[str], schemas: list[str] | None = None) -> DataFrame:
    """Tags of one or several catalogs' schemas or tables, in one scan: full_name, tags in order of name and value.

    rows: an information-schema table.  Identifiers are checked, values are bound.  An object has at most a few dozen tags.
    """
    names = [catalog] if isinstance(catalog, str) else catalog
    for c in names:
        if not c.replace("_", "").isalnum() or not c.isascii():
            raise ValueError(f"{c!r} is no identifier")
    parts = "catalog_name, schema_name" + ", table_name" * (table == "table_tags")
    args = {f"c{i}": c for i, c in enumerate(names)} | {f"s{i}": s for i, s in enumerate(schemas or [])}
    one_of = lambda column, p, n: f"{column} IN ({', '.join(f':{p}{i}' for i in range(n))})" if n else "false"
    where = one_of("catalog_name", "c", len(names)) + (" AND " + one_of("schema_name", "s", len(schemas)) if schemas is not None else "")
    found = spark.sql(f"SELECT DISTINCT concat_ws('.', {parts}) AS full_name, tag_name, tag_value FROM {{rows}} WHERE {where}", args=args, rows=rows)
    tag = F.struct(F.col("tag_name").alias("key"), F.col("tag_value").alias("value"))
    return found.groupBy("full_name").agg(F.array_sort(F.collect_list(tag)).alias("tags"))


def with_tags(objects: DataFrame, tags: DataFrame | None) -> DataFrame:
    """Add tags: an empty list where there are none, null where tags can't be read at all."""
    kind = "array<struct<key:string,value:string>>"
    if tags is None:
        return objects.withColumn("tags", F.lit(None).cast(kind))
    return objects.join(tags, "full_name", "left").withColumn("tags", F.coalesce("tags", F.array().cast(kind)))


def datasets(raw: DataFrame, endpoint: str, tags: DataFrame | None) -> DataFrame:
    """Neutral datasets from raw tables: identity, text fields, owners, tags, classifications (tag keys), asset type, and all other properties."""
    t = with_tags(raw, tags)
    owner = owner_party(F.col("owner"))
    return t.select(
        F.lit(endpoint).alias("endpoint"), F.lit("dataset").alias("entity_type"), F.col("table_id").alias("native_key"), F.col("metastore_id").alias("tenant_id"), "full_name", "name",
        F.nullif(strip(F.col("comment")), F.lit("")).alias("description"), F.when(owner.isNotNull(), F.array(owner)).otherwise(F.array().cast("array<struct<party_id:string,display_name:string,email:string,role:string>>")).alias("owners"),
        "tags", F.transform("tags", lambda x: x["key"]).alias("classifications"), asset_type(F.col("table_type")).alias("asset_type"),
        F.map_filter("properties", lambda k, v: ~k.isin(*MAPPED)).alias("custom_attributes"),
    )


def data_products(raw: DataFrame, endpoint: str, tags: DataFrame | None) -> DataFrame:
    """Neutral data products from raw schemas: identity and neutral id, text fields, owners, tags, and all other properties. What they hold are rows of dataset_refs()."""
    t = with_tags(raw, tags)
    owner = owner_party(F.col("owner"))
    fixed = [F.lit(endpoint), F.lit("data_product"), F.col("metastore_id"), F.col("schema_id")]
    return t.select(
        *[c.alias(n) for c, n in zip(fixed, ("endpoint", "entity_type", "tenant_id", "native_key"), strict=True)], neutral_id(*fixed).alias("neutral_id"), "full_name", "name",
        F.nullif(strip(F.col("comment")), F.lit("")).alias("description"), F.when(owner.isNotNull(), F.array(owner)).otherwise(F.array().cast("array<struct<party_id:string,display_name:string,email:string,role:string>>")).alias("owners"),
        "tags", F.map_filter("properties", lambda k, v: ~k.isin(*MAPPED)).alias("custom_attributes"),
    )


def dataset_refs(products: DataFrame, datasets: DataFrame) -> DataFrame:
    """product_id, dataset_id (neutral ids) for every dataset of a product: a row each, however many there are. A dataset lies in the product that its full name begins with, up to the last dot."""
    parent = F.substring_index("full_name", ".", 2)
    own = datasets.select(parent.alias("full_name"), neutral_id(F.col("endpoint"), F.col("entity_type"), F.col("tenant_id"), F.col("native_key")).alias("dataset_id"))
    return products.select("full_name", F.col("neutral_id").alias("product_id")).join(own, "full_name").select("product_id", "dataset_id")


def target_products(raw: DataFrame, endpoint: str, tenant: str) -> DataFrame:
    """Neutral data products from a target's export: status from activated, owner then contacts (each user once), tags as labels without values."""
    contacts = F.transform(F.coalesce("keyContacts", F.array().cast("array<struct<userId:string,role:string>>")), lambda c: F.struct(c["userId"].alias("party_id"), party_role(c["role"]).alias("role")))
    owner = F.array_compact(F.array(F.when(F.col("ownerId").isNotNull(), F.struct(F.col("ownerId").alias("party_id"), F.lit("owner").alias("role")))))
    parties = F.concat(owner, contacts)
    once = F.filter(parties, lambda p, i: F.array_position(F.transform(parties, lambda q: q["party_id"]), p["party_id"]) == i + 1)
    return raw.select(
        F.lit(endpoint).alias("endpoint"), F.lit("data_product").alias("entity_type"), F.col("id").alias("native_key"), F.lit(tenant).alias("tenant_id"), "name",
        F.nullif(strip(F.col("description")), F.lit("")).alias("description"), F.col("readMe").alias("documentation"), F.when(F.col("activated"), "active").otherwise("draft").alias("status"),
        once.alias("owners"), F.transform("tags", lambda x: F.struct(x.alias("key"), F.lit(None).cast("string").alias("value"))).alias("tags"), F.col("spaceId").alias("placement"),
        F.try_to_timestamp("updatedAt").alias("last_modified_at"), F.col("etag").alias("source_revision"),
    )
