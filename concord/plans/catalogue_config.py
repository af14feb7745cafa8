"""More queries of the catalogue: configuration, listings and reads, and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import text as T
from ..operators import config, ranks, rule_table, snapshots
from ..sources import catalogs, reads
from .catalogue import Tables, _s, query

_RULES = "SELECT p_brand AS pair, p_partkey AS rule_id, p_size AS ordinal, p_name AS pattern, p_type AS decision FROM part"


def _rules(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("pair"), F.col("p_partkey").alias("rule_id"), F.col("p_size").alias("ordinal"), F.col("p_type").alias("decision"), F.lit("glob").alias("matcher_kind"), F.col("p_name").alias("pattern"))


@query(f"SELECT pair, max(ordinal) + 1 AS next_ordinal FROM ({_RULES}) GROUP BY 1")
def next_ordinal(t: Tables) -> DataFrame:
    return config.next_ordinal(_rules(t), ["pair"])


@query(f"SELECT pair, rule_id, (row_number() OVER (PARTITION BY pair ORDER BY rule_id % 3 <> 0, CASE WHEN rule_id % 3 = 0 THEN -rule_id END, ordinal, rule_id) - 1)::INTEGER AS ordinal FROM ({_RULES})")
def rules_reordered(t: Tables) -> DataFrame:
    wanted = _rules(t).where("rule_id % 3 = 0").select("pair", "rule_id", (-F.col("rule_id")).alias("pos"))
    return config.reordered(_rules(t), wanted, ["pair"]).select("pair", "rule_id", "ordinal")


@query(f"""
WITH r AS (SELECT pair, rule_id, row_number() OVER (PARTITION BY pair ORDER BY ordinal, rule_id) - 1 AS p, count(*) OVER (PARTITION BY pair) AS n FROM ({_RULES})), m AS (SELECT pair, min(rule_id) % 7 AS f, max(rule_id) % 5 AS t FROM ({_RULES}) GROUP BY 1)
SELECT pair, rule_id, (CASE WHEN f >= n OR t >= n THEN p WHEN p = f THEN t WHEN f < t AND p > f AND p <= t THEN p - 1 WHEN t < f AND p >= t AND p < f THEN p + 1 ELSE p END)::INTEGER AS ordinal FROM r JOIN m USING (pair)
""")
def rule_moved(t: Tables) -> DataFrame:
    moves = _rules(t).groupBy("pair").agg((F.min("rule_id") % 7).alias("from"), (F.max("rule_id") % 5).alias("to"))
    return config.moved(_rules(t), moves, ["pair"]).select("pair", "rule_id", "ordinal")


def _draft(t: Tables) -> DataFrame:
    """What a person made of the rules: some renamed, some left out, some new, and of one pair in another order."""
    k = F.col("rule_id")
    rules = _rules(t).where(k % 10 != 9).withColumn("pattern", F.when(k % 8 == 0, "renamed").otherwise(F.col("pattern")))
    named = rules.withColumn("scope", F.col("pair")).withColumn("key", _s("rule_id"))
    return named.withColumn("rule_id", F.when(k % 6 == 0, None).when(k % 35 == 1, -k).otherwise(k))


@query(f"""
SELECT pair AS scope, CASE WHEN rule_id % 6 = 0 OR rule_id % 35 = 1 THEN NULL ELSE rule_id END AS rule_id, rule_id::VARCHAR AS key, CASE WHEN rule_id % 6 = 0 OR rule_id % 35 = 1 THEN 'create' ELSE 'update' END AS action FROM ({_RULES}) WHERE rule_id % 10 <> 9 AND (rule_id % 6 = 0 OR rule_id % 35 = 1 OR rule_id % 8 = 0)
UNION ALL SELECT pair, rule_id, NULL, 'delete' FROM ({_RULES}) WHERE rule_id % 10 = 9 OR rule_id % 6 = 0 OR rule_id % 35 = 1
""")
def draft_save_plan(t: Tables) -> DataFrame:
    return config.save_plan(_draft(t), _rules(t).withColumnRenamed("pair", "scope"))


@query(f"""
WITH a AS ({_RULES}), s AS (SELECT pair, rule_id, decision, pattern, row_number() OVER (PARTITION BY pair ORDER BY ordinal, rule_id) AS p FROM a),
d AS (SELECT pair, rule_id, decision, CASE WHEN rule_id % 97 = 0 THEN 'renamed' ELSE pattern END AS pattern, row_number() OVER (PARTITION BY pair ORDER BY CASE WHEN pair = 'Brand#7' THEN -rule_id ELSE ordinal END, rule_id) AS p FROM a WHERE NOT (pair = 'Brand#9' AND rule_id % 50 = 9))
SELECT coalesce(d.pair, s.pair) AS scope, bool_or(d.rule_id IS DISTINCT FROM s.rule_id OR d.pattern IS DISTINCT FROM s.pattern OR d.decision IS DISTINCT FROM s.decision) AS dirty FROM d FULL JOIN s ON d.pair = s.pair AND d.p = s.p GROUP BY 1
""")
def draft_dirty(t: Tables) -> DataFrame:
    k = F.col("rule_id")
    rules = _rules(t).withColumnRenamed("pair", "scope")
    order = F.when(F.col("scope") == "Brand#7", -k).otherwise(F.col("ordinal"))
    kept = rules.where(~((F.col("scope") == "Brand#9") & (k % 50 == 9))).withColumn("pattern", F.when(k % 97 == 0, "renamed").otherwise(F.col("pattern")))
    draft = kept.withColumn("pos", F.row_number().over(Window.partitionBy("scope").orderBy(order, "rule_id")) - 1)
    return config.dirty(draft, rules, "scope")


@query("""
WITH a AS (SELECT p_type AS section, p_partkey AS name, p_brand AS content FROM part WHERE p_partkey % 9 <> 0), b AS (SELECT p_type AS section, p_partkey AS name, CASE WHEN p_size < 10 THEN p_name WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS content FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(a.section, b.section) AS section, coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.section = b.section AND a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.content IS DISTINCT FROM b.content
""")
def section_diff(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = lambda content: t.part.select(F.col("p_type").alias("section"), k.alias("name"), content.alias("content"))
    new = F.when(F.col("p_size") < 10, F.col("p_name")).when(k % 4 == 0, None).otherwise(F.col("p_brand"))
    return config.section_diff(rows(F.col("p_brand")).where("name % 9 <> 0"), rows(new).where("name % 7 <> 0"))


def _pairs(t: Tables) -> DataFrame:
    k, name = F.col("s_suppkey"), lambda c: F.concat(F.lit("NATION_"), c.cast("string"))
    return t.supplier.select(k.alias("pair"), name(F.col("s_nationkey") % 20).alias("source"), name((F.col("s_nationkey") + k) % 27).alias("target"), (F.col("s_acctbal") > 1000).alias("enabled"))


_PAIRS = "SELECT s_suppkey AS pair, 'NATION_' || (s_nationkey % 20)::VARCHAR AS source, 'NATION_' || ((s_nationkey + s_suppkey) % 27)::VARCHAR AS target, s_acctbal > 1000 AS enabled FROM supplier"


@query(f"SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM ({_PAIRS}) WHERE source = n_name OR target = n_name)")
def endpoints_in_use(t: Tables) -> DataFrame:
    return config.in_use(t.nation.select(F.col("n_name").alias("name")), _pairs(t))


@query(f"WITH e AS (SELECT n_name FROM nation WHERE n_nationkey % 5 <> 0) SELECT pair FROM ({_PAIRS}) WHERE enabled AND source IN (SELECT n_name FROM e) AND target IN (SELECT n_name FROM e)")
def schedulable_pairs(t: Tables) -> DataFrame:
    endpoints = t.nation.select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 5 != 0).alias("enabled"))
    return config.schedulable(_pairs(t), endpoints).select("pair")


@query("SELECT s_suppkey AS pair, array_to_string(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'dataset' END, CASE WHEN s_suppkey % 3 = 0 THEN 'data_product' END], lambda x: x IS NOT NULL), ',') AS entity_types FROM supplier")
def entity_type_overlap(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    own = F.array_compact(F.array(F.when(k % 3 == 0, "data_product"), F.lit("glossary_term"), F.when(k % 2 == 0, "dataset")))
    out = config.type_overlap(t.supplier.select(k.alias("pair"), own.alias("entity_types")), ["dataset", "data_product", "dataset"])
    return out.withColumn("entity_types", F.array_join("entity_types", ","))


@query("SELECT s_suppkey AS endpoint, CASE WHEN s_nationkey % 2 = 0 THEN 'password,token' ELSE 'token' END AS fields FROM supplier WHERE s_suppkey % 3 <> 0")
def inline_secret_settings(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    names = F.when(k % 3 == 0, F.array(F.lit("host"))).otherwise(F.array(F.lit("token"), F.lit("host"), F.lit("password")))
    settings = t.supplier.select(k.alias("endpoint"), F.concat(F.lit("c"), (F.col("s_nationkey") % 2).cast("string")).alias("connector"), names.alias("names"))
    secrets = t.spark.createDataFrame([("c0", ["password", "token"]), ("c1", ["token"])], "connector string, secrets array<string>")
    return config.inline_secrets(settings, secrets).withColumn("fields", F.array_join("fields", ","))


@query("""
WITH k AS (SELECT o_orderkey - o_orderkey % 2 * (o_orderkey % 50 = 1)::INT AS id, o_orderkey AS k FROM orders), d AS (SELECT id, unnest([k - 1, k + 2]) AS dep FROM k WHERE k % 2 = 0)
SELECT id, 'duplicate_id' AS problem, NULL::VARCHAR AS other FROM k GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'unknown_dependency', dep::VARCHAR FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = dep)
""")
def task_problems(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    id_ = F.when((k % 50 == 1) & (k % 2 == 1), k - 1).otherwise(k)
    deps = F.when(k % 2 == 0, F.array(k - 1, k + 2)).otherwise(F.array().cast("array<bigint>"))
    return config.task_problems(t.orders.select(id_.alias("id"), deps.alias("deps")))


@query("SELECT p_partkey AS assumption_id FROM part WHERE p_brand = 'Brand#3' AND p_size % 2 = 0 AND p_retailprice > 1000 AND p_partkey % 3 <> 0")
def assumptions_to_verify(t: Tables) -> DataFrame:
    registry = t.part.select(
        F.col("p_partkey").alias("assumption_id"), F.col("p_brand").alias("component"), F.when(F.col("p_size") % 2 == 0, "unverified").otherwise("verified").alias("status"),
        F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name")).alias("probe"), F.when(F.col("p_retailprice") > 1000, "high").otherwise("low").alias("severity"),
    )
    return config.assumptions(registry, component="Brand#3", with_probe=True, must_verify=True).select("assumption_id")


_IMPORT = f"""e AS (SELECT n_name AS name, CASE WHEN n_nationkey % 6 = 5 THEN 'no_connector' END AS reason FROM nation), p AS (SELECT pair::VARCHAR AS name, source, target FROM ({_PAIRS})),
q AS (SELECT p.*, CASE WHEN p.source = p.target THEN 'same_endpoint' WHEN NOT coalesce(a.reason IS NULL AND a.name IS NOT NULL, false) THEN 'no_source' WHEN NOT coalesce(b.reason IS NULL AND b.name IS NOT NULL, false) THEN 'no_target' END AS reason FROM p LEFT JOIN e a ON a.name = p.source LEFT JOIN e b ON b.name = p.target)"""


@query(f"WITH {_IMPORT} SELECT 'endpoint' AS kind, name AS key, coalesce(reason, 'created') AS result, 0::BIGINT AS rules FROM e UNION ALL SELECT 'pair', name, coalesce(reason, 'created'), CASE WHEN reason IS NULL THEN 2 ELSE 0 END FROM q")
def first_import(t: Tables) -> DataFrame:
    endpoints = t.nation.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 6 == 5, " ").otherwise("rest").alias("connector"))
    pairs = _pairs(t).select(_s("pair").alias("name"), "source", "target")
    patterns = pairs.select(F.col("name").alias("pair"), F.posexplode(F.array(F.lit("main.*"), F.lit("raw.*"))).alias("pos", "pattern"))
    items, rules, failures = config.first_import(0, endpoints, pairs, patterns)
    made = rules.groupBy(F.col("pair").alias("key")).agg(F.count(F.lit(1)).alias("rules")).withColumn("kind", F.lit("pair"))
    both = items.select("kind", "key", F.lit("created").alias("result")).unionByName(failures.select("kind", "key", F.col("reason").alias("result")))
    return both.join(made, ["kind", "key"], "left").withColumn("rules", F.coalesce("rules", F.lit(0)))


@query("SELECT c_custkey AS entity_id, CASE WHEN c_acctbal < 0 THEN 'delete' WHEN c_acctbal < 1000 THEN 'create' ELSE 'update' END AS action, 42::BIGINT AS generation FROM customer WHERE c_acctbal < 1000 OR c_custkey % 3 = 0")
def audit_generation(t: Tables) -> DataFrame:
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    changes = t.customer.select(
        F.lit("endpoint").alias("entity_kind"), k.alias("entity_id"), F.when(b < 0, "delete").when(b < 1000, "create").otherwise("update").alias("action"),
        F.lit("enabled").alias("field"), F.col("c_mktsegment").alias("was"), F.when(k % 3 == 0, "x").otherwise(F.col("c_mktsegment")).alias("now"),
    )
    log, _ = config.audited(t.spark.createDataFrame([(41,)], "generation long"), changes)
    return log.select("entity_id", "action", "generation")


# listings and reads

_FRESH = "SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_totalprice > 200000 THEN o_orderstatus ELSE o_orderpriority END AS checksum, 't' || (o_custkey % 4)::VARCHAR AS tenant_id, 'o.' || o_orderkey::VARCHAR AS full_name FROM orders WHERE o_orderkey % 17 <> 0"
_OLD = "SELECT o_orderkey::VARCHAR AS key, o_orderpriority AS checksum, 't' || (o_custkey % 4)::VARCHAR AS tenant_id, 'old.' || o_orderkey::VARCHAR AS full_name FROM orders WHERE o_orderkey % 13 <> 0"


def _listing(t: Tables, checksum, prefix: str) -> DataFrame:
    return t.orders.select(_s("o_orderkey").alias("key"), checksum.alias("checksum"), F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tenant_id"), F.concat(F.lit(prefix), _s("o_orderkey")).alias("full_name"))


def _listed(t: Tables) -> tuple[DataFrame, DataFrame]:
    now = F.when(F.col("o_totalprice") > 200000, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))
    return reads.list_changed(_listing(t, now, "o.").where("key % 17 <> 0"), _listing(t, F.col("o_orderpriority"), "old.").where("key % 13 <> 0"))


@query(f"WITH a AS ({_FRESH}), b AS ({_OLD}) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'deleted' ELSE 'upsert' END AS change, a.checksum, b.checksum AS was, coalesce(a.tenant_id, b.tenant_id) AS tenant_id, coalesce(a.full_name, b.full_name) AS full_name FROM a FULL JOIN b ON a.key = b.key WHERE a.checksum IS DISTINCT FROM b.checksum")
def list_changed(t: Tables) -> DataFrame:
    return _listed(t)[0]


@query("SELECT c_custkey AS native_key, CASE WHEN c_acctbal > 0 THEN 'dataset' ELSE 'data_product' END AS entity_type FROM customer WHERE c_mktsegment = 'BUILDING'")
def target_listing(t: Tables) -> DataFrame:
    objects = t.customer.select(F.col("c_custkey").alias("native_key"), F.when(F.col("c_acctbal") > 0, "dataset").otherwise("data_product").alias("entity_type"), F.col("c_mktsegment").alias("placement"))
    return reads.target_listing(objects, "BUILDING", ["dataset", "data_product"]).select("native_key", "entity_type")


def _tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    schemas = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.translate("r_name", " ", "_").alias("catalog_name"), F.col("n_name").alias("schema_name"), "n_nationkey")
    tables = t.customer.join(schemas, F.col("c_nationkey") == F.col("n_nationkey")).select("catalog_name", "schema_name", F.col("c_name").alias("table_id"))
    return schemas.drop("n_nationkey"), tables


_SCHEMAS = "SELECT replace(r_name, ' ', '_') AS c, n_name AS s, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT c AS catalog_name, s AS schema_name FROM ({_SCHEMAS}) WHERE (c = 'ASIA' AND s LIKE 'NATION_1%') OR (c = 'EUROPE' AND s SIMILAR TO 'NATION_[2-4]')")
def matching_schemas(t: Tables) -> DataFrame:
    schemas = _tree(t)[0]
    return reads.matching_schemas(schemas.unionAll(schemas), ["ASIA.NATION_1*", "EUROPE.NATION_[234]", "ASIA.NATION_1?"])


@query(f"""
WITH s AS (SELECT c || '.' || s AS full_name, c = 'ASIA' AS found, n_nationkey FROM ({_SCHEMAS})), m AS (SELECT c_nationkey, count(*) AS n, list_sort(list(c_name))[1:3] AS d FROM customer GROUP BY 1)
SELECT full_name, found, CASE WHEN found THEN coalesce(n, 0) ELSE 0 END AS n_datasets, CASE WHEN found THEN array_to_string(d, ',') END AS datasets FROM s LEFT JOIN m ON c_nationkey = n_nationkey UNION ALL SELECT 'gone.gone', false, 0, NULL
""")
def read_products(t: Tables) -> DataFrame:
    schemas, tables = _tree(t)
    refs = schemas.select(F.concat_ws(".", "catalog_name", "schema_name").alias("full_name")).unionAll(t.spark.createDataFrame([("gone.gone",)], "full_name string"))
    out = reads.read_products(schemas, tables, refs, ["ASIA.*"], listed=3, most=1_000_000_000)
    return out.withColumn("datasets", F.array_join("datasets", ","))


@query("SELECT l_orderkey, l_linenumber, p_partkey IS NOT NULL AS found, p_brand AS brand FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 40")
def read_entities(t: Tables) -> DataFrame:
    objects = t.part.where("p_size < 40").select(F.lit("dataset").alias("entity_type"), F.col("p_partkey").alias("native_key"), F.col("p_brand").alias("brand"))
    refs = t.lineitem.select("l_orderkey", "l_linenumber", F.lit("dataset").alias("entity_type"), F.col("l_partkey").alias("native_key"))
    return reads.read_entities(objects, refs, ["dataset"]).select("l_orderkey", "l_linenumber", "found", "brand")


@query("SELECT 'R' || l_returnflag || '.' || l_suppkey::VARCHAR AS full_name, array_to_string(list_sort(list(DISTINCT l_linestatus || '=' || l_linenumber::VARCHAR)), ',') AS tags FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1")
def tags_of_catalogs(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.concat(F.lit("R"), "l_returnflag").alias("catalog_name"), _s("l_suppkey").alias("schema_name"), F.col("l_linestatus").alias("tag_name"), _s("l_linenumber").alias("tag_value"))
    tags = reads.tags_of_catalogs(t.spark, rows, "schema_tags", ["RA", "RN", "RA"])
    return tags.select("full_name", F.array_join(T.tag_values(F.col("tags")), ",").alias("tags"))


@query(f"WITH a AS ({_FRESH}) SELECT key AS native_key, o_orderstatus AS status FROM a JOIN orders ON o_orderkey::VARCHAR = key WHERE o_orderkey % 5 <> 0")
def all_entities(t: Tables) -> DataFrame:
    now = F.when(F.col("o_totalprice") > 200000, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))
    changes, _ = reads.list_changed(_listing(t, now, "o.").where("key % 17 <> 0"), None)
    objects = t.orders.where("o_orderkey % 5 <> 0").select(_s("o_orderkey").alias("native_key"), F.col("o_orderstatus").alias("status"))
    return reads.all_entities(changes, objects)


def _bindings(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(F.when(k % 2 == 0, "src").otherwise("tgt").alias("endpoint"), F.col("c_mktsegment").alias("entity_type"), (F.col("c_nationkey") % 3).cast("string").alias("tenant_id"), k.cast("string").alias("native_key"), (F.col("c_acctbal") > 0).alias("confirmed"))


@query("SELECT c_mktsegment AS entity_type, (c_nationkey % 3)::VARCHAR AS tenant_id, c_custkey::VARCHAR AS native_key FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey % 3 = 1 AND c_acctbal > 0")
def bindings_listed(t: Tables) -> DataFrame:
    return reads.bindings_of(_bindings(t), endpoint="src", tenant_id="1", confirmed_only=True).select("entity_type", "tenant_id", "native_key")


@query("SELECT c_custkey::VARCHAR AS native_key FROM customer WHERE c_custkey = 42 AND c_nationkey % 3 = (SELECT c_nationkey % 3 FROM customer WHERE c_custkey = 42)")
def binding_point_read(t: Tables) -> DataFrame:
    own = _bindings(t).where("native_key = '42'").first()
    return reads.binding_of(_bindings(t), endpoint="src", entity_type=own["entity_type"], tenant_id=own["tenant_id"], native_key="42").select("native_key")


@query("SELECT o_orderkey, o_totalprice, true AS more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(t: Tables) -> DataFrame:
    rows, more = ranks.page(t.orders.select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("down")), ["down", "o_orderkey"], 100, 50)
    return rows.select("o_orderkey", "o_totalprice", F.lit(more).alias("more"))


@query("WITH e AS (SELECT * FROM part ORDER BY p_name, p_partkey LIMIT 150) SELECT p_brand, count(*) AS n, true AS truncated FROM e GROUP BY 1")
def preview_examined(t: Tables) -> DataFrame:
    rows, truncated = reads.examined(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name", "p_partkey"], 150)
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn("truncated", F.lit(truncated))


@query(f"SELECT 0 AS level, c || '.' || s AS name FROM ({_SCHEMAS}) UNION ALL SELECT 1, c || '.' || s || '.' || c_name FROM customer JOIN ({_SCHEMAS}) ON n_nationkey = c_nationkey")
def source_tree(t: Tables) -> DataFrame:
    schemas, tables = _tree(t)
    return reads.all_nodes(schemas, tables).select("level", F.concat_ws(".", "catalog_name", "schema_name", "table_id").alias("name"))


# scalar functions


@query("""
WITH s AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)
SELECT doc_id, CASE WHEN rtrim(substr(s, 1, 80), '-') = '' THEN 'item' ELSE rtrim(substr(s, 1, 80), '-') END AS slug FROM s
""")
def slugs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.slug(F.coalesce("text", F.lit(""))).alias("slug"))


@query("SELECT s_suppkey, upper(replace(s_name, '#', '_')) AS key, least(s_suppkey * 7.0::DOUBLE * 0.1::DOUBLE, 60::DOUBLE) AS jitter FROM supplier")
def endpoint_keys(t: Tables) -> DataFrame:
    name = F.concat(F.lit(" -"), "s_name", F.lit("! "))
    return t.supplier.select("s_suppkey", T.endpoint_key(name).alias("key"), T.jitter(F.col("s_suppkey") * 7.0).alias("jitter"))


@query("SELECT event_id, rtrim(replace(replace(to_base64((strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || event_id::VARCHAR)::BLOB), '+', '-'), '/', '_'), '') AS cursor, ts AS at, event_id::VARCHAR AS key FROM events")
def page_cursors(t: Tables) -> DataFrame:
    made = t.events.select("event_id", T.cursor(F.col("ts"), F.col("event_id")).alias("cursor"))
    return made.withColumn("parts", T.cursor_parts(F.col("cursor"))).select("event_id", "cursor", F.col("parts.at").cast("timestamp_ntz").alias("at"), F.col("parts.key").alias("key"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN l_extendedprice::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.2f', l_extendedprice), '0'), '.') END AS price, CASE WHEN l_discount = 0 THEN '0' ELSE rtrim(rtrim(printf('%.2f', l_discount), '0'), '.') END AS discount FROM lineitem""")
def numbers_as_json(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", C.number_text(F.col("l_extendedprice")).alias("price"), C.number_text(-F.col("l_discount") * -1.0).alias("discount"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS instant, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS from_millis FROM events""")
def instants_canonical(t: Tables) -> DataFrame:
    k = F.col("event_id")
    shifted = F.date_format(F.col("ts").cast("timestamp") + F.expr("INTERVAL '5:30' HOUR TO MINUTE"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    zulu = F.date_format("ts", "yyyy-MM-dd't'HH:mm:ss.SSSSSS")
    text = F.when(k % 3 == 0, F.concat(shifted, F.lit("+0530"))).when(k % 3 == 1, F.concat(shifted, F.lit("+05:30"))).otherwise(F.concat(F.lit(" "), zulu, F.lit("z\r\n")))
    millis = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return t.events.select("event_id", C.canonical_string(text).alias("instant"), C.instant_text(C.instant_of_millis(millis)).alias("from_millis"))


@query("""SELECT event_id, '{"a":' || (event_id % 7)::VARCHAR || ',"k":' || (props::JSON ->> 'k') || ',"tags":["' || CASE WHEN event_type < 'm' THEN event_type || '","m' ELSE 'm","' || event_type END || '"]}' AS canonical, '{"tags":["m"," ' || event_type || '"],"k":' || (props::JSON ->> 'k') || ',"a":' || (event_id % 7)::VARCHAR || '.0}' AS faithful FROM events""")
def json_two_projections(t: Tables) -> DataFrame:
    text = F.concat(F.lit('{"tags": ["m", " '), "event_type", F.lit('"], "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": '), (F.col("event_id") % 7).cast("string"), F.lit(".0}"))
    return t.events.select("event_id", C.canonical_json(text, sort_arrays=True).alias("canonical"), C.faithful_json(text).alias("faithful"))


@query("""
WITH c AS (SELECT c_custkey, '["' || c_mktsegment || '","a"]' AS v, CASE WHEN c_mktsegment < 'a' THEN '["' || c_mktsegment || '","a"]' END AS s FROM customer)
SELECT c_custkey, 'tags' AS field, v AS value, 'sha256:' || sha256(s) AS checksum, 'src' AS source_endpoint FROM c UNION ALL SELECT c_custkey, 'columns', v, 'sha256:' || sha256(v), 'src' FROM c
""")
def envelopes_with_provenance(t: Tables) -> DataFrame:
    value = F.concat(F.lit('["'), "c_mktsegment", F.lit('","a"]'))
    out = snapshots.json_envelopes(t.customer, "c_custkey", {"tags": value, "columns": value}, source_endpoint=F.lit("src"))
    return out.select("c_custkey", "field", "value", "checksum", "source_endpoint")


@query("""
WITH x AS (SELECT e.event_id, e.event_type AS t, b.event_type AS p, e.props::JSON ->> 'k' AS k FROM events e LEFT JOIN events b ON b.event_id = e.event_id - 1),
y AS (SELECT *, CASE WHEN p IS NULL THEN 'not_json' WHEN t = 'view' AND p = 'purchase' THEN 'not_finite' WHEN t = 'click' AND p = 'signup' THEN 'too_deep' WHEN t = p THEN 'keys_collide' WHEN t = 'signup' AND p = 'view' THEN 'not_unicode' END AS fault FROM x)
SELECT event_id, fault, CASE WHEN fault IS NULL THEN '{"' || t || '":' || k || '," ' || p || ' ":[1.0]}' END AS faithful,
CASE WHEN fault IS NULL THEN CASE WHEN t < p THEN '{"' || t || '":' || k || ',"' || p || '":[1]}' ELSE '{"' || p || '":[1],"' || t || '":' || k || '}' END END AS canonical FROM y
""")
def json_faults(t: Tables) -> DataFrame:
    """JSON made of each event and the one before it: texts that are cut off, too deep, infinite, beyond UTF-8 or with keys that become equal have their fault, all others both projections."""
    before = t.events.select((F.col("event_id") + 1).alias("event_id"), F.col("event_type").alias("before"))
    kind, last = F.col("event_type"), F.col("before")
    value = F.when((kind == "view") & (last == "purchase"), "1e999").when((kind == "click") & (last == "signup"), "[" * 70 + "]" * 70).when((kind == "signup") & (last == "view"), '"\\ud800"')
    first = F.concat(F.lit('{"'), kind, F.lit('": '), F.coalesce(value, F.get_json_object("props", "$.k")))
    text = F.concat(first, F.coalesce(F.concat(F.lit(', " '), last, F.lit(' ": [1.0]}')), F.lit("")))
    return t.events.join(before, "event_id", "left").select("event_id", C.json_projections(text).alias("j")).select("event_id", "j.fault", "j.faithful", "j.canonical")


_NATIONS = """
WITH x AS (SELECT c_custkey, c_mktsegment AS m, c_nationkey::VARCHAR AS a, s_nationkey::VARCHAR AS b FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey),
y AS (SELECT *, CASE WHEN b IS NULL THEN 'not_json' WHEN a = b THEN 'keys_collide' END AS fault, CASE WHEN a < b THEN '{"' || a || '":1,"' || b || '":2}' ELSE '{"' || b || '":2,"' || a || '":1}' END AS c,
CASE WHEN m < 'a' THEN '["' || m || '","a"]' ELSE '["a","' || m || '"]' END AS s FROM x),
z AS (SELECT c_custkey, 'tags' AS field, '["' || m || '","a"]' AS value, s AS canonical, NULL AS fault, 'columns:' || fault AS object_fault FROM y
UNION ALL SELECT c_custkey, 'columns', CASE WHEN fault IS NULL THEN '{"' || a || '":1," ' || b || '":2}' END, CASE WHEN fault IS NULL THEN c END, fault, 'columns:' || fault FROM y)
"""


def _nation_envelopes(t: Tables) -> DataFrame:
    both = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left")
    tags = F.concat(F.lit('["'), "c_mktsegment", F.lit('","a"]'))
    columns = F.concat(F.lit('{"'), _s("c_nationkey"), F.lit('":1'), F.coalesce(F.concat(F.lit(', " '), _s("s_nationkey"), F.lit('": 2}')), F.lit("")))
    return snapshots.json_envelopes_or_faults(both, "c_custkey", {"tags": tags, "columns": columns}, source_endpoint=F.lit("src"))


@query(_NATIONS + "SELECT c_custkey, field, value, 'sha256:' || sha256(canonical) AS checksum, fault, object_fault FROM z WHERE object_fault IS NOT NULL")
def objects_with_faults(t: Tables) -> DataFrame:
    """All fields of objects one of whose texts has no canonical form."""
    return _nation_envelopes(t).where(F.col("object_fault").isNotNull()).select("c_custkey", "field", "value", "checksum", "fault", "object_fault")


@query(_NATIONS + "SELECT c_custkey, field, value, canonical, 'sha256:' || sha256(canonical) AS checksum, 'src' AS source_endpoint FROM z WHERE object_fault IS NULL")
def sound_objects(t: Tables) -> DataFrame:
    return snapshots.sound_envelopes(_nation_envelopes(t))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS owner, p_type AS team, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS id FROM part""")
def maps_merged(t: Tables) -> DataFrame:
    first = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("owner"), "p_brand"))
    both = T.merged(first, F.create_map(F.lit("owner"), "p_type", F.lit("team"), "p_type"))
    keys = T.secondary_keys(F.create_map(F.lit("id"), F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(F.col("p_name"))))
    return t.part.select("p_partkey", F.try_element_at(both, F.lit("owner")).alias("owner"), F.try_element_at(both, F.lit("team")).alias("team"), F.try_element_at(keys, F.lit("id")).alias("id"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"props":' || regexp_replace(props, ': ', ':') || ',"apiKey":"***REDACTED***","note":"say Bearer ***REDACTED***"}' ELSE '{"list":[{"access-key":"***REDACTED***"},"basic ***REDACTED*** y"],"n":1}' END AS redacted, '***REDACTED***' AS in_map FROM events""")
def secrets_in_json(t: Tables) -> DataFrame:
    a = F.concat(F.lit('{"props": '), "props", F.lit(', "apiKey": {"deep": [1]}, "note": "say Bearer\\tabc!x"}'))
    b = F.lit('{"list": [{"access-key": 5}, "basic dXNlcg== y"], "n": 1}')
    m = F.create_map(F.lit("clientSecret"), "event_type", F.lit("name"), "event_type")
    redacted = T.redacted_json(F.when(F.col("event_id") % 2 == 0, a).otherwise(b))
    return t.events.select("event_id", redacted.alias("redacted"), T.redacted_map(m)["clientSecret"].alias("in_map"))


@query("SELECT 'pattern-' || (row_number() OVER (ORDER BY p_partkey) - 1)::VARCHAR AS rule_id, (row_number() OVER (ORDER BY p_partkey) - 1)::INTEGER AS ordinal, p_type || '.' || p_name || '*' AS pattern FROM part")
def rules_of_patterns(t: Tables) -> DataFrame:
    return rule_table.rules_from_patterns(t.part.select("p_partkey", F.concat("p_type", F.lit("."), "p_name", F.lit("*")).alias("pattern")), "p_partkey").select("rule_id", "ordinal", "pattern")


@query("SELECT p_type || '.' || p_name || CASE WHEN p_size % 2 = 0 THEN '*' ELSE '' END AS pattern, min(p_partkey)::INTEGER AS ordinal FROM part WHERE p_size % 3 <> 0 AND p_size % 5 <> 0 GROUP BY 1")
def patterns_of_rules(t: Tables) -> DataFrame:
    size = F.col("p_size")
    rules = t.part.select(
        F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_partkey").cast("int").alias("ordinal"), F.lit("object").alias("scope"), F.when(size % 3 == 0, "exclude").otherwise("include").alias("decision"),
        F.when(size % 5 == 0, "owner").otherwise("glob").alias("kind"), F.concat("p_type", F.lit("."), "p_name", F.when(size % 2 == 0, "*").otherwise("")).alias("pattern"),
    )
    return rule_table.patterns_from_rules(rules)


@query("""
WITH l AS (SELECT o_orderkey, [(o_orderkey % 7)::BIGINT, 3, 5, o_orderkey % 4] AS ids FROM orders), f AS (SELECT o_orderkey, list_filter(ids, lambda x, i: x IN (1, 3, o_orderkey % 4) AND list_position(ids, x) = i) AS k FROM l) SELECT o_orderkey, array_to_string(k, ',') AS kept FROM f""")
def ordered_subsets(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    three = F.lit(3).cast("long")
    ids = F.array(k % 7, three, F.lit(5).cast("long"), k % 4)
    kept = config.ordered_subset(ids, F.array(F.lit(1).cast("long"), three, k % 4))
    return t.orders.select("o_orderkey", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment || '@example.com' END AS email, CASE WHEN c_nationkey % 2 = 0 THEN 'example.com' END AS domain, CASE WHEN c_acctbal > 0 THEN 'view' ELSE 'table' END AS asset_type FROM customer""")
def datasets_neutral(t: Tables) -> DataFrame:
    raw = t.customer.select(
        F.concat(F.lit("c.s."), "c_name").alias("full_name"), F.col("c_name").alias("name"), _s("c_custkey").alias("table_id"), F.lit("m").alias("metastore_id"), F.lit(" ").alias("comment"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit("@example.com "))).otherwise(" ").alias("owner"), F.when(F.col("c_acctbal") > 0, "VIEW").otherwise("MANAGED").alias("table_type"),
        F.create_map(F.lit("k"), F.lit("v")).alias("properties"),
    )
    out = catalogs.datasets(raw, "src", None).withColumn("email", F.get("owners.email", F.lit(0)))
    return out.select(F.col("native_key").cast("long").alias("c_custkey"), "email", T.email_domain(F.col("email")).alias("domain"), "asset_type")
