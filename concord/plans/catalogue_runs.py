"""More queries of the catalogue: manifests, payloads, recorded runs, bindings and orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diffs, history, identity, manifests, payloads, runs
from .catalogue import _CHANGED, _COMPOSED, _CYCLE, _LONG, _OWN, Tables, _customer_fields, _customers, _cycle, _diff, _s, query

_OUTCOME = "CASE event_type WHEN 'view' THEN 'unchanged' WHEN 'signup' THEN 'created' WHEN 'click' THEN 'written' WHEN 'purchase' THEN 'skipped' ELSE CASE WHEN value < 30 THEN 'failed' ELSE 'orphaned' END END"
_MANIFEST = [
    ("ECONOMY", True, "Brand#1", "rw", True, False), ("ECONOMY", True, "Brand#2", "ro", True, False), ("ECONOMY", True, "Brand#3", "na", True, False), ("PROMO", True, "Brand#1", "rw", False, True),
    ("PROMO", True, "Brand#4", "rw", True, True), ("STANDARD", False, "Brand#1", "rw", True, False), ("LARGE", True, "Brand#5", "ro", False, False),
]
_MANIFEST_SQL = "(VALUES " + ", ".join(f"('{t}', {s}, '{f}', '{m}', {p})" for t, s, f, m, p, _ in _MANIFEST).lower().replace("brand", "Brand") + ") AS m(t, s, f, m, p)"


def _declared(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(_MANIFEST, "entity_type string, supported boolean, field string, mode string, partial_update boolean, normalized boolean")
    return rows.withColumn("path_allowed", F.lit(None).cast("boolean"))


@query(f"""
WITH m AS (SELECT upper(t) AS t, s, f, m, p FROM {_MANIFEST_SQL}), y AS (SELECT t, bool_or(s) AS s FROM m GROUP BY 1)
SELECT p_partkey, coalesce(y.s, false) AS supports, coalesce(y.s AND m.m <> 'na', false) AS offered, coalesce(y.s AND m.m = 'rw', false) AS is_writable, coalesce(y.s AND m.m = 'rw' AND NOT m.p, false) AS full_replace
FROM part LEFT JOIN y ON y.t = p_type LEFT JOIN m ON m.t = p_type AND m.f = p_brand
""")
def manifest_capabilities(t: Tables) -> DataFrame:
    fields = t.part.select("p_partkey", F.col("p_type").alias("entity_type"), F.col("p_brand").alias("field"))
    return manifests.capabilities(fields, _declared(t)).select("p_partkey", "supports", "offered", "is_writable", "full_replace")


@query("""
SELECT r_name AS connector, 'type' || (n_nationkey % 2)::VARCHAR AS entity_type, bool_or(n_nationkey % 7 <> 0) AS supported,
string_agg(n_name || ':' || CASE n_nationkey % 3 WHEN 0 THEN 'rw' WHEN 1 THEN 'ro' ELSE 'na' END || CASE WHEN n_nationkey % 4 = 0 THEN '!' ELSE '' END, ',' ORDER BY n_name) AS fields FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
""")
def capability_matrix(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("connector"), F.concat(F.lit("type"), (k % 2).cast("string")).alias("entity_type"), (k % 7 != 0).alias("supported"), F.col("n_name").alias("field"),
        F.when(k % 3 == 0, "rw").when(k % 3 == 1, "ro").otherwise("na").alias("mode"), (k % 4 != 0).alias("partial_update"),
    )
    return manifests.capability_matrix(rows)


@query("""
WITH w AS (SELECT s_suppkey, s_nationkey AS e, CASE WHEN s_suppkey % 2 = 0 THEN 'object' ELSE 'dataset' END AS scope, CASE s_suppkey % 3 WHEN 0 THEN 'glob' WHEN 1 THEN 'tag' ELSE 'owner' END AS kind FROM supplier),
d AS (SELECT n_nationkey AS e, CASE WHEN n_nationkey % 2 = 0 THEN 'object' ELSE 'dataset' END AS scope, CASE WHEN n_nationkey % 3 = 0 THEN 'tag' ELSE 'owner' END AS kind, n_nationkey % 5 <> 1 AS fits FROM nation)
SELECT s_suppkey, CASE WHEN kind = 'glob' THEN 'available' WHEN n_regionkey = 0 THEN 'unknown' WHEN coalesce(fits, false) THEN 'available' ELSE 'unavailable' END AS state FROM w JOIN nation ON n_nationkey = w.e LEFT JOIN d USING (e, scope, kind)
""")
def matcher_availability(t: Tables) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    wanted = t.supplier.select(k, F.col("s_nationkey").alias("endpoint"), F.when(k % 2 == 0, "object").otherwise("dataset").alias("scope"), F.when(k % 3 == 0, "glob").when(k % 3 == 1, "tag").otherwise("owner").alias("kind"))
    endpoints = t.nation.select(n.alias("endpoint"), (F.col("n_regionkey") != 0).alias("read"))
    declared = t.nation.select(
        n.alias("endpoint"), F.when(n % 2 == 0, "data_product").otherwise("dataset").alias("entity_type"), F.when(n % 3 == 0, "tags").otherwise("owners").alias("field"),
        F.lit(True).alias("supported"), F.when(n % 5 == 1, "na").otherwise("ro").alias("mode"),
    )
    return manifests.matcher_availability(wanted, endpoints, declared).select("s_suppkey", "state")


@query(f"""
WITH s AS (SELECT c_custkey, x.f AS field, x.v AS value FROM ({_LONG % _OWN})), b AS (SELECT c_custkey, field, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN upper(value) ELSE value END AS back FROM s WHERE c_custkey % 11 <> 0)
SELECT c_custkey, field, CASE WHEN field = 'name' THEN back IS NOT NULL AND back <> '' ELSE back IS NOT DISTINCT FROM value END AS survived FROM s LEFT JOIN b USING (c_custkey, field)
""")
def substance_survived(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    written = _customer_fields(t.customer).withColumn("entity_type", F.lit("dataset"))
    read = written.where(k % 11 != 0).withColumn("value", F.when(k % 5 == 0, "").when(k % 3 == 0, F.upper("value")).otherwise(F.col("value")))
    lossy = t.spark.createDataFrame([("dataset", "name", True), ("dataset", "cents", False)], "entity_type string, field string, normalized boolean")
    return manifests.survived(written, read, lossy, "c_custkey").select("c_custkey", "field", "survived")


@query("""
WITH r AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey)) AS ids, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, coalesce([x::VARCHAR FOR x IN ids IF x % 4 <> 0], []) AS refs, coalesce(n, 0) AS n_refs, coalesce([x::VARCHAR FOR x IN ids IF x % 3 = 0], []) AS con FROM customer LEFT JOIN r ON o_custkey = c_custkey),
q AS (SELECT *, refs[1:100] AS sent, CASE WHEN c_custkey % 2 = 0 THEN [x FOR x IN con IF list_contains(refs[1:100], x)] END AS c2 FROM p)
SELECT c_custkey AS key, '{"name":"' || c_name || '","spaceId":"s1"' || CASE WHEN c_acctbal > 0 THEN ',"description":"' || c_mktsegment || '"' ELSE '' END || CASE WHEN c_mktsegment <> 'BUILDING' THEN ',"tags":["' || c_mktsegment || '"]' ELSE '' END
 || CASE WHEN len(sent) > 0 THEN ',"datasetIds":["' || array_to_string(sent, '","') || '"]' ELSE '' END || CASE WHEN len(c2) > 0 THEN ',"apiConsumableDatasetIds":["' || array_to_string(c2, '","') || '"]' ELSE '' END || '}' AS body,
 array_to_string(list_sort(list_filter([CASE WHEN len(sent) > 0 THEN 'dataset_refs' END, CASE WHEN c_acctbal > 0 THEN 'description' END, 'name', CASE WHEN c_custkey % 3 = 0 THEN 'placement' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'tags' END], lambda x: x IS NOT NULL)), ',') AS written,
 array_to_string(list_filter([CASE WHEN n_refs > len(refs) THEN 'dataset_refs: ' || (n_refs - len(refs)) || ' not resolved' END, CASE WHEN len(refs) > 100 THEN 'dataset_refs: ' || (len(refs) - 100) || ' beyond the cap' END,
  CASE WHEN c_custkey % 2 = 0 AND len(con) > len(c2) THEN 'dataset_refs: ' || (len(con) - len(c2)) || ' consumable but not sent' END, CASE WHEN c_custkey % 3 = 1 THEN 'placement: ignored' END], lambda x: x IS NOT NULL), '; ') AS skipped FROM q
""")
def create_bodies(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    order = F.col("o_orderkey")
    members = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.when(order % 4 != 0, order).alias("ref"), (order % 3 == 0).alias("consumable"))
    none = F.array().cast("array<string>")
    joined = t.customer.join(payloads.listed_members(members, "c_custkey"), "c_custkey", "left")
    count = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    products = joined.select(
        k.alias("key"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(" ").alias("description"), F.lit(None).cast("string").alias("documentation"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.array("c_mktsegment")).otherwise(F.array().cast("array<string>")).alias("tags"), F.coalesce("refs", none).alias("refs"),
        count("n_refs"), count("n_resolved"), count("n_distinct"), count("n_consumable"), F.when(k % 2 == 0, F.coalesce("consumable", none)).alias("consumable"), F.array().cast("array<struct<userId:string,role:string>>").alias("contacts"),
        F.lit(0).alias("n_owners"), F.when(k % 3 == 0, "s1").when(k % 3 == 1, "s2").alias("placement"),
    )
    out = payloads.create_bodies(products, "s1")
    return out.select("key", "body", F.array_join("written", ",").alias("written"), F.array_join("skipped", "; ").alias("skipped"))


_OPS = f"""{_CYCLE}, ops AS (SELECT c_custkey AS key, CASE field WHEN 'name' THEN 'name' ELSE 'description' END AS f, CASE field WHEN 'name' THEN '/name' ELSE '/description' END AS path, '"' || value || '"' AS value, coalesce(revision, '') AS rev FROM v WHERE field IN ('name', 'segment')),
need AS (SELECT * FROM ops WHERE NOT (key % 4 = 1 AND path = '/name'))"""


@query(f"""WITH {_OPS} SELECT key, '[' || string_agg('{{"op":"replace","path":"' || path || '","value":' || value || '}}', ',' ORDER BY path) || ']' AS patch, count(*) AS n_operations, 'r' || (key % 2)::VARCHAR AS if_match FROM need GROUP BY key""")
def patch_bodies(t: Tables) -> DataFrame:
    k = F.col("key")
    writes = _cycle(t)[1].where(F.col("field").isin("name", "segment"))
    ops = payloads.operations(writes.withColumn("field", F.when(F.col("field") == "segment", "description").otherwise(F.col("field"))))
    current = ops.withColumn("value", F.when((k % 4 == 1) & (F.col("path") == "/name"), F.col("value")).otherwise(F.lit('"other"')))
    revisions = t.customer.select(F.col("c_custkey").alias("key"), F.concat(F.lit("r"), (F.col("c_custkey") % 2).cast("string")).alias("if_match"))
    return payloads.patches(payloads.still_needed(ops, current), revisions)


@query(f"""
WITH {_CHANGED}, w AS (SELECT * FROM x WHERE action <> 'drop'), r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'no_op' WHEN 1 THEN 'written' WHEN 2 THEN 'written' ELSE 'skipped' END AS o, CASE WHEN c_custkey % 4 = 1 THEN ['name'] ELSE [] END AS named FROM customer)
SELECT c_custkey AS key, field, value, checksum, 't' || c_custkey::VARCHAR AS revision, TIMESTAMP '2024-02-01' AS last_synced_at FROM w JOIN r USING (c_custkey) WHERE r.o = 'no_op' OR (r.o = 'written' AND (len(r.named) = 0 OR list_contains(r.named, field)))
""")
def persisted_envelopes(t: Tables) -> DataFrame:
    k = F.col("key")
    diff = _diff(t).where("action <> 'drop'").withColumnRenamed("c_custkey", "key")
    replies = t.customer.select(F.col("c_custkey").alias("key")).select(
        k, F.when(k % 4 == 0, "no_op").when(k % 4 == 3, "skipped").otherwise("written").alias("outcome"), F.when(k % 4 == 1, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")).alias("written_fields"),
        F.concat(F.lit("t"), k.cast("string")).alias("revision"), F.lit("2024-02-01").cast("timestamp_ntz").alias("at"),
    )
    return payloads.persisted(diff, replies)


@query("SELECT l_orderkey, max(CASE WHEN l_returnflag <> 'R' THEN l_shipdate END) AS last_synced_at FROM lineitem GROUP BY 1")
def last_synced(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("last_synced_at"))
    return payloads.last_synced(rows, ["l_orderkey"])


def _run_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs (one a user), records and errors (events); every seventh run was closed before."""
    run = F.col("user_id").alias("run_id")
    start = F.lit("2024-01-01").cast("timestamp")
    running = runs.started(t.events.select("user_id").distinct().select(run, F.lit("p").alias("pair"), F.lit("dataset").alias("entity_type"), F.lit(False).alias("dry_run"), start.alias("started_at")))
    given = running.withColumn("status", F.when(F.col("run_id") % 7 == 0, "failed").otherwise(F.col("status")))
    outcome = F.expr(_OUTCOME)
    records = t.events.select(
        run, _s("event_id").alias("native_key"), outcome.alias("outcome"), F.lit(None).cast("string").alias("reason"), (F.col("event_type") == "purchase").alias("holds"), (F.col("event_type") != "error").alias("was_read"),
        F.array_compact(F.array(F.when(F.col("value") > 150, "owners"), F.when(F.col("value") > 200, "dataset_refs"))).alias("unresolved"),
    )
    failed = t.events.where("event_type = 'error'")
    errors = failed.select(run, F.when(F.col("value") < 20, "AuthError").otherwise("WriteError").alias("kind"), F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string")).alias("endpoint"), F.lit(False).alias("fatal"))
    return given, records, errors


_COUNTS = ", ".join(f"count(*) FILTER (WHERE o = '{o}')" + f" AS n_{o}" for o in diffs.OUTCOMES)
_RUNS = f"""c AS (SELECT user_id, {_COUNTS}, count(*) FILTER (WHERE event_type <> 'error') AS read, count(*) FILTER (WHERE event_type = 'error') AS errors,
 coalesce(array_to_string(list_sort(list(DISTINCT 'e' || (event_id % 3)::VARCHAR) FILTER (WHERE event_type = 'error' AND value < 20)), ','), '') AS quarantined, max(ts) AS done FROM (SELECT *, {_OUTCOME} AS o FROM events) GROUP BY 1)"""


def _finished(t: Tables) -> DataFrame:
    given, records, errors = _run_tables(t)
    reports = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.when(F.count_if(F.col("event_type") == "error") > 13, "partial").otherwise("ok").alias("status"), F.max(F.col("ts").cast("timestamp")).alias("finished_at"))
    return runs.finished(given, reports, records, errors)


_ZERO = ", ".join(f"CASE WHEN user_id % 7 = 0 THEN 0 ELSE n_{o} END AS n_{o}" for o in diffs.OUTCOMES)


@query(f"""WITH {_RUNS} SELECT user_id AS run_id, CASE WHEN user_id % 7 = 0 THEN 'failed' WHEN errors > 13 THEN 'partial' ELSE 'ok' END AS status, {_ZERO}, CASE WHEN user_id % 7 = 0 THEN 0 ELSE read END AS read, CASE WHEN user_id % 7 = 0 THEN 0 ELSE errors END AS errors,
CASE WHEN user_id % 7 = 0 THEN '' ELSE quarantined END AS quarantined, CASE WHEN user_id % 7 <> 0 THEN epoch_us(done) - epoch_us(TIMESTAMP '2024-01-01') END AS duration_us FROM c""")
def run_recorder(t: Tables) -> DataFrame:
    counts = [f"n_{o}" for o in diffs.OUTCOMES]
    return _finished(t).select("run_id", "status", *counts, "read", "errors", F.array_join("quarantined", ",").alias("quarantined"), F.round(F.col("duration_s") * 1e6).cast("long").alias("duration_us"))


@query("""SELECT user_id AS run_id, CASE WHEN user_id % 5 = 0 THEN 'unknown_run' WHEN user_id % 7 = 0 THEN 'already_finished' ELSE 'closed_twice' END AS problem FROM events WHERE value > 90 GROUP BY 1, user_id HAVING user_id % 5 = 0 OR user_id % 7 = 0 OR count(*) > 1""")
def run_transitions(t: Tables) -> DataFrame:
    given, _, _ = _run_tables(t)
    closings = t.events.where("value > 90").select(F.col("user_id").alias("run_id"))
    return runs.transitions(given.where("run_id % 5 <> 0"), closings)


@query("""SELECT user_id AS run_id, CASE WHEN user_id % 7 = 0 OR lo < TIMESTAMP '2024-01-01 03:00:00' THEN 'failed' ELSE 'running' END AS status, CASE WHEN user_id % 7 <> 0 AND lo < TIMESTAMP '2024-01-01 03:00:00' THEN 1 ELSE 0 END::BIGINT AS errors FROM (SELECT user_id, min(ts) AS lo FROM events GROUP BY 1)""")
def runs_reaped(t: Tables) -> DataFrame:
    given, _, _ = _run_tables(t)
    begun = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.min(F.col("ts").cast("timestamp")).alias("started_at"))
    after, _ = runs.reaped(given.drop("started_at").join(begun, "run_id"), F.lit("2024-01-01 04:00:00").cast("timestamp"), older_than_s=3600)
    return after.select("run_id", "status", "errors")


_ITEMS = f"""i AS (SELECT *, {_OUTCOME} AS o, event_type = 'purchase' AS h, list_filter([CASE WHEN value > 150 THEN 'owners' END, CASE WHEN value > 200 THEN 'dataset_refs' END], lambda x: x IS NOT NULL) AS u FROM events)"""


@query(f"""WITH {_ITEMS} SELECT sha256(user_id::VARCHAR || '|' || event_id::VARCHAR) AS item_id, user_id AS run_id, event_id::VARCHAR AS native_key, o AS outcome, h AS held_watermark, CASE WHEN o = 'orphaned' THEN 'src' END AS endpoint, len(u) AS n_unresolved FROM i WHERE h OR o IN ('orphaned', 'failed') OR len(u) > 0""")
def run_items(t: Tables) -> DataFrame:
    items = runs.run_items(_run_tables(t)[1], F.lit("src"))
    return items.select("item_id", "run_id", "native_key", "outcome", "held_watermark", "endpoint", F.size("unresolved").cast("long").alias("n_unresolved"))


@query(f"""WITH {_ITEMS} SELECT event_id::VARCHAR AS native_key, CASE WHEN f = 'owners' THEN 'owner' ELSE 'dataset_member' END AS kind FROM (SELECT event_id, unnest(u) AS f FROM i)""")
def unresolved_once_a_kind(t: Tables) -> DataFrame:
    return runs.unresolved_kinds(_run_tables(t)[1])


@query(f"""WITH {_ITEMS}, r AS (SELECT user_id, event_id::VARCHAR AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id::VARCHAR) AS n FROM i WHERE h)
SELECT user_id AS run_id, count(*) AS n_held, string_agg(k, ',' ORDER BY k) FILTER (WHERE n <= 5) AS held_by FROM r GROUP BY 1""")
def held_by_run(t: Tables) -> DataFrame:
    return runs.held_by(_run_tables(t)[1], ["run_id"], 5).withColumn("held_by", F.array_join("held_by", ","))


@query(f"""SELECT CASE WHEN o = 'created' THEN 'create' WHEN o = 'written' THEN 'update' WHEN o = 'unchanged' THEN 'no_op' ELSE 'other' END AS bucket, count(*) AS n FROM (SELECT {_OUTCOME} AS o FROM events) GROUP BY 1""")
def display_buckets(t: Tables) -> DataFrame:
    return _run_tables(t)[1].groupBy(runs.display_bucket(F.col("outcome")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RUNS}, f AS (SELECT *, user_id % 7 = 0 AS old FROM c)
SELECT CASE WHEN bool_or(NOT old AND quarantined <> '') THEN 3 WHEN bool_or(old OR errors > 13 OR errors > 0) THEN 1 ELSE 0 END::INTEGER AS exit_code, CASE WHEN bool_or(old) THEN 'failed' WHEN bool_or(errors > 13) THEN 'partial' ELSE 'ok' END AS worst FROM f""")
def exit_code(t: Tables) -> DataFrame:
    return runs.exit_code(_finished(t))


@query(f"""WITH {_RUNS} SELECT user_id % 40 AS plan, bool_and(user_id % 7 = 0 OR (n_created = 0 AND n_written = 0)) AS no_changes, bool_or(user_id % 7 = 0) AS any_failed FROM c GROUP BY 1""")
def plan_without_changes(t: Tables) -> DataFrame:
    return runs.plan_summary(_finished(t).withColumn("plan", F.col("run_id") % 40), ["plan"])


_HEALTH = "CASE WHEN s_acctbal < 0 THEN 'unhealthy' WHEN s_acctbal < 2000 THEN 'degraded' ELSE 'healthy' END"


def _components(t: Tables) -> DataFrame:
    reason = F.when(F.col("s_suppkey") % 3 != 0, "low balance").when(F.col("s_suppkey") % 2 == 0, " ")
    return t.supplier.select(F.col("s_name").alias("name"), F.expr(_HEALTH).alias("health"), reason.alias("reason"))


@query(f"SELECT s_name AS name, 'no_reason' AS problem FROM supplier WHERE {_HEALTH} <> 'healthy' AND s_suppkey % 3 = 0")
def health_without_reason(t: Tables) -> DataFrame:
    return runs.health_problems(_components(t))


@query(f"SELECT bool_and({_HEALTH} <> 'unhealthy') AS healthy, count(*) FILTER (WHERE {_HEALTH} = 'degraded') AS n_degraded FROM supplier")
def overall_health(t: Tables) -> DataFrame:
    return runs.overall_health(_components(t))


@query(f"SELECT s_name AS name FROM supplier WHERE {_HEALTH} = 'unhealthy'")
def quarantined_endpoints(t: Tables) -> DataFrame:
    return runs.quarantined(_components(t)).select("name")


@query(f"""SELECT c_custkey, CASE WHEN via = 'parent' THEN 'excluded by parent' WHEN via = 'override' THEN 'excluded by override' WHEN via = 'rule' AND selected THEN 'included by rule' WHEN via = 'rule' THEN 'excluded by rule' ELSE 'included by default (no rule matched)' END
|| CASE WHEN unknown THEN '; 1 undetermined: rich' ELSE '' END AS explanation FROM ({_COMPOSED})""")
def explanations(t: Tables) -> DataFrame:
    out = _customers(t)
    by = F.when(F.col("via") == "inherited", "default").otherwise(F.col("via"))
    verb = F.when(F.col("selected"), "include").otherwise("exclude")
    return out.select("c_custkey", runs.explanation(verb, by, F.col("via"), F.col("undetermined")).alias("explanation"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'click') AND user_id = 8")
def run_filters(t: Tables) -> DataFrame:
    return runs.filtered(t.events.select("event_id", "user_id", "event_type"), user_id=8, event_type=["error", "click"])


@query("""SELECT p_partkey FROM part WHERE p_size % 3 IN (0, 1) AND p_partkey % 4 = 0""")
def proposals_for_people(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size") % 3
    rows = t.part.select(k, F.when(n == 0, "proposed").when(n == 1, "ambiguous").otherwise("unmatched").alias("status"), F.when(k % 4 == 0, "pending").otherwise("confirm").alias("decision"))
    return runs.proposals_of(rows, needs_human=True).select("p_partkey")


_BIND = """b AS (SELECT c_custkey AS nid, c_custkey * 3 AS nk, c_acctbal > 5000 AS conf FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT c_custkey AS nid, CASE WHEN c_custkey % 10 = 3 THEN (c_custkey - 1) * 3 WHEN c_custkey % 50 IN (11, 15) THEN -(c_custkey // 50) - 1 ELSE c_custkey * 3 + 1 END AS nk, c_custkey % 4 = 1 AS conf FROM customer WHERE c_custkey % 3 <> 0),
cl AS (SELECT nk, min(nid) AS a, max(nid) AS z FROM n GROUP BY 1), f AS (SELECT n.*, coalesce(b.nid <> n.nid, false) OR a < z AS refused FROM n LEFT JOIN b USING (nk) JOIN cl USING (nk))"""


def _bound(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    fixed = [F.lit("src").alias("endpoint"), F.lit("dataset").alias("entity_type"), F.lit("t").alias("tenant_id")]
    before = t.customer.where(k % 2 == 0).select(*fixed, (k * 3).alias("native_key"), k.alias("neutral_id"), F.when(F.col("c_acctbal") > 5000, F.lit("2024-01-01").cast("timestamp_ntz")).alias("confirmed_at"))
    key = F.when(k % 10 == 3, (k - 1) * 3).when((k % 50).isin(11, 15), -F.floor(k / 50) - 1).otherwise(k * 3 + 1)
    new = t.customer.where(k % 3 != 0).select(*fixed, key.alias("native_key"), k.alias("neutral_id"), (k % 4 == 1).alias("confirmed"))
    return identity.bound_after(before, new, F.lit("2024-02-02").cast("timestamp_ntz"))


@query(f"""WITH {_BIND}, g AS (SELECT * FROM f WHERE NOT refused) SELECT coalesce(g.nid, b.nid) AS neutral_id, coalesce(g.nk, b.nk) AS native_key, CASE WHEN b.conf THEN TIMESTAMP '2024-01-01' WHEN g.conf THEN TIMESTAMP '2024-02-02' END AS confirmed_at FROM g FULL JOIN b ON g.nid = b.nid""")
def bind_identities(t: Tables) -> DataFrame:
    return _bound(t)[0].select("neutral_id", "native_key", "confirmed_at")


@query(f"WITH {_BIND} SELECT nid AS neutral_id, nk AS native_key FROM f WHERE refused")
def bindings_refused(t: Tables) -> DataFrame:
    return _bound(t)[1].select("neutral_id", "native_key")


@query("""SELECT c_custkey AS neutral_id, CASE WHEN c_acctbal > 5000 THEN TIMESTAMP '2024-01-01' WHEN c_custkey % 6 = 0 THEN TIMESTAMP '2024-03-03' END AS confirmed_at, false AS unknown FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, NULL, true FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0""")
def confirm_bindings(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    fixed = [k.alias("neutral_id"), F.lit("src").alias("endpoint"), F.lit("dataset").alias("entity_type")]
    before = t.customer.where(k % 2 == 0).select(*fixed, F.when(F.col("c_acctbal") > 5000, F.lit("2024-01-01").cast("timestamp_ntz")).alias("confirmed_at"))
    after, unknown = identity.confirmed_after(before, t.customer.where(k % 3 == 0).select(*fixed), F.lit("2024-03-03").cast("timestamp_ntz"))
    return after.select("neutral_id", "confirmed_at", F.lit(False).alias("unknown")).unionByName(unknown.select("neutral_id", F.lit(None).cast("timestamp_ntz").alias("confirmed_at"), F.lit(True).alias("unknown")))


@query("""
WITH o AS (SELECT user_id AS pair, 't' || max(event_id)::VARCHAR AS token, max(ts) AS run_at FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), n AS (SELECT user_id AS pair, arg_max({'t': CASE WHEN event_type <> 'view' THEN 'n' || event_id::VARCHAR END, 's': event_type}, ts) AS x, max(ts) AS run_at FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND user_id % 3 <> 0 GROUP BY 1)
SELECT coalesce(o.pair, n.pair) AS pair, CASE WHEN n.pair IS NULL THEN token ELSE coalesce(n.x.t, token) END AS token, CASE WHEN n.pair IS NULL THEN 'ok' ELSE n.x.s END AS status, coalesce(n.run_at, o.run_at) AS run_at FROM o FULL JOIN n ON o.pair = n.pair
""")
def advance_watermarks(t: Tables) -> DataFrame:
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    fixed = [F.col("user_id").alias("pair"), F.lit("src").alias("endpoint"), F.lit("dataset").alias("entity_type")]
    old = t.events.where(F.col("ts") < cut).groupBy(*fixed).agg(F.concat(F.lit("t"), F.max("event_id").cast("string")).alias("token"), F.lit("ok").alias("status"), F.max("ts").alias("run_at"))
    done = t.events.where((F.col("ts") >= cut) & (F.col("user_id") % 3 != 0)).select(*fixed, F.when(F.col("event_type") != "view", F.concat(F.lit("n"), _s("event_id"))).alias("token"), F.col("event_type").alias("status"), F.col("ts").alias("run_at"))
    return history.advanced(old, done).select("pair", "token", "status", "run_at")


_SEEN = "s AS (SELECT user_id, ts, CASE WHEN value > 60 THEN event_id::VARCHAR END AS nk FROM events WHERE event_type = 'error')"


def _orphan_log(t: Tables) -> DataFrame:
    errors = t.events.where("event_type = 'error'").select("user_id", F.col("ts").alias("at"), F.when(F.col("value") > 60, _s("event_id")).alias("native_key"), F.lit(None).cast("timestamp_ntz").alias("last_seen_at"))
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    empty = t.spark.createDataFrame([], "user_id long, native_key string, last_seen_at timestamp_ntz, first_missing_at timestamp_ntz, last_missing_at timestamp_ntz, resolved_at timestamp_ntz")
    first = history.record_orphans(empty, errors.where(F.col("at") < cut), ["user_id"])
    return history.record_orphans(first, errors.where(F.col("at") >= cut), ["user_id"])


@query(f"WITH {_SEEN} SELECT user_id, arg_max(nk, CASE WHEN nk IS NOT NULL THEN ts END) AS native_key, min(ts) AS first_missing_at, max(ts) AS last_missing_at FROM s GROUP BY 1")
def record_orphans(t: Tables) -> DataFrame:
    return _orphan_log(t).select("user_id", "native_key", "first_missing_at", "last_missing_at")


@query("""WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), g AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-29')
SELECT l.user_id, CASE WHEN g.user_id IS NOT NULL THEN TIMESTAMP '2024-02-01' END AS resolved_at, CASE WHEN g.user_id IS NOT NULL THEN TIMESTAMP '2024-02-01' END AS last_seen_at FROM l LEFT JOIN g ON l.user_id = g.user_id""")
def resolve_orphans(t: Tables) -> DataFrame:
    seen = t.events.where("event_type = 'purchase' AND ts > TIMESTAMP_NTZ '2024-01-29'").select("user_id")
    return history.resolved(_orphan_log(t), seen, ["user_id"], F.lit("2024-02-01").cast("timestamp_ntz")).select("user_id", "resolved_at", "last_seen_at")


@query("""WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 60), p AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 100) AS here FROM events WHERE ts > TIMESTAMP '2024-01-28' GROUP BY 1)
SELECT l.user_id, CASE WHEN here IS NULL THEN 'inconclusive' WHEN here THEN 'resolved' ELSE 'still_missing' END AS finding FROM l JOIN b ON l.user_id = b.user_id LEFT JOIN p ON p.user_id = l.user_id""")
def recheck_orphans(t: Tables) -> DataFrame:
    bindings = t.events.where("event_type = 'signup' AND value > 60").select("user_id").distinct()
    presence = t.events.where("ts > TIMESTAMP_NTZ '2024-01-28'").groupBy("user_id").agg(F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("here"))
    return history.rechecked(_orphan_log(t), bindings, presence, ["user_id"])





@query(f"""WITH {_ITEMS}, i2 AS (SELECT user_id, count(*) FILTER (WHERE h OR o IN ('orphaned', 'failed') OR len(u) > 0) AS a, count(*) FILTER (WHERE event_type = 'error') AS b, min(ts) AS lo FROM i GROUP BY 1), j AS (SELECT *, user_id % 7 <> 0 AND lo < TIMESTAMP '2024-01-01 03:00:00' AS swept FROM i2)
SELECT user_id AS run_id, a + b + swept::BIGINT AS issues_recorded, a + b + swept::BIGINT > 0 AS has_issues, swept AS swept_stale FROM j""")
def run_issue_counts(t: Tables) -> DataFrame:
    given, records, errors = _run_tables(t)
    begun = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.min(F.col("ts").cast("timestamp")).alias("started_at"))
    after, reaped = runs.reaped(given.drop("started_at").join(begun, "run_id"), F.lit("2024-01-01 04:00:00").cast("timestamp"), older_than_s=3600)
    return runs.issue_counts(after, runs.run_items(records, F.lit("src")), errors.select("run_id", "kind").unionByName(reaped.select("run_id", "kind")))


@query("""
WITH k AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS package FROM orders), d AS (SELECT id, unnest([id - 1, id + 2]) AS dep FROM k WHERE id % 2 = 0), m AS (SELECT d.id, bool_and(coalesce(k.s = 'F', false)) AS met FROM d LEFT JOIN k ON k.id = dep GROUP BY 1),
r AS (SELECT k.*, s = 'O' AND coalesce(met, true) AS ready FROM k LEFT JOIN m USING (id))
SELECT package, count(*) AS n_tasks, count(*) FILTER (WHERE ready) AS n_ready, max(id) FILTER (WHERE ready) AS next_ready FROM r GROUP BY 1
""")
def task_board(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("active")
    deps = F.when(k % 2 == 0, F.array(k - 1, k + 2)).otherwise(F.array().cast("array<bigint>"))
    return history.board(t.orders.select(k.alias("id"), (-k).alias("number"), F.col("o_orderpriority").alias("package"), status.alias("status"), deps.alias("deps")))
