"""Queries of rule tables, places and pages, confirmations, folded changes and recovered conflicts, with DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import text as T
from ..operators import folding, history, identity, parties, payloads, ranks, rule_table, runs, spread
from ..sources import catalogs, reads
from .catalogue import Tables, _s, query
from .catalogue_config import _FRESH, _OLD, _listed, _tree
from .cycle import Options, plan_cycle

# rules as rows

#: Every fourth part is a rule; its pattern, and so its index, is made from its own values.
_RULES = """SELECT 'r' || p_partkey::VARCHAR AS rule_id, p_partkey::INTEGER AS ordinal, CASE WHEN p_size % 3 = 0 THEN 'exclude' ELSE 'include' END AS decision,
CASE WHEN p_partkey % 16 = 4 THEN 'tag' WHEN p_partkey % 16 = 8 THEN 'owner' ELSE 'glob' END AS kind,
CASE WHEN p_partkey % 16 = 4 THEN CASE WHEN p_size % 2 = 0 THEN p_brand || '=' || p_size::VARCHAR ELSE p_brand || p_size::VARCHAR END WHEN p_partkey % 16 = 8 THEN 'U' || (p_size % 10)::VARCHAR || '?@*.com'
WHEN p_size % 6 = 0 THEN p_type || '.' || replace(p_name, ' ', '_') || '_' || (p_partkey % 7)::VARCHAR || '*' WHEN p_size % 6 = 1 THEN '*.*' || substr(p_name, 2, 5) || '_*' || (p_partkey % 9)::VARCHAR
WHEN p_size % 6 = 2 THEN substr(p_type, 1, 3) || '*.[!a-m]*_' || (p_partkey % 100)::VARCHAR WHEN p_size % 6 = 3 THEN '*[A-E]*.*_' || (p_partkey % 1000)::VARCHAR WHEN p_size % 6 = 4 THEN p_type || '.?' || replace(substr(p_name, 2), ' ', '_') || '_??' ELSE '*.*_1?' || (p_size % 5)::VARCHAR END AS pattern
FROM part WHERE p_partkey % 4 = 0"""
_NAMES = """SELECT p_partkey AS id, CASE WHEN p_size % 11 <> 0 THEN p_type || '.' || replace(p_name, ' ', '_') || '_' || p_partkey::VARCHAR END AS n, CASE WHEN p_size % 13 <> 0 THEN [p_brand, p_brand || p_size::VARCHAR] END AS tk, p_size::VARCHAR AS tv,
CASE WHEN p_size % 17 <> 0 THEN 'u' || (p_partkey % 200)::VARCHAR || '@x' || (p_size % 3)::VARCHAR || '.com' END AS o FROM part"""


def _rules(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    part, text = size % 6, lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    named = F.translate("p_name", " ", "_")
    glob = (
        F.when(part == 0, text(F.col("p_type"), ".", named, "_", k % 7, "*")).when(part == 1, text("*.*", F.substring("p_name", 2, 5), "_*", k % 9))
        .when(part == 2, text(F.substring("p_type", 1, 3), "*.[!a-m]*_", k % 100)).when(part == 3, text("*[A-E]*.*_", k % 1000))
        .when(part == 4, text(F.col("p_type"), ".?", F.translate(F.expr("substring(p_name, 2)"), " ", "_"), "_??")).otherwise(text("*.*_1?", size % 5))
    )
    tag = F.when(size % 2 == 0, text(F.col("p_brand"), "=", size)).otherwise(text(F.col("p_brand"), size))
    kind = F.when(k % 16 == 4, "tag").when(k % 16 == 8, "owner").otherwise("glob")
    pattern = F.when(k % 16 == 4, tag).when(k % 16 == 8, text("U", size % 10, "?@*.com")).otherwise(glob)
    return t.part.where(k % 4 == 0).select(text("r", k).alias("rule_id"), k.cast("int").alias("ordinal"), F.lit("object").alias("scope"), F.when(size % 3 == 0, "exclude").otherwise("include").alias("decision"), kind.alias("kind"), pattern.alias("pattern"))


@query(f"""
WITH r AS ({_RULES}), n AS ({_NAMES}),
h AS (SELECT n.id, r.ordinal, r.rule_id, r.decision FROM n, r WHERE (r.kind = 'glob' AND n.n GLOB r.pattern) OR (r.kind = 'owner' AND n.o GLOB lower(r.pattern))
  OR (r.kind = 'tag' AND (list_contains(n.tk, r.pattern) OR (contains(r.pattern, '=') AND n.tk[1] = split_part(r.pattern, '=', 1) AND n.tv = split_part(r.pattern, '=', 2))))),
b AS (SELECT id, arg_max(rule_id, ordinal) AS rule_id, arg_max(decision, ordinal) AS decision FROM h GROUP BY 1),
u AS (SELECT n.id, sha256(string_agg(r.rule_id, ',' ORDER BY r.ordinal)) AS u FROM n, r WHERE (r.kind = 'glob' AND n.n IS NULL) OR (r.kind = 'tag' AND n.tk IS NULL) OR (r.kind = 'owner' AND n.o IS NULL) GROUP BY 1)
SELECT n.id AS p_partkey, coalesce(b.decision, 'exclude') AS decision, CASE WHEN b.id IS NULL THEN 'default' ELSE 'rule' END AS decided_by, b.rule_id, coalesce(u, sha256('')) AS undetermined FROM n LEFT JOIN b USING (id) LEFT JOIN u USING (id)
""")
def rules_as_table(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(size % 11 != 0, F.concat("p_type", F.lit("."), F.translate("p_name", " ", "_"), F.lit("_"), _s("p_partkey")))
    tags = F.when(size % 13 != 0, F.array(F.struct(F.col("p_brand").alias("key"), _s("p_size").alias("value")), F.struct(F.concat("p_brand", _s("p_size")).alias("key"), F.lit(None).cast("string").alias("value"))))
    owner = F.concat(F.lit("u"), (k % 200).cast("string"), F.lit("@x"), (size % 3).cast("string"), F.lit(".com"))
    objects = t.part.select(k, name.alias("name"), tags.alias("tags"), F.when(size % 17 != 0, F.array(owner)).alias("owners"))
    out = rule_table.decide_by_table(objects, _rules(t), scope="object", name=F.col("name"), tags=F.col("tags"), owners=F.col("owners"), id_col="p_partkey", told=lambda ids: F.sha2(F.array_join(ids, ","), 256))
    return out.select("p_partkey", "decision", "decided_by", "rule_id", "undetermined")


@query("""
WITH r AS (SELECT 'r' || (p_partkey - CASE WHEN p_partkey % 50 = 1 THEN 1 ELSE 0 END)::VARCHAR AS rule_id, (p_partkey - CASE WHEN p_partkey % 70 = 1 THEN 1 ELSE 0 END)::INTEGER AS ordinal, CASE WHEN p_size % 9 = 0 THEN 'space' WHEN p_size % 2 = 0 THEN 'object' ELSE 'dataset' END AS scope,
  CASE WHEN p_size % 10 = 0 THEN 'like' WHEN p_size % 5 = 0 THEN 'tag' WHEN p_size % 7 = 0 THEN 'owner' ELSE 'glob' END AS kind, CASE WHEN p_size % 5 = 0 AND p_size % 3 = 0 THEN '=x' WHEN p_size % 7 = 0 AND p_size % 4 = 0 THEN ' ' WHEN p_size % 4 = 1 THEN p_type || '.' || p_name ELSE p_type || '.' || replace(p_name, ' ', '_*') END AS pattern FROM part),
f AS (SELECT *, CASE WHEN kind = 'glob' THEN regexp_full_match(pattern, CASE scope WHEN 'object' THEN '[A-Za-z0-9_*?\\[\\]!]+\\.[A-Za-z0-9_*?\\[\\]!]+' ELSE '[A-Za-z0-9_*?\\[\\]!]+\\.[A-Za-z0-9_*?\\[\\]!]+\\.[A-Za-z0-9_*?\\[\\]!]+' END) ELSE trim(pattern) <> '' AND NOT (kind = 'tag' AND starts_with(pattern, '=')) END AS fine FROM r)
SELECT rule_id, 'duplicate_id' AS fault FROM r GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT rule_id, 'duplicate_ordinal' FROM r JOIN (SELECT scope, ordinal FROM r GROUP BY 1, 2 HAVING count(*) > 1) USING (scope, ordinal)
UNION ALL SELECT rule_id, 'unknown_scope' FROM r WHERE scope = 'space' UNION ALL SELECT rule_id, 'unknown_kind' FROM r WHERE kind = 'like' UNION ALL SELECT rule_id, 'malformed_pattern' FROM f WHERE scope <> 'space' AND NOT fine
""")
def rule_faults(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    rule_id = F.concat(F.lit("r"), (k - F.when(k % 50 == 1, 1).otherwise(0)).cast("string"))
    kind = F.when(size % 10 == 0, "like").when(size % 5 == 0, "tag").when(size % 7 == 0, "owner").otherwise("glob")
    wild = F.concat("p_type", F.lit("."), F.when(size % 4 == 1, F.col("p_name")).otherwise(F.regexp_replace("p_name", " ", "_*")))
    pattern = F.when((size % 5 == 0) & (size % 3 == 0), "=x").when((size % 7 == 0) & (size % 4 == 0), " ").otherwise(wild)
    scope = F.when(size % 9 == 0, "space").when(size % 2 == 0, "object").otherwise("dataset")
    return rule_table.faults(t.part.select(rule_id.alias("rule_id"), (k - F.when(k % 70 == 1, 1).otherwise(0)).cast("int").alias("ordinal"), scope.alias("scope"), F.lit("include").alias("decision"), kind.alias("kind"), pattern.alias("pattern")))


# places in an order, and pages


@query(f"WITH a AS ({_FRESH}), b AS ({_OLD}), c AS (SELECT coalesce(a.key, b.key) AS key, a.key IS NULL AS d FROM a FULL JOIN b ON a.key = b.key WHERE a.checksum IS DISTINCT FROM b.checksum) SELECT key, row_number() OVER (ORDER BY d, key) AS place FROM c")
def changes_in_order(t: Tables) -> DataFrame:
    changes = _listed(t)[0].select("key", (F.col("change") == "deleted").alias("deleted"))
    return ranks.ranked(changes, ["deleted", "key"], rows_per_range=2000).select("key", "place")


@query("WITH o AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r, count(*) OVER () AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice, n > n // 2 + 500 AS more FROM o WHERE r > n // 2 AND r <= n // 2 + 500")
def deep_page(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", (-F.col("l_extendedprice")).alias("down"))
    out, more = ranks.page(rows, ["down", "l_orderkey", "l_linenumber"], t.lineitem.count() // 2, 500, rows_per_range=10_000)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", F.lit(more).alias("more"))


# confirmations that see each other

_DECISIONS = "SELECT c_custkey AS o, c_custkey // 8 AS g, c_custkey % 8 AS i, c_custkey // 8 * 10 + floor(abs(c_acctbal))::BIGINT % 4 AS n, c_custkey // 8 * 10 + c_nationkey % 4 AS k FROM customer"


@query(f"""
WITH RECURSIVE d AS ({_DECISIONS}), r AS (SELECT DISTINCT g, -1::BIGINT AS i, NULL::BIGINT AS o, []::BIGINT[] AS ns, []::BIGINT[] AS ks, '' AS result FROM d UNION ALL
  SELECT s.g, s.i, s.o, CASE WHEN s.result = 'bound' THEN list_append(ns, n) ELSE ns END, CASE WHEN s.result = 'bound' THEN list_append(ks, k) ELSE ks END, s.result
  FROM (SELECT r.g, r.i + 1 AS i, d.o, ns, ks, d.n, d.k, CASE WHEN d.o IS NULL THEN '' WHEN list_contains(ns, d.n) THEN CASE WHEN ks[list_position(ns, d.n)] = d.k THEN 'already_bound' ELSE 'conflict' END WHEN list_contains(ks, d.k) THEN 'conflict' ELSE 'bound' END AS result FROM r LEFT JOIN d ON d.g = r.g AND d.i = r.i + 1 WHERE r.i < 7) AS s)
SELECT o AS c_custkey, result FROM r WHERE o IS NOT NULL
""")
def confirm_in_order(t: Tables) -> DataFrame:
    group = F.floor(F.col("c_custkey") / 8) * 10
    decisions = t.customer.select("c_custkey", (group + F.floor(F.abs("c_acctbal")) % 4).alias("neutral_id"), (group + F.col("c_nationkey") % 4).alias("target_key"), F.lit("proposed").alias("status"), F.lit(None).cast("long").alias("chosen"))
    none = t.spark.createDataFrame([], "neutral_id long, native_key long")
    return identity.confirm(decisions, none, order="c_custkey").select("c_custkey", "result")


_CANDIDATES = """s AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 2 = 0), g AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 2 = 1), b AS (SELECT p_partkey AS source_id, p_partkey + 1 AS target_id FROM part WHERE p_partkey % 20 = 0)"""


@query(f"""
WITH {_CANDIDATES}, c AS (SELECT p_partkey AS source_id, p_partkey + 1 + 2 * (p_size % 9) AS target_id FROM part WHERE p_partkey % 2 = 0)
SELECT c.source_id, c.target_id, coalesce(s.name = g.name AND c.source_id NOT IN (SELECT source_id FROM b) AND c.target_id NOT IN (SELECT target_id FROM b), false) AS is_candidate FROM c LEFT JOIN s ON s.id = c.source_id LEFT JOIN g ON g.id = c.target_id
""")
def choice_is_candidate(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    side = lambda odd: t.part.where(k % 2 == odd).select(k.alias("id"), F.col("p_name").alias("name"), F.lit(1).alias("parent"))
    bound = t.part.where(k % 20 == 0).select(k.alias("source_id"), (k + 1).alias("target_id"))
    choices = t.part.where(k % 2 == 0).select(k.alias("source_id"), (k + 1 + 2 * (F.col("p_size") % 9)).alias("target_id"))
    return identity.chosen(choices, side(0), side(1), bound, "name", ["parent"])


@query("SELECT replace(r_name, ' ', '_') || '.' || n_name AS full_name, c_name AS table_id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND n_nationkey % 2 = 0")
def product_members(t: Tables) -> DataFrame:
    schemas, tables = _tree(t)
    refs = t.nation.where(F.col("n_nationkey") % 2 == 0).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(".", F.translate("r_name", " ", "_"), "n_name").alias("full_name"))
    return reads.product_members(schemas, tables, refs, ["ASIA.*"])


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND value >= 40")
def held_records(t: Tables) -> DataFrame:
    holds = (F.col("event_type") == "error") & (F.col("value") >= 40)
    return runs.held(t.events.select("event_id", "user_id", "event_type", holds.alias("holds"))).drop("holds")


# several changes of one object

_FOLD = """c AS (SELECT o_custkey, 'status' AS field, o_orderkey AS seq, o_orderstatus AS value, o_orderpriority <> '1-URGENT' AS writable FROM orders UNION ALL SELECT o_custkey, 'priority', o_orderkey, o_orderpriority, o_totalprice > 150000 FROM orders),
s AS (SELECT c_custkey AS o_custkey, 'status' AS field, CASE WHEN c_acctbal > 5000 THEN 'F' ELSE 'O' END AS value FROM customer WHERE c_custkey % 3 = 0),
w AS (SELECT c.*, coalesce(last_value(CASE WHEN writable THEN c.value END IGNORE NULLS) OVER (PARTITION BY c.o_custkey, c.field ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s.value) AS previous FROM c LEFT JOIN s ON s.o_custkey = c.o_custkey AND s.field = c.field),
f AS (SELECT *, previous IS DISTINCT FROM value AS changed, previous IS DISTINCT FROM value AND writable AS written FROM w)"""


def _folded(t: Tables) -> tuple[DataFrame, DataFrame, int]:
    field = lambda name, value, writable: t.orders.select("o_custkey", F.lit(name).alias("field"), F.col("o_orderkey").alias("seq"), F.col(value).alias("value"), writable.alias("writable"))
    changes = field("status", "o_orderstatus", F.col("o_orderpriority") != "1-URGENT").unionAll(field("priority", "o_orderpriority", F.col("o_totalprice") > 150000))
    stored = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("status").alias("field"), F.when(F.col("c_acctbal") > 5000, "F").otherwise("O").alias("value"))
    summed = lambda df: df.withColumn("checksum", C.checksum(F.col("value")))
    n = spread.parts(changes, stored)
    return folding.folded_fields(summed(changes), summed(stored), ["o_custkey"], width=4000, n=n), summed(stored), n


@query(f"WITH {_FOLD} SELECT o_custkey, field, seq, value, previous, changed, written FROM f")
def read_your_writes(t: Tables) -> DataFrame:
    return _folded(t)[0].select("o_custkey", "field", "seq", "value", "previous", "changed", "written")


@query(f"""
WITH {_FOLD}, r AS (SELECT o_custkey, seq, count(*) FILTER (WHERE changed) AS n_changes, count(*) FILTER (WHERE written) AS n_writes FROM f GROUP BY 1, 2), k AS (SELECT o_custkey, min(seq) AS first FROM f WHERE written GROUP BY 1)
SELECT r.o_custkey, seq, CASE WHEN seq = first AND r.o_custkey NOT IN (SELECT o_custkey FROM s) THEN 'created' WHEN n_writes > 0 THEN 'written' WHEN n_changes = 0 THEN 'unchanged' ELSE 'skipped' END AS outcome, n_changes, n_writes FROM r LEFT JOIN k ON k.o_custkey = r.o_custkey
""")
def records_of_each_change(t: Tables) -> DataFrame:
    fields, stored, n = _folded(t)
    return folding.folded_records(fields, stored, ["o_custkey"], n=n)


# a conflict, once

_CONFLICT = """x AS (SELECT o_orderkey, 'status' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders),
l AS (SELECT l_orderkey AS o_orderkey, 'status' AS field, max(l_linestatus) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, 'priority', CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END FROM orders),
v AS (SELECT l_orderkey AS o_orderkey, CASE WHEN bool_or(l_returnflag = 'A') THEN 'rev-' || max(l_linenumber)::VARCHAR END AS revision FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'conflict' ELSE 'written' END AS reply, CASE WHEN o_orderpriority = '5-LOW' THEN 'conflict' ELSE 'written' END AS again FROM orders),
a AS (SELECT x.o_orderkey, x.field, x.value, v.revision, CASE WHEN v.revision IS NULL THEN 'unguarded' WHEN l.value IS NOT DISTINCT FROM x.value THEN 'already' ELSE 'resend' END AS action
  FROM x JOIN p ON p.o_orderkey = x.o_orderkey AND reply = 'conflict' LEFT JOIN l ON l.o_orderkey = x.o_orderkey AND l.field = x.field LEFT JOIN v ON v.o_orderkey = x.o_orderkey)"""


def _conflict(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    field = lambda name, value: t.orders.select("o_orderkey", F.lit(name).alias("field"), F.col(value).alias("value"))
    summed = lambda df: df.withColumn("checksum", C.checksum(F.col("value")))
    replies = t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "conflict").otherwise("written").alias("reply"))
    retried = t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "conflict").otherwise("written").alias("reply"))
    n = spread.parts(t.lineitem, t.orders)
    met = spread.dealt(replies.where("reply = 'conflict'").select("o_orderkey"), n, ["o_orderkey"])
    sent = summed(spread.dealt(field("status", "o_orderstatus").unionAll(field("priority", "o_orderpriority")), n, ["o_orderkey"]).join(met, "o_orderkey", "left_semi"))
    lines = spread.dealt(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus", "l_returnflag", "l_linenumber"), n, ["o_orderkey"]).groupBy("o_orderkey")
    live = lines.agg(F.max("l_linestatus").alias("value")).select("o_orderkey", F.lit("status").alias("field"), "value")
    live = live.unionAll(t.orders.select("o_orderkey", F.lit("priority"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))))
    revisions = lines.agg(F.when(F.bool_or(F.col("l_returnflag") == "A"), F.concat(F.lit("rev-"), F.max("l_linenumber").cast("string"))).alias("revision"))
    return payloads.after_conflict(sent, summed(live), revisions, ["o_orderkey"], n=n), replies, retried


@query(f"WITH {_CONFLICT} SELECT o_orderkey, field, value, revision, action FROM a")
def fields_after_conflict(t: Tables) -> DataFrame:
    return _conflict(t)[0].drop("checksum")


@query(f"""
WITH {_CONFLICT}, s AS (SELECT o_orderkey, max(revision) AS revision, count(*) FILTER (WHERE action = 'resend') AS n_resent, count(*) FILTER (WHERE action = 'already') AS n_already FROM a GROUP BY 1)
SELECT o_orderkey, CASE WHEN reply <> 'conflict' THEN reply WHEN revision IS NULL THEN 'conflict_unresolved' WHEN n_resent = 0 THEN 'no_op' WHEN again = 'conflict' THEN 'conflict_unresolved' ELSE again END AS outcome, revision, coalesce(n_resent, 0) AS n_resent, coalesce(n_already, 0) AS n_already FROM p LEFT JOIN s USING (o_orderkey)
""")
def conflict_recovery(t: Tables) -> DataFrame:
    fields, replies, retried = _conflict(t)
    return payloads.recovered(replies, fields, retried, ["o_orderkey"])


# wider data for older operators


@query("""
WITH k AS (SELECT c_custkey AS key, e AS entity_type FROM customer, (VALUES ('dataset'), ('data_product')) AS v(e)), n AS (SELECT key, entity_type, 'name' AS field, CASE entity_type WHEN 'dataset' THEN c_name ELSE c_mktsegment END AS value FROM k JOIN customer ON c_custkey = key),
o AS (SELECT key, entity_type, field, CASE WHEN c_nationkey % 3 = 0 AND entity_type = 'dataset' THEN 'old' WHEN c_nationkey % 5 = 0 AND entity_type = 'data_product' THEN 'old' ELSE value END AS value FROM n JOIN customer ON c_custkey = key WHERE c_nationkey <> 7 OR entity_type = 'dataset')
SELECT n.key, n.entity_type, CASE WHEN n.key % 23 = 0 AND n.entity_type = 'dataset' THEN 'filtered' WHEN n.value IS DISTINCT FROM o.value THEN 'written' ELSE 'unchanged' END AS outcome, o.value AS previous FROM n LEFT JOIN o USING (key, entity_type)
""")
def cycle_of_two_types(t: Tables) -> DataFrame:
    """Data sets and data products of the same keys."""
    kinds = t.customer.select("*", F.explode(F.array(F.lit("dataset"), F.lit("data_product"))).alias("entity_type"))
    dataset, nation = F.col("entity_type") == "dataset", F.col("c_nationkey")
    value = F.when(dataset, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    old = F.when((nation % 3 == 0) & dataset, "old").when((nation % 5 == 0) & ~dataset, "old").otherwise(value)
    fields = lambda df, v: df.select(F.col("c_custkey").alias("key"), "entity_type", F.lit("name").alias("field"), v.alias("value"), C.checksum(v).alias("checksum"))
    source, stored = fields(kinds, value), fields(kinds.where((nation != 7) | dataset), old)
    changes = kinds.select(F.col("c_custkey").alias("key"), "entity_type", ((F.col("c_custkey") % 23 != 0) | ~dataset).alias("selected"), F.lit(False).alias("deleted"), F.lit(True).alias("bound"), F.lit("confirmed").alias("target"))
    manifest = t.spark.createDataFrame([(e, "name", True, "rw", True, True) for e in ("dataset", "data_product")], "entity_type string, field string, supported boolean, mode string, partial_update boolean, path_allowed boolean")
    records, _ = plan_cycle(changes, source, stored, stored.limit(0), manifest, Options())
    return records.select("key", "entity_type", "outcome").join(stored.select("key", "entity_type", F.col("value").alias("previous")), ["key", "entity_type"], "left")


@query("""
WITH n AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE c_nationkey % 4 WHEN 0 THEN chr(9) || c_mktsegment || chr(160) WHEN 1 THEN chr(8195) || 'U' || c_custkey::VARCHAR || '@X.org' || chr(10) WHEN 2 THEN chr(9) || chr(160) ELSE c_name END AS t FROM customer)
SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN 'u' || c_custkey::VARCHAR || '@x.org' WHEN 2 THEN '' ELSE lower(t) END AS normal, CASE WHEN c_nationkey % 4 = 1 THEN 'U' || c_custkey::VARCHAR || '@X.org' END AS email, CASE c_nationkey % 4 WHEN 0 THEN c_mktsegment WHEN 3 THEN t END AS display_name FROM n
""")
def white_space_of_all_kinds(t: Tables) -> DataFrame:
    kind = F.col("c_nationkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("\t"), "c_mktsegment", F.lit("\xa0"))).when(kind == 1, F.concat(F.lit(" U"), _s("c_custkey"), F.lit("@X.org\n"))).when(kind == 2, F.lit("\t\xa0")).otherwise(F.col("c_name"))
    owner = T.owner_party(text)
    return t.customer.select("c_custkey", C.normal_name(text).alias("normal"), owner["email"].alias("email"), owner["display_name"].alias("display_name"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN rpad(((1 + event_id % 9))::VARCHAR, 21, '0') WHEN 1 THEN (event_id % 7 + 1)::VARCHAR || 'e-' || lpad((event_id % 90 + 7)::VARCHAR, 2, '0') WHEN 2 THEN event_id::VARCHAR ELSE '0.' || (event_id % 1000 + 1000)::VARCHAR || '1' END AS text FROM events""")
def numbers_of_all_sizes(t: Tables) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 4 == 0, F.concat((k % 9 + 1).cast("string"), F.lit("e20"))).when(k % 4 == 1, F.concat((k % 7 + 1).cast("string"), F.lit("e-"), (k % 90 + 7).cast("string"))).when(k % 4 == 2, k.cast("string"))
    text = text.otherwise(F.concat(F.lit("0."), (k % 1000 + 1000).cast("string"), F.lit("1")))
    return t.events.select("event_id", C.number_text(text.cast("double")).alias("text"))


# people, orphans, neutral entities


@query("""
WITH s AS (SELECT c_custkey AS party, CASE WHEN c_nationkey % 4 = 0 THEN c_mktsegment END AS name, CASE WHEN c_nationkey % 3 <> 0 THEN 'u' || (c_custkey % 400)::VARCHAR || '@example.com' END AS email, CASE c_nationkey % 2 WHEN 0 THEN 'owner' ELSE 'steward' END AS role, c_custkey AS pos FROM customer),
t AS (SELECT s_suppkey % 7 AS party, CASE WHEN s_nationkey % 2 = 0 THEN 'Ann' END AS name, CASE WHEN s_nationkey % 3 <> 1 THEN 'u' || (s_suppkey * 5)::VARCHAR || '@example.com' END AS email, 'contact' AS role, s_suppkey AS pos FROM supplier),
x AS (SELECT 'source' AS side, * FROM s UNION ALL SELECT 'target', * FROM t), f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY side, email, CASE WHEN email IS NULL THEN [coalesce(name, ''), party::VARCHAR, role] END ORDER BY pos) = 1)
SELECT side, email, party, name, role, coalesce(name, party::VARCHAR) AS label, CASE WHEN email IS NULL THEN 'no_email' ELSE 'no_match' END AS reason FROM f WHERE email IS NULL OR NOT EXISTS (SELECT 1 FROM x WHERE x.side <> f.side AND x.email = f.email)
""")
def unmatched_parties(t: Tables) -> DataFrame:
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    email = lambda n: F.concat(F.lit("u"), n.cast("string"), F.lit("@example.com"))
    source = t.customer.select(k.alias("party"), F.when(nation % 4 == 0, F.col("c_mktsegment")).alias("name"), F.when(nation % 3 != 0, email(k % 400)).alias("email"), F.when(nation % 2 == 0, "owner").otherwise("steward").alias("role"), k.alias("pos"))
    s, nation = F.col("s_suppkey"), F.col("s_nationkey")
    target = t.supplier.select((s % 7).alias("party"), F.when(nation % 2 == 0, "Ann").alias("name"), F.when(nation % 3 != 1, email(s * 5)).alias("email"), F.lit("contact").alias("role"), s.alias("pos"))
    return parties.unmatched(source, target)


@query("""
WITH l AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi, bool_or(event_type = 'purchase' AND value > 150) AS back FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1)
SELECT user_id, CASE WHEN hi > lo AND floor(epoch(hi)) - floor(epoch(lo)) >= 864000 THEN 'confirmed' ELSE 'tentative' END AS confidence, (epoch(TIMESTAMP '2025-01-01') - floor(epoch(lo)))::BIGINT AS missing_for_s, (epoch(TIMESTAMP '2025-01-01') - floor(epoch(hi)))::BIGINT AS checked_ago_s FROM l WHERE NOT back
""")
def orphan_advisories(t: Tables) -> DataFrame:
    seen = t.events.where(F.col("event_type").isin("error", "purchase")).withColumn("at", F.col("ts").cast("timestamp"))
    log = seen.groupBy("user_id").agg(F.min("at").alias("first_missing_at"), F.max("at").alias("last_missing_at"), F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 150), F.col("at"))).alias("resolved_at"))
    return history.orphan_advisories(log, F.lit("2025-01-01").cast("timestamp"), confirm_after_s=864_000).select("user_id", "confidence", "missing_for_s", "checked_ago_s")


_PRODUCTS = """p AS (SELECT n_nationkey, replace(r_name, ' ', '_') || '.' || n_name AS full_name, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey)"""


def _products(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    raw = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws(".", F.translate("r_name", " ", "_"), "n_name").alias("full_name"), F.col("n_name").alias("name"), k.cast("string").alias("schema_id"), F.lit("m").alias("metastore_id"), F.when(k % 2 == 0, F.col("r_name")).otherwise("\t ").alias("comment"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), "n_name", F.lit("@x.org"))).when(k % 3 == 1, F.col("n_name")).alias("owner"), F.create_map(F.lit("owner"), F.col("n_name"), F.lit("region"), F.col("r_name")).alias("properties"),
    )
    tags = t.supplier.join(t.nation, F.col("s_nationkey") == k).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.translate("r_name", " ", "_").alias("catalog_name"), F.col("n_name").alias("schema_name"), F.concat(F.lit("t"), (F.col("s_suppkey") % 3).cast("string")).alias("tag_name"), F.lit("v").alias("tag_value"))
    regions = [r[0] for r in t.region.select(F.translate("r_name", " ", "_")).collect()]
    return catalogs.data_products(raw, "src", catalogs.tags_of(t.spark, tags, "schema_tags", regions))


@query(f"""
WITH {_PRODUCTS}, g AS (SELECT s_nationkey, string_agg(DISTINCT 't' || (s_suppkey % 3)::VARCHAR, ',' ORDER BY 't' || (s_suppkey % 3)::VARCHAR) AS tags FROM supplier GROUP BY 1)
SELECT full_name, n_nationkey::VARCHAR AS native_key, CASE WHEN n_nationkey % 2 = 0 THEN r_name END AS description, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '@x.org' END AS email, CASE WHEN n_nationkey % 3 = 1 THEN n_name END AS display_name, coalesce(tags, '') AS tags, r_name AS attributes FROM p LEFT JOIN g ON s_nationkey = n_nationkey
""")
def products_neutral(t: Tables) -> DataFrame:
    owner = F.get("owners", F.lit(0))
    attributes = F.array_join(F.map_values("custom_attributes"), ",")
    return _products(t).select("full_name", "native_key", "description", owner["email"].alias("email"), owner["display_name"].alias("display_name"), F.array_join(F.transform("tags", lambda x: x["key"]), ",").alias("tags"), attributes.alias("attributes"))


@query(f"""
WITH {_PRODUCTS}, h AS (SELECT *, sha256('src' || chr(31) || 'data_product' || chr(31) || 'm' || chr(31) || n_nationkey::VARCHAR) AS x FROM p), d AS (SELECT c_nationkey, sha256('src' || chr(31) || 'dataset' || chr(31) || 'm' || chr(31) || c_custkey::VARCHAR) AS y FROM customer)
SELECT substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-' || substr(x, 17, 4) || '-' || substr(x, 21, 12) AS product_id, substr(y, 1, 8) || '-' || substr(y, 9, 4) || '-' || substr(y, 13, 4) || '-' || substr(y, 17, 4) || '-' || substr(y, 21, 12) AS dataset_id FROM h JOIN d ON c_nationkey = n_nationkey
""")
def product_dataset_refs(t: Tables) -> DataFrame:
    own = t.customer.join(_products(t).select(F.col("native_key").cast("int").alias("c_nationkey"), "full_name"), "c_nationkey")
    datasets = own.select(F.lit("src").alias("endpoint"), F.lit("dataset").alias("entity_type"), F.lit("m").alias("tenant_id"), _s("c_custkey").alias("native_key"), F.concat_ws(".", "full_name", "c_name").alias("full_name"))
    return catalogs.dataset_refs(_products(t), datasets)


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN p_type || '.' || p_brand ELSE p_type END ELSE p_type || '.' || p_name END AS full_name, p_brand || '.k' AS native_key,
CASE WHEN p_size % 3 = 0 AND p_size % 2 <> 0 THEN p_brand || '.k' WHEN p_size % 3 = 0 THEN p_type || '.' || p_brand ELSE p_type || '.' || p_name END AS name FROM part
""")
def qualified_names(t: Tables) -> DataFrame:
    size = F.col("p_size")
    full = F.when(size % 3 == 0, F.when(size % 2 == 0, F.concat_ws(".", "p_type", "p_brand")).otherwise(F.col("p_type"))).otherwise(F.concat_ws(".", "p_type", "p_name"))
    rows = t.part.select("p_partkey", full.alias("full_name"), F.concat("p_brand", F.lit(".k")).alias("native_key"))
    return rows.withColumn("name", T.qualified_name(F.col("full_name"), F.col("native_key"), 2))


@query("""
WITH r AS (SELECT c_custkey, c_name, CASE WHEN c_nationkey % 3 = 0 THEN ' ' || c_mktsegment || ' ' ELSE chr(9) END AS description, c_acctbal > 0 AS activated, 'u' || (c_custkey % 10)::VARCHAR AS owner,
  [('u' || (c_nationkey % 10)::VARCHAR, 'Data Steward'), ('u' || (c_custkey % 7)::VARCHAR, ' key CONTACT'), ('u' || (c_nationkey % 3)::VARCHAR, 'Co-Owner')] AS k FROM customer),
u AS (SELECT c_custkey, 0 AS i, owner AS p, 'owner' AS role FROM r UNION ALL SELECT c_custkey, i, k[i][1], CASE i WHEN 1 THEN 'steward' WHEN 2 THEN 'contact' ELSE 'owner' END FROM r, range(1, 4) AS g(i)),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY c_custkey, p ORDER BY i) = 1)
SELECT c_custkey::VARCHAR AS native_key, CASE WHEN trim(description, ' ' || chr(9)) <> '' THEN c_mktsegment END AS description, CASE WHEN activated THEN 'active' ELSE 'draft' END AS status, (SELECT string_agg(p || ':' || role, ',' ORDER BY i) FROM o WHERE o.c_custkey = r.c_custkey) AS owners, c_mktsegment AS tag, TRUE AS label FROM r JOIN customer USING (c_custkey, c_name)
""")
def targets_neutral(t: Tables) -> DataFrame:
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    user = lambda n, role: F.struct(F.concat(F.lit("u"), n.cast("string")).alias("userId"), F.lit(role).alias("role"))
    raw = t.customer.select(
        _s("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(nation % 3 == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).otherwise("\t").alias("description"), F.lit("md").alias("readMe"), (F.col("c_acctbal") > 0).alias("activated"), F.concat(F.lit("u"), (k % 10).cast("string")).alias("ownerId"),
        F.array(user(nation % 10, "Data Steward"), user(k % 7, " key CONTACT"), user(nation % 3, "Co-Owner")).alias("keyContacts"), F.array("c_mktsegment").alias("tags"), F.lit("space").alias("spaceId"), F.lit("2024-01-01T00:00:00Z").alias("updatedAt"), F.lit("e1").alias("etag"),
    )
    out = catalogs.target_products(raw, "target", "m")
    return out.select("native_key", "description", "status", F.array_join(F.transform("owners", lambda p: F.concat_ws(":", p["party_id"], p["role"])), ",").alias("owners"), F.get("tags", F.lit(0))["key"].alias("tag"), F.get("tags", F.lit(0))["value"].isNull().alias("label"))


@query("SELECT o_custkey, array_to_string(k[1:3], ', ') || CASE WHEN len(k) > 3 THEN ' and ' || (len(k) - 3)::VARCHAR || ' more' ELSE '' END AS told FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS k FROM orders GROUP BY 1)")
def some_of_many(t: Tables) -> DataFrame:
    listed = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("k"))  # of five priorities
    return listed.select("o_custkey", T.some_of(F.col("k"), 3).alias("told"))


@query("SELECT p_partkey, p_size, running FROM (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM part WHERE p_size <= 40) WHERE running <= 30000")
def files_within_limits(t: Tables) -> DataFrame:
    return history.within_limits(t.part.select("p_partkey", "p_size"), "p_partkey", "p_size", most_bytes=40, total_bytes=30_000)
