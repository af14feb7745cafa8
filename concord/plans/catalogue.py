"""Queries over the driver's tables, one for each operator, and DuckDB SQL that says the same.

Tables stand in for catalogs: region.nation is a schema, customers are its datasets,
orders are objects with fields, events are runs and changes.  Rules, manifests and
overrides are short literal lists in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import text as T
from ..operators import diffs, history, identity, parties, selection, snapshots
from ..operators.selection import Rule
from ..sources import catalogs
from .cycle import Options, plan_cycle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def digest_sql(x: str) -> str:
    """The multiset digest of texts x as SQL."""
    pieces = [f"('0x' || substr(sha256({x}), {1 + 15 * i}, 15))::BIGINT" for i in range(2)]
    sums = ", ".join(f"coalesce(sum({half}), 0)::VARCHAR" for p in pieces for half in (f"({p} & 1073741823)", f"({p} >> 30)"))
    return f"sha256(concat_ws('|', count({x})::VARCHAR, {sums}))"


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _order_sum(status: Column) -> Column:
    return C.checksum(F.concat_ws("|", status, "o_orderpriority"))


@query("""
WITH f AS (SELECT o_orderkey AS k, 'sha256:' || sha256(o_orderstatus || '|' || o_orderpriority) AS c FROM orders WHERE o_orderkey % 17 <> 0),
b AS (SELECT o_orderkey AS k, 'sha256:' || sha256(CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END || '|' || o_orderpriority) AS c FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(f.k, b.k) AS o_orderkey, CASE WHEN f.k IS NULL THEN 'deleted' ELSE 'upsert' END AS change, f.c AS checksum, b.c AS was
FROM f FULL JOIN b ON f.k = b.k WHERE f.c IS DISTINCT FROM b.c
""")
def snapshot_change_feed(t: Tables) -> DataFrame:
    fresh = t.orders.where("o_orderkey % 17 <> 0").select("o_orderkey", _order_sum(F.col("o_orderstatus")).alias("checksum"))
    before = t.orders.where("o_orderkey % 13 <> 0").select("o_orderkey", _order_sum(F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("checksum"))
    return snapshots.snapshot_changes(fresh, before, "o_orderkey")


@query(f"""
WITH m AS (SELECT l_orderkey, count(*) AS n, {digest_sql("l_partkey::VARCHAR")} AS ids FROM lineitem GROUP BY 1)
SELECT o_orderkey AS l_orderkey, coalesce(n, 0) AS n_members, 'sha256:' || sha256(o_orderstatus || '|' || coalesce(ids, sha256('0|0|0|0|0'))) AS fingerprint FROM orders LEFT JOIN m ON o_orderkey = l_orderkey
""")
def membership_fingerprint(t: Tables) -> DataFrame:
    return snapshots.membership_fingerprint(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), t.lineitem, "l_orderkey", "l_partkey", F.col("o_orderstatus"))


def _customer_fields(df: DataFrame, name: Column | None = None, segment: Column | None = None, nation: Column | None = None, cents: Column | None = None) -> DataFrame:
    given = {"name": name, "segment": segment, "nation": nation, "cents": cents}
    own = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "nation": _s("c_nationkey"), "cents": F.round(F.col("c_acctbal") * 100).cast("long").cast("string")}
    return snapshots.envelopes(df, "c_custkey", {k: own[k] if given[k] is None else given[k] for k in own})


_LONG = """SELECT c_custkey, unnest([{'f': 'name', 'v': %s}, {'f': 'segment', 'v': %s}, {'f': 'nation', 'v': %s}, {'f': 'cents', 'v': %s}]) AS x FROM customer"""
_OWN = ("c_name", "c_mktsegment", "c_nationkey::VARCHAR", "round(c_acctbal * 100)::BIGINT::VARCHAR")
_ENV = "SELECT c_custkey, x.f AS field, x.v AS value, 'sha256:' || sha256(x.v) AS checksum FROM ({})"


@query(_ENV.format(_LONG % _OWN))
def field_envelopes_long(t: Tables) -> DataFrame:
    return _customer_fields(t.customer)


@query("""
WITH c AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\\r\\n?', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS c FROM documents)
SELECT doc_id, length(c)::INTEGER AS n, 'sha256:' || sha256(c) AS checksum FROM c
""")
def canonical_text_checksum(t: Tables) -> DataFrame:
    c = t.documents.select("doc_id", C.canonical_string(F.coalesce("text", F.lit(""))).alias("c"))
    return c.select("doc_id", F.length("c").alias("n"), C.checksum(F.col("c")).alias("checksum"))


@query("""SELECT l_orderkey, l_linenumber, 'sha256:' || sha256(array_to_string(list_sort(['flag=' || l_returnflag, 'status=' || l_linestatus, l_shipdate::DATE::VARCHAR]), ',')) AS checksum FROM lineitem""")
def tagset_checksum_order_free(t: Tables) -> DataFrame:
    tags = [F.concat_ws("=", F.lit("status"), "l_linestatus"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.concat_ws("=", F.lit("flag"), "l_returnflag")]
    listed = F.array_join(C.sorted_multiset(F.array(*[C.stripped(x) for x in tags])), ",")
    return t.lineitem.select("l_orderkey", "l_linenumber", C.checksum(listed).alias("checksum"))


def _stored(df: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    old = _customer_fields(
        df.where(k % 11 != 0),
        F.when(k % 3 == 0, "old").otherwise(F.col("c_name")), F.when(k % 5 == 0, "OLD").otherwise(F.col("c_mktsegment")), F.when(k % 7 == 0, "-1").otherwise(_s("c_nationkey")), F.when(k % 4 == 0, "0").otherwise(F.round(F.col("c_acctbal") * 100).cast("long").cast("string")),
    )
    return old.withColumn("revision", F.when(F.col("field") != "nation", F.concat(F.lit("r"), (k % 2).cast("string"))))


_OLD = ("CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE c_name END", "CASE WHEN c_custkey % 5 = 0 THEN 'OLD' ELSE c_mktsegment END", "CASE WHEN c_custkey % 7 = 0 THEN '-1' ELSE c_nationkey::VARCHAR END", "CASE WHEN c_custkey % 4 = 0 THEN '0' ELSE round(c_acctbal * 100)::BIGINT::VARCHAR END")
_CHANGED = f"""s AS ({_ENV.format(_LONG % _OWN)}), o AS (SELECT * FROM ({_ENV.format(_LONG % _OLD)}) WHERE c_custkey % 11 <> 0),
d AS (SELECT s.*, o.value AS previous, o.checksum AS old, CASE WHEN o.c_custkey IS NOT NULL AND s.field <> 'nation' THEN 'r' || (s.c_custkey % 2)::VARCHAR END AS revision FROM s LEFT JOIN o USING (c_custkey, field) WHERE s.checksum IS DISTINCT FROM o.checksum),
m AS (SELECT * FROM (VALUES ('name', 'rw', true), ('segment', 'rw', false), ('nation', 'ro', true)) AS m(field, mode, partial_update)),
x AS (SELECT d.*, CASE WHEN mode IS NULL THEN 'undeclared' WHEN mode = 'ro' THEN 'read_only' END AS reason, CASE WHEN mode IS NULL OR mode = 'ro' THEN 'drop' WHEN partial_update THEN 'patch' ELSE 'replace' END AS action FROM d LEFT JOIN m USING (field))"""


def _manifest(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("name", "rw", True, None), ("segment", "rw", False, None), ("nation", "ro", True, None)], "field string, mode string, partial_update boolean, path_allowed boolean").select(F.lit("dataset").alias("entity_type"), F.lit(True).alias("supported"), "*")


def _diff(t: Tables) -> DataFrame:
    source = _customer_fields(t.customer).withColumn("entity_type", F.lit("dataset"))
    return diffs.field_diff(diffs.changed_fields(source, _stored(t.customer), "c_custkey"), _manifest(t))


@query(f"WITH {_CHANGED} SELECT c_custkey, field, value, previous, action, reason FROM x")
def field_diff_minimal(t: Tables) -> DataFrame:
    return _diff(t).select("c_custkey", "field", "value", "previous", "action", "reason")


@query(f"""WITH {_CHANGED} SELECT c_custkey, count(*) AS operations, ceil(count(*) / 2.0)::BIGINT AS requests, count(*) > 2 AS exceeds_cap, CASE WHEN count(DISTINCT revision) = 1 THEN min(revision) END AS expected_revision, count(DISTINCT revision) > 1 AS ambiguous_revision
FROM x WHERE action <> 'drop' GROUP BY 1""")
def diff_expected_revision(t: Tables) -> DataFrame:
    return diffs.diff_summary(_diff(t), "c_custkey", 2)


@query(f"""WITH {_CHANGED}, l AS (SELECT c_custkey, field, CASE WHEN c_custkey % 6 = 0 THEN 'edited' ELSE checksum END AS live FROM o WHERE c_custkey % 10 <> 3)
SELECT x.c_custkey, x.field, CASE WHEN x.field = 'name' AND x.old IS NOT NULL AND live IS NOT NULL AND live <> x.old THEN 'manual_edit' END AS withheld FROM x LEFT JOIN l USING (c_custkey, field)""")
def manual_edit_withhold(t: Tables) -> DataFrame:
    stored = _stored(t.customer)
    live = stored.where("c_custkey % 10 <> 3").withColumn("checksum", F.when(F.col("c_custkey") % 6 == 0, "edited").otherwise(F.col("checksum")))
    mode = F.when(F.col("field") == "name", "preserve_local").otherwise("source_wins")
    return diffs.withheld(_diff(t), live, stored, "c_custkey", mode).select("c_custkey", "field", "withheld")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'none' WHEN o_custkey % 3 = 0 THEN 'no_managed_space' WHEN o_totalprice < 100000 THEN 'unsupported' ELSE 'activate' END AS gate FROM orders""")
def activation_gate(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ACTIVE").otherwise("draft")
    return t.orders.select("o_orderkey", diffs.activation(status, opt_in=True, managed_space=F.when(F.col("o_custkey") % 3 != 0, "space"), supported=F.col("o_totalprice") >= 100000).alias("gate"))


_FACTS = """SELECT o_orderpriority AS run, CASE WHEN o_orderkey % 23 = 0 THEN 'filtered' WHEN o_orderkey % 19 = 0 AND o_orderkey % 2 = 0 THEN 'skipped' WHEN o_orderkey % 19 = 0 THEN 'orphaned' WHEN o_orderkey % 29 = 0 THEN 'skipped'
 WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderkey % 5 = 0 AND o_orderpriority = '5-LOW' THEN 'skipped' WHEN o_orderkey % 5 = 0 THEN 'created' WHEN o_orderstatus = 'F' THEN 'unchanged' WHEN o_totalprice < 60000 THEN 'skipped'
 WHEN o_totalprice < 200000 THEN 'skipped' WHEN o_totalprice < 250000 THEN 'no_op' ELSE 'written' END AS outcome,
 o_orderkey % 23 <> 0 AND o_orderkey % 19 <> 0 AND (o_orderkey % 29 = 0 OR o_orderkey % 7 = 0 OR (o_orderkey % 5 = 0 AND o_orderpriority = '5-LOW') OR (o_orderkey % 5 <> 0 AND o_orderstatus <> 'F' AND o_totalprice >= 60000 AND o_totalprice < 200000)) AS holds FROM orders"""


@query(f"""SELECT run, {", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in diffs.OUTCOMES)}, count(*) FILTER (WHERE outcome IN ('created', 'written')) AS writes, count(*) FILTER (WHERE holds) AS held FROM ({_FACTS}) GROUP BY 1""")
def outcome_ladder_report(t: Tables) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    facts = {
        "selected": k % 23 != 0, "deleted": k % 19 == 0, "bound": k % 2 != 0, "has_envelopes": k % 29 != 0, "target": F.when(k % 7 == 0, "unconfirmed").when(k % 5 == 0, "none").otherwise("confirmed"), "creatable": F.col("o_orderpriority") != "5-LOW",
        "has_changes": F.col("o_orderstatus") != "F", "all_withheld": price < 60000,
        "reply": F.when(price < 100000, "conflict").when(price < 150000, "not_found").when(price < 200000, "refused").when(price < 250000, "no_op").otherwise("written"),
    }
    records = t.orders.select(F.col("o_orderpriority").alias("run"), diffs.outcome(facts, create=True, dry_run=False).alias("o")).select("run", "o.*")
    return diffs.outcome_counts(records, ["run"])


@query("""SELECT user_id % 10 AS run, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) AS writes FROM events GROUP BY 1""")
def run_counts_pivot(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.events.groupBy((F.col("user_id") % 10).alias("run")).agg(F.count_if(e == "view").alias("n_view"), F.count_if(e == "error").alias("n_error"), F.count_if(e.isin("signup", "purchase")).alias("writes"))


@query("""
WITH p AS (SELECT user_id % 8 AS pair, event_id // 50 AS page, bool_and(event_type <> 'error' OR value < 40) AS terminal, max(event_id) AS mark FROM events GROUP BY 1, 2),
w AS (SELECT *, bool_and(terminal) OVER (PARTITION BY pair ORDER BY page ROWS UNBOUNDED PRECEDING) AS ok FROM p)
SELECT pair, max(mark) FILTER (WHERE ok) AS committable FROM w GROUP BY 1
""")
def committable_offset(t: Tables) -> DataFrame:
    pages = t.events.groupBy((F.col("user_id") % 8).alias("pair"), F.floor(F.col("event_id") / 50).alias("page")).agg(F.bool_and((F.col("event_type") != "error") | (F.col("value") < 40)).alias("terminal"), F.max("event_id").alias("mark"))
    return diffs.committable(pages, ["pair"], "page", "terminal", "mark")


SCHEMA_RULES = [
    Rule("all-asia", 0, "object", "include", "glob", "ASIA.*"), Rule("teens", 1, "object", "include", "glob", "*.NATION_1?"), Rule("not-17", 2, "object", "exclude", "glob", "*.NATION_[!0123456]*"),
    Rule("africa", 3, "object", "include", "glob", "AF*.NATION_*"), Rule("not-20", 4, "object", "exclude", "glob", "AFRICA.NATION_20"),
]
_GLOB_CASE = """list_filter([{'i': 'all-asia', 'd': 'include', 'm': regexp_full_match(n, 'ASIA[.][^.]*')}, {'i': 'teens', 'd': 'include', 'm': regexp_full_match(n, '[^.]*[.]NATION_1.')},
 {'i': 'not-17', 'd': 'exclude', 'm': regexp_full_match(n, '[^.]*[.]NATION_[^0-6].*')}, {'i': 'africa', 'd': 'include', 'm': regexp_full_match(n, 'AF[^.]*[.]NATION_.*')}, {'i': 'not-20', 'd': 'exclude', 'm': n = 'AFRICA.NATION_20'}], lambda x: x.m)"""
_SCHEMAS = f"""SELECT n_nationkey, n, {_GLOB_CASE} AS m FROM (SELECT n_nationkey, r_name || '.' || n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _schemas(t: Tables) -> DataFrame:
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.concat_ws(".", "r_name", "n_name").alias("n"))


def _unknown() -> dict[str, Column]:
    return {"tags": F.lit(None).cast("array<struct<key:string,value:string>>"), "owners": F.lit(None).cast("array<string>")}


@query(f"""SELECT n_nationkey, n, CASE WHEN len(m) = 0 THEN 'exclude' ELSE m[-1].d END AS decision, CASE WHEN len(m) = 0 THEN 'default' ELSE 'rule' END AS decided_by, CASE WHEN len(m) > 0 THEN m[-1].i END AS rule_id FROM ({_SCHEMAS})""")
def glob_selection_last_match(t: Tables) -> DataFrame:
    out = selection.decide(_schemas(t), SCHEMA_RULES, scope="object", name=F.col("n"), **_unknown(), id_col="n_nationkey")
    return out.drop("undetermined")


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 5 <> 0 AS known_tags, p_partkey % 3 <> 0 AS known_owner, p_brand, p_type, p_partkey % 10 AS o FROM part),
r AS (SELECT p_partkey, CASE WHEN NOT known_tags THEN NULL ELSE p_brand IN ('Brand#1', 'Brand#2') END AS a, CASE WHEN NOT known_tags THEN NULL ELSE p_type = 'ECONOMY' END AS b, CASE WHEN NOT known_owner THEN NULL ELSE o IN (1, 2) END AS c FROM p)
SELECT p_partkey, CASE WHEN c THEN 'exclude' WHEN b OR a THEN 'include' ELSE 'exclude' END AS decision, array_to_string(list_filter([CASE WHEN a IS NULL THEN 'brand' END, CASE WHEN b IS NULL THEN 'type' END, CASE WHEN c IS NULL THEN 'owner' END], lambda x: x IS NOT NULL), ',') AS undetermined FROM r
""")
def tag_owner_three_valued(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rules = [Rule("brand", 0, "dataset", "include", "tag", "small"), Rule("type", 1, "dataset", "include", "tag", "type=ECONOMY"), Rule("owner", 2, "dataset", "exclude", "owner", "user[12]@*")]
    brand = F.struct(F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "small").otherwise("large").alias("key"), F.lit(None).cast("string").alias("value"))
    tags = F.when(k % 5 != 0, F.array(brand, F.struct(F.lit("type").alias("key"), F.col("p_type").alias("value"))))
    owners = F.when(k % 3 != 0, F.array(F.concat(F.lit("user"), (k % 10).cast("string"), F.lit("@example.com"))))
    out = selection.decide(t.part, rules, scope="dataset", name=F.lit(None).cast("string"), tags=tags, owners=owners, id_col="p_partkey")
    return out.select("p_partkey", "decision", F.array_join("undetermined", ",").alias("undetermined"))


def _overrides(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("object", "3", "exclude"), ("object", "EUROPE.NATION_3", "include"), ("object", "EUROPE.NATION_8", "include"), ("object", "12", "exclude"), ("dataset", "0", "exclude")], "scope string, key string, decision string")


_OVER = "(VALUES ('3', 'exclude'), ('EUROPE.NATION_3', 'include'), ('EUROPE.NATION_8', 'include'), ('12', 'exclude'))"
_DECIDED = f"""SELECT s.n_nationkey, s.n, coalesce(a.d, b.d, CASE WHEN len(m) > 0 THEN m[-1].d END, 'exclude') AS decision, CASE WHEN coalesce(a.d, b.d) IS NOT NULL THEN 'override' WHEN len(m) > 0 THEN 'rule' ELSE 'default' END AS decided_by
FROM ({_SCHEMAS}) s LEFT JOIN {_OVER} AS a(k, d) ON s.n_nationkey::VARCHAR = a.k LEFT JOIN {_OVER} AS b(k, d) ON s.n = b.k"""


def _decided(t: Tables) -> DataFrame:
    return selection.decide(_schemas(t), SCHEMA_RULES, scope="object", name=F.col("n"), **_unknown(), overrides=_overrides(t), id_col="n_nationkey")


@query(_DECIDED)
def override_priority(t: Tables) -> DataFrame:
    return _decided(t).select("n_nationkey", "n", "decision", "decided_by")


def _customers(t: Tables) -> DataFrame:
    named = t.customer.join(_schemas(t), F.col("c_nationkey") == F.col("n_nationkey"))
    rules = [Rule("out-5", 0, "dataset", "exclude", "glob", "*.*.*5"), Rule("in-55", 1, "dataset", "include", "glob", "*.*.*55"), Rule("rich", 2, "dataset", "exclude", "tag", "class=rich")]
    full = F.concat_ws(".", "n", F.regexp_replace("c_name", "#", "_"))
    tag = F.struct(F.lit("class").alias("key"), F.when(F.col("c_acctbal") > 9000, "rich").otherwise("other").alias("value"))
    tags = F.when(F.col("c_custkey") % 4 != 0, F.array(tag))
    sets = selection.decide(named, rules, scope="dataset", name=full, tags=tags, owners=_unknown()["owners"], overrides=_overrides(t), id_col="c_custkey")
    return selection.compose(sets, _decided(t), "n")


_RICH = "c_custkey % 4 <> 0 AND c_acctbal > 9000"
_COMPOSED = f"""SELECT c_custkey, n, CASE WHEN p.decision = 'exclude' THEN false WHEN c_custkey = 0 THEN false WHEN {_RICH} THEN false WHEN c_name LIKE '%55' THEN true WHEN c_name LIKE '%5' THEN false ELSE true END AS selected,
CASE WHEN p.decision = 'exclude' THEN 'parent' WHEN c_custkey = 0 THEN 'override' WHEN {_RICH} OR c_name LIKE '%5' THEN 'rule' ELSE 'inherited' END AS via, c_custkey % 4 = 0 AND c_custkey <> 0 AS unknown FROM customer JOIN ({_DECIDED}) p ON c_nationkey = n_nationkey"""


@query(f"SELECT c_custkey, selected, via FROM ({_COMPOSED})")
def dataset_inherits_parent(t: Tables) -> DataFrame:
    return _customers(t).select("c_custkey", "selected", "via")


@query(f"SELECT split_part(n, '.', 1) AS scope, count(*) AS total, count(*) FILTER (WHERE selected) AS included, count(*) FILTER (WHERE NOT selected) AS excluded, count(*) FILTER (WHERE unknown) AS n_undetermined FROM ({_COMPOSED}) GROUP BY 1")
def preview_tally(t: Tables) -> DataFrame:
    return selection.tally(_customers(t), F.substring_index("n", ".", 1), F.col("selected"))


@query("""
WITH s AS (SELECT c_custkey AS id, 'obj ' || (c_custkey % 400)::VARCHAR AS n, c_nationkey % 5 AS p FROM customer), c AS (SELECT s_suppkey AS id, 'obj ' || (s_suppkey * 7 % 450)::VARCHAR AS n, s_nationkey % 5 AS p FROM supplier),
b AS (SELECT id AS sid, id + 1 AS tid FROM s WHERE id % 50 = 0), g AS (SELECT n, p, list_sort(list(id)) AS l, count(*) AS c FROM c WHERE id NOT IN (SELECT tid FROM b) GROUP BY 1, 2),
j AS (SELECT s.id, l, b.sid IS NOT NULL AS bound, CASE WHEN b.sid IS NOT NULL OR l IS NULL THEN 0 ELSE c END AS k FROM s LEFT JOIN g USING (n, p) LEFT JOIN b ON b.sid = s.id)
SELECT id AS source_id, CASE WHEN bound THEN 'bound' WHEN k = 0 THEN 'unmatched' WHEN k = 1 THEN 'proposed' ELSE 'ambiguous' END AS status, CASE WHEN k > 0 THEN array_to_string(l[1:20], ',') END AS candidates, k::INTEGER AS n_candidates FROM j
""")
def natural_key_bootstrap(t: Tables) -> DataFrame:
    name = lambda k: C.normal_name(F.concat(F.lit("  OBJ "), k.cast("string"), F.lit(" ")))
    source = t.customer.select(F.col("c_custkey").alias("id"), name(F.col("c_custkey") % 400).alias("name"), (F.col("c_nationkey") % 5).alias("parent"))
    target = t.supplier.select(F.col("s_suppkey").alias("id"), name(F.col("s_suppkey") * 7 % 450).alias("name"), (F.col("s_nationkey") % 5).alias("parent"))
    bound = source.where("id % 50 = 0").select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"))
    out = identity.propose(source, target, bound, "name", ["parent"])
    return out.withColumn("candidates", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ","))


@query(f"""SELECT p_name, count(*) AS n, {digest_sql("(p_partkey::VARCHAR || '|' || p_brand)")} AS fingerprint FROM part GROUP BY 1""")
def candidate_fingerprint(t: Tables) -> DataFrame:
    return snapshots.set_fingerprint(t.part, "p_name", F.concat_ws("|", _s("p_partkey"), "p_brand"))


@query("""
WITH f AS (SELECT p_partkey AS id, p_brand AS fp FROM part WHERE p_partkey % 9 <> 0), r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE p_brand END AS fp, CASE p_partkey % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' ELSE 'pending' END AS d, p_partkey % 10 = 0 AS applied FROM part WHERE p_partkey % 8 <> 0),
j AS (SELECT coalesce(f.id, r.id) AS id, f.fp AS now, r.fp AS was, d, applied, coalesce(applied OR f.fp IS NOT DISTINCT FROM r.fp, false) AS stays FROM f FULL JOIN r ON f.id = r.id WHERE f.fp IS NOT NULL OR applied)
SELECT id AS proposal_id, coalesce(now, was) AS fingerprint, CASE WHEN stays THEN d ELSE 'pending' END AS decision, CASE WHEN NOT stays AND d <> 'pending' THEN d END AS superseded FROM j
""")
def review_merge(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    fresh = t.part.where(k % 9 != 0).select(k.alias("proposal_id"), F.col("p_brand").alias("fingerprint"))
    decision = F.when(k % 3 == 0, "confirm").when(k % 3 == 1, "reject").otherwise("pending")
    reviewed = t.part.where(k % 8 != 0).select(k.alias("proposal_id"), F.when(k % 4 == 0, "other").otherwise(F.col("p_brand")).alias("fingerprint"), decision.alias("decision"), (k % 10 == 0).alias("applied"))
    return identity.merge_review(fresh, reviewed)


@query("""
WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'ambiguous' ELSE 'proposed' END AS status, CASE WHEN c_custkey % 6 = 1 THEN c_custkey + 1 END AS chosen, c_custkey + 1 AS tk FROM customer),
k AS (SELECT *, coalesce(chosen, CASE WHEN status = 'proposed' THEN tk END) AS key FROM d), b AS (SELECT c_custkey AS nid, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey + 3 END AS nk FROM customer WHERE c_custkey % 5 = 0)
SELECT k.c_custkey AS neutral_id, CASE WHEN k.key IS NULL THEN 'needs_choice' WHEN o.nk = k.key THEN 'already_bound' WHEN o.nk IS NOT NULL OR h.nid IS NOT NULL THEN 'conflict' ELSE 'bound' END AS result FROM k LEFT JOIN b o ON o.nid = k.c_custkey LEFT JOIN b h ON h.nk = k.key
""")
def confirm_review(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    decisions = t.customer.select(k.alias("neutral_id"), F.when(k % 4 == 0, None).when(k % 4 == 1, "ambiguous").otherwise("proposed").alias("status"), F.when(k % 6 == 1, k + 1).alias("chosen"), (k + 1).alias("target_key"))
    bindings = t.customer.where(k % 5 == 0).select(k.alias("neutral_id"), F.when(k % 2 == 0, k + 1).otherwise(k + 3).alias("native_key"))
    return identity.confirm(decisions, bindings).select("neutral_id", "result")


@query("""
WITH o AS (SELECT c_custkey, c_custkey - c_custkey % 3 AS nk, c_nationkey % 5 AS tenant FROM customer), b AS (SELECT c_custkey AS nk, c_nationkey % 5 AS tenant, 'n' || c_custkey::VARCHAR AS nid FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT c_custkey, nid FROM o LEFT JOIN b USING (nk, tenant)), tg AS (SELECT 'n' || c_custkey::VARCHAR AS nid, c_custkey * 2 AS tk, c_acctbal > 3000 AS confirmed FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, r.nid AS neutral_id, CASE WHEN tk IS NULL THEN 'none' WHEN confirmed THEN 'confirmed' ELSE 'unconfirmed' END AS target, CASE WHEN confirmed THEN tk END AS target_key FROM r LEFT JOIN tg ON r.nid = tg.nid
""")
def identity_resolve_tenant(t: Tables) -> DataFrame:
    k, tenant = F.col("c_custkey"), F.col("c_nationkey") % 5
    fixed = [F.lit("source").alias("endpoint"), F.lit("dataset").alias("entity_type")]
    objects = t.customer.select(k, *fixed, tenant.alias("tenant_id"), (k - k % 3).alias("native_key"))
    bindings = t.customer.where(k % 3 == 0).select(*fixed, tenant.alias("tenant_id"), k.alias("native_key"), F.concat(F.lit("n"), k.cast("string")).alias("neutral_id"))
    targets = t.customer.where(k % 2 == 0).select(F.lit("target").alias("endpoint"), fixed[1], F.concat(F.lit("n"), k.cast("string")).alias("neutral_id"), (k * 2).alias("native_key"), (F.col("c_acctbal") > 3000).alias("confirmed"))
    resolved = identity.resolve(objects, bindings).drop("endpoint", "native_key")
    return identity.counterpart(resolved, targets, "target").select("c_custkey", "neutral_id", "target", "target_key")


@query("""
WITH s AS (SELECT 'u' || (c_custkey % 300)::VARCHAR || '@example.com' AS email, c_custkey AS party, CASE c_custkey % 3 WHEN 0 THEN 'owner' ELSE 'steward' END AS role FROM customer WHERE c_custkey % 7 <> 0), t AS (SELECT 'u' || (s_suppkey * 5)::VARCHAR || '@example.com' AS email, s_suppkey AS party, 'contact' AS role FROM supplier),
a AS (SELECT email, min(party) AS p, arg_min(role, party) AS r FROM s GROUP BY 1), b AS (SELECT email, min(party) AS p, arg_min(role, party) AS r FROM t GROUP BY 1)
SELECT coalesce(a.email, b.email) AS email, a.p AS source_party, b.p AS target_party, coalesce(a.r, b.r) AS role, CASE WHEN a.p IS NULL THEN 'target' WHEN b.p IS NULL THEN 'source' ELSE 'both' END AS side FROM a FULL JOIN b ON a.email = b.email
""")
def party_correlate(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    email = lambda n: C.normal_email(F.concat(F.lit(" U"), n.cast("string"), F.lit("@Example.com")))
    source = t.customer.select(F.when(k % 7 != 0, email(k % 300)).alias("email"), k.alias("party"), F.when(k % 3 == 0, "owner").otherwise("steward").alias("role"), k.alias("pos"))
    target = t.supplier.select(email(F.col("s_suppkey") * 5).alias("email"), F.col("s_suppkey").alias("party"), F.lit("contact").alias("role"), F.col("s_suppkey").alias("pos"))
    return parties.correlate(source, target)


@query("""
WITH m AS (SELECT p_partkey AS member, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' ' || (p_partkey % 100)::VARCHAR END AS name FROM part), i AS (SELECT p_name || ' ' || (p_partkey % 50)::VARCHAR AS name, p_partkey AS id FROM part),
g AS (SELECT name, count(*) AS n, min(id) AS id FROM i GROUP BY 1), j AS (SELECT member, CASE WHEN member % 10 = 0 THEN member + 5000 END AS bound, n, g.id FROM m LEFT JOIN g USING (name)),
s AS (SELECT *, CASE WHEN bound IS NOT NULL OR n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status FROM j)
SELECT member, CASE WHEN status = 'resolved' THEN coalesce(bound, id) END AS target_id, CASE WHEN status = 'resolved' THEN CASE WHEN bound IS NOT NULL THEN 'binding' ELSE 'name' END END AS how, status FROM s
""")
def dataset_member_two_tier(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    members = t.part.select(k.alias("member"), F.when(k % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", (k % 100).cast("string"))).alias("name"))
    items = t.part.select(F.concat_ws(" ", "p_name", (k % 50).cast("string")).alias("name"), k.alias("id"))
    bindings = t.part.where(k % 10 == 0).select(k.alias("member"), (k + 5000).alias("target_id"))
    return parties.resolve_datasets(members, bindings, items)


@query("""
WITH o AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'u' || (c_custkey % 200)::VARCHAR END AS email FROM customer), u AS (SELECT 'u' || (s_suppkey % 90)::VARCHAR AS email, s_suppkey AS id FROM supplier), g AS (SELECT email, count(DISTINCT id) AS n, min(id) AS id FROM u GROUP BY 1)
SELECT pos, CASE WHEN o.email IS NULL THEN 'no_email' WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'resolved' ELSE 'not_found' END AS status, CASE WHEN n = 1 THEN id END AS user_id FROM o LEFT JOIN g USING (email)
""")
def owner_resolution(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    owners = t.customer.select(k.alias("pos"), F.when(k % 5 != 0, F.concat(F.lit("u"), (k % 200).cast("string"))).alias("email"), F.lit("owner").alias("role"))
    users = t.supplier.select(F.concat(F.lit("u"), (F.col("s_suppkey") % 90).cast("string")).alias("email"), F.col("s_suppkey").alias("user_id"))
    return parties.resolve_owners(owners, users).select("pos", "status", "user_id")


_PRIORITY = ["purchase", "signup", "click", "view"]


@query("SELECT user_id, arg_min(event_type, struct_pack(p := CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END, i := event_id)) AS role, min(event_id) AS first_pos FROM events GROUP BY 1")
def owner_best_role(t: Tables) -> DataFrame:
    return parties.best_role(t.events, "user_id", "event_type", "event_id", _PRIORITY)


@query("""SELECT l_orderkey, bool_and(l_partkey % 20 <> 0) AS all_bound, CASE WHEN bool_and(l_partkey % 20 <> 0) THEN array_to_string(list_sort(list(DISTINCT p_partkey * 10))[1:100], ',') END AS refs, count(DISTINCT CASE WHEN p_partkey % 20 <> 0 THEN p_partkey END) AS n_bound, count(*) AS n_refs FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def refs_all_or_nothing(t: Tables) -> DataFrame:
    refs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", F.col("l_partkey").alias("ref"))
    bound = t.part.where("p_partkey % 20 <> 0").select(F.col("p_partkey").alias("ref"), (F.col("p_partkey") * 10).alias("bound"))
    out = parties.all_or_nothing(refs, bound, "l_orderkey")
    return out.withColumn("refs", F.array_join(F.transform("refs", lambda x: x.cast("string")), ","))


@query("""SELECT s_suppkey, CASE WHEN t IS NULL THEN 0 ELSE len(t) END AS n_tags, coalesce(array_to_string(t, ','), '') AS tags FROM supplier LEFT JOIN (SELECT l_suppkey, list_sort(list(DISTINCT l_returnflag || '=' || l_linestatus)) AS t FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1) ON s_suppkey = l_suppkey""")
def tags_available_vs_empty(t: Tables) -> DataFrame:
    schema = F.when(F.col("l_suppkey") % 7 == 0, "elsewhere").otherwise(_s("l_suppkey"))  # every seventh supplier has no tags
    rows = t.lineitem.select(F.lit("main").alias("catalog_name"), schema.alias("schema_name"), F.col("l_returnflag").alias("tag_name"), F.col("l_linestatus").alias("tag_value"))
    tags = catalogs.tags_of(t.spark, rows, "schema_tags", "main")
    out = catalogs.with_tags(t.supplier.withColumn("full_name", F.concat_ws(".", F.lit("main"), _s("s_suppkey"))), tags)
    return out.select("s_suppkey", F.size("tags").cast("long").alias("n_tags"), F.array_join(T.tag_values(F.col("tags")), ",").alias("tags"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'inconclusive' WHEN o_orderkey % 6 < 4 AND o_orderkey % 10 = 0 THEN 'resolved' WHEN o_orderkey % 6 < 4 THEN 'present' WHEN o_orderkey % 10 = 0 THEN 'still_missing' ELSE 'newly_missing' END AS finding FROM orders""")
def orphan_reconcile(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    presence = t.orders.select(k, F.when(k % 6 != 5, k % 6 < 4).alias("here"))
    log = t.orders.where(k % 5 == 0).select(k, F.when(k % 10 != 0, F.current_timestamp()).alias("resolved_at"))
    return history.orphans(t.orders, presence, log, "o_orderkey")


def _log(t: Tables) -> DataFrame:
    """Two recorded sightings of missing users: errors before and after an instant."""
    errors = t.events.where("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    empty = t.spark.createDataFrame([], "user_id long, first_missing_at timestamp, last_missing_at timestamp, resolved_at timestamp")
    first = history.record_missing(empty, errors.where(F.col("at") < "2024-01-15"), "user_id")
    first = first.withColumn("resolved_at", F.when(F.col("user_id") % 4 == 0, F.col("last_missing_at")))
    return history.record_missing(first, errors.where(F.col("at") >= "2024-01-15"), "user_id")


@query("""
WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), l AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi, count(*) FILTER (WHERE ts >= '2024-01-15') AS later FROM e GROUP BY 1)
SELECT user_id % 5 AS team, count(*) AS n_open, count(*) FILTER (WHERE hi <= lo) AS n_tentative, count(*) FILTER (WHERE hi > lo) AS n_confirmed, max(epoch(TIMESTAMP '2025-01-01')::BIGINT - floor(epoch(lo))::BIGINT) AS longest_s FROM l WHERE user_id % 4 <> 0 OR later > 0 GROUP BY 1
""")
def orphan_digest(t: Tables) -> DataFrame:
    return history.orphan_digest(_log(t).withColumn("team", F.col("user_id") % 5), "team", F.lit("2025-01-01").cast("timestamp"))


@query("SELECT ts, event_id, event_type FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20 00:00:00', 500) ORDER BY ts DESC, event_id DESC LIMIT 101")
def keyset_page_runs(t: Tables) -> DataFrame:
    import datetime

    return history.keyset_page(t.events.select("ts", "event_id", "event_type"), ["ts", "event_id"], 100, (datetime.datetime(2024, 1, 20), 500))


@query("""
WITH g AS (SELECT user_id, max(event_id) FILTER (WHERE event_type <> 'error') AS good FROM events GROUP BY 1)
SELECT user_id, count(event_id) AS streak, count(event_id) >= 2 AS degraded FROM g LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'error') e USING (user_id) WHERE e.event_id IS NULL OR good IS NULL OR e.event_id > good GROUP BY 1
UNION ALL SELECT user_id, 0, false FROM g WHERE EXISTS (SELECT 1 FROM events x WHERE x.user_id = g.user_id AND x.event_type = 'error') AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = g.user_id AND x.event_type = 'error' AND (good IS NULL OR x.event_id > good))
""")
def consecutive_failures(t: Tables) -> DataFrame:
    return history.failure_streaks(t.events.withColumn("failed", F.col("event_type") == "error"), "user_id", ["event_id"], "failed", 2)


@query("""
WITH i AS (SELECT event_id AS item_id, user_id AS nid, CASE WHEN event_type = 'error' THEN 'orphaned' ELSE 'written' END AS outcome FROM events), u AS (SELECT event_id AS item_id, list_sort(list_filter([CASE WHEN event_id % 6 = 0 THEN 'dataset_refs' END, CASE WHEN event_id % 4 = 0 THEN 'owners' END], lambda x: x IS NOT NULL)) AS f FROM events)
SELECT item_id, CASE WHEN list_contains(f, 'dataset_refs') THEN 'dataset_refs' WHEN list_contains(f, 'owners') THEN 'owners' WHEN outcome = 'orphaned' THEN 'orphan' ELSE 'other' END AS kind, array_to_string(CASE WHEN len(f) > 0 THEN f END, ',') AS fields, CASE WHEN outcome = 'orphaned' AND nid % 3 = 0 THEN nid * 2 END AS first_missing_at FROM i JOIN u USING (item_id)
""")
def run_issues_join(t: Tables) -> DataFrame:
    k = F.col("event_id")
    items = t.events.select(k.alias("item_id"), F.col("user_id").alias("neutral_id"), F.lit("source").alias("endpoint"), F.lit("dataset").alias("entity_type"), F.when(F.col("event_type") == "error", "orphaned").otherwise("written").alias("outcome"))
    unresolved = t.events.select(k.alias("item_id"), F.explode(F.array_compact(F.array(F.when(k % 6 == 0, "dataset_refs"), F.when(k % 4 == 0, "owners")))).alias("field"))
    log = t.events.select("user_id").distinct().where("user_id % 3 = 0").select(F.col("user_id").alias("neutral_id"), F.lit("source").alias("endpoint"), F.lit("dataset").alias("entity_type"), (F.col("user_id") * 2).alias("first_missing_at"))
    return history.run_issues(items, log, unresolved).select("item_id", "kind", F.array_join("fields", ",").alias("fields"), "first_missing_at")


@query("""
WITH b AS (SELECT event_id, user_id, event_type, 0 AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' UNION ALL SELECT event_id, user_id, event_type, 1 FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT user_id, arg_max(event_type, {'n': n, 'e': event_id}) AS event_type, arg_max(event_id, {'n': n, 'e': event_id}) AS event_id FROM b GROUP BY 1
""")
def upsert_latest(t: Tables) -> DataFrame:
    rows = lambda when: t.events.where(f"ts {when} TIMESTAMP '2024-01-20'").select("user_id", "event_type", "event_id")
    return history.upsert(rows("<"), rows(">="), ["user_id"], ["event_id"])


@query("""
WITH h AS (SELECT p_partkey AS k, p_brand AS f FROM part WHERE p_partkey % 7 <> 0), w AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END AS f FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(h.k, w.k) AS p_partkey, CASE WHEN h.k IS NULL THEN 'added' WHEN w.k IS NULL THEN 'removed' WHEN w.f IS NOT NULL AND w.f <> h.f THEN 'updated' ELSE 'kept' END AS action FROM h FULL JOIN w ON h.k = w.k
""")
def config_reconcile(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    want = t.part.where(k % 5 != 0).select(k, F.when(k % 9 == 0, None).when(k % 4 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("f"))
    return snapshots.reconcile(t.part.where(k % 7 != 0).select(k, F.col("p_brand").alias("f")), want, "p_partkey", "f")


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' WHEN 'view' THEN 'skipped' ELSE 'ok' END"


@query(f"WITH s AS (SELECT user_id, {_STATUS} AS s FROM events) SELECT user_id, arg_max(s, list_position(['ok', 'skipped', 'partial', 'failed'], s)) AS worst, count(*) AS n_runs, bool_or(s = 'failed') AS any_failed FROM s GROUP BY 1")
def worst_status(t: Tables) -> DataFrame:
    return history.worst_status(t.events.withColumn("status", F.expr(_STATUS)), "user_id", "status")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 45)")
def anti_unbound_refs(t: Tables) -> DataFrame:
    bound = t.part.where("p_size < 45").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(bound, "l_partkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_bound_refs(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query(f"""SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), {sql_text(T.KEYED)}, '\\1{T.REDACTED}', 'g'), {sql_text(T.CREDENTIAL)}, '\\1\\2 {T.REDACTED}', 'g')) AS digest FROM documents""")
def redact_secrets_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(T.redacted(F.coalesce("text", F.lit(""))), 256).alias("digest"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'absent' WHEN event_id % 4 = 1 THEN 'null' WHEN event_id % 4 = 2 THEN 'empty' ELSE 'value' END AS state FROM events""")
def json_absent_null_empty(t: Tables) -> DataFrame:
    k = F.col("event_id")
    document = F.when(k % 4 == 0, F.col("props")).when(k % 4 == 1, '{"owner": null}').when(k % 4 == 2, '{"owner": " "}').otherwise('{"owner": "x"}')
    return t.events.select("event_id", catalogs.key_state(document, "owner").alias("state"))


@query("""SELECT event_type, CASE WHEN value <= 0.1 THEN '0.1' WHEN value <= 0.5 THEN '0.5' WHEN value <= 1 THEN '1' WHEN value <= 2.5 THEN '2.5' WHEN value <= 5 THEN '5' WHEN value <= 10 THEN '10' WHEN value <= 30 THEN '30' WHEN value <= 60 THEN '60' WHEN value <= 120 THEN '120' WHEN value <= 300 THEN '300' WHEN value <= 600 THEN '600' WHEN value <= 1200 THEN '1200' ELSE '+Inf' END AS le, count(*) AS n FROM events GROUP BY 1, 2""")
def duration_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", history.bucket(F.col("value")).alias("le")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_name, count(DISTINCT p_brand) AS n_owners FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def name_collisions(t: Tables) -> DataFrame:
    return history.conflicts(t.part, ["p_name"], "p_brand")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return history.duplicates(t.lineitem, ["l_orderkey", "l_partkey"])


@query("""SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS was, 'NEW' AS now FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'NEW' UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR, (c_nationkey + 1)::VARCHAR FROM customer WHERE c_custkey % 4 = 0""")
def audit_field_rows(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    new = t.customer.select(k, F.when(k % 3 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(k % 4 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"))
    return history.row_audit(t.customer, new, "c_custkey", ["c_mktsegment", "c_nationkey", "c_name"])


@query("""
WITH k AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders), d AS (SELECT id, unnest([id - 1, id + 2]) AS dep FROM k WHERE id % 2 = 0), m AS (SELECT d.id, bool_and(coalesce(k.s = 'F', false)) AS met FROM d LEFT JOIN k ON k.id = dep GROUP BY 1)
SELECT k.id, s = 'O' AND coalesce(met, true) AS ready FROM k LEFT JOIN m USING (id)
""")
def ready_tasks(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("active")
    return history.ready(t.orders.select(k.alias("id"), status.alias("status"), F.when(k % 2 == 0, F.array(k - 1, k + 2)).otherwise(F.array().cast("array<bigint>")).alias("deps")))


@query("""
WITH e AS (SELECT n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'target' ELSE 'both' END AS role, n_nationkey % 5 <> 0 AS enabled FROM nation WHERE n_nationkey < 20),
p AS (SELECT s_suppkey AS pair, 'NATION_' || s_nationkey::VARCHAR AS s, 'NATION_' || ((s_nationkey + s_suppkey) % 25)::VARCHAR AS t FROM supplier), j AS (SELECT pair, s, t, a.role AS sr, b.role AS tr, a.enabled AS se, b.enabled AS te FROM p LEFT JOIN e a ON a.name = s LEFT JOIN e b ON b.name = t)
SELECT pair, problem FROM (SELECT pair, unnest([CASE WHEN sr IS NULL THEN 'source_missing' END, CASE WHEN tr IS NULL THEN 'target_missing' END, CASE WHEN sr = 'target' THEN 'source_is_target' END, CASE WHEN tr = 'source' THEN 'target_is_source' END, CASE WHEN s = t THEN 'same_endpoint' END, CASE WHEN NOT se THEN 'source_disabled' END, CASE WHEN NOT te THEN 'target_disabled' END]) AS problem FROM j) WHERE problem IS NOT NULL
""")
def pair_violations(t: Tables) -> DataFrame:
    k, name = F.col("n_nationkey"), lambda c: F.concat(F.lit("NATION_"), c.cast("string"))
    endpoints = t.nation.where(k < 20).select(F.col("n_name").alias("name"), F.when(k % 3 == 0, "source").when(k % 3 == 1, "target").otherwise("both").alias("role"), (k % 5 != 0).alias("enabled"))
    pairs = t.supplier.select(F.col("s_suppkey").alias("pair"), name(F.col("s_nationkey")).alias("source"), name((F.col("s_nationkey") + F.col("s_suppkey")) % 25).alias("target"))
    return history.violations(pairs, endpoints)


@query(f"""
WITH {_CHANGED}, l AS (SELECT c_custkey, field, CASE WHEN c_custkey % 6 = 0 THEN 'edited' ELSE checksum END AS live FROM o), w AS (SELECT x.*, x.field = 'name' AND x.old IS NOT NULL AND live <> x.old AS held FROM x LEFT JOIN l USING (c_custkey, field)),
p AS (SELECT c_custkey, count(*) FILTER (WHERE action <> 'drop') AS nc, count(*) FILTER (WHERE action <> 'drop' AND NOT coalesce(held, false)) AS nw FROM w GROUP BY 1),
c AS (SELECT c_custkey AS k, coalesce(nc, 0) AS nc, coalesce(nw, 0) AS nw FROM customer LEFT JOIN p USING (c_custkey))
SELECT k AS key, CASE WHEN k % 23 = 0 THEN 'filtered' WHEN k % 19 = 0 THEN 'orphaned' WHEN k % 13 = 0 THEN 'skipped' WHEN nc = 0 THEN 'unchanged' WHEN nw = 0 THEN 'skipped' ELSE 'written' END AS outcome,
CASE WHEN k % 23 = 0 THEN 'not_selected' WHEN k % 19 = 0 THEN NULL WHEN k % 13 = 0 THEN 'no_target_binding' WHEN nc = 0 THEN NULL WHEN nw = 0 THEN 'nothing_to_write' END AS reason, nc AS n_changes, nw AS n_writes FROM c
""")
def cycle_plan(t: Tables) -> DataFrame:
    return _cycle(t)[0].select("key", "outcome", "reason", "n_changes", "n_writes")


def _cycle(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("key")
    keyed = lambda df: df.withColumnRenamed("c_custkey", "key")
    stored = keyed(_stored(t.customer))
    live = stored.withColumn("checksum", F.when(k % 6 == 0, "edited").otherwise(F.col("checksum")))
    changes = keyed(t.customer.select("c_custkey")).select("key", F.lit("dataset").alias("entity_type"), (k % 23 != 0).alias("selected"), (k % 19 == 0).alias("deleted"), F.lit(True).alias("bound"), F.when(k % 13 == 0, "none").otherwise("confirmed").alias("target"))
    source = keyed(_customer_fields(t.customer)).withColumn("entity_type", F.lit("dataset"))
    return plan_cycle(changes, source, stored, live, _manifest(t), Options(preserve=("name",)))


_CYCLE = f"""{_CHANGED}, l AS (SELECT c_custkey, field, CASE WHEN c_custkey % 6 = 0 THEN 'edited' ELSE checksum END AS live FROM o), w AS (SELECT x.*, x.field = 'name' AND x.old IS NOT NULL AND live <> x.old AS held FROM x LEFT JOIN l USING (c_custkey, field)),
v AS (SELECT * FROM w WHERE action <> 'drop' AND NOT coalesce(held, false) AND c_custkey % 23 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 13 <> 0)"""


@query(f"WITH {_CYCLE} SELECT c_custkey AS key, field, action, value, previous, checksum, revision FROM v")
def cycle_writes(t: Tables) -> DataFrame:
    return _cycle(t)[1].drop("entity_type")


@query("SELECT min(p_partkey) AS p_partkey, sha256(p_name || '|' || p_brand) AS digest FROM part WHERE p_partkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 2 = 1 AND q.p_name = part.p_name AND q.p_brand = part.p_brand) GROUP BY p_name, p_brand")
def new_content_only(t: Tables) -> DataFrame:
    digest = F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256)
    rows = t.part.select("p_partkey", digest.alias("digest"))
    known = rows.where("p_partkey % 2 = 1").select("digest")
    return rows.where("p_partkey % 2 = 0").join(known, "digest", "left_anti").groupBy("digest").agg(F.min("p_partkey").alias("p_partkey"))
