"""Rule tables, places, pages, confirmations, folded changes and recovered conflicts against plain loops; odd texts and numbers."""

import json
import math
import random
import struct
from fnmatch import fnmatchcase

import pytest
from conftest import SF
from pyspark.sql import functions as F

from concord.functions import canonical as C
from concord.functions import text as T
from concord.operators import diffs, folding, history, identity, payloads, ranks, rule_table, selection, spread
from concord.plans import catalogue, catalogue_sync  # noqa: F401
from concord.sources import reads


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_rules(rng, n):
    def segment():
        return "".join(rng.choice(["a", "b", "c", "ab", "abc", "x_", "?", "*", "[ab]", "[!a]", "cab", "_9"]) for _ in range(rng.randint(1, 4)))

    kinds = {"glob": lambda: f"{segment()}.{segment()}", "tag": lambda: rng.choice(["t1", "t2", "t1=v", "t2=w", "t=1=2"]), "owner": lambda: rng.choice(["*@X.org", "u?@x.org", "u1@*", "*", "ann.*@x.org"])}
    return [(f"r{i}", i, "object", rng.choice(["include", "exclude"]), k := rng.choice(list(kinds)), kinds[k]()) for i in range(n)]


def test_rules_as_a_table_decide_as_a_short_list_does(spark):
    rng = random.Random(3)
    rules = random_rules(rng, 60)
    word = lambda: "".join(rng.choice("abcx_9") for _ in range(rng.randint(1, 7)))
    objects = []
    for i in range(400):
        name = rng.choice([None, word(), f"{word()}.{word()}.x", *[f"{word()}.{word()}"] * 9])
        tags = rng.choice([None, [], [("t1", "v")], [("t1", None), ("t2", "w")], [("t=1", "2"), ("t", "1=2")]])
        owners = rng.choice([None, [], ["u1@x.org"], ["u12@x.org", "ann.b@x.org"], [None, "z"]])
        objects.append((i, name, tags, owners))
    df = spark.createDataFrame(objects, "object_id int, name string, tags array<struct<key:string,value:string>>, owners array<string>")
    overrides = spark.createDataFrame([("object", "7", "include"), ("object", objects[9][1] or "none", "exclude"), ("dataset", "8", "include")], "scope string, key string, decision string")
    cols = {"scope": "object", "name": F.col("name"), "tags": F.col("tags"), "owners": F.col("owners"), "overrides": overrides}
    fields = ("object_id", "decision", "decided_by", "rule_id", "undetermined")
    table = rule_table.decide_by_table(df, spark.createDataFrame(rules, rule_table.RULES), **cols)
    short = selection.decide(df, [selection.Rule(*r) for r in rules], **cols)
    assert table.columns == short.columns
    got = sorted(tuple(r) for r in table.select(*fields).collect())
    assert got == sorted(tuple(r) for r in short.select(*fields).collect())
    # and as a loop does, by names only
    for i, name, _, _ in objects:
        hits = [r for r in rules if r[4] == "glob" and name and name.count(".") == 1 and all(fnmatchcase(a, b) for a, b in zip(name.split("."), r[5].split("."), strict=True))]
        row = got[i]
        if row[2] == "rule" and hits:
            assert int(row[3][1:]) >= hits[-1][1]
    none = rule_table.decide_by_table(df, spark.createDataFrame([], rule_table.RULES), **{**cols, "overrides": None})
    assert {tuple(r) for r in none.select("decision", "decided_by").collect()} == {("exclude", "default")}


def test_lists_of_undetermined_rules_are_told_once_not_for_each_object(spark):
    df = spark.range(300).select(F.col("id").alias("object_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("a.b"), F.col("id").cast("string"))).alias("name"))
    df = df.withColumn("tags", F.lit(None).cast("array<struct<key:string,value:string>>")).withColumn("owners", F.array(F.lit("u@x.org")))
    rules = spark.createDataFrame([(f"r{i}", i * 6000, "object", "include", "glob" if i % 3 else "tag", f"a.b{i}" if i % 3 else f"t{i}") for i in range(40)], rule_table.RULES)
    calls = spark.sparkContext.accumulator(0)

    def joined(ids):
        calls.add(1)
        return ",".join(ids)

    cols = {"scope": "object", "name": F.col("name"), "tags": F.col("tags"), "owners": F.col("owners")}
    out = rule_table.decide_by_table(df, rules, **cols, told=F.udf(joined, "string"))
    tagged, all_ = (",".join(f"r{i}" for i in range(40) if i % 3 == 0), ",".join(f"r{i}" for i in range(40)))
    assert {(r["object_id"] % 2, r["undetermined"]) for r in out.select("object_id", "undetermined").collect()} == {(0, tagged), (1, all_)}
    assert 0 < calls.value <= 8


def test_rules_as_a_table_are_equi_joins(spark):
    plan = plan_of(catalogue.QUERIES["rules_as_table"](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_places_and_pages_in_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "hot", "hot", "hot", "b" * rng.randint(1, 3)]), rng.randrange(10), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "a string, b int, c int").repartition(6)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    for size, most in ((100, 256), (10_000, 256), (1, 7)):
        out = ranks.ranked(df, ["a", "b", "c"], rows_per_range=size, most=most)
        assert [tuple(r)[:3] for r in out.orderBy("place").collect()] == want
        assert [r["place"] for r in out.select("place").orderBy("place").collect()] == list(range(1, 1501))
        for offset, n in ((0, 10), (0, 0), (730, 120), (1490, 10), (1490, 11), (1490, 9), (1500, 5), (9000, 5)):
            page, more = ranks.page(df, ["a", "b", "c"], offset, n, rows_per_range=size, most=most)
            assert ([tuple(r) for r in page.collect()], more) == (want[offset : offset + n], offset + n < 1500), (size, offset, n)
    empty = df.limit(0)
    assert ranks.ranked(empty, ["c"]).collect() == [] and ranks.page(empty, ["c"], 0, 5)[1] is False
    assert "SinglePartition" not in plan_of(ranks.ranked(df, ["a", "b", "c"], rows_per_range=100))


def one_by_one(decisions, bound):
    own, held, out = dict(bound), {k: n for n, k in bound}, {}
    for i, n, k in decisions:
        if k is None:
            out[i] = "needs_choice"
        elif n in own:
            out[i] = "already_bound" if own[n] == k else "conflict"
        elif k in held:
            out[i] = "conflict"
        else:
            own[n], held[k], out[i] = k, n, "bound"
    return out


def test_confirmations_are_taken_one_after_the_other(spark):
    rng = random.Random(5)
    chain = [(i, f"n{(i + 1) // 2}", f"k{i // 2}") for i in range(8)]
    many = [(i, f"n{rng.randrange(25)}", rng.choice([None, f"k{rng.randrange(25)}"])) for i in range(120)]
    hot = [(i, f"n{i}", "k0") for i in range(40)] + [(40 + i, "n0", "k0") for i in range(3)]
    for decisions, bound in ((chain, []), (many, [("n3", "k3"), ("n9", "k1")]), (hot, []), ([], [])):
        df = spark.createDataFrame([(*d, "proposed", None) for d in decisions], "i int, neutral_id string, target_key string, status string, chosen string")
        got = identity.confirm(df, spark.createDataFrame(bound, "neutral_id string, native_key string"), order="i")
        assert got.columns == [*df.columns, "result"]
        assert {r["i"]: r["result"] for r in got.collect()} == one_by_one(decisions, bound)


def test_candidates_beyond_those_listed(spark):
    side = lambda ids: spark.createDataFrame([(i, "same", 1) for i in ids], "id int, name string, parent int")
    bound = spark.createDataFrame([(90, 1000)], "source_id int, target_id int")
    source, target = side([1, 90]), side(range(100, 150))
    listed = identity.propose(source, target, bound, "name", ["parent"]).where("source_id = 1").first()
    assert listed["n_candidates"] == 50 and len(listed["candidates"]) == 20
    assert {r["target_id"] for r in identity.candidates(source, target, bound, "name", ["parent"]).collect()} == set(range(100, 150))
    choices = spark.createDataFrame([(1, 149), (1, 99), (90, 120)], "source_id int, target_id int")
    assert sorted(tuple(r) for r in identity.chosen(choices, source, target, bound, "name", ["parent"]).collect()) == [(1, 99, False), (1, 149, True), (90, 120, False)]


def test_products_raise_beyond_their_limit(spark):
    schemas = spark.createDataFrame([("c", "s")], "catalog_name string, schema_name string")
    tables = spark.createDataFrame([("c", "s", f"t{i:03d}") for i in range(30)], "catalog_name string, schema_name string, table_id string")
    refs = spark.createDataFrame([("c.s",)], "full_name string")
    row = reads.read_products(schemas, tables, refs, ["c.*"], listed=2, most=30).first()
    assert (row["n_datasets"], row["datasets"]) == (30, ["t000", "t001"])
    assert reads.product_members(schemas, tables, refs, ["c.*"]).count() == 30
    with pytest.raises(Exception, match="over 29 datasets"):
        reads.read_products(schemas, tables, refs, ["c.*"], most=29).collect()


def test_changes_see_what_earlier_ones_wrote(spark):
    rng = random.Random(2)
    stored = {("a", "f"): "1", ("hot", "g"): "0"}
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.choice("fg"), i * 3, str(rng.randrange(3)), rng.random() < 0.6) for i in range(600)]
    target, fields, writes = dict(stored), set(), {}
    records: dict = {}
    for key, field, seq, value, writable in rows:
        was = target.get((key, field))
        changed = was != value
        fields.add((key, field, seq, was, changed, changed and writable))
        n = records.setdefault((key, seq), [0, 0])
        n[0] += changed
        n[1] += changed and writable
        if changed and writable:
            target[key, field] = value
            writes.setdefault(key, seq)
    df = spark.createDataFrame([(k, f, s, v, v, w) for k, f, s, v, w in rows], "key string, field string, seq long, value string, checksum string, writable boolean").repartition(5)
    old = spark.createDataFrame([(k, f, v, v) for (k, f), v in stored.items()], "key string, field string, value string, checksum string")
    for width in (7, 100, 10**6):
        out = folding.folded_fields(df, old, ["key"], width=width)
        assert {tuple(r) for r in out.select("key", "field", "seq", "previous", "changed", "written").collect()} == fields, width
    known = {k for k, _ in stored}
    want = {(k, s, "created" if w and k not in known and writes[k] == s else "written" if w else "unchanged" if not c else "skipped", c, w) for (k, s), (c, w) in records.items()}
    assert {tuple(r) for r in folding.folded_records(out, old, ["key"]).collect()} == want
    assert folding.folded_records(folding.folded_fields(df.limit(0), old, ["key"]), old, ["key"]).collect() == []


def largest_part(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_of_folded_changes_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 100)
    for rows in (1000, 4000):
        changes = spark.range(rows).select((F.col("id") % (rows // 10)).alias("key"), F.lit("f").alias("field"), F.col("id").alias("seq"), F.col("id").cast("string").alias("value"), F.lit("c").alias("checksum"), F.lit(True).alias("writable"))
        stored = changes.limit(5).select("key", "field", "value", "checksum")
        fields = folding.folded_fields(changes, stored, ["key"])
        assert fields.count() == rows and largest_part(fields) <= 250
        assert largest_part(folding.folded_records(fields, stored, ["key"])) <= 250


def test_one_recovery_of_a_conflict(spark):
    sent = spark.createDataFrame([("a", "f", "1"), ("a", "g", "2"), ("b", "f", "1"), ("c", "f", "1"), ("d", "f", None)], "key string, field string, checksum string")
    live = spark.createDataFrame([("a", "f", "1"), ("a", "g", "9"), ("b", "f", "1"), ("c", "f", "0"), ("a", "h", "x")], "key string, field string, checksum string")
    revisions = spark.createDataFrame([("a", "r2"), ("b", "r5"), ("c", None)], "key string, revision string")
    fields = payloads.after_conflict(sent, live, revisions, ["key"])
    assert {tuple(r) for r in fields.select("key", "field", "action").collect()} == {("a", "f", "already"), ("a", "g", "resend"), ("b", "f", "already"), ("c", "f", "unguarded"), ("d", "f", "unguarded")}
    replies = spark.createDataFrame([(k, "conflict") for k in "abcd"] + [("e", "written"), ("g", "refused")], "key string, reply string")
    for again, a in ((("a", "written"), "written"), (("a", "conflict"), "conflict_unresolved"), (("z", "written"), "conflict_unresolved")):
        out = payloads.recovered(replies, fields, spark.createDataFrame([again], "key string, reply string"), ["key"])
        assert {(r["key"], r["outcome"]) for r in out.collect()} == {("a", a), ("b", "no_op"), ("c", "conflict_unresolved"), ("d", "conflict_unresolved"), ("e", "written"), ("g", "refused")}


def test_tasks_after_a_conflict_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 100)
    for rows in (1000, 4000):
        sent = spark.range(rows).select(F.col("id").alias("key"), F.lit("f").alias("field"), F.lit("v").alias("value"), F.lit("c").alias("checksum"))
        fields = payloads.after_conflict(sent, sent, sent.select("key", F.lit("r").alias("revision")), ["key"])
        assert fields.where("action = 'already'").count() == rows and largest_part(fields) <= 250


def test_fields_of_two_entity_types_with_one_key(spark):
    schema = "key string, entity_type string, field string, value string, checksum string"
    source = spark.createDataFrame([("k", "dataset", "name", "a", "A"), ("k", "data_product", "name", "b", "B")], schema)
    stored = spark.createDataFrame([("k", "dataset", "name", "a", "A"), ("k", "data_product", "name", "x", "X")], schema)
    assert [tuple(r)[:3] for r in diffs.changed_fields(source, stored, "key").select("key", "entity_type", "previous").collect()] == [("k", "data_product", "x")]
    with pytest.raises(Exception, match="no checksum of fresh field name"):
        diffs.changed_fields(source.withColumn("checksum", F.lit(None).cast("string")), stored, "key").collect()


def test_numbers_of_any_size(spark):
    rng = random.Random(1)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4000)] + [rng.randrange(10**6) / 100 for _ in range(500)] + [10.0**i for i in range(-320, 309)] + [2.0**i for i in range(-1074, 1024)]
    values += [0.0, -0.0, 5e-324, 1e38, 1e23, 2e23, 1.7976931348623157e308, 9007199254740993.0, 0.1 + 0.2, 2.2250738585072014e-308, 1e-4, 9.999e-5, -1.5]
    values = [x for x in values if math.isfinite(x)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", C.number_text(F.col("x"))).collect()
    for i, text in got:
        x = values[i]
        assert text == json.dumps(int(x) if x.is_integer() else x), x
    for bad in (math.nan, math.inf, -math.inf):
        with pytest.raises(Exception, match="not a finite number"):
            spark.createDataFrame([(bad,)], "x double").select(C.number_text(F.col("x"))).collect()


def test_white_space_of_any_kind_is_stripped(spark):
    texts = ["\tAnna\n", "\xa0Anna　", "  Anna\x1f", "Anna"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0] for r in df.select(C.normal_name(F.col("t"))).collect()} == {"anna"}
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]
    assert one("\tAnna@X.org\xa0", C.normal_email) == "anna@x.org" and one("\t\xa0", C.normal_email) is None
    assert one("\tanna@x.org", T.owner_party)["email"] == "anna@x.org" and one("\t", T.owner_party) is None


def test_lists_of_secrets_and_words_that_only_begin_like_keys(spark):
    texts = ['password: ["hunter2","hunter3"] end', "secretary: Anna", "tokens=abc x", "access_token_2: 'q w' y", "api-key = z"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_replace("t", T.KEYED, f"$1{T.REDACTED}")).collect()]
    assert out == [f"password: {T.REDACTED} end", "secretary: Anna", f"tokens={T.REDACTED} x", f"access_token_2: {T.REDACTED} y", f"api-key = {T.REDACTED}"]


def test_a_late_change_does_not_replace_a_newer_row(spark):
    stored = spark.createDataFrame([("a", 5, "new"), ("b", 1, "old")], "key string, seq int, v string")
    changes = spark.createDataFrame([("a", 3, "late"), ("b", 1, "same"), ("c", 0, "first")], "key string, seq int, v string")
    assert {tuple(r) for r in history.upsert(stored, changes, ["key"], ["seq"]).collect()} == {("a", 5, "new"), ("b", 1, "same"), ("c", 0, "first")}
