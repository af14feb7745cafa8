"""Operators against small brute-force versions, and state and streams across crashes."""

import json
import random
from datetime import datetime
from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from concord.operators import config, diffs, history, identity, parties, payloads, ranks, runs, selection, snapshots
from concord.operators.selection import Rule
from concord.plans.cycle import Options, plan_cycle
from concord.plans.state import State
from concord.sources import catalogs, reads
from concord.streaming import offsets
from concord.streaming.snapshots import POSITION, STATE, follow, position_of


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_last_match_wins_against_a_loop(spark):
    rng = random.Random(11)
    names = [f"{c}.{s}" for c in ("main", "dev", "m2", "x") for s in ("a", "b1", "b2", "zz", "q")]
    df = spark.createDataFrame(list(enumerate(names)), "object_id long, n string")
    for _ in range(6):
        rules = [Rule(f"r{i}", i, "object", rng.choice(["include", "exclude"]), "glob", rng.choice(["*.*", "m*.b?", "dev.*", "*.[ab]*", "x.q", "main.zz", "?2.*", "[!m]*.a"])) for i in range(rng.randint(1, 8))]
        shuffled = rng.sample(rules, len(rules))
        got = {r["n"]: (r["decision"], r["rule_id"]) for r in selection.decide(df, shuffled, scope="object", name=F.col("n"), tags=F.lit(None).cast("array<struct<key:string,value:string>>"), owners=F.lit(None).cast("array<string>")).collect()}
        for n in names:
            hits = [r for r in rules if all(fnmatchcase(a, b) for a, b in zip(n.split("."), r.pattern.split("."), strict=True))]
            assert got[n] == ((hits[-1].decision, hits[-1].rule_id) if hits else ("exclude", None))


def test_rules_are_checked():
    r = Rule("a", 0, "object", "include", "glob", "a.b")
    for bad in ([r, r], [r, Rule("b", 0, "object", "include", "glob", "a.c")], [Rule("c", 1, "dataset", "include", "glob", "a.b")], [Rule("d", 1, "object", "include", "tag", "=x")]):
        with pytest.raises(ValueError):
            selection.check_rules(bad)
    assert selection.patterns_from_rules(selection.rules_from_patterns(["a.b", "c.*", "a.b"])) == ["a.b", "c.*"]


def test_unknown_is_not_empty(spark):
    tags = "array<struct<key:string,value:string>>"
    df = spark.createDataFrame([(1, None), (2, []), (3, [("k", None)]), (4, [("k", "v")])], f"object_id long, t {tags}")
    rules = [Rule("any", 0, "object", "include", "tag", "k"), Rule("one", 1, "object", "exclude", "tag", "k=v")]
    got = {r["object_id"]: (r["decision"], r["decided_by"], tuple(r["undetermined"])) for r in selection.decide(df, rules, scope="object", name=F.lit("a.b"), tags=F.col("t"), owners=F.lit(None).cast("array<string>")).collect()}
    assert got == {1: ("exclude", "default", ("any", "one")), 2: ("exclude", "default", ()), 3: ("include", "rule", ()), 4: ("exclude", "rule", ())}


def test_second_run_plans_nothing(spark):
    e = snapshots.envelopes(spark.range(20), "id", {"a": F.col("id").cast("string"), "b": F.lit("x")})
    assert diffs.changed_fields(e, e, "id").isEmpty()
    s = e.select("id", "checksum").groupBy("id").agg(F.max("checksum").alias("checksum"))
    assert snapshots.snapshot_changes(s, s, "id").isEmpty()
    assert snapshots.snapshot_changes(s, s.limit(0), "id").count() == 20


def test_no_update_path(spark):
    changed = spark.createDataFrame([(1, "x", "a", "v"), (1, "x", "b", "v"), (2, "y", "a", "v")], "k long, entity_type string, field string, value string")
    rows = [("x", True, "a", "rw", True, False), ("x", True, "b", "rw", True, True), ("y", True, "a", "ro", True, None), ("z", False, "a", "rw", True, None)]
    m = spark.createDataFrame(rows, "entity_type string, supported boolean, field string, mode string, partial_update boolean, path_allowed boolean")
    # a manifest of two entity types has one answer for each
    assert {(r["k"], r["field"], r["action"], r["reason"]) for r in diffs.field_diff(changed, m).collect()} == {(1, "a", "drop", "no_update_path"), (1, "b", "patch", None), (2, "a", "drop", "read_only")}
    for kind in ("z", "unheard of", None):
        with pytest.raises(Exception, match="not supported"):
            diffs.field_diff(changed.withColumn("entity_type", F.lit(kind).cast("string")), m).collect()


def test_last_change_of_a_batch(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "key string, seq long")
    assert as_set(diffs.last_change(df, ["key"], ["seq"]).select("key", "seq", "n_changes")) == {("a", 3, 2), ("b", 2, 1)}


def test_neutral_ids_are_stable(spark):
    df = spark.createDataFrame([("s", "dataset", "t", "1"), ("s", "dataset", "t", "2")], "a string, b string, c string, d string")
    ids = [[r[0] for r in df.select(identity.neutral_id(*[F.col(c) for c in "abcd"])).collect()] for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 2 and len(ids[0][0]) == 36


def test_orphan_log_folds(spark):
    log = spark.createDataFrame([("a", 1, 5, 6), ("b", 2, 2, None)], "key string, first_missing_at long, last_missing_at long, resolved_at long")
    seen = spark.createDataFrame([("a", 9), ("c", 3), ("c", 4)], "key string, at long")
    assert as_set(history.record_missing(log, seen, "key")) == {("a", 1, 9, None), ("b", 2, 2, None), ("c", 3, 4, None)}


def test_capped_and_limits(spark):
    ids = spark.range(1).select(*parties.capped(F.sequence(F.lit(1), F.lit(120)))).first()
    assert len(ids[0]) == 100 and ids[1] == 20
    files = spark.createDataFrame([("a", 5), ("b", 50), ("c", 5), ("d", 5)], "name string, size long")
    assert [r["name"] for r in history.within_limits(files, "name", "size", most_bytes=10, total_bytes=10).orderBy("name").collect()] == ["a", "c"]


def test_source_and_target_mapping(spark):
    raw = spark.createDataFrame([("c.s.t", "t", "1", "m", " ", "a@b.c", "VIEW", {"x": "1", "owner": "z"})], "full_name string, name string, table_id string, metastore_id string, comment string, owner string, table_type string, properties map<string,string>")
    tags = spark.createDataFrame([("c.s.t", [("k", None)])], "full_name string, tags array<struct<key:string,value:string>>")
    r = catalogs.datasets(raw, "src", tags).first()
    assert (r["description"], r["owners"][0]["email"], r["classifications"], r["asset_type"], r["custom_attributes"]) == (None, "a@b.c", ["k"], "view", {"x": "1"})
    assert catalogs.datasets(raw, "src", None).first()["tags"] is None
    assert catalogs.datasets(raw, "src", tags.limit(0)).first()["tags"] == []
    schema = "id string, name string, description string, readMe string, activated boolean, ownerId string, keyContacts array<struct<userId:string,role:string>>, tags array<string>, spaceId string, updatedAt string, etag string"
    p = catalogs.target_products(spark.createDataFrame([("1", "n", "", "# x", True, "u1", [("u1", "contact"), ("u2", "Data Steward")], ["a"], "sp", "2024-01-01T00:00:00Z", "e1")], schema), "tgt", "ten").first()
    assert (p["status"], [tuple(o) for o in p["owners"]], p["description"], p["last_modified_at"].year) == ("active", [("u1", "owner"), ("u2", "steward")], None, 2024)
    with pytest.raises(ValueError):
        catalogs.tags_of(spark, raw, "schema_tags", "a; drop")


def test_state_commits_together_and_once(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    assert state.table("objects", STATE).isEmpty()
    one = spark.createDataFrame([("a", "1", 1)], STATE)
    assert state.commit({"objects": one}, 0) and not state.commit({"objects": one.limit(0)}, 0)
    assert state.commit({"other": one}, 1)
    assert state.current()["version"] == 2 and state.table("objects", STATE).count() == 1


def test_a_crash_leaves_the_last_commit(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    one = spark.createDataFrame([("a", "1", 1)], STATE)
    for batch in range(3):
        state.commit({"objects": one.withColumn("seq", F.lit(batch).cast("long"))}, batch)
    versions = tmp_path / "state" / "versions"
    (versions / "4").write_text('{"version": 4, "ba')  # cut off while it was written
    assert state.current()["version"] == 3 and state.table("objects", STATE).first()["seq"] == 2
    (tmp_path / "state" / ".pointer-5").write_text("{}")  # written, never put in place
    assert not state.commit({"objects": one}, 2) and state.commit({"objects": one}, 3)
    assert state.current()["version"] == 5 and State(spark, str(tmp_path / "state")).current()["batch"] == 3


def test_only_touched_buckets_are_written(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    rows = spark.createDataFrame([("a", "1", 1, 0), ("b", "1", 1, 1), ("c", "1", 1, 2)], STATE + ", bucket int")
    state.commit({"objects": rows}, 0, {"objects": [0, 1, 2]})
    state.commit({"objects": rows.where("key = 'b'").withColumn("checksum", F.lit("2"))}, 1, {"objects": [1, 2]})
    assert as_set(state.table("objects", STATE).select("key", "checksum")) == {("a", "1"), ("b", "2")}


def test_offsets_of_other_streams_mean_a_rescan():
    token = offsets.encoded("s", 5)
    assert offsets.decoded(token, "s") == 5
    assert [offsets.decoded(t, "s") for t in (None, "", "{", "[]", '{"stream":"s"}', '{"stream":"s","position":true}', offsets.encoded("t", 5))] == [None] * 7
    assert offsets.later(offsets.encoded("s", 6), token) and not offsets.later(token, token)
    with pytest.raises(ValueError):
        offsets.later(token, offsets.encoded("t", 1))


def test_stream_holds_back_what_is_not_terminal(spark, tmp_path):
    given = tmp_path / "in"
    given.mkdir()
    state = State(spark, str(tmp_path / "state"))
    schema = "key string, checksum string, seq long, terminal boolean"
    stream = spark.readStream.schema(schema).parquet(str(given))

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(given))
        follow(stream, state, str(tmp_path / "checkpoint")).awaitTermination()
        return as_set(state.table("objects", STATE).select("key", "seq")), position_of(state, "objects")

    assert feed([("a", "1", 1, True), ("b", "1", 2, False), ("c", "1", 3, True)]) == ({("a", 1)}, 1)
    assert feed([("d", "1", 4, True)]) == ({("a", 1)}, 1)
    assert feed([("b", "1", 2, True)]) == ({("a", 1), ("b", 2), ("c", 3), ("d", 4)}, 4)
    # a position that can't be read: all that is observed is told as new, and stands alone
    state.commit({"positions": spark.createDataFrame([("objects", "{")], POSITION)})
    assert feed([("e", "1", 5, True)]) == ({("e", 5)}, 5)


def test_stream_follows_snapshots(spark, tmp_path):
    given = tmp_path / "in"
    given.mkdir()
    state = State(spark, str(tmp_path / "state"))
    schema = "key string, checksum string, seq long"
    stream = spark.readStream.schema(schema).parquet(str(given))
    for i, rows in enumerate([[("a", "1", 1), ("b", "1", 2), ("a", "2", 3)], [("b", None, 4), ("c", "1", 5), ("a", "2", 6)], [("c", "9", 7)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(given))
        follow(stream, state, str(tmp_path / "checkpoint")).awaitTermination()
        if i == 1:
            follow(stream, state, str(tmp_path / "checkpoint")).awaitTermination()  # nothing new
    assert as_set(state.table("objects", STATE).select("key", "checksum")) == {("a", "2"), ("c", "9")}
    feed = spark.read.parquet(f"{state.folder}/feed")
    assert as_set(feed.select("batch", "key", "change")) == {(0, "a", "upsert"), (0, "b", "upsert"), (1, "b", "deleted"), (1, "c", "upsert"), (2, "c", "upsert")}


def test_a_run_is_closed_once(spark):
    begun = spark.createDataFrame([(i, "p", "dataset", False, datetime(2024, 1, 1)) for i in (1, 2)], "run_id long, pair string, entity_type string, dry_run boolean, started_at timestamp")
    table = runs.started(begun)
    records = spark.createDataFrame([(1, "written", True), (1, "filtered", False)], "run_id long, outcome string, was_read boolean")
    errors = spark.createDataFrame([(1, "AuthError", "e", True)], "run_id long, kind string, endpoint string, fatal boolean")
    report = spark.createDataFrame([(1, "ok", datetime(2024, 1, 1, 0, 0, 5))], "run_id long, status string, finished_at timestamp")
    after = runs.finished(table, report, records, errors)
    assert after.columns == table.columns and after.schema.simpleString() == table.schema.simpleString()
    one, two = after.orderBy("run_id").collect()
    assert (one["status"], one["duration_s"], one["n_written"], one["n_filtered"], one["read"], one["errors"], one["quarantined"]) == ("ok", 5.0, 1, 1, 1, 1, ["e"]) and two["status"] == "running"
    assert as_set(runs.transitions(after, spark.createDataFrame([(1,), (2,), (2,), (3,)], "run_id long"))) == {(1, "already_finished"), (2, "closed_twice"), (3, "unknown_run")}
    again = runs.finished(after, report.withColumn("status", F.lit("failed")), records, errors)
    assert as_set(again.select("run_id", "status")) == {(1, "ok"), (2, "running")}
    assert as_set(runs.exit_code(after)) == {(3, "ok")} and as_set(runs.exit_code(after.limit(0))) == {(0, "ok")}
    assert runs.overall_health(spark.createDataFrame([], "name string, health string, reason string")).first()["healthy"]


def test_configuration(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"a": {"x": 1, "y": 2}, "b": 1}')
    assert config.load_config(str(path), {"CONCORD_A__X": "5", "OTHER": "z"}, {"b": 3}) == {"a": {"x": "5", "y": 2}, "b": 3}
    path.write_text("[]")
    with pytest.raises(ValueError):
        config.load_config(str(path), {}, {})
    review = config.save_review(str(tmp_path / "r.json"), [{"proposal_id": "b"}, {"proposal_id": "a"}])
    assert [p["proposal_id"] for p in config.load_review(review)] == ["a", "b"] and len(list(tmp_path.iterdir())) == 2
    for bad in ('{"kind":"identity-review","version":2,"proposals":[]}', '{"kind":"identity-review","version":1,"proposals":[{"proposal_id":1},{"proposal_id":1}]}', "[]"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            config.load_review(str(path))
    none = spark.createDataFrame([("a", "c")], "name string, connector string")
    pairs = spark.createDataFrame([("p", "a", "a")], "name string, source string, target string")
    patterns = spark.createDataFrame([("p", 0, "x.*")], "pair string, pos int, pattern string")
    assert all(df.isEmpty() for df in config.first_import(3, none, pairs, patterns))
    log, generation = config.audited(spark.createDataFrame([(4,)], "generation long"), spark.createDataFrame([("update", "a", "a")], "action string, was string, now string"))
    assert log.isEmpty() and generation.first()[0] == 4


def test_reads(spark):
    objects = spark.createDataFrame([("dataset", "1", "x")], "entity_type string, native_key string, v string")
    refs = spark.createDataFrame([("dataset", "1"), ("dataset", "2")], "entity_type string, native_key string")
    assert as_set(reads.read_entities(objects, refs, ["dataset"]).select("native_key", "found", "v")) == {("1", True, "x"), ("2", False, None)}
    with pytest.raises(Exception, match="no reads"):
        reads.read_entities(objects, refs, ["data_product"]).collect()
    fresh = spark.createDataFrame([("a", "1", "t", "n")], reads.CURSOR)
    broken = spark.createDataFrame([("a",)], "key string")
    for cursor in (None, broken):
        changes, after = reads.list_changed(fresh, cursor)
        assert as_set(changes.select("key", "change")) == {("a", "upsert")}
    assert reads.list_changed(after, after)[0].isEmpty()
    gone = reads.list_changed(fresh.limit(0), fresh)[0].first()
    assert (gone["change"], gone["tenant_id"], gone["full_name"]) == ("deleted", "t", "n")
    order = spark.createDataFrame([("b", "upsert"), ("a", "deleted"), ("a", "upsert")], "key string, change string")
    assert [tuple(r) for r in reads.in_order(order).collect()] == [("a", "upsert"), ("b", "upsert"), ("a", "deleted")]
    assert ranks.page(spark.range(5), ["id"], 3, 2)[1] is False and ranks.page(spark.range(6), ["id"], 3, 2)[1] is True
    assert reads.matching_schemas(spark.createDataFrame([("a", "b")], "catalog_name string, schema_name string"), []).isEmpty()
    assert reads.tags_of_catalogs(spark, None, "schema_tags", ["a"]) is None


def test_payloads(spark):
    writes = spark.createDataFrame([("k", "name", 'a"b', None), ("k", "tags", '["x"]', None), ("k", "owners", "[]", 2), ("k", "dataset_refs", "[]", 0)], "key string, field string, value string, n_asked int")
    ops = payloads.operations(writes)
    assert as_set(ops.select("path", "value")) == {("/name", '"a\\"b"'), ("/tags", '["x"]'), ("/datasetIds", "[]")}
    with pytest.raises(Exception, match="no path"):
        payloads.operations(writes.withColumn("field", F.lit("glossary"))).collect()
    current = spark.createDataFrame([("k", "/tags", '["x"]'), ("k", "/name", '"b"')], "key string, path string, value string")
    revisions = spark.createDataFrame([("k", "r1")], "key string, if_match string")
    p = payloads.patches(payloads.still_needed(ops, current), revisions).first()
    assert json.loads(p["patch"]) == [{"op": "replace", "path": "/datasetIds", "value": []}, {"op": "replace", "path": "/name", "value": 'a"b'}] and (p["n_operations"], p["if_match"]) == (2, "r1")


def test_policies_withhold(spark):
    rows = "key string, entity_type string, field string, value string, checksum string"
    source = spark.createDataFrame([("k", "t", "name", "a", "1"), ("k", "t", "tags", "b", "2")], rows)
    manifest = spark.createDataFrame([("t", True, "name", "rw", True, None), ("t", True, "tags", "rw", False, None)], "entity_type string, supported boolean, field string, mode string, partial_update boolean, path_allowed boolean")
    changes = spark.createDataFrame([("k", "t", True, False, True, "confirmed")], "key string, entity_type string, selected boolean, deleted boolean, bound boolean, target string")
    no_tags = lambda df: df.withColumn("withheld", F.coalesce("withheld", F.when(F.col("field") == "tags", "policy")))
    records, writes = plan_cycle(changes, source, source.limit(0), source.limit(0), manifest, Options(policies=(no_tags,)))
    assert as_set(writes.select("field")) == {("name",)} and records.first()["n_writes"] == 1
    readonly = manifest.withColumn("mode", F.lit("ro"))
    records, _ = plan_cycle(changes.withColumn("target", F.lit("none")), source, source.limit(0), source.limit(0), readonly, Options(create=True))
    assert tuple(records.select("outcome", "reason", "holds").first()) == ("skipped", "capability_refused", True)


def test_members_are_cut_before_they_are_listed(spark):
    rows = [("a", i, i % 2 == 0) for i in range(250)] + [("a", 3, None), ("a", None, True), ("b", None, False), ("c", 7, None), (None, 1, True)]
    members = spark.createDataFrame(rows, "key string, ref long, consumable boolean")
    got = {r["key"]: r for r in payloads.listed_members(members).collect()}
    assert {k: (r["n_refs"], r["n_resolved"], r["n_distinct"], r["n_consumable"]) for k, r in got.items()} == {"a": (252, 251, 250, 126), "b": (1, 0, 0, 0), "c": (1, 1, 1, 0), None: (1, 1, 1, 1)}
    assert got["a"]["refs"] == [str(i) for i in range(101)] and got["a"]["consumable"] == [str(i) for i in range(0, 101, 2)]
    assert (got["b"]["refs"], got["c"]["refs"], got["c"]["consumable"], got[None]["consumable"]) == ([], ["7"], [], ["1"])
    told = [c for c in ("name", "description", "documentation", "placement")]
    products = payloads.listed_members(members).where("key = 'a'").select("*", *[F.lit("x").alias(c) for c in told], F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("contacts"), F.lit(0).alias("n_owners"))
    body = payloads.create_bodies(products, "x").first()
    assert body["skipped"] == ["dataset_refs: 1 not resolved", "dataset_refs: 150 beyond the cap", "dataset_refs: 76 consumable but not sent"]
    assert len(json.loads(body["body"])["datasetIds"]) == 100 and len(json.loads(body["body"])["apiConsumableDatasetIds"]) == 50
    assert payloads.listed_members(members.limit(0)).isEmpty()
