"""Values that mean the same have the same checksum; others don't."""

import json

import pytest
from pyspark.sql import functions as F

from concord.functions import canonical as C
from concord.functions import text as T
from concord.operators import snapshots

CLASSES = [
    ["", "  ", "\n\t", "\r\n\v\f"],
    ["a", " a ", "a\n"],
    ["a  b"],
    [" a"],
    ["x\ny", "x\r\ny", "x\ry"],
    ["é", "é"],
    ["ﬁ"],
    ["fi"],
    ["2024-05-01T10:00:00Z", "2024-05-01T12:00:00+02:00", "2024-05-01T10:00:00.000400Z", "2024-05-01t10:00:00z", "2024-05-01 12:00:00.0+0200", "2024-04-30 10:01:00-2359"],
    ["2024-05-01T10:00:00.001Z"],
    ["2024-05-01T10:00:00"],
    ["2024-05-01"],
]


def test_canonical_strings(spark):
    given = [(i, v) for i, group in enumerate(CLASSES) for v in group]
    out = spark.createDataFrame(given, "i int, v string").select("i", C.canonical_string(F.col("v")).alias("c"), C.checksum(C.canonical_string(F.col("v"))).alias("s")).collect()
    by = {}
    for r in out:
        by.setdefault(r["i"], set()).add(r["s"])
    assert all(len(s) == 1 for s in by.values()), [(r["i"], r["c"]) for r in out]
    assert len(set.union(*by.values())) == len(CLASSES)


ODD_INSTANTS = [
    "2024-05-01T25:00:00Z", "2024-02-30T10:00:00Z", "2024-05-01T10:00:00+24:00", "2024-05-01T10:00:00+02:60", "2024-05-01T10:00:00 Z", "x2024-05-01T10:00:00Z", "2024-05-01T10:00:00Z\n", "2024-05-01T10:00Z", "0999-05-01T10:00:00.9999999+00:00",
    "2024-05-01T10:00:00.1+01:00", "2024-05-01T10:00:00.1234567-0130", "2024-05-01T23:59:59.9999Z",
]


def test_columns_and_json_agree(spark):
    given = [v for group in CLASSES for v in group] + ODD_INSTANTS
    got = spark.createDataFrame([(v,) for v in given], "v string").select("v", C.canonical_string(F.col("v")).alias("c")).collect()
    assert [(r["v"], r["c"]) for r in got] == [(v, json.loads(C.canonical_json_text(json.dumps(v)))) for v in given]


def test_numbers_as_json(spark):
    given = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-4, 5e-4, 9.999e-5, 2.5e-300, 1.25e-10, 12345678.25, 4503599627370497.5, 1e15, 1e22, 1e23, 2.0**63, -(2.0**63), 2.0**70, 1.7e37, 123456789012345680.0, 1 / 3]
    got = spark.createDataFrame([(x,) for x in given], "x double").select(C.number_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [C.canonical_json_text(json.dumps(x)) for x in given]
    assert [C.canonical_json_text(json.dumps(x)) for x in (1e23, -0.0)] == ["99999999999999991611392", "0"]


def test_keys_are_no_instants_and_writing_changes_nothing():
    text = '{" 2024-05-01T12:00:00+02:00 ": [2.0, " b ", 1], "a": null}'
    assert C.canonical_json_text(text, True) == '{"2024-05-01T12:00:00+02:00":["b",1,2],"a":null}'
    assert C.faithful_json_text(text) == '{" 2024-05-01T12:00:00+02:00 ":[2.0," b ",1],"a":null}'
    with pytest.raises(ValueError):
        C.faithful_json_text("[NaN]")


def test_order_of_arrays_by_field(spark):
    names = ["tags", "dataset_refs", "datasetRefs", "columns", "customAttributes", "TermRelations"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(C.ordered(F.col("n"))).collect()
    assert [r[0] for r in got] == [False, False, False, True, True, False] == [not snapshots.order_free(n) for n in names]


SECRETS = [
    ("Bearer\tabc.def x", "Bearer ***REDACTED*** x"), ("say Bearer abc!secret.", "say Bearer ***REDACTED***"), ('password: "two words" x', "password: ***REDACTED*** x"), ("a=1; apiKey = 'x;\\' y'; b", "a=1; apiKey = ***REDACTED***; b"),
    ("Authorization: Basic dXNl x", "Authorization: ***REDACTED*** x"), ('{"client_secret": "a\\"b", "n": 1}', '{"client_secret": ***REDACTED***, "n": 1}'), ("private_key=k, access-key:v", "private_key=***REDACTED***, access-key:***REDACTED***"),
    ("forebearer z", "forebearer z"), ("no secrets here", "no secrets here"), ("credential\u00a0=\u00a0q", "credential\u00a0=\u00a0***REDACTED***"), ("", ""),
]


def test_secrets_are_redacted(spark):
    got = spark.createDataFrame([(a,) for a, _ in SECRETS], "t string").select(T.redacted(F.col("t"))).collect()
    assert [r[0] for r in got] == [b for _, b in SECRETS]
    long = "token" * 20_000 + "=" + "x" * 100_000
    assert spark.createDataFrame([(long,)], "t string").select(T.redacted(F.col("t"))).first()[0].endswith("=***REDACTED***")
    assert T.redacted_json_text('{"a":{"Refresh-Token":{"x":1}},"b":["basic Zm9v!"]}') == '{"a":{"Refresh-Token":"***REDACTED***"},"b":["basic ***REDACTED***"]}'


JSON = [
    ['{"a":1,"b":[1,2]}', '{"b":[1.0,2e0],"a":1.000}', '{ "b" : [1,2], "a" : 1 }'],
    ['{"a":"1","b":[1,2]}'],
    ['{"a":1,"b":[2,1]}'],
    ['{"a":null}'],
    ["{}"],
    ["[]"],
    ["null"],
    ["true"],
    ["1180591620717411303424", "1180591620717411303424.0", "1.180591620717411303424e21"],
    ["0", "-0.0", "0.0"],
    ['{"ké":" x "}', '{"ké":"x"}'],
]


def test_canonical_json(spark):
    texts = [[C.canonical_json_text(v) for v in group] for group in JSON]
    assert all(len(set(g)) == 1 for g in texts), texts
    assert len({g[0] for g in texts}) == len(JSON)
    assert C.canonical_json_text('{"a":[2,1,1]}', True) == C.canonical_json_text('{"a":[1,2,1]}', True) != C.canonical_json_text('{"a":[1,2]}', True)
    for bad in ("NaN", "[Infinity]", '{"a":1," a":2}', "[" * 70 + "]" * 70):
        with pytest.raises(ValueError):
            C.canonical_json_text(bad)
    got = spark.createDataFrame([(None,), ('{"b":1,"a":" x"}',)], "t string").select(C.canonical_json(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == [None, '{"a":"x","b":1}']


def test_numbers_names_and_mail(spark):
    one = spark.range(1)
    got = one.select(C.number_text(F.lit(1.0)), C.number_text(F.lit(-0.0)), C.number_text(F.lit(1.5)), C.normal_name(F.lit(" STRASSE ßﬁ ")), C.normal_email(F.lit(" A@B.c ")), C.normal_email(F.lit("  "))).first()
    assert list(got) == ["1", "0", "1.5", "strasse ssfi", "a@b.c", None]
    with pytest.raises(Exception, match="finite"):
        one.select(C.number_text(F.lit(float("nan")))).collect()


def test_globs_follow_fnmatch(spark):
    from fnmatch import fnmatchcase

    names = ["a.b", "a.b\n", "A.b", "a.b.c", "ax.b", "a-.b", "x[.b", "a.", None]
    patterns = ["a.b", "a*.b", "?.b", "[ab].b", "[!a].b", "*.*", "a[xyz].b"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", *[T.glob_matches(F.col("n"), p).alias(str(i)) for i, p in enumerate(patterns)])
    for r in df.collect():
        for i, p in enumerate(patterns):
            n = r["n"]
            want = None if n is None else n.count(".") == 1 and all(fnmatchcase(x, y) for x, y in zip(n.split("."), p.split("."), strict=True))
            assert r[str(i)] == want, (n, p)
    for bad in ("a", "a.b.c", "a b.c", ".b", "a-b.c", "[a-c].b"):
        with pytest.raises(ValueError):
            T.check_glob(bad, 2)


def test_small_conversions(spark):
    uid = "123E4567-e89b-12d3-a456-426614174000"
    df = spark.createDataFrame([("a@b.c",), (uid,), ("group",), (" ",), (None,)], "o string").select(T.owner_party(F.col("o")).alias("p"))
    assert [tuple(r["p"]) if r["p"] else None for r in df.collect()] == [(None, None, "a@b.c", "owner"), (uid, None, None, "owner"), (None, "group", None, "owner"), None, None]
    got = spark.range(1).select(
        T.asset_type(F.lit("MATERIALIZED_VIEW")), T.asset_type(F.lit("FOREIGN")), T.asset_type(F.lit("x")), T.party_role(F.lit(" Data Steward")), T.redacted(F.lit("api_key=abc x Bearer zz.z")), T.snake(F.lit("dataProductRef")),
        T.qualified_name(F.lit("a."), F.lit("c.d"), 2), T.email_domain(F.lit("a@b.c")), T.some_of(F.array(*[F.lit(str(i)) for i in range(7)])),
    ).first()
    assert list(got) == ["view", "table", "other", "steward", "api_key=***REDACTED*** x Bearer ***REDACTED***", "data_product_ref", "c.d", "b.c", "0, 1, 2, 3, 4 and 2 more"]
    assert T.literal_catalogs(["b.x", "a*.y", "b.z", "c.*"]) == ["b", "c"]


def test_slugs_keys_and_cursors(spark):
    got = spark.range(1).select(
        T.slug(F.lit(" Ä Über--uns! ")), T.slug(F.lit("***")), T.slug(F.lit("ab " * 60)), T.endpoint_key(F.lit(" my-end.point ")), T.cursor_parts(F.lit("%%%")), T.cursor_parts(F.lit("YWJj")),
        T.cursor_parts(T.cursor(F.lit("2024-05-01 10:00:00.5").cast("timestamp"), F.lit("k|1"))), T.jitter(F.lit(900.0)), T.jitter(F.lit(50.0)),
    ).first()
    assert list(got)[:6] == ["ber-uns", "item", "-".join(["ab"] * 27)[:80].rstrip("-"), "MY_END_POINT", None, None]
    assert (got[6]["at"].microsecond, got[6]["key"], got[7], got[8]) == (500000, "k|1", 60.0, 5.0)
    with pytest.raises(Exception, match="letter or digit"):
        spark.range(1).select(T.endpoint_key(F.lit("--"))).collect()


def test_json_faults_cost_their_own_row_only(spark):
    given = {
        '{"b":1.0,"a":" x"}': ('{"b":1.0,"a":" x"}', '{"a":"x","b":1}', None), "": (None, None, "not_json"), "{'a':1}": (None, None, "not_json"), "[1,]": (None, None, "not_json"), "NaN": (None, None, "not_finite"),
        "[1e999]": (None, None, "not_finite"), "[" * 70 + "]" * 70: (None, None, "too_deep"), "[" * 200_000: (None, None, "too_deep"), '{"a":1," a":2}': (None, None, "keys_collide"),
        '["\\ud800"]': (None, None, "not_unicode"), "1" * 5000: (None, None, "number_too_long"), None: (None, None, None),
    }
    texts = list(given)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.json_projections(F.col("t")).alias("j")).select("i", "j.*")
    assert {texts[r[0]]: tuple(r)[1:] for r in df.collect()} == given
    assert {f for _, _, f in given.values()} - {None} == set(C.FAULTS)
    empty = spark.createDataFrame([], "t string").select(C.json_projections(F.col("t"), sort_arrays=True).alias("j"))
    assert empty.collect() == []
    for text, (_, _, fault) in given.items():
        if fault and fault != "not_unicode":
            with pytest.raises(C.Refused):
                C.canonical_json_text(text)


def test_sound_envelopes(spark):
    """One faulty field takes its object out, all others are as json_envelopes has them; clashing names."""
    good = [(1, '["b","a"]', "{}"), (2, None, "[1.0]")]
    rows = spark.createDataFrame([*good, (3, '["a"]', "{"), (4, "[NaN]", "{")], "id int, _json0 string, field string")
    fields = {"tags": F.col("_json0"), "columns": F.col("field")}
    got = snapshots.json_envelopes_or_faults(rows, "id", fields, src=F.lit("s"))
    assert {(r["id"], r["object_fault"]) for r in got.collect()} == {(1, None), (2, None), (3, "columns:not_json"), (4, "tags:not_finite")}
    sound = snapshots.sound_envelopes(got)
    plain = snapshots.json_envelopes(spark.createDataFrame(good, "id int, _json0 string, field string"), "id", fields, src=F.lit("s")).select(sound.columns)
    assert sorted(map(repr, sound.collect())) == sorted(map(repr, plain.collect()))
    plan = sound._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
