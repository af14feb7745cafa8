"""Registered queries against their SQL, and the pipeline's stages."""

import os
import random
from collections import Counter

import duckdb
import pytest
from conftest import SF

import __spark_entry__
import corpus_pipeline
from concord.llm import mixing, quality, queries
from tools.compare import rows

WORDS = ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(3 + i % 5)) for i in range(800)]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in rel.description], rel.fetchall())


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names and {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_pipeline_stages_follow_from_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        assert after.join(before, "doc_id", "left_anti").isEmpty(), name
        if "mixing" not in name:
            assert 0 < after.count() <= before.count() and after.count() == after.select("doc_id").distinct().count()
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert out.count() == before.count() and max(sizes) - min(sizes) <= 1 and {*columns} < {*out.columns}


def test_pipeline_against_plain_versions_on_odd_tables(spark, tmp_path):
    """Each stage's decisions on a small table of nulls, empty and repeated rows, a long text and clashing columns."""
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    item, same = prose(40), prose(80)
    edited = same.split()
    edited[40] = "changed"
    texts = [prose(60) for _ in range(30)] + [same, same, " ".join(edited), f"{prose(20)} {item} {prose(20)}", "", None, None, "one two", prose(60) + " " + prose(15_000)]
    junk = ["$$$ !!! 0001 2222 @@@ ### " * 8 + str(i) for i in range(30)]
    rows = [(i if i != 5 else None, t, "en", ["a", "b", None][i % 3], None, "r", 1.5) for i, t in enumerate(texts + junk)] + [(7, texts[7], "en", "b", None, "r", 1.5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, size double"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    good = {i for i in range(len(texts)) if texts[i]}
    labels = [(i, int(i in good), 0) for i in range(len(rows) - 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda df: Counter((r["doc_id"], r["text"], r["source"], r["row"], r["size"]) for r in df.collect())
    stages, before = dict(corpus_pipeline.STAGES), docs
    sf = str(tmp_path)
    # quality: what it scores by itself decides, row by row
    kept = stages["quality classifier"](spark, before, sf)
    score = {r["text"] or "": r["score"] for r in quality.with_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    want = Counter({k: n for k, n in key(before).items() if score[k[1] or ""] >= 0.3})
    assert key(kept) == want and kept.columns == docs.columns
    assert not any((t or "").startswith("$$$") for _, t, *_ in want) and sum(t in texts[:30] for _, t, *_ in want) >= 29
    # near dedup: of texts that are linked or equal the row of the least id stays
    before = kept.cache()
    kept = stages["near dedup"](spark, before, sf).cache()
    left = key(kept)
    groups = {}
    for k in key(before):
        t = "same" if k[1] in (same, " ".join(edited)) else k[1] or ""
        groups.setdefault(t, []).append(k)
    assert left == Counter(min(g, key=lambda k: (k[0] is not None, k[0] or 0)) for g in groups.values())
    # decontamination: only what holds the item goes
    before, kept = kept, stages["benchmark decontamination"](spark, kept, sf).cache()
    assert key(kept) == Counter({k: n for k, n in key(before).items() if item not in (k[1] or "")}) and len(key(kept)) == len(key(before)) - 1
    # mixing: whole documents, at most three times each, every source near its target
    before, kept = kept, stages["source mixing"](spark, kept, sf).cache()
    copies, given = key(kept), key(before)
    assert set(copies) <= set(given) and max(copies.values()) <= 3 and kept.columns == docs.columns
    told = {(r["doc_id"], r["taken"]): r for r in mixing.mix_documents(before).collect()}
    taken = Counter()
    for k, n in copies.items():
        taken[k[0]] += n * len((k[1] or "").split())
    assert all(taken[i] == t for i, t in told if i is not None)
    # sharding: every row once, sizes at most one apart, slots without gaps
    out = corpus_pipeline.run(spark, sf)
    assert key(out) == copies and {*docs.columns} < {*out.columns}
    by = {}
    for r in out.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert out.schema["size"].dataType.typeName() == "double"


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
