"""N-gram join, whitening and hard negatives against brute force on small tables with nulls, ties, repeats and odd vectors."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from concord.llm import hard_negatives, ngram_join, queries, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VECTORS = "vec_id long, embedding array<float>, label int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_components(rows, words=5, percent=80):
    """(id, size of set, component) of each row."""
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return Counter((x, len(s), least.get(find(i))) for i, ((x, _), s) in enumerate(zip(rows, sets, strict=True)))


def copies(seed, n_families=6, n_copies=12, n_words=120):
    """Families of texts whose copies have a few words changed, so that similarities lie around 0.8, in chains too."""
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 7))) for _ in range(500)] + ["Été", "ñandú", "日本"]
    out = []
    for _ in range(n_families):
        text = [rng.choice(lexicon) for _ in range(rng.randint(n_words // 2, n_words))]
        for _ in range(n_copies):
            own = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(lexicon)
            if rng.random() < 0.3:
                text = own  # a chain
            out.append(" ".join(own))
    return out, lexicon


def document_rows(seed=5):
    out, lexicon = copies(seed)
    rng = random.Random(seed)
    out += ["", None, " \t", "One", "one", "ONE two", "one two", "a b c d e", "a b c d", "A  b\nc d e", out[0].upper(), out[0], out[0]]
    out += [" ".join(rng.choice(lexicon) for _ in range(5000))]
    out += [out[-1] + " tail", "x " * 400, "x " * 20, "É é ß", "é É ß"]
    rows = [(None if i in (3, 70) else i, t) for i, t in enumerate(out)]
    rng.shuffle(rows)
    return rows + [(7, out[7]), (None, out[20]), (None, None)]


def test_ngram_components(spark):
    rows = document_rows()
    want = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"chunk_bytes": 3000, "bucket_keys": 400, "block": 3, "cluster_parts": 1}):
        got = ngram_join.ngram_components(df, **options)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert Counter(tuple(r) for r in got.collect()) == want, options


def test_ngram_components_by_other_measures(spark):
    rows = document_rows(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_components(df, words=2, percent=60, block=5, block_tokens=900)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows, 2, 60)


def test_ngram_components_in_one_large_group(spark):
    """A third of all rows are one text, another third near copies of one another, not all of which link."""
    out, _ = copies(3, n_families=1, n_copies=150, n_words=90)
    rows = [(i, t) for i, t in enumerate(out + [out[0]] * 150 + copies(4, 30, 5)[0])]
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_components(df, block=10, cluster_parts=2, chunk_bytes=4000)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_ngram_components_keep_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_components(empty).collect() == []
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "id", "n", "chunk", "same", "component", "least", "tokens")})
    assert sorted(tuple(r) for r in ngram_join.ngram_components(df).collect()) == [(1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_prefix_tree_finds_what_all_pairs_find():
    rng = random.Random(8)
    for _ in range(60):
        universe = rng.randint(3, 40)
        base = rng.sample(range(universe), rng.randint(1, universe))
        sets = []
        for _ in range(rng.randint(3, 25)):
            own = set(base if rng.random() < 0.7 else rng.sample(range(universe), rng.randint(1, universe)))
            for _ in range(rng.randint(0, 3)):
                own ^= {rng.randrange(universe)}
            sets.append(sorted(own))
        sizes = np.array([len(s) + rng.randint(0, 2) for s in sets])
        sides = np.array([-1] * len(sets)) if rng.random() < 0.5 else np.array([0] + [rng.randint(0, 1) for _ in sets[2:]] + [1])
        tokens = [np.array(s, "<u8").tobytes() for s in sets]
        percent = rng.choice([50, 80, 100])
        fits = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and (sides[0] < 0 or sides[i] != sides[j]) and 100 * len(set(sets[i]) & set(sets[j])) >= percent * (sizes[i] + sizes[j] - len(set(sets[i]) & set(sets[j])))}
        got = ngram_join.block_links(tokens, sizes, sides, [bytes([i]) for i in range(len(sets))], percent)
        assert set(got) <= fits

        def classes(links, n=len(sets)):
            root = list(range(n))
            for i, j in links:
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
            return {frozenset(i for i in range(n) if root[i] == r) for r in root}

        assert classes(got) == classes(fits)


def brute_whitening(rows, scale=64, offset=1_000_000, k=32):
    x = np.array([[math.floor(scale * float(np.float32(c))) + offset for c in v] for _, v in rows], dtype=object)
    n = len(x)
    d = n * x - x.sum(axis=0)
    centred = (d / n).astype(float)
    covariance = centred.T @ centred / n
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return (d * d).sum(axis=1), centred @ v / np.sqrt(e), e / np.trace(covariance)


def vector_rows(spark):
    return [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]


def test_whitening_against_plain_eigenvectors(spark):
    rows = vector_rows(spark)
    bad = [(-1, None), (-2, [float("nan")] * 64), (-3, [None] * 64), (-4, [float("inf")] * 64), (-5, [1e30] * 64)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad + [(None, rows[0][1]), (rows[1][0], rows[1][1])]], VECTORS).repartition(4)
    rows += [(None, rows[0][1]), rows[1]]
    deviation, w, explained = brute_whitening(rows)
    found = whitening.whitening_report(df).collect()
    assert len(found) == 32 * len(rows)
    signs: dict[int, float] = {}
    by_id: dict = {}
    for i, (x, _) in enumerate(rows):
        by_id.setdefault(x, []).append(i)
    for r in found:
        i = by_id[r["vec_id"]][0]
        c = r["component"] - 1
        sign = signs.setdefault(c, math.copysign(1, r["whitened"] * w[i, c]))
        assert r["n"] == len(rows) and r["deviation"] == deviation[i] and r["identity_error"] < 1e-9
        assert abs(r["whitened"] - sign * w[i, c]) < 1e-6 and abs(r["explained"] / explained[c] - 1) < 1e-9


def test_whitening_of_few_dimensions_by_iterations_and_of_odd_tables(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(110)], 0) for i in range(400)]
    df = spark.createDataFrame(rows, VECTORS)
    monkeypatch.setattr(whitening, "WHOLE_DIMS", 50)
    model = whitening.fit_whitening(df, components=4)
    _, w, explained = brute_whitening([(i, v) for i, v, _ in rows], k=4)
    assert np.allclose(model.explained, explained, rtol=1e-8)
    got = {r["vec_id"]: r["whitened"] for r in whitening.whitened_rows(df, model).collect()}
    assert np.allclose(np.abs([got[i] for i in range(400)]), np.abs(w), atol=1e-6)
    monkeypatch.undo()
    for odd in ([], [(i, [0.5, 0.5], 0) for i in range(5)], [(1, [], 0), (2, [], 0)]):
        assert whitening.whitening_report(spark.createDataFrame(odd, VECTORS)).collect() == []
    # a constant dimension and short vectors, filled with 0; clashing names
    some = spark.createDataFrame([(i, [float(i), 1.0, 0.0][: 2 + i % 2], 0) for i in range(6)], VECTORS).withColumns({c: F.lit("clash") for c in ("id", "x", "n", "whitened", "component")})
    out = whitening.whitening_report(some).collect()
    assert {r["component"] for r in out} == {1} and len(out) == 6 and abs(out[0]["explained"] - 1) < 1e-12


def test_whitening_of_numbers_beyond_64_bits(spark):
    rows = [(i, [float(2**40 * i), float(i % 3)], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    model = whitening.fit_whitening(df)
    x = [[64 * 2**40 * i + 1_000_000, 64 * (i % 3) + 1_000_000] for i in range(40)]
    assert model.sums == tuple(sum(c) for c in zip(*x, strict=True)) and len(model.variances) == 1
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened_rows(df, model).collect()}
    exact = [sum((40 * c - s) ** 2 for c, s in zip(v, model.sums, strict=True)) for v in x]
    assert [got[i] for i in range(40)] == [d if d < 2**63 else None for d in exact]


def brute_negatives(rows, scale=256, every=100, k=5, low=80):
    fine = [(i, [math.floor(scale * float(np.float32(c))) for c in v], x) for i, v, x in rows if i is not None and x is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    width = max((len(v) for _, v, _ in fine), default=0)
    fine = [(i, v + [0] * (width - len(v)), x) for i, v, x in fine]
    out = Counter()
    for a, v, label in fine:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, x) for i, w, x in fine)
        for p, positive, _ in [(s, i, x) for s, i, x in scored if x == label and i != a][:k]:
            fits = [(s, i) for s, i, x in scored if x != label and low * -p <= 100 * -s <= 100 * -p][:k]
            out.update((a, positive, r, i, -p, -s) for r, (s, i) in enumerate(fits, 1))
    return out


def negatives(df, **options):
    return Counter(tuple(r) for r in hard_negatives.hard_negatives(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)], rng.randrange(3)) for i in range(400)]
    rows += [(500 + i, [0.5, 0.5, 0.5], i % 3) for i in range(60)]  # ties, in all labels
    rows += [(600, None, 1), (601, [0.1, None, 0.2], 1), (602, [float("nan")] * 3, 1), (603, [1.0, 0.0, 0.0], None), (None, [1.0, 1.0, 1.0], 1), (700, [0.5, 0.5], 2), (800, [0.0, 0.0, 0.0], 0), rows[100], rows[3], rows[3]]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    want = brute_negatives(rows)
    assert len(want) > 100
    assert negatives(df) == want
    assert negatives(df, digit_bits=3, part_bytes=400, group_anchors=2, tile=1) == want
    assert negatives(df, every=50, positives=30, negatives=30, low_percent=0) == brute_negatives(rows, every=50, k=30, low=0)
    clash = df.withColumns({c: F.lit("clash") for c in ("id", "v", "part", "anchor", "w", "score", "windows", "group")})
    assert negatives(clash) == want


def test_hard_negatives_one_vector_for_a_third_of_rows(spark):
    rows = [(i, [0.6, 0.8] if i % 3 == 0 else [math.cos(i), math.sin(i)], i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, VECTORS)
    assert negatives(df, part_bytes=2000) == brute_negatives(rows)
    for odd in ([], [(100, [], 1), (200, [], 1), (201, [], 2)]):
        assert negatives(spark.createDataFrame(odd, VECTORS)) == brute_negatives(odd)


@pytest.mark.parametrize("power", [14, 24])
def test_hard_negatives_scores_of_any_size(spark, power):
    """Products that floats of 32 bits, or of 64, don't hold."""
    rng = random.Random(power)
    rows = [(i, [float(rng.randrange(-(2**power), 2**power)) / 256 for _ in range(4)], i % 2) for i in range(120)]
    big = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fine = [(i, [np.float64(c) for c in v], x) for i, v, x in rows]
    want = Counter()
    for a, v, label in fine:
        if a % 20 == 0:
            scored = sorted((-sum(int(256 * p) * int(256 * q) for p, q in zip(v, w, strict=True)), i, x) for i, w, x in fine)
            for p, positive, _ in [t for t in scored if t[2] == label and t[1] != a][:5]:
                fits = [(s, i) for s, i, x in scored if x != label and 80 * -p <= 100 * -s <= 100 * -p][:5]
                want.update((a, positive, r, i, -p, -s) for r, (s, i) in enumerate(fits, 1))
    assert want and negatives(big, every=20) == want


def test_registered_whitening_has_all_rows(spark):
    out = queries.op12_embedding_whitening(spark, SF)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 32 * spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_mixing_spreads_equal_rows_and_rows_of_low_quality(spark):
    """A third of all rows are equal, and half of the others hold no letters: the sample is that of one sort, and no cell holds many."""
    from concord.llm import mixing

    rng = random.Random(3)
    texts = ["same words here"] * 600 + [" ".join(str(rng.randrange(100)) for _ in range(rng.randint(1, 9))) for _ in range(600)] + [" ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    rows = [(None if i < 600 else i, t, ["a", "b", None][(i // 7) % 3] if i >= 600 else "a") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.md5("text"))
    cells = {}
    for per_cell in (10, 10**6):
        out = mixing.mixed_rows(df, size=mixing.n_words(F.col("text")), quality=mixing.letter_share(F.col("text")), key=key, rows_per_cell=per_cell, min_cells=1 if per_cell > 10 else 96)
        cells[per_cell] = Counter((r["row"]["doc_id"], r["row"]["text"], r["size"], r["target"], r["times"]) for r in out.collect())
    assert cells[10] == cells[10**6] and sum(cells[10].values()) == len(rows)
    equal = Counter({k: n for k, n in cells[10].items() if k[0] is None})
    assert sum(equal.values()) == 600 and len({k[-1] for k in equal}) <= 2


def test_top_k_of_very_large_vectors(spark):
    """Exact beyond the whole numbers that doubles hold; what may not fit 64 bits takes no part."""
    from concord.llm import topk

    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-(2**28), 2**28)) for _ in range(3)], 0) for i in range(60)]
    df = spark.createDataFrame([*rows, (200, [1e300, 1.0, 1.0], 0), (201, [float(2**30), float(2**29), 0.0], 0)], "vec_id long, embedding array<double>, label int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(df, k=4, scale=1, every=20).collect()}
    want = {}
    for q, v, _ in rows[::20]:
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), i) for i, w, _ in rows if i != q)
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(scored[:4], 1)}
    assert got == want


def test_tables_of_a_result_are_deleted_with_the_driver(tmp_path):
    """A session of its own leaves nothing behind in the shared folder."""
    import os
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from pyspark.sql import SparkSession
from concord.llm import queries
spark = SparkSession.builder.master('local[4]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').getOrCreate()
for name in ('op3_sharding', 'op6_mixing', 'op13_hard_negatives'):
    assert queries.QUERIES[name](spark, {SF!r}).count()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=200, cwd=tmp_path, capture_output=True)
    left = [f for d, _, names in os.walk(tmp_path / "shared") for f in names]
    assert left == []
