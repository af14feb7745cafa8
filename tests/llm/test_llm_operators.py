"""The ten operators against brute force on small tables that hold nulls, empty and long texts, repeats and ties."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

from concord.llm import decontamination, mixing, near_dedup, pii, quality, queries, sharding, substring_dedup, suffix_dedup, token_files, topk
from concord.llm.shared import scratch, shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=3):
    """Prose of a few hundred words with shared passages, exact and near copies, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    lexicon = [word() for _ in range(900)] + ["été", "ñandú", "日本語", "ﬁn"]
    prose = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    passage, long_ = prose(60), prose(4000)
    out = [prose(rng.randint(30, 200)) for _ in range(25)]
    out += [f"{prose(40)} {passage}\n{prose(30)}" for _ in range(4)]
    out += [out[0]] * 3 + [out[1].replace(" ", "  ", 1), out[2] + " tail", " ".join(w for i, w in enumerate(out[3].split()) if i != 20)]
    out += ["", None, " ", "one", "two words", "x " * 300, long_, long_[:9000] + prose(10), prose(200) + "\t" + passage]
    return out


def frame(spark, values, extra=False):
    rows = [(None if i == 7 else i, t, "en", [None, "a", "b", "hot"][i % 4], None) for i, t in enumerate(values)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if extra else df


CLASHES = (
    "text_total", "chunk", "id", "shard", "slot", "hits", "contaminated", "score", "_score", "_text", "bucket", "size", "source_size", "target", "times", "taken", "row", "copies", "_id", "_h", "_digest", "_source", "_size", "_key", "digest",
    "found", "held_out", "_rank", "_cell", "v", "low", "query_id",
)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).cache()


def test_substring_dedup_removes_repeated_windows(spark, docs):
    values = texts()
    split = [WORD.findall(t or "") for t in values]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = Counter()
    for i, w in enumerate(split):
        gone = {j for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for j in range(p, p + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[(None if i == 7 else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    for options in ({}, {"chunk_bytes": 2000, "bucket_keys": 500}):
        got = substring_dedup.substring_dedup(docs, **options).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert Counter(tuple(r) for r in got.collect()) == want


def covered_bytes(values, size):
    seen = Counter(b[i : i + size] for b in values for i in range(len(b) - size + 1))
    out = []
    for b in values:
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = [True] * size
        out.append(gone)
    return out


def test_suffix_dedup_removes_repeated_strings(spark, docs):
    values = [(t or "").encode() for t in texts()]
    want = Counter()
    for i, (b, gone, short) in enumerate(zip(values, covered_bytes(values, 400), covered_bytes(values, 250), strict=True)):
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        want[(None if i == 7 else i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest(), sum(short))] += 1
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for options in ({}, {"chunk_bytes": 3000, "bucket_bytes": 4000}, {"hot_anchor": 1}, {"hot_anchor": 3}, {"hot_anchor": 4, "chunk_bytes": 3000, "bucket_bytes": 4000}):
        got = suffix_dedup.suffix_dedup(docs, report=250, **options)
        assert Counter(tuple(r) for r in got.select(*columns, "n_repeated").collect()) == want, options
    got = suffix_dedup.suffix_dedup(docs, hot_anchor=2)
    assert got.columns == columns and Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(k[:-1] for k in want.elements())


def test_suffix_dedup_in_periodic_and_copied_texts(spark):
    rng = random.Random(2)
    unit = "".join(rng.choice("abcdef ") for _ in range(37))
    phrase = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (60, 90, 150, 280, 320)]
    mixed = [" ".join(rng.choice(phrase) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    values = [unit * 30, unit * 12 + "x", "y" + unit * 11, "z" * 900, "z" * 399, "z" * 400, *mixed, *[phrase[3] + str(i) + phrase[1] for i in range(40)]]
    raw = [v.encode() for v in values]
    want = sorted((i, sum(a), sum(b)) for i, (a, b) in enumerate(zip(covered_bytes(raw, 400), covered_bytes(raw, 250), strict=True)))
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    for hot in (1000, 20, 1):
        got = suffix_dedup.suffix_dedup(df, report=250, hot_anchor=hot).select("doc_id", "n_removed", "n_repeated").collect()
        assert sorted(tuple(r) for r in got) == want, hot
    # rows equal in id and text that would overfill a chunk
    copies = spark.createDataFrame([(1, "q" * 10 + unit * 12)] * 50 + [(2, "q" * 9 + unit * 11)], "doc_id long, text string")
    got = Counter(tuple(r) for r in suffix_dedup.suffix_dedup(copies, chunk_bytes=2000).select("doc_id", "n_bytes", "n_removed").collect())
    assert got == Counter({(1, 454, 454): 50, (2, 416, 416): 1})


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(4)], 0) for i in range(230)]
    rows += [(300, None, 0), (301, [1.0, None, 1.0, 1.0], 0), (400, [float("nan")] * 4, 0), (302, rows[5][1], 0), (303, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    import numpy as np

    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v and None not in v and not any(math.isnan(x) for x in v)]
    want = set()
    for q, v in fine:
        if q % 100 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q)
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked[:10])}
    for options in ({}, {"rows_per_node": 40, "block_bytes": 64, "tile": 2}):
        assert {tuple(r) for r in topk.exact_top_k(df, **options).collect()} == want
    assert topk.exact_top_k(df.limit(0)).isEmpty()


def test_shards_have_exact_sizes(spark, docs):
    values = texts()
    got = [r.asDict() for r in sharding.shard_documents(docs, n_shards=5).collect()]
    assert len(got) == len(values) and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        t = (values[r["doc_id"]] if r["doc_id"] is not None else values[7]) or ""
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
    assert sorted(map(len, by.values())) == sorted(len(values) // 5 + (s < len(values) % 5) for s in range(5))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_documents(docs.limit(0), n_shards=5).isEmpty()


def test_copies_spread_over_shards(spark):
    df = spark.createDataFrame([(i,) for i in range(200) for _ in range(3)] + [(1000,)] * 300, "doc_id long")
    for options in ({}, {"min_blocks": 1}):  # one key above an average block, and none
        seen = []
        for parts in (2, 5):
            rows = sharding.shard_uniformly(df.repartition(parts), n_shards=5, key=F.col("doc_id"), **options).select("doc_id", "shard", "slot").collect()
            seen.append(sorted(tuple(r) for r in rows))
        assert seen[0] == seen[1]
        by = {}
        for i, shard, _ in seen[0]:
            by.setdefault(i, []).append(shard)
        assert {i: len(s) for i, s in by.items()} == {**dict.fromkeys(range(200), 3), 1000: 300}
        assert all(35 <= by[1000].count(s) <= 85 for s in range(5))
        assert sum(len(set(s)) == 1 for s in by.values()) <= 25  # 8 are expected
        for s in range(5):
            assert sorted(slot for _, shard, slot in seen[0] if shard == s) == list(range(180))


def test_hypergeometric_matrix_adds_up():
    m = sharding.communication_matrix([7, 0, 5, 20], [8, 8, 8, 8], 3)
    assert [sum(r) for r in m] == [7, 0, 5, 20] and [sum(c) for c in zip(*m, strict=True)] == [8] * 4
    rng = random.Random(5)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(sum(draws) / len(draws) - 6) < 0.15 and abs(sum((d - 6) ** 2 for d in draws) / len(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


def test_the_matrix_in_slices_is_the_matrix(spark):
    df = spark.range(700).select(F.col("id").alias("doc_id"))
    whole, sliced = ({tuple(r) for r in sharding.shard_uniformly(df, n_shards=6, key=F.col("doc_id"), rows_per_block=40, min_blocks=20, blocks_per_slice=n).collect()} for n in (1000, 3))
    assert whole == sliced and len(whole) == 700


def test_an_encoder_is_shared_by_tasks_of_one_folder_only(monkeypatch):
    monkeypatch.setattr(token_files, "Encoder", lambda *args: [args])
    first = token_files.encoder_of("a", "t.json", 1, 9)
    assert token_files.encoder_of("a", "t.json", 1, 9) is first and token_files.encoder_of("b", "t.json", 1, 9) is not first
    token_files.encoder_of.cache_clear()


def test_token_files_hold_whole_texts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    values = [*texts(), "Ünïcode ÀÉ it's <|endoftext|> a’b 12345 \x00\x1f x"]
    model = Tokenizer.from_file(path)
    ids = {None if i == 7 else i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(values)}
    df = frame(spark, values)
    start, want = 0, set()
    for i in sorted(ids, key=lambda x: -1 if x is None else x):
        want.add((i, start, len(ids[i]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[i]))))
        start += len(ids[i])
    for size in (24 << 20, 4000):
        folder = f"{shared_folder(spark)}/t{size}"
        got = token_files.read_tokens(token_files.write_tokens(df, folder, tokenizer=path, bytes_per_part=size), with_ids=True).collect()
        assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
        assert all(r["ids"] == ids[r["doc_id"]] for r in got)


def test_mixing_meets_targets(spark):
    out = queries.op6_mixing(spark, SF).toPandas()
    source = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["source"].fillna("?")
    out["source"] = out["doc_id"].map(source)
    for _, g in out.groupby("source"):
        assert (g["taken"] <= 3 * g["size"]).all() and abs(g["taken"].sum() - g["target"].iloc[0]) <= max(g["size"].max(), 1)
    assert out.equals(queries.op6_mixing(spark, SF).toPandas().sort_values("doc_id").set_index(out.sort_values("doc_id").index).reindex(out.index)[list(out.columns.drop("source"))].assign(source=out["source"]))


def weighted(values):
    bags = []
    for t in values:
        w = WORD.findall(t or "")
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    df, n = Counter(x for b in bags for x in b), len(values)
    return [{x: c * (1 + 0.25 * math.log1p(n / 2 ** (round(8 * math.log2(df[x])) / 8)) / math.log1p(n)) for x, c in b.items()} for b in bags]


def test_near_copies_share_a_class(spark, docs):
    values = texts()
    bags = weighted(values)
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            both = sum(min(bags[i][x], bags[j][x]) for x in bags[i].keys() & bags[j].keys())
            total = sum(bags[i].values()) + sum(bags[j].values()) - both
            if (values[i] or "") == (values[j] or "") or total and both / total >= 0.8:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = {}
    for i, g in enumerate(group):
        want.setdefault(g, set()).add(None if i == 7 else i)
    got = {}
    for r in near_dedup.near_duplicates(docs).collect():
        got.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert sorted(map(str, map(lambda s: sorted(s, key=str), got.values()))) == sorted(map(str, map(lambda s: sorted(s, key=str), want.values())))
    kept = near_dedup.first_of_class(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)


def test_large_buckets_are_split(spark):
    base = " ".join(f"w{i}" for i in range(300))
    values = [base.replace(f"w{i} ", f"v{i} ") for i in range(0, 300, 3)] + ["nothing like it at all here"]
    got = {r["class_size"] for r in near_dedup.near_duplicates(frame(spark, values), block=16).collect()}
    assert got == {100, 1}


def families(n=90, own=5, twin=2):
    """Pairs of texts that are linked to each other; other pairs, and both with most heads, agree in many samples without a link."""
    rng = random.Random(12)
    base, out = [f"w{i}" for i in range(300)], []
    for f in range(n):
        one = list(base)
        for k, i in enumerate(rng.sample(range(10, 290, 6), own)):
            one[i] = f"a{f}x{k}"
        two = list(one)
        for k, i in enumerate(rng.sample(range(7, 290, 6), twin)):
            two[i] = f"b{f}x{k}"
        out += [" ".join(one), " ".join(two)]
    return out


def near_classes(df, **options):
    out = {}
    for r in near_dedup.near_duplicates(df, **options).collect():
        out.setdefault(r["class_id"], set()).add(-1 if r["doc_id"] is None else r["doc_id"])
    return sorted(map(sorted, out.values()))


def test_parts_of_large_buckets_all_meet(spark):
    df = frame(spark, families(90, 4, 4)).cache()
    want = near_classes(df)
    assert sum(len(c) == 2 for c in want) >= 60
    assert near_classes(df, block=2) == want


def test_one_band_suffices_at_every_size(spark):
    df = frame(spark, families()).cache()
    assert near_classes(df, bands=1, block=8) == near_classes(df, bands=1)


def test_benchmark_passages_are_found(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"t{rng.randrange(3000)}" for _ in range(n))
    items = [prose(n) for n in (25, 40, 12, 3, 60)]
    edited = items[4].split()
    edited[30] = "changed"
    values = [prose(50), f"{prose(30)} {items[0]} {prose(20)}", f"{items[1]}\n{items[2]}", f"{prose(5)} {items[3]} x", " ".join(edited), " ".join(items[4].split()[:30]), "", None]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (None, "x y"), (10, "")], "item_id long, text string")
    got = {r["doc_id"]: sorted(h["item_id"] for h in r["hits"]) for r in decontamination.contamination(frame(spark, values), bench).collect()}
    assert got == {0: [], 1: [0], 2: [1, 2], 3: [3], 4: [4], 5: [], 6: [], None: []}
    assert decontamination.contamination(frame(spark, values), bench.limit(0)).where("contaminated").isEmpty()


def test_items_of_null_id_are_found(spark):
    bench = spark.createDataFrame([(None, "a b c d e f"), (None, "x y"), (5, "k l m n o p"), (None, None)], "item_id long, text string")
    values = ["q a b c d e f q", "k l m n o p x y", "nothing", None]
    got = {r["doc_id"]: (r["contaminated"], [h["item_id"] for h in r["hits"]]) for r in decontamination.contamination(frame(spark, values), bench).collect()}
    assert got == {0: (True, [None]), 1: (True, [None, 5]), 2: (False, []), 3: (False, [])}


def test_blocks_of_the_benchmark_change_nothing(spark):
    rng = random.Random(12)
    stock = " ".join(f"s{rng.randrange(400)}" for _ in range(14))
    items = [" ".join(f"t{rng.randrange(500)}" for _ in range(rng.randint(3, 30))) + (f" {stock}" if i % 3 == 0 else "") for i in range(60)]
    bench = spark.createDataFrame([*enumerate(items), (5, items[5]), (5, items[5]), (70, items[0]), (None, items[1]), (71, None), (72, " ")], "item_id long, text string")
    values = [f"a b {items[i]} c d {items[(i * 7) % 60]}" for i in range(60)] + ["", None, "nothing here"]
    for i in range(0, 60, 4):
        w = items[i].split()
        w[len(w) // 2] = "zz"
        values.append(" ".join(w))
    df = frame(spark, values)
    got = []
    for size in (1 << 20, 1500):
        with scratch(spark):
            rows = decontamination.contamination(df, bench, block_bytes=size).collect()
        got.append({r["doc_id"]: sorted((h["item_id"] is not None, h["item_id"] or 0, *h[1:3], round(h["similarity"], 9), h["distance"]) for h in r["hits"]) for r in rows})
    assert got[0] == got[1] and sum(map(len, got[0].values())) > 60
    fives = [h for hits in got[0].values() for h in hits if h[1] == 5]
    assert fives and len(fives) % 3 == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() >= 0.9
    rank = scored["score"].rank()
    ones, zeros = scored["quality"] == 1, scored["quality"] == 0
    assert (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * zeros.sum()) >= 0.95
    none = quality.quality_scores(docs, labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert tuple(none) == (0.5, 0.5)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data_keeps_base_spans(spark):
    rng = random.Random(4)
    odd = ["a@b@c.com", "@x.y a.b@c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111-", "+1 (555) 123-4567 +44.20.7946.0958 +12", "é a.b%c@d-e.co.uk, call +33 1 23 45 67 89", "", None]
    odd += ["".join(rng.choice("a1@.+- (45)7é") for _ in range(400)) for _ in range(40)]
    rows = pii.personal_data(frame(spark, odd)).collect()
    for r in rows:
        t = odd[7 if r["doc_id"] is None else r["doc_id"]] or ""
        base = base_spans(t)
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert set(base) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in base) for k in BASE]


def planted():
    """Texts with what further labelers should find, and with what only looks like it; each with the spans to be added."""
    rng = random.Random(6)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: rng.choice(["anna", "lee", "kim", "omar", "lucia", "sven"])
    prose = lambda: " ".join(rng.choice("the of and to in is that for it was on are with they be one had this from or by".split()) for _ in range(12))
    out = []
    for _ in range(60):
        span = f"{word()}.{word()} [at] mail [dot] org"
        out.append((f"{prose()}. contact: {span}, {prose()}", [("email", span)]))
        span = f"({rng.randint(200, 989)}) {rng.randint(200, 989)}-{rng.randint(1000, 9999)}"
        out.append((f"{prose()}. call {span} {prose()}", [("phone", span)]))
        span = hexa(40)
        out.append((f'{prose()} token = "{span}" {prose()}', [("secret", span)]))
        out.append((f"{prose()} at {word()} dot the i {prose()}", []))
        out.append((f"{prose()} commit {hexa(40)} {prose()}", []))
        out.append((f"{prose()} sha {hexa(64)} version 2 {prose()}", []))
        out.append((f"{prose()} aVeryLongIdentifierName{rng.randint(1, 9)}OfSomething {prose()}", []))
    return out


def test_added_spans_on_planted_texts(spark):
    """Precision and recall of what the trained classifier adds."""
    given = planted()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(given)], "doc_id long, text string")
    right = wrong = 0
    for r in pii.personal_data(df).collect():
        text, wanted = given[r["doc_id"]]
        want = {f"{k}:{text.index(s)}:{text.index(s) + len(s)}" for k, s in wanted}
        got = set(r["spans"].split(",")) - {""}
        right += len(got & want)
        wrong += len(got - want)
        assert r["n_spans"] == len(got) == r["n_added"]
    total = sum(len(w) for _, w in given)
    print(f"recall {right / total:.3f}, precision {right / (right + wrong):.3f}")
    assert right >= 0.9 * total and right >= 0.9 * (right + wrong)


def test_reliabilities_follow_the_votes():
    """A labeler that disagrees with all others at random is trusted less than they are."""
    import numpy as np

    rng = random.Random(3)
    seen = Counter()
    for _ in range(4000):
        truth = 1 if rng.random() < 0.5 else -1
        good = [truth if rng.random() < 0.9 else -truth for _ in range(4)]
        seen[(*good, rng.choice((1, -1)))] += 1
    patterns = [("phone", v, 16, False) for v in seen]
    post = dict(zip(seen, pii.reliabilities(patterns, np.array(list(seen.values()))), strict=True))
    assert post[(1, 1, 1, 1, -1)] > 0.95 > 0.05 > post[(-1, -1, -1, -1, 1)]
    assert abs(post[(1, 1, -1, 1, 1)] - post[(1, 1, -1, 1, -1)]) < 0.2


def test_quality_votes_against_a_loop():
    import numpy as np

    rng = np.random.default_rng(2)
    x, known = quality.unit(rng.standard_normal((40, 8))), quality.unit(rng.standard_normal((30, 8)))
    y = rng.integers(0, 2, 30).astype(float)
    got = quality.votes(x, known, y, 7, 5.0)
    for i in range(40):
        near = sorted(range(30), key=lambda j: -float(x[i] @ known[j]))[:7]
        w = [max(float(x[i] @ known[j]), 1e-6) ** 5.0 for j in near]
        assert abs(got[i] - sum(a * y[j] for a, j in zip(w, near, strict=True)) / sum(w)) < 1e-9


def test_windows_against_a_loop():
    """Every window whose weighted similarity with an item is enough is found, as far as its fingerprint is within the radius."""
    import numpy as np

    rng = random.Random(4)
    items = [" ".join(f"k{rng.randrange(60)}" for _ in range(n)) for n in (12, 12, 20, 31, 31)]
    index = decontamination.Index(decontamination.built_index(items, 5), 5, 64)  # a radius that leaves nothing out
    texts_ = []
    for _ in range(60):
        w = rng.choice(items).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        texts_.append(" ".join([f"k{rng.randrange(60)}" for _ in range(rng.randint(0, 9))] + w + ["tail"] * rng.randint(0, 4)))
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    bags = [grams(t.split()) for t in items]
    df = Counter(g for b in bags for g in b)
    weigh = lambda g: math.log1p(len(items) / df[g]) if g in df else math.log1p(len(items))
    import pyarrow as pa

    for text, found in zip(texts_, index.search_all(pa.array(texts_), 0.8), strict=True):
        want = {}
        w = text.split()
        for j, item in enumerate(items):
            n = len(item.split())
            for p in range(len(w) - n + 1):
                b = grams(w[p : p + n])
                both = sum(min(c, b[g]) * weigh(g) for g, c in bags[j].items())
                total = sum(c * weigh(g) for g, c in bags[j].items()) + sum(c * weigh(g) for g, c in b.items()) - both
                if both / total >= 0.8 and both / total > want.get(j, 0) + 1e-12:
                    want[j] = both / total
        assert {f[0]: round(f[3], 9) for f in found} == {j: round(v, 9) for j, v in want.items()}
    # fingerprints within the radius are all found, by either way of probing
    prints = np.array([rng.getrandbits(64) for _ in range(3000)], dtype=np.uint64)
    arrays = decontamination.built_index(items, 5)
    small = decontamination.Index(arrays, 5, 19)
    for values in (len(small.near), 0):
        probe = decontamination.Index(arrays, 5, 19)
        if not values:
            probe.near = probe.near.copy()
            probe.blocks = [(o, np.append(v, np.arange(70_000, 73_000, dtype=v.dtype)), np.append(f, np.full(3000, f[-1]))) for o, v, f in probe.blocks]
        near = np.concatenate([prints, arrays["prints"] ^ np.uint64(0b1011), arrays["prints"]])
        a, b = probe.within(near)
        want = {(i, j) for i, x in enumerate(near.tolist()) for j, y in enumerate(arrays["prints"].tolist()) if bin(x ^ y).count("1") <= 19}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


@pytest.mark.parametrize("case", ["empty", "nulls", "clashing"])
def test_odd_tables(spark, case):
    given = ["a b c d e f", "a b c d e f", "", None, "x", "mail a@b.org " + "long " * 30_000]
    plain = frame(spark, given)
    odd = plain.limit(0) if case == "empty" else spark.createDataFrame([(None,) * 5] * 3, SCHEMA) if case == "nulls" else frame(spark, given, extra=True)
    n = odd.count()
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0), (4, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, "a b c d e f")], "item_id long, text string")
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    operators = {
        "op1": lambda df: substring_dedup.substring_dedup(df, window=5), "op9": lambda df: suffix_dedup.suffix_dedup(df, report=300), "op3": lambda df: sharding.shard_documents(df, n_shards=3), "op7": near_dedup.near_duplicates,
        "op4": lambda df: decontamination.contamination(df, bench).select("doc_id", "contaminated", F.size("hits").alias("n")), "op6": mixing.mix_documents, "op8": lambda df: quality.quality_scores(df, labels), "op10": pii.personal_data,
        "op5": lambda df: token_files.token_digest(df, tokenizer=path), "first": lambda df: near_dedup.first_of_class(df).select("doc_id", "text"), "clean": lambda df: decontamination.without_benchmark(df, bench).select("doc_id", "text"),
        "good": lambda df: quality.good_documents(df, labels, threshold=0.0).select("doc_id", "text"), "mixed": lambda df: mixing.mixed_documents(df).select("doc_id", "text"), "shards": lambda df: sharding.shard_uniformly(df, n_shards=2, key=F.col("doc_id")).select("doc_id", "shard", "slot"),
    }
    results = {}
    for name, operator in operators.items():
        if case == "clashing" and name in ("op7", "first", "clean", "good", "mixed", "shards"):
            continue  # looked at below
        results[name] = got = Counter(tuple(r) for r in operator(odd).collect())
        if case == "clashing":  # columns of any name change nothing
            assert got == Counter(tuple(r) for r in operator(plain).collect()), name
        if name not in ("first", "clean", "mixed"):
            assert sum(got.values()) == n, name
    nothing = hashlib.sha256(b"").hexdigest()
    if case == "nulls":
        assert set(results["op1"]) == {(None, 0, 0, nothing, 0)} and set(results["op9"]) == {(None, 0, 0, 0, nothing, 0)}
        assert set(results["op7"]) == {(None, None, 3)} and results["first"] == Counter({(None, None): 1})
        assert set(results["op4"]) == {(None, False, 0)} and {r[-1] for r in results["op6"]} == {0}
        assert sorted(results["op5"]) == [(None, i, 1, zlib.crc32((1).to_bytes(4, "little"))) for i in range(3)]
        assert {r[1:7] for r in results["op10"]} == {(0, 0, 0, 0, nothing, "")} and {r[1] for r in results["op8"]} == {False}
    if case == "clashing":
        # stages give back what they were given, under every name
        first = near_dedup.first_of_class(odd).cache()
        for kept in (first, decontamination.without_benchmark(odd, bench), quality.good_documents(odd, labels, threshold=0.0), mixing.mixed_documents(odd)):
            assert kept.columns == odd.columns and kept.select(*CLASHES).distinct().collect() == odd.select(*CLASHES).distinct().collect()
        assert {r["doc_id"] for r in decontamination.without_benchmark(odd, bench).collect()} == {2, 3, 4, 5}
        assert first.count() == 4  # one of the copies, empty and null are alike
        assert sharding.shard_uniformly(odd, n_shards=2, key=F.col("doc_id")).columns == [*(c for c in odd.columns if c not in ("shard", "slot")), "shard", "slot"]


def test_equal_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "same text here", i % 3) for i in range(30)] + [(None, "other", 0)] * 4, "doc_id long, text string, n int")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near_dedup.first_of_class(df).collect()) == [(0, "other"), (1, "same text here")]


def thue_morse(n):
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def test_no_hash_takes_different_words_for_equal(spark):
    """Two words on which every polynomial modulo 2**64 agrees: the texts share no 35 words."""
    one = thue_morse(10)
    two = one.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(34)]
    df = spark.createDataFrame([(1, " ".join([*words[:17], one, *words[17:]])), (2, " ".join([*words[:17], two, *words[17:]]))], "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup.substring_dedup(df).collect()} == {0}
    same = df.unionAll(df.where("doc_id = 1").selectExpr("3L", "text"))
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(same).collect()} == {1: 35, 2: 0, 3: 35}


def test_hashes_are_polynomials_modulo_a_prime():
    import numpy as np

    from concord.llm import hashing

    rng = random.Random(8)
    values = np.array([rng.randrange(hashing.PRIME) for _ in range(900)] + [0, hashing.PRIME - 1], dtype=np.uint64)
    for base in (2, hashing.PRIME - 1, rng.randrange(hashing.PRIME)):
        assert hashing.reduced(hashing.times(values, base)).tolist() == [int(x) * base % hashing.PRIME for x in values]
        for width in (1, 2, 3, 35, 400, 902, 903):
            want = []
            for i in range(len(values) - width + 1):
                h = 0
                for x in values[i : i + width].tolist():
                    h = (h * base + x) % hashing.PRIME
                want.append(h)
            assert hashing.window_hashes(values, width, base).tolist() == want


def test_rows_that_overfill_a_chunk(spark):
    rows = [(1, "p q r s t " * 40)] * 60 + [(2, "p q r s t " * 3)] + [(None, "u v w x y z")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(df, window=6, chunk_bytes=2000).collect())
    assert got == Counter({(1, 200, 200): 60, (2, 15, 15): 1, (None, 6, 6): 50})
    got = Counter(tuple(r) for r in near_dedup.near_duplicates(df, chunk_bytes=2000).collect())
    assert got == Counter({(1, 1, 60): 60, (2, 2, 1): 1, (None, None, 50): 50})


def test_shuffles_are_uniform(spark):
    """Every row is as likely to come to every shard, and to the first half of its slots, and pairs of rows don't stay together."""
    df = spark.range(96).withColumnRenamed("id", "doc_id")
    shards, halves, together = Counter(), 0, 0
    for seed in range(16):
        at = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_uniformly(df, n_shards=4, key=F.col("doc_id"), seed=seed, min_blocks=8).collect()}
        shards.update((i % 8, s) for i, (s, _) in at.items())
        halves += sum(slot < 12 for i, (_, slot) in at.items() if i < 48)
        together += sum(at[i][0] == at[i + 1][0] for i in range(95))
    assert all(abs(n - 48) < 30 for n in shards.values()) and len(shards) == 32  # 6 is the deviation
    assert abs(halves - 384) < 85 and abs(together - 16 * 23) < 85


def all_links(values, threshold=0.8, idf_share=0.25):
    """Pairs of different texts whose weighted Jaccard similarity, by all their shingles, is at least threshold."""
    import numpy as np

    distinct = list(dict.fromkeys(t or "" for t in values))
    bags, names = [], {}
    for t in distinct:
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        bags.append({names.setdefault(g, len(names)): n for g, n in grams.items()})
    of = Counter(t or "" for t in values)
    df = np.zeros(len(names))
    for t, b in zip(distinct, bags, strict=True):
        df[list(b)] += of[t]
    factor = 1 + idf_share * np.log1p(len(values) / 2.0 ** (np.round(8 * np.log2(np.maximum(df, 1))) / 8)) / np.log1p(len(values))
    ids = [np.fromiter(b, np.int64, len(b)) for b in bags]
    weights = [np.fromiter(b.values(), float, len(b)) * factor[i] for b, i in zip(bags, ids, strict=True)]
    total = np.array([w.sum() for w in weights])
    flat, owner, weight = np.concatenate(ids), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.concatenate(weights)
    order = np.argsort(flat, kind="stable")
    flat, owner, weight = flat[order], owner[order], weight[order]
    start = np.searchsorted(flat, np.arange(len(names) + 1))
    links = set()
    for i, (own, w) in enumerate(zip(ids, weights, strict=True)):
        begin, size = start[own], start[own + 1] - start[own]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = np.bincount(owner[at], np.minimum(weight[at], np.repeat(w, size)), len(bags))
        links.update((i, int(j)) for j in np.flatnonzero(both >= threshold * (total + total[i] - both)) if j > i)
    return distinct, links


def test_recall_against_all_pairs(spark):
    """Both ends of nearly all links are in one class, and no class has ends that links don't join."""
    table = spark.read.parquet(f"{os.environ.get('RECALL_SF_DIR', '/root/testdata/sf0.01')}/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    distinct, links = all_links([r["text"] for r in rows])
    class_of = {}
    named = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(table).collect()}
    for r in rows:
        class_of[r["text"] or ""] = named[r["doc_id"]]
    found = sum(class_of[distinct[i]] == class_of[distinct[j]] for i, j in links)
    print(f"{len(rows)} rows, {len(distinct)} texts, {len(links)} links, {found} found")
    assert found >= 0.9 * len(links)
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[root(i)] = root(j)
    by = {}
    for i, t in enumerate(distinct):
        by.setdefault(class_of[t], set()).add(root(i))
    assert all(len(x) == 1 for x in by.values())
