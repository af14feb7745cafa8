"""One query for each operator, over its whole table, with production parameters; and DuckDB SQL where SQL says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contamination
from .hard_negatives import hard_negatives
from .mixing import mix_documents
from .near_dedup import near_duplicates
from .ngram_join import ngram_components
from .pii import personal_data
from .quality import quality_scores
from .sharding import shard_documents
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_files import token_digest
from .topk import exact_top_k
from .whitening import whitening_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=35)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=10, scale=1024, every=100)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), n_shards=24)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.array_sort(F.array_distinct("hits.item_id")).alias("item_ids"), F.array_max("hits.similarity").alias("similarity"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digest(table(spark, sf_dir, "documents"), tokenizer=str(public_tokenizers.path("word_bpe_49k.json")), end_id=1)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3, folds=5)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # n_repeated, by a shorter string, also tells of repeated passages that are too short to be removed
    return suffix_dedup(table(spark, sf_dir, "documents"), width=400, report=250)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), words=5, percent=80)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(table(spark, sf_dir, "embeddings"), scale=64, offset=1_000_000, components=32)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), scale=256, every=100, positives=5, negatives=5, low_percent=80)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_topk": op2_exact_topk,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_token_files": op5_token_files,
    "op6_mixing": op6_mixing,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_personal_data": op10_personal_data,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}



def _spans_sql(name: str, width: int, among: str = "") -> str:
    """Maximal runs [a, b) of bytes covered by strings of `width` bytes that start elsewhere as well, of documents in n (k, h: bytes, n: how many); among: repeated shorter strings, if these are known."""
    starts = f"SELECT k, h, p FROM {among}_r JOIN n USING (k) WHERE p + {width} <= n" if among else f"SELECT k, h, unnest(range(0, n - {width - 1})) AS p FROM n WHERE n >= {width}"
    return f"""{name}_h AS (SELECT k, p, md5_number(h[p + 1:p + {width}]) AS m FROM ({starts})),
{name}_r AS (SELECT k, p FROM {name}_h WHERE m IN (SELECT m FROM {name}_h GROUP BY m HAVING count(*) > 1)),
{name}_i AS (SELECT k, p, sum(first) OVER (PARTITION BY k ORDER BY p) AS g FROM (SELECT k, p, CASE WHEN p - lag(p) OVER (PARTITION BY k ORDER BY p) <= {width} THEN 0 ELSE 1 END AS first FROM {name}_r)),
{name} AS (SELECT k, g, min(p) AS a, max(p) + {width} AS b FROM {name}_i GROUP BY 1, 2)"""


SQL = {
    "op1_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r),
c AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM (SELECT DISTINCT doc_id, p FROM g)),
gone AS (SELECT doc_id, list(p) AS p, count(*) AS n, count(DISTINCT p - n) AS spans FROM c GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  CASE WHEN n IS NULL THEN w WHEN n = len(w) THEN [] ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone.p, x)), lambda x: w[x]) END AS k
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256, n_spans::BIGINT AS n_spans FROM kept
""",
    "op2_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * v.v[i]))::BIGINT AS score FROM v AS q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op9_suffix_dedup": f"""
WITH n AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n, row_number() OVER () AS k FROM documents),
{_spans_sql("y", 250)},
{_spans_sql("x", 400, "y")},
parts AS (SELECT k, a AS place, CASE WHEN a > before THEN hex(h[before + 1:a]) ELSE '' END AS t FROM (SELECT k, a, h, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM x JOIN n USING (k))
  UNION ALL SELECT k, n, CASE WHEN n > last THEN hex(h[last + 1:n]) ELSE '' END FROM (SELECT k, max(b) AS last FROM x GROUP BY 1) JOIN n USING (k)),
kept AS (SELECT k, string_agg(t, '' ORDER BY place) AS t FROM parts GROUP BY 1),
gone AS (SELECT k, sum(b - a) AS c, count(*) AS s FROM x GROUP BY 1), told AS (SELECT k, sum(b - a) AS c FROM y GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(gone.c, 0)::BIGINT AS n_removed, coalesce(gone.s, 0)::BIGINT AS n_spans, sha256(CASE WHEN kept.t IS NULL THEN h ELSE unhex(kept.t) END) AS kept_sha256, coalesce(told.c, 0)::BIGINT AS n_repeated
FROM n LEFT JOIN gone USING (k) LEFT JOIN kept USING (k) LEFT JOIN told USING (k)
""",
    "op6_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  greatest(coalesce(1 - length(regexp_replace(text, '[\\p{L}\\s]+', '', 'g')) / nullif(length(text), 0)::DOUBLE, 0), 0.001) AS q,
  md5(concat_ws('|', 'mix', doc_id::VARCHAR, md5(coalesce(text, '')))) AS digest FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM t),
c AS (SELECT *, (i % 3 + 1)::DOUBLE AS wt, (3 * source_size)::DOUBLE AS cap FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / wt, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(wt) OVER (ORDER BY cap / wt, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c),
f AS (SELECT arg_min(lv, {'r': cap / wt, 'i': i}) AS lv FROM l WHERE lv <= cap / wt),
p AS (SELECT source, source_size, least(cap, f.lv * wt) AS target FROM l, f),
k AS (SELECT doc_id, size, source_size, target, p.source, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS e,
  coalesce(sum(size) OVER (PARTITION BY p.source ORDER BY -ln((('0x' || substr(digest, 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656) / q, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (e + CASE WHEN before + size / 2 <= target - e * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
""",
    "op11_ngram_jaccard_join": """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, md5_number(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT k, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
o AS (SELECT x.k AS a, y.k AS b, count(*) AS o FROM s AS x JOIN s AS y ON x.h = y.h AND x.k <> y.k GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n AS p ON p.k = a JOIN n AS q ON q.k = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
r AS (SELECT k AS a, k AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(f.doc_id) AS component_id FROM r JOIN d AS e ON e.k = r.a JOIN d AS f ON f.k = r.b LEFT JOIN n ON n.k = r.a GROUP BY r.a, e.doc_id, n.n
""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score FROM v AS a, v AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
}
