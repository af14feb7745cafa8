"""Exact top-k inner products in three phases with a uniform threshold."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

_LISTED = "query_id long, id long, low double"
_ENTRY = "query_id long, id long, score long"


def quantised(vectors: DataFrame, *, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v: floor(scale * component) as double; rows with a null id, vector or component, or one that is not finite, are left out.

    So are those whose products may not fit 64 bits: the largest component times the root of the number of components is over 2**30.
    """
    v = F.transform(vector_col, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.where(F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x * scale))), F.lit(0.0)) * F.sqrt(F.size(v)) < float(1 << 30))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of lists as a matrix; short rows are filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lens), dims))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integer matrices (as float64), exact as int64."""
    most = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def exact_top_k(
    vectors: DataFrame, *, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, every: int = 100, block_bytes: int = 32 << 20, tile: int = 1024, rows_per_node: int = 4096
) -> DataFrame:
    """Each query's k highest integer inner products with all other rows: query_id, rank, id, score.

    Components become floor(scale * x).  Queries are `queries` or the rows whose id
    is divisible by `every`; candidates are all rows with another id.  Ties go to
    the smaller id; rows that repeat an id and score fill one rank each.

    Queries go in blocks of at most some block_bytes, each broadcast, and are multiplied with rows in tiles of `tile`
    queries.  For a block, nodes are parts of the table of about rows_per_node rows:

    1. every node scores its rows in 32-bit floats, with a bound on what rounding can
       have changed, and lists the lower bounds of its best ceil(2 k / nodes) + 1 rows
       (k, if there are few nodes).  The k-th highest listed lower bound of a query is
       a safe cutoff: k rows reach it, so no row below it can be an answer.  Lists are cut
       to k where they are made and again where they meet (a window's group limit);
    2. cutoffs, one number a query, are broadcast, and every node collects all rows
       whose upper bound reaches the cutoff: enough, and hardly more than k a query;
    3. what was collected is resolved exactly in integers, and ranked.

    The table is scanned twice for each block, so twice in all up to block_bytes of queries; if there are
    more blocks, each one's answers are written before the next begins.

    A query with fewer than k other rows has no cutoff and collects all.  Vectors
    that are null or hold null or non-finite components, or components so large that
    scores may not fit 64 bits (see quantised()), take no part; where lengths
    differ, missing components count 0.  Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col=id_col, vector_col=vector_col, scale=scale)
    asked = quantised(queries, id_col=id_col, vector_col=vector_col, scale=scale) if queries is not None else rows.where(F.pmod("id", F.lit(every)) == 0)
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_asked, more = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(dims, more, 1)
    nodes = max(1, math.ceil(n / rows_per_node))
    per_list = min(k, math.ceil(2 * k / nodes) + 1)
    n_blocks = max(1, math.ceil(1.1 * n_asked * dims * 8 / block_bytes))  # hashed blocks are not quite even
    dealt = rows.repartition(nodes, F.xxhash64("id", "v"))

    def answers(b: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toPandas()  # one block of the query set
        q_id = part["id"].to_numpy(np.int64)
        q = np.zeros((len(part), dims))
        for i, v in enumerate(part["v"]):
            q[i, : len(v)] = v
        sent = spark.sparkContext.broadcast((q_id, q))

        def tiles(batch):
            """Queries of a tile: their places, ids and vectors; the batch's ids and vectors; float scores, and how far these may be off."""
            q_id, q = sent.value
            x = _matrix(batch.column("v"), dims)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            size = np.sqrt((x * x).sum(1))
            for a in range(0, len(q), tile):
                own = q[a : a + tile]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = (own.astype(np.float32) @ x.astype(np.float32).T).astype(np.float64)
                    slack = (dims + 4) * 2.0**-23 * np.outer(np.sqrt((own * own).sum(1)), size) + 1
                    if not np.isfinite(score).all():
                        score = own @ x.T
                yield a, q_id[a : a + tile], own, ids, x, score, slack

        def gather(batches):
            for batch in batches:
                for _, q_id, _, ids, _, score, slack in tiles(batch):
                    low = np.where(ids[None, :] == q_id[:, None], -np.inf, score - slack)
                    m = min(per_list, low.shape[1])
                    if m:
                        at = np.argpartition(-low, m - 1, axis=1)[:, :m]
                        best = np.take_along_axis(low, at, 1)
                        fine = best > -np.inf
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_id, m)[fine.ravel()]), pa.array(ids[at][fine]), pa.array(best[fine])], ["query_id", "id", "low"])

        listed = dealt.mapInArrow(gather, _LISTED)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("low").desc()))
        cut = listed.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("query_id", "low")
        cutoffs = {r["query_id"]: r["low"] for r in cut.collect()}  # one number for each query of the block
        cuts = spark.sparkContext.broadcast(np.array([cutoffs.get(int(i), -np.inf) for i in q_id]))

        def collect(batches):
            for batch in batches:
                for a, q_id, q, ids, x, score, slack in tiles(batch):
                    i, j = np.nonzero((score + slack >= cuts.value[a : a + len(q), None]) & (ids[None, :] != q_id[:, None]))
                    most = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) * dims
                    exact = np.einsum("ij,ij->i", q[i], x[j]).astype(np.int64) if most < 2**53 else np.array([exact_products(q[a : a + 1], x[c : c + 1])[0, 0] for a, c in zip(i, j, strict=True)], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(q_id[i]), pa.array(ids[j]), pa.array(exact)], ["query_id", "id", "score"])

        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        ranked = dealt.mapInArrow(collect, _ENTRY).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), F.col("id").alias(id_col), "score")

    out = answers(0)
    if n_blocks > 1:
        out = written(out, "answers")
        for b in range(1, n_blocks):
            out = out.unionAll(written(answers(b), "answers"))
    return out
