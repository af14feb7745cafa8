"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import few, nested, written


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls without replacement are good.

    Inversion outwards from the mode: about as many steps as the standard deviation.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    u = rng.random() - p
    below, above, p_below, p_above = mode, mode, p, p
    while u > 0 and (below > low or above < high):
        if above < high:
            p_above *= (good - above) * (draws - above) / ((above + 1) * (bad - draws + above + 1))
            above += 1
            u -= p_above
            if u <= 0:
                return above
        if below > low:
            p_below *= below * (bad - draws + below) / ((good - below + 1) * (draws - below + 1))
            below -= 1
            u -= p_below
            if u <= 0:
                return below
        if p_above + p_below < 1e-300:
            break
    return mode


def drawn_rows(blocks: Iterable[int], shards: list[int], seed: int) -> Iterator[list[int]]:
    """The rows of communication_matrix, one after the other."""
    rng, left = random.Random(seed), list(shards)
    for size in blocks:
        rest, row, need = sum(left), [], size
        for s, room in enumerate(left):
            rest -= room
            took = hypergeometric(rng, room, rest, need) if rest else need
            row.append(took)
            left[s] -= took
            need -= took
        yield row


def communication_matrix(blocks: Iterable[int], shards: list[int], seed: int) -> list[list[int]]:
    """matrix[b][s]: rows of block b that go to shard s, as a uniform shuffle of all rows would deal them; rows and columns add up exactly."""
    return list(drawn_rows(blocks, shards, seed))


def _cuts(spark: SparkSession, sizes: Iterable[int], shards: list[int], seed: int, blocks_per_slice: int) -> DataFrame:
    """_block, _cuts (running totals of the block's row of the matrix): drawn and handed on in slices, of which the driver holds one."""
    rows = ((b, list(accumulate(row))) for b, row in enumerate(drawn_rows(sizes, shards, seed)))
    slices = iter(lambda: list(islice(rows, blocks_per_slice)), [])
    schema = "_block int, _cuts array<long>"
    out = spark.createDataFrame(next(slices), schema)
    for n, more in enumerate(slices):
        # with a second slice the first is written as well, and none stays in the driver
        out = written(out, "cuts", keep=True) if n == 0 else out
        out = out.unionAll(written(spark.createDataFrame(more, schema), "cuts", keep=True))
    return out


def shard_uniformly(docs: DataFrame, *, n_shards: int, key: Column, seed: int = 17, rows_per_block: int = 50_000, min_blocks: int = 96, blocks_per_slice: int = 16_384) -> DataFrame:
    """Add shard (int, 0 to n_shards - 1) and slot (long, gapless from 0 in each shard) to every row.

    All orders of the rows are equally likely (as far as 64-bit hashes look random)
    and shard sizes differ by one row at most; the larger ones come first.  Rows
    fall into blocks by a hash; the driver draws from the blocks' sizes alone how
    many rows of each block go to each shard; a block's rows are permuted by hashed
    keys and cut at those counts; within a shard rows are permuted anew: they fall
    into cells by a second hash, are ordered within cells, and cells are laid end to
    end by prefix sums.  No task sees more than a block or a cell, both of about
    rows_per_block rows however large the table is.

    key: what tells rows apart (ids, hashes).  Rows that agree in key are numbered
    before they are hashed, so repeated rows are shuffled like all others; which of
    them has which number may differ between runs, which can't be seen if they are
    equal.  A key of more rows than an average block is numbered over salts: counts
    by key and salt give each salt its base, so no window holds such a key, and its
    rows go to blocks by number.  Rows of other keys are numbered within their block.
    A null key is a key.  An empty table gives an empty result.  Columns of the
    input are kept; shard and slot replace columns of those names.

    The driver holds one number for each block (8 bytes, so 3 MB at 20 billion rows) and blocks_per_slice rows of the
    matrix (16 MB at 24 shards), which it draws, writes and forgets slice by slice.  Small tables are broadcast only
    below a checked number of rows (see few()).
    """
    spark = docs.sparkSession
    rows = nested(docs, _h=F.xxhash64(F.lit(seed), key))
    keys = written(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("count")), "keys")
    n = keys.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    n_blocks = max(min_blocks, math.ceil(n / rows_per_block))
    n_cells = math.ceil(n_blocks / n_shards)
    limit = max(1, n // n_blocks)
    block = lambda *of: F.pmod(F.xxhash64(*of), F.lit(n_blocks)).cast("int").alias("_block")
    hot = [tuple(r) for r in keys.where(F.col("count") > limit).collect()]  # fewer than 2 * n_blocks rows
    sums = keys.where(F.col("count") <= limit).groupBy(block("_h")).agg(F.sum("count").alias("count"))
    rows = rows.withColumn("_number", F.lit(None).cast("long"))
    if hot:
        n_hot, hot = len(hot), spark.createDataFrame(hot, "_h long, _times long")
        spans = hot.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_times") - 1, F.lit(rows_per_block)))).repartition("_h", "_from")
        numbers = spans.select("_h", F.explode(F.sequence("_from", F.least(F.col("_from") + rows_per_block, F.col("_times")) - 1)).alias("_number"))
        sums = sums.unionAll(numbers.groupBy(block("_h", "_number")).count())
        # written, so that every step sees the same salts
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("_times") / limit))
        salted = written(rows.drop("_number").join(few(hot, n_hot), "_h").withColumn("_salt", salt).drop("_times"), "salted")
        bases = Window.partitionBy("_h").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        bases = salted.groupBy("_h", "_salt").count().select("_h", "_salt", F.coalesce(F.sum("count").over(bases), F.lit(0)).alias("_before"))  # under 4 * n_blocks rows
        numbered = salted.withColumn("_number", F.row_number().over(Window.partitionBy("_h", "_salt").orderBy("_h")) - 1).join(few(bases, 4 * n_blocks), ["_h", "_salt"])
        numbered = numbered.withColumn("_number", F.col("_before") + F.col("_number"))
        rows = rows.join(few(hot, n_hot), "_h", "left_anti").unionByName(numbered.select(*rows.columns))
    rows = rows.withColumn("_block", F.when(F.col("_number").isNull(), block("_h")).otherwise(block("_h", "_number")))
    counts = array("q", bytes(8 * n_blocks))
    for r in sums.groupBy("_block").agg(F.sum("count").alias("count")).toLocalIterator():  # n_blocks rows at most
        counts[r["_block"]] = r["count"]
    shards = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    cuts = _cuts(spark, counts, shards, seed, blocks_per_slice)
    same = Window.partitionBy("_block", "_h").orderBy("_h")
    local = Window.partitionBy("_block").orderBy("_mixed")
    placed = (
        rows.withColumn("_mixed", F.xxhash64("_h", F.coalesce("_number", F.row_number().over(same) - 1)))
        .withColumn("_rank", F.row_number().over(local) - 1)
        .join(few(cuts, n_blocks * n_shards // 2), "_block")  # n_blocks rows of n_shards numbers
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))).cast("int"))
        .drop("_cuts", "_rank", "_block", "_number")
        .withColumn("_again", F.xxhash64(F.lit(seed + 1), "_mixed"))
        .withColumn("_cell", F.pmod(F.xxhash64("_again"), F.lit(n_cells)).cast("int"))
    )
    cell = Window.partitionBy("shard", "_cell")
    ranked = placed.withColumn("_place", F.row_number().over(cell.orderBy("_again")) - 1)
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("shard", "_cell").count().select("shard", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    kept = [f"row.`{c}`" for c in docs.columns if c not in ("shard", "slot")]
    return ranked.join(few(bases, n_cells * n_shards), ["shard", "_cell"]).select(*kept, "shard", (F.col("_base") + F.col("_place")).alias("slot"))


def shard_documents(docs: DataFrame, *, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """Digest of a uniform shuffle of documents: id, size (bytes of the text, null none, plus 8), text_crc32, law 'rows', shard, slot, grown_shard (null: that belongs to another law)."""
    digest = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    dealt = shard_uniformly(digest, n_shards=n_shards, key=F.struct(id_col, "size", "text_crc32"), seed=seed)
    return dealt.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
