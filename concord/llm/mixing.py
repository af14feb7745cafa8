"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import nested, written

#: Cells of one source at most, and how many bounds of cells lie side by side.
MOST_CELLS, _STEP = 4096, 64
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Share of letters and white space among a text's characters: what menus, symbols and shouting marks lower. Empty: 0."""
    return F.coalesce(1 - F.length(F.regexp_replace(text, r"[\p{L}\s]+", "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def source_targets(sources: DataFrame, *, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """source, source_size -> also target.

    Sources in order of code points, null last, weigh weights[0], weights[1], ... in
    turn.  All sizes together are shared by weight; no target exceeds max_epochs
    times its source's size, and what is above is shared again by weight until none
    is above.  That ends where every target is min(max_epochs * size, level * weight)
    for one level, found here from prefix sums over sources in the order in which
    they reach their limit.  One row a source: an aggregate, not the corpus.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weighed = sources.withColumn("_i", F.row_number().over(order) - 1).withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_i", F.lit(len(weights))) + 1).cast("int")))
    full = weighed.withColumn("_cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    up = Window.orderBy("_ratio", "_i")
    rest = full.withColumn("_before", F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_after", F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    level = rest.withColumn("_level", (F.sum("source_size").over(Window.partitionBy()) - F.col("_before")) / F.col("_after"))
    # the first source that does not reach its limit sets the level of it and all that follow
    found = level.withColumn("_found", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct(F.col("_ratio"), F.col("_i"), F.col("_level")))).over(Window.partitionBy()))
    return found.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_found._level") * F.col("_w"), F.col("_cap"))).alias("target"))


def mixed_rows(
    docs: DataFrame,
    *,
    size: Column,
    quality: Column,
    key: Column,
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: int = 3,
    seed: str = "mix",
    rows_per_cell: int = 50_000,
    min_cells: int = 96,
) -> DataFrame:
    """row (the row of docs as a struct), size, source_size, target, times (int: how often the mix takes the row) and taken (long: size times that).

    A source whose target is e times its size, plus a rest, gives e complete epochs,
    and then a weighted sample without replacement of the rest: every document has
    the exponential key -ln(u) / quality (u uniform, from a hash of key), documents
    are ordered by key, and are taken while prefix sums of size stay within the
    budget; the one that crosses it is taken if that comes nearer.  Documents are
    taken whole, so a source misses its target by half a document at most.

    Prefix sums run in cells, which are quantiles of a source's own keys, so cells are
    near even whatever the qualities are, and a source that holds a third of all rows spreads
    over at least a third of min_cells (the largest source has MOST_CELLS at most).  Cells' totals are summed first (a small
    table), then rows within cells.  Rows that agree in key, and so in all that counts, have a cell of their own where they are many;
    of over twice as many as a cell should have, each is numbered by salts, and has its prefix sum from its number: no window holds them all.

    Null sizes are 0; quality below 0.001 or null counts as 0.001.  Null sources are a source,
    the last.  Rows that agree in key share u; ties go by size, so equal rows cannot
    be told apart.  Rows of size 0 take 0.  Empty tables give empty results.  Extra columns
    may have any names.
    """
    rows = nested(
        docs, _source=F.col(source_col), _size=F.coalesce(size.cast("long"), F.lit(0)), _quality=F.greatest(F.coalesce(quality.cast("double"), F.lit(0.001)), F.lit(0.001)),
        _digest=F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))),
    )
    u = (F.conv(F.substring("_digest", 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = rows.withColumn("_key", -F.log(u) / F.col("_quality"))
    # sizes, qualities and digests of all rows: texts are measured here once, and once more when rows are placed
    measured = written(rows.drop("row"), "measured")
    totals = measured.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    n_sources, largest, n = totals.agg(F.count(F.lit(1)), F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    per_cell = max(1, min(rows_per_cell, math.ceil(n / min_cells)))
    cells = min(MOST_CELLS, math.ceil(largest / per_cell) or 1)
    # small tables are broadcast only below a checked number of rows of under 100 bytes; all bounds of cells are n / per_cell + n_sources numbers at most
    small = lambda df, rows: F.broadcast(df) if rows <= 100_000 else df
    n_cells = 2 * (n // per_cell + n_sources + 1)
    plan = source_targets(totals.select("source", "source_size"), weights=weights, max_epochs=max_epochs)
    quantiles = measured.groupBy(F.col("_source").alias("_q")).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_key", [i / cells for i in range(1, cells)] or [0.5], 4 * MOST_CELLS).alias("_all"))
    # a source has a cell for each per_cell rows: of all quantiles every so manieth
    own = F.least(F.lit(cells), F.ceil(F.col("_n") / per_cell))
    bounds = F.array_distinct(F.transform(F.filter(F.sequence(F.lit(1).cast("long"), own - 1, F.lit(1).cast("long")), lambda i: i > 0), lambda i: F.get("_all", (F.floor(i * cells / own) - 1).cast("int"))))
    quantiles = quantiles.select("_q", F.when(own > 1, bounds).otherwise(F.array().cast("array<double>")).alias("_bounds"))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_bounds") / _STEP).cast("int")), lambda i: F.slice("_bounds", i * _STEP + 1, _STEP))
    plan = (
        plan.join(quantiles, F.col("source").eqNullSafe(F.col("_q")))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
        .select(F.col("source").alias("_s"), "source_size", "target", "_epochs", "_rest", F.filter(parts, lambda p: F.size(p) > 0).alias("_parts"))
    )
    plan = written(plan, "plan")

    def in_cells(df):
        """Bounds below a key, doubled, and one more for keys that are a bound: those have a cell of their own. Any monotone function gives the same sample."""
        df = df.join(small(plan, n_sources), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
        before = F.size(F.filter("_parts", lambda p: p[0] < F.col("_key"))) - 1
        last = F.coalesce(F.get("_parts", F.greatest(F.col("_before"), F.lit(0))), F.array().cast("array<double>"))
        below = F.when(F.col("_before") < 0, 0).otherwise(F.col("_before") * _STEP + F.size(F.filter(last, lambda b: b < F.col("_key"))))
        at = F.exists(last, lambda b: b == F.col("_key")) | F.coalesce(F.get(F.get("_parts", F.col("_before") + 1), F.lit(0)) == F.col("_key"), F.lit(False))
        return df.withColumn("_before", before).withColumn("_cell", 2 * below + at.cast("int")).drop("_before", "_parts")

    placed = in_cells(rows)
    celled = in_cells(measured).groupBy(F.col("_source").alias("_s"), F.col("_cell").alias("_c"))
    sums = celled.agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_rows"), (F.min("_digest") == F.max("_digest")).alias("_equal"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    sums = written(sums, "cells")
    hot = sums.where(F.col("_equal") & (F.col("_rows") > 2 * per_cell)).select("_s", "_c", "_rows")
    same_cell = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c"))
    n_hot = hot.count()
    spread = placed.join(small(hot, n_hot), same_cell, "left_anti") if n_hot else placed
    inner = Window.partitionBy("_source", "_cell").orderBy("_key", "_size", "_digest").rowsBetween(Window.unboundedPreceding, -1)
    ranked = spread.withColumn("_inner", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    if n_hot:
        # written, so that every step sees the same salts
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("_rows") / per_cell))
        salted = written(placed.join(small(hot, n_hot), same_cell).withColumn("_salt", salt).drop("_s", "_c", "_rows"), "salted")
        of_salt = salted.groupBy(F.col("_source").alias("_s"), F.col("_cell").alias("_c"), F.col("_salt").alias("_t")).agg(F.count(F.lit(1)).alias("_k"))
        of_salt = of_salt.select("_s", "_c", "_t", F.coalesce(F.sum("_k").over(Window.partitionBy("_s", "_c").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
        number = F.row_number().over(Window.partitionBy("_source", "_cell", "_salt").orderBy("_key")) - 1
        numbered = salted.withColumn("_number", number).join(small(of_salt, 2 * n_cells), same_cell & (F.col("_salt") == F.col("_t")))
        ranked = ranked.unionByName(numbered.withColumn("_inner", (F.col("_first") + F.col("_number")) * F.col("_size")).select(*ranked.columns))
    summed = ranked.join(small(sums.drop("_rows", "_equal"), n_cells), same_cell)
    before = F.col("_base") + F.col("_inner")
    times = F.col("_epochs") + F.when(before + F.col("_size") / 2 <= F.col("_rest"), 1).otherwise(0)
    return summed.withColumn("times", times.cast("int")).select("row", F.col("_size").alias("size"), "source_size", "target", "times", (F.col("_size") * F.col("times")).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """docs with size, source_size, target, times and taken, in place of columns so named; options: see mixed_rows."""
    kept = [f"row.`{c}`" for c in docs.columns if c not in ("size", "source_size", "target", "times", "taken")]
    return mixed_rows(docs, **options).select(*kept, "size", "source_size", "target", "times", "taken")


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """Digest of a mix of documents by numbers of words; quality is the share of letters."""
    slim = docs.select(F.col(id_col), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("_words"), letter_share(F.col(text_col)).alias("_letters"), F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("_md5"))
    mixed = mix_sources(written(slim, "sizes"), size=F.col("_words"), quality=F.col("_letters"), key=F.concat_ws("|", F.col(id_col).cast("string"), F.col("_md5")), seed=seed)
    return mixed.select(id_col, "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns; documents without words as often as their source's epochs and draw say."""
    key = F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")))
    mixed = mixed_rows(docs, size=n_words(F.col(text_col)), quality=letter_share(F.col(text_col)), key=key, source_col=source_col, seed=seed)
    return mixed.where(F.col("times") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
