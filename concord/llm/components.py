"""Connected components of a graph of links, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few, rows_for, written


def connected_components(links: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the component's least node) for every node of a link; a node type that sorts and hashes.

    Alternates large-star and small-star steps until no link changes: every node's links
    are moved to the least node around it, so paths at least halve.  Minima are
    combined before they are shuffled and stand in tables of their own, so the joins
    that give them to a node with very many links can be split; where links are
    few (see few()), minima are broadcast.  The driver sees only a count and a checksum
    of the links.
    """

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = written(edges, "edges")
    before = state(edges)
    while before[0]:
        n = 2 * before[0]
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(rows_for(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n), "least")
        # large star: neighbours above a node link to the least of the node and its neighbours
        large = written(rows_for(both.where(F.col("v") > F.col("u")).join(few(least, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")), n), "large")
        # small star: a node and the neighbours below it link to the least of them
        lowest = written(rows_for(large.groupBy("u").agg(F.min("v").alias("m")), n), "lowest")
        small = large.join(few(lowest, n), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        edges = written(rows_for(small, n), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
