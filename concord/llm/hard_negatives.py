"""Hard negatives by distributed radix selection over integer scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

_PACKED = "part int, ids binary, labels binary, v binary"
_COUNTED = "anchor long, w int, digit long, n long"
_GATHERED = "anchor long, w int, id long, score long"


def labelled_vectors(vectors: DataFrame, *, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label, v: floor(scale * component as double) as double.

    Rows with a null id, label, vector or component, or a component that isn't finite, are
    left out, and so are those whose products may not fit 64 bits: the largest component times
    the root of the number of components is over 2**30.
    """
    v = F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    fine = F.forall(vector_col, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale <= float(1 << 30)), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    largest = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    return rows.where(largest * F.sqrt(F.size("v")) <= float(1 << 30))


class _Scores:
    """Rows of one part, packed, and the products of anchors with them."""

    def __init__(self, packed: pa.Table, dims: int, kind: np.dtype):
        joined = lambda name, dtype: np.frombuffer(b"".join(packed.column(name).to_pylist()), dtype)
        self.ids, self.labels = joined("ids", "<i8"), joined("labels", "<i8")
        self.x = joined("v", kind).reshape(len(self.ids), dims)

    def of(self, v: np.ndarray) -> np.ndarray:
        """Whole scores of a tile of anchors: products of floats are exact, as kind() chose these."""
        return (v @ self.x.T).astype(np.int64)


def _kind(largest: float, dims: int) -> np.dtype:
    """A type in which no product of two vectors is rounded; integers are the slowest."""
    bound = largest * largest * max(1, dims)
    return np.dtype("<f4" if bound < 1 << 24 else "<f8" if bound < 1 << 53 else "<i8")


def _filled(column, dims: int, kind: np.dtype) -> np.ndarray:
    """Rows of lists as a matrix; short rows are filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lens), dims), dtype=kind)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


class Selection:
    """Selects, for windows of scores of many anchors, the k highest scores of the same or of other labels among all rows.

    Rows lie in packed parts, anchors in groups; a task has one part and one group, and
    multiplies them in tiles.  A window starts at score `top` and holds offsets top - score from 0 to
    `depth`.  select() finds the offset of the kth row digit by digit: in each round tasks
    count a window's rows by their offset's next digit, but tell only the digits up to the one at which the task itself has
    enough rows, which are at most k and tell as much: the kth row of all can't lie beyond.
    Sums over tasks say which digit holds the kth row, and how many rows come before it.
    After the last digit, rows up to that offset are gathered; of those right at it, each task sends no more
    than are still needed, least ids first.  So what is shuffled are counts, k for
    each window and task, and then little more than the rows that are returned.
    """

    def __init__(self, rows: DataFrame, anchors: DataFrame, *, part_bytes: int, group_anchors: int, digit_bits: int, tile: int):
        self.tile, self.digit_bits = tile, digit_bits
        n, dims, largest, norm = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0)), F.coalesce(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)), F.lit(0.0))).first()
        self.dims, self.kind = dims, _kind(largest, dims)
        #: No score is larger or smaller (Cauchy-Schwarz; with room for rounding).
        self.bound = int(norm * (1 + 1e-9)) + 1
        per_row = max(1, dims) * self.kind.itemsize
        # parts grow with the table, up to part_bytes: each task has one, and all anchors meet all parts
        per_part = max(1, min(max(4096, n // 512), part_bytes // per_row))
        self.n_parts = max(1, math.ceil(n / per_part))
        kind = self.kind

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            for batch in batches:
                v = _filled(batch.column("v"), dims, kind)
                packed = [[part], [batch.column("id").to_numpy(zero_copy_only=False).astype("<i8").tobytes()], [batch.column("label").to_numpy(zero_copy_only=False).astype("<i8").tobytes()], [v.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(packed[0], pa.int32()), *(pa.array(p, pa.binary()) for p in packed[1:])], ["part", "ids", "labels", "v"])

        self.parts = written(rows.repartition(self.n_parts).mapInArrow(pack, _PACKED), "parts")
        self.anchors = written(anchors.select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "v"), "anchors")
        self.n_groups = max(1, math.ceil(1.1 * self.anchors.count() / group_anchors))

    def _meet(self, windows: DataFrame, work, schema: str) -> DataFrame:
        """work(scores, tile of anchors' rows, whole scores) for each part and group; windows: anchor, w and what work needs of each window."""
        columns = [c for c in windows.columns if c != "anchor"]
        listed = windows.groupBy("anchor").agg(F.collect_list(F.struct(*columns)).alias("windows"))  # at most k of an anchor
        asked = self.anchors.join(listed, "anchor").withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(self.n_groups)))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.n_parts - 1))))
        rows = self.parts.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n_groups - 1).cast("long"))))
        dims, kind, tile = self.dims, self.kind, self.tile
        names = [c.split()[0] for c in schema.split(", ")]

        def run(key, packed: pa.Table, asked: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if len(packed) and len(asked):
                scores = _Scores(packed, dims, kind)
                v = _filled(asked.column("v"), dims, kind)
                who = list(zip(*(asked.column(c).to_pylist() for c in ("anchor", "id", "label", "windows")), strict=True))
                for a in range(0, len(who), tile):
                    for one, row in zip(who[a : a + tile], scores.of(v[a : a + tile]), strict=True):
                        out += work(scores, one, row)
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            return pa.table({name: pa.array(np.concatenate(c) if out else [], pa.int32() if name == "w" else pa.int64()) for name, c in zip(names, columns, strict=True)})

        return rows.groupBy("part", "group").cogroup(asked.groupBy("part", "group")).applyInArrow(run, schema)

    def select(self, windows: DataFrame, k: int, *, same: bool) -> DataFrame:
        """anchor, w, rank (from 1), id, score: the k highest scores (all, if fewer) of each of windows (anchor, w, top, depth), ties by the smaller id; same: of rows with the anchor's label but another id; else of those with other labels."""
        most = windows.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
        rounds = max(1, math.ceil(most.bit_length() / self.digit_bits))
        bits = max(1, math.ceil(most.bit_length() / rounds))

        def among(scores: _Scores, who: tuple) -> np.ndarray:
            return (scores.labels == who[2]) & (scores.ids != who[1]) if same else scores.labels != who[2]

        state = windows.select("anchor", "w", "top", "depth", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("whole"))
        for left in reversed(range(rounds)):

            def count(scores: _Scores, who: tuple, row: np.ndarray, shift: int = left * bits) -> list[tuple]:
                row, out = row[among(scores, who)], []
                for x in who[3]:
                    o = x["top"] - row
                    o = o[(o >= 0) & (o <= x["depth"])]
                    digit = (o >> shift) - (x["prefix"] << bits)
                    n = np.bincount(digit[(digit >= 0) & (digit < 1 << bits)])
                    at = np.flatnonzero(n)
                    at = at[: np.searchsorted(np.cumsum(n[at]), x["need"]) + 1]
                    out.append((np.full(len(at), who[0]), np.full(len(at), x["w"], dtype=np.int32), at, n[at]))
                return out

            asks = state.where(~F.col("whole"))
            counts = self._meet(asks.select("anchor", "w", "top", "depth", "prefix", "need"), count, _COUNTED).groupBy("anchor", "w", "digit").agg(F.sum("n").alias("n"))
            upto = F.sum("n").over(Window.partitionBy("anchor", "w").orderBy("digit"))
            hit = counts.withColumn("before", upto - F.col("n")).join(asks.select("anchor", "w", "need"), ["anchor", "w"])
            hit = hit.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need"))).select("anchor", "w", "digit", "before")
            # windows with too few rows are taken whole
            state = state.join(hit, ["anchor", "w"], "left").select(
                "anchor", "w", "top", "depth", F.when(F.col("digit").isNotNull(), F.shiftleft("prefix", bits) + F.col("digit")).otherwise(F.col("prefix")).alias("prefix"),
                (F.col("need") - F.coalesce("before", F.lit(0))).alias("need"), (F.col("whole") | F.col("digit").isNull()).alias("whole"),
            )
            state = written(state, "windows")

        def gather(scores: _Scores, who: tuple, row: np.ndarray) -> list[tuple]:
            fine = among(scores, who)
            row, ids, out = row[fine], scores.ids[fine], []
            for x in who[3]:
                o = x["top"] - row
                last = x["depth"] if x["whole"] else x["prefix"]
                at = np.flatnonzero((o >= 0) & (o <= last))
                if not x["whole"]:
                    tied = at[o[at] == last]
                    at = np.concatenate((at[o[at] < last], tied[np.argsort(ids[tied], kind="stable")[: x["need"]]]))
                out.append((np.full(len(at), who[0]), np.full(len(at), x["w"], dtype=np.int32), ids[at], row[at]))
            return out

        found = self._meet(state.select("anchor", "w", "top", "depth", "prefix", "need", "whole"), gather, _GATHERED)
        rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 5, low_percent: int = 80,
    part_bytes: int = 32 << 20, group_anchors: int = 4096, digit_bits: int = 9, tile: int = 128,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`.  An anchor's positives are the
    first `positives` rows of its label with another id, and for each of these its hard negatives are the first
    `negatives` rows of other labels whose score is at most the positive's and at least low_percent
    of it; all, if there are fewer.  Scores are whole inner products of vectors of floor(scale * c);
    higher ones come first, ties by the smaller id.  Both choices are made by Selection.

    Labels are whole numbers.  Rows that labelled_vectors() leaves out take no part.  Vectors that are too short are
    filled with 0.  Rows that repeat an id are rows of their own: each such anchor has its own
    result, and each such positive or negative fills a rank.  Positives of negative score have
    no negatives.  Empty tables, and tables without anchors, give no rows.
    """
    rows = labelled_vectors(vectors, id_col=id_col, label_col=label_col, vector_col=vector_col, scale=scale)
    search = Selection(rows, rows.where(F.pmod("id", F.lit(every)) == 0), part_bytes=part_bytes, group_anchors=group_anchors, digit_bits=digit_bits, tile=tile)
    whole = search.anchors.select("anchor", F.lit(0).alias("w"), F.lit(search.bound).cast("long").alias("top"), F.lit(2 * search.bound).cast("long").alias("depth"))
    best = written(search.select(whole, positives, same=True).select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 s >= low_percent * p for a score s at an offset o = p - s means 100 o <= (100 - low_percent) * p
    depth = F.expr(f"positive_score div 100 * {100 - low_percent} + positive_score % 100 * {100 - low_percent} div 100")
    found = search.select(best.where(F.col("positive_score") >= 0).select("anchor", "w", F.col("positive_score").alias("top"), depth.alias("depth")), negatives, same=False)
    found = found.select("anchor", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(best, ["anchor", "w"]).join(search.anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
