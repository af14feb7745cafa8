"""Asking the whole corpus about hashed keys with little shuffle.

Many operators must know, for every hashed key of every document, something
that all documents decide (is it repeated elsewhere? how frequent is it?).  One
row for each key would shuffle many times the input.  Instead documents are
dealt into *chunks* of a few MB by a hash; each chunk sends each *bucket* of the
key space one message with its distinct keys, sorted, as 32-bit remainders in
delta-coded byte planes (about 3 bytes a key).  A bucket answers every message
with one value for each key in the same order, and the answer is brought to the
chunk by a cogroup, where the documents meet it.

Both counts grow with the input: chunks hold a bounded number of bytes, buckets
a bounded number of keys, so a bucket's keys stay sparse in 32 bits at any size.
As there is a message for each pair of them, both bounds grow as the square root of
inputs above 30 GB (see plan()), up to 16 times: at 100 TB a message still holds
some 8 keys.  A key that a third of all documents hold costs one entry for each
chunk, as a chunk combines its own copies first; rows that agree in id and text and
would overfill a chunk go as two rows with a count (see in_chunks()).  All of it is
recomputed from the input if an executor is lost; nothing depends on the order of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from .hashing import PRIME
from .shared import few

MESSAGE = "bucket long, chunk long, keys binary, facts binary"
REPLY = "chunk long, bucket long, phase int, reply binary"
_LOW = np.uint64(0xFFFFFFFF)
_PART_BYTES = 64 << 20


@dataclass(frozen=True)
class Plan:
    """How a corpus is dealt: its rows and bytes, numbers of chunks and buckets, and tasks that hold chunks."""

    rows: int
    total: int
    n_chunks: int
    n_buckets: int
    n_parts: int


def text_total(docs: DataFrame, text: Column) -> tuple[int, int]:
    """Rows, and bytes of all texts."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(n), int(size)


def plan(docs: DataFrame, rows: int, total: int, *, chunk_bytes: int, keys: float, bucket_keys: int, row_bytes: int = 40) -> Plan:
    """keys: an estimate of the corpus's distinct keys."""
    grown = min(16.0, max(1.0, math.sqrt(total / 30e9)))
    size = total + row_bytes * rows
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / _PART_BYTES))
    return Plan(rows, total, max(1, math.ceil(size / (chunk_bytes * grown))), max(1, math.ceil(keys / (bucket_keys * grown))), n_parts)


def by_chunk(df: DataFrame, p: Plan) -> GroupedData:
    """df grouped by chunk, in as many partitions as the corpus asks for, or as the session has, if that is more."""
    if p.n_parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(p.n_parts, "chunk")
    return df.groupBy("chunk")


def in_chunks(docs: DataFrame, id_col: str, text_col: str, *, chunk_bytes: int, keys_per_byte: float, bucket_keys: int, row_bytes: int = 40) -> tuple[DataFrame, Plan]:
    """chunk, id, text (null texts empty), copies; and the plan. Chunks are dealt by a hash of id and text.

    Rows that agree in id and text meet in one chunk.  Where they would overfill
    it, they go as two rows, of which one stands for itself and one for all others
    (copies): a string of theirs occurs more than once either way, and results of equal rows are equal.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    same = F.xxhash64("id", "text")
    counts = slim.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    large = (F.col("n") > 2) & (F.col("size") + row_bytes * F.col("n") > chunk_bytes)
    rows, total, n_large = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.count_if(large)).first()
    p = plan(docs, rows, total, chunk_bytes=chunk_bytes, keys=total * keys_per_byte + rows, bucket_keys=bucket_keys, row_bytes=row_bytes)
    one = F.lit(1).cast("long")
    if n_large:  # at most one for each chunk
        hot = few(counts.where(large).select("same"), n_large)
        told = slim.withColumn("same", same)
        twice = told.join(hot, "same", "left_semi").groupBy("id", "text").agg(F.count(F.lit(1)).alias("n"))
        slim = told.join(hot, "same", "left_anti").select("id", "text", one.alias("copies"))
        slim = slim.unionAll(twice.select("id", "text", F.explode(F.when(F.col("n") > 1, F.array(one, F.col("n") - 1)).otherwise(F.array(one)))))
    else:
        slim = slim.withColumn("copies", one)
    return slim.select(F.pmod(same, F.lit(p.n_chunks)).alias("chunk"), "id", "text", "copies"), p


def each_copy(results: DataFrame) -> DataFrame:
    """A row for every copy of in_chunks()."""
    times = F.when(F.col("copies") > 1, F.sequence(F.lit(1).cast("long"), "copies")).otherwise(F.array(F.lit(1).cast("long")))
    return results.withColumn("copies", F.explode(times)).drop("copies")


def routed(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket in the high 32 bits, remainder in the low ones."""
    return ((hashes >> np.uint64(40)) % np.uint64(n_buckets)) << np.uint64(32) | (hashes & _LOW)


def packed(sorted32: np.ndarray) -> bytes:
    gaps = np.diff(sorted32.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    gaps = np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint32)


def messages(chunk: int, keys: np.ndarray, facts: np.ndarray) -> pa.Table:
    """One row for each bucket that has keys; keys: sorted and distinct, from routed(); facts: an array with a row for each key."""
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(keys))[: len(cuts)]  # none if there are no keys
    return pa.table({
        "bucket": pa.array(bucket[cuts]),
        "chunk": pa.array(np.full(len(cuts), chunk, dtype=np.int64)),
        "keys": pa.array([packed(keys[a:b] & _LOW) for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        "facts": pa.array([facts[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
    })


def bucket_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of a bucket's messages: all keys end to end, where each message ends, and the messages' facts."""
    keys = [unpacked(x) for x in table.column("keys").to_pylist()]
    return (np.concatenate(keys) if keys else np.empty(0, np.uint32)), np.cumsum([len(k) for k in keys]), table.column("facts").to_pylist()


def replies(table: pa.Table, answer: np.ndarray, ends: np.ndarray, phase: int) -> pa.Table:
    """answer: a row for each key in the order of bucket_keys(); bool goes as bits."""
    parts = np.split(answer, ends[:-1])
    return pa.table({
        "chunk": table.column("chunk"),
        "bucket": table.column("bucket"),
        "phase": pa.array(np.full(len(parts), phase, dtype=np.int32)),
        "reply": pa.array([np.packbits(p).tobytes() if p.dtype == bool else p.tobytes() for p in parts], pa.binary()),
    })


def answered(keys: np.ndarray, table: pa.Table, phase: int, kind: type) -> np.ndarray:
    """The answers to a chunk's own keys, in their order; kind: what replies() was given."""
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    out = np.zeros(len(keys), dtype=kind)
    for b, ph, raw in zip(table.column("bucket").to_pylist(), table.column("phase").to_pylist(), table.column("reply").to_pylist(), strict=True):
        if ph == phase:
            a, z = np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right")
            out[a:z] = np.unpackbits(np.frombuffer(raw, np.uint8), count=z - a).astype(bool) if kind is bool else np.frombuffer(raw, kind)
    return out


#: A fingerprint of 122 bits: two hashes modulo 2**61 - 1 with bases drawn independently.
PAIR = np.dtype([("h", "<u8"), ("g", "<u8")])


def pair_bucket(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return h // np.uint64(PRIME // n_buckets + 1)  # in order of h


def in_order(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Order by h, then g; a sort by h alone is enough, and faster, unless two that agree in h differ in g."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    return np.lexsort((g, h)) if (g[order[1:][same]] != g[order[:-1][same]]).any() else order


def distinct_pairs(h: np.ndarray, g: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints sorted, and so by bucket, whether each occurs more than once, and each input's place among them."""
    order = in_order(h, g)
    pairs = np.empty(len(h), dtype=PAIR)
    pairs["h"], pairs["g"] = h[order], g[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = pairs[1:] != pairs[:-1]
    group = np.cumsum(new) - 1
    inverse = np.empty(len(h), dtype=np.int64)
    inverse[order] = group
    out = pairs[new]
    return out, np.bincount(group, minlength=len(out)) > 1, inverse


def pair_keys(pairs: np.ndarray, n_buckets: int) -> np.ndarray:
    """Keys with the fingerprints' buckets, for answered()."""
    return pair_bucket(pairs["h"], n_buckets) << np.uint64(32)


def pair_messages(chunk: int, pairs: np.ndarray, many: np.ndarray, n_buckets: int) -> pa.Table:
    bucket = pair_bucket(pairs["h"], n_buckets).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(pairs))[: len(cuts)]
    return pa.table({
        "bucket": pa.array(bucket[cuts]),
        "chunk": pa.array(np.full(len(cuts), chunk, dtype=np.int64)),
        "keys": pa.array([pairs[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        "facts": pa.array([many[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
    })


def repeated_pairs(table: pa.Table, phase: int) -> pa.Table:
    """Answer a bucket's pair_messages: which fingerprints occur more than once in the corpus."""
    raw = table.column("keys").to_pylist()
    pairs = np.frombuffer(b"".join(raw), PAIR)
    many = np.frombuffer(b"".join(table.column("facts").to_pylist()), bool)
    order = in_order(pairs["h"].copy(), pairs["g"])
    ranked = pairs[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    repeated = (np.bincount(group) > 1) | (np.bincount(group, many[order]) > 0)
    answer = np.empty(len(ranked), dtype=bool)
    answer[order] = repeated[group]
    return replies(table, answer, np.cumsum([len(x) // PAIR.itemsize for x in raw]), phase)
