"""Substring dedup over words by fixed-block anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .hashing import Family, covered, mix64, words_of


def substring_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_bytes: int = 3 << 20, bucket_keys: int = 1_000_000, keep_text: bool = False
) -> DataFrame:
    """Remove every word that lies in a `window`-word sequence that starts anywhere else as well.

    Fixed blocks of B = (window + 1) // 2 words, one after the other from each
    document's start, are the index: any window holds one whole block.  Every
    rolling B-word window of every document probes the index (32-bit remainders
    within buckets: a filter that may pass too much, never too little).  A hit is
    extended to exact repeats group by group rather than pair by pair: all
    `window`-word windows around a block that another place probed are counted by
    fingerprints of their words; what is counted twice is repeated, and
    overlapping repeats merge into maximal runs.  n copies so cost n entries, not
    n * n pairs.  Words are hashed by a polynomial modulo 2**61 - 1, and a fingerprint is two
    such polynomials of the words' hashes, with three bases drawn anew for each call: no text can be made
    for which different windows agree.  Whatever they are, two windows that differ in words do so
    with a probability under 2**-56 (if all their different words have equal hashes), else under 2**-110.

    Returns a row for each input row: id, n_words, n_removed, kept_sha256, n_spans
    (maximal removed runs), and with keep_text the kept words joined by one space.
    Null and empty texts have no words (sha256 of nothing).  Repeated rows are
    documents of their own, so both lose what they share.  Null ids stay null;
    other columns are left out.
    """
    block = (window + 1) // 2
    chunks, plan = X.in_chunks(docs, id_col, text_col, chunk_bytes=chunk_bytes, keys_per_byte=1 / 6, bucket_keys=bucket_keys)
    n_buckets = plan.n_buckets
    one, two = Family.drawn(), Family.drawn()

    def anchors(words):
        """Of every rolling block of the column's documents: its first word, routed hash, and whether it is a fixed block."""
        h = mix64(one.windows(words.hashes(one), block))
        at = np.flatnonzero(words.left()[: len(h)] >= block) if len(h) else np.empty(0, np.int64)
        fixed = words.positions()[at] % block == 0
        return at, X.routed(h[at], n_buckets), fixed

    def copied(words, table, at):
        """Which of the words at these places are of rows that stand for several."""
        return np.repeat(table.column("copies").to_numpy() > 1, np.diff(words.first))[at]

    def ask(key, table):
        words = words_of(table.column("text"))
        at, keys, fixed = anchors(words)
        own, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        facts = (times > 1).astype(np.uint8) * 2
        facts[inverse[fixed]] |= 1
        facts[inverse[copied(words, table, at)]] |= 2
        return X.messages(key[0].as_py(), own, facts)

    def probe(key, table):
        keys, ends, facts = X.bucket_keys(table)
        facts = np.frombuffer(b"".join(facts), np.uint8)
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        several = (times > 1) | (np.bincount(inverse, facts >> 1, len(times)) > 0)
        indexed = np.bincount(inverse, facts & 1, len(times)) > 0
        return X.replies(table, (several & indexed)[inverse], ends, 1)

    def candidates(words, table):
        """First words of windows that may be repeated, and their fingerprints."""
        at, keys, fixed = anchors(words)
        own, inverse = np.unique(keys, return_inverse=True)
        hit = X.answered(own, table, 1, bool)[inverse]
        n = len(words.start)
        own_block = np.zeros(n + window, dtype=np.int32)
        own_block[at[hit & fixed]] = 1
        reach = np.cumsum(own_block)
        left = words.left()
        starts = np.flatnonzero(left >= window)
        # blocks wholly inside a window start within its first window - block + 1 words
        inside = reach[starts + window - block] - np.where(starts > 0, reach[starts - 1], 0)
        starts = starts[inside > 0]
        return starts, one.windows(words.hashes(one), window)[starts], two.windows(words.hashes(one), window)[starts]

    def extend(key, table, right):
        words = words_of(table.column("text"))
        starts, h, g = candidates(words, right)
        pairs, many, inverse = X.distinct_pairs(h, g, n_buckets)
        many[inverse[copied(words, table, starts)]] = True
        return X.pair_messages(key[0].as_py(), pairs, many, n_buckets)

    def remove(key, table, right):
        words = words_of(table.column("text"))
        starts, h, g = candidates(words, right)
        pairs, _, inverse = X.distinct_pairs(h, g, n_buckets)
        gone = covered(starts[X.answered(X.pair_keys(pairs, n_buckets), right, 2, bool)[inverse]], window, len(words.start))
        first = words.first
        # adjoining words of two documents are two runs
        begins = gone & ~np.concatenate(([False], gone[:-1]))
        begins |= gone & (words.positions() == 0)
        count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[first])
        kept = ~gone
        lens = words.end - words.start
        text, at = joined(words.data[words.byte_is_word], lens, kept, first)
        parts = [text[a:b].tobytes() for a, b in zip(at[:-1], np.maximum(at[1:] - 1, at[:-1]), strict=True)]
        out = {
            "id": table.column("id"),
            "n_words": pa.array(np.diff(first).astype(np.int64)),
            "n_removed": pa.array(count(gone).astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
            "n_spans": pa.array(count(begins).astype(np.int64)),
            "copies": table.column("copies"),
        }
        if keep_text:
            out["kept_text"] = pa.array([p.decode("utf-8", "replace") for p in parts], pa.string())
        return pa.table(out)

    grouped = lambda df: X.by_chunk(df, plan)
    first = grouped(chunks).applyInArrow(ask, X.MESSAGE).groupBy("bucket").applyInArrow(probe, X.REPLY)
    second = grouped(chunks).cogroup(grouped(first)).applyInArrow(extend, X.MESSAGE).groupBy("bucket").applyInArrow(lambda key, table: X.repeated_pairs(table, 2), X.REPLY)
    schema = "id long, n_words long, n_removed long, kept_sha256 string, n_spans long, copies long" + ", kept_text string" * keep_text
    out = grouped(chunks).cogroup(grouped(first.unionAll(second))).applyInArrow(remove, schema)
    return X.each_copy(out).withColumnRenamed("id", id_col)


def joined(word_bytes: np.ndarray, lens: np.ndarray, kept: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words, each with a space behind it, end to end; and where each document begins. word_bytes: all words without what parts them."""
    sizes = np.where(kept, lens + 1, 0)
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.full(at[-1], 32, dtype=np.uint8)
    letter = np.ones(at[-1], dtype=bool)
    letter[at[1:][kept] - 1] = False
    out[letter] = word_bytes[np.repeat(kept, lens)]
    return out, at[first]
