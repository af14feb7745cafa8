"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .hashing import FIXED, mix64, words_of
from .shared import forget, hold, nested, stored, written

_FIELDS = (("item_id", "bigint"), ("first_word", "bigint"), ("n_words", "bigint"), ("similarity", "double"), ("distance", "int"))
_HITS = ArrayType(StructType([StructField(n, {"bigint": LongType(), "double": DoubleType(), "int": IntegerType()}[k]) for n, k in _FIELDS]))
_BITS = 64
_BLOCKS = 4
_WIDTH = _BITS // _BLOCKS
_STRETCH = 8192


def shingle_bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each hash."""
    return np.unpackbits(mix64(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of weighted bit sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def neighbours(width: int, radius: int) -> np.ndarray:
    """All patterns of `width` bits with at most `radius` ones."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.uint32)


def short_hashes(single: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words, fewer than a shingle has, from the words' hashes."""
    return mix64(FIXED.windows(single, n) ^ np.uint64(n % 8 << 61))


def bags_of(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Places of the texts that have words, how many words each has, and its shingles."""
    words = words_of(pa.array(texts, pa.string()))
    counts, single = np.diff(words.first), words.hashes()
    rolling = mix64(FIXED.windows(single, size))
    item = np.flatnonzero(counts)
    bags = [rolling[a : a + n - size + 1] if n >= size else short_hashes(single[a : a + n], n) for a, n in zip(words.first[item].tolist(), counts[item].tolist(), strict=True)]
    return item, counts[item], bags


def common_shingles(bags: list[np.ndarray], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles that more than one item holds, sorted, how many items do, and how many items there are; bag i stands for times[i] items."""
    each = [np.unique(b) for b in bags]
    shingles, place = np.unique(np.concatenate([np.empty(0, np.uint64), *each]), return_inverse=True)
    df = np.bincount(place, weights=np.repeat(times, list(map(len, each))), minlength=len(shingles)).astype(np.int64)
    return shingles[df > 1], df[df > 1], int(times.sum())


def built_index(texts: list[str], size: int, times: list[int] | None = None, common: tuple[np.ndarray, np.ndarray, int] | None = None) -> dict[str, np.ndarray]:
    """The index of a block of benchmark items as arrays, about five times the texts' bytes: built once, broadcast, and used as it is (see Index).

    times: how many items each text stands for (one, if not given); common: common_shingles of the whole benchmark, if these texts are a part of it.

    Items (those with words): item, its place among texts; words, its number of words; bags from cut[i]
    to cut[i + 1], its shingles.  Shingles: all that occur, sorted; for each the lengths of
    the items that hold it.  common, common_df and n_items: see common_shingles; common is left out if it is given.
    prints: items' fingerprints; for each block of bits the items in order of
    its value there, the distinct values, and where each begins.
    """
    item, counts, bags = bags_of(texts, size)
    none = np.empty(0, np.uint64)
    bag, cut = np.concatenate([none, *bags]), np.cumsum([0, *map(len, bags)])
    owner = np.repeat(np.arange(len(item)), np.diff(cut))
    shingles, place = np.unique(bag, return_inverse=True)
    longest = int(counts.max(initial=0)) + 1
    lengths = np.unique(place * longest + counts[owner])
    out = {"item": item, "words": counts, "bags": bag, "cut": cut, "shingles": shingles, "lengths": lengths % longest, "lengths_cut": np.searchsorted(lengths // longest, np.arange(len(shingles) + 1))}
    if common is None:
        common = common_shingles(bags, (np.ones(len(texts), np.int64) if times is None else np.asarray(times, np.int64))[item])
        out |= {"common": common[0], "common_df": common[1], "n_items": np.array(common[2])}
    weights = Weights(*common)(bag)
    prints = np.array([simhash((shingle_bits(b) * weights[a:z, None]).sum(0)[None, :])[0] for b, a, z in zip(bags, cut[:-1], cut[1:], strict=True)], dtype=np.uint64)
    out["prints"] = prints
    for b in range(_BLOCKS):
        part = (prints >> np.uint64(b * _WIDTH) & np.uint64((1 << _WIDTH) - 1)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        values, first = np.unique(part[order], return_index=True)
        out |= {f"order{b}": order, f"values{b}": values, f"first{b}": np.append(first, len(order))}
    return out


class Weights:
    """ln(1 + items / items that hold it) of each shingle; one item or none: the most there is."""

    def __init__(self, common: np.ndarray, df: np.ndarray, n_items: int):
        self.common, self.weights, self.most = common, np.log1p(max(1, int(n_items)) / df), math.log1p(max(1, int(n_items)))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(hashes), self.most)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, self.weights[at], self.most)


class Index:
    """Search in the arrays of built_index; common: as it was given there."""

    def __init__(self, arrays: dict[str, np.ndarray], size: int, radius: int, common: tuple[np.ndarray, np.ndarray, int] | None = None):
        self.size, self.radius = size, radius
        self.weigh = Weights(*(common or (arrays["common"], arrays["common_df"], arrays["n_items"])))
        for name in ("item", "words", "bags", "cut", "shingles", "lengths", "lengths_cut", "prints"):
            setattr(self, name, arrays[name])
        self.blocks = [(arrays[f"order{b}"], arrays[f"values{b}"], arrays[f"first{b}"]) for b in range(_BLOCKS)]
        self.near = neighbours(_WIDTH, radius // _BLOCKS)
        self.tiny = {}
        for j in np.flatnonzero(self.words < size).tolist():
            self.tiny.setdefault(int(self.words[j]), {}).setdefault(int(self.bags[self.cut[j]]), []).append(j)

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among shingles, and whether they are there."""
        at = np.minimum(np.searchsorted(self.shingles, hashes), max(len(self.shingles) - 1, 0))
        return at, self.shingles[at] == hashes if len(self.shingles) else np.zeros(len(hashes), bool)

    def similarity(self, item: np.ndarray, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of two bags of shingles."""
        a, n = np.unique(item, return_counts=True)
        b, m = np.unique(window, return_counts=True)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        both = (np.minimum(n[i], m[j]) * self.weigh(a[i])).sum()
        return float(both / ((n * self.weigh(a)).sum() + (m * self.weigh(b)).sum() - both))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of fingerprint and item within the radius.

        Fingerprints within 4 * r + 3 bits are within r bits in at least one of 4 blocks.  For each
        block's value the items near it are found from the patterns of up to r bits, or from
        the distinct values there are, whichever are fewer; both give the same.
        """
        pairs = []
        for b, (order, values, first) in enumerate(self.blocks):
            part, at = np.unique((prints >> np.uint64(b * _WIDTH) & np.uint64((1 << _WIDTH) - 1)).astype(np.uint32), return_inverse=True)
            for a in range(0, len(part), 256):
                own = part[a : a + 256, None]
                if len(values) <= len(self.near):
                    who, value = np.nonzero(np.bitwise_count(own ^ values[None, :]) <= self.radius // _BLOCKS)
                else:
                    probe = own ^ self.near[None, :]
                    place = np.minimum(np.searchsorted(values, probe), len(values) - 1)
                    who, hit = np.nonzero(values[place] == probe)
                    value = place[who, hit]
                begin, many = first[value], first[value + 1] - first[value]
                items = order[np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)]
                # from distinct values back to fingerprints
                groups = np.repeat(who + a, many)
                by = np.argsort(at, kind="stable")
                start = np.searchsorted(at[by], np.arange(len(part) + 1))
                size = start[groups + 1] - start[groups]
                window = by[np.arange(size.sum()) + np.repeat(start[groups] - (np.cumsum(size) - size), size)]
                pairs.append(window * len(self.prints) + np.repeat(items, size))
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // len(self.prints), pair % len(self.prints)
        fits = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
        return window[fits], item[fits]

    def search(self, hashes: np.ndarray, n_words: int, threshold: float) -> list[tuple]:
        """Best window of each item that a text of n_words words holds: item, first word, length, similarity, distance; hashes: of its shingles.

        Windows that share no shingle with an item of their length have similarity 0
        and are not fingerprinted; all others are.
        """
        place, known = self.known(hashes)
        at = np.flatnonzero(known)
        if not len(at):
            return []
        begin, many = self.lengths_cut[place[at]], np.diff(self.lengths_cut)[place[at]]
        length = self.lengths[np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)]
        at = np.repeat(at, many)
        best: dict[int, tuple] = {}
        for n in np.unique(length[length >= self.size]).tolist():
            span = n - self.size + 1
            shared = at[length == n]
            low, high = np.maximum(shared - span + 1, 0), np.minimum(shared, n_words - n) + 1
            low, high = low[high > low], high[high > low]
            open_ = np.bincount(low, minlength=len(hashes) + 1) - np.bincount(high, minlength=len(hashes) + 1)
            starts = np.flatnonzero(np.cumsum(open_) > 0)
            # windows a stretch at a time, so that a long text takes no more memory
            for first in np.split(starts, np.flatnonzero(np.diff(starts // _STRETCH)) + 1) if len(starts) else ():
                self._search(hashes, first, n, span, threshold, best)
        return sorted(best.values())

    def _search(self, hashes, first, n, span, threshold, best) -> None:
        low = int(first[0])
        h = hashes[low : int(first[-1]) + span]
        total = np.zeros((len(h) + 1, _BITS))
        np.cumsum(shingle_bits(h) * self.weigh(h)[:, None], axis=0, out=total[1:])
        prints = simhash(total[first - low + span] - total[first - low])
        window, item = self.within(prints)
        fits = self.words[item] == n
        window, item = window[fits], item[fits]
        distance = np.bitwise_count(prints[window] ^ self.prints[item])
        for w, j, d in zip(window.tolist(), item.tolist(), distance.tolist(), strict=True):
            if j in best and best[j][3] >= 1:
                continue
            s = self.similarity(self.bags[self.cut[j] : self.cut[j + 1]], hashes[first[w] : first[w] + span])
            if s >= threshold and (j not in best or s > best[j][3]):
                best[j] = (int(self.item[j]), int(first[w]), n, s, int(d))

    def search_all(self, column, threshold: float) -> list[list[tuple]]:
        """search() for each text of a column, items shorter than a shingle included: these match runs of as many words exactly."""
        words = words_of(column)
        single = words.hashes()
        h = mix64(FIXED.windows(single, self.size))
        left = words.left()
        found = [self.search(h[a : max(a, z - self.size + 1)], z - a, threshold) if z - a >= self.size else [] for a, z in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        for n, items in self.tiny.items():
            runs = short_hashes(single, n)
            hit = np.flatnonzero(np.isin(runs, np.array(list(items), np.uint64)) & (left[: len(runs)] >= n))
            seen = set()
            for p, doc in zip(hit.tolist(), (np.searchsorted(words.first, hit, "right") - 1).tolist(), strict=True):
                for j in items[int(runs[p])]:
                    if (doc, j) not in seen:
                        seen.add((doc, j))
                        found[doc].append((int(self.item[j]), int(p - words.first[doc]), n, 1.0, 0))
        return found


def _common_of(items: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """common_shingles of a table of distinct items (text, times)."""

    def bags(batches):
        for batch in batches:
            times = batch.column("times").to_numpy(zero_copy_only=False)
            item, _, found = bags_of(batch.column("text").to_pylist(), size)
            each = [np.unique(b) for b in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *each]).view(np.int64)), pa.array(np.repeat(times[item], list(map(len, each))).astype(np.int64))], ["shingle", "n"])

    held = items.select("text", "times").mapInArrow(bags, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > 1).toPandas()  # see contamination() for its size
    common = held["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    n_items = items.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    return common[order], held["n"].to_numpy(np.int64)[order], n_items


def _with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, shingle_words: int, threshold: float, radius: int, block_bytes: int) -> DataFrame:
    """row (the whole row of docs) and hits."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    items = items.groupBy("item", "text").agg(F.count(F.lit(1)).alias("times"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(total / block_bytes))
    shared = None
    if n_blocks > 1:
        items = written(items, "items")
        common = _common_of(items, shingle_words)
        shared = spark.sparkContext.broadcast(common)
    marked = nested(docs, text=F.coalesce(F.col(text_col).cast("string"), F.lit("")), hits=F.array().cast(_HITS))
    names = [n for n, _ in _FIELDS]
    arrow = pa.struct([(n, {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}[k]) for n, k in _FIELDS])
    sent = before = None
    for b in range(n_blocks):
        if sent is not None:
            # one block's index is with the executors at a time, and one table of rows and hits
            marked, path = stored(marked, "marked")
            hold(spark, path, keep=True)
            sent.destroy()
            if before:
                forget(spark, before)
            before = path
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).orderBy("item", "text").collect()  # about block_bytes
        arrays = built_index([r["text"] for r in part], shingle_words, [r["times"] for r in part], common if shared else None)
        sent = spark.sparkContext.broadcast(([(r["item"], r["times"]) for r in part], arrays))

        def find(batches, sent=sent):
            ids, arrays = sent.value
            index = Index(arrays, shingle_words, radius, shared.value if shared else None)
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    cut = batch.slice(a, 256)
                    out = []
                    for found in index.search_all(cut.column("text"), threshold):
                        hits = sorted(((ids[i][0], *f) for i, *f in found for _ in range(ids[i][1])), key=lambda f: (f[0] is not None, f[0] or 0, *f[1:]))  # places, as ids may be null
                        out.append([dict(zip(names, f, strict=True)) for f in hits])
                    yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(out, pa.list_(arrow))], [*cut.schema.names, "found"])

        marked = marked.mapInArrow(find, StructType([*marked.schema.fields, StructField("found", _HITS)]))
        marked = marked.select("row", "text", F.array_sort(F.concat("hits", "found")).alias("hits"))  # by item, whatever its block
    return marked.select("row", "hits")


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle_words: int = 5, threshold: float = 0.8, radius: int = 19, block_bytes: int = 8 << 20
) -> DataFrame:
    """Add contaminated (boolean) and hits (array of item_id, first_word, n_words, similarity, distance: the best window of each item) to every row.

    For an item of n words every run of n words of a document is a window.  Items and
    windows are bags of shingles of shingle_words words; a shingle weighs ln(1 + items /
    items that hold it), most if no item does.  Fingerprints are 64-bit SimHashes of
    the weighted shingles.  An index of all items, in four blocks of 16 bits with all
    patterns near theirs, gives every item whose fingerprint is within `radius`
    bits of a window's; those whose weighted Jaccard similarity with the window, computed
    from the shingles, is at least threshold are hits.  At a similarity of 0.8
    fingerprints differ in about 9.5 bits, so 19 leaves out about one in a thousand.

    The benchmark goes to all tasks in blocks of items of about block_bytes of text,
    one after the other: the driver builds each block's index, some five times
    its texts' bytes, and broadcasts it.  Documents stay where they are, and are
    read once for each block; with several blocks rows and hits are written between them, so executors hold the
    index of one.  Weights count all items, however many blocks there are: shingles that several items
    hold go to all tasks, 16 bytes each, which is 8 for each word of the benchmark at most, so hardly more than its text.  Null and empty texts, on either side, hold nothing.
    Items shorter than a shingle are one shingle of their words and match windows of as many words exactly.
    Items whose id is null are items, and item_id is null in their hits.  Repeated items are items.  Columns of docs are
    kept; contaminated and hits replace columns so named.
    """
    told = _with_hits(docs, benchmark, text_col, item_col, item_text_col, shingle_words, threshold, radius, block_bytes)
    kept = [f"row.`{c}`" for c in docs.columns if c not in ("contaminated", "hits")]
    return told.select(*kept, "hits", (F.size("hits") > 0).alias("contaminated"))


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle_words: int = 5, threshold: float = 0.8, radius: int = 19, block_bytes: int = 8 << 20
) -> DataFrame:
    """The rows of docs that hold no item, with the columns of docs and no others; see contamination."""
    return _with_hits(docs, benchmark, text_col, item_col, item_text_col, shingle_words, threshold, radius, block_bytes).where(F.size("hits") == 0).select("row.*")
