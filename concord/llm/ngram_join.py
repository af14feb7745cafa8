"""N-gram Jaccard join: all documents joined by links of word n-grams, found exactly by prefix trees."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .components import connected_components
from .hashing import Family, mix64, words_of
from .shared import few, scratch, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLASSES = 15  # of frequency, by powers of two; the last one is open
_SET = "digest binary, id long, n long, centre double, tokens binary, prefix array<long>"
_LINK = "a binary, b binary"


def lowered(text_col: str) -> Column:
    """The text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)


def shingle_sets(column, size: int, family: Family) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number and hash, in order; a text of fewer than `size` words has all its words as one shingle, one without words has none."""
    words = words_of(column)
    single = words.hashes(family)
    per = np.diff(words.first)
    long_enough = words.left() >= size
    doc = np.repeat(np.arange(len(per)), per)[long_enough]
    h = mix64(family.windows(single, size))[long_enough[: max(0, len(single) - size + 1)]]
    short = np.flatnonzero((per > 0) & (per < size))
    if len(short):
        # lengths differ from those of the others, so they go into the hash
        whole = [family.windows(single[a:b], b - a)[0] ^ np.uint64((b - a) % 8 << 61) for a, b in zip(words.first[short].tolist(), words.first[short + 1].tolist(), strict=True)]
        doc, h = np.concatenate((doc, short)), np.concatenate((h, mix64(np.array(whole, dtype=np.uint64))))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def least_overlap(n, m, percent: int):
    """The smallest whole overlap o of sets of n and m members for which 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


class PrefixTree:
    """Sets, each a sorted array of ranks, as a compressed trie: a node is an interval of sets in lexicographic order and a run of ranks that they share after its parent's."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        leaves = [sets[i] for i in self.order]
        sizes = sizes[self.order]
        shared = np.zeros(len(leaves) + 1, dtype=np.int64)
        for i in range(1, len(leaves)):
            m = min(len(leaves[i]), len(leaves[i - 1]))
            differ = np.flatnonzero(leaves[i][:m] != leaves[i - 1][:m])
            shared[i] = differ[0] if len(differ) else m
        lengths = np.array([len(x) for x in leaves])
        place = np.cumsum(lengths) - lengths
        low, high, start, end, first, kids = [0], [len(leaves)], [0], [], [], []
        i = 0
        while i < len(low):
            a, b = low[i], high[i]
            first.append(len(low))
            if b - a == 1:
                end.append(len(leaves[a]))
                kids.append(0)
            else:
                inner = shared[a + 1 : b]
                end.append(int(inner.min()))
                cuts = [a, *(np.flatnonzero(inner == end[-1]) + a + 1).tolist(), b]
                kids.append(len(cuts) - 1)
                low += cuts[:-1]
                high += cuts[1:]
                start += [end[-1]] * kids[-1]
            i += 1
        self.low, self.high, self.end, self.first, self.kids = (np.array(x, dtype=np.int64) for x in (low, high, end, first, kids))
        start = np.array(start, dtype=np.int64)
        self.begin, self.stop = place[self.low] + start, place[self.low] + self.end  # of each node's run in ranks
        self.ranks = np.concatenate(leaves) if leaves else np.empty(0, np.uint32)
        self.smallest = np.array([sizes[a:b].min() for a, b in zip(low, high, strict=True)], dtype=np.int64)
        self.largest = np.array([sizes[a:b].max() for a, b in zip(low, high, strict=True)], dtype=np.int64)
        self.deepest = np.array([lengths[a:b].max() for a, b in zip(low, high, strict=True)], dtype=np.int64)

    def linked(self, ranks: np.ndarray, size: int, percent: int, group: np.ndarray, own: int, marks: np.ndarray) -> np.ndarray:
        """Places (in order) of the sets that link with a set of `size` members of which `ranks` can be shared, but for those of its own group.

        All sets below a node share its overlap with the probe, so a level of the trie is one step.
        A subtree is left when all of it is of the probe's own group, or when neither the ranks
        that the probe has left nor those that the longest set below has left can bring the overlap to what the
        smallest set below asks for.
        """
        marks[ranks] = True
        change = np.concatenate(([0], np.cumsum(group[1:] != group[:-1])))
        node, overlap, found = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), []
        while len(node):
            a, b = self.begin[node], self.stop[node]
            runs = b - a
            ends = np.cumsum(runs)
            hits = np.concatenate(([0], np.cumsum(marks[self.ranks[np.arange(runs.sum()) + np.repeat(a - (ends - runs), runs)]])))
            overlap = overlap + hits[ends] - hits[ends - runs]
            passed = np.where(b > 0, np.searchsorted(ranks, self.ranks[np.maximum(b, 1) - 1], "right"), 0)
            # an empty run at the root says nothing about where the probe is
            rest = len(ranks) - np.where(self.end[node] > 0, passed, 0)
            possible = overlap + np.minimum(rest, self.deepest[node] - self.end[node])
            alive = possible >= least_overlap(size, self.smallest[node], percent)
            alive &= 100 * np.minimum(size, self.largest[node]) >= percent * np.maximum(size, self.smallest[node])
            alive &= (change[self.high[node] - 1] != change[self.low[node]]) | (group[self.low[node]] != own)
            node, overlap = node[alive], overlap[alive]
            leaf = self.kids[node] == 0
            found.append(self.low[node[leaf]][100 * overlap[leaf] >= percent * (size + self.smallest[node[leaf]] - overlap[leaf])])
            node, overlap = node[~leaf], overlap[~leaf]
            n = self.kids[node]
            ends = np.cumsum(n)
            overlap = np.repeat(overlap, n)
            node = np.arange(n.sum()) + np.repeat(self.first[node] - (ends - n), n)
        marks[ranks] = False
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def block_links(tokens: list[bytes], sizes: np.ndarray, sides: np.ndarray, groups: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links between sets of different groups that make one group of all groups which links join; of two sides (0, 1; else -1) only across."""
    cuts = np.cumsum([0, *(len(t) // 8 for t in tokens)])
    known, ranks = np.unique(np.frombuffer(b"".join(tokens), "<u8"), return_inverse=True)
    sets = [ranks[a:b].astype(np.uint32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    numbers: dict[bytes, int] = {}
    group = np.array([numbers.setdefault(g, len(numbers)) for g in groups])
    if len(numbers) < 2:
        return []
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (int(sizes.sum()) - both) and (sides[0] < 0 or sides[0] != sides[1]) else []
    kept = np.flatnonzero(sides != 0)  # all, or one side, which the other probes
    probes = np.arange(len(sets)) if len(kept) == len(sets) else np.flatnonzero(sides == 0)
    if sides[0] >= 0 and len(kept) in (0, len(sets)):
        return []
    tree = PrefixTree([sets[i] for i in kept], sizes[kept])
    place = kept[tree.order]
    marks = np.zeros(len(known), dtype=bool)
    links = []
    for i in probes.tolist():
        found = place[tree.linked(sets[i], int(sizes[i]), percent, group[place], group[i], marks)]
        if len(found):
            for g in np.unique(group[found]).tolist():
                links.append((i, int(found[group[found] == g][0])))
            group[np.isin(group, group[found])] = group[i]
            if (group == group[0]).all():
                break
    return links


def ngram_links(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, chunk_bytes: int = 3 << 20, bucket_keys: int = 1_000_000, block: int = 400, block_tokens: int = 4_000_000, cluster_parts: int = 16, part_bytes: int = 8 << 20
) -> tuple[DataFrame, DataFrame]:
    """Two tables: distinct texts (digest, id: the least, n: size of its set), and links a, b (digests) whose components are those of all links.

    A text's set holds its distinct shingles of `words` words, A-Z in lower case; texts link if
    100 * (intersection) >= percent * (union).  Shingles are compared by 60 bits of a
    polynomial modulo 2**61 - 1 with bases drawn for each call.

    1. Chunks of texts learn from buckets (see exchange.py) in how many distinct texts each shingle occurs, by powers of
       two.  These and the hash make the one global order, frequent shingles first.  A shingle of
       one text alone can be in no overlap: it only counts to the set's size.  A set that shares fewer shingles than
       percent of its size with all texts together links with nothing and is done.
    2. Linked sets share one of the rarest size - ceil(percent * size) + 1 shingles of either
       (the prefix), of which those of one text alone needn't be looked at.  Sets that share one are joined to clusters.
    3. A cluster of at most `block` sets goes to one task, which stores them in a PrefixTree and
       probes it with each.  Links to a group that is joined already are not looked for.
    4. Of a larger cluster, every set meets the one whose shingles are the most frequent;
       what is then of one component is not compared again, all others are dealt as pairs of
       bounded parts, one stored, the other probing.  Clusters of over cluster_parts parts are first
       taken apart by the shared shingles, each of which is a group of its own.

    No pair is left out in any case.  Equal texts are one set.  Texts of fewer words are one shingle;
    null and empty texts and those without words have none, and link with nothing.  An empty table gives empty tables.
    """
    chunks, plan = _text_chunks(docs, id_col, text_col, chunk_bytes, bucket_keys)
    family = Family.drawn()
    n_buckets = plan.n_buckets

    def distinct(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
        """A chunk's distinct texts, and the least id of each."""
        column = table.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        coded = column.dictionary_encode()
        least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(least, coded.indices.to_numpy(), table.column("id").fill_null(np.iinfo(np.int64).max).to_numpy())
        return coded.dictionary, least

    def ask(key, table):
        _, h = shingle_sets(distinct(table)[0], words, family)
        keys, times = np.unique(X.routed(h, n_buckets), return_counts=True)
        return X.messages(key[0].as_py(), keys, np.minimum(times, 255).astype(np.uint8))

    def count(key, table):
        keys, ends, facts = X.bucket_keys(table)
        _, inverse = np.unique(keys, return_inverse=True)
        n = np.bincount(inverse, np.frombuffer(b"".join(facts), np.uint8))
        return X.replies(table, np.minimum(np.log2(np.maximum(n, 1)), _CLASSES).astype(np.uint8)[inverse], ends, 1)

    def sets(key, table, right):
        texts, least = distinct(table)
        doc, h = shingle_sets(texts, words, family)
        keys, inverse = np.unique(X.routed(h, n_buckets), return_inverse=True)
        often = X.answered(keys, right, 1, np.uint8)[inverse]
        n = np.bincount(doc, minlength=len(texts))
        shared = np.bincount(doc[often > 0], minlength=len(texts))
        needs = -(-percent * n // 100)
        can = (n > 0) & (shared >= needs)
        fine = (often > 0) & can[doc]
        doc, often, h = doc[fine], often[fine], h[fine]
        token = (np.uint64(_CLASSES) - often) << np.uint64(60) | h >> np.uint64(4)
        token = token[np.lexsort((token, doc))]
        ends = np.cumsum(np.where(can, shared, 0))
        centre = np.bincount(doc, often, len(texts)) / np.maximum(n, 1)
        own = [token[e - s : e] if c else None for e, s, c in zip(ends.tolist(), shared.tolist(), can.tolist(), strict=True)]
        return pa.table({
            "digest": pa.array([hashlib.md5(t.encode()).digest() for t in texts.to_pylist()], pa.binary()),
            "id": pa.array(least, mask=least == np.iinfo(np.int64).max),
            "n": pa.array(n, pa.int64()),
            "centre": pa.array(centre, pa.float64()),
            "tokens": pa.array([None if t is None else t.astype("<u8").tobytes() for t in own], pa.binary()),
            "prefix": pa.array([None if t is None else t[k - 1 :].view(np.int64) for t, k in zip(own, needs.tolist(), strict=True)], pa.list_(pa.int64())),
        })

    by_chunk = lambda df: X.by_chunk(df, plan)
    counted = by_chunk(chunks).applyInArrow(ask, X.MESSAGE).groupBy("bucket").applyInArrow(count, X.REPLY)
    texts = written(by_chunk(chunks).cogroup(by_chunk(counted)).applyInArrow(sets, _SET), "sets")
    links = _links(texts.where(F.col("tokens").isNotNull()), percent=percent, block=block, block_tokens=block_tokens, cluster_parts=cluster_parts, part_bytes=part_bytes)
    return texts.select("digest", "id", "n"), links


def _text_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, bucket_keys: int) -> tuple[DataFrame, X.Plan]:
    """chunk, id, text (in lower case), and the plan. Chunks are dealt by a hash of the text, so each text is in one; of texts whose copies would overfill it, only the least id comes."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), lowered(text_col).alias("text")).withColumn("same", F.xxhash64("text"))
    counts = slim.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    large = (F.col("n") > 2) & (F.col("size") + 40 * F.col("n") > chunk_bytes)
    rows, total, n_large = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.count_if(large)).first()
    plan = X.plan(docs, rows, total, chunk_bytes=chunk_bytes, keys=total / 6 + rows, bucket_keys=bucket_keys)
    if n_large:  # at most one for each chunk
        hot = few(counts.where(large).select("same"), n_large)
        one = slim.join(hot, "same", "left_semi").groupBy("text").agg(F.min("id").alias("id")).select("id", "text", F.xxhash64("text").alias("same"))
        slim = slim.join(hot, "same", "left_anti").select("id", "text", "same").unionAll(one)
    return slim.select(F.pmod("same", F.lit(plan.n_chunks)).alias("chunk"), "id", "text"), plan


def _links(sets: DataFrame, *, percent: int, block: int, block_tokens: int, cluster_parts: int, part_bytes: int) -> DataFrame:
    """Links between sets (digest, n, centre, tokens, prefix) that give the components of all links; see ngram_links()."""
    volume = F.octet_length("tokens") / 8
    parts = lambda n, v: F.ceil(F.greatest(n / block, 2 * v / block_tokens)).cast("int")  # noqa: E731  # two parts hold block_tokens at most
    bounded = lambda n, v: (n <= block) & (v <= block_tokens)
    spread = sets.select("digest", F.explode("prefix").alias("token"))
    shared = spread.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("digest").alias("least"), F.max("digest").alias("most"), F.bit_xor(F.xxhash64("digest")).alias("content")).where(F.col("size") > 1)
    # shingles often occur in the same sets: one of these is enough
    shared = written(shared.groupBy("size", "least", "most", "content").agg(F.min("token").alias("token")).select("token", "least"), "shared")
    n_shared = shared.count()
    held = written(spread.join(few(shared, n_shared), "token").select("token", "least", "digest"), "held")
    clusters = written(connected_components(held.select(F.col("least").alias("a"), F.col("digest").alias("b"))), "clusters").select(F.col("node").alias("digest"), "component")
    slim = sets.select("digest", "centre", volume.alias("volume"))

    def stats(members: DataFrame) -> DataFrame:
        return members.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.sum("volume").alias("tokens"), F.max(F.struct("centre", "digest")).alias("head"))

    members = clusters.join(slim, "digest").select(F.xxhash64("component").alias("group"), "digest", "centre", "volume")
    known = written(stats(members), "known")
    n_known = known.count()
    giant = known.where(parts(F.col("size"), F.col("tokens")) > cluster_parts).select("group")
    n_giant = giant.count()
    if n_giant:
        within = clusters.withColumn("group", F.xxhash64("component")).join(few(giant, n_giant), "group").select("digest")
        apart = held.join(within, "digest", "left_semi").join(slim, "digest").select(F.xxhash64("token", F.lit("token")).alias("group"), "digest", "centre", "volume")
        members = written(members.join(few(giant, n_giant), "group", "left_anti").unionAll(apart), "members")
        known = written(stats(members), "known")
        n_known = known.count()

    def linked(live: DataFrame) -> DataFrame:
        """Links within each block of live (block, side, digest, component)."""
        dealt = live.join(sets.select("digest", "n", "tokens"), "digest")
        size = live.join(slim.select("digest", "volume"), "digest").agg(F.coalesce(F.sum(F.col("volume") * 8 + 100), F.lit(0))).first()[0]
        n_parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / part_bytes))

        def link(key, table):
            table = table.sort_by([("block", "ascending"), ("side", "ascending"), ("digest", "ascending")])
            cuts = [0, *(np.flatnonzero(np.diff(table.column("block").to_numpy())) + 1).tolist(), len(table)]
            digests, found = table.column("digest").to_pylist(), []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                tokens, component = (table.column(c)[a:b].to_pylist() for c in ("tokens", "component"))
                n, side = (table.column(c)[a:b].to_numpy() for c in ("n", "side"))
                found += [(digests[a + i], digests[a + j]) for i, j in block_links(tokens, n, side, component, percent)]
            return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

        return written(dealt.withColumn("part", F.pmod("block", F.lit(n_parts))).repartition(n_parts, "part").groupBy("part").applyInArrow(link, _LINK), "links")

    fits = bounded(F.col("size"), F.col("tokens"))
    n_large = known.where(~fits).count()
    whole = members.join(few(known.where(fits).select("group"), n_known), "group", "left_semi") if n_large else members
    live = whole.select(F.xxhash64("group", F.lit("whole")).alias("block"), F.lit(-1).alias("side"), "digest", F.col("digest").alias("component"))
    if not n_large:
        return linked(live)

    n_parts = parts(F.col("size"), F.col("tokens")).alias("parts")
    large = members.join(few(known.where(~fits).select("group", F.col("head.digest").alias("head"), n_parts), n_large), "group")
    star = lambda part: F.xxhash64("group", part, F.lit("star"))
    stored = large.select(star(F.pmod(F.xxhash64("digest", "group"), "parts").cast("int")).alias("block"), F.lit(1).alias("side"), "digest", F.col("digest").alias("component"))
    heads = known.where(~fits).select("group", F.col("head.digest").alias("digest"), F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"))
    heads = heads.select(star(F.col("part")).alias("block"), F.lit(0).alias("side"), "digest", F.col("digest").alias("component"))
    links = linked(live.unionAll(stored).unionAll(heads))
    components = written(connected_components(links).withColumnRenamed("node", "digest"), "components")
    large = written(large.drop("head", "parts").join(components, "digest", "left").withColumn("component", F.coalesce("component", "digest")), "large")
    shares = large.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("v"))
    shares = shares.groupBy("group").agg(F.sum("n").alias("size"), F.sum("v").alias("tokens"), F.max(F.struct("n", "component", "v")).alias("main")).where(F.col("main.n") < F.col("size"))
    shares = shares.select("group", F.col("main.component").alias("main"), parts(F.col("size") - F.col("main.n"), F.col("tokens") - F.col("main.v")).alias("rest"), parts(F.col("main.n"), F.col("main.v")).alias("mains"))
    # parts of the component with most sets, and of the rest; all pairs of parts but those of the former among themselves
    ours = F.col("component") == F.col("main")
    own = F.when(ours, F.col("rest")).otherwise(0) + F.pmod(F.xxhash64("digest", "group"), F.when(ours, F.col("mains")).otherwise(F.col("rest"))).cast("int")
    pairs = large.join(few(shares, n_large), "group").withColumn("own", own)
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(ours, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    live = pairs.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("block"), side.alias("side"), "digest", "component")
    return links.unionAll(linked(live))


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_shingles (size of its set), component_id (the least id that links reach, its own included) for every row; options: see ngram_links().

    Rows whose texts are equal up to the case of A-Z link, if they have words; those without have
    their own id.  Repeated rows have the same result; null ids count as none, and are the component_id only where links reach no other.
    """
    with scratch(docs.sparkSession):
        texts, links = ngram_links(docs, id_col=id_col, text_col=text_col, **options)
        components = connected_components(links).withColumnRenamed("node", "digest")
        told = written(texts.join(components, "digest", "left").withColumn("component", F.coalesce("component", "digest")), "told")
        least = told.groupBy("component").agg(F.min("id").alias("least"))
        told = written(told.join(least, "component").select("digest", "n", "least"), "joined", keep=True)
    named = docs.select(F.col(id_col), F.unhex(F.md5(F.encode(lowered(text_col), "UTF-8"))).alias("digest"))
    out = named.join(told, "digest", "left")
    return out.select(id_col, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col(id_col).cast("long")).alias("component_id"))
