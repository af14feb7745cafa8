"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .components import connected_components
from .hashing import FIXED, mix64, words_of
from .shared import few, nested, rows_for, scratch, written

_SLOT_BITS = 14
_SLOTS = 1 << _SLOT_BITS
_TEXT = "chunk long, digest binary, id long, n long, size long, keys array<long>, samples binary, codes binary"
_NO_ID = -(1 << 63)


def shingles(column, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order of hash: text number, hash, and how often; a text of fewer than `size` words has its words as one shingle."""
    words = words_of(column)
    single = words.hashes()
    h = mix64(FIXED.windows(single, size))
    at = np.flatnonzero(words.left()[: len(h)] >= size)
    per = np.diff(words.first)
    counts = np.where(per >= size, per - size + 1, per > 0)
    cuts = np.concatenate(([0], np.cumsum(counts)))
    hashes = np.empty(cuts[-1], dtype=np.uint64)
    hashes[np.repeat(per >= size, counts)] = h[at]
    short = np.flatnonzero((per > 0) & (per < size))
    if len(short):
        whole = [FIXED.windows(single[a:b], b - a)[0] ^ np.uint64((b - a) % 8 << 61) for a, b in zip(words.first[short].tolist(), words.first[short + 1].tolist(), strict=True)]
        hashes[cuts[short]] = mix64(np.array(whole, dtype=np.uint64))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        hashes[a:b].sort()
    doc = np.repeat(np.arange(len(per)), counts)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def variates(hashes_per_text: int, seed: int) -> list[tuple[np.ndarray, ...]]:
    """For each sample: r, 1 / r, beta and ln c - r of every slot of shingles; r, c ~ Gamma(2, 1), beta uniform."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(hashes_per_text):
        r, c, beta = rng.gamma(2, 1, _SLOTS), rng.gamma(2, 1, _SLOTS), rng.random(_SLOTS)
        r = np.maximum(r, 1e-3)
        out.append(tuple(x.astype(np.float32) for x in (r, 1 / r, beta, np.log(c) - r)))
    return out


def weighted_samples(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int, tables: list) -> np.ndarray:
    """Improved consistent weighted sampling: n rows of one 32-bit sample for each table.

    Two texts agree in a sample with the probability of their weighted Jaccard
    similarity.  With t = floor(ln w / r + beta), the shingle of least
    ln c - r (t - beta) - r is sampled, together with its t.
    """
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.zeros((n, len(tables)), dtype=np.uint32)
    log_w = np.log(weight).astype(np.float32)
    counts = np.diff(np.append(first, len(doc)))
    for i, (r, inverse_r, beta, c) in enumerate(tables):
        slot = ((hashes * np.uint64(2 * i + 0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)
        b = beta[slot]
        t = np.floor(log_w * inverse_r[slot] + b)
        key = c[slot] - r[slot] * (t - b)
        least = np.flatnonzero(key == np.repeat(np.minimum.reduceat(key, first), counts))
        least = least[np.diff(doc[least], prepend=-1) > 0]  # the first, as shingles are sorted by hash
        out[doc[least], i] = (mix64(hashes[least] ^ mix64(t[least].astype(np.int64).astype(np.uint64) + np.uint64(i + 1))) >> np.uint64(32)).astype(np.uint32)
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least over sum of largest weights; each side: sorted shingles and their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(a[1].sum() + b[1].sum() - both, 1e-12))


def classed_texts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    threshold: float = 0.8,
    bands: int = 10,
    rows: int = 3,
    idf_share: float = 0.25,
    chunk_bytes: int = 3 << 20,
    bucket_keys: int = 1_000_000,
    block: int = 400,
    block_shingles: int = 4_000_000,
    part_bytes: int = 8 << 20,
    seed: int = 7,
) -> DataFrame:
    """For every distinct text: digest (MD5), first (id and digest of its class's first row), class_size (rows).

    A text is a weighted set of shingles of shingle_words words: how often the shingle
    occurs in it times 1 + idf_share * ln(1 + N / df) / ln(1 + N), df counted over all
    documents (in chunks and buckets, see exchange.py; stored to an eighth of a power
    of two; shingles of a bucket that agree in 32 bits, one in some thousands, share a count).
    Rarity gets a share of the weight only: under plain TF-IDF the few shingles that an edit
    makes unique would outweigh all those that many copies share, and copies of a text that
    is copied thousands of times would fall apart.  Texts are linked if their weighted Jaccard similarity, computed from the
    sets, is at least threshold.  Classes are connected components of links and of equal texts.

    Equal texts are one node throughout.  Candidates share a band of `rows` of
    bands * rows consistent weighted samples: a pair at 0.8 is missed by
    all bands with probability 0.0008.  Buckets of two are pairs, verified at once, as are the
    pairs of each text of large buckets with one text that heads them.  All other
    buckets that hold more than one component by then go, with their texts' sets, to one
    task each: there every pair of texts of different components that may be
    a link by the samples' estimate is verified from the sets, and texts that are linked become
    one component, so that a group of alike texts takes few comparisons.  Only links leave the task.
    Buckets of over `block` texts or block_shingles shingles are dealt, at any size, as all
    pairs of bounded parts, save those inside the one component that holds most of the bucket's
    texts: sharing a bucket is enough to be compared.  A pair is compared in the first band it shares.

    Null and empty texts have no shingles and are like equal texts only.  Texts of fewer than
    shingle_words words are one shingle.  Null ids count as the least id.
    Repeated rows are equal texts.  An empty table has no classes.
    """
    with scratch(docs.sparkSession):
        return _classed(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, threshold=threshold, bands=bands, rows=rows, idf_share=idf_share, chunk_bytes=chunk_bytes, bucket_keys=bucket_keys, block=block, block_shingles=block_shingles, part_bytes=part_bytes, seed=seed)


def _classed(docs: DataFrame, *, id_col, text_col, shingle_words, threshold, bands, rows, idf_share, chunk_bytes, bucket_keys, block, block_shingles, part_bytes, seed) -> DataFrame:
    chunks, plan = X.in_chunks(docs, id_col, text_col, chunk_bytes=chunk_bytes, keys_per_byte=1 / 6, bucket_keys=bucket_keys)
    chunks = chunks.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    n_docs, n_buckets = plan.rows, plan.n_buckets
    by_chunk = lambda df: X.by_chunk(df, plan)
    log_n = math.log1p(max(n_docs, 1))

    def ask(key, table):
        doc, hashes, _ = shingles(table.column("text"), shingle_words)
        keys, inverse = np.unique(X.routed(hashes, n_buckets), return_inverse=True)
        times = np.bincount(inverse, table.column("copies").to_numpy()[doc], len(keys))
        return X.messages(key[0].as_py(), keys, times.astype("<u8"))

    def count(key, table):
        keys, ends, facts = X.bucket_keys(table)
        _, inverse = np.unique(keys, return_inverse=True)
        df = np.bincount(inverse, np.frombuffer(b"".join(facts), "<u8"))
        return X.replies(table, np.minimum(np.round(8 * np.log2(np.maximum(df, 1))), 255).astype(np.uint8)[inverse], ends, 1)

    factor = (1 + idf_share * np.log1p(n_docs / 2.0 ** (np.arange(256) / 8)) / log_n).astype(np.float32)  # of each answer

    def weighed(column, answers):
        """Distinct shingles of a chunk's distinct texts, their weights, and what was answered about the chunk's keys; answers: gives it for the keys."""
        doc, hashes, tf = shingles(column, shingle_words)
        keys, inverse = np.unique(X.routed(hashes, n_buckets), return_inverse=True)
        codes = answers(keys)
        return doc, hashes, (tf * factor[codes[inverse]]).astype(np.float32), codes

    def digests_of(column):
        return [hashlib.md5(t.encode()).digest() for t in column.to_pylist()]

    def distinct_texts(table):
        """A chunk's distinct texts, the least id and number of rows of each."""
        own: dict[bytes, int] = {}
        least, times = [], []
        for i, (d, x, n) in enumerate(zip(digests_of(table.column("text")), table.column("id").to_pylist(), table.column("copies").to_pylist(), strict=True)):
            j = own.setdefault(d, len(own))
            if j == len(least):
                least.append((i, x))
                times.append(n)
            else:
                times[j] += n
                if x < least[j][1]:
                    least[j] = (least[j][0], x)
        return list(own), least, times

    tables: list = []  # drawn once a task

    def sign(key, table, right):
        digests, least, times = distinct_texts(table)
        column = table.column("text").take(pa.array([i for i, _ in least], pa.int64()))
        doc, hashes, weight, codes = weighed(column, lambda keys: X.answered(keys, right, 1, np.uint8))
        if not tables:
            tables.extend(variates(bands * rows, seed))
        some = np.zeros(len(digests), dtype=bool)
        some[doc] = True
        samples = weighted_samples(doc, hashes, weight, len(digests), tables) if len(doc) else np.zeros((len(digests), bands * rows), np.uint32)
        keys = np.zeros((len(digests), bands), dtype=np.uint64)
        for b in range(bands):
            h = np.full(len(digests), b + 1, dtype=np.uint64)
            for i in range(b * rows, (b + 1) * rows):
                h = mix64(h ^ samples[:, i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            keys[:, b] = h
        signed = keys.view(np.int64)
        # and one row more, with the answers: the sets of candidates are weighed by them later
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * (len(digests) + 1), pa.int64()),
            "digest": pa.array([*digests, None], pa.binary()),
            "id": pa.array([*(x for _, x in least), None], pa.int64()),
            "n": pa.array([*times, None], pa.int64()),
            "size": pa.array([*np.bincount(doc, minlength=len(digests)).tolist(), None], pa.int64()),
            "keys": pa.array([*(k.tolist() if s else [] for k, s in zip(signed, some, strict=True)), None], pa.list_(pa.int64())),
            "samples": pa.array([*(x.tobytes() if s else b"" for x, s in zip(samples, some, strict=True)), None], pa.binary()),
            "codes": pa.array([None] * len(digests) + [codes.tobytes()], pa.binary()),
        })

    def sets(key, table, right):
        """Shingles and weights of the chunk's texts that are candidates."""
        wanted = set(right.column("digest").to_pylist())
        digests, least, _ = distinct_texts(table)
        pick = [j for j, d in enumerate(digests) if d in wanted]
        codes = next(c for c in right.column("codes").to_pylist() if c is not None)
        column = table.column("text").take(pa.array([i for i, _ in least], pa.int64()))
        doc, hashes, weight, _ = weighed(column, lambda _: np.frombuffer(codes, np.uint8))
        cuts = np.searchsorted(doc, np.arange(len(digests) + 1)).tolist()
        return pa.table({
            "digest": pa.array([digests[j] for j in pick], pa.binary()),
            "shingles": pa.array([hashes[cuts[j] : cuts[j + 1]].tobytes() for j in pick], pa.binary()),
            "weights": pa.array([weight[cuts[j] : cuts[j + 1]].tobytes() for j in pick], pa.binary()),
        })

    frequencies = by_chunk(chunks).applyInArrow(ask, X.MESSAGE).groupBy("bucket").applyInArrow(count, X.REPLY)
    signed = written(by_chunk(chunks).cogroup(by_chunk(frequencies)).applyInArrow(sign, _TEXT), "signed")
    texts = signed.where(F.col("digest").isNotNull()).groupBy("digest")
    texts = written(texts.agg(F.min("id").alias("id"), F.sum("n").alias("n"), F.min("chunk").alias("chunk"), F.first("size").alias("shingles"), F.first("keys").alias("keys"), F.first("samples").alias("samples")), "texts")

    # buckets with more than one text, and their members
    banded = texts.select("digest", "shingles", "samples", "keys", F.posexplode("keys").alias("band", "key"))
    volume = F.sum("shingles").alias("volume")
    sizes = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), volume, F.min("digest").alias("head"), F.max("digest").alias("tail"), F.bit_xor(F.xxhash64("digest")).alias("content")).where(F.col("size") > 1)
    # bands often hold the same texts together: one bucket of those is enough; buckets of two are pairs at once
    sizes = written(sizes.groupBy("size", "volume", "head", "tail", "content").agg(F.min(F.struct("band", "key")).alias("bucket")), "buckets")
    twos = sizes.where(F.col("size") == 2).select(F.col("head").alias("a"), F.col("tail").alias("b"))
    more = sizes.where(F.col("size") > 2).select(F.col("bucket.band").alias("band"), F.col("bucket.key").alias("key"), "bucket", "size", "volume", "head")
    members = banded.join(few(more, more.count()), ["band", "key"]).select("bucket", "size", "volume", "head", "digest", "shingles", "samples")
    fits = (F.col("size") <= block) & (F.col("volume") <= block_shingles)
    small = members.where(fits).select(F.xxhash64("bucket").alias("block"), F.col("bucket.band").alias("band"), F.lit(-1).alias("side"), "digest", "samples")
    large = members.where(~fits)
    small, large = written(small, "blocks"), written(large, "large")
    # each text of large buckets meets the first of their first texts at once
    stars = large.groupBy("digest").agg(F.min("head").alias("head")).where(F.col("digest") != F.col("head")).select(F.col("head").alias("a"), F.col("digest").alias("b"))
    start = written(twos.unionAll(stars).distinct(), "pairs")
    wanted = small.select("digest").unionAll(large.select("digest")).unionAll(start.select(F.explode(F.array("a", "b")).alias("digest"))).distinct().join(texts.select("digest", "chunk"), "digest")
    told = signed.where(F.col("codes").isNotNull()).select("chunk", "digest", "codes").unionAll(wanted.select("chunk", "digest", F.lit(None).cast("binary").alias("codes")))
    found = written(by_chunk(chunks).cogroup(by_chunk(told)).applyInArrow(sets, "digest binary, shingles binary, weights binary"), "sets")

    def block_links(band, side, component, samples, shingles, weights):
        """Links of a block between texts of different components, until what is linked is one component; of two sides (0, 1; else -1) only across, and only of pairs that share no band before this."""
        n = len(component)
        own: dict[bytes, int] = {}
        group = np.array([own.setdefault(c, len(own)) for c in component])
        x = np.frombuffer(b"".join(samples), np.uint32).reshape(n, -1)
        # a pair at the threshold agrees in fewer samples with a probability under 0.001
        least = max(1, math.floor(x.shape[1] * threshold - 3.2 * math.sqrt(x.shape[1] * threshold * (1 - threshold))))
        cuts = np.cumsum([0, *(len(b) // 8 for b in shingles)])
        known, place = np.unique(np.frombuffer(b"".join(shingles), "<u8"), return_inverse=True)
        weight = np.frombuffer(b"".join(weights), "<f4")
        total = np.add.reduceat(weight, cuts[:-1], dtype=np.float64)
        own_weight = np.zeros(len(known), dtype=np.float32)
        links = []
        side = np.array(side)
        earlier = x[:, : band[0] * rows].reshape(n, band[0], rows)
        for i in range(n - 1):
            agree = (x[i + 1 :] == x[i]).sum(axis=1)
            asks = np.flatnonzero((agree >= least) & (group[i + 1 :] != group[i]) & ((side[i + 1 :] != side[i]) | (side[i] < 0)))
            if band[0]:
                asks = asks[~(earlier[asks + i + 1] == earlier[i]).all(axis=2).any(axis=1)]
            asks = asks[np.argsort(-agree[asks], kind="stable")] + i + 1
            mine = slice(cuts[i], cuts[i + 1])
            own_weight[place[mine]] = weight[mine]
            step = 16
            while len(asks):
                now, asks = asks[:step], asks[step:]
                step = min(2 * step, 256)
                lengths = cuts[now + 1] - cuts[now]
                begin = np.cumsum(lengths) - lengths
                at = np.arange(lengths.sum()) + np.repeat(cuts[now] - begin, lengths)
                both = np.add.reduceat(np.minimum(own_weight[place[at]], weight[at]), begin, dtype=np.float64)
                linked = now[both >= threshold * np.maximum(total[i] + total[now] - both, 1e-12)].tolist()
                links += [(i, j) for j in linked]
                if linked:
                    group[np.isin(group, group[linked])] = group[i]
                    asks = asks[group[asks] != group[i]]
            own_weight[place[mine]] = 0
        return links

    def link(key, table):
        links: set[tuple[bytes, bytes]] = set()
        table = table.sort_by([("block", "ascending"), ("digest", "ascending")])
        cuts = [0, *(np.flatnonzero(np.diff(table.column("block").to_numpy())) + 1).tolist(), len(table)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            digest, *columns = (table.column(c)[a:b].to_pylist() for c in ("digest", "band", "side", "component", "samples", "shingles", "weights"))
            links.update((digest[i], digest[j]) for i, j in block_links(*columns))
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    def verify(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("sa", "wa", "sb", "wb")]
            similar = [weighted_jaccard((np.frombuffer(a, "<u8"), np.frombuffer(w, "<f4")), (np.frombuffer(b, "<u8"), np.frombuffer(v, "<f4"))) for a, w, b, v in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similar, pa.float64())], ["a", "b", "similarity"])

    left = found.select(F.col("digest").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = found.select(F.col("digest").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    checked = written(start.join(left, "a").join(right, "b").select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(verify, "a binary, b binary, similarity double"), "checked")
    links = checked.where(F.col("similarity") >= threshold).select("a", "b")
    components = written(connected_components(links), "components")
    n_nodes = components.count()

    def with_component(df):
        return df.join(few(components.withColumnRenamed("node", "digest"), n_nodes), "digest", "left").withColumn("component", F.coalesce("component", "digest"))

    # blocks that hold more than one component
    state = written(with_component(small), "state")
    open_blocks = state.groupBy("block").agg(F.min("component").alias("c"), F.max("component").alias("d")).where(F.col("c") != F.col("d")).select("block")
    columns = ("block", "band", "side", "digest", "component", "samples")
    # large buckets: parts of the component with most texts, and of the rest; all pairs of parts but those of the former among themselves
    large = written(with_component(large), "large")
    shares = large.groupBy("bucket", "size", "volume", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("v"))
    shares = shares.groupBy("bucket", "size", "volume").agg(F.max(F.struct("n", "component", "v")).alias("main")).where(F.col("main.n") < F.col("size"))
    parts = lambda n, v: F.ceil(F.greatest(n / block, 2 * v / block_shingles)).cast("int")  # noqa: E731  # two parts' shingles are within a block's
    n_large = large.select("bucket").distinct().count()
    shares = shares.select("bucket", F.col("main.component").alias("main"), parts(F.col("size") - F.col("main.n"), F.col("volume") - F.col("main.v")).alias("r"), parts(F.col("main.n"), F.col("main.v")).alias("m"))
    own = F.pmod(F.xxhash64("digest", "bucket"), F.when(F.col("component") == F.col("main"), F.col("m")).otherwise(F.col("r"))).cast("int")
    dealt = large.join(few(shares, n_large), "bucket").withColumn("own", F.when(F.col("component") == F.col("main"), F.col("r")).otherwise(0) + own)
    others = F.sequence(F.lit(0), F.when(F.col("own") < F.col("r"), F.col("r") + F.col("m")).otherwise(F.col("r")) - 1)
    dealt = dealt.withColumn("other", F.explode(others)).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    dealt = dealt.select(F.xxhash64("bucket", "low", "high").alias("block"), F.col("bucket.band").alias("band"), side.alias("side"), "digest", "component", "samples")
    live = written(state.join(open_blocks, "block").select(*columns).unionAll(dealt.select(*columns)), "live")
    size = found.agg(F.coalesce(F.avg(F.octet_length("shingles") + F.octet_length("weights")), F.lit(0))).first()[0]
    n_parts = max(256, math.ceil(live.count() * (size + 200) / part_bytes))
    dealt = live.join(found, "digest").select(F.pmod("block", F.lit(n_parts)).alias("part"), "block", "band", "side", "digest", "component", "samples", "shingles", "weights")
    new = written(dealt.groupBy("part").applyInArrow(link, "a binary, b binary").distinct(), "links")
    joins = new.count()
    if joins:
        # components of components: only what the new links join
        of = few(components.withColumnRenamed("component", "c"), components.count())
        ends = new.join(of.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b", "left")
        ends = written(rows_for(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), joins), "ends")
        merged = written(rows_for(connected_components(ends, a="ca", b="cb"), 2 * joins), "merged")
        nodes = components.unionAll(ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("component")), F.struct(F.col("b").alias("node"), F.col("cb").alias("component")))).alias("x")).select("x.*")).distinct()
        components = written(nodes.join(few(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), 2 * joins), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
    classed = texts.select("digest", "id", "n").join(components.withColumnRenamed("node", "digest"), "digest", "left")
    classed = classed.withColumn("component", F.coalesce("component", "digest"))
    whole = written(classed.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("first"), F.sum("n").alias("class_size")), "classes")
    return written(classed.join(whole, "component").select("digest", "first", "class_size"), "classed", keep=True)


def _digest(text_col: str):
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, class_id (least id of its class), class_size (rows) for every row; options: see classed_texts."""
    classed = classed_texts(docs, id_col=id_col, text_col=text_col, **options)
    named = docs.select(F.col(id_col), _digest(text_col).alias("digest"))
    return named.join(classed, "digest", "left").select(id_col, F.nullif("first.id", F.lit(_NO_ID)).alias("class_id"), "class_size")


def first_of_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """Keep one row of each class: the least id, of equal ids the least digest of the text, of equal rows one. Columns stay as they are.

    Texts stay where they are if the list of what goes has at most broadcast_rows rows of some 40 bytes: it is broadcast then.
    """
    classed = classed_texts(docs, id_col=id_col, text_col=text_col, **options)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), _digest(text_col).alias("digest"))
    own = own.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("times"))
    stays = (F.col("first.id") == F.col("id")) & (F.col("first.digest") == F.col("digest"))
    told = written(own.join(classed, "digest").select("id", "digest", "times", stays.alias("stays")), "told")
    named = nested(docs, id=F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), digest=_digest(text_col))
    gone = told.where(~F.col("stays")).select("id", "digest")
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    kept = named.join(gone, ["id", "digest"], "left_anti")
    many = told.where(F.col("stays") & (F.col("times") > 1)).select("id", "digest")
    n_many = many.count()
    if n_many:
        # equal in id and text: combined within tasks before they are shuffled, so no task gets all of them
        many = few(many, n_many)
        one = kept.join(many, ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = kept.join(many, ["id", "digest"], "left_anti").select("row").unionAll(one.select("row"))
    return kept.select("row.*")
