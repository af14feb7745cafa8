"""Quality classifier: nearest-neighbour voting in a latent semantic space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .hashing import SEPARATOR, text_bytes, words_of
from .shared import nested

TERMS = 4096
_STEPS = 8
_SHARES = 6
_LENGTHS = 16
DIMS = TERMS + _SHARES * _STEPS + _LENGTHS
_ROWS = 128  # documents whose counts are dense at a time


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Rows whose crc32(id as text) is divisible by folds: never learnt from. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(folds)) == 0, F.lit(False))


def term_counts(column, with_shape: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed byte trigrams, and shape terms (one-hot steps of shares and of the length), a row for each text."""
    data, offs = text_bytes(column)
    n, size = len(offs) - 1, np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    counts = np.zeros((n, TERMS))
    if len(data) > 2:
        wide = data.astype(np.uint32)
        code = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(2654435761) >> np.uint32(20)
        inside = doc[2:] == doc[:-2]
        counts = np.bincount((doc[:-2] * TERMS + code)[inside], minlength=n * TERMS).reshape(n, TERMS)
    if not with_shape:
        return counts, np.zeros((n, 0))
    share = lambda mask: np.bincount(doc[mask], minlength=n) / np.maximum(size, 1)
    upper, space, digit = (data >= 65) & (data <= 90), SEPARATOR[data], (data >= 48) & (data <= 57)
    symbol = (data > 32) & (data < 127) & ~((data >= 97) & (data <= 122)) & ~upper & ~digit
    variety = np.count_nonzero(counts, axis=1) / np.sqrt(np.maximum(size, 1)) / 16
    words = words_of(column)
    h = words.hashes()
    again = np.flatnonzero((h[1:] == h[:-1]) & (words.positions()[1:] > 0)) + 1
    repeats = np.bincount(np.searchsorted(words.first, again, "right") - 1, minlength=n) / np.maximum(np.diff(words.first), 1)
    shape = np.zeros((n, DIMS - TERMS))
    for i, x in enumerate((share(upper) * 4, share(space) * 3, share(digit) * 4, share(symbol) * 3, variety, repeats * 4)):
        shape[np.arange(n), i * _STEPS + np.minimum((x * _STEPS).astype(int), _STEPS - 1)] = 1
    shape[np.arange(n), _SHARES * _STEPS + np.minimum(np.log2(size + 1).astype(int), _LENGTHS - 1)] = 1
    return counts, shape


def vectors(counts: np.ndarray, shape: np.ndarray, idf: np.ndarray, shape_weight: float) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32)
    x *= idf.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return np.hstack([x, (shape * shape_weight).astype(np.float32)])


class Learnt:
    """Features of labelled texts as packed rows; blocks of dense vectors are made when they are used, so few are in memory."""

    def __init__(self, rows: list, idf: np.ndarray, shape_weight: float):
        self.rows, self.idf, self.shape_weight = rows, idf, shape_weight

    def blocks(self):
        for a in range(0, len(self.rows), _ROWS):
            part = self.rows[a : a + _ROWS]
            counts, shape = np.zeros((len(part), TERMS), dtype=np.float32), np.zeros((len(part), DIMS - TERMS), dtype=np.float32)
            for i, r in enumerate(part):
                counts[i, np.frombuffer(r["terms"], "<u2")] = np.frombuffer(r["tf"], "<f4")
                shape[i, np.frombuffer(r["marks"], "<u2")] = 1
            yield vectors(counts, shape, self.idf, self.shape_weight)

    def times(self, basis: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ basis for x in self.blocks()])


def latent_space(x: Learnt, rank: int, seed: int = 5, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of x as columns, by subspace iteration."""
    rank = max(1, min(rank, len(x.rows), DIMS))
    basis = np.random.default_rng(seed).standard_normal((DIMS, min(rank + 16, DIMS))).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(sum(b.T @ (b @ basis) for b in x.blocks()))
    _, _, v = np.linalg.svd(x.times(basis), full_matrices=False)
    return (basis @ v.T)[:, :rank].astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def votes(x: np.ndarray, known: np.ndarray, labels: np.ndarray, k: int, sharpness: float) -> np.ndarray:
    """Share of label 1 among the k labelled vectors of highest cosine, weighted by cosine ** sharpness."""
    cosine = x @ known.T
    k = min(k, len(labels))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** sharpness
    return np.clip((weight * labels[near]).sum(1) / weight.sum(1), 0, 1)


def scored_rows(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    keep: list[str] | None = None,
    per_label: int = 2000,
    rank: int = 64,
    k: int = 15,
    sharpness: float = 24.0,
    shape_weight: float = 0.6,
    folds: int = 5,
) -> DataFrame:
    """row (the columns keep of docs, all by default, as one struct) and score (double, 0 to 1, higher: label 1 likelier) for every row.

    Terms are hashed byte trigrams of the whole text (TF-IDF; document frequencies
    count all documents) and its shape: steps of its length, of shares of capitals,
    white space, digits and symbols, of words that repeat the word before, and of the
    variety of its trigrams.  The
    labelled sample, at most per_label rows of each label by order of hashed id and
    only from rows that are not held out, spans a latent space of `rank` dimensions
    (truncated SVD) and is broadcast in it: at most 2 * per_label * rank floats.
    Every document is projected, compared with all labelled vectors by exact cosine
    products in blocks, and its k nearest vote, weighted by cosine ** sharpness.
    Nothing but the text enters a score, and no text is shuffled.

    Null and empty texts have the shape of an empty text and a score like any other.
    Without usable labels every score is 0.5.  Labels other than 0 and 1 or of null
    ids are ignored; an id with both labels counts for both, and of rows that repeat a
    labelled id one text is learnt from.  Rows that repeat an id are scored one by one.  Extra columns may have any names.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    fine = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"), folds)).distinct()
    sample = [r for y in (0, 1) for r in fine.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_label).collect()]

    def frequencies(batches):
        df = np.zeros(TERMS, dtype=np.int64)
        n = 0
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                counts, _ = term_counts(batch.column("_text").slice(a, _ROWS), with_shape=False)
                df += np.count_nonzero(counts, axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_pydict({"term": np.arange(TERMS + 1, dtype=np.int32), "df": np.append(df, n)})

    def features(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                cut = batch.slice(a, _ROWS)
                counts, shape = term_counts(cut.column("_text"))
                packed = [(np.flatnonzero(c).astype("<u2").tobytes(), c[c > 0].astype("<f4").tobytes(), np.flatnonzero(s).astype("<u2").tobytes()) for c, s in zip(counts, shape, strict=True)]
                terms, tf, marks = zip(*packed, strict=True)
                yield pa.RecordBatch.from_pydict({"y": cut.column("_y").cast(pa.int32()), "terms": pa.array(terms, pa.binary()), "tf": pa.array(tf, pa.binary()), "marks": pa.array(marks, pa.binary())})

    model = None
    if sample:
        table = {r["term"]: r["df"] for r in slim.select("_text").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # TERMS + 1 rows
        df = np.array([table.get(t, 0) for t in range(TERMS)])
        idf = np.log((1 + table.get(TERMS, 0)) / (1 + df)) + 1
        ids = spark.createDataFrame([(r["_id"], r["_y"]) for r in sample], "_id long, _y int")
        # one text for each id and label, that of least hash: at most 2 * per_label rows, however often an id repeats
        texts = slim.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
        learnt = texts.select("_text", "_y").mapInArrow(features, "y int, terms binary, tf binary, marks binary").collect()
        if learnt:
            learnt.sort(key=lambda r: (r["terms"], r["tf"], r["marks"], r["y"]))  # rows come in any order; scores must not
            x = Learnt(learnt, idf, shape_weight)
            space = latent_space(x, rank)
            model = spark.sparkContext.broadcast((idf, space, unit(x.times(space)), np.array([r["y"] for r in learnt], dtype=np.float32)))

    def score(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                cut = batch.slice(a, _ROWS)
                if model is None:
                    s = np.full(cut.num_rows, 0.5)
                else:
                    idf, space, known, y = model.value
                    s = votes(unit(vectors(*term_counts(cut.column("_text")), idf, shape_weight) @ space), known, y, k, sharpness).astype(np.float64)
                yield pa.RecordBatch.from_arrays([cut.column("row"), pa.array(s)], ["row", "score"])

    whole = nested(docs, keep, _text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return whole.mapInArrow(score, StructType([whole.schema["row"], StructField("score", DoubleType())]))


def with_quality(docs: DataFrame, labels: DataFrame, *, score_col: str = "score", **options) -> DataFrame:
    """docs with score_col, in place of a column of that name; options: see scored_rows."""
    kept = [f"row.`{c}`" for c in docs.columns if c != score_col]
    return scored_rows(docs, labels, **options).select(*kept, F.col("score").alias(score_col))


def good_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs that score at least threshold, with the columns of docs and no others; options: see scored_rows."""
    return scored_rows(docs, labels, **options).where(F.col("score") >= threshold).select("row.*")


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", threshold: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """id, held_out, score, predicted (1 if score >= threshold) for every row; options: see scored_rows."""
    scored = scored_rows(docs, labels, id_col=id_col, folds=folds, keep=[id_col], **options).select(F.col(f"row.`{id_col}`"), "score")
    return scored.select(id_col, held_out(F.col(id_col), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
