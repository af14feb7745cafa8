"""From raw documents to a sharded training corpus, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; run()
writes it as Parquet to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.decontamination import without_benchmark
from concord.llm.mixing import mixed_documents
from concord.llm.near_dedup import first_of_class
from concord.llm.quality import good_documents
from concord.llm.sharding import shard_uniformly
from concord.llm.shared import forget, scratch, stored

#: Documents below this score go.
QUALITY = 0.3
SHARDS = 24


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text scores below QUALITY."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return good_documents(docs, labels, threshold=QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return first_of_class(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target weights."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add shard and slot: a uniform shuffle into SHARDS shards of equal size."""
    key = F.struct("doc_id", F.xxhash64("text"), "source")
    return shard_uniformly(docs, n_shards=SHARDS, key=key)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("sharding", sharding),
]

#: SQL can express neither the classifier nor consistent weighted sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is written on the way is deleted as soon as the next stage is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            forget(spark, before)
        before = path
    return docs
