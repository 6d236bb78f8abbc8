"""Corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; what it returns is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, further ones of any name
included; columns that a stage needs for itself get names that are free. Null and empty texts are clean everywhere and stay
(as groups of their own rows). Empty tables pass through. Rows that share an id but not a text are rows of their own: each is
scored, searched and masked for itself, and near copies among them are one group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, packing, secrets, set_join, textkit, toxicity

#: Near-duplicate stages take runs of five words and a similarity of 0.8.
NEAR_GRAM, NEAR_PERCENT = 5, 80
NO_ID = -(1 << 63)


def free_name(docs: DataFrame, name: str) -> str:
    """name, made longer until no column of docs bears it."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below the threshold of their language; the classifier is fitted to labelled rows of the input."""
    model = toxicity.learn(docs, textkit.table(spark, sf_dir, "labels"))
    name = free_name(docs, "_toxicity")
    scored = toxicity.with_scores(docs, model, name)
    return scored.filter(F.col(name) < toxicity.threshold(model, F.col("lang"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one with the smallest id; of a repeated row, one. Of a group of rows without an id one stays too."""
    joined = set_join.keyed_join(docs, NEAR_GRAM, NEAR_PERCENT)
    # A null id counts as the key NO_ID with a hash of the text, so that the join and the removal of repeated rows share one exchange by key.
    name, part, text = free_name(docs, "_key"), free_name(docs, "_part"), free_name(docs, "_text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(name)
    of = lambda x: F.when(F.col("doc_id").isNull(), x).otherwise(F.lit(0)).cast("long").alias(part)
    first = F.col("doc_id").isNotNull() | F.coalesce(F.col("key") == F.col("lead_key"), F.lit(True))
    kept = joined.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & first).select(key, of(F.col("key"))).distinct()
    keyed = docs.select("*", key, of(F.xxhash64("text")), F.xxhash64("text").alias(text))
    one = keyed.join(kept.hint("merge"), [name, part], "left_semi").dropDuplicates([name, part, text])
    return one.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.clean(docs, textkit.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; each secret's characters give way to a mark, and n_chars follows the text."""
    return secrets.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of what is left."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("secrets", mask_secrets), ("packing", pack)]

#: A trained classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows go through Parquet in the folder of spark.checkpoint.dir. A stage's folder goes once the next one's is written; the last stays, since the result may read it."""
    docs = textkit.table(spark, sf_dir, "documents")
    folder = f"{textkit.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if i:
                removed(spark, f"{folder}/{STAGES[i - 1][0]}")
    return docs
