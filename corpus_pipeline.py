"""The corpus pipeline: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontaminate, repeats, simhash, toxicity
from palimpsest.llm.common import free_name, new_path, prepare, table
from palimpsest.llm.words import row_key
from palimpsest.scratch import drop_since, made


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of at least 0.7. The classifier learns from the labelled rows of docs."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return toxicity.score(docs, model).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near-duplicates one row, with its smallest doc_id; one with a null id only where the component has no other. Rows of different components all stay, whatever ids they share."""
    prepare(spark)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k"))
    kept = simhash.grouped(docs).groupBy("label").agg(first.alias("x")).select("x.k")
    key = free_name(docs, "k")
    docs = docs.withColumn(key, row_key())
    # rows that are left with one key are equal in id and text
    return docs.join(kept.withColumnRenamed("k", key), key, "left_semi").dropDuplicates([key]).drop(key)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of repeats.SHORT bytes (some 50 words) that occur again out of all texts and sets n_chars anew; every document stays."""
    out = repeats.remove_repeats(docs, repeats.SHORT)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(out.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in out.columns else out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    return bpe.round_trip(docs, *bpe.multi_50k())


STAGES = [
    ("toxicity", keep_clean),
    ("simhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", decontaminated),
    ("byte_level_bpe", encoded),
]

#: SQL can express neither the classifier nor the byte-wise cuts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is a table in the shared folder that the next one reads. What a stage wrote besides goes when its result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path, mark = new_path(spark, f"pipeline-{name}"), made()
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_since(spark, mark)
        docs = spark.read.parquet(path)
    return docs
