"""From documents to packed training bins: quality, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specgraph.llm import minhash, mixing, packing, pii, quality
from specgraph.llm.common import IdFilter, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A null or empty text is scored like any other, as one without words; rows that repeat are scored each; a null doc_id has no label but a score. An empty
    table gives an empty one. Columns other than those of documents are left out.
    """
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), 0.7)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and one row of each document; rows with a null doc_id stay.

    Only rows whose id is dropped or comes twice are shuffled, and the few that a fixed-size filter takes for one. Documents without words are in no group
    and stay; of rows that share an id the first by text, source, lang and n_chars stays. An empty table gives an empty one.
    """
    found = written(minhash.near_duplicates(docs, 5, 80).where("doc_id is not null"), "duplicates")
    rows = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    maybe, others = IdFilter(rows.select(F.col("doc_id").alias("id"))).split(docs.select(*COLUMNS), "doc_id")
    maybe = maybe.join(rows.withColumnRenamed("n", "__n").withColumnRenamed("kept", "__kept"), "doc_id", "left").where("coalesce(__kept, true)")
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("text", "source", "lang", "n_chars"))
    twice = maybe.where("__n > 1").withColumn("__first", first).where("__first = 1")
    return others.select(*COLUMNS).union(maybe.where("__n is null or __n = 1").select(*COLUMNS)).union(twice.select(*COLUMNS))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars counted anew.

    A null text stays null (n_chars null), an empty one empty; repeated rows are redacted each; an empty table gives an empty one.
    """
    found = pii.with_spans(docs.select(*COLUMNS)).withColumn("text", pii.redact(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three times, or not at all.

    Documents without words are never taken. A null source is a source; rows with a null doc_id are told apart by their texts. An empty table gives an empty one.
    """
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("__key")
    docs = docs.select(*COLUMNS, key)
    taken = mixing.mix(docs, keep=("__key",)).where("taken > 0").select("__key", "size", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    taken = taken.groupBy("__key", "size").agg(F.sort_array(F.collect_list("times")).alias("times"))
    taken = taken.groupBy("__key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("size", "times"))), lambda x: x["times"])).alias("times"))
    held = docs.join(taken, "__key")
    # Rows that share an id share its repetitions in the order of their texts; nearly always there is one.
    nth = F.when(F.size("times") == 1, F.lit(1)).otherwise(F.row_number().over(W.partitionBy("__key").orderBy("n_chars", "text")))
    held = held.withColumn("times", F.try_element_at("times", nth))
    return held.where("times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 2048 words; copies of one document lie in different bins.

    A document without words is a piece of 0 words; longer ones than a bin are cut, whole; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [("quality", good), ("near_duplicates", unique), ("personal_data", redacted), ("mixing", mixed), ("packing", packed)]

#: No stage but the last two has a fair SQL form; tests/llm/test_plain_versions.py holds run() to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
