"""A pipeline over documents, from raw rows to packed sequences.

Each stage works on all that the one before kept, and its result is written and read again. A row
without a doc_id can't be told from others and is left out by the stages that decide by id. Of rows that
repeat a doc_id one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, stored
from loomgraph.llm.exact import exact_groups
from loomgraph.llm.packing import pack_pieces
from loomgraph.llm.pii import sanitised
from loomgraph.llm.quality import fit_quality, keep_quality, training_labels
from loomgraph.llm.simhash import near_duplicates
from loomgraph.shared import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score of being good is 0.3 or more; learned from the labels of four fifths of the ids."""
    vectors, network = fit_quality(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return keep_quality(docs, vectors, network)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without blanks, the longest original with the smallest id. Rows that repeat an id count as one, that of the longest text."""
    n, text = F.coalesce(F.length("text"), F.lit(0)), F.coalesce("text", F.lit(""))
    longest = F.max_by(F.struct(*docs.columns), F.struct(n, F.sha2(F.encode(text, "UTF-8"), 256), F.xxhash64(*docs.columns)))
    named = docs.where("doc_id is not null")
    repeated = stored(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    one = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(longest.alias("row")).select("row.*")
    single = named.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one)
    with scratch(spark):
        gone = stored(exact_groups(single).where("not kept").select("doc_id"), "gone", keep=True)
    return single.join(gone, "doc_id", "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group joined by similarities of 0.8 or more of five-word shingles."""
    with scratch(spark):
        gone = stored(near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct(), "gone", keep=True)
    return docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced in their texts."""
    clean = sanitised(docs, carry=[c for c in docs.columns if c != "text"])
    return clean.select("text", "carried.*").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2048 ids along the curve, a row for each piece of a document, with its ids."""
    return pack_pieces(docs, with_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: SQL has neither the classifier nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
    return docs
