"""A corpus pipeline: toxicity, near duplicates, repeated passages, secrets, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents, and each works on all that its predecessor kept:

- toxicity drops documents whose calibrated score is 0.5 or more;
- near_duplicates keeps the smallest doc_id of each component of the n-gram Jaccard join (one row of it);
- repeated_passages removes words in windows that an earlier document has, and drops documents that lose every word;
- secrets masks every span that the ownership scan reports;
- packing lays out the token ids of what is left.

Cases: null text counts as empty and passes through as null until words are removed from it (none are); empty tables stay
empty; repeated rows are near duplicates of each other; of equally good documents the smallest doc_id stays; very long texts
go through every stage whole; extra columns are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import jaccard, pack, secrets, substrings, toxicity
from tidemark.llm.shared import discard, small_batches, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    with small_batches(spark):  # whole texts wait for their features, so few are handed over at once
        return written(model.kept(docs.select(*COLUMNS)), "calm")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.join_documents(docs)
    rest = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "near-duplicates")
    return one_row_each(docs.select(*COLUMNS).join(rest, docs.doc_id == rest.gone, "left_anti"))


def one_row_each(docs: DataFrame) -> DataFrame:
    """Of rows with one doc_id the first by its other columns; rows without doc_id all stay. Texts move only if ids do repeat."""
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return docs
    first = W.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars")
    several = docs.join(again, "doc_id", "left_semi").withColumn("_row", F.row_number().over(first)).where("_row = 1")
    return docs.join(again, "doc_id", "left_anti").select(*COLUMNS).union(several.select(*COLUMNS))


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = substrings.stripped(docs.withColumn("no_text", F.col("text").isNull()), True, "no_text", "lang", "source", "n_chars")
    text = F.when(~F.col("no_text"), F.col("kept"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return rows.where("n_removed = 0 OR n_removed < n_words").select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL has no trained trees or tokenizers; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spent = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spent)
        spent = docs
    return STAGES[-1][1](spark, docs, sf_dir)
