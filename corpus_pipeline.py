"""A training corpus in four steps: toxic documents go, one document of each
group of near copies stays, personal data is masked, the rest is packed.

Every stage is ``f(spark, docs, sf_dir) -> DataFrame``; its rows are written as
Parquet and read again as the next one's ``docs``. All stages but the last
return the columns of ``documents``. Edge cases: null texts are kept as empty
ones (clean, alone, unmasked, one end token); the second stage judges every row
by its own text: of a group of near copies the row with the smallest doc_id
stays (one without an id only where no row of the group has one), rows that
repeat an id with texts of their own all stay; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.llm import ngram_join, packing, pii, toxicity
from admitflow.llm.common import Scratch
from admitflow.llm.encoding import tokenizer_path
from admitflow.session import ship_package

# Fixed values of this corpus: shingle words, similarity, window and end id.
SHINGLE, SIMILAR, OF = 5, 80, 100
WINDOW, END_ID = 1024, 0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier predicts to be toxic."""
    ship_package(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "pipeline-labels"))
    scored = toxicity.score(docs, model, out=("_score", "_predicted"))
    return scored.where("_predicted = 0").drop("_score", "_predicted")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 and more) the
    document with the smallest doc_id."""
    ship_package(spark)
    return ngram_join.first_of_groups(docs, Scratch(spark, "pipeline-groups"), SHINGLE, SIMILAR, OF)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed spans of personal data replaced by their kinds."""
    masked = pii.redact_pii(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows."""
    ship_package(spark)
    return packing.pack(docs, Scratch(spark, "pipeline-packs"), tokenizer_path("byte_bpe_50k.json"), END_ID, WINDOW)


STAGES = [("toxicity", drop_toxic), ("ngram_join", keep_one_of_each_group), ("pii", mask_personal_data),
          ("packing", pack_documents)]

ORACLE_SQL = None  # a learned classifier and a tokenizer are no SQL; tests/llm compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
