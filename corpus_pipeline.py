"""The corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next stage's docs.
All but the last return the columns of documents.  A stage drops documents whole: those with a toxicity score of 0.3 or more; all but
the largest id of equal texts (A-Z lower-cased); all but the least id of each class of texts linked by a Jaccard
similarity of 0.8 or more on five-word shingles; those with a benchmark window of ten words.  What is left is packed into
sequences of at most 4096 tokens.

Empty tables pass through every stage; each operator's docstring says what it does with nulls, empty texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askwright.llm.common import scratch, table
from askwright.llm.decontaminate import drop_contaminated
from askwright.llm.exact_dedup import drop_exact_duplicates
from askwright.llm.near_dup import drop_near_duplicates
from askwright.llm.packing import default_tokenizer, pack
from askwright.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained model, MinHash and a packing search are not SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
