"""The corpus pipeline: quality rules, near duplicates, personal data, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import op2_packing, op3_mixing, op4_jaccard, op8_pii, op9_rules
from larder.llm.queries import tokenizer_path
from larder.llm.storage import delete_at_end, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep; null and empty texts go, repeated rows are judged each."""
    return op9_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, the first in the table; rows are told apart by their place, so ids may repeat or be null.

    Texts without words link with nothing and stay. docs gives its rows in one order each time, as a table
    read from files does. Further columns stay, whatever their names; empty in, empty out.
    """
    place = "__place"
    while place in {c.lower() for c in docs.columns}:
        place += "_"
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    found = op4_jaccard.near_duplicates(placed, key=place).where("doc_id = component_id").select(F.col("doc_id").alias(place))
    return placed.join(found, place, "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null and empty texts and further columns stay as they are, repeated rows are cleaned each; empty in, empty out."""
    return op8_pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows of one id, or without one, are taken each by themselves; null texts have size 0."""
    return op3_mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens; null and empty texts are one end token."""
    return op2_packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Expectation-maximisation, the tagger and the linear program aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents, each stage's result written and read again."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            delete_at_end(spark, f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
    return docs
