"""From raw documents to token files: the stages, each run on the written result of the one before.

Null and empty texts have no words and go with the first stage.  Rows that repeat a doc_id share each stage's verdict; a null doc_id is never a copy or a leak of another.
An empty table of documents, labels or test items gives what the stage gives without them: no row, no rejection, no leak."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontam, mixing, neardup, quality, tokens
from pagewright.llm.common import materialize
from pagewright.llm.queries import END_ID, tokenizer_path


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling; rejected documents go, texts without words among them. Without labelled good and bad rows all others stay."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id; all rows of that id, and all without an id."""
    return neardup.deduplicated(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, all rows of their id; null and empty items are in none."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most; a null source is one of its own."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; the digest read back from them, one row for each document, those without an id first."""
    return tokens.token_output(docs, tokenizer_path(), END_ID)


STAGES = [("quality", select_quality), ("near duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("token output", write_tokens)]

#: The classifier and its random choice are beyond SQL; tests/llm/test_pipeline.py works the stages out one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
