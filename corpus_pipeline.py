"""Five operators in a row over `documents`: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage takes all rows that its predecessor kept, with all their columns. A row whose
text is null is empty to every stage and stays; so does a row with a null doc_id, but
for what the toxicity and the benchmark stage find in its text. Rows that repeat a
doc_id and its text are judged alike; the third stage keeps one of them. Rows that repeat
a doc_id alone are documents of their own. Ties go to the smallest doc_id. An empty
table of documents, labels or benchmark items is allowed: without labels nothing is toxic,
without items nothing is contaminated. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from lodestone.llm._cut import cut

#: No SQL form: toxicity is a fitted model, line dedup an alignment.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks are cut from the later document; n_chars follows the text."""
    out = line_dedup.delete_blocks(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest doc_id stays."""
    return jaccard_join.keep_first(docs)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark windows hit less than a twentieth."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("near_copies", without_near_copies),
    ("decontamination", without_contaminated),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
