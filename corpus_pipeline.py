"""The pipeline over a corpus: stages, each written as Parquet and read again.

Every stage works on what its predecessor kept and returns the columns of its
documents; the last adds `copy`, which numbers the times a document is taken.
Where a stage changes a text, `n_chars` is counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import decontaminate, language, line_dedup, mixing, ngram_join
from assay.llm.common import cut_lineage, read


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    chars = F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))
    return docs.withColumn("n_chars", chars)


def identify_language(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Documents without letters, or mostly in no language that labels teach, go."""
    return language.accepted(docs)


def drop_lines(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Long lines of five documents or more stay in one document only."""
    return _counted(line_dedup.dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns]))


def join_near_copies(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.representatives(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go, and documents that are mostly such passages."""
    return _counted(decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark")))


def mix_sources(_spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources", mix_sources),
]
#: No SQL can say the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
