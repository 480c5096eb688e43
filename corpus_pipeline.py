"""The corpus pipeline: each stage reads what the one before it wrote.

Null texts count as empty; rows that repeat, ties, very long texts, extra columns (kept by all stages but
the last) and empty tables are what the stages' operators say of them. Rows without a doc_id are
documents of their own for quality, kept by the join unless linked to another row, and mixed and
packed like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ngram_join, packing, quality_rules, source_mixing
from tidemark.llm.common import read_table, shared_folder, stored

#: Near duplicates of the corpus: word shingles and the least Jaccard similarity in percent.
SHINGLE = 5
PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filtered(docs)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return ngram_join.deduplicated(docs, SHINGLE, PERCENT)


#: Where the session says which table holds the positions of the mixture.
MIXTURE = "spark.tidemark.mixture"


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as they are; their positions in the mixture of their sources go into a table beside them."""
    path = shared_folder(spark, "mixture")
    source_mixing.schedule(docs).select("doc_id", "position").write.parquet(path)
    spark.conf.set(MIXTURE, path)
    return source_mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, in the order of the mixture if there is one."""
    path = spark.conf.get(MIXTURE, None)
    return packing.packed(docs, order=spark.read.parquet(path) if path else None)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", join_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Token ids, components and packed sequences have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    spark.conf.unset(MIXTURE)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
