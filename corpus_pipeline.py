"""Corpus preparation: quality filter, line dedup, near-duplicate removal, decontamination, encoding.

Every stage takes the documents that the stage before it kept and returns documents with the same
columns; the last one adds the token ids. `n_chars`, where there is one, follows the text. Null or
empty texts pass every stage whose measure they meet; an empty table passes all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.decontaminate import decontaminated
from gaugeworks.llm.line_dedup import dedup_lines
from gaugeworks.llm.ngram_join import without_near_copies
from gaugeworks.llm.quality_qda import accepted
from gaugeworks.llm.sentencepiece_viterbi import encoded
from gaugeworks.llm.workspace import Workspace, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(spark, docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]
#: Rolling hashes, the discriminant and the vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.cut(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
