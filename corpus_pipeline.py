"""The corpus pipeline: toxicity, line dedup, Jaccard join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A stage works on all rows that the one before it kept.

Null and empty texts are clean, have no lines, link with nothing and pack as one token. Rows
without an id are scored, but go at the line stage, since they have no place in the order.
Rows that share an id are judged each for itself by the first two stages; where one of them
is hit by the benchmark, all go; packing takes each. Of linked documents that with the
smallest id stays, so there are no ties. Columns other than doc_id and text are carried
along; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import decontam, lines, packing, toxicity
from pointloom.llm.jaccard import jaccard_join
from pointloom.llm.queries import table, tokenizer_path
from pointloom.plans.lineage import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; labels train the model only."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col(toxicity.SCORE) < toxicity.THRESHOLD).drop(toxicity.SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted, by lines or by words; documents that lose all their lines go."""
    return lines.deduped(docs, words=lines.WORDS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    others = jaccard_join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    hit = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: SQL cannot express the learned classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each read back from Parquet by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
