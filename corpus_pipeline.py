"""Corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what it
returns is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. A table without rows goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainstate.llm.common import stored, table
from brainstate.llm.near_dup import without_copies
from brainstate.llm.packing import pack_documents
from brainstate.llm.quality import with_quality
from brainstate.llm.toxicity import learn, with_scores

#: Name of a stage's own column; it is gone in what the stage returns.
VERDICT = "_stage_verdict"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail them."""
    out = with_quality(docs, out=VERDICT).filter(f"{VERDICT}.kept").withColumn("text", F.col(f"{VERDICT}.cleaned_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic, by a lexicon learned from the labelled ones among them."""
    model = learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return with_scores(docs, model, out=VERDICT).filter(f"{VERDICT}.predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near-duplicates, once."""
    return without_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", packing),
]

#: SQL can express neither the learned lexicon nor the near-duplicates nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
