"""A corpus pipeline of five stages, each over all that its predecessor kept: quality rules, exact dedup, near-dedup,
mixing and packing.

Defined results of every stage: a document is told by its doc_id; rows that repeat one stay or go together. Rows without a
doc_id are documents too: those that agree in text, lang and source are one, and where groups keep the largest doc_id they
come after all others. Columns besides those of documents are carried along, whatever their names; an empty table gives
no rows. What a stage does with null and empty texts stands at the stage; all else is as its operator says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import op2_near_dedup, op3_packing, op5_quality, op6_exact_dedup, op9_mixing
from sigspark.llm.common import dropped, read_table, written


def _identity() -> Column:
    """doc_id, or below all doc_ids a hash of what the operators read."""
    own = F.xxhash64(*[F.col(c).cast("string") for c in ("text", "lang", "source")])
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)) - own.bitwiseAND((1 << 62) - 1))


def _named(docs: DataFrame) -> DataFrame:
    """What the operators need, every row with an identity."""
    return docs.select(_identity().alias("doc_id"), "text", "lang", "source")


def _with_verdict(docs: DataFrame, verdict: DataFrame, how: str) -> DataFrame:
    """(document, verdict's columns): the documents whole, so that no column's name can clash."""
    rows = docs.select(_identity().alias("doc_id"), F.struct("*").alias("document"))
    return rows.join(verdict.hint("merge"), "doc_id", how)


def _chosen(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Documents that the verdict (doc_id, kept) keeps."""
    return _with_verdict(docs, verdict.where("kept").select("doc_id").distinct(), "left_semi").select("document.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules. Null and empty texts have no words and go."""
    return _chosen(docs, op5_quality.quality(_named(docs)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id. Null and empty texts are equal, so one stays."""
    return _chosen(docs, op6_exact_dedup.dedup(_named(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the largest doc_id. Texts without a word all stay."""
    return _chosen(docs, op2_near_dedup.near_classes(_named(docs)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes n times is in the result n times. Texts without a word have size 0; the mix takes them
    as often as it passes whole over their source, and the budget that is left takes none of them."""
    taken = op9_mixing.mix(_named(docs)).where("copies > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies"))
    return _with_verdict(docs, taken, "inner").select("document", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. A null or empty text is one end token."""
    return op3_packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can't express language references, order sketches or the vocabulary; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped(*held)  # the stage was its only reader
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
