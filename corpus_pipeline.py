"""A corpus through toxicity, quality, near-duplicate, mixing and tokenising stages.

Every stage takes documents and returns rows of their columns, whatever further columns they have and however these are
named; the last one has token ids in the place of the texts. Null and empty texts are scored like any other, have no
shingles, so no duplicates, and go in the mixing stage, which takes words. Repeated rows are near duplicates of each other,
of which one stays. Ties go by id. Empty tables give empty results with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memoglyph.llm import bpe, mixing, near_dedup, quality, toxicity
from memoglyph.llm.common import checkpointed, free_names, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity grammar, fitted on labelled ones among them, doesn't reject."""
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    own = free_names(docs.columns)
    return toxicity.score(docs, grammar, out=own).where(F.col(own) < toxicity.TOXIC_FROM).drop(own)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the compression classifier, fitted on labelled ones among them, doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    own = free_names(docs.columns)
    return quality.score(docs, model, out=own).where(F.col(own) >= quality.GOOD_FROM).drop(own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    own = free_names(docs.columns)
    held = {c: f"{own}{c}" for c in docs.columns if c in ("size", "source_size", "target", "taken")}
    mixed = mixing.taken_rows(mixing.mix(docs.withColumnsRenamed(held)))
    return mixed.select(*(F.col(f"`{held.get(c, c)}`").alias(c) for c in docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with their number; columns of these names are replaced."""
    return bpe.encode(docs, keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL can't express the models and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each on what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
