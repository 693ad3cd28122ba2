"""Corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``documents``; the last returns
the pieces of the packed sequences.

Defined cases: a null or empty text has too few words and goes in the first
stage; a null source is a host of its own; a text that loses all its lines
stays as an empty one, of which the near-duplicate stage keeps the least id;
other columns are dropped; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import common, decontaminate, line_runs, packing, quality_rules, simhash

_CARRY = ("lang", "source")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the new text."""
    return df.select(
        "doc_id", "text", F.col("carry_lang").alias("lang"), F.col("carry_source").alias("source"),
        F.length("text").cast("long").alias("n_chars"),
    )


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their host's boilerplate lines."""
    return _documents(quality_rules.clean_documents(docs, carry=_CARRY))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go."""
    return _documents(line_runs.dedup_lines(docs, carry=_CARRY))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.keep_one(docs).select("doc_id", "text", "lang", "source", "n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = decontaminate.containment_matches(docs, common.read_table(spark, sf_dir, "benchmark"))
    leaked = common.materialise(found.select("key_a", "key_b").distinct(), "decon-leaked")
    text = F.lower(common.text_of("text"))
    keyed = docs.select("doc_id", "text", "lang", "source", "n_chars", *common.content_key(text))
    return keyed.join(leaked, ["key_a", "key_b"], "left_anti").drop("key_a", "key_b")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in cost-balanced sequences, with their token ids."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

# Fingerprints and token ids are beyond SQL. The tests compare run() with brute force over a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
