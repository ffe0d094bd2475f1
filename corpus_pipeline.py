"""A training corpus from documents: each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberframe.llm import alike, langid, mixing, packing, repeats, trie_join
from emberframe.llm.common import table
from emberframe.session import cut_lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (3): documents that no language claims go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates (7), five-word shingles alike to 0.8: of each group the document of smallest doc_id stays. What the operator
    and seeded minima propose is confirmed by the sets of shingles.

    Rows without an id are a corpus of their own: no document with an id stands for them, of their copies one stays.
    """
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    kept = alike.keep_one(named, also=trie_join.near_duplicates)
    return kept if nameless.isEmpty() else kept.union(alike.keep_one(nameless, also=trie_join.near_duplicates))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (5): words of repeated passages go; n_chars is that of what is left, a text left empty goes too."""
    return repeats.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (1): documents sampled to the target weights of sources, languages and topics."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (4): pieces of documents in sequences of 4,096 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # SQL has neither the classifier nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents table; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
