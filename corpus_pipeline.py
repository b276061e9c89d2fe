"""A training-corpus pipeline over `documents`: five stages, each of them one operator of polyloci.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyloci.llm.common import stored
from polyloci.llm.decontaminate import drop_contaminated
from polyloci.llm.exact_dedup import drop_exact_duplicates
from polyloci.llm.langid import fit, keep_known_languages
from polyloci.llm.packing import pack_documents
from polyloci.llm.queries import table, tokenizer_path
from polyloci.llm.simhash import drop_similar


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near to a language learnt from the labelled ones; others go, and so do null, empty and blank texts, which
    have no language. Repeated rows are judged alike; an empty table leaves nothing."""
    return keep_known_languages(docs, fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for A-Z and a-z, the one with the largest id (null is smallest); of
    repeated rows of that id one stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id: candidates by SimHash, links by a
    Jaccard similarity of 5-word shingles of 0.8 or more. Null, empty and blank texts are copies of one another."""
    return drop_similar(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of `benchmark`, within its edit budget, anywhere in the text. Null and empty texts have none and
    stay, and so do null ids; without a benchmark all stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, with sequence and offset; null and empty texts give their end id alone."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the classifier nor XXH64, edit distances within bands or the tokenizer; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
