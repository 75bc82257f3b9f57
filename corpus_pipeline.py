"""Corpus pipeline: named stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last the columns of
documents, the last the pieces of packed sequences. A document goes if the quality rules reject it, if it is
in no language that was learned or between two, or if a document of smaller doc_id is
linked with it; strings of 50 bytes that an earlier document has are cut out of the others.

Null and empty texts have no words, so the quality rules reject them. Rows that repeat a doc_id go with the Jaccard
stage but for one; rows without doc_id stay, and neither remove others' text nor lose theirs. Ties go to the smaller
doc_id. Very long texts are handled whole, by stages whose memory follows the longest one. Columns beside those of
documents stay as they are, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm import cost_packing, ecoc_langid, ngram_jaccard, quality_llr, suffix_dedup
from driftloom.llm.arrowkit import cut_lineage, table
from driftloom.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_llr.filter_documents(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ecoc_langid.filter_documents(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more."""
    return ngram_jaccard.keep_first(docs, n=5, num=80, den=100)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cost_packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("ngram_jaccard", jaccard_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]
#: The stages learn models, sort suffixes and run a tokenizer; SQL has none of these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after another."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
