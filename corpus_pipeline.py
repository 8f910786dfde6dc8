"""A training-corpus pipeline: five of the corpus operators over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, others
with them, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyproof.llm.common import checkpointed, read
from tallyproof.llm.decontaminate import clean_documents
from tallyproof.llm.jaccard_join import keep_one
from tallyproof.llm.mixing import mixed_documents
from tallyproof.llm.quality_rules import remove_frequent_lines
from tallyproof.llm.token_file import round_trip


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, frequent lines taken out. Null and empty texts go; repeated rows are judged
    each; a null source is a host of its own."""
    return remove_frequent_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id (null last), of each group linked by shingle similarity. Repeated rows
    are copies; documents without words all stay."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark. Null and empty texts and items have no windows; repeated rows are judged
    each."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them, at most three times. Texts without words are not drawn; a null
    source is one source; repeated rows are documents of their own."""
    return mixed_documents(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as a token-id file, read back: one row for each document written, repeats included. Null and empty texts are
    the end id alone."""
    return round_trip(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("token ids", token_file),
]

#: SQL cannot express the last stages; tests/llm/test_odd_rows.py compares the pipeline with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading the table that the one before has written."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
