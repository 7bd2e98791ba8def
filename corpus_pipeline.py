"""From raw documents to token ids: the corpus pipeline, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's input. All but the last return the columns of `documents`.

Defined results: rows without a doc_id pass every stage that doesn't judge their text; of rows that repeat a doc_id one
leaves near_duplicates, and the other stages judge each row by itself; null and empty texts fail the quality rules;
ties go to the smallest doc_id; an empty table leaves every stage empty; columns beside those of `documents` stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import byte_bpe, decontaminate, minhash, quality_rules, suffix_dedup
from granary.llm.common import stored, table
from granary.session import ship_package

#: Similarity of word shingles from which the pipeline takes two documents for near copies; op3 has its own.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (NEAR_PERCENT of all shingles shared) the document with the smallest doc_id stays."""
    ship_package(spark)
    return minhash.keep_first(docs, percent=NEAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier go out of the texts; every document stays, maybe with an empty text.

    Where a cut falls inside a character, the character's remaining bytes go too.
    """
    ship_package(spark)
    return suffix_dedup.cut(docs, valid_text, sizes=("n_chars",))


def valid_text(data):
    """Bytes as text without what isn't UTF-8."""

    @F.pandas_udf("string")
    def decode(values):
        return values.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    return decode(data)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids."""
    ship_package(spark)
    return byte_bpe.encode_documents(docs, *byte_bpe.default_files(), keep=["doc_id"], with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("byte_bpe", token_ids),
]

#: SQL can't express near duplicates by MinHash, the removal of repeated bytes or BPE merges; tests compare run()'s rows with stages written out in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
