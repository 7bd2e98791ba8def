"""What the operators of this package share: table access, word columns, folds and scratch tables."""

from __future__ import annotations

import os
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import scratch_path, shared_root, stored  # noqa: F401

#: ASCII white space (space, tab to carriage return); words are what stands between.
WHITE = r"[\x20\x09-\x0D]+"
#: A column that identifies rows, whatever their doc_id.
KEY = "_row_key"
WHITE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def words_of(text: Column) -> Column:
    """Words of a text, in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def with_key(docs: DataFrame) -> DataFrame:
    """docs with KEY, unique: the doc_id where that identifies rows, else numbers that are written down with the rows."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(KEY, F.col("doc_id"))
    return stored(docs.withColumn(KEY, F.monotonically_increasing_id()), "rows")


def vocabulary_file(path: str) -> str:
    """A vocabulary file where this machine has it: the path given, or else the installed one of that name."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions_for(n_rows: int, rows_each: int, least: int = 12) -> int:
    """Partitions that hold about rows_each rows."""
    return max(least, -(-n_rows // rows_each))
