"""Shared steps of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), whole_text().alias("text"))


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                fields: list[tuple[str, T.DataType]]) -> DataFrame:
    return df.mapInArrow(function, T.StructType([T.StructField(n, t) for n, t in fields]))


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def crc_of_id() -> Column:
    """crc32 of the id as text, by which labelled rows are split."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def row_key() -> list[Column]:
    """key_id, key_hash of rows that carry doc_id and text_hash."""
    return [F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")]


def with_keys(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` that (left_semi) or that no (left_anti) row (key_id, key_hash) of `keys` names.

    A row is named by its id and the hash of its text; null ids match null ids. The row travels as
    one struct, so its columns may have any names. The keys grow with the documents, so they
    are shuffled at every size.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").alias("row_id"), F.xxhash64(whole_text()).alias("row_hash"))
    same = F.col("row_id").eqNullSafe(F.col("key_id")) & (F.col("row_hash") == F.col("key_hash"))
    return rows.join(keys.hint("merge"), same, how).select("row.*")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of `docs` that no row (key_id, key_hash) names."""
    return with_keys(docs, gone, "left_anti")
