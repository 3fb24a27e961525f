"""Table updates: upserts, one-time inserts, edge merges and child replacement.

Each takes the stored table and a batch and returns the new table. A repeated run
with the same batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(incoming: DataFrame, key: str, cols: Sequence[str], seq: str) -> DataFrame:
    """One row per key, the one with the highest `seq`; combines before the shuffle."""
    return incoming.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_new"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, cols: Sequence[str], seq: str) -> DataFrame:
    """Insert new keys; on known keys overwrite exactly `cols`, NULLs included."""
    newest = last_per_key(incoming, key, cols, seq)
    arrived = F.col("_new").isNotNull()
    return existing.join(newest, key, "full_outer").select(*[
        F.when(arrived, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
        for c in existing.columns
    ])


def insert_once(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Add only absent keys; stored rows stay untouched."""
    fresh = incoming.join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def edges_insert_absent(
    existing: DataFrame, parents: DataFrame, parent_key: str, array_col: str, child_key: str,
    position: str | None = None, skip: Sequence[str] = (),
) -> DataFrame:
    """Add the (parent, child) pairs of an array column that are not stored yet.

    With `position`, new edges take their array index (the first one when a child
    is listed twice) and stored edges keep the one they have. Children in `skip`
    are never linked, though their index still counts.
    """
    pair = [parent_key, child_key]
    listed = parents.select(parent_key, F.posexplode(array_col).alias("_pos", child_key))
    if skip:
        listed = listed.filter(~F.col(child_key).isin(list(skip)))
    fresh = listed.groupBy(*pair).agg(F.min("_pos").alias("_pos")).join(existing.select(*pair), pair, "left_anti")
    fresh = fresh.withColumnRenamed("_pos", position) if position else fresh.drop("_pos")
    return existing.unionByName(fresh)


def replace_children(existing: DataFrame, parents: DataFrame, children: DataFrame, parent_key: str) -> DataFrame:
    """Drop the children of every parent of the batch and put the new ones in."""
    kept = existing.join(parents.select(parent_key).distinct(), parent_key, "left_anti")
    return kept.unionByName(children)


def explode_children(parents: DataFrame, parent_key: str, array_col: str, value: str) -> DataFrame:
    """Array elements as rows with positions 0..n-1."""
    return parents.select(parent_key, F.posexplode(array_col).alias("position", value))


def drop_retired(rows: DataFrame, key: str, retired: Sequence[str]) -> DataFrame:
    """Leave out merged-away ids; a NULL key is kept."""
    return rows.filter(F.col(key).isNull() | ~F.col(key).isin(list(retired)))


def upsert_glossary(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Upsert on the term itself; only the translation and definition change."""
    return upsert(existing, incoming, "term", ["term_en", "definition"], seq)


def set_null_where_gone(rows: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """SET NULL rule: clear references to deleted keys and keep the row."""
    deleted = gone.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    cleared: Column = F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(column))
    return rows.join(deleted, column, "left").withColumn(column, cleared).select(*rows.columns)
