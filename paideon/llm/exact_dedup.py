"""Exact duplicates with a split of heavy hitters.

A Misra-Gries summary of each partition, merged, names every digest that more than
1/(k+1) of all rows share. Their exact winners, k rows at most, are broadcast, so the
copies of frequent texts are settled where they are read. All other digests are
grouped by an ordinary shuffle in which no group is larger than n/(k+1) rows.

Defined cases: a null text counts as the empty text. Ids may be null: a null id stays
only in a group without any other id. Rows that repeat id and text are one document;
`flags` gives each of them the same result, `distinct_documents` leaves one. An
empty table gives an empty result. Texts of any length are hashed whole; frequent digests that tie for the
last counters go by the digest, which decides only how they are resolved. Further columns of any name pass through
`distinct_documents` unchanged.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paideon.llm.common import map_batches, whole_text
from paideon.session import stage

COUNTERS = 1024  # k: 1024 rows of about 60 bytes are broadcast at most


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.sha2(whole_text(), 256)).alias("digest"))


def _summary(counters: int):
    """Misra-Gries over batches; a batch is merged as a summary of its own."""

    def summarise(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            counts = batch.column(0).value_counts()
            for value, count in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist()):
                held[value] = held.get(value, 0) + count
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {v: c - cut for v, c in held.items() if c > cut}
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "counter"])

    return summarise


def frequent(digested: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests, among them each that more than n/(counters+1) rows share."""
    partial = map_batches(digested.select("digest"), _summary(counters),
                          [("digest", T.BinaryType()), ("counter", T.LongType())])
    merged = partial.groupBy("digest").agg(F.sum("counter").alias("counter"))
    return merged.orderBy(F.desc("counter"), "digest").limit(counters).select("digest")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def resolved(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, digest, keep_id, group_size of every row."""
    rows = stage(digests(docs), "digests")
    names = stage(frequent(rows, counters), "frequent")
    # Verified: exact sizes and winners of the named digests, copies only.
    winners = stage(_groups(rows.join(F.broadcast(names), "digest")).filter("group_size > 1"), "winners")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    light = rows.join(F.broadcast(winners), "digest", "left_anti")
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    return (marked.filter("group_size is not null").select(*columns)
            .unionByName(light.join(_groups(light), "digest").select(*columns)))


def flags(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: keep_id (the largest id of equal texts), group_size, kept, text_sha256."""
    return resolved(docs, counters).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names."""
    rows = stage(resolved(docs, counters).filter("group_size > 1"), "copies")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    key = [F.col("digest").alias("key_digest"), F.col("doc_id").alias("key_id")]
    gone = rows.filter(~stays).select(*key).distinct()
    left = _by_digest(_with_digest(docs), gone, "left_anti")
    repeated = stage(rows.filter(stays).groupBy("digest", "doc_id").count().filter("count > 1").select(*key), "repeated")
    if repeated.isEmpty():
        return left.select("row.*")
    again = _by_digest(left, repeated, "left_semi").dropDuplicates(["row_digest"])
    return _by_digest(left, repeated, "left_anti").unionByName(again).select("row.*")


def _with_digest(docs: DataFrame) -> DataFrame:
    """Each row as one struct, so that its columns may have any names, beside its id and digest."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("row_id"),
                       F.unhex(F.sha2(whole_text(), 256)).alias("row_digest"))


def _by_digest(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    same = (F.col("row_digest") == F.col("key_digest")) & F.col("row_id").eqNullSafe(F.col("key_id"))
    return rows.join(keys.hint("merge"), same, how)
