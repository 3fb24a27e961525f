"""Long repeated passages by De Bruijn compaction of word k-mers.

Every window of k words is an edge between its first and its last k-1 words. Consecutive
edges of a document with the same minimizer (the smallest hash among the m-word pieces of a
window) are compacted into a path at once, where the text is read; equal windows have equal
minimizers, so only minimizers met in several places can hold repeated edges, and all other
paths drop out after one count. Equal paths are joined to their first source coordinate
(smallest document and position). A minimizer with several paths branches: every occurrence
of its paths inside the source document of the path is opened into single edges, which are
joined to the first source of the edge. In later documents a path repeats all its edges.

Neighbouring repeated paths with neighbouring sources are compacted into spans. Both ends of
a span, the copy and the source coordinates, are read again and their digests compared;
spans that fail go back to text.

Defined cases: a null text has no words; texts shorter than a window are kept; null ids
neither give nor lose words; rows that repeat an id with its text have equal results, and
different texts under one id keep what is not at the same place in each; an empty table gives
an empty result; texts of any length are read whole; of equal windows the smallest id keeps its own, further
places in that document stay; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paideon.llm.common import ids_and_texts, map_batches
from paideon.llm.textblocks import Words, mix, row_groups, sequence_hashes, window_hashes, words_of
from paideon.session import stage

WINDOW_WORDS = 13
MINIMIZER_WORDS = 4


def paths_of(words: Words, size: int = WINDOW_WORDS, piece: int = MINIMIZER_WORDS):
    """(minimizer, row, first word within the row, windows, path hash) of every path."""
    n = len(words.hashes) - size + 1
    if n <= 0:
        return [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    factor, pieces = 1, np.zeros(len(words.hashes) - piece + 1, np.uint64)
    for j in range(piece):
        factor = factor * 0xA0761D6478BD642F & ((1 << 64) - 1)
        pieces += words.hashes[j:j + len(pieces)] * np.uint64(factor)
    pieces = mix(pieces)
    least = pieces[:n].copy()
    for j in range(1, size - piece + 1):
        np.minimum(least, pieces[j:j + n], out=least)
    row = words.rows
    whole = row[:n] == row[size - 1:]
    head = whole.copy()
    head[1:] &= ~(whole[:-1] & (least[1:] == least[:-1]) & (row[1:n] == row[:n - 1]))
    begin = np.flatnonzero(head)
    if not len(begin):
        return [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    windows = np.add.reduceat(whole.astype(np.int64), begin)
    path = sequence_hashes(words, begin, begin + windows + size - 1)
    return [least[begin], row[begin], begin - words.first[row[begin]], windows, path]


def _count(size: int, piece: int):
    def count(batches):
        for batch in batches:
            keys = []
            for a, b in row_groups(batch.column(1)):
                least, row, *_ = paths_of(words_of(batch.column(1), a, b), size, piece)
                # Once per row: a minimizer of one text alone repeats nothing.
                order = np.lexsort((least, row))
                least, row = least[order], row[order]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                keys.append(least[new])
            key, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int32))], ["minimizer", "n"])

    return count


def _emit(size: int, piece: int):
    def emit(batches):
        for batch in batches:
            for a, b in row_groups(batch.column(1)):
                least, row, at, windows, path = paths_of(words_of(batch.column(1), a, b), size, piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), pa.array(path.view(np.int64)), batch.column(0).slice(a, b - a).take(pa.array(row)),
                     pa.array(at.astype(np.int32)), pa.array(windows.astype(np.int32))], ["minimizer", "path", "doc", "at", "windows"])

    return emit


def repeated_paths(docs: DataFrame, size: int, piece: int) -> DataFrame:
    """minimizer, path, doc, at, windows of the paths whose minimizer is in several rows."""
    counted = map_batches(docs, _count(size, piece), [("minimizer", T.LongType()), ("n", T.IntegerType())])
    several = stage(counted.groupBy("minimizer").agg(F.sum("n").alias("n")).filter("n > 1").select("minimizer"), "minimizers")
    listed = map_batches(docs, _emit(size, piece), [
        ("minimizer", T.LongType()), ("path", T.LongType()), ("doc", T.LongType()), ("at", T.IntegerType()), ("windows", T.IntegerType())])
    return stage(listed.join(several, "minimizer"), "paths")


def _open(size: int):
    def open_paths(batches):
        for batch in batches:
            for a, b in row_groups(batch.column(1)):
                words = words_of(batch.column(1), a, b)
                edge, starts = window_hashes(words, size)
                place = np.full(len(words.hashes) + 1, -1, np.int64)
                place[starts] = np.arange(len(starts))
                lists = batch.column(2).slice(a, b - a)
                count = np.diff(lists.offsets.to_numpy())
                spans = lists.flatten()
                row = np.repeat(np.arange(b - a), count)
                at, windows = (spans.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                index = np.arange(int(windows.sum())) + np.repeat(at - (np.cumsum(windows) - windows), windows)
                row = np.repeat(row, windows)
                inside = index < words.counts[row]
                row, index = row[inside], index[inside]
                found = place[words.first[row] + index]
                row, index, found = row[found >= 0], index[found >= 0], found[found >= 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(edge[found].view(np.int64)), batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(index.astype(np.int32))],
                    ["edge", "doc", "at"])

    return open_paths


def _source(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("source.doc").alias("source_doc"), F.col("source.at").alias("source_at")).drop("source")


def _first():
    return F.min(F.struct("doc", "at")).alias("source")


_REPEAT = ["doc", "at", "windows", "source_doc", "source_at"]


def repeats(docs: DataFrame, size: int = WINDOW_WORDS, piece: int = MINIMIZER_WORDS) -> DataFrame:
    """doc, at, windows, source_doc, source_at of paths and edges that begin in a smaller document."""
    paths = repeated_paths(docs, size, piece)
    distinct = stage(_source(paths.groupBy("minimizer", "path").agg(_first(), F.min("windows").alias("windows"))), "distinct-paths")
    later = paths.join(distinct.select("minimizer", "path", "source_doc", "source_at"), ["minimizer", "path"]).filter("doc > source_doc")
    branching = distinct.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("minimizer")
    forks = distinct.join(branching, "minimizer").select("minimizer", "path", "source_doc")
    # Every place in the source document: the places after the first are no later repeats of it.
    places = paths.join(forks, ["minimizer", "path"]).filter("doc = source_doc").select("doc", "at", "windows").distinct()
    opened = places.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("at", "windows")).alias("spans"))
    texts = docs.join(opened, "doc_id").select("doc_id", "text", "spans")
    edges = stage(map_batches(texts, _open(size), [("edge", T.LongType()), ("doc", T.LongType()), ("at", T.IntegerType())]), "edges")
    first = _source(edges.groupBy("edge").agg(_first(), F.max("doc").alias("last"))).filter("last > source_doc").drop("last")
    single = edges.join(stage(first, "first-edges"), "edge").filter("doc > source_doc").withColumn("windows", F.lit(1))
    return later.select(*_REPEAT).unionByName(single.select(*_REPEAT))


def spans_of(repeated: DataFrame, size: int) -> DataFrame:
    """doc, at, words, source_doc, source_at: neighbouring repeats with neighbouring sources as one."""
    order = Window.partitionBy("doc").orderBy("at", "source_doc", "source_at")
    shift = F.col("at") - F.col("source_at")
    same = ((F.lag("source_doc").over(order) == F.col("source_doc")) & (F.lag(shift).over(order) == shift)
            & (F.lag(F.col("at") + F.col("windows")).over(order) >= F.col("at")))
    marked = repeated.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "span", "source_doc").agg(
        F.min("at").alias("at"), (F.max(F.col("at") + F.col("windows")) - F.min("at") + size - 1).alias("words"),
        F.min("source_at").alias("source_at")).drop("span")


_DIGEST = T.StructType([T.StructField("doc", T.LongType()), T.StructField("at", T.IntegerType()),
                        T.StructField("words", T.IntegerType()), T.StructField("digest", T.BinaryType())])


def _clean(batches):
    kind = pa.list_(pa.struct([("doc", pa.int64()), ("at", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())]))
    for batch in batches:
        for a, b in row_groups(batch.column(1)):
            words = words_of(batch.column(1), a, b)
            part = batch.slice(a, b - a)
            removed, kept, digests = [], [], []
            raw, begin, end = words.data.tobytes(), words.begin.tolist(), words.end.tolist()
            spans = part.column(2).to_pylist()
            for i in range(b - a):
                first, n = int(words.first[i]), int(words.counts[i])
                listed = [raw[begin[k]:end[k]] for k in range(first, first + n)]
                gone, found = np.zeros(n + 1, np.int64), []
                for s in spans[i] or ():
                    at, size = s["at"], s["words"]
                    found.append({"doc": s["source_doc"], "at": s["source_at"], "words": size,
                                  "digest": hashlib.sha256(b" ".join(listed[at:at + size])).digest()})
                    if s["copy"] and at < n:
                        gone[at] += 1
                        gone[min(at + size, n)] -= 1
                left = np.cumsum(gone[:n]) == 0
                removed.append(n - int(left.sum()))
                text = b" ".join(listed if left.all() else [w for w, k in zip(listed, left.tolist()) if k])
                kept.append(hashlib.sha256(text).hexdigest())
                digests.append(found)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.counts.astype(np.int64)), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(digests, kind)], ["doc_id", "n_words", "n_removed", "kept_sha256", "digests"])


def _cleaned(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document without its spans, and the digests of both ends of the spans."""
    copies = spans.select(F.col("doc").alias("doc_id"), "at", "words", "source_doc", "source_at", F.lit(True).alias("copy"))
    sources = spans.select(F.col("source_doc").alias("doc_id"), F.col("source_at").alias("at"), "words", "source_doc", "source_at",
                           F.lit(False).alias("copy")).distinct()
    ends = copies.unionByName(sources).groupBy("doc_id").agg(
        F.collect_list(F.struct("at", "words", "source_doc", "source_at", "copy")).alias("ends"))
    joined = docs.join(ends, "doc_id", "left").select("doc_id", "text", "ends")
    return map_batches(joined, _clean, [
        ("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()),
        ("digests", T.ArrayType(_DIGEST))])


def without_repeats(docs: DataFrame, size: int = WINDOW_WORDS, piece: int = MINIMIZER_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = ids_and_texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    spans = stage(spans_of(repeats(docs.filter("doc_id is not null"), size, piece), size), "spans")
    cleaned = stage(_cleaned(docs, spans), "cleaned")
    digests = cleaned.select(F.inline("digests"))
    failed = stage(digests.groupBy("doc", "at", "words").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
                   .filter("low <> high").select(F.col("doc").alias("source_doc"), F.col("at").alias("source_at"), "words"), "failed")
    if not failed.isEmpty():
        cleaned = _cleaned(docs, spans.join(failed, ["source_doc", "source_at", "words"], "left_anti"))
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")
