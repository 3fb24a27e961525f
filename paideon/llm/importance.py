"""Importance resampling towards a target by hashed n-grams, with CRC-32 from a position table.

CRC-32 is linear: the code of a text is a constant of its length, xor one contribution per
byte that depends on the byte and its distance from the end. All contributions up to REACH
bytes are looked up at once and folded by `bitwise_xor.reduceat` over the spans of the
features; a longer span is folded block by block from its end, each partial code being moved
on by REACH bytes with four more lookups.

Every document is weighed by the summed log ratio of target and corpus over its features,
Gumbel noise that depends only on seed and id is added, and the highest scores are drawn, which
samples without replacement in proportion to the weights.

Defined cases: a null or empty text has no words, features or weight; a null id takes noise of
the empty string; equal scores go by the smaller id (null first), rows equal in both have
ranks in any order; repeated rows are scored and drawn one by one; an empty target or
corpus counts nothing (all gains follow from the smoothing); an empty table gives no row;
texts of any length are counted whole, a few thousand words at a time; further columns are not
read by `ranked` and pass through `sample` unchanged, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paideon.functions.rank import numbered
from paideon.llm.common import ids_and_texts, map_batches, row_key, type_of, whole_text, with_keys
from paideon.llm.textblocks import LOWER_ASCII, NOT_ALPHANUMERIC, row_groups, text_bytes
from paideon.session import stage

BUCKETS = 10_000
SIZES = (1, 2, 3)  # words of a feature
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
REACH = 96  # bytes looked up by distance from the end
STARTS = 1 << 13  # features folded together; only speed and memory depend on it


def _byte_codes() -> np.ndarray:
    """Register after each single byte, from an empty register."""
    codes = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        codes = np.where(codes & 1, (codes >> 1) ^ np.uint32(0xEDB88320), codes >> 1)
    return codes


_ONE = _byte_codes()


def _zeros(register: np.ndarray, count: int) -> np.ndarray:
    """Registers after `count` zero bytes more."""
    for _ in range(count):
        register = (register >> np.uint32(8)) ^ _ONE[register & np.uint32(255)]
    return register


def _position_table() -> np.ndarray:
    rows = [_ONE]
    while len(rows) < REACH:
        rows.append(_zeros(rows[-1], 1))
    return np.concatenate(rows)


POSITION = _position_table()  # [distance from the end * 256 + byte]
MOVED = [_zeros(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), REACH) for k in range(4)]
_lengths = [0]


def length_constants(longest: int) -> np.ndarray:
    """Code of as many zero bytes: what start value and final complement add to a text of that length."""
    while len(_lengths) <= longest:
        _lengths.append(zlib.crc32(b"\0", _lengths[-1]))
    return np.array(_lengths[:longest + 1], np.uint32)


def _fold(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Linear part of the codes of spans of 1 to REACH bytes."""
    size = end - begin
    stop = np.cumsum(size)
    flat = np.arange(stop[-1])
    distance = np.repeat(stop - 1, size) - flat
    found = POSITION[distance * 256 + data[flat + np.repeat(begin - (stop - size), size)]]
    return np.bitwise_xor.reduceat(found, stop - size)


def span_codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[begin:end] for each pair; no span is empty."""
    if not len(begin):
        return np.zeros(0, np.uint32)
    size = end - begin
    constants = length_constants(0 if size.max() > 1 << 16 else int(size.max()))
    codes = np.empty(len(size), np.uint32)
    short = np.flatnonzero(size <= REACH)
    if len(short):
        codes[short] = _fold(data, begin[short], end[short])
    for i in np.flatnonzero(size > REACH):
        cuts = np.arange(end[i], begin[i], -REACH)[::-1]
        folded = _fold(data, np.maximum(cuts - REACH, begin[i]), cuts)
        code = 0
        for part in folded.tolist():  # from the front: what is held moves on by one block
            code = int(MOVED[0][code & 255] ^ MOVED[1][code >> 8 & 255] ^ MOVED[2][code >> 16 & 255] ^ MOVED[3][code >> 24]) ^ part
        codes[i] = code
    if len(constants) > 1:
        return codes ^ constants[size]
    return codes ^ np.array([zlib.crc32(bytes(int(n))) for n in size], np.uint32)


def word_line(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of the rows joined by single spaces, where each begins and ends there, first word of each row."""
    data = LOWER_ASCII[data]
    letter = ~NOT_ALPHANUMERIC[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(letter & (np.concatenate([[True], ~letter[:-1]])[:len(letter)] | edge[:-1]))
    end = np.flatnonzero(letter & (np.concatenate([~letter[1:], [True]])[:len(letter)] | edge[1:])) + 1
    size = end - begin
    stop = np.cumsum(size + 1) - 1
    line = np.full(int(stop[-1]) + 1 if len(stop) else 0, 0x20, np.uint8)
    letters = np.flatnonzero(letter)
    line[letters + np.repeat(stop - size - begin, size)] = data[letters]
    return line, stop - size, stop, np.searchsorted(begin, offsets)


def feature_buckets(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every feature, block by block, after one empty block."""
    line, begin, end, first = word_line(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    for n in sizes:
        starts = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.zeros(0, np.int64)
        for i in range(0, len(starts), STARTS):
            at = starts[i:i + STARTS]
            yield span_codes(line, begin[at], end[at + n - 1]) % np.uint32(buckets), row[at]


def bucket_counts(texts: DataFrame, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts; one task adds its rows up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = batch.column(0)
            for a, b in row_groups(column):
                for found, _ in feature_buckets(*text_bytes(column, a, b), sizes, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    counted = map_batches(texts.select(whole_text().alias("text")), count, [("bucket", T.IntegerType()), ("n", T.LongType())])
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of target and corpus per bucket; `buckets` rows reach the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, df in ((s, docs), (t, target)):
        for r in bucket_counts(df, sizes, buckets).collect():
            counts[r.bucket] = r.n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in row_groups(column):
                data, offsets = text_bytes(column, a, b)
                rows = b - a
                features, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for found, row in feature_buckets(data, offsets, sizes, len(gain)):
                    low, high = int(row[0]), int(row[-1]) + 1
                    features[low:high] += np.bincount(row - low, minlength=high - low)
                    np.add.at(weight, row, gain[found])
                words = np.diff(word_line(data, offsets)[3])
                part = batch.slice(a, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(words.astype(np.int64)), pa.array(features), pa.array(weight)],
                    ["doc_id", "text_hash", "n_words", "n_features", "weight"])

    texts = ids_and_texts(docs).withColumn("text_hash", F.xxhash64("text"))
    long = T.LongType()
    return map_batches(texts, weigh, [("doc_id", type_of(docs, "doc_id")), ("text_hash", long), ("n_words", long), ("n_features", long), ("weight", long)])


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
           sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn), text_hash of every row."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = stage(weighed(docs, gains(docs, target, sizes, buckets), sizes)
                   .withColumn("score", F.col("weight") + noise), "scored")
    long_enough = F.col("n_words") >= least_words
    drawn = percent * scored.filter(long_enough).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    columns = ["doc_id", "n_features", "weight", "score", "rank", "text_hash"]
    placed = numbered(scored.filter(long_enough), order, "place").withColumn(
        "rank", F.when(F.col("place") < drawn, F.col("place") + 1)).select(*columns)
    return placed.union(scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def sample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn rows of `docs`, every column as it came; rows equal in id and text are drawn together."""
    taken = ranked(docs, target, **parameters).filter("rank is not null").select(*row_key()).distinct()
    return with_keys(docs, taken, "left_semi")
