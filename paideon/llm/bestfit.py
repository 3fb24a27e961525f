"""Best-fit packing of token pieces with certified bin counts.

Whole texts become token pieces of at most `capacity`; full pieces are sequences of
their own. The rest is dealt into bounded partitions and packed by best-fit decreasing.
Dual-feasible functions bound each partition's bin count from below. Partitions whose
count meets the bound are certified; the others exchange the pieces of their unfilled
bins, deal them anew and pack again, as long as that saves bins. A certified partition has
rounded up once, so its emptiest bin takes part too.

Only lengths move: ids are counted and hashed where the text is read.

Defined cases: a null or empty text is one piece that holds the end id alone; repeated
rows are packed one by one; equal lengths are packed in any order; an empty table gives
an empty result; texts of any length are cut into pieces whole; further columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paideon.llm.common import ids_and_texts, map_batches, type_of
from paideon.llm.textblocks import row_groups
from paideon.session import stage

CAPACITY = 2048
END_ID = 0
PARTITION_PIECES = 8192  # pieces packed together; the number of partitions grows with the input


def _cut(path: str, capacity: int, end_id: int):
    def cut(batches):
        from paideon.llm.tokens import encoder

        encode = encoder(path).encode
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in row_groups(texts):
                rows, piece, start, length, crc = [], [], [], [], []
                for row, raw in enumerate(encode(texts.slice(a, b - a).to_pylist()), a):
                    raw += end
                    n = len(raw) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        part = raw[4 * at:4 * (at + capacity)]
                        rows.append(row)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder(path).rest()

    return cut


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    return map_batches(ids_and_texts(docs), _cut(path, capacity, end_id), [
        ("doc_id", type_of(docs, "doc_id")), ("piece", T.IntegerType()), ("start", T.LongType()),
        ("length", T.LongType()), ("ids_crc32", T.LongType())])


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions."""
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    # Sizes over capacity - t count as whole bins, sizes under t as nothing.
    for t in sizes[sizes <= capacity // 2]:
        value = np.where(sizes > capacity - t, capacity, np.where(sizes >= t, sizes, 0))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    # Rounded multiples k+1 of a size, exact multiples kept.
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length."""
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    room: list[tuple[int, int]] = []  # (free space, bin), sorted
    opened = 0
    for i in order.tolist():
        need = int(lengths[i])
        at = bisect_left(room, (need, -1))
        if at < len(room):
            free, bin_no = room.pop(at)
        else:
            free, bin_no = capacity, opened
            opened += 1
        bins[i], offsets[i] = bin_no, capacity - free
        if free > need:
            insort(room, (free - need, bin_no))
    return bins, offsets


def _pack(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(used) - lower_bound(lengths, capacity)
        spare = (bins == used.argmin()) if len(used) else np.zeros(0, bool)
        return pa.table({
            "row_no": table["row_no"], "length": table["length"], "part": table["part"], "bin": pa.array(bins),
            "offset": pa.array(offsets), "open": pa.array((used[bins] < capacity) & ((gap > 0) | spare))})

    return pack


_PACKED = "row_no long, length long, part long, bin long, offset long, open boolean"


def _deal(rows: DataFrame, salt: int, partition_pieces: int, capacity: int, count: int) -> DataFrame:
    parts = max(1, -(-count // partition_pieces))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row_no", F.lit(salt)), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(_pack(capacity), _PACKED)


def _places(rest: DataFrame, capacity: int, partition_pieces: int) -> DataFrame:
    """row_no, sequence_id, offset of every piece shorter than the capacity."""

    def settle(df: DataFrame, salt: int) -> DataFrame:
        # Round, partition and bin in one number; partitions stay below 2**30.
        number = F.lit(salt << 50) + F.shiftleft("part", 20) + F.col("bin")
        return stage(df.withColumn("sequence_id", number), "packed")

    packed = settle(_deal(rest, 0, partition_pieces, capacity, rest.count()), 0)
    done = []
    for salt in itertools.count(1):  # every round has fewer bins than the one before
        pool = packed.filter("open")
        count, before = pool.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if before < 2:
            break
        again = settle(_deal(pool.select("row_no", "length"), salt, partition_pieces, capacity, count), salt)
        after = again.select("sequence_id").distinct().count()
        if after >= before:
            break
        done.append(packed.filter("not open"))
        packed = again
    for df in done:
        packed = packed.unionByName(df)
    return packed.select("row_no", "sequence_id", "offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stage(token_pieces(docs, path, capacity, end_id)
                   .withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    rest = pieces.filter(F.col("length") < capacity).select("row_no", "length")
    places = _places(rest, capacity, partition_pieces)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = pieces.filter(F.col("length") == capacity).withColumn(
        "sequence_id", F.col("row_no").bitwiseOR(F.lit(1 << 62))).withColumn("offset", F.lit(0).cast("long"))
    return full.select(*columns).unionByName(
        pieces.filter(F.col("length") < capacity).join(places, "row_no").select(*columns))
