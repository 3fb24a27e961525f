"""Token ids in word-aligned Simple-8b blocks.

A 64-bit word holds a selector in its top 4 bits and, in the other 60, as many ids as fit at
the selector's width: 60 of 1 bit down to 1 of 60 bits. Ids of 60 bits and more are escapes:
selector 0 names a raw 64-bit word in the escape area of the segment. Selector 1 is not used.

A segment holds whole documents: a header, offsets of its blocks (words and ids before
each), the words, the escapes, and a directory of documents. No word spans two blocks, so any
block is decoded from its offset alone, and a whole segment by one vector operation per
selector. Segments are the rows of Parquet files that Spark commits, in ascending order of
doc_id over all files, so lost executors leave no partial file and any file system serves.

Defined cases: a null or empty text is one end id; rows that repeat an id follow each other;
rows with null id come first; an empty table gives files without segments; a text of any length is one
document of one segment; further columns
are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paideon.llm.common import ids_and_texts, map_batches, type_of
from paideon.llm.textblocks import row_groups
from paideon.session import stage_root

END_ID = 2
SEGMENT_IDS = 1 << 17  # a segment is closed at the first document end after so many ids
BLOCK_IDS = 1 << 10
MAGIC = b"S8B1"
# Selector -> (ids per word, bits per id); fixed values of the coding.
SELECTORS = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10),
             11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ESCAPE = 0
_HEADER = struct.Struct("<4sIIIII")  # magic, ids, blocks, words, escapes, documents


def _reach(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position the selector of a word that begins there, and how many ids it takes."""
    n = len(ids)
    place = np.arange(n, dtype=np.int32)
    left = np.minimum(BLOCK_IDS - place % BLOCK_IDS, n - place)  # a word ends with its block
    selector, taken = np.full(n, ESCAPE, np.int8), np.ones(n, np.int32)
    largest, fit, wide = int(ids.max()), place, np.zeros(n + 1, np.int32)
    if largest < 1 << 31:
        ids = ids.astype(np.int32)
    for s, (count, bits) in sorted(SELECTORS.items(), reverse=True):
        # Narrower words take more ids, so they fit only where wider ones do. A word need not be full at the
        # end of a block: zeros fill it.
        most = np.minimum(np.int32(count), left[fit])
        if largest >= 1 << bits:
            if 4 * len(fit) > n:
                np.cumsum(ids >= 1 << bits, out=wide[1:])
                ok = wide.take(fit + most) == wide.take(fit)
                fit, most = fit[ok], most[ok]
            else:
                for j in range(count):
                    ok = (ids[np.minimum(fit + j, n - 1)] < 1 << bits) | (most <= j)
                    fit, most = fit[ok], most[ok]
        if not len(fit):
            break
        selector[fit] = s
        taken[fit] = most
    return selector, taken


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words before each block, and escapes of the ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    selector, taken = _reach(ids)
    # All blocks step from word to word together.
    lanes = np.arange(0, n, BLOCK_IDS)
    ends = np.minimum(lanes + BLOCK_IDS, n)
    at, steps = lanes.copy(), []
    while len(at):
        steps.append(at)
        at = at + taken[at]
        going = at < ends
        at, ends = at[going], ends[going]
    begin = np.sort(np.concatenate(steps))
    selector, taken = selector[begin].astype(np.int64), taken[begin]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in SELECTORS.items():
        mine = np.flatnonzero(selector == s)
        if not len(mine):
            continue
        value = np.zeros(len(mine), np.uint64)
        for j in range(count):
            there = taken[mine] > j
            value[there] |= ids[begin[mine][there] + j] << np.uint64(j * bits)
        words[mine] |= value
    escaped = np.flatnonzero(selector == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, np.searchsorted(begin, lanes).astype(np.uint32), ids[begin[escaped]]


def decode(words: np.ndarray, escapes: np.ndarray, n: int, block_words: np.ndarray) -> np.ndarray:
    """The ids of all blocks."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    full = np.ones(16, np.int64)
    for s, (count, _) in SELECTORS.items():
        full[s] = count
    taken = full[selector]
    # The last word of a block may be short: the next block begins at its own id.
    before = np.cumsum(taken) - taken
    block = np.repeat(np.arange(len(block_words)), np.diff(np.append(block_words, len(words))))
    begin = before - before[block_words][block] + block * BLOCK_IDS
    end = np.minimum(np.minimum(begin + taken, (block + 1) * BLOCK_IDS), n)
    out = np.empty(n, np.uint64)
    for s, (count, bits) in SELECTORS.items():
        mine = np.flatnonzero(selector == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count if len(mine) else 0):
            there = mine[begin[mine] + j < end[mine]]
            out[begin[there] + j] = (words[there] >> np.uint64(j * bits)) & mask
    escaped = selector == ESCAPE
    out[begin[escaped]] = escapes[(words[escaped] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A segment of documents, `lengths` ids each."""
    words, block_words, escapes = encode(ids)
    head = _HEADER.pack(MAGIC, len(ids), len(block_words), len(words), len(escapes), len(lengths))
    return b"".join([head, block_words.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
                     np.asarray(lengths).astype("<u4").tobytes()])


def _areas(payload: bytes):
    magic, n, blocks, words, escapes, documents = _HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at, areas = _HEADER.size, []
    for count, kind in ((blocks, "<u4"), (words, "<u8"), (escapes, "<u8"), (documents, "<u4")):
        area = np.frombuffer(payload, kind, count, at)
        areas.append(area)
        at += area.nbytes
    return n, *areas


def read_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a segment and the length of each document."""
    n, block_words, words, escapes, lengths = _areas(payload)
    return decode(words, escapes, n, block_words.astype(np.int64)), lengths.astype(np.int64)


def read_block(payload: bytes, block: int) -> np.ndarray:
    """The ids of one block, from its offset."""
    n, block_words, words, escapes, _ = _areas(payload)
    end = int(block_words[block + 1]) if block + 1 < len(block_words) else len(words)
    size = min(BLOCK_IDS, n - block * BLOCK_IDS)
    return decode(words[int(block_words[block]):end], escapes, size, np.zeros(1, np.int64))


def _write(path: str, end_id: int, id_type: pa.DataType):
    def write(batches):
        from pyspark import TaskContext

        from paideon.llm.tokens import encoder

        tokens, end = encoder(path).encode, np.array([end_id], np.uint32).tobytes()
        shard, before = TaskContext.get().partitionId(), 0
        ids, parts, held = [], [], 0

        def close():
            nonlocal ids, parts, held, before
            lengths = np.array([len(p) // 4 for p in parts], np.int64)
            payload = segment(np.frombuffer(b"".join(parts), np.uint32), lengths)
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([ids], pa.list_(id_type)), pa.array([payload], pa.binary())],
                ["shard", "shard_start", "n_ids", "doc_ids", "payload"])
            before += held
            ids, parts, held = [], [], 0
            return row

        for batch in batches:
            for a, b in row_groups(batch.column(1)):
                for doc, raw in zip(batch.column(0).slice(a, b - a).to_pylist(), tokens(batch.column(1).slice(a, b - a).to_pylist())):
                    ids.append(doc)
                    parts.append(raw + end)
                    held += len(raw) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield close()
        if ids:
            yield close()
        encoder(path).rest()

    return write


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> None:
    """Write the ids of every whole text and its end id to `folder`, in ascending order of doc_id."""
    kind = type_of(docs, "doc_id")
    ordered = ids_and_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    from pyspark.sql.pandas.types import to_arrow_type

    map_batches(ordered, _write(path, end_id, to_arrow_type(kind)), [
        ("shard", T.IntegerType()), ("shard_start", T.LongType()), ("n_ids", T.LongType()),
        ("doc_ids", T.ArrayType(kind)), ("payload", T.BinaryType())]).write.parquet(folder)


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            ids, lengths = read_segment(batch.column(3)[i].as_buffer())
            docs = batch.column(2).slice(i, 1).flatten()
            begin = np.cumsum(lengths) - lengths
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * b:4 * (b + n)]) for b, n in zip(begin.tolist(), lengths.tolist())]
            start = begin + batch.column(1)[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(np.full(len(lengths), batch.column(0)[i].as_py(), np.int32)), pa.array(start),
                 pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def read_ids(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.parquet(folder)
    kind = files.schema["doc_ids"].dataType.elementType
    # One row per shard, that is per task of the writer: small whatever the number of ids.
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("shard", F.coalesce(before, F.lit(0)).alias("ids_before"))
    docs = map_batches(files.select("shard", "shard_start", "doc_ids", "payload"), _read, [
        ("doc_id", kind), ("shard", T.IntegerType()), ("shard_start", T.LongType()), ("n_tokens", T.LongType()),
        ("ids_crc32", T.LongType())])
    return docs.join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("ids_before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    import uuid

    folder = f"{stage_root(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, folder, end_id)
    return read_ids(docs.sparkSession, folder)
