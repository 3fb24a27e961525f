"""Near-duplicate groups by HyperMinHash.

A sketch has one 16-bit register per bucket: of the smallest shingle hash in the bucket the
count of leading zeros (6 bits) and the mantissa bits after them (10 bits). One hash per
shingle fills all buckets; empty buckets borrow from filled ones by fixed probes, so small
sets collide like large ones. Bands of registers propose pairs. The share of equal
registers, less the collisions that equal-looking minima of different shingles make,
estimates the Jaccard similarity, and what may reach the threshold is verified on full sets.

Documents with the same shingle set are one class, represented by its row of the smallest id, so exact
and shuffled copies cost nothing after the first pass. Buckets of up to `PAIR_LIMIT` classes
propose all their pairs. Larger ones propose a star, which only says that their classes
must be compared with each other: classes that hang together are cut into blocks, and all
pairs of blocks are compared inside tasks, so that no pair is lost and none is emitted
unless it is a link that joins two so far separate parts of a block.

Defined cases: null, empty or blank text has an empty set and links with nothing; a text
with fewer words than a shingle is one shingle; rows that repeat an id are judged each
by its own text; null ids link with nothing and are their own (null) component; an empty
table gives an empty result; texts of any length are shingled whole; a pair exactly at the threshold is a link;
further columns of any name pass through `first_of_groups`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paideon.llm.common import ids_and_texts, map_batches, row_key, without
from paideon.llm.components import components
from paideon.llm.textblocks import mix, row_groups, window_hashes, words_of
from paideon.session import stage

BANDS, BAND_ROWS = 40, 6  # a pair at 0.8 shares no band with probability 5e-6
REGISTERS = BANDS * BAND_ROWS
MANTISSA_BITS = 10
THRESHOLD = (80, 100)
ESTIMATE_FLOOR = 0.62  # below the threshold by six standard errors of 240 registers
PAIR_LIMIT = 16  # classes of a bucket whose pairs are listed
BLOCK = 1024  # classes of a block
BLOCK_SHINGLES = 2_000_000  # and their shingles, about
_PROBES = 64


def shingle_sets(column: pa.Array, a: int, b: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after the other, and where rows begin."""
    words = words_of(column, a, b, lower=True)
    hashes, starts = window_hashes(words, size)
    row = words.rows[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):  # the whole sequence as one shingle
        first, n = words.first[short], words.counts[short]
        value = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            more = n > j
            value[more] = mix(value[more] + words.hashes[first[more] + j] + np.uint64(j + 1))
        hashes, row = np.concatenate([hashes, mix(value + np.uint64(99))]), np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(b - a + 1))


def registers(hashes: np.ndarray, first: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """Sketches (rows x count, uint16) of sets; a row with an empty set is all zero."""
    rows = len(first) - 1
    size = np.diff(first)
    row = np.repeat(np.arange(rows), size)
    bucket = ((hashes >> np.uint64(40)) * np.uint64(count) >> np.uint64(24)).astype(np.int64)
    value = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    cell = row * count + bucket
    order = np.lexsort((value, cell))
    cell, value = cell[order], value[order]
    head = np.ones(len(cell), bool)
    head[1:] = cell[1:] != cell[:-1]
    cell, value = cell[head], value[head]
    # Leading zeros by the exponent of a float; the mantissa follows the first one bit.
    zeros = np.clip(62 - np.log2(np.maximum(value >> np.uint64(1), np.uint64(1)).astype(np.float64)).astype(np.int64), 0, 62)
    over = (value << zeros.astype(np.uint64)) >> np.uint64(63) == 0
    zeros[over] += 1
    mantissa = (value << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    out = np.zeros(rows * count, np.uint16)
    out[cell] = ((zeros + 1).astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)
    out = out.reshape(rows, count)
    _densify(out, size > 0)
    return out


def _densify(table: np.ndarray, filled_row: np.ndarray) -> None:
    """Give empty registers the value of the first filled one on their own fixed path."""
    filled = table > 0
    row, at = np.nonzero(~filled & filled_row[:, None])
    count = table.shape[1]
    source = table.copy()
    for probe in range(1, _PROBES * 8):
        if not len(row):
            return
        step = mix(at.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(probe))
        there = (step % np.uint64(count)).astype(np.int64)
        ok = filled[row, there]
        table[row[ok], at[ok]] = source[row[ok], there[ok]]
        row, at = row[~ok], at[~ok]
    for r in np.unique(row):  # as good as never: take the first filled register
        table[r, at[row == r]] = source[r, np.flatnonzero(filled[r])[0]]


def expected_collisions() -> float:
    """Chance that minima of different shingles give equal registers: same leading zeros, same mantissa.

    For one shingle per bucket; with more the chance is about half of it.
    """
    zeros = sum(4.0 ** -(k + 1) for k in range(62))
    return zeros / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of sketches along the last axis."""
    share = (a == b).mean(-1)
    chance = expected_collisions()
    return np.clip((share - chance) / (1 - chance), 0, 1)


_CLASS = [("text_hash", T.LongType()), ("n_shingles", T.LongType()), ("set_hash", T.LongType()), ("set_check", T.LongType()), ("sketch", T.BinaryType())]


def _sketch(size: int):
    def sketch(batches):
        for batch in batches:
            for a, b in row_groups(batch.column(1), 2 << 20):
                hashes, first = shingle_sets(batch.column(1), a, b, size)
                n = np.diff(first)
                table = registers(hashes, first)
                total, check = _sums(hashes, first), _sums(mix(hashes + np.uint64(7)), first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(total.view(np.int64)),
                     pa.array(check.view(np.int64)), pa.array([r.tobytes() if k else None for r, k in zip(table, n)], pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "set_hash", "set_check", "sketch"])

    return sketch


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values)])
    return mix(sums[first[1:]] - sums[first[:-1]])


def _band_keys(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
        key = np.zeros(table.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(BAND_ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + table[:, :, j])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.repeat(np.arange(len(table)), BANDS))), pa.array(key.reshape(-1).view(np.int64))],
            ["id", "band"])


def _near(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            near = pa.array(estimate(a, b) >= ESTIMATE_FLOOR)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])


def proposals(classes: DataFrame) -> DataFrame:
    """Links (a, b) that hold together all classes which may be similar; not yet verified."""
    bands = map_batches(classes.select("id", "sketch"), _band_keys, [("id", T.LongType()), ("band", T.LongType())])
    sizes = stage(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
                  .filter("n > 1"), "buckets")
    several = stage(bands.join(sizes.filter("n > 2").select("band", "n", "low"), "band"), "several")
    star = several.filter((F.col("n") > PAIR_LIMIT) & (F.col("id") > F.col("low"))).select(
        F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    few = several.filter(F.col("n") <= PAIR_LIMIT)
    listed = few.select("band", F.col("id").alias("a")).join(few.select("band", F.col("id").alias("b")), "band").filter("a < b")
    pairs = sizes.filter("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(
        listed.select("a", "b")).distinct()
    sketches = classes.select("id", "sketch")
    fetched = (pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a")
               .join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y"))
    return map_batches(fetched, _near, [("a", T.LongType()), ("b", T.LongType())]).unionByName(star)


def links_within(ids: np.ndarray, hashes: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray,
                 threshold=THRESHOLD) -> list[tuple[int, int]]:
    """Links that join separate parts, from comparing each `left` row with all `right` rows.

    Rows that agree with most others come first, so the bulk of a group is joined after a
    few of them and only the rows outside it are left to compare.
    """
    need, of = threshold
    size = np.diff(first)
    sketch = registers(hashes, first)
    vocabulary, local = np.unique(hashes, return_inverse=True)
    part = np.arange(len(ids))
    order = left
    if len(left) > 64:
        common = np.array([np.bincount(c).argmax() for c in sketch.T])
        order = left[np.argsort(-(sketch[left] == common).sum(1), kind="stable")]
    mark = np.zeros(len(vocabulary), bool)
    found = []
    for x in order.tolist():
        if not size[x]:
            continue
        other = right[(part[right] != part[x]) & (size[right] > 0)]
        # Sizes first, then the estimate, then the full sets.
        small, large = np.minimum(size[other], size[x]), np.maximum(size[other], size[x])
        other = other[of * small >= need * large]
        if len(other):
            other = other[estimate(sketch[other], sketch[x]) >= ESTIMATE_FLOOR]
        if not len(other):
            continue
        mark[local[first[x]:first[x + 1]]] = True
        n = size[other]
        at = np.arange(int(n.sum())) + np.repeat(first[other] - (np.cumsum(n) - n), n)
        shared = np.add.reduceat(mark[local[at]].astype(np.int64), np.cumsum(n) - n)
        mark[local[first[x]:first[x + 1]]] = False
        for y in other[of * shared >= need * (n + size[x] - shared)].tolist():
            if part[y] != part[x]:
                found.append((int(ids[x]), int(ids[y])))
                part[part == part[y]] = part[x]
    return found


def _verify(size: int, threshold):
    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table["text"].chunk(0) if table.num_rows else pa.array([], pa.string())
        hashes, first = shingle_sets(texts, 0, len(texts), size) if len(texts) else (np.zeros(0, np.uint64), np.zeros(1, int))
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        every = np.arange(len(ids))
        left, right = every[side < 2], every[side > 0]
        found = links_within(ids, hashes, first, left, right, threshold)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return verify


def verified_links(members: DataFrame, texts: DataFrame, size: int, threshold=THRESHOLD) -> DataFrame:
    """Links among members (id, component, n_shingles), each group compared block by block."""
    counts = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sized = members.join(counts, "component")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = sized.select("id", "component", "blocks", block.alias("block"))
    # Task (i, j) compares blocks i <= j: side 1 is in both, 0 left only, 2 right only.
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("block", j).alias("i"), F.greatest("block", j).alias("j"),
        F.when(F.col("block") == j, 1).when(F.col("block") < j, 0).otherwise(2).alias("side")))
    dealt = placed.select("id", "component", F.inline(tasks))
    return (dealt.join(texts, "id").groupBy("component", "i", "j")
            .applyInArrow(_verify(size, threshold), "a long, b long"))


def memberships(docs: DataFrame, size: int = 2, threshold=THRESHOLD) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row."""
    read = ids_and_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    rows = stage(map_batches(read, _sketch(size), [("doc_id", T.LongType()), *_CLASS]), "sketches")
    named = rows.filter("n_shingles > 0 and doc_id is not null")
    identity = ["n_shingles", "set_hash", "set_check"]
    # A class has a number of its own: ids may repeat.
    classes = stage(named.groupBy(*identity).agg(F.min(F.struct("doc_id", "text_hash", "sketch")).alias("least")).select(
        F.monotonically_increasing_id().alias("id"), *identity, "least.*"), "classes")
    loose = stage(components(proposals(classes.select("id", "sketch"))).join(
        classes.select("id", "n_shingles", "doc_id", "text_hash"), "id"), "loose")
    # Rows equal in id and text are one text. The loose rows grow with the documents, so the join is shuffled at every size.
    texts = read.join(loose.select("id", "doc_id", "text_hash").hint("merge"), ["doc_id", "text_hash"]).groupBy("id").agg(F.first("text").alias("text"))
    found = components(verified_links(loose.select("id", "component", "n_shingles"), texts, size, threshold))
    of_class = classes.select(*identity, "id", "doc_id").join(found, "id", "left").select(
        *identity, "doc_id", F.coalesce("component", "id").alias("component"))
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = rows.join(of_class.join(least, "component").select(*identity, "component_id"), identity, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def groups(docs: DataFrame, size: int = 2, threshold=THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return memberships(docs, size, threshold).drop("text_hash")


def first_of_groups(docs: DataFrame, size: int = 5, threshold=THRESHOLD) -> DataFrame:
    """The documents that are the smallest id of their group."""
    return without(docs, stage(memberships(docs, size, threshold).filter("not kept").select(*row_key()).distinct(), "near"))
