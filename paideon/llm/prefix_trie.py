"""Trie of conversation prefixes by union-find over sorted neighbours.

Turns become 128-bit hashes keyed by their place; a conversation is cut into blocks of
`BLOCK_TURNS` turns, each under the xor of all turns before it, so no conversation has to fit into
one row. Distinct blocks are sorted; the edge between two neighbours carries the length of
their longest common prefix (LCP). Taken in descending order of depth, every edge that
merges two components makes (or widens) the branching node at that depth, and the turns between two
branching nodes are its chain.

A range of rows is such a forest on its own. What no other range can reach is final; the rest, the
paths of its first and last row, is contracted to short rows (a prefix with the sums of what
hangs there), and the short rows of `FAN_IN` neighbouring ranges are a forest again, until one
range is left.

Tokens of a subtree are summed from members: a conversation owns the turns of the nodes of which it
is the smallest member, and what it does not own it shares. The nodes of a first pass say
from which depth on each conversation owns its path; a second pass sums that.

Defined cases: a null role or text is empty; rows without conv_id belong to no conversation; turns go by
(turn with null first, role, text), so repeated rows are turns of their own; an empty table
has no node, not even the root; texts of any length are hashed whole; further columns are not read.
Rows that cannot be told from each other by 128 bits count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paideon.functions.rank import numbered
from paideon.session import stage

BLOCK_TURNS = 64
FAN_IN = 64  # neighbouring ranges merged in one task: some thousand short rows
RUN_ROWS = 50_000  # rows of one forest inside a task; a longer range is merged from several
SPAN_BLOCKS = 1024  # blocks of a conversation whose prefixes are scanned in one window
CHUNK_IDS = 2048
FIRST, LAST = 1, 2  # marks of the outer rows of a range


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), a, b (hashes of the turn), size (code points of its text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # Only the order needs the texts; what is kept of them is two hashes and a length.
    keyed = turns.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64("text", F.lit(1), "role"),
                               "size": F.char_length("text").cast("long")})
    placed = numbered(keyed.select("conv_id", "turn", "role", "text", "a", "b", "size"), order, "pos", ["conv_id"],
                      keep=["conv_id", "a", "b", "size"])
    return stage(placed, "turns")


def rebuilt(turns: DataFrame, group: int = 100, choices: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with the first h turns of the first of their hundred, and all conv_ids.

    h is crc32 of the decimal id modulo `choices`; then follow the own turns after the first h.
    """
    short = turns.filter(F.col("pos") < choices - 1)
    first = stage(short.groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "a", "b", "size"))).alias("opening")), "openings")  # choices - 1 at most
    convs = stage(turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % choices).cast("int").alias("h")
    ).join(first, "base", "left").select("conv_id", "h", F.slice(F.coalesce(
        "opening", F.array().cast(first.schema["opening"].dataType)), F.lit(1), F.col("h")).alias("opening")), "rebuilt")
    opening = convs.select("conv_id", F.inline("opening"))
    own = turns.join(convs.select("conv_id", "h", F.size("opening").alias("n")), "conv_id").filter("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "a", "b", "size")
    return opening.unionByName(own), convs.select("conv_id")


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, k, pa, pb (xor of the turns before the block), pre (their code points), path (a, b, size of its turns), last."""
    keyed = turns.select("conv_id", "pos", F.xxhash64("pos", "a", "b").alias("x"), F.xxhash64("b", "a", "pos").alias("y"), "size")
    cut = keyed.groupBy("conv_id", F.floor(F.col("pos") / BLOCK_TURNS).alias("k")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "size"))),
                              lambda t: F.array(t["x"], t["y"], t["size"]))).alias("path"),
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("size").alias("size"))
    empty = convs.join(turns.filter("pos = 0").select("conv_id"), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("k"), F.array().cast("array<bigint>").alias("path"),
        *[F.lit(0).cast("long").alias(c) for c in ("x", "y", "size")])
    rows = stage(cut.unionByName(empty).withColumn("span", F.floor(F.col("k") / SPAN_BLOCKS)), "blocks")

    def scanned(w, **columns):
        return [F.coalesce(f(c).over(w), F.lit(0)).alias(n) for n, (f, c) in columns.items()]

    parts = {"pa": (F.bit_xor, "x"), "pb": (F.bit_xor, "y"), "pre": (F.sum, "size")}
    totals = rows.groupBy("conv_id", "span").agg(
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("size").alias("size"), F.max("k").alias("top"))
    of_conv = Window.partitionBy("conv_id").orderBy("span")
    carried = totals.select("conv_id", "span", *[c.alias(f"c_{n}") for n, c in zip(parts, scanned(
        of_conv.rowsBetween(Window.unboundedPreceding, -1), **parts))],
        F.max("top").over(of_conv.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("last_k"))
    local = rows.select("*", *scanned(Window.partitionBy("conv_id", "span").orderBy("k").rowsBetween(Window.unboundedPreceding, -1), **parts))
    return stage(local.join(carried, ["conv_id", "span"]).select(
        "conv_id", "k", F.col("pa").bitwiseXOR(F.col("c_pa")).alias("pa"), F.col("pb").bitwiseXOR(F.col("c_pb")).alias("pb"),
        (F.col("pre") + F.col("c_pre")).alias("pre"), "path", (F.col("k") == F.col("last_k")).alias("last")), "prefixed")


# --- one forest ----------------------------------------------------------------------------------------------------
# A row is [(k, pa, pb), pre, path, n, low, low_shared, shared, leaves, kids, marks]: n members of smallest id `low`,
# their summed shared tokens and owned leaves, and children already counted. A component is a list of the same sums.

_N, _LOW, _LOW_SHARED, _SHARED, _LEAVES, _KIDS, _MARKS = range(3, 10)
_NODE = pa.schema([(n, pa.int64()) for n in (
    "depth", "x", "y", "parent_x", "parent_y", "pre", "n", "low", "low_shared", "shared", "leaves", "kids", "k")]
    + [("head", pa.bool_())])
_ROW = pa.schema([(n, pa.int64()) for n in ("part", "k", "pa", "pb", "pre")] + [("path", pa.list_(pa.int64()))]
                 + [(n, pa.int64()) for n in ("n", "low", "low_shared", "shared", "leaves", "kids", "marks")])


def common_depth(a: list, b: list) -> int:
    """Turns that two paths share at their begin."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i // 3
    return n // 3


class Component:
    """Rows that share a prefix; `depth` is that of its top node."""

    __slots__ = ("depth", "row", "sums", "own_marks", "marked")

    def __init__(self, row: list):
        self.depth, self.row, self.sums = len(row[2]) // 3, row, row[_N:_MARKS]
        self.own_marks, self.marked = row[_MARKS], row[_MARKS] != 0


def _added(a: list, b: list) -> list:
    low, shared = min((a[1], a[2]), (b[1], b[2])) if a[0] and b[0] else (a[1:3] if a[0] else b[1:3])
    return [a[0] + b[0], low, shared, a[3] + b[3], a[4] + b[4], a[5] + b[5]]


class Forest:
    """Union-find over sorted rows; `nodes` are final, `short` is what the neighbours may still reach."""

    def __init__(self, rows: list[list]):
        self.nodes: list[tuple] = []
        self.short: list[list] = []
        rows.sort(key=lambda r: (r[0], r[2]))
        self.parent = list(range(len(rows)))
        self.of = [Component(r) for r in rows]
        edges = [(common_depth(rows[i - 1][2], rows[i][2]), i) for i in range(1, len(rows)) if rows[i - 1][0] == rows[i][0]]
        edges.sort(key=lambda e: -e[0])
        for depth, i in edges:
            self._merge(self._find(i - 1), self._find(i), depth)
        for i in range(len(rows)):
            if self.parent[i] == i:
                c = self.of[i]
                self._lift(c, 0)
                self._finish(c, -1)

    def _find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def _merge(self, i: int, j: int, depth: int) -> None:
        a, b = self.of[i], self.of[j]
        self._lift(a, depth)
        self._lift(b, depth)
        a.sums = _added(a.sums, b.sums)
        a.own_marks |= b.own_marks
        a.marked |= b.marked
        self.parent[j] = i

    def _lift(self, c: Component, depth: int) -> None:
        """Make the node at `depth` the top of the component; the one below becomes its child."""
        if c.depth == depth:
            return
        self._finish(c, depth)
        c.sums = [0, 0, 0, 0, 0, 0] if c.marked else [*c.sums[:5], 1]
        c.depth, c.own_marks = depth, 0

    def _finish(self, c: Component, above: int) -> None:
        """Give out the chain of nodes from below `above` down to the top node, or its short row."""
        key, pre, path = c.row[0], c.row[1], c.row[2]
        if c.marked:
            if c.sums[0] or c.own_marks:
                self.short.append([key, pre, path[:3 * c.depth], *c.sums, c.own_marks])
            return
        k, x, y = key
        n, low, low_shared, shared, leaves, kids = c.sums
        up = (0, 0)
        for d in range(c.depth + 1):
            if d > above:
                self.nodes.append((k * BLOCK_TURNS + d, x, y, *up, pre if d == 0 else last, n, low, low_shared, shared, leaves,
                                   kids if d == c.depth else 1, k, d == above + 1))
            if d < c.depth:
                up, last = (x, y), pre
                x, y, pre = x ^ path[3 * d], y ^ path[3 * d + 1], pre + path[3 * d + 2]


def _mark(rows: list[list], first: bool, last: bool) -> list[list]:
    keep = FIRST * first | LAST * last
    for r in rows:
        r[_MARKS] &= keep
    return rows


def _joined(runs: list[list[list]], outer: int = FIRST | LAST) -> Forest:
    """Forest of neighbouring runs; only the outer rows of the first and last run stay marked, if `outer` says so."""
    rows = []
    for i, run in enumerate(runs):
        rows += _mark(run, i == 0 and bool(outer & FIRST), i == len(runs) - 1 and bool(outer & LAST))
    return Forest(rows)


def _read(batch: pa.RecordBatch) -> list[list]:
    c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
    return [[(k, x, y), pre, path, *sums] for k, x, y, pre, path, *sums in zip(
        c["k"], c["pa"], c["pb"], c["pre"], c["path"], c["n"], c["low"], c["low_shared"], c["shared"], c["leaves"], c["kids"], c["marks"])]


def _write(forest: Forest, part: int) -> Iterator[pa.RecordBatch]:
    """Node rows and short rows in one table: the side that a row does not use is null."""
    names = [*(f"node_{f.name}" for f in _NODE), *_ROW.names]
    types = [*(f.type for f in _NODE), *(f.type for f in _ROW)]
    for i in range(0, len(forest.nodes), 10_000):
        some = forest.nodes[i:i + 10_000]
        arrays = [pa.array(list(c), t) for c, t in zip(zip(*some), types)] + [pa.nulls(len(some), f.type) for f in _ROW]
        yield pa.RecordBatch.from_arrays(arrays, names)
    short = [(part, *r[0], *r[1:]) for r in forest.short]
    if short:
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(len(short), f.type) for f in _NODE), *(pa.array(list(c), f.type) for c, f in zip(zip(*short), _ROW))], names)


_SPARK = {pa.int64(): "long", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<bigint>"}
_OUT = ", ".join([*(f"node_{f.name} {_SPARK[f.type]}" for f in _NODE), *(f"{f.name} {_SPARK[f.type]}" for f in _ROW)])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest of one sorted range, run by run."""
    runs, held, part = [], [], 0
    done = Forest([])

    def close(rows: list[list]) -> None:
        rows[0][_MARKS] |= FIRST
        rows[-1][_MARKS] |= LAST
        forest = Forest(rows)
        done.nodes += forest.nodes
        runs.append(forest.short)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        held += _read(batch)
        if len(held) >= RUN_ROWS:
            close(held)
            held = []
            if len(runs) >= FAN_IN:
                forest = _joined(runs)
                done.nodes += forest.nodes
                runs[:] = [forest.short]
            yield from _write(done, part)
            done.nodes = []
    if held:
        close(held)
    if runs:
        forest = _joined(runs) if len(runs) > 1 else None
        done.nodes += forest.nodes if forest else []
        done.short = forest.short if forest else runs[0]
        yield from _write(done, part)


def _merged(top: bool):
    def merge(table: pa.Table) -> pa.Table:
        parts: dict[int, list[list]] = {}
        part_of = table["part"].to_pylist()
        rows = [r for b in table.combine_chunks().to_batches() for r in _read(b)]
        for p, r in zip(part_of, rows):
            parts.setdefault(p, []).append(r)
        forest = _joined([parts[p] for p in sorted(parts)], 0 if top else FIRST | LAST)
        return pa.Table.from_batches(list(_write(forest, min(parts) // FAN_IN)) or [], schema=pa.schema(
            [*(pa.field(f"node_{f.name}", f.type) for f in _NODE), *_ROW]))

    return merge


def forest(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of distinct blocks (k, pa, pb, pre, path, n, low, low_shared, shared, leaves)."""
    by = ["k", "pa", "pb", "path"]
    zero = F.lit(0).cast("long")
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(
        F.spark_partition_id().cast("long").alias("part"), "k", "pa", "pb", "pre", "path",
        *[F.col(c).cast("long").alias(c) for c in ("n", "low", "low_shared", "shared", "leaves")], zero.alias("kids"), zero.alias("marks"))
    level = stage(ranges.mapInArrow(_local, _OUT), "forest")
    found = [level]
    while True:
        short = level.filter("part is not null").select(*_ROW.names)
        ends = short.agg(F.max("part")).first()[0]
        if ends is None:
            break
        top = ends < FAN_IN
        level = stage(short.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(_merged(top), _OUT), "forest")
        found.append(level)
        if top:
            break
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return nodes.filter("node_depth is not null").select(*[F.col(f"node_{f.name}").alias(f.name) for f in _NODE])


def distinct_blocks(block: DataFrame, weights: DataFrame | None) -> DataFrame:
    """One row per block and prefix, with the sums of its members."""
    zero = F.lit(0).cast("long")
    if weights is None:
        weighted = block.select("*", zero.alias("w"), zero.alias("leaf"))
    else:
        weighted = block.join(weights, "conv_id")
    return weighted.groupBy("k", "pa", "pb", "pre", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("conv_id", "w")).alias("least"), F.sum("w").alias("shared"),
        F.sum("leaf").alias("leaves")).select(
        "k", "pa", "pb", "pre", "path", "n", F.col("least.conv_id").alias("low"), F.col("least.w").alias("low_shared"), "shared", "leaves")


def _whole(nodes: DataFrame) -> DataFrame:
    """A node at the edge of two blocks is the end of one and the root of the other."""
    both = nodes.groupBy("depth", "x", "y").agg(
        F.max(F.struct((-F.col("k")).alias("upper"), "n", "low", "low_shared", "shared", "leaves", "pre", "parent_x", "parent_y", "head")).alias("top"),
        F.sum("kids").alias("kids"))
    return both.select("depth", "x", "y", "top.*", "kids").drop("upper")


def _ends(block: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256 of the nodes at which conversations end.

    The ids of a node are joined to pieces in sorted ranges; the hash of one node goes over its pieces
    in one task, which holds one piece at a time.
    """
    path = F.col("path")
    places = F.sequence(F.lit(0), F.size(path) - 1, F.lit(3))

    def folded(start: str, shift: int):
        return F.when(F.size(path) > 0, F.aggregate(places, F.col(start), lambda acc, i: acc.bitwiseXOR(F.get(path, i + shift)))).otherwise(F.col(start))

    ends = block.filter("last").select(
        (F.col("k") * BLOCK_TURNS + F.size(path) / 3).cast("long").alias("depth"),
        folded("pa", 0).alias("x"), folded("pb", 1).alias("y"), "conv_id")
    by = ["depth", "x", "y", "conv_id"]

    def pieces(batches):
        key, ids = None, []

        def out():
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in (*key, ids[0])), pa.array([",".join(map(str, ids))])],
                                              ["depth", "x", "y", "first", "piece"])

        for batch in batches:
            for *k, i in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key or len(ids) >= CHUNK_IDS:
                    if ids:
                        yield out()
                    key, ids = k, []
                ids.append(i)
        if ids:
            yield out()

    def hashed(batches):
        key, code = None, None

        def out():
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in key), pa.array([code.hexdigest()])],
                                              ["depth", "x", "y", "ends_sha256"])

        for batch in batches:
            for *k, piece in zip(*(batch.column(n).to_pylist() for n in ("depth", "x", "y", "piece"))):
                if k != key:
                    if key is not None:
                        yield out()
                    key, code = k, hashlib.sha256(piece.encode())
                else:
                    code.update(b"," + piece.encode())
        if key is not None:
            yield out()

    cut = stage(ends.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        pieces, "depth long, x long, y long, first long, piece string"), "ends")
    return cut.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "first").mapInArrow(
        hashed, "depth long, x long, y long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the turns (conv_id, pos, a, b, size): see the columns below."""
    block = blocks(turns, convs)
    first = _whole(forest(distinct_blocks(block, None)))
    # A conversation owns the nodes of which it is the smallest member: all below what it shares.
    owned = first.groupBy(F.col("low").alias("conv_id")).agg(
        F.min("pre").alias("w"), F.max((F.col("kids") == 0).cast("long")).alias("leaf"))
    total = block.filter("last").select("conv_id", (F.col("pre") + F.aggregate(
        F.transform("path", lambda v, i: F.when(i % 3 == 2, v).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)).alias("total"))
    weights = stage(total.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("w", "total").alias("w"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "weights")
    nodes = stage(_whole(forest(distinct_blocks(block, weights))), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"), F.col("low").alias("up"))
    heads = nodes.filter("head and depth > 0").select("depth", "x", "y", "parent_x", "parent_y").join(
        parents, ["depth", "parent_x", "parent_y"]).select("depth", "x", "y", "up")
    key = ["depth", "x", "y"]
    saved = F.col("shared") - F.col("low_shared") - (F.col("n") - 1) * F.col("pre")
    return (nodes.join(heads, key, "left").join(_ends(block), key, "left").select(
        F.col("low").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("up", "low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie over the conversations as they are."""
    turns = numbered_turns(conversations)
    return trie(turns, turns.select("conv_id").distinct())


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie over the conversations rebuilt on shared openings."""
    turns, convs = rebuilt(numbered_turns(conversations))
    return trie(stage(turns, "rebuilt-turns"), convs)
