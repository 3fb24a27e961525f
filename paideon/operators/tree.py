"""Section tree from the sequence of headings, without walking it one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paideon.functions.scan import ordered_scan
from paideon.functions.text import strip
from paideon.functions.values import round_tenth
from paideon.session import counted_stage

# --- Fixed values ------------------------------------------------------------
DOTTED = r"(?U)^(\d+(\.\d+)*)[.)]?\s+\S"
MAX_LEVEL, BAND_TOLERANCE = 4, 0.08
INTRODUCTION, INTRODUCTION_CONFIDENCE = "Introduction", 0.5
# -----------------------------------------------------------------------------

CHUNK_HEADINGS = 4096


def numbering_depth(text: Column) -> Column:
    number = F.regexp_extract(strip(text), DOTTED, 1)
    return F.when(number == "", 0).otherwise(F.size(F.split(number, r"\.")))


def size_bands(sizes: Column) -> Column:
    """Distinct heading sizes to array<struct<size, rank>>, largest first.

    A band opens when a size is clearly below the first size of the current band.
    """
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("rank"),
                     F.array().cast("array<struct<size:double,rank:int>>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        opens = acc["anchor"].isNull() | (acc["anchor"] - size > acc["anchor"] * BAND_TOLERANCE)
        rank = acc["rank"] + opens.cast("int")
        return F.struct(F.when(opens, size).otherwise(acc["anchor"]).alias("anchor"), rank.alias("rank"),
                        F.array_append(acc["out"], F.struct(size.alias("size"), rank.alias("rank"))).alias("out"))

    return F.aggregate(F.sort_array(F.array_distinct(sizes), asc=False), start, step, lambda acc: acc["out"])


def heading_levels(headings: DataFrame) -> DataFrame:
    """Headings with `wanted`: the deeper of size band and numbering, at most four."""
    sized = headings.withColumn("size", round_tenth(F.col("font_size")))
    bands = sized.groupBy("doc_id").agg(F.collect_set("size").alias("_sizes")).select(
        "doc_id", F.inline(size_bands(F.col("_sizes"))))
    return sized.join(bands, ["doc_id", "size"]).withColumn(
        "wanted", F.least(F.greatest("rank", numbering_depth(F.col("text"))), F.lit(MAX_LEVEL))
    ).drop("rank", "size")


def place_headings(headings: DataFrame) -> DataFrame:
    """Level, parent and position of every heading.

    The open sections always have the levels 1, 2, ..., d, so a heading that wants
    level w after depth d gets min(d + 1, w). Unrolled, the depth of heading t is
    the minimum of t and of (w_s - s) + t over all headings s up to t: a running
    minimum. Its parent is the latest heading one level up, and its position the
    number of headings of its level since then.
    """
    key, order, chunk = ["doc_id"], ["heading_no"], F.floor(F.col("heading_no") / CHUNK_HEADINGS)
    t = F.col("heading_no")
    depth = counted_stage(ordered_scan(headings, key, order, chunk, mins={"_m": F.col("wanted") - t}).withColumn(
        "level", F.least(t, t + F.col("_m")).cast("int")).drop("_m"), "levels")
    levels = range(1, MAX_LEVEL + 1)
    counted = ordered_scan(depth, key, order, chunk,
                           sums={f"_c{k}": (F.col("level") == k).cast("int") for k in levels})
    latest = {
        f"_p{k}": F.when(F.col("level") == k, F.struct(t.alias("no"), F.col(f"_c{k + 1}").alias("base")))
        for k in levels if k < MAX_LEVEL
    }
    linked = ordered_scan(counted, key, order, chunk, lasts=latest)
    parent, position = F.lit(None).cast("long"), F.col("_c1") - 1
    for k in range(2, MAX_LEVEL + 1):
        here = F.col("level") == k
        parent = F.when(here, F.col(f"_p{k - 1}")["no"]).otherwise(parent)
        position = F.when(here, F.col(f"_c{k}") - F.col(f"_p{k - 1}")["base"] - 1).otherwise(position)
    return linked.withColumns({"parent_no": parent, "position": position}).drop(
        *[f"_c{k}" for k in levels], *latest)


def section_tree(headings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections of every document with page spans; section 0 is the introduction.

    It exists only where blocks stand before any heading, and then comes first
    among the roots.
    """
    spans = blocks.groupBy("doc_id", "heading_no").agg(
        F.min("page_start").alias("_from"), F.max("page_end").alias("_to"))
    intro = spans.filter("heading_no = 0").select(
        "doc_id", F.lit(0).cast("long").alias("heading_no"), F.lit(None).cast("long").alias("parent_no"),
        F.lit(1).alias("level"), F.lit(0).cast("long").alias("position"), F.lit(INTRODUCTION).alias("title"),
        F.lit(INTRODUCTION_CONFIDENCE).alias("confidence"), F.col("_from").alias("page_start"), F.col("_to").alias("page_end"),
    )
    own = place_headings(counted_stage(heading_levels(headings), "headings")).join(spans, ["doc_id", "heading_no"], "left")
    rows = own.join(intro.select("doc_id", F.lit(1).alias("_shift")), "doc_id", "left").select(
        "doc_id", F.col("heading_no").cast("long").alias("heading_no"), "parent_no", "level",
        (F.col("position") + F.when(F.col("level") == 1, F.coalesce("_shift", F.lit(0))).otherwise(0)).alias("position"),
        F.col("text").alias("title"), "confidence",
        F.least("page_start", "_from").alias("page_start"), F.greatest("page_end", "_to").alias("page_end"),
    )
    return rows.unionByName(intro)


def block_positions(blocks: DataFrame) -> DataFrame:
    """Blocks with their position inside their section."""
    first = blocks.groupBy("doc_id", "heading_no").agg(F.min("element_no").alias("_first"))
    return blocks.join(first, ["doc_id", "heading_no"]).withColumn(
        "position", F.col("element_no") - F.col("_first")).drop("_first")


def sort_paths(sections: DataFrame) -> DataFrame:
    """Reading-order path of every section: the positions from the root down.

    At most four levels exist, so the parents are joined level by level.
    """
    done = sections.filter("parent_no is null").withColumn("path", F.array("position"))
    out, layer = done, done
    for level in range(2, MAX_LEVEL + 1):
        up = layer.select("doc_id", F.col("heading_no").alias("parent_no"), F.col("path").alias("_up"))
        layer = sections.filter(F.col("level") == level).join(up, ["doc_id", "parent_no"]).withColumn(
            "path", F.array_append("_up", F.col("position"))).select(*out.columns)
        out = out.unionByName(layer)
    return out


def block_totals(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Number of blocks in the whole subtree of every section."""
    own = blocks.groupBy("doc_id", "heading_no").agg(F.count(F.lit(1)).alias("own"))
    up = sections.select("doc_id", "heading_no", "parent_no")
    rising = up.join(own, ["doc_id", "heading_no"], "left").select(
        "doc_id", "heading_no", "parent_no", F.coalesce("own", F.lit(0)).alias("n"))
    total = rising.select("doc_id", "heading_no", "n")
    layer = rising
    for _ in range(MAX_LEVEL - 1):
        parents = layer.filter("parent_no is not null").groupBy("doc_id", F.col("parent_no").alias("heading_no")).agg(
            F.sum("n").alias("n"))
        layer = parents.join(up, ["doc_id", "heading_no"])
        total = total.unionByName(layer.select("doc_id", "heading_no", "n"))
    return total.groupBy("doc_id", "heading_no").agg(F.sum("n").alias("blocks"))
