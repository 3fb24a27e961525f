"""Fragments to visual lines, their measures and the body size of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paideon.functions.fold import fold_values, let
from paideon.functions.text import strip
from paideon.functions.values import array_median, round_tenth, weighted_median
from paideon.operators.columns import column_layout, reading_order
from paideon.operators.fragments import PAGE, with_width

# --- Fixed values ------------------------------------------------------------
SAME_LINE = 0.45
SPACE_GAP = 0.22
CELL_GAP_FACTOR, CELL_GAP_POINTS = 1.5, 10.0
# -----------------------------------------------------------------------------


def row_starts(sorted_fragments: Column) -> Column:
    """Whether each fragment of a page in reading order starts a row.

    A fragment stays in the row while it is close to the row's first fragment, so
    the test carries that fragment along; comparing neighbours would let a row
    drift. The array is one page, which bounds the fold.
    """
    start = F.struct(
        F.lit(-1).cast("long").alias("zone"), F.lit(-1).alias("rank"), F.lit(0.0).alias("y"), F.lit(0.0).alias("font_size"))

    def same(acc: Column, f: Column) -> Column:
        reach = F.greatest(acc["font_size"], f["font_size"], F.lit(1.0)) * SAME_LINE
        return (acc["zone"] == f["zone"]) & (acc["rank"] == f["rank"]) & (F.abs(f["y"] - acc["y"]) <= reach)

    def step(acc: Column, f: Column) -> Column:
        first = F.struct(*[f[n].alias(n) for n in ("zone", "rank", "y", "font_size")])
        return F.when(same(acc, f), acc).otherwise(first)

    return fold_values(sorted_fragments, start, step, "boolean", lambda acc, f: F.when(same(acc, f), False).otherwise(True))


def group_rows(ordered: DataFrame) -> DataFrame:
    """Rows of each page with their number, column and fragments (`parts`) sorted by x.

    The rows are cut out of the page's array, so fragments are brought together once.
    """
    item = F.struct(
        "zone", "rank", (-F.col("y")).alias("up"), "x", "seq", "y", "font_size", "text", "width", "chars", "column",
        "bold", "italic", "mono",
    )
    pages = ordered.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("_f"))
    opened = F.transform(row_starts(F.col("_f")), lambda opens, i: F.when(opens, i))
    placed = pages.withColumn("_s", F.filter(opened, lambda i: i.isNotNull()))

    def part(f: Column) -> Column:
        return F.struct(*[f[n].alias(n) for n in (
            "x", "up", "seq", "width", "font_size", "text", "y", "chars", "bold", "italic", "mono")])

    def row(s: Column, i: Column) -> Column:
        until = F.coalesce(F.get("_s", i + 1), F.size("_f"))
        return F.struct(i.alias("line_no"), F.get("_f", s)["column"].alias("column"),
                        F.sort_array(F.transform(F.slice("_f", s + 1, until - s), part)).alias("parts"))

    return placed.select(*PAGE, F.inline(F.transform("_s", row)))


def line_text(parts: Column) -> Column:
    """Fragments sorted by x to text, with a space where the gap asks for one."""
    def piece(f: Column, i: Column) -> Column:
        prev = F.get(parts, i - 1)
        gap = f["x"] - (prev["x"] + prev["width"])
        spaced = prev["text"].endswith(" ") | f["text"].startswith(" ")
        return F.concat(F.when((i > 0) & (gap > prev["font_size"] * SPACE_GAP) & ~spaced, " ").otherwise(""), f["text"])

    return strip(F.regexp_replace(F.array_join(F.transform(parts, piece), ""), r"(?U)\s+", " "))


def split_cells(parts: Column, size: Column) -> Column:
    """Cells (x, text) of a line: a wide gap opens the next one, empty ones go."""
    wide = F.greatest(size * CELL_GAP_FACTOR, F.lit(CELL_GAP_POINTS))

    def fresh(f: Column, i: Column) -> Column:
        prev = F.get(parts, i - 1)
        return F.when((i == 0) | (f["x"] - (prev["x"] + prev["width"]) >= wide), i)

    def cells(starts: Column) -> Column:
        def cell(s: Column, i: Column) -> Column:
            until = F.coalesce(F.get(starts, i + 1), F.size(parts))
            text = F.array_join(F.transform(F.slice(parts, s + 1, until - s), lambda f: strip(f["text"])), " ")
            return F.struct(F.get(parts, s)["x"].alias("x"), strip(text).alias("text"))

        return F.transform(starts, cell)

    starts = F.filter(F.transform(parts, fresh), lambda i: i.isNotNull())
    return F.filter(let(starts, cells), lambda c: c["text"] != "")


def build_lines(rows: DataFrame) -> DataFrame:
    """Rows of fragments to lines with text, cells and measures."""
    parts = F.col("parts")
    first, alone = F.get(parts, F.lit(0)), F.size(parts) == 1

    def total(chars: Callable[[Column], Column]) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda n, f: n + F.coalesce(chars(f), F.lit(0)))

    def share(flag: str) -> Column:
        marked = total(lambda f: F.when(f[flag], f["chars"])) / F.nullif(total(lambda f: f["chars"]), F.lit(0).cast("long"))
        return F.when(F.exists(parts, lambda f: f[flag]), F.coalesce(marked, F.lit(0.0))).otherwise(0.0)

    def known(field: str) -> Column:
        return F.filter(parts, lambda f: f[field].isNotNull())

    sizes = F.transform(known("font_size"), lambda f: F.struct(
        f["font_size"].alias("v"), F.greatest(f["chars"], F.lit(1)).cast("long").alias("w")))
    # The text is made with the rows, so that the filter does not make it again.
    written = rows.select(*PAGE, F.inline(F.array(F.struct("line_no", "column", "parts", line_text(parts).alias("text")))))
    measured = written.filter(F.col("text") != "").select(
        *PAGE, "line_no",
        F.array_min(F.transform(parts, lambda f: f["x"])).alias("x"),
        F.when(alone, first["y"]).otherwise(array_median(F.transform(known("y"), lambda f: f["y"]))).alias("y"),
        F.when(alone, first["font_size"]).otherwise(weighted_median(sizes)).alias("font_size"),
        *[share(flag).alias(f"{flag}_ratio") for flag in ("bold", "italic", "mono")],
        "column", F.size(parts).cast("long").alias("fragments"), "text", "parts",
    )
    # Bound once, or the size would be worked out again for every fragment.
    return measured.withColumn("cells", let(F.col("font_size"), lambda size: split_cells(parts, size))).drop("parts")


def visual_lines(measured: DataFrame, layout: DataFrame) -> DataFrame:
    """Lines of fragments (with width) in the reading order of their page layout."""
    return build_lines(group_rows(reading_order(measured, layout)))


def lines_of(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, page layouts) of fragments, every page step keyed by page."""
    measured = with_width(fragments)
    layout = column_layout(measured)
    return visual_lines(measured, layout), layout


def body_size(lines: DataFrame) -> DataFrame:
    """Most frequent line size by amount of text; a tie goes to the size seen first."""
    sizes = lines.groupBy("doc_id", round_tenth(F.col("font_size")).alias("size")).agg(
        F.sum(F.greatest(F.length("text"), F.lit(1))).alias("weight"),
        F.min(F.struct("page_no", "line_no")).alias("seen"),
    )
    return sizes.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("weight"), "seen")).alias("body_size"))
