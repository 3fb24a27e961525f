"""Tables: runs of lines split into cells at the same positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paideon.functions.values import array_median
from paideon.operators.fragments import PAGE

# --- Fixed values ------------------------------------------------------------
MIN_ROWS, ALIGN_POINTS, ROW_SPACING = 3, 6.0, 3.0
MAX_LOWERCASE, MAX_MEDIAN_LENGTH = 0.3, 30
MONO_SHARE, BOLD_SHARE = 0.6, 0.6
TABLE_CONFIDENCE = 0.9
# -----------------------------------------------------------------------------


def table_runs(lines: DataFrame) -> DataFrame:
    """Lines with `run`, the first line of their run of split lines, or NULL."""
    page = Window.partitionBy(*PAGE).orderBy("line_no")
    usable = F.col("boilerplate").isNull() & (F.col("mono_ratio") <= MONO_SHARE) & (F.size("cells") >= 2)
    far = F.lag("y").over(page) - F.col("y") > F.greatest(F.lag("font_size").over(page), "font_size", F.lit(1.0)) * ROW_SPACING
    opens = F.col("_use") & (~F.coalesce(F.lag("_use").over(page), F.lit(False)) | F.coalesce(far, F.lit(False)))
    upto = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        lines.withColumn("_use", usable).withColumn("_open", F.when(opens, F.col("line_no")))
        .withColumn("run", F.when(F.col("_use"), F.last("_open", ignorenulls=True).over(upto)))
        .drop("_use", "_open")
    )


def _texts(row: Column) -> Column:
    return F.transform(row["cells"], lambda c: c["text"])


def _average(row: Column) -> Column:
    lengths = F.transform(row["cells"], lambda c: F.length(c["text"]))
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n) / F.size(lengths)


def accept_tables(runs: DataFrame) -> DataFrame:
    """Accepted tables: (page, run) with headers (NULL when not established) and rows."""
    row = F.struct("line_no", "font_size", "bold_ratio", "cells")
    rows = F.col("_rows")
    grouped = runs.filter("run is not null").groupBy(*PAGE, "run").agg(
        F.array_sort(F.collect_list(row)).alias("_rows"), F.max("font_size").alias("_size"),
    ).filter(F.size("_rows") >= MIN_ROWS)

    width = F.size(F.get(rows, F.lit(0))["cells"])
    even = F.forall(rows, lambda r: F.size(r["cells"]) == width)
    tolerance = F.greatest(F.col("_size"), F.lit(ALIGN_POINTS))

    def aligned_at(i: Column) -> Column:
        at = F.transform(rows, lambda r: F.get(r["cells"], i)["x"])
        return F.array_max(at) - F.array_min(at) <= tolerance

    aligned = even & F.forall(F.sequence(F.lit(0), width - 1), aligned_at)
    cells = F.flatten(F.transform(rows, _texts))
    lower = F.size(F.filter(cells, lambda t: t.rlike(r"^\p{Ll}"))) / F.size(cells)
    closed = array_median(F.transform(cells, lambda t: F.length(t).cast("double"))) <= MAX_MEDIAN_LENGTH

    first, others = F.get(rows, F.lit(0)), F.slice(rows, 2, F.size(rows))

    def digits(r: Column) -> Column:
        return F.exists(r["cells"], lambda c: c["text"].rlike(r"\p{Nd}"))

    bold = (first["bold_ratio"] > BOLD_SHARE) & F.forall(others, lambda r: r["bold_ratio"] <= BOLD_SHARE)
    numeric = ~digits(first) & F.exists(others, digits)
    mean_rest = F.aggregate(F.transform(others, _average), F.lit(0.0), lambda a, v: a + v) / F.size(others)
    shorter = _average(first) < mean_rest
    headed = bold.cast("int") + numeric.cast("int") + shorter.cast("int") >= 2
    return (
        grouped.filter(aligned & (lower <= MAX_LOWERCASE) & closed)
        .withColumn("_headed", headed)
        .select(
            *PAGE, "run",
            F.when(F.col("_headed"), _texts(first)).alias("headers"),
            F.transform(F.when(F.col("_headed"), others).otherwise(rows), _texts).alias("rows"),
            F.lit(TABLE_CONFIDENCE).alias("table_confidence"),
        )
    )


def mark_tables(runs: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines with `table_no`, the run of their accepted table, or NULL."""
    accepted = tables.select(*PAGE, "run", F.col("run").alias("table_no"))
    return runs.join(accepted, [*PAGE, "run"], "left").drop("run")
