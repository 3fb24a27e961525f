"""Headers, footers and page numbers from recurring position bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paideon.functions import text as tx
from paideon.functions.scan import spread_facts
from paideon.operators.fragments import PAGE

# --- Fixed values ------------------------------------------------------------
MARGIN_SHARE, BAND_POINTS, BAND_PAGE_SHARE, BAND_MIN_PAGES = 0.08, 3.0, 0.5, 3
MAX_LENGTH, SMALLER = 120, 0.95
BAND_TEXT = "%s à %dpt du bord sur %d/%d pages (%d lignes)"
# -----------------------------------------------------------------------------


def layout_page_number(text: Column) -> Column:
    return tx.strip(text).rlike(tx.PAGE_NUMBER_LAYOUT)


def _form(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(tx.strip(text), r"(?U)\s+", " "), r"(?U)\d+", "#"))


def margin_candidates(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines with `edge` and `band` when they lie in a margin, NULL otherwise."""
    top, limit = F.col("height") - F.col("y"), F.col("height") * MARGIN_SHARE
    on_page = top.between(F.lit(0), F.col("height")) & F.col("y").between(F.lit(0), F.col("height"))
    short = F.length("text") <= MAX_LENGTH
    edge = F.when(on_page & short & (top <= limit), "HEADER").when(on_page & short & (F.col("y") <= limit), "FOOTER")
    distance = F.when(F.col("edge") == "HEADER", top).otherwise(F.col("y"))
    return (
        lines.join(pages.select(*PAGE, "height"), PAGE).withColumn("edge", edge)
        .withColumn("band", F.when(F.col("edge").isNotNull(), F.rint(distance / BAND_POINTS).cast("int")))
        .drop("height")
    )


def margin_bands(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Bands used on enough pages, with the recurring digit forms found in them.

    A document has few bands: their number is bounded by the height of the margin.
    """
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    key = ["doc_id", "edge", "band"]
    inside = candidates.filter("edge is not null")
    touched = inside.select(*key, "page_no").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("touched"))
    enough = F.greatest(F.lit(BAND_MIN_PAGES), F.floor(F.col("pages") * BAND_PAGE_SHARE))
    bands = touched.filter(F.col("touched") >= BAND_MIN_PAGES).join(counts, "doc_id").withColumn("needed", enough).filter(
        "touched >= needed")
    forms = inside.groupBy(*key, _form(F.col("text")).alias("form")).agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= BAND_MIN_PAGES)
    kept = bands.join(forms, key, "left").groupBy(*key, "touched", "pages").agg(
        F.collect_set(F.when(F.col("n") >= F.col("needed"), F.col("form"))).alias("forms"))
    return kept


def margin_marks(candidates: DataFrame, bands: DataFrame, body: DataFrame) -> DataFrame:
    """Lines with `boilerplate`: PAGE_NUMBER, HEADER, FOOTER or NULL.

    A line in a recurring band still needs a signal of its own: page-number shape,
    smaller type than the body, or a recurring text.
    """
    facts = body.join(
        bands.groupBy("doc_id").agg(F.collect_list(F.struct("edge", "band", "forms")).alias("_bands")), "doc_id", "left")
    hit = F.get(F.filter("_bands", lambda b: (b["edge"] == F.col("edge")) & (b["band"] == F.col("band"))), F.lit(0))
    text = F.col("text")
    number = layout_page_number(text)
    small = (F.col("body_size") > 0) & (F.col("font_size") < F.col("body_size") * SMALLER)
    repeated = F.array_contains(F.col("_hit")["forms"], _form(text))
    return (
        spread_facts(candidates, facts, "doc_id", "chunk").withColumn("_hit", F.when(F.col("edge").isNotNull(), hit))
        .withColumn("boilerplate", F.when(
            F.col("_hit").isNotNull(),
            F.when(number, "PAGE_NUMBER").when(small | repeated, F.col("edge"))))
        .drop("_hit", "_bands")
    )


def margin_report(marks: DataFrame, bands: DataFrame) -> DataFrame:
    """One row per band with marked lines: counts per mark and the report text."""
    marked = marks.filter("boilerplate is not null").groupBy("doc_id", "edge", "band").agg(
        F.count_if(F.col("boilerplate") == "HEADER").alias("headers"),
        F.count_if(F.col("boilerplate") == "FOOTER").alias("footers"),
        F.count_if(F.col("boilerplate") == "PAGE_NUMBER").alias("page_numbers"),
        F.count(F.lit(1)).alias("marked"),
    )
    text = F.format_string(BAND_TEXT, "edge", F.rint(F.col("band") * BAND_POINTS).cast("long"), "touched", "pages", "marked")
    return marked.join(bands.drop("forms"), ["doc_id", "edge", "band"]).select(
        "doc_id", "edge", "band", "headers", "footers", "page_numbers", "marked", text.alias("text"))
