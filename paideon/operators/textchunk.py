"""Page text to titled sections: boilerplate, headings, paragraphs, bodies.

Lines are rows (doc_id, page_no, line_no, text). Rules that look at one page use
windows over the page; counts that run through a document use `ordered_scan`, so a
very long document is spread over chunks of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paideon.functions import text as tx
from paideon.functions.scan import ordered_scan, spread_facts

# --- Fixed values ------------------------------------------------------------
MARGIN_LINES, SHORT_PAGE = 2, 4
MAX_BOILERPLATE, MIN_PAGES, PAGE_SHARE = 120, 3, 0.25
MAX_HEADING, MAX_ISOLATED_HEADING = 90, 70
FIRST_TITLE = "Introduction"
SUMMARY_LENGTH = 300
WARN_ALL_EMPTY = (
    "Aucun texte n'a pu être extrait — ce PDF est probablement scanné (image sans couche de texte). "
    "Une leçon vide a été créée ; l'OCR n'est pas encore pris en charge."
)
WARN_SOME_EMPTY = "%d page(s) sur %d sans texte extractible, ignorée(s)."
# -----------------------------------------------------------------------------

CHUNK_PAGES = 32

_PAGE = ["doc_id", "chunk", "page_no"]


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) to stripped lines; an empty page gives one blank line."""
    lines = F.split(tx.strip_end(F.col("text")), "\n")
    return pages.select("doc_id", "page_no", F.posexplode(lines).alias("line_no", "raw")).select(
        "doc_id", "page_no", "line_no", tx.strip(F.col("raw")).alias("text")
    )


def with_chunk(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk", F.floor(F.col("page_no") / CHUNK_PAGES))


def margin_flag(lines: DataFrame) -> DataFrame:
    """Mark the first and last visible lines of each page."""
    page = Window.partitionBy(*_PAGE)
    rank = F.count_if(F.col("text") != "").over(page.orderBy("line_no"))
    total = F.count_if(F.col("text") != "").over(page)
    band = F.when(F.col("_n") > SHORT_PAGE, MARGIN_LINES).otherwise(1)
    return (
        lines.withColumns({"_rank": rank, "_n": total})
        .withColumn("in_margin", (F.col("text") != "") & ((F.col("_rank") <= band) | (F.col("_rank") > F.col("_n") - band)))
        .drop("_rank", "_n")
    )


def page_counts(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "page_no").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))


def boilerplate_forms(marked: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per document the exact and digit forms that recur in margins.

    A form is counted once per page. Pages have at most four margin lines and a
    form must be on a quarter of the pages, so a document keeps at most 16 of each.
    """
    text = F.col("text")
    forms = F.array_compact(F.array(
        F.struct(F.lit("exact").alias("kind"), tx.norm_exact(text).alias("form")),
        F.when(tx.is_page_number(text), F.struct(F.lit("digits").alias("kind"), tx.norm_digits(text).alias("form"))),
    ))
    counted = (
        marked.filter(F.col("in_margin") & (F.length("text") <= MAX_BOILERPLATE))
        .select("doc_id", "page_no", F.inline(forms)).distinct()
        .groupBy("doc_id", "kind", "form").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= MIN_PAGES)
    )
    enough = F.greatest(F.lit(MIN_PAGES), F.floor(F.col("pages") * PAGE_SHARE))
    counts = page_counts(marked) if counts is None else counts
    return counted.join(counts, "doc_id").filter(F.col("n") >= enough).select("doc_id", "kind", "form", "n")


def boilerplate_flag(marked: DataFrame, forms: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Mark margin lines whose exact form recurs, or whose page-number form does."""
    kept = forms.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("kind") == "exact", F.col("form"))).alias("_exact"),
        F.collect_set(F.when(F.col("kind") == "digits", F.col("form"))).alias("_digits"),
    )
    text = F.col("text")
    hit = F.array_contains("_exact", tx.norm_exact(text)) | (
        tx.is_page_number(text) & F.array_contains("_digits", tx.norm_digits(text))
    )
    return spread_facts(marked, kept, "doc_id", "chunk", places=places).withColumn(
        "boilerplate", F.col("in_margin") & F.coalesce(hit, F.lit(False))
    ).drop("_exact", "_digits")


def ordered_list_flag(lines: DataFrame) -> DataFrame:
    """Mark runs of two or more visible lines numbered one after the other.

    A line is in such a run exactly when it continues the visible line before it
    or is continued by the one after it.
    """
    page = Window.partitionBy(*_PAGE).orderBy("line_no")
    seen = F.when(F.col("text") != "", F.struct(tx.first_number(F.col("text")).alias("n")))
    before = F.last("_seen", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1))["n"]
    back = Window.partitionBy(*_PAGE).orderBy(F.col("line_no").desc())
    after = F.last("_seen", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))["n"]
    number = F.col("_seen")["n"]
    return (
        lines.withColumn("_seen", seen).withColumns({"_before": before, "_after": after})
        .withColumn("in_list", F.coalesce(number == F.col("_before") + 1, F.lit(False))
                    | F.coalesce(F.col("_after") == number + 1, F.lit(False)))
        .drop("_seen", "_before", "_after")
    )


def isolation(lines: DataFrame) -> DataFrame:
    """Mark the first visible line of a page and lines below a blank one.

    Only the page itself matters: every other line has a visible line above it.
    """
    page = Window.partitionBy(*_PAGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    blank = F.col("text") == ""
    before = F.last(F.when(~F.col("boilerplate"), blank), ignorenulls=True).over(page)
    earlier = F.coalesce(F.count_if(~F.col("boilerplate") & ~blank).over(page), F.lit(0))
    return lines.withColumns({
        "first_visible": ~F.col("boilerplate") & ~blank & (earlier == 0), "_blank_above": before,
    }).withColumn("isolated", F.col("first_visible") | F.coalesce("_blank_above", F.lit(True))).drop("_blank_above")


def is_heading(text: Column, isolated: Column) -> Column:
    """Heading decision for one line that is neither boilerplate nor a list item."""
    capitals = (tx.letter_count(text) >= 3) & (text == F.upper(text))
    weak = (
        isolated & (F.length(text) <= MAX_ISOLATED_HEADING) & ~text.rlike(tx.SENTENCE_END)
        & ~text.rlike(tx.LEADING_FUNCTION_WORD) & text.rlike(r"^\p{Lu}")
    )
    decided = F.when(text.rlike(tx.NUMBERED_HEADING), ~tx.is_footnote(text)).otherwise(capitals | weak)
    return (text != "") & (F.length(text) <= MAX_HEADING) & decided


def classify_lines(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """All page-level decisions: margin, boilerplate, list, isolation, heading.

    `pages` lists the same pages as the lines do and saves splitting them again to count them.
    """
    # One shuffle by chunk serves every page window, the join and the scans below.
    marked = margin_flag(with_chunk(lines).repartition("doc_id", "chunk"))
    sheets = with_chunk(lines if pages is None else pages)
    flagged = boilerplate_flag(marked, boilerplate_forms(marked, page_counts(sheets)), sheets)
    listed = isolation(ordered_list_flag(flagged))
    return listed.withColumn(
        "heading", ~F.col("boilerplate") & ~F.col("in_list") & is_heading(F.col("text"), F.col("isolated"))
    )


def assign_sections(classified: DataFrame) -> DataFrame:
    """Surviving lines with section and paragraph numbers and their title.

    Section 0 is the text before any heading. A blank line or heading closes a
    paragraph; a page break does not.
    """
    live = classified.filter(~F.col("boilerplate"))
    scanned = ordered_scan(
        live.withColumn("_gap", F.col("heading") | (F.col("text") == "")), ["doc_id"], ["page_no", "line_no"], F.col("chunk"),
        sums={"section_no": F.col("heading").cast("int"), "paragraph_no": F.col("_gap").cast("int")},
        lasts={"_title": F.when(F.col("heading"), F.col("text"))},
        prevs={"_gap_above": F.col("_gap")},
    )
    return scanned.withColumns({
        "starts_paragraph": F.coalesce("_gap_above", F.lit(True)),
        "title": F.coalesce("_title", F.lit(FIRST_TITLE)),
    }).select("doc_id", "page_no", "line_no", "text", "heading", "section_no", "paragraph_no", "starts_paragraph", "title")


def paragraphs(sectioned: DataFrame) -> DataFrame:
    """Paragraph texts: lines joined by a space."""
    content = sectioned.filter(~F.col("heading") & (F.col("text") != ""))
    listed = F.array_sort(F.collect_list(F.struct("page_no", "line_no", "text")))
    return content.groupBy("doc_id", "section_no", "paragraph_no").agg(
        F.array_join(F.transform(listed, lambda e: e["text"]), " ").alias("text")
    )


def section_bodies(sectioned: DataFrame) -> DataFrame:
    """Sections with text, one row each: lines joined by a space, paragraphs by a blank line."""
    content = sectioned.filter(~F.col("heading") & (F.col("text") != ""))
    grouped = content.groupBy("doc_id", "section_no").agg(
        F.any_value("title").alias("title"),
        F.array_sort(F.collect_list(F.struct("page_no", "line_no", "starts_paragraph", "text"))).alias("_pieces"),
    )
    spelled = F.array_join(F.transform("_pieces", lambda e: F.concat(
        F.when(e["starts_paragraph"], F.lit("\n\n")).otherwise(F.lit(" ")), e["text"])), "")
    return grouped.select("doc_id", "section_no", "title", F.regexp_replace(spelled, r"^\s+", "").alias("body"))


def chunk_pages(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Lines to section bodies, the whole chain."""
    return section_bodies(assign_sections(classify_lines(lines, pages)))


def import_summary(files: DataFrame, pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """Title, page counts, warning and lesson summary of each imported file."""
    counts = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.count_if(tx.strip(F.col("text")) == "").alias("empty_pages")
    )
    first = bodies.groupBy("doc_id").agg(
        F.min_by(F.substring("body", 1, SUMMARY_LENGTH), "section_no").alias("summary")
    )
    warning = F.when(F.col("empty_pages") == F.col("page_count"), F.lit(WARN_ALL_EMPTY)).when(
        F.col("empty_pages") > 0, F.format_string(WARN_SOME_EMPTY, "empty_pages", "page_count")
    )
    return (
        files.select("doc_id", "source_file").join(counts, "doc_id").join(first, "doc_id", "left")
        .select("doc_id", tx.title_from_file_name(F.col("source_file")).alias("title"), "page_count", "empty_pages",
                warning.alias("warning"), "summary")
    )
