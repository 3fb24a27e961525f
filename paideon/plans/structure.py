"""Whole-corpus document structuring: fragments to sections, blocks and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paideon.functions.values import round_tenth
from paideon.operators.blocks import blocks as build_blocks, elements as number_elements
from paideon.operators.classify import classify, merge_overlines
from paideon.operators.columns import column_layout
from paideon.operators.fragments import DEALT, DRAWN, PAGE, with_chunk, with_width
from paideon.operators.lines import body_size, visual_lines
from paideon.operators.merge import replace_children
from paideon.operators.margins import margin_bands, margin_candidates, margin_marks
from paideon.operators.paragraphs import group_paragraphs, median_leading
from paideon.operators.report import anomalies, quality_report
from paideon.operators.tables import accept_tables, mark_tables, table_runs
from paideon.operators.tree import block_positions, section_tree, sort_paths
from paideon.session import counted_stage, stage

# Stored title length, preview length, lines kept in a block's origin.
MAX_TITLE, PREVIEW_CHARS = 500, 160


@dataclass
class Structure:
    """Stage tables of one run; every one covers all documents."""

    pages: DataFrame
    layout: DataFrame
    lines: DataFrame
    bands: DataFrame
    tables: DataFrame
    paragraphs: DataFrame
    elements: DataFrame
    blocks: DataFrame
    sections: DataFrame

    def report(self) -> DataFrame:
        return quality_report(self.pages, self.layout, self.lines, self.elements, self.blocks, self.sections)

    def anomalies(self) -> DataFrame:
        return anomalies(self.report(), self.elements, self.blocks)


def marked_lines(fragments: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pages, layout, lines with margin and table marks, margin bands, tables).

    Margins come before tables, because boilerplate breaks a run of table rows. The fragments are dealt by
    chunk once and written, as layout and lines both read them more than once; texts are written with the lines and not
    again with the marks.
    """
    sheets = with_chunk(pages)
    dealt = with_chunk(fragments).select(*PAGE, *DRAWN).repartition(*DEALT)
    measured = stage(with_width(dealt), "fragments", DEALT)
    layout = stage(column_layout(measured), "layout", DEALT)
    placed = margin_candidates(visual_lines(measured, layout), sheets)
    # A single cell repeats the text of its line and is never part of a table.
    cells = F.when(F.size("cells") >= 2, F.col("cells")).otherwise(F.array().cast(placed.schema["cells"].dataType))
    candidates = stage(placed.withColumn("cells", cells), "lines", DEALT)
    bands = margin_bands(candidates, sheets)
    runs = table_runs(margin_marks(candidates, bands, body_size(candidates)))
    tables = counted_stage(accept_tables(runs), "tables")
    marks = stage(mark_tables(runs, tables).select(*PAGE, "line_no", "boilerplate", "table_no"), "marks", DEALT)
    return sheets, layout, candidates.join(marks, [*PAGE, "line_no"]), bands, tables


def classified_paragraphs(lines: DataFrame) -> DataFrame:
    return classify(group_paragraphs(lines, median_leading(lines)), body_size(lines), lines)


def structure_documents(fragments: DataFrame, pages: DataFrame) -> Structure:
    """Run the whole chain. Stage tables stand where several steps read one result."""
    sheets, layout, lines, bands, tables = marked_lines(fragments, pages)
    paragraphs = stage(classified_paragraphs(lines), "paragraphs", DEALT)
    elements = stage(number_elements(stage(merge_overlines(paragraphs), "merged", DEALT)), "elements", DEALT)
    built = counted_stage(build_blocks(elements, tables), "blocks")
    headings = elements.filter("kind is null").select("doc_id", "heading_no", "text", "font_size", "confidence",
                                                      "page_start", "page_end")
    sections = counted_stage(section_tree(headings, built), "sections")
    return Structure(sheets, layout, lines, bands, tables, paragraphs, elements, built, sections)


def document_tables(result: Structure) -> tuple[DataFrame, DataFrame]:
    """(sections, blocks) in stored form: cut titles, JSON items and origin."""
    sections = result.sections.select(
        "doc_id", "heading_no", "parent_no", "level", "position",
        F.substring("title", 1, MAX_TITLE).alias("title"), "confidence", "page_start", "page_end")
    table = F.to_json(F.struct("headers", "rows"), {"ignoreNullFields": "false"})
    items = F.when(F.col("kind") == "LIST", F.to_json("items")).when(F.col("rows").isNotNull(), table)
    origin = F.struct(
        "paragraph_count", "line_count",
        F.transform("lines", lambda l: F.struct(
            l["page_no"].alias("page"), round_tenth(l["y"]).alias("y"), round_tenth(l["x"]).alias("x"))).alias("lines"))
    blocks = block_positions(result.blocks).select(
        "doc_id", "heading_no", "position", "kind", "text", items.alias("items"), "confidence",
        "page_start", "page_end", F.to_json(origin).alias("source"))
    return sections, blocks


def write_document_tree(
    files: DataFrame, result: Structure, path: str, previous: str | None = None, buckets: int = 256
) -> None:
    """Write documents, sections and blocks of the imported files under `path`.

    With `previous`, the tables written there before are carried over except for
    the documents of this batch, whose whole tree is replaced. The old folder is
    left as it is, so a failed or repeated run loses nothing.
    """
    sections, blocks = document_tables(result)
    report = result.report().select("doc_id", "pages", F.to_json(F.struct("*")).alias("report"))
    for name, rows in (("documents", files.join(report, "doc_id", "left")), ("sections", sections), ("blocks", blocks)):
        if previous is not None:
            stored = files.sparkSession.read.schema(rows.schema).parquet(f"{previous}/{name}").select(*rows.columns)
            rows = replace_children(stored, files, rows, "doc_id")
        (
            rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
            .repartition("bucket", F.pmod(F.xxhash64("doc_id", *([] if name == "documents" else ["heading_no"])), F.lit(16)))
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        )


def preview(result: Structure) -> DataFrame:
    """Blocks in reading order with their first characters; nothing is written."""
    paths = sort_paths(result.sections).select("doc_id", "heading_no", "path", "title", "level")
    # Cut before the joins, so that whole texts stay where they are.
    cut = result.blocks.select("doc_id", "heading_no", "element_no", "kind", F.substring("text", 1, PREVIEW_CHARS).alias("text"))
    return block_positions(cut).join(paths, ["doc_id", "heading_no"]).select(
        "doc_id", "path", "title", "level", "position", "kind", "text")


def corpus_blocks(files: DataFrame, result: Structure) -> DataFrame:
    """The retrieval corpus: every block with file, section title and pages."""
    titles = result.sections.select("doc_id", "heading_no", F.col("title").alias("section_title"))
    # File and title meet first, so the texts are joined once.
    named = titles.join(files.select("doc_id", "source_file"), "doc_id")
    return (
        result.blocks.join(named, ["doc_id", "heading_no"])
        .select("doc_id", "source_file", "section_title", "element_no", "kind", "text", "page_start", "page_end")
    )


def broken_documents(fragments: DataFrame) -> DataFrame:
    """Documents whose fragments cannot be placed, with the reason."""
    bad = F.lit(False)
    for name in ("x", "y", "font_size"):
        bad = bad | F.col(name).isNull() | F.isnan(name) | (F.abs(F.col(name)) == float("inf"))
    return fragments.filter(bad | F.col("text").isNull()).select("doc_id").distinct().withColumn(
        "error", F.lit("fragment without usable position or text"))


def route_documents(files: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imported, failed) of files with doc_id and create_course, before any structuring."""
    state = files.join(broken_documents(fragments), "doc_id", "left")
    failed = state.filter("error is not null and not create_course")
    return state.filter("error is null or create_course").withColumn("has_tree", F.col("error").isNull()), failed


def import_documents(
    files: DataFrame, fragments: DataFrame, pages: DataFrame
) -> tuple[DataFrame, DataFrame, Structure]:
    """(imported, failed, structure). `files` has doc_id and create_course.

    A broken document with a course keeps its flat sections and gets no tree; a
    reference document has nothing else, so it is reported as failed.
    """
    imported, failed = route_documents(files, fragments)
    good = broken_documents(fragments).select("doc_id")
    result = structure_documents(fragments.join(good, "doc_id", "left_anti"), pages.join(good, "doc_id", "left_anti"))
    return imported, failed, result
