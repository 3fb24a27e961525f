"""Quality report and points to check of every structured document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paideon.operators.classify import AMBIGUOUS

# --- Fixed values ------------------------------------------------------------
SCANNED_SHARE, OVERSIZED = 0.2, 6000
BLOCK_COUNTERS = {"lists": "LIST", "code_blocks": "CODE", "tables": "TABLE", "formulas": "FORMULA", "captions": "CAPTION"}
MSG_SCANNED = ("Extraction textuelle insuffisante : ce PDF est probablement scanné. L'OCR n'est pas pris en charge.")
MSG_HEADING = "Titre incertain : « %s »"
MSG_UNKNOWN = "Élément non classé : « %s »"
MSG_TABLE = ("Tableau de %d lignes sans ligne d'en-tête identifiable : toutes les lignes sont livrées comme des données.")
MSG_OVERSIZED = "Bloc anormalement long (%d caractères) : une frontière de paragraphe a probablement été manquée."
MSG_COLUMNS = ("%d page(s) lue(s) en colonnes : le texte a été réordonné colonne par colonne. "
               "À vérifier si le document contient des tableaux.")
MSG_EMPTY = "%d page(s) sans texte extractible, ignorée(s)."
MSG_NO_HEADING = "Aucun titre détecté : le document est livré en une seule section."
# -----------------------------------------------------------------------------


def quality_report(
    pages: DataFrame, layout: DataFrame, marked: DataFrame, paragraphs: DataFrame, blocks: DataFrame, sections: DataFrame
) -> DataFrame:
    """One row per document with all counters. Every stage is counted on its own first."""
    n = F.count(F.lit(1))
    base = pages.groupBy("doc_id").agg(n.alias("pages"))
    lined = marked.select("doc_id", "page_no").distinct().groupBy("doc_id").agg(n.alias("text_pages"))
    removed = marked.groupBy("doc_id").agg(F.count("boilerplate").alias("boilerplate_removed"))
    columns = layout.groupBy("doc_id").agg(F.count_if(F.col("column_count") > 1).alias("multi_column_pages"))
    typed = paragraphs.groupBy("doc_id").agg(
        n.alias("paragraphs"), F.count_if(F.col("type") == "HEADING").alias("headings"),
        F.avg("confidence").alias("average_confidence"))
    kinds = blocks.groupBy("doc_id").agg(
        n.alias("blocks"), *[F.count_if(F.col("kind") == kind).alias(name) for name, kind in BLOCK_COUNTERS.items()])
    nodes = sections.groupBy("doc_id").agg(
        F.count_if(F.col("level") == 1).alias("sections"), F.count_if(F.col("level") > 1).alias("subsections"))
    out = base
    for part in (lined, removed, columns, typed, kinds, nodes):
        out = out.join(part, "doc_id", "left")
    counters = [c for c in out.columns if c not in ("doc_id", "pages", "average_confidence")]
    share = F.col("text_pages") / F.col("pages")
    return (
        out.fillna(0, counters).fillna(0.0, ["average_confidence"])
        .withColumns({
            "text_extraction_confidence": share,
            "document_type": F.when(share < SCANNED_SHARE, "SCANNED").otherwise("TEXT"),
            "empty_pages": F.col("pages") - F.col("text_pages"),
        }).drop("text_pages")
    )


def _row(kind: str, message: Column, page: Column | None = None, confidence: Column | None = None) -> list[Column]:
    return [
        F.col("doc_id"), F.lit(kind).alias("kind"), message.alias("message"),
        (F.lit(None) if page is None else page).cast("int").alias("page"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"),
    ]


def anomalies(report: DataFrame, paragraphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Points to check. A scanned document is reported as such and nothing else."""
    scanned = report.filter("document_type = 'SCANNED'")
    readable = report.filter("document_type <> 'SCANNED'")
    start = F.substring("text", 1, 70)
    headings = paragraphs.filter((F.col("type") == "HEADING") & (F.col("confidence") < AMBIGUOUS))
    unknown = paragraphs.filter("type = 'UNKNOWN'")
    bare = blocks.filter("kind = 'TABLE' and headers is null and rows is not null")
    oversized = blocks.withColumn("size", F.length("text")).filter(F.col("size") > OVERSIZED)
    found = (
        headings.select(*_row("AMBIGUOUS_HEADING", F.format_string(MSG_HEADING, start), F.col("page_start"), F.col("confidence")))
        .unionByName(unknown.select(*_row("UNKNOWN_ELEMENT", F.format_string(MSG_UNKNOWN, start), F.col("page_start"),
                                          F.col("confidence"))))
        .unionByName(bare.select(*_row("TABLE_WITHOUT_HEADERS", F.format_string(MSG_TABLE, F.size("rows")),
                                       F.col("page_start"), F.lit(0.9))))
        .unionByName(oversized.select(*_row("OVERSIZED_BLOCK", F.format_string(MSG_OVERSIZED, F.col("size")),
                                            F.col("page_start"))))
        .join(scanned.select("doc_id"), "doc_id", "left_anti")
    )
    whole = (
        readable.filter("multi_column_pages > 0").select(*_row("MULTI_COLUMN", F.format_string(MSG_COLUMNS, "multi_column_pages")))
        .unionByName(readable.filter("empty_pages > 0").select(*_row("EMPTY_PAGES", F.format_string(MSG_EMPTY, "empty_pages"))))
        .unionByName(readable.filter("headings = 0 and paragraphs > 0").select(*_row("NO_HEADINGS", F.lit(MSG_NO_HEADING))))
    )
    return scanned.select(*_row("SCANNED_DOCUMENT", F.lit(MSG_SCANNED), None, F.col("text_extraction_confidence"))
                          ).unionByName(found).unionByName(whole)
