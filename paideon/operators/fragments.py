"""Draw calls to positioned text fragments.

Draw calls are rows (doc_id, page_no, seq, kind, text, tm, cm, operands, font_name,
font_size): `kind` is text, Td, TD or Tm; tm and cm are the text and current
matrices (six doubles); `operands` are those of a positioning operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paideon.functions.text import strip

# --- Fixed values: font-name marks -------------------------------------------
BOLD_MARKS = "bold|demi|black|heavy|semib"
ITALIC_MARKS = "italic|ital|oblique"
MONO_MARKS = "mono|courier|consol"
WIDTH_PER_CHAR = 0.5
# -----------------------------------------------------------------------------

CHUNK_PAGES = 32
PAGE = ["doc_id", "chunk", "page_no"]
# The rows of a document are dealt by these columns through the whole chain.
DEALT = ["doc_id", "chunk"]
# What the chain reads of a fragment beside its page.
DRAWN = ["seq", "text", "x", "y", "font_size", "bold", "italic", "mono"]


def with_chunk(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk", F.floor(F.col("page_no") / CHUNK_PAGES))


def compose(tm: Column, cm: Column) -> Column:
    """Affine product tm x cm as a six-element array."""
    return F.array(
        tm[0] * cm[0] + tm[1] * cm[2],
        tm[0] * cm[1] + tm[1] * cm[3],
        tm[2] * cm[0] + tm[3] * cm[2],
        tm[2] * cm[1] + tm[3] * cm[3],
        tm[4] * cm[0] + tm[5] * cm[2] + cm[4],
        tm[4] * cm[1] + tm[5] * cm[3] + cm[5],
    )


def _moved(tm: Column, by: Column) -> Column:
    """Text matrix after the relative move of a Td operator."""
    return F.array(
        tm[0], tm[1], tm[2], tm[3],
        by[0] * tm[0] + by[1] * tm[2] + tm[4],
        by[0] * tm[1] + by[1] * tm[3] + tm[5],
    )


def positioned_calls(calls: DataFrame) -> DataFrame:
    """Text calls with x, y and effective size.

    A text matrix at the origin is replaced by the one the last positioning
    operator before the call set up.
    """
    tm, cm, by = F.col("tm"), F.col("cm"), F.col("operands")
    pending = F.when(F.col("kind").isin("Td", "TD") & (F.size(by) >= 2), compose(_moved(tm, by), cm)).when(
        (F.col("kind") == "Tm") & (F.size(by) >= 6), compose(F.slice(by, 1, 6), cm)
    )
    before = Window.partitionBy(*PAGE).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("_own")
    lost = (own[4] == 0) & (own[5] == 0) & F.col("_pending").isNotNull()
    return (
        with_chunk(calls).withColumn("_set", pending)
        .withColumns({"_pending": F.last("_set", ignorenulls=True).over(before), "_own": compose(tm, cm)})
        .filter("kind = 'text'")
        .withColumn("_m", F.when(lost, F.col("_pending")).otherwise(own))
        .select(*PAGE, "seq", "text", "font_name", F.col("_m")[4].alias("x"), F.col("_m")[5].alias("y"),
                (F.col("font_size") * F.hypot(F.col("_m")[2], F.col("_m")[3])).alias("font_size"))
    )


def repair_positions(calls: DataFrame) -> DataFrame:
    """Give calls still at the origin the next valid position, or else the last one."""
    page = Window.partitionBy(*PAGE)
    back = page.orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = page.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valid = F.when((F.col("x") != 0) | (F.col("y") != 0), F.struct("x", "y"))
    return (
        calls.withColumn("_at", valid)
        .withColumn("_next", F.last("_at", ignorenulls=True).over(back))
        .withColumn("_prev", F.last("_at", ignorenulls=True).over(ahead))
        .withColumn("_use", F.coalesce("_next", "_prev"))
        .withColumns({"x": F.coalesce(F.col("_use")["x"], F.col("x")), "y": F.coalesce(F.col("_use")["y"], F.col("y"))})
        .drop("_at", "_next", "_prev", "_use")
    )


def style_flags(rows: DataFrame) -> DataFrame:
    """Bold, italic and mono from the font name without slash and subset prefix."""
    name = F.substring_index(F.regexp_replace(F.coalesce("font_name", F.lit("")), "^/+", ""), "+", -1)
    low = F.lower("font_name")
    return rows.withColumn("font_name", name).withColumns({
        "bold": low.rlike(BOLD_MARKS), "italic": low.rlike(ITALIC_MARKS), "mono": low.rlike(MONO_MARKS),
    })


def fragments_of(calls: DataFrame) -> DataFrame:
    """Draw calls to fragments; blank text goes only after the repair, which may need it."""
    repaired = repair_positions(positioned_calls(calls))
    return style_flags(repaired.filter(strip(F.col("text")) != ""))


def approx_width(text: Column, size: Column) -> Column:
    return F.length(text) * size * WIDTH_PER_CHAR


def with_width(fragments: DataFrame) -> DataFrame:
    """Fragments with their page chunk, width and number of stripped characters."""
    return with_chunk(fragments).withColumns({
        "width": approx_width(F.col("text"), F.col("font_size")), "chars": F.length(strip(F.col("text"))),
    })
