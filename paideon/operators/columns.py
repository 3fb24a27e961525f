"""Page columns and reading order from fragment positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from paideon.functions.fold import let
from paideon.functions.values import array_median, round_tenth
from paideon.operators.fragments import PAGE

# --- Fixed values: thresholds and reason texts -------------------------------
GUTTER_FACTOR, GUTTER_POINTS = 1.2, 12.0
FULL_WIDTH = 0.55
BAND_FRAGMENTS, BAND_CHARS, BAND_WIDTH, BAND_ROWS, BAND_FILL = 3, 0.15, 0.15, 6, 0.45
VERTICAL_OVERLAP = 0.5
REASON_FEW = "trop peu de fragments pour conclure"
REASON_NO_WIDTH = "largeur de texte nulle"
REASON_WIDE = "fragments majoritairement pleine largeur"
REASON_NO_GUTTER = "aucune gouttière d'au moins %d pt"
REASON_BAND = {
    1: "une bande ne porte presque aucun texte",
    2: "une bande porte une part négligeable du texte",
    3: "une bande est trop étroite pour une colonne",
    4: "une bande compte trop peu de lignes (tableau ?)",
    5: "une bande est trop irrégulièrement remplie (tableau ?)",
}
REASON_NOT_FACING = "les bandes ne se font pas face verticalement"
REASON_COLUMNS = "%d colonnes séparées par %s"
REASON_ONE_GUTTER = "une gouttière de %d pt"
# -----------------------------------------------------------------------------

_FACING = 9
# Sort key of a full-width fragment: behind the columns of the zone it closes.
_AFTER_COLUMNS = 1_000_000


def _by_start() -> WindowSpec:
    return Window.partitionBy(*PAGE).orderBy("x", "_end")


def _measured(fragments: DataFrame) -> DataFrame:
    """Fragments with the measures of their page and the narrow ones marked.

    The windows of a page name one order, though these need none, so that the rows are sorted once for all of them.
    """
    page = _by_start().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    area = fragments.withColumn("_end", F.col("x") + F.col("width")).withColumns({
        "n": F.count(F.lit(1)).over(page),
        "area_start": F.min("x").over(page),
        "area_end": F.max("_end").over(page),
    }).withColumn("area_width", F.col("area_end") - F.col("area_start"))
    narrow = area.withColumn("narrow", F.col("width") < F.col("area_width") * FULL_WIDTH)
    size = F.when(F.col("narrow"), F.col("font_size"))
    weighted = narrow.withColumns({
        "n_narrow": F.count_if("narrow").over(page),
        "_body": F.percentile(size, F.lit(0.5), F.greatest("chars", F.lit(1))).over(page),
    })
    body = F.when(F.coalesce("_body", F.lit(0.0)) == 0, 10.0).otherwise(F.col("_body"))
    return weighted.withColumn("minimum", F.greatest(body * GUTTER_FACTOR, F.lit(GUTTER_POINTS))).drop("_body")


def _with_gaps(fragments: DataFrame) -> DataFrame:
    """Measured fragments with `_gaps`, the wide enough empty bands of their page, and `_nth`, their place on it.

    The spans are scanned by start with the furthest end so far; a later start
    opens an empty band.
    """
    ends = F.when(F.col("narrow"), F.col("_end"))
    furthest = F.max(ends).over(_by_start().rowsBetween(Window.unboundedPreceding, -1))
    opened = F.col("narrow") & (F.col("x") > F.col("_furthest")) & (
        F.col("x") - F.col("_furthest") >= F.col("minimum"))
    gap = F.when(opened, F.struct(F.col("_furthest").alias("start"), F.col("x").alias("end")))
    page = _by_start().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        _measured(fragments).withColumn("_furthest", furthest).withColumn("_gap", gap)
        .withColumns({"_gaps": F.collect_list("_gap").over(page), "_nth": F.row_number().over(_by_start())})
    )


def gutters(fragments: DataFrame) -> DataFrame:
    """One row per page with its wide enough empty bands, from left to right."""
    return _with_gaps(fragments).filter("_nth = 1").select(
        *PAGE, "n", "n_narrow", "area_start", "area_end", "area_width", "minimum", F.array_sort("_gaps").alias("gutters"))


def _total(values: Column) -> Column:
    """Sum of the known values; NULL when none is known."""
    return F.aggregate(values, F.lit(None).cast("long"), lambda a, v: F.coalesce(a + v, a, v))


def _bands(narrow: Column) -> Column:
    """Narrow fragments of a page to the measures of its bands, from left to right."""
    def band_of(f: Column) -> Column:
        return F.size(F.filter("gutters", lambda g: g["end"] <= f["x"]))

    def band(placed: Column, k: Column) -> Column:
        def measures(own: Column) -> Column:
            low, widths = F.transform(own, lambda f: f["y"]), F.transform(own, lambda f: f["width"])
            tenths = F.filter(F.transform(own, lambda f: f["tenth"]), lambda y: y.isNotNull())
            return F.struct(
                k.alias("band"), F.size(own).alias("members"), _total(F.transform(own, lambda f: f["chars"].cast("long"))).alias("chars"),
                F.size(F.array_distinct(tenths)).alias("rows"), array_median(widths).alias("typical"),
                F.array_max(widths).alias("widest"), F.array_min(low).alias("low"), F.array_max(low).alias("high"))

        return let(F.filter(placed, lambda f: f["band"] == k), measures)

    placed = F.transform(narrow, lambda f: F.struct(*[f[n].alias(n) for n in ("y", "tenth", "width", "chars")], band_of(f).alias("band")))
    listed = let(placed, lambda p: F.transform(F.sequence(F.lit(0), F.size("gutters")), lambda k: band(p, k)))
    return F.filter(listed, lambda b: b["members"] > 0)


def _failed(bands: Column) -> Column:
    """The first check that a band of the page fails, NULL when all pass.

    Bands are judged from left to right, facing only after all of them passed.
    """
    def verdict(all_chars: Column) -> Column:
        def failed(b: Column, i: Column) -> Column:
            after = F.get(bands, i + 1)
            start = F.when(b["band"] == 0, F.col("area_start")).otherwise(F.get("gutters", b["band"] - 1)["end"])
            end = F.coalesce(F.get("gutters", b["band"])["start"], F.col("area_end"))
            shorter = F.least(b["high"] - b["low"], after["high"] - after["low"])
            overlap = F.least(b["high"], after["high"]) - F.greatest(b["low"], after["low"])
            check = (
                F.when(b["members"] < BAND_FRAGMENTS, 1)
                .when(b["chars"] < all_chars * BAND_CHARS, 2)
                .when(end - start < F.col("area_width") * BAND_WIDTH, 3)
                .when(b["rows"] < BAND_ROWS, 4)
                .when(b["typical"] < b["widest"] * BAND_FILL, 5)
            )
            apart = (shorter > 0) & (overlap < shorter * VERTICAL_OVERLAP)
            return let(check, lambda c: F.when(c.isNotNull(), F.struct(F.lit(0).alias("late"), b["band"].alias("band"), c.alias("check")))
                       .when(apart, F.struct(F.lit(1).alias("late"), b["band"].alias("band"), F.lit(_FACING).alias("check"))))

        return F.array_min(F.transform(bands, failed))["check"]

    return let(_total(F.transform(bands, lambda b: b["chars"])), verdict)


def column_layout(fragments: DataFrame) -> DataFrame:
    """One row per page: accepted gutters, column count and the reason of the decision.

    The narrow fragments of a page are gathered where the windows left them, so gutters are found once and no
    band is a group of its own.
    """
    enough = 2 * BAND_FRAGMENTS
    few, flat, wide = F.col("n") < enough, F.col("area_width") <= 0, F.col("n_narrow") < enough
    closed = F.coalesce(few | flat | wide | (F.size("_gaps") == 0), F.lit(False))
    narrow = F.when(F.col("narrow") & ~closed, F.struct("x", "y", round_tenth(F.col("y")).alias("tenth"), "width", "chars"))
    facts = ["n", "n_narrow", "area_start", "area_end", "area_width", "minimum", "_gaps"]
    found = _with_gaps(fragments).groupBy(*PAGE).agg(
        *[F.any_value(c).alias(c) for c in facts], F.collect_list(narrow).alias("_narrow"))
    none = F.array().cast(found.schema["_gaps"].dataType)
    early = (
        F.when(few, F.lit(REASON_FEW)).when(flat, F.lit(REASON_NO_WIDTH)).when(wide, F.lit(REASON_WIDE))
        .when(F.size("gutters") == 0, F.format_string(REASON_NO_GUTTER, F.rint("minimum").cast("long")))
    )
    # The bands of a page without full key are not judged.
    known = F.lit(True)
    for key in PAGE:
        known = known & F.col(key).isNotNull()
    judged = found.withColumn("gutters", F.array_sort(F.coalesce("_gaps", none))).withColumn("_early", early).withColumn(
        "_check", F.when(F.col("_early").isNull() & known, let(_bands(F.col("_narrow")), _failed)))
    band_reason = F.when(F.col("_check") == _FACING, F.lit(REASON_NOT_FACING))
    for number, text in REASON_BAND.items():
        band_reason = band_reason.when(F.col("_check") == number, F.lit(text))
    described = F.array_join(F.transform("gutters", lambda g: F.format_string(
        REASON_ONE_GUTTER, F.rint(g["end"] - g["start"]).cast("long"))), ", ")
    good = F.col("_early").isNull() & F.col("_check").isNull()
    return judged.select(
        *PAGE,
        F.when(good, F.col("gutters")).otherwise(none).alias("gutters"),
        F.when(good, F.size("gutters") + 1).otherwise(1).alias("column_count"),
        F.coalesce("_early", band_reason, F.format_string(REASON_COLUMNS, F.size("gutters") + 1, described)).alias("reason"),
    )


def column_of(gutter_list: Column, x: Column, width: Column) -> Column:
    """Column index, or -1 for text that runs across a gutter."""
    across = F.exists(gutter_list, lambda g: (x < g["start"]) & (x + width > g["end"]))
    return F.when(across, -1).otherwise(F.size(F.filter(gutter_list, lambda g: x >= g["end"])))


def reading_order(fragments: DataFrame, layout: DataFrame) -> DataFrame:
    """Fragments with column, zone and in-zone rank of their reading group.

    A full-width fragment closes the zone above it and forms a group of its own.
    """
    placed = fragments.join(layout.select(*PAGE, "gutters"), PAGE).withColumn(
        "column", column_of(F.col("gutters"), F.col("x"), F.col("width"))
    )
    down = Window.partitionBy(*PAGE).orderBy(F.col("y").desc(), "x", "seq")
    above = F.count_if(F.col("column") == -1).over(down.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumns({
        "zone": F.coalesce(above, F.lit(0)),
        "rank": F.when(F.col("column") == -1, _AFTER_COLUMNS).otherwise(F.col("column")),
    }).drop("gutters")
