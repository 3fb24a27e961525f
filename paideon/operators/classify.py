"""Element types of paragraphs by weighted signals, and overline headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paideon.functions import text as tx
from paideon.functions.scan import ordered_scan, spread_facts
from paideon.functions.values import round_tenth
from paideon.operators.paragraphs import measures

# --- Fixed values: patterns, word lists, weights and reason texts ------------
NUMBERED = (
    r"(?iU)^((chapitre|chapter|partie|part|section|module|annexe|appendix|unit[ée]?|unit)\s+\d+\b"
    r"|\d+(\.\d+)*[.)]?\s+\S"
    r"|[IVXLCDM]{1,6}[.)]\s+\S)"
)
CAPTION = r"(?iU)^(figure|fig\.?|tableau|table|listing|exemple|example|schema|schéma)\s*\d+"
STRUCTURAL_WORDS = (
    "introduction définition definition objectifs objectives principe principles fonctionnement applications "
    "exemple example avantages limites limitations conclusion synthèse summary méthodologie methodology "
    "architecture résultats results overview prérequis prerequisites références references annexe appendix"
).split()
DANGLING_WORDS = (
    "le la les un une des du de au aux et ou mais donc car ni que qui dans pour avec sur sous par chez vers sans "
    "entre a an the of in on at to for with from by and or but if as into than when while which"
).split()
MATH_SIGN = r"[=≈≠≤≥±×÷∑∏∫√∈∉⊂⊃∪∩→←⇒⇔∂∇∞]|[⁰-⁹²³¹]|\^(?U)\s*\d"
TITLE_END = r"[.!?…:;]$"
CONFIDENT, POSSIBLE, AMBIGUOUS = 70, 50, 0.6
FORMULA_LETTERS, FORMULA_LENGTH = 0.5, 80
STYLE_SHARE, TITLE_SHARE = 0.6, 0.6
LARGE_STEPS = ((1.35, 45), (1.15, 35), (1.05, 20))
SMALL_RATIO, SMALL_WEIGHT = 0.9, -15
SHORT_TITLE, LONG_TITLE = 60, 120
OVERLINE_LENGTH, OVERLINE_GAP, SIZE_STEP = 50, 2.5, 0.08
WHY_SIZE = "police %.1fx le corps"
WHY_SMALL = "police plus petite que le corps"
WHY_BOLD = "texte en gras"
WHY_CASE = "capitalisation de titre"
WHY_NUMBER = "numérotation de titre"
WHY_OPEN_END = "pas de ponctuation finale"
WHY_SHORT = "ligne courte"
WHY_LONG = "trop long pour un titre"
WHY_STRUCTURAL = "mot structurel"
WHY_MANY_LINES = "plus de trois lignes"
WHY_DANGLING = "se termine sur un mot-outil : fragment de phrase"
WHY_EMPTY = "texte vide"
WHY_TABLE = "ligne d'un tableau détecté"
WHY_MONO = "police à chasse fixe (%d%%)"
WHY_CAPTION = "forme de légende"
WHY_BULLET = "puce en début de ligne"
WHY_FORMULA = ("opérateur mathématique", "ligne courte et peu alphabétique")
WHY_ORDERED = ("numérotation d'énumération", "signaux typographiques insuffisants pour un titre")
WHY_BETWEEN = "score intermédiaire"
WHY_NOTHING = "aucun indice de titre"
WHY_OVERLINE = "surtitre réuni au titre"
# -----------------------------------------------------------------------------


def _title_case(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(1)), lambda w: F.length(w) > 2)
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return (F.size(words) > 0) & (capital / F.greatest(F.size(words), F.lit(1)) >= TITLE_SHARE)


def _dangling(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit("([A-Za-zÀ-ÿ']+)"), F.lit(1))
    return (F.size(words) > 0) & F.lower(F.get(words, F.size(words) - 1)).isin(DANGLING_WORDS)


def heading_signals(text: Column) -> list[tuple[Column, int, Column]]:
    """(condition, weight, reason) of every signal that speaks for or against a heading."""
    sized = F.col("body_size") > 0
    ratio = F.when(sized, F.col("font_size") / F.col("body_size"))
    signals: list[tuple[Column, int, Column]] = []
    above: Column = F.lit(False)
    for least, weight in LARGE_STEPS:
        signals.append(((ratio >= least) & ~above, weight, F.format_string(WHY_SIZE, round_tenth(ratio))))
        above = ratio >= least
    signals += [
        (ratio < SMALL_RATIO, SMALL_WEIGHT, F.lit(WHY_SMALL)),
        (F.col("bold_ratio") > STYLE_SHARE, 20, F.lit(WHY_BOLD)),
        (_title_case(text), 10, F.lit(WHY_CASE)),
        (text.rlike(NUMBERED), 25, F.lit(WHY_NUMBER)),
        (~text.rlike(TITLE_END), 10, F.lit(WHY_OPEN_END)),
        (F.length(text) <= SHORT_TITLE, 10, F.lit(WHY_SHORT)),
        (F.length(text) > LONG_TITLE, -25, F.lit(WHY_LONG)),
        (F.regexp_extract(F.lower(text), r"(?U)^([^\s:,.]*)", 1).isin(STRUCTURAL_WORDS), 10, F.lit(WHY_STRUCTURAL)),
        (F.col("line_count") > 3, -15, F.lit(WHY_MANY_LINES)),
        (_dangling(text), -25, F.lit(WHY_DANGLING)),
    ]
    return signals


def heading_score(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (with body_size) plus `score` and `signals`, the reasons for it."""
    signals = heading_signals(F.col("_t"))
    hits = F.filter(
        F.array(*[F.when(cond, F.struct(F.lit(weight).alias("weight"), why.alias("why"))) for cond, weight, why in signals]),
        lambda s: s.isNotNull(),
    )
    return paragraphs.withColumn("_t", tx.strip(F.col("text"))).withColumn("_hits", hits).withColumns({
        "score": F.aggregate("_hits", F.lit(0), lambda a, s: a + s["weight"]),
        "signals": F.transform("_hits", lambda s: s["why"]),
    }).drop("_hits", "_t")


def formula_confidence(text: Column) -> Column:
    """Confidence that a one-line paragraph is a displayed formula, NULL if it is not."""
    share = tx.letter_count(text) / F.length(text)
    fits = (F.col("line_count") <= 1) & (F.length(text) <= FORMULA_LENGTH) & (F.length(text) > 0) & text.rlike(MATH_SIGN)
    return F.when(fits & (share < FORMULA_LETTERS), F.least(F.lit(0.9), F.lit(0.6) + (F.lit(FORMULA_LETTERS) - share)))


def classify(paragraphs: DataFrame, body: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Paragraphs with type, confidence, score and reasons, tests in order of reliability.

    `lines` lists the chunks of the paragraphs more cheaply than the paragraphs when given.
    """
    scored = heading_score(spread_facts(paragraphs, body, "doc_id", "chunk", places=lines)).withColumn("_t", tx.strip(F.col("text")))
    text, score = F.col("_t"), F.col("score")
    smaller = (F.col("body_size") > 0) & (F.col("font_size") < F.col("body_size"))

    def result(kind: str, confidence: Column, reasons: Column, points: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("type"), confidence.cast("double").alias("confidence"),
                        (F.lit(0) if points is None else points).alias("score"), reasons.alias("reasons"))

    def why(*texts: str) -> Column:
        return F.array(*[F.lit(t) for t in texts])

    mono = F.col("mono_ratio")
    gray = F.concat("signals", why(WHY_BETWEEN))
    verdict = (
        F.when(text == "", result("UNKNOWN", F.lit(0.0), why(WHY_EMPTY)))
        .when(F.col("table_no").isNotNull(), result("TABLE_ROW", F.lit(0.9), why(WHY_TABLE)))
        .when(mono > STYLE_SHARE, result("CODE", F.least(F.lit(0.95), F.lit(0.6) + mono * 0.35),
                                         F.array(F.format_string(WHY_MONO, F.rint(mono * 100).cast("long")))))
        .when(text.rlike(CAPTION) & smaller, result("CAPTION", F.lit(0.85), why(WHY_CAPTION, WHY_SMALL)))
        .when(text.rlike(CAPTION), result("CAPTION", F.lit(0.7), why(WHY_CAPTION)))
        .when(text.rlike(tx.BULLET), result("LIST_ITEM", F.lit(0.9), why(WHY_BULLET)))
        .when(F.col("_formula").isNotNull(), result("FORMULA", F.col("_formula"), why(*WHY_FORMULA)))
        .when(text.rlike(tx.ORDERED_ITEM) & (score < CONFIDENT),
              result("LIST_ITEM", F.lit(0.7), why(*WHY_ORDERED), score))
        .when(score >= CONFIDENT, result(
            "HEADING", F.least(F.lit(0.98), F.lit(0.7) + (score - CONFIDENT) / 100), F.col("signals"), score))
        .when(score >= POSSIBLE, result("HEADING", F.lit(0.5), gray, score))
        .otherwise(result("PARAGRAPH", F.least(F.lit(0.95), F.lit(0.6) + (F.lit(POSSIBLE) - score) / 100),
                          F.when(F.size("signals") > 0, F.col("signals")).otherwise(why(WHY_NOTHING)), score))
    )
    return (
        scored.withColumn("_formula", formula_confidence(text)).withColumn("_c", verdict)
        .drop("score", "signals", "_formula", "_t").select("*", "_c.*").drop("_c", "body_size")
    )


_ORDER = ["page_no", "line_no"]


def merge_overlines(paragraphs: DataFrame) -> DataFrame:
    """Join each overline heading to the larger heading right below it.

    Pairs are found between neighbours. In a chain of pairs the first two go
    together, then the next two: the place in the chain decides, so the chain's
    first paragraph is carried along.
    """
    heading = F.col("type") == "HEADING"
    seen = ordered_scan(
        paragraphs, ["doc_id"], _ORDER, F.col("chunk"), sums={"_n": F.lit(1)},
        prevs={"_above": F.struct("type", "font_size", "page_end", "last_y", *_ORDER,
                                  F.when(heading, F.col("text")).alias("text"),
                                  F.when(heading, F.col("lines")).alias("lines"))},
    )
    above = F.col("_above")
    title = tx.strip(above["text"])
    gap = above["last_y"] - F.col("first_y")
    pair = (
        (above["type"] == "HEADING") & heading & (above["page_end"] == F.col("page_start"))
        & (F.length(title) <= OVERLINE_LENGTH) & ~title.rlike(r"[.!?]$")
        & (F.col("font_size") > above["font_size"] * (1 + SIZE_STEP))
        & (gap > 0) & (gap <= F.col("font_size") * OVERLINE_GAP)
    )
    chained = ordered_scan(
        seen.withColumn("_pair", F.coalesce(pair, F.lit(False))), ["doc_id"], _ORDER, F.col("chunk"),
        lasts={"_first": F.when(~F.col("_pair"), F.col("_n"))}, nexts={"_below": F.col("_pair")},
    )
    second = (F.col("_n") - F.col("_first")) % 2 == 1
    absorbed = ~F.col("_second") & F.coalesce("_below", F.lit(False))
    kept = chained.withColumn("_second", second).filter(~absorbed)
    whole = kept.withColumns({
        "text": F.when(F.col("_second"), F.concat(title, F.lit(" "), tx.strip(F.col("text")))).otherwise(F.col("text")),
        "lines": F.when(F.col("_second"), F.concat(above["lines"], F.col("lines"))).otherwise(F.col("lines")),
        "reasons": F.when(F.col("_second"), F.array_append("reasons", F.lit(WHY_OVERLINE))).otherwise(F.col("reasons")),
    }).drop("_n", "_above", "_pair", "_first", "_below", "_second")
    # A title that begins in the chunk before stays in the chunk of its second part: it is the first one there.
    return measures(whole)
