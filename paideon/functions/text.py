"""Text shapes and normal forms as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: patterns and word lists that decide results ---------------
NUMBERED_HEADING = (
    r"(?iU)^((chapitre|partie|section|module|annexe)\s+\d+\b"
    r"|\d+(\.\d+)*[.\)]?\s+\S"
    r"|[IVXLCDM]{1,6}[.\)]\s+\S)"
)
LEADING_FUNCTION_WORD = (
    r"(?iU)^(le|la|les|un|une|des|de|du|et|ou|mais|donc|car|ni|que|qui|dans|pour|"
    r"avec|sur|sous|par|the|a|an|and|or|but|of|in|on|for|with)\b"
)
SENTENCE_END = r"[.!?…]$"
FOOTNOTE_LEAD = r"(?iU)^\d+(\.\d+)*[.\)]?\s+(voir\b|cf\.|source\s*:)"
URL_HINT = r"(?iU)(https?://|www\.\w|\b\w[\w-]*\.(com|org|net|fr|io|edu)\b)"
PAGE_NUMBER_TEXT = (
    r"(?iU)^(\d{1,4}$"
    r"|[-–—]\s*\d{1,4}\s*[-–—]$"
    r"|p(age)?\.?\s*\d{1,4}\b"
    r"|\d{1,4}\s*(/|sur|of|\|)\s*\d{1,4}$)"
)
PAGE_NUMBER_LAYOUT = (
    r"(?iU)^(\d{1,4}$"
    r"|[-–—•·]\s*\d{1,4}\s*[-–—•·]?$"
    r"|p(age)?\.?\s*\d{1,4}\b"
    r"|\d{1,4}\s*(/|sur|of|\|)\s*\d{1,4}$)"
)
ORDERED_LINE = r"(?U)^(\d{1,3})[.)]\s+\S"
BULLET = r"(?U)^\s*[-–—•·*▪◦‣]\s+\S"
ORDERED_ITEM = r"(?U)^\s*(\d{1,3}|[a-zA-Z])[.)]\s+\S"
PERCENT = r"(?U)(\d+)\s*%"

# Characters replaced by a plain space / removed / spelt out.
SPACE_LIKE = "\u00a0\u2007\u202f\u2009\u2002\u2003\u2004\u2005\u2006\u2008"
INVISIBLE = "\u200b\u200c\u200d\ufeff\u2060"
LIGATURES = {
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi",
    "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st",
}
# Every decimal digit of Unicode and the ASCII digit of its value, in the same order.
DIGITS = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd")
DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in DIGITS)
SOFT_HYPHEN = "\u00ad"
HYPHENS = "-\u2010\u2011"
# -----------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Cut Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def norm_exact(text: Column) -> Column:
    """White-space runs to one space, ends cut, lower case."""
    return F.lower(F.regexp_replace(strip(text), r"(?U)\s+", " "))


def norm_digits(text: Column) -> Column:
    """`norm_exact` with digit runs as `#`."""
    return F.regexp_replace(norm_exact(text), r"(?U)\d+", "#")


def is_page_number(text: Column) -> Column:
    return text.rlike(PAGE_NUMBER_TEXT)


def is_footnote(text: Column) -> Column:
    return text.rlike(FOOTNOTE_LEAD) | text.rlike(URL_HINT)


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def is_list_item(text: Column) -> Column:
    return text.rlike(BULLET) | text.rlike(ORDERED_ITEM)


def whole_number(digits: Column) -> Column:
    """Value of a run of decimal digits of any script; NULL beyond 38 digits."""
    return F.translate(digits, DIGITS, DIGIT_VALUES).try_cast("decimal(38,0)")


def first_number(text: Column) -> Column:
    """Number of an `n.` or `n)` line, NULL for any other line."""
    return F.when(text.rlike(ORDERED_LINE), whole_number(F.regexp_extract(text, ORDERED_LINE, 1)).cast("int"))


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    pieces = F.regexp_extract_all(text, F.lit(r"([^\p{L}]*\p{L}*)"), F.lit(1))

    def cased(piece: Column) -> Column:
        lead = F.regexp_extract(piece, r"^([^\p{L}]*)", 1)
        word = F.substring(piece, F.length(lead) + 1, F.length(piece))
        head = F.substring(word, 1, 1)
        return F.concat(lead, F.upper(head), F.lower(F.substring(word, F.lit(2), F.length(word))))

    return F.array_join(F.transform(pieces, cased), "")


def title_from_file_name(name: Column) -> Column:
    """Readable title of a file: stem, separators to spaces, title case."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(base, r"(?<=[^/])\.[^./]+$", "")
    words = strip(F.regexp_replace(stem, r"[_\-]+", " "))
    return F.when(words == "", F.lit("Cours importé")).otherwise(title_case(words))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark SQL has no Unicode normal forms."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition with everything outside ASCII dropped."""
    return text.map(
        lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii"),
        na_action="ignore",
    )


def clean_spaces(text: Column) -> Column:
    """Everything of the text clean-up except canonical composition."""
    out = F.translate(text, SPACE_LIKE + INVISIBLE, " " * len(SPACE_LIKE))
    for mark, letters in LIGATURES.items():
        out = F.replace(out, F.lit(mark), F.lit(letters))
    return out


def normalize_text(text: Column) -> Column:
    """Odd spaces, invisible marks, ligatures, NFC, single blanks, stripped ends.

    Text without any character from U+0300 on is in NFC already, so only the rest
    is sent to Python.
    """
    cleaned = clean_spaces(text)
    composed = F.coalesce(nfc(F.when(cleaned.rlike(r"[^\x{0}-\x{2FF}]"), cleaned)), cleaned)
    return strip(F.regexp_replace(composed, r"[ \t]+", " "))
