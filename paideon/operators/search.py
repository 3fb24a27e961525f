"""Many search texts against many rows through an index of character runs.

A search text of up to GRAM characters is itself a run, so only rows that hold it are looked at; of a longer one all runs
of GRAM characters are in a row that holds it, and it is compared with the rows that hold its rarest run. Runs are
indexed in the lengths the search texts have, and only those that a search text asks for are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paideon.session import stage

GRAM = 8


def _runs(text: Column, size: int) -> Column:
    """Distinct runs of `size` characters."""
    starts = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    return F.when(F.char_length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>"))


def gram_index(rows: DataFrame, key: str, fields: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """(gram, key) of every run of the given lengths in any of the fields, in lower case."""
    texts = F.array(*[F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields])
    none = F.array().cast("array<string>")
    grams = F.flatten(F.transform(texts, lambda t: F.concat(none, *[_runs(t, n) for n in sizes])))
    return rows.select(F.explode(F.array_distinct(grams)).alias("gram"), F.col(key))


def search_many(rows: DataFrame, key: str, fields: Sequence[str], searches: DataFrame) -> DataFrame:
    """(pattern, key) of the rows of which a field contains the pattern, whatever the case of letters.

    `searches` has one column, pattern; null and empty patterns find nothing. Patterns are plain text.
    """
    wanted = searches.filter("pattern <> ''").distinct()
    low = F.lower("pattern")
    own = stage(wanted.select("pattern", F.explode(_runs(low, GRAM)).alias("gram")).unionByName(
        wanted.filter(F.char_length(low) < GRAM).select("pattern", low.alias("gram"))), "runs")
    # At most GRAM numbers.
    sizes = sorted(r[0] for r in own.select(F.char_length("gram")).distinct().collect())
    index = stage(gram_index(rows, key, fields, sizes).join(own.select("gram").distinct(), "gram", "left_semi"), "grams")
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A run that no row has decides that there is nothing to find.
    rarest = own.join(counts, "gram", "left").groupBy("pattern").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    candidates = rarest.join(index, "gram").select("pattern", key)
    found = candidates.join(rows.select(key, *fields), key)
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f)), F.lower("pattern")), F.lit(False))
    return found.filter(hit).select("pattern", key)
