"""Numeric helpers: half-even rounding and medians over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paideon.functions.fold import let


def round_half_even(value: Column) -> Column:
    """Nearest whole number, ties to even, as a long."""
    return F.rint(value).cast("long")


def round_tenth(value: Column) -> Column:
    """One decimal, deciding ties on the exact binary value of the double.

    The fraction is scaled by 2**58, where it is a whole number, so the decimal
    comparison is done without any rounding error.
    """
    size = F.abs(value)
    whole = F.floor(size)
    scaled = ((size - whole) * F.lit(float(2**58))).cast("long") * 10
    tenth = F.shiftright(scaled, 58)
    rest = scaled - F.shiftleft(tenth, 58)
    half = F.lit(2**57)
    up = F.when((rest > half) | ((rest == half) & (tenth % 2 == 1)), 1).otherwise(0)
    rounded = (whole * 10 + tenth + up).cast("double") / 10.0
    return F.when(value < 0, -rounded).otherwise(rounded)


def array_median(values: Column) -> Column:
    """Mean of the two middle values of a numeric array; NULL when empty."""
    def middle(ranked: Column) -> Column:
        n = F.size(ranked)
        low = F.element_at(ranked, F.greatest(((n - 1) / 2).cast("int") + 1, F.lit(1)))
        high = F.element_at(ranked, F.greatest((n / 2).cast("int") + 1, F.lit(1)))
        return F.when(n > 0, (low + high) / 2.0)

    return let(F.array_sort(values), middle)


def weighted_median(pairs: Column) -> Column:
    """Median of array<struct<v double, w long>> with every v repeated w times.

    The total is bound once and both middle values come from one pass, so the cost grows with the number of pairs.
    """
    def middle(ranked: Column, total: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("low"),
                         F.lit(None).cast("double").alias("high"))

        def step(acc: Column, p: Column) -> Column:
            seen = acc["seen"] + p["w"]

            def at(name: str, rank: Column) -> Column:
                return F.when(acc[name].isNull() & (seen > rank), p["v"]).otherwise(acc[name]).alias(name)

            return F.struct(seen.alias("seen"), at("low", F.floor((total - 1) / 2)), at("high", F.floor(total / 2)))

        return F.when(total > 0, F.aggregate(ranked, start, step, lambda acc: (acc["low"] + acc["high"]) / 2.0))

    def summed(ranked: Column) -> Column:
        total = F.aggregate(ranked, F.lit(0).cast("long"), lambda acc, p: acc + p["w"])
        return let(total, lambda total: middle(ranked, total))

    return let(F.sort_array(pairs), summed)
