"""Ordered folds over arrays that give one value per item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256  # items folded with one output array; an append copies at most so many values


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_values(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str,
                emit: Callable[[Column, Column], Column] | None = None) -> Column:
    """Array of emit(state before, item) for every item, while state = step(state, item).

    Without `emit` the state after each item is given. `kind` is the type of an output value. Outputs are
    appended within blocks and the blocks are put together at the end, so the cost grows with the number of items,
    not with its square.
    """
    emit = emit or step

    def one(acc: Column, item: Column) -> Column:
        return F.struct(step(acc["state"], item).alias("state"), F.array_append(acc["out"], emit(acc["state"], item)).alias("out"))

    def folded(all_items: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_items) / BLOCK).cast("int") - 1, F.lit(0)))

        def block(acc: Column, b: Column) -> Column:
            own = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
            return F.aggregate(F.slice(all_items, b * BLOCK + 1, F.lit(BLOCK)), own, one, lambda o: F.struct(
                o["state"].alias("state"), F.array_append(acc["out"], o["out"]).alias("out")))

        zero = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(blocks, zero, block, lambda acc: acc["out"]))

    return let(items, folded)
