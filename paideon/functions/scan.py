"""Running sums, carried values and neighbours over long ordered groups.

A plain window partitioned by document (or any other group) puts the whole group
in one task. Here each group is cut into chunks by a column that grows with the
order; windows run inside a chunk, and only one summary row per chunk is scanned
over the whole group. A group holding a third of all rows is therefore spread
over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    sums: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    prevs: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ordered columns to `df`, whose (keys, order) must be unique.

    sums / mins: running sum / minimum up to and including the row.
    lasts: latest non-null value up to and including the row.
    prevs / nexts: value of the row before / after, NULL at the ends.
    """
    sums, mins, lasts = sums or {}, mins or {}, lasts or {}
    prevs, nexts = prevs or {}, nexts or {}
    part = [*keys, "_chunk"]
    cut = df.withColumn("_chunk", chunk)
    at = F.struct(*order)

    seen = Window.partitionBy(*part).orderBy(*order)
    upto = seen.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns(
        {n: F.sum(e).over(upto) for n, e in sums.items()}
        | {n: F.min(e).over(upto) for n, e in mins.items()}
        | {n: F.last(e, ignorenulls=True).over(upto) for n, e in lasts.items()}
        | {n: F.lag(F.struct(e.alias("v"))).over(seen) for n, e in prevs.items()}
        | {n: F.lead(F.struct(e.alias("v"))).over(seen) for n, e in nexts.items()}
    )

    tails = cut.groupBy(*part).agg(
        *[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()],
        *[F.min(e).alias(f"_t_{n}") for n, e in mins.items()],
        *[F.max_by(e, F.when(e.isNotNull(), at)).alias(f"_t_{n}") for n, e in lasts.items()],
        *[F.max_by(F.struct(e.alias("v")), at).alias(f"_t_{n}") for n, e in prevs.items()],
        *[F.min_by(F.struct(e.alias("v")), at).alias(f"_t_{n}") for n, e in nexts.items()],
    )
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *part,
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.min(f"_t_{n}").over(before).alias(f"_c_{n}") for n in mins],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
        *[F.lag(f"_t_{n}").over(by_chunk).alias(f"_c_{n}") for n in prevs],
        *[F.lead(f"_t_{n}").over(by_chunk).alias(f"_c_{n}") for n in nexts],
    )

    joined = local.join(carried, part)
    return joined.select(
        *df.columns,
        *[(F.coalesce(n, F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.least(n, f"_c_{n}").alias(n) for n in mins],
        *[F.coalesce(n, f"_c_{n}").alias(n) for n in lasts],
        *[F.coalesce(F.col(n), F.col(f"_c_{n}"))["v"].alias(n) for n in (*prevs, *nexts)],
    )


def spread_facts(
    rows: DataFrame, facts: DataFrame, key: str, chunk: str, how: str = "left", places: DataFrame | None = None
) -> DataFrame:
    """Join one small row per `key` to all its rows without one task per key.

    The facts are first copied to the chunks that exist for their key, then the
    big side joins on (key, chunk). `places` lists the same chunks more cheaply
    than `rows` when given.
    """
    places = (rows if places is None else places).select(key, chunk).distinct()
    by_chunk = places.join(facts, key)
    return rows.join(by_chunk, [key, chunk], how)
