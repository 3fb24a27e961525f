"""Row numbers of one global order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paideon.session import stage


def numbered(df: DataFrame, order: Sequence[Column], into: str, within: Sequence[str] = (),
             keep: Sequence[str] | None = None) -> DataFrame:
    """Add the place (from 0) of each row, in `order` over all rows or over the rows of one key.

    Rows are dealt to sorted ranges and numbered inside their range; only one row per range
    (and key) is scanned over the whole order. A key with a third of all rows is thus spread
    over as many ranges as it fills. `within` are columns; rows equal in `order` get places
    in any order. `keep` names the columns that are still needed once the order is known.
    """
    by = [*(F.col(k) for k in within), *order]
    columns = list(keep or df.columns)
    ranges = stage(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumns({"_range": F.spark_partition_id(),
                      "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        .select(*columns, "_range", "_at"), "ranges")
    sizes = ranges.groupBy("_range", *within).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    key = {f"_key{i}": k for i, k in enumerate(within)}
    shift = sizes.select(F.col("_range").alias("_of"), *[F.col(k).alias(n) for n, k in key.items()],
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_of")
    for n, k in key.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return ranges.join(shift, same).select(*columns, (F.col("_at") + F.col("_shift")).alias(into))
