"""Readable unique ids for whole batches of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paideon.functions.scan import ordered_scan
from paideon.functions.text import ascii_fold
from paideon.session import stage

CHUNK = 4096
# A literal title such as "x 2" belongs to the same family as "x".
SUFFIX = r"-(\d{1,9})$"


def slug_base(title: Column, seq: Column) -> Column:
    """ASCII letters and digits with single dashes; eight hex characters when nothing is left."""
    dashed = F.regexp_replace(ascii_fold(title), r"[^a-zA-Z0-9]+", "-")
    base = F.lower(F.regexp_replace(dashed, r"^-+|-+$", ""))
    return F.when(base != "", base).otherwise(F.substring(F.md5(seq.cast("string")), 1, 8))


def _slots(ids: DataFrame, bases: DataFrame) -> DataFrame:
    """(base, slot) of ids that block a base: slot 1 is the base, n is `base-n`."""
    plain = ids.select(F.col("id").alias("base"), F.lit(1).cast("long").alias("slot"))
    number = F.regexp_extract("id", SUFFIX, 1)
    suffixed = ids.filter(number.rlike(r"^[1-9]\d*$")).select(
        F.regexp_replace("id", SUFFIX, "").alias("base"), number.cast("long").alias("slot")
    ).filter("slot >= 2")
    return plain.unionByName(suffixed).join(bases, "base", "left_semi").distinct()


def _assign(items: DataFrame, blocked: DataFrame) -> DataFrame:
    """The r-th item of a base takes its r-th slot that is not blocked."""
    ranked = ordered_scan(items, ["base"], ["seq"], F.floor(F.col("seq") / CHUNK), sums={"rank": F.lit(1)})
    # A blocked slot t with i blocked ones up to it leaves t - i free slots below,
    # so an item of rank r skips it exactly when t - i < r.
    counted = ordered_scan(blocked, ["base"], ["slot"], F.floor(F.col("slot") / CHUNK), sums={"upto": F.lit(1)})
    free_below = counted.groupBy("base", (F.col("slot") - F.col("upto")).alias("at")).agg(
        F.count(F.lit(1)).alias("skips"))
    marks = free_below.select("base", "at", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("seq"), "skips")
    wants = ranked.select("base", F.col("rank").cast("long").alias("at"), F.lit(0).alias("kind"), "seq",
                          F.lit(0).cast("long").alias("skips"))
    merged = ordered_scan(
        stage(marks.unionByName(wants), "slug-wants"), ["base"], ["at", "kind", "seq"], F.floor(F.col("at") / CHUNK),
        sums={"skipped": F.col("skips")},
    )
    slot = F.col("at") + F.col("skipped")
    return merged.filter("kind = 0").select(
        "base", "seq", slot.alias("slot"),
        F.when(slot == 1, F.col("base")).otherwise(F.concat_ws("-", "base", slot.cast("string"))).alias("id"),
    )


def assign_slugs(existing: DataFrame, titles: DataFrame) -> DataFrame:
    """Ids for (seq, title) rows as if they were created one by one in `seq` order.

    Items are ranked inside their base and skip ids already stored. Two bases can
    still want one id ("x" twice and a literal "x 2"); the earlier item keeps it,
    the slot is blocked for the other base and the ranking is redone until no id
    is wanted twice. A loss is final as soon as nothing before it in either base can
    still move, so all such losses are settled in one round, and rounds follow the
    depth of chains of clashes only.
    """
    items = stage(titles.select("seq", "title", slug_base(F.col("title"), F.col("seq")).alias("base")), "slug-items")
    bases = items.select("base").distinct()
    blocked = _slots(existing.select("id"), bases)
    while True:
        given = stage(_assign(items, blocked), "slug-round")
        clashing = given.groupBy("id").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", F.col("base").alias("winner_base"))).alias("winner")).filter("n > 1")
        lost = given.join(clashing, "id").filter(F.col("seq") > F.col("winner.seq"))
        first = lost.groupBy("base").agg(F.min_by(F.struct("slot", "seq", "winner"), "seq").alias("l")).select("base", "l.*")
        moving = first.select(F.col("base").alias("winner_base"), F.col("seq").alias("moves_from"))
        settled = first.withColumn("winner_base", F.col("winner.winner_base")).join(moving, "winner_base", "left").filter(
            F.col("moves_from").isNull() | (F.col("moves_from") > F.col("winner.seq")))
        losses = stage(settled.select("base", "slot"), "slug-losses")
        if losses.isEmpty():
            return items.join(given.select("seq", "id"), "seq")
        blocked = stage(blocked.unionByName(losses).distinct(), "slug-blocked")
