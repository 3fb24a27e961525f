"""Shared helpers against plain statements of the same rules."""

import random
import statistics
import unicodedata

from pyspark.sql import functions as F

from paideon.functions import text as tx
from paideon.functions.nesting import attach, nest
from paideon.functions.scan import ordered_scan
from paideon.functions.values import array_median, round_tenth, weighted_median


def test_ordered_scan_equals_a_loop(spark):
    rng = random.Random(7)
    rows = [(g, i, rng.randint(-5, 5), rng.choice([None, rng.randint(0, 9)])) for g in "ab" for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int, w int").repartition(5)
    got = ordered_scan(
        df, ["g"], ["i"], F.floor(F.col("i") / 7), sums={"total": F.col("v")}, mins={"low": F.col("v")},
        lasts={"seen": F.col("w")}, prevs={"before": F.col("w")}, nexts={"after": F.col("v")},
    ).collect()
    want = {}
    for g in "ab":
        own = sorted(r for r in rows if r[0] == g)
        total, low, seen = 0, None, None
        for k, (_, i, v, w) in enumerate(own):
            total, low = total + v, v if low is None else min(low, v)
            seen = w if w is not None else seen
            want[g, i] = (total, low, seen, own[k - 1][3] if k else None, own[k + 1][2] if k + 1 < len(own) else None)
    assert len(got) == len(rows)
    assert {(r.g, r.i): (r.total, r.low, r.seen, r.before, r.after) for r in got} == want


def test_nest_keeps_every_row_of_a_large_group(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    nested = nest(df, ["k"], ["id"], [], "items").collect()
    assert {r.k: [e.id for e in r["items"]] for r in nested} == {k: [i for i in range(1000) if (i % 3 == 0) == k] for k in (0, 1)}
    parents = spark.createDataFrame([(0,), (1,), (2,)], "k int")
    rows = attach(parents, "k", {"items": nest(df, ["k"], ["id"], [], "items")}).collect()
    assert {r.k: len(r["items"]) for r in rows} == {0: 666, 1: 334, 2: 0}


def test_round_tenth_is_python_round(spark):
    values = [79.65, 79.85, 79.95, 79.949999, 12.25, 12.35, 0.05, 0.15, -3.25, -3.35, 11.65, 100.0, 0.0, 737.05]
    rng = random.Random(3)
    values += [rng.uniform(-800, 800) for _ in range(300)] + [round(rng.uniform(0, 100), 2) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_tenth(F.col("v")).alias("r")).collect()
    assert [(r.v, r.r) for r in got if r.r != round(r.v, 1)] == []


def test_medians(spark):
    pairs = [(9.0, 3), (11.0, 4), (16.0, 1)]
    row = spark.createDataFrame([(pairs, [3.0, 1.0, 2.0, 10.0])], "p array<struct<v:double,w:bigint>>, a array<double>").select(
        weighted_median(F.col("p")).alias("w"), array_median(F.col("a")).alias("m")).first()
    assert row.w == statistics.median([v for v, w in pairs for _ in range(w)])
    assert row.m == 2.5


def test_titles_and_shapes(spark):
    names = ["mon_cours-d'ia.pdf", "a/b/L'IA pour tous.PDF", "___.pdf", "cours 2eme.v2.pdf"]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select(
        tx.title_from_file_name(F.col("n")).alias("t")).collect()]
    assert got == ["Mon Cours D'Ia", "L'Ia Pour Tous", "Cours importé", "Cours 2Eme.V2"]
    shapes = {"12": True, "- 12 -": True, "Page 4": True, "p. 4": True, "4 / 20": True, "4 sur 20": True,
              "4 of 20": True, "4 | 20": True, "Exercice 1": False, "12345": False, "4 / 20 x": False}
    rows = spark.createDataFrame([(k,) for k in shapes], "t string").select("t", tx.is_page_number(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == shapes


def test_normalize_text(spark):
    samples = ["a : b", "été", "ﬁn ﬃ", "mc²", "x​y  \t z ", "Ångstrom Å"]
    got = [r.t for r in spark.createDataFrame([(s,) for s in samples], "s string").select(
        tx.normalize_text(F.col("s")).alias("t")).collect()]
    assert got == ["a : b", "été", "fin ffi", "mc²", "xy z", unicodedata.normalize("NFC", "Ångstrom Å")]


def test_weighted_median_counts_the_weights_once(spark):
    import random
    import statistics

    from pyspark.sql import functions as F

    from paideon.functions.values import weighted_median

    rng = random.Random(3)
    data = [[(rng.choice([8.0, 9.5, 11.0, 16.0]), rng.randrange(1, 9)) for _ in range(rng.randrange(0, 7))] for _ in range(60)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, a array<struct<v:double,w:bigint>>")
    median = weighted_median(F.col("a"))
    got = {r.i: r.m for r in df.select("i", median.alias("m")).collect()}
    assert got == {i: statistics.median([v for v, w in d for _ in range(w)]) if d else None for i, d in enumerate(data)}
    # One pass for the total, one for the middle; a total inside the second pass would be counted for every pair.
    assert str(median).count("aggregate(") == 2
