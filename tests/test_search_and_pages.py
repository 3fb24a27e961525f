"""Many searches, all pages of a listing, ordered folds and certificates by stream against plain versions."""

import random

from pyspark.sql import functions as F

from paideon.functions.fold import fold_values
from paideon.functions.nesting import all_pages
from paideon.functions.rank import numbered
from paideon.operators.search import search_many
from paideon.plans.streams import as_stream, collect_stream
from paideon.streaming import learner_streams as ls


def test_search_many_is_contains(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "Ab", "cAb", "été ab", "%_x", "aaaa"]), "".join(rng.choices("abcé%_ ", k=rng.randrange(9)))) for i in range(200)]
    patterns = ["a", "AB", "cab", "é", "%_", "aaa", "", None, "zzz", "b c", "abcabcabc", "ÉT"]
    people = spark.createDataFrame(rows, "id int, email string, name string")
    got = {tuple(r) for r in search_many(people, "id", ["email", "name"], spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()}
    want = {(p, i) for i, *texts in rows for p in patterns if p and any(p.lower() in (t or "").lower() for t in texts)}
    assert got == want
    none = spark.createDataFrame([], "pattern string")
    assert search_many(people, "id", ["email", "name"], none).count() == 0


def test_pages_hold_each_row_once(spark):
    df = spark.range(1003).withColumn("k", (F.col("id") * 37) % 11)
    got = all_pages(df, [F.col("k").desc(), F.col("id")], 20).collect()
    order = sorted(range(1003), key=lambda i: (-(i * 37 % 11), i))
    assert {(r.id, r.page_no, r.place_on_page) for r in got} == {(i, n // 20, n % 20) for n, i in enumerate(order)}
    assert all_pages(df.limit(0), [F.col("k")], 20).count() == 0


def test_numbers_within_keys(spark):
    rows = [(None if i % 9 == 0 else i % 3, i * 7 % 50) for i in range(200)]
    got = numbered(spark.createDataFrame(rows, "k int, v int"), [F.col("v")], "n", ["k"]).collect()
    for k in (None, 0, 1, 2):
        own = sorted(v for q, v in rows if q == k)
        assert sorted((r.n, r.v) for r in got if r.k == k) == list(enumerate(own))


def test_fold_gives_a_value_per_item(spark):
    data = [list(range(n)) for n in (0, 1, 255, 256, 257, 1000)]
    df = spark.createDataFrame([(d,) for d in data], "a array<int>")
    sums = df.select(fold_values(F.col("a"), F.lit(0), lambda s, x: s + x, "int").alias("s")).collect()
    assert [r.s for r in sums] == [[sum(d[:i + 1]) for i in range(len(d))] for d in data]


def test_certificates_are_issued_once_over_batches(spark):
    eligible = [(u, c, 80.0 + u % 7, True) for u in range(20) for c in range(3)] + [(50, 1, 79.9, False)]
    schema = "user_id long, course_id long, average_score double, eligible boolean"
    events = spark.createDataFrame(eligible * 3, schema).repartition(6)
    issued = spark.createDataFrame([(0, 0), (1, 2)], "user_id long, course_id long")
    out = collect_stream(ls.stream_certificates(as_stream(events, 1), issued))
    got = [tuple(r) for r in out.select("user_id", "course_id", "average_score").collect()]
    want = {(u, c, round(s)) for u, c, s, e in eligible if e and (u, c) not in ((0, 0), (1, 2))}
    assert len(got) == len(set(got)) and set(got) == want


def test_last_answer_of_each_question(spark):
    rng = random.Random(9)
    data = [[(n, rng.randrange(5), rng.choice([None, 10, 11, 12])) for n in range(rng.choice([1, 5, 300]))] for _ in range(20)] + [[]]
    df = spark.createDataFrame([(d,) for d in data], "a array<struct<submit_seq:int,question_no:int,selected_option_id:int>>")
    got = df.select(ls._counting(F.col("a")).alias("g")).collect()
    for row, answers in zip(got, data):
        want = {q: s for _, q, s in answers}
        assert row.g is None if not answers else {(g.question_no, g.selected_option_id) for g in row.g} == set(want.items())


def test_purge_takes_all_rows_below(spark):
    """A chain of 40 levels, and children of the removed rows."""
    from paideon.operators import audits

    tree = spark.createDataFrame([(i, i - 1 if i % 41 else None) for i in range(123)], "id int, up int")
    leaves = spark.createDataFrame([(i, i % 123) for i in range(300)], "leaf int, id int")
    gone = tree.filter("id in (20, 60, 999)")
    kept = audits.purge({"tree": tree, "leaves": leaves}, "tree", gone, "id", [("tree", "up", "id", "tree"), ("leaves", "id", "leaf", "tree")])
    dead = set(range(20, 41)) | set(range(60, 82))
    assert {r.id for r in kept["tree"].collect()} == set(range(123)) - dead
    assert {r.leaf for r in kept["leaves"].collect()} == {i for i in range(300) if i % 123 not in dead}


def test_search_index_holds_only_rows_with_the_pattern(spark, monkeypatch):
    """Runs that every row has (customer#0000) must not bring every row to a search text of other characters."""
    from paideon.operators import search

    written = {}
    monkeypatch.setattr(search, "stage", lambda df, label: written.setdefault(label, df))
    people = spark.range(3000).selectExpr("id", "format_string('customer#%09d', id) as email")
    searches = spark.createDataFrame([("00042",), ("#00000042",), ("omer#000002999",)], "pattern string")
    found = {tuple(r) for r in search_many(people, "id", ["email"], searches).collect()}
    names = {i: f"customer#{i:09d}" for i in range(3000)}
    want = {(p, i) for i, n in names.items() for p in ("00042", "#00000042", "omer#000002999") if p in n}
    assert found == want
    grams = {(r.gram, r.id) for r in written["grams"].collect()}
    assert {g for g, _ in grams if len(g) < search.GRAM} == {"00042"}
    assert {i for g, i in grams if g == "00042"} == {i for p, i in want if p == "00042"}
