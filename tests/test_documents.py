"""Golden documents through both text engines, and the rules stated one by one."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from golden_documents import (CALL_SCHEMA, DOCUMENTS, FRAGMENT_SCHEMA, PAGE_SCHEMA, fragment_rows, page_rows, page_text_rows)
from paideon.operators import fragments as fr, paragraphs as par, textchunk as tc, tree
from paideon.plans import structure as st


@pytest.fixture(scope="module")
def result(spark):
    rows = fragment_rows()
    random.Random(1).shuffle(rows)
    fragments = spark.createDataFrame(rows, FRAGMENT_SCHEMA)
    return st.structure_documents(fragments, spark.createDataFrame(page_rows(), PAGE_SCHEMA))


@pytest.fixture(scope="module")
def preview(result):
    out = {}
    for r in st.preview(result).orderBy("doc_id", "path", "position").collect():
        out.setdefault(r.doc_id, []).append((r.kind, r.text))
    return out


@pytest.fixture(scope="module")
def sections(result):
    out = {}
    for r in result.sections.orderBy("doc_id", "heading_no").collect():
        out.setdefault(r.doc_id, []).append((r.title, r.level, r.parent_no, r.position))
    return out


def test_nested_levels(sections):
    assert [(s[1], s[2]) for s in sections["deep_numbers"]] == [(1, None), (2, 1), (3, 2), (2, 1), (1, None)]


def test_titles(sections):
    assert [s[0] for s in sections["two_numbers"]] == ["1. Choisir la terre", "2. Semer les graines"]
    assert [s[0] for s in sections["same_titles"]] == ["Exercice 1", "Exercice 2", "Exercice 3"]
    assert sections["only_text"] == [("Introduction", 1, None, 0)]
    assert [s[0] for s in sections["steps"]] == ["Pain au levain"]


def test_boilerplate_is_removed(preview, result):
    assert not any("Atelier" in text for _, text in preview["margins"])
    report = {r.doc_id: r for r in result.report().collect()}
    assert report["margins"].boilerplate_removed == 9
    assert report["columns"].multi_column_pages == 1
    assert report["one_formula"].formulas == 1 and report["program"].code_blocks == 1


def test_columns_are_read_one_after_the_other(preview):
    assert preview["columns"][0][1].startswith("Une colonie d'abeilles vit toute l'année dans la ruche autour")


def test_table(result):
    row = result.tables.filter("doc_id = 'price_table'").first()
    assert row.headers == ["Produit", "Unité"]
    assert row.rows == [["Poires Williams", "Cageot de bois"], ["Noix sèches", "Sac de toile"]]


def test_hyphens_and_fragments(preview):
    assert preview["broken_words"][0][1] == "L'agriculture de montagne reste rare. Le garde-manger reste frais en été."
    assert preview["pieces_of_a_line"][0][1].startswith("Le mot rouet désigne un outil.")


def test_invariants(result):
    assert result.sections.filter("level not between 1 and 4 or trim(title) = ''").count() == 0
    assert result.blocks.filter("paragraph_count = 0").count() == 0
    assert {r.doc_id for r in result.sections.select("doc_id").distinct().collect()} == set(DOCUMENTS)


@pytest.mark.parametrize("name", ["layout", "paragraphs", "elements"])
def test_stage_tables_stay_dealt_by_chunk(result, name):
    """Windows and groups inside a chunk move no rows, so texts are shuffled once for lines and once for blocks."""
    rows = getattr(result, name).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*fr.DEALT).orderBy("page_no")))
    counted = rows.groupBy(*fr.DEALT).agg(F.max("n").alias("n"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert sum(r.n for r in counted.collect()) == getattr(result, name).count()


@pytest.mark.parametrize("by", [(), fr.DEALT])
def test_a_stage_table_is_broadcast_by_its_rows_not_by_its_files(spark, by):
    """A million numbers compress to a few kB; their table of 32 MB must not go through the driver."""
    from paideon.session import counted_stage

    rows = spark.range(1 << 20).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("chunk"), F.floor(F.col("id") / 9).alias("no"))
    big = counted_stage(rows.coalesce(1), "numbers", by)
    other = counted_stage(rows.coalesce(1), "others", by)
    plan = big.join(other, ["doc_id", "chunk", "no"])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    few = counted_stage(rows.limit(10), "few", by)
    assert "Broadcast" in big.join(few, ["doc_id", "chunk", "no"])._jdf.queryExecution().sparkPlan().toString()


def test_anomalies(result):
    kinds = {(r.doc_id, r.kind) for r in result.anomalies().collect()}
    assert ("only_text", "NO_HEADINGS") in kinds and ("columns", "MULTI_COLUMN") in kinds


def test_write_replaces_only_its_documents(spark, result, tmp_path):
    files = spark.createDataFrame([(d, f"{d}.pdf") for d in DOCUMENTS], "doc_id string, source_file string")
    one, two, three = (str(tmp_path / n) for n in ("one", "two", "three"))
    st.write_document_tree(files, result, one, buckets=2)
    st.write_document_tree(files, result, two, previous=one, buckets=2)
    gone = spark.createDataFrame([("steps", "steps.pdf")], "doc_id string, source_file string")
    empty = st.Structure(*[getattr(result, n).filter("doc_id = 'none'") for n in st.Structure.__dataclass_fields__])
    st.write_document_tree(gone, empty, three, previous=two, buckets=2)
    n = result.blocks.count()
    assert [spark.read.parquet(f"{p}/blocks").count() for p in (one, two)] == [n, n]
    left = spark.read.parquet(f"{three}/blocks")
    assert left.count() == n - result.blocks.filter("doc_id = 'steps'").count()
    assert spark.read.parquet(f"{three}/documents").count() == len(DOCUMENTS)


def test_broken_document_keeps_its_course(spark):
    rows = [("ok", 0, 0, "Texte.", 72.0, 700.0, 11.0, "Helvetica", False, False, False),
            ("bad", 0, 0, "Texte.", float("nan"), 700.0, 11.0, "Helvetica", False, False, False),
            ("ref", 0, 0, "Texte.", None, 700.0, 11.0, "Helvetica", False, False, False)]
    files = spark.createDataFrame([("ok", True), ("bad", True), ("ref", False)], "doc_id string, create_course boolean")
    pages = spark.createDataFrame([(d, 0, 612.0, 792.0) for d in ("ok", "bad", "ref")], PAGE_SCHEMA)
    imported, failed, built = st.import_documents(files, spark.createDataFrame(rows, FRAGMENT_SCHEMA), pages)
    assert {r.doc_id: r.has_tree for r in imported.collect()} == {"ok": True, "bad": False}
    assert [r.doc_id for r in failed.collect()] == ["ref"]
    assert [r.doc_id for r in built.sections.collect()] == ["ok"]


def test_flat_sections(spark):
    pages = spark.createDataFrame(page_text_rows(), "doc_id string, page_no int, text string")
    got = {}
    for r in tc.chunk_pages(tc.page_lines(pages)).orderBy("doc_id", "section_no").collect():
        got.setdefault(r.doc_id, []).append(r.title)
    assert got["two_numbers"] == ["1. Choisir la terre", "2. Semer les graines"]
    assert got["margins"] == ["1. Saison 1", "2. Saison 2", "3. Saison 3"]
    assert got["same_titles"] == ["Exercice 1", "Exercice 2", "Exercice 3"]
    assert got["steps"] == ["Pain au levain"]


def test_long_documents_do_not_depend_on_the_chunk_size(spark, monkeypatch):
    rows = [("d", p, ("Titre Un\n" if p == 0 else "") + "\n".join(f"ligne {p} numero {i} du texte." for i in range(8)) + "\n")
            for p in range(70)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    whole = tc.chunk_pages(tc.page_lines(pages)).collect()
    monkeypatch.setattr(tc, "CHUNK_PAGES", 3)
    assert tc.chunk_pages(tc.page_lines(pages)).collect() == whole and len(whole) == 1
    assert whole[0].title == "Titre Un" and whole[0].body.count("ligne") == 560


def test_digits_of_other_scripts_and_long_numbers(spark):
    rows = [("d", 0, "Titre\n٣. x\n٤. y\n5. z\n\n9. seul\n")]
    lines = tc.page_lines(spark.createDataFrame(rows, "doc_id string, page_no int, text string"))
    got = {r.text: r.in_list for r in tc.classify_lines(lines).collect()}
    assert got["٣. x"] and got["٤. y"] and got["5. z"] and not got["9. seul"]


def test_draw_calls(spark):
    one, half = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [0.5, 0.0, 0.0, 0.5, 0.0, 0.0]
    rows = [
        ("d", 0, 0, "text", "a", one, one, None, "/ABC+DejaVuSansMono-Bold", 10.0),        # repaired from the next
        ("d", 0, 1, "Tm", "", one, one, [20.0, 0.0, 0.0, 20.0, 72.0, 720.0], "", 1.0),
        ("d", 0, 2, "text", "b", one, one, None, "Helvetica-Oblique", 1.0),                # takes the Tm, size 20
        ("d", 0, 3, "text", "c", [2.0, 0.0, 0.0, 2.0, 10.0, 20.0], half, None, "Courier", 10.0),
        ("d", 0, 4, "Td", "", [2.0, 0.0, 0.0, 2.0, 100.0, 50.0], one, [5.0, 5.0], "", 1.0),
        ("d", 0, 5, "text", "  ", one, one, None, "Helvetica", 10.0),
        ("d", 0, 6, "text", "e", one, one, None, "Helvetica", 10.0),                       # relative move
    ]
    got = {r.text: (r.x, r.y, r.font_size, r.bold, r.italic, r.mono)
           for r in fr.fragments_of(spark.createDataFrame(rows, CALL_SCHEMA)).collect()}
    assert got == {"a": (72.0, 720.0, 10.0, True, False, True), "b": (72.0, 720.0, 20.0, False, True, False),
                   "c": (5.0, 10.0, 10.0, False, False, True), "e": (110.0, 60.0, 20.0, False, False, False)}


def test_size_bands(spark):
    def ranks(sizes):
        row = spark.createDataFrame([(sizes,)], "s array<double>").select(tree.size_bands(F.col("s")).alias("b")).first()
        return [b.rank for b in row.b]

    assert ranks([14.0, 30.0, 12.0, 8.7, 15.0, 11.6]) == [1, 2, 2, 3, 3, 4]
    assert ranks([15.0, 14.3, 13.6, 13.0, 12.4]) == [1, 1, 2, 2, 3]


def test_heading_places_equal_a_stack(spark, monkeypatch):
    monkeypatch.setattr(tree, "CHUNK_HEADINGS", 5)
    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(4):
        stack, counts = [], {}
        for t in range(1, 40):
            wanted = rng.randint(1, 4)
            rows.append((doc, t, wanted))
            while stack and stack[-1][1] >= wanted:
                stack.pop()
            level = min(wanted, stack[-1][1] + 1 if stack else 1)
            parent = stack[-1][0] if stack else None
            want[doc, t] = (level, parent, counts.get(parent, 0))
            counts[parent] = counts.get(parent, 0) + 1
            stack.append((t, level))
    df = spark.createDataFrame(rows, "doc_id int, heading_no bigint, wanted int")
    got = {(r.doc_id, r.heading_no): (r.level, r.parent_no, r.position) for r in tree.place_headings(df).collect()}
    assert got == want


def plain_starts(lines):
    """First lines of the paragraphs of one document: (x, flow, is_item, reference, hard) in order."""
    out, left, item = [], 0.0, False
    for i, (x, flow, is_item, reference, hard) in enumerate(lines):
        shift = reference * par.INDENT
        if hard or flow and (left < x - shift or item and left > x + shift):
            out.append(i)
            left, item = x, is_item
        else:
            left = min(left, x)
    return out


def run_frame(spark, lines, chunk):
    """One document of the lines, `chunk` of them in a chunk."""
    start, rows = 0, []
    for i, (x, flow, is_item, reference, hard) in enumerate(lines):
        start = i if hard else start
        rows.append((1, i // chunk, i, x, flow, is_item, reference, (start // chunk, start),
                     (lines[i + 1][4], (i + 1) // chunk) if i + 1 < len(lines) else None))
    df = spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, x double, flow boolean, is_item boolean, reference double, "
                                     "_run struct<page_no:int,line_no:int>, _next struct<hard:boolean,chunk:int>")
    return df.withColumn("chunk", F.col("page_no"))


def starts_of(runs):
    item = F.struct("page_no", "line_no", "x", "flow", "is_item", "reference")
    found = par.paragraph_lines(runs, item).select(F.transform("lines", lambda l: l["line_no"]).alias("n")).collect()
    numbers = sorted(r.n for r in found)
    assert [i for n in numbers for i in n] == list(range(runs.count()))  # every line once, in order
    return [n[0] for n in numbers]


def test_paragraph_starts_follow_the_left_edge(spark):
    text = [(72.0, True, False, 11.0, True), (72.0, True, False, 11.0, False), (90.0, True, False, 11.0, False), (72.0, True, False, 11.0, False),
            (79.0, True, False, 11.0, False), (95.0, False, False, 11.0, False)]
    assert starts_of(run_frame(spark, text, 100)) == [0, 2]
    item = [(90.0, True, True, 11.0, True), (90.0, True, False, 11.0, False), (72.0, True, False, 11.0, False)]
    assert starts_of(run_frame(spark, item, 100)) == [0, 2]


@pytest.mark.parametrize("seed,chunk", [(0, 1), (2, 3), (4, 25)])
def test_paragraphs_of_cut_runs_are_those_of_the_plain_fold(spark, seed, chunk):
    rng = random.Random(seed)
    lines = []
    for i in range(700):
        hard = i == 0 or rng.random() < 0.02
        lines.append((rng.choice([60.0, 66.5, 72.0, 72.0, 72.0, 75.0, 80.8, 84.0, 90.0]), rng.random() < 0.9, hard and rng.random() < 0.5,
                      rng.choice([8.0, 11.0, 16.0]), hard))
    assert starts_of(run_frame(spark, lines, chunk)) == plain_starts(lines)


def test_a_run_of_200000_lines_is_spread(spark):
    """No task holds the run: pieces are folded apart and paragraphs, not runs, are gathered."""
    n, chunk = 200_000, 500
    at = F.col("id")
    runs = spark.range(n).select(
        F.lit(1).alias("doc_id"), F.floor(at / chunk).cast("int").alias("page_no"), at.cast("int").alias("line_no"),
        F.when(at % 1777 == 0, 90.0).when(at % 5 == 0, 75.0).otherwise(72.0).alias("x"), F.lit(True).alias("flow"), F.lit(False).alias("is_item"),
        F.lit(11.0).alias("reference"), F.expr("struct(0 as page_no, 0 as line_no)").alias("_run"),
        F.when(at < n - 1, F.struct(F.lit(False).alias("hard"), F.floor((at + 1) / chunk).cast("int").alias("chunk"))).alias("_next"),
    ).withColumn("chunk", F.col("page_no"))
    item = F.struct("page_no", "line_no", "x", "flow", "is_item", "reference")
    got = par.paragraph_lines(runs, item).select(F.get("lines", F.lit(0))["line_no"].alias("first"), F.size("lines").alias("n")).collect()
    lines = [(90.0 if i % 1777 == 0 else 75.0 if i % 5 == 0 else 72.0, True, False, 11.0, i == 0) for i in range(n)]
    want = plain_starts(lines)
    assert sorted((r.first, r.n) for r in got) == list(zip(want, [b - a for a, b in zip(want, [*want[1:], n])]))


def test_lines_are_joined_as_by_a_plain_loop(spark):
    import re

    from paideon.functions import text as tx

    hyphens = "".join(c for c in map(chr, range(0x2000, 0x2020)) if re.match(f"[{tx.HYPHENS}]", c)) + "-"

    def plain(texts):
        out = ""
        for t in texts:
            if not t:
                continue
            soft = out.endswith(tx.SOFT_HYPHEN)
            if out and (soft or re.search(rf"\w\w[{tx.HYPHENS}]$", out[-3:]) and re.match(r"[a-zéà]", t)):
                out = out.rstrip(tx.SOFT_HYPHEN).rstrip(hyphens) + t
            else:
                out += (" " if out else "") + t
        return out

    rng = random.Random(2)
    parts = ["mot", "cou-", "pure", "Éta-", "a", "b-", "-", "x" + tx.SOFT_HYPHEN, "", "fin.", "été", "ab-"]
    data = [[rng.choice(parts) for _ in range(rng.choice([1, 3, 12, 600]))] for _ in range(60)] + [["long", "ligne-", "s"] * 4_000]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, t array<string>")
    got = {r.i: r.text for r in df.select("i", par.join_lines(F.col("t")).alias("text")).collect()}
    assert got == {i: plain(d) for i, d in enumerate(data)}


def layout_fragments(spark):
    """Pages of rows with one to three parts, a wide gap between cells, unequal sizes and parts that lie a little lower."""
    rng = random.Random(12)
    rows = []
    for page in range(40):
        for row in range(rng.randrange(1, 15)):
            for part in range(rng.randrange(1, 4)):
                rows.append((page // 8, page, len(rows), rng.choice(["Mot", "deux mots", "12", " x "]), 70.0 + 130 * part + rng.choice([0, 3]),
                             700.0 - 20 * row - rng.choice([0, 0, 2.5]), rng.choice([9.0, 11.0]), rng.random() < 0.3))
    return spark.createDataFrame(rows, "doc_id long, page_no int, seq int, text string, x double, y double, font_size double, bold boolean").selectExpr(
        "*", "'Helvetica' as font_name", "false as italic", "false as mono")


def test_lines_equal_a_plain_loop_and_pages_are_grouped_once(spark):
    import itertools
    import statistics

    from paideon.operators import lines as ln
    from paideon.operators.fragments import with_width

    measured = with_width(layout_fragments(spark)).selectExpr("*", "0L as zone", "0 as rank", "0 as column")
    lines = ln.build_lines(ln.group_rows(measured))
    want = set()
    found = sorted(measured.collect(), key=lambda f: (f.page_no, -f.y, f.x, f.seq))
    for page, own in itertools.groupby(found, key=lambda f: f.page_no):
        rows = []
        for f in own:
            head = rows[-1][0] if rows else None
            if head and abs(f.y - head.y) <= max(head.font_size, f.font_size, 1.0) * 0.45:
                rows[-1].append(f)
            else:
                rows.append([f])
        for n, row in enumerate(rows):
            size = statistics.median([f.font_size for f in row for _ in range(max(f.chars, 1))])
            chars = sum(f.chars for f in row)
            want.add((page, n, min(f.x for f in row), statistics.median([f.y for f in row]), size,
                      sum(f.chars for f in row if f.bold) / chars, len(row)))
    got = lines.collect()
    assert {(r.page_no, r.line_no, r.x, r.y, r.font_size, r.bold_ratio, r.fragments) for r in got} == want and len(got) == len(want)
    plan = lines._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ObjectHashAggregate(") == 2  # partial and final of the pages


def test_gutters_sort_the_fragments_of_a_page_once(spark):
    from paideon.operators import columns
    from paideon.operators.fragments import with_width

    rows = columns.gutters(with_width(layout_fragments(spark)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate(" not in plan


def test_layout_takes_its_fragments_once_and_judges_every_band(spark):
    from paideon.operators import columns
    from paideon.operators.fragments import with_width

    def column(page, x, rows, top=700.0, text="w" * 20):
        return [(0, page, 1000 * int(x) + r, text, x, top - 17 * r, 11.0) for r in range(rows)]

    rows = [
        *column(0, 70.0, 8), *column(0, 350.0, 8),
        *column(1, 70.0, 5), *column(1, 350.0, 5),
        *column(2, 70.0, 8), *column(2, 350.0, 8, top=300.0),
        *column(3, 70.0, 8), *column(3, 350.0, 2),
        *column(4, 70.0, 30), *column(4, 350.0, 6, text="w"),
        *column(5, 70.0, 8), *column(5, 350.0, 7, text="w" * 6), *column(5, 350.0, 1, top=500.0),
        *column(6, 70.0, 3),
        (None, 7, 0, "w", 70.0, 700.0, 11.0),
    ]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, seq int, text string, x double, y double, font_size double")
    layout = columns.column_layout(with_width(pages))
    plan = layout._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan
    got = {r.page_no: (r.column_count, r.reason) for r in layout.collect()}
    assert got.pop(0) == (2, columns.REASON_COLUMNS % (2, columns.REASON_ONE_GUTTER % 170))
    few = columns.REASON_FEW
    assert got == {1: (1, columns.REASON_BAND[4]), 2: (1, columns.REASON_NOT_FACING), 3: (1, columns.REASON_BAND[1]),
                   4: (1, columns.REASON_BAND[2]), 5: (1, columns.REASON_BAND[5]), 6: (1, few), 7: (1, few)}


def test_fragments_are_read_once_for_layout_and_lines(spark, monkeypatch):
    """Only the job that deals the fragments reads the input; the others read the table it wrote."""
    read, write = {}, st.stage

    def watched(df, label, by=()):
        read[label] = "Generate" in df._jdf.queryExecution().analyzed().toString()
        return write(df, label, by)

    monkeypatch.setattr(st, "stage", watched)
    rows = layout_fragments(spark).withColumn("text", F.explode(F.array("text")))
    pages = spark.createDataFrame([(0, 0, 612.0, 792.0)], "doc_id long, page_no int, width double, height double")
    st.marked_lines(rows, pages)
    assert read["fragments"] and not read["layout"]


def test_table_fragments_number_the_rows_once(spark, tmp_path):
    from paideon.sources.model_tables import ModelTables

    lines = [(o, n, f"1995-01-0{1 + n % 3}", 10 * o + n, n % 2, 100.5 * n, 5.0 + n, "A", "F") for o in (1, 2) for n in range(1, 5)]
    folder = str(tmp_path)
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate string, l_partkey long, l_suppkey long, l_extendedprice double,"
                          "l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "1-URGENT"), (2, "2-HIGH")], "o_orderkey long, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    tables = ModelTables(spark, folder)
    found = tables.table_fragments
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    want = set()
    for r in tables.table_rows.collect():
        want |= {(r.doc_id, 0, 3 * r.row_no + k, text, x, 700.0 - 20 * r.row_no, 11.0, r.bold)
                 for k, (text, x) in enumerate(((r.c0, 72.0), (r.c1, 200.0), (r.c2, 330.0)))}
    got = found.collect()
    assert {(r.doc_id, r.page_no, r.seq, r.text, r.x, r.y, r.font_size, r.bold) for r in got} == want and len(got) == len(want) == 27


def plan_above(frame, column):
    """Nodes of the first plan without broadcasts, from the scan that reads `column` up to the top."""
    conf, key = frame.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
    before = conf.get(key)
    conf.set(key, "-1")
    try:
        lines = frame.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        conf.set(key, before)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    at = next(i for i, line in enumerate(lines) if "Scan " in line and f"{column}#" in line)
    found, least = [], depth[at]
    for i in range(at, -1, -1):
        if i == at or depth[i] < least:
            found.append(lines[i].strip(" :+-"))
            least = depth[i]
    return found


def stored_structure(spark, tmp_path):
    spark.sql("select 1L as doc_id, 0L as heading_no, 1L as element_no, 'TEXT' as kind, 'long text' as text, 0 as page_start, 0 as page_end").write.parquet(f"{tmp_path}/blocks")
    spark.sql("select 1L as doc_id, 0L as heading_no, cast(null as long) as parent_no, 0L as position, 1 as level, 'T' as title").write.parquet(f"{tmp_path}/sections")
    tables = [spark.read.parquet(f"{tmp_path}/{name}") for name in ("blocks", "sections")]
    return st.Structure(*[None] * 7, *tables)


def test_corpus_texts_are_shuffled_once(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.pdf")], "doc_id long, source_file string")
    rows = st.corpus_blocks(files, stored_structure(spark, tmp_path))
    assert sum(node.startswith("Exchange ") for node in plan_above(rows, "text")) == 1
    assert [(r.source_file, r.section_title, r.text) for r in rows.collect()] == [("a.pdf", "T", "long text")]


def test_preview_cuts_texts_before_they_are_shuffled(spark, tmp_path):
    rows = st.preview(stored_structure(spark, tmp_path))
    nodes = plan_above(rows, "text")
    moved = next(i for i, node in enumerate(nodes) if node.startswith("Exchange "))
    assert any("substring(text" in node for node in nodes[:moved])
    assert [(r.path, r.title, r.text) for r in rows.collect()] == [([0], "T", "long text")]
