"""Registered queries against their SQL, and the pipeline's stages against plain versions."""

import os

import duckdb
import pytest

import corpus_pipeline
from paideon.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = sorted(con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall(), key=repr)
    assert got == want and got


def test_stages(spark):
    from test_llm_operators import ITEMS, plain_groups, plain_report  # noqa: F401

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = queries.table(spark, FOLDER, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in queries.table(spark, FOLDER, "benchmark").collect()]

    def ids(name, df):
        out = dict(corpus_pipeline.STAGES)[name](spark, df, FOLDER)
        assert out.columns == docs.columns
        left = out.collect()
        assert all(r == rows[r.doc_id] for r in left) and len({r.doc_id for r in left}) == len(left)
        return {r.doc_id for r in left}

    last = {r.text or "": i for i, r in sorted(rows.items())}
    assert ids("exact_dedup", docs) == set(last.values())
    plain = [(i, r.text) for i, r in rows.items()]
    assert ids("near_dedup", docs) == {i for i, (_, c) in plain_groups(plain, 5).items() if i == c}
    assert ids("decontamination", docs) == {r[0] for r in plain_report(plain, bench) if not r[5]}
    assert ids("toxicity", docs) <= set(rows)


def test_stages_take_odd_and_no_rows(spark):
    from test_llm_operators import documents

    rows = [(*r, 1) for r in documents()] + [(None, "lost id " * 20, None, None, None, 1), (None, None, None, None, None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int"
    odd, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, FOLDER)
        assert out.count() > 0 and stage(spark, none, FOLDER).count() == 0
        if name != "packing":
            assert out.columns == odd.columns
