"""Registered queries against their SQL on the smallest driver tables."""

import functools
import os

import pytest

from check_oracle import compare, connect
from paideon.plans import all_queries, layout_documents
from paideon.session import tune
from paideon.sources.model_tables import ModelTables

FOLDER = "/root/testdata/sf0.001"
NAMES = list(all_queries())


@pytest.fixture(scope="module", autouse=True)
def one_chain(spark):
    """The structuring chain runs once here; its queries read the same stage tables."""
    kept = {name: functools.cache(getattr(layout_documents, name)) for name in ("_marked", "_structure")}
    shared = ModelTables(tune(spark), FOLDER)
    with pytest.MonkeyPatch.context() as patch:
        for name, function in kept.items():
            patch.setattr(layout_documents, name, lambda t, f=function: f(shared))
        yield


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    rows, problem, _ = compare(spark, db, all_queries()[name], FOLDER)
    assert problem is None


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
