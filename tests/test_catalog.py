"""Every query on the dataflow operators against DuckDB."""

import pytest

from shardflow import catalog
from tests.conftest import SMALL
from tests.oracle import of_duckdb, of_spark


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, name):
    names, got = of_spark(catalog.queries()[name](spark, SMALL))
    want_names, want = of_duckdb(catalog.oracle_sql()[name], SMALL)
    assert names == want_names
    assert len(got) == len(want)
    assert got == want


def test_order_of_sorted_queries(spark):
    q = catalog.queries()
    keys = [r["key"] for r in q["sort_global"](spark, SMALL).collect()]
    assert keys == sorted(keys)
    names = [r["value"] for r in q["sort_ci"](spark, SMALL).collect()]
    assert names == sorted(names, key=lambda x: (x.lower(), x))
    merged = [tuple(r) for r in q["merge_sorted"](spark, SMALL).collect()]
    assert merged == sorted(merged)
    top = [r["o_totalprice"] for r in q["top_orders"](spark, SMALL).collect()]
    assert len(top) == 100 and top == sorted(top, reverse=True)
