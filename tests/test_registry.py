"""Every query against its SQL, and without one against a plain run."""

import os
from decimal import Decimal

import duckdb
import pytest

from strikeframe.plans import audit_queries, crawl_queries, page_queries, payload_queries, registry, reports, scale_queries, slate_queries, status_queries, stream_queries  # noqa: F401  the others add their queries to the registry's

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 9) if isinstance(v, float) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in values], key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.ORACLE:
        rel = oracle.sql(registry.ORACLE[name])
        want = rows(rel.columns, rel.fetchall())
        assert got[0] == want[0]
        assert got[1] == want[1]
    else:
        assert got[1]
