"""The registered queries and their SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 100


def core_names():
    from framelake.plans import registry

    return sorted(registry.ORACLE_SQL)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", core_names())
def test_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    df = e.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    rel = con.sql(e.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]


    def plain(v):
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, dict):
            return [plain(x) for x in v.values()]
        return round(float(v), 6) + 0.0 if isinstance(v, float) or v.__class__.__name__ == "Decimal" else v

    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_neighbours_and_grown_classes_see_all_rows(spark):
    import numpy as np

    import __spark_entry__ as e

    rows = sorted((r["vec_id"], [float(v) for v in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    inverse = np.linalg.inv(np.cov(x.T))
    got = {(r["query"], r["rank"]): r["id"] for r in e.queries()["m9_mahalanobis"](spark, SMALL).collect()}
    for q in ids[ids % 50 == 0]:
        d = np.einsum("ij,jk,ik->i", x - x[ids == q], inverse, x - x[ids == q])
        order = [i for i in ids[np.lexsort((ids, d.round(9)))] if i != q][:5]
        assert [got[q, k] for k in range(1, 6)] == order
    assert any(i % 50 == 0 for i in got.values())
    confusion = e.queries()["m15_grown_classes"](spark, SMALL)
    assert {r[0] for r in confusion.select("label" if "label" in confusion.columns else confusion.columns[0]).collect()} == {r[2] for r in rows}
