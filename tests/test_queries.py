import os

import pytest

import __spark_entry__ as entry
from lamina.fit_queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_equals_its_sql(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for file in os.listdir(DATA):
            con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{DATA}/{file}'")
        want, names = con.sql(SQL[name]).df(), sorted(got.columns)
        assert names == sorted(want.columns)
        got, want = (x[names].sort_values(names).reset_index(drop=True) for x in (got, want))
        assert got.astype(str).equals(want.astype(str))


def test_entry(spark):
    assert entry.entry(spark).count() == 2 and set(entry.oracle_sql()) <= set(entry.queries())


def test_adjusted_p_values_cover_every_supplier(spark):
    data = "/root/testdata/sf0.01"
    got = QUERIES["adjusted_p_values"](spark, data).toPandas().sort_values("k")
    keys = sorted(r[0] for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_suppkey").distinct().collect())
    p = [(1 + k * 37 % 101) / 2000 for k in keys]
    ranked, m = sorted(p), len(p)
    holm = [min(1, max((m - i) * q for i, q in enumerate(ranked) if q <= x)) for x in p]
    fdr = [min(1, min(m * q / (i + 1) for i, q in enumerate(ranked) if q >= x)) for x in p]
    assert list(got["k"]) == keys and len(keys) > 60
    for name, want in (("p", p), ("holm", holm), ("fdr", fdr), ("bonferroni", [min(1, m * x) for x in p])):
        assert list(got[name]) == pytest.approx(want, abs=2e-6)
