import glob
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["prefix_endpoints", "health_samples", "drift_report", "fold_metrics", "spectra"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = entry.queries()[name](spark, SMALL).toPandas(), c.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for k in cols:
        if got[k].dtype.kind == "f":
            assert got[k].to_numpy() == pytest.approx(want[k].to_numpy(float), abs=2e-6, nan_ok=True)
        else:
            assert got[k].tolist() == want[k].tolist()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 15
