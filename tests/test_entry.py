import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrand.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.QUERIES) >= 52


def test_training_data_queries_are_registered():
    """All of them, unless their folders are gone: a missing package must not hide them."""
    if not os.path.isdir(os.path.join(os.path.dirname(entry.__file__), "lodestrand", "llm")):
        pytest.skip("the subpackage is not here")
    names = set(entry.queries()) - set(catalog.QUERIES)
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names - {"pipeline"}) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_equal_their_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = sorted((tuple(plain(x) for x in r) for r in duck.sql(f"SELECT {listed} FROM ({catalog.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want


def test_scans_read_only_what_they_need(spark):
    plan = catalog.QUERIES["q15_tokenize_term_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan
