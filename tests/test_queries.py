"""Every query against its SQL in DuckDB; those without SQL must at least give rows."""

import duckdb
import pyarrow.dataset as ds
import pytest
from conftest import DATA, frame_of

from inventra.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.register(t, ds.dataset(f"{DATA}/{t}.parquet").to_table())
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = frame_of(catalog.QUERIES[name](spark, sf_dir))
    if name not in catalog.ORACLES:
        assert got[1]
        return
    want = frame_of(duck.execute(catalog.ORACLES[name]).fetchdf())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_graph_neighbours_of_ids_that_overlap(spark, tmp_path):
    """Customers from 100,000 on, one without a customer row, one without orders, a supplier below zero and lines without an order."""
    con = duckdb.connect()
    rows = {
        "customer": "SELECT unnest([0, 50, 200, 99950, 100000, 100050])::BIGINT AS c_custkey",
        "orders": "SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8])::BIGINT AS o_orderkey, unnest([0, 50, 150, 51, 99950, 100000, 100050, NULL])::BIGINT AS o_custkey",
        "lineitem": "SELECT unnest([1, 2, 2, 3, 4, 5, 6, 7, 7, 8, 9])::BIGINT AS l_orderkey, unnest([0, 50, 50, 7, -50, 50, 0, 50, -100, 9, 50])::BIGINT AS l_suppkey, 'R' AS l_returnflag, 0.05::DOUBLE AS l_discount",
    }
    for name, sql in rows.items():
        con.execute(f"CREATE TABLE {name} AS {sql}")
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = frame_of(catalog.QUERIES["graph_neighbours"](spark, str(tmp_path)))
    want = frame_of(con.execute(catalog.ORACLES["graph_neighbours"]).fetchdf())
    assert got == want
    assert {r[got[0].index("node")] for r in got[1]} == {"0", "50", "150", "99950", "99900"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["full_hash", "size_bytes", "members", "canonical_entry_id"]
    assert set(e.oracle_sql()) <= set(e.queries())
