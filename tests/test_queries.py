"""Every registered panel query against its SQL."""

import math
import os

import duckdb
import pytest

from panelsmith.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(rows):
    def one(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = _norm(tuple(x) for x in df.select(*columns).collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({ORACLE_SQL[name]}) q").fetchall()
    assert rows == _norm(want)


def test_distinct_factors_of_many_tasks(spark):
    """On tables whose aggregates take several tasks, where a union of parts that are dealt alike once tore the cells."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("events", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES["distinct_factors"](spark, sf).collect()
    assert _norm(tuple(r) for r in got) == _norm(con.execute(ORACLE_SQL["distinct_factors"]).fetchall())


def test_crowding_of_equal_points(spark, tmp_path):
    """On three copies of each supplier: as the SQL with its ties broken by name."""
    con = duckdb.connect()
    for t, key in (("lineitem", "l_suppkey"), ("supplier", "s_suppkey"), ("events", None)):
        copies = f"SELECT t.* REPLACE ({key} + 1000 * k AS {key}) FROM '{SF}/{t}.parquet' t, range(3) r(k)" if key else f"SELECT * FROM '{SF}/{t}.parquet'"
        con.execute(f"COPY ({copies}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    text = ORACLE_SQL["crowding"]
    for f in ("f1", "f2", "f3"):
        text = text.replace(f"(ORDER BY {f})", f"(ORDER BY {f}, name)")
    want = con.execute(f"SELECT crowding, name FROM ({text}) q").fetchall()
    assert len({r[0] for r in want}) < len(want)
    assert _norm(tuple(r) for r in QUERIES["crowding"](spark, str(tmp_path)).select("crowding", "name").collect()) == _norm(want)


def test_stage_compare_reads_its_cells_once(spark):
    """All that follows reads stored scores; before, every reader of the books made the panel anew."""
    plan = QUERIES["stage_compare"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
