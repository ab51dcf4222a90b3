"""Every registered query against its SQL.  By default a cross-section; all with FORMLOOM_ALL=1."""

import os

import pytest

from formloom.plans import load
from tools.check import TABLES, compare

QUERIES, SQL = load()
SAMPLE = ("fun_01 fun_08 fun_11 fun_13 fun_18 fun_21 fun_32 fun_33 win_04 win_06 win_09 win_10 win_11 win_20 win_21 efa_02 efa_03 "
          "efa_05 efa_07 efa_09 src_02 src_10 prj_01 prj_09 prj_17 prj_20 jon_01 jon_02 jon_05 jon_09 jon_11 jon_14 agg_06 agg_07 "
          "agg_13 agg_15 srt_04 srt_06 set_01 mul_01 mul_05 mul_12 clu_06 clu_07 res_02 res_04 res_17 res_23 res_26 img_01 img_05 img_09").split()
NAMES = sorted(QUERIES) if os.environ.get("FORMLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    import duckdb
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    msg, _, _, ok = compare(spark, name, QUERIES[name], SQL.get(name), con, sf)
    assert ok, msg


def test_contract(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
