"""One local session for all tests, and the check of a query against its SQL."""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")

    def check(query, sql):
        df = query(spark, SMALL)
        names = sorted(df.columns)
        rel = con.execute(sql)
        assert sorted(d[0] for d in rel.description) == names
        at = [[d[0] for d in rel.description].index(n) for n in names]
        want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
        assert sorted(tuple(plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in names]).collect()) == want

    return check
