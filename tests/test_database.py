"""Databases embedded in the driver, whose tasks may run in other processes."""

import datetime
import json
import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pyspark
import pytest

from tallyloom.plans import exchange_sql
from tallyloom.sources import tables as S

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}

ON_CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", sys.argv[2]).config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
print("ROWS", json.dumps([list(map(list, __spark_entry__.queries()["through_database"](s, sys.argv[1]).collect())) for _ in range(2)]))
s.stop()
"""


def test_through_database_on_a_cluster(folder, tmp_path):
    """Executors in processes of their own; a second call finds the first one's table."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # the workers write to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"SPARK_HOME": str(home), "PYTHONPATH": str(Path(__file__).parent.parent), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    run = subprocess.run([sys.executable, "-c", ON_CLUSTER, folder, str(tmp_path / "shared")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = [line for line in run.stdout.splitlines() if line.startswith("ROWS ")]
    assert said, run.stderr[-2000:]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW county_dim AS SELECT * FROM '{folder}/county_dim.parquet'")
    want = sorted(con.execute(exchange_sql.ORACLES["through_database"]).fetchall())
    first, second = json.loads(said[0][5:])
    assert sorted(map(tuple, first)) == sorted(map(tuple, second)) == want


def test_driver_keeps_all_rows_types_and_nulls(spark, monkeypatch):
    """As in a session of several processes: several batches, all kinds of columns, appended rows, an empty table, a refused second write."""
    types = "i int, n long, x double, t string, d date, at timestamp, b boolean, m decimal(12,2), raw binary"
    day, at = datetime.date(2020, 2, 29), datetime.datetime(2020, 2, 29, 23, 59, 58, 123456)
    rows = [(k, 2**40 + k, k / 3, f"it's {k} é" if k % 3 else "", day, at, k % 2 == 0, Decimal("1234567.89"), b"\0\xff") for k in range(25)] + [(None,) * 9]
    df = spark.createDataFrame(rows, types).repartition(3)
    url = "jdbc:derby:memory:kept;create=true"
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    monkeypatch.setattr(S, "in_one_process", lambda s: False)
    read = lambda where="": S.read_jdbc(spark, url, f"SELECT * FROM kept {where}", fetch_size=4, **DERBY)
    as_rows = lambda got: sorted(map(repr, got))
    S.write_jdbc(df, url, "kept", batch_size=4, **DERBY)
    assert as_rows(map(tuple, read().collect())) == as_rows(rows)
    S.write_jdbc(df.where("i < 3"), url, "kept", mode="append", **DERBY)
    assert read().count() == 29 and read('WHERE "i" < 3').count() == 6
    assert read('WHERE "i" > 99').count() == 0
    with pytest.raises(Exception, match="already exists"):
        S.write_jdbc(df, url, "kept", mode="error", **DERBY)
    S.write_jdbc(df.where("i > 99"), url, "kept", **DERBY)
    assert read().count() == 0
    assert S._driver_only(spark, url) and not S._driver_only(spark, "jdbc:derby://host/db") and not S._driver_only(spark, "jdbc:mysql://host/db")
