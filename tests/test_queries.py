"""Every query with a DuckDB twin meets it on the smallest tables; sources and the stream monitor."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from evenhand.plans.queries import ORACLE_SQL, QUERIES
from evenhand.sources import readers
from evenhand.streaming.monitor import fairness_monitor

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_meets_sql(spark, duck, tmp_path, name):
    QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "q"))
    got = f"'{tmp_path}/q/*.parquet'"
    duck.execute(f"CREATE OR REPLACE TABLE want AS {ORACLE_SQL[name]}")
    names = sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall())
    assert names == sorted(r[0] for r in duck.execute(f"DESCRIBE SELECT * FROM {got}").fetchall())
    cols = ", ".join(f'"{c}"' for c in names)
    for a, b in (("want", got), (got, "want")):
        assert duck.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_other_operators_or_their_libraries():
    """Whatever keeps the subpackage from being imported, the own queries stay."""
    import subprocess
    import sys

    code = "import sys\nsys.modules[{!r}] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()))"
    for absent in ("xxhash", "evenhand.llm", "corpus_pipeline"):
        out = subprocess.run([sys.executable, "-W", "ignore", "-c", code.format(absent)], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=120)
        assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))], out.stderr


def test_readers(spark, tmp_path):
    german = tmp_path / "g"
    german.write_text("A13 11 A31 A40 2500 A62 A72 3 A91 A103 1 A124 50 A141 A151 3 A174 2 A191 A202 1\nA14 30 A33 A49 777 A64 A71 1 A95 A102 3 A122 31 A142 A153 2 A172 1 A192 A201 2\n")
    g = readers.read_german(spark, str(german)).collect()
    assert [(r["sex"], r["credit"], r["age"]) for r in g] == [(1, 1, 50), (0, 0, 31)]
    heart = tmp_path / "h"
    heart.write_text("50.0 0.0 1.0 120.0 200.0 1.0 0.0 150.0 1.0 0.5 1.0 0.0 7.0 2\n")
    assert readers.read_heart(spark, str(heart)).first()["heart_disease"] == 0
    adult = tmp_path / "a"
    adult.write_text("age,fnlwgt,race,sex,native-country,Probability\n39,1, White, Male, X, >50K\n20,2, Black, Female, Y, <=50K\n")
    a = readers.read_adult(spark, str(adult)).orderBy("age").collect()
    assert [(r["sex"], r["race"], r["Probability"]) for r in a] == [(0, 0, 0), (1, 1, 1)]
    x, y = readers.split_target(readers.read_german(spark, str(german)), "credit")
    assert "credit" not in x.columns and y.columns == ["credit"] and x.count() == y.count() == 2
    with pytest.raises(ValueError, match="no column"):
        readers.read_heart(spark, str(heart), target="no")
    with pytest.raises(ValueError, match="no column"):
        readers.split_target(x, "credit")


def test_monitor_of_a_stream_meets_the_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 4}:10:00", i % 2, int(i % 3 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "ts string, s int, p int").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = fairness_monitor(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "s", "p")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("fair").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("fair").orderBy("start").collect()
    assert got == fairness_monitor(df, "ts", "s", "p").orderBy("start").collect() and len(got) == 4
