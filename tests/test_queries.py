"""Every query with SQL against DuckDB on the smallest tables, and literal cases of the operators."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortscore.functions import text as T
from cohortscore.operators import cohorts as C
from cohortscore.plans.queries import ORACLE, QUERIES
from compare import TABLES, canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, name):
    assert canon(QUERIES[name](spark, SF).toPandas()) == canon(db.execute(ORACLE[name]).df())


def test_severity_words(spark):
    classes = (("critical", ("engine", "brake")), ("moderate", ("airbag",)))
    df = spark.createDataFrame([("engineered paint finish",), ("brakes hydraulic defect",), ("air bags failure",), (None,)], "t string")
    assert [r[0] for r in df.select(T.keyword_class(F.col("t"), classes)).collect()] == ["unclassified", "critical", "moderate", "unclassified"]


def test_window_is_calendar_years(spark):
    cohorts = spark.createDataFrame([("a", 2010), ("b", 2010)], "id string, y int")
    events = spark.createDataFrame([("a", 2010, 3.0), ("a", 2012, 1.5), ("a", 2013, 3.0), ("a", None, 3.0), ("a", 2009, 3.0)], "id string, ey int, w double")
    got = {r["id"]: (r["score"], r["n_in_window"], r["n_outside"], r["n_undated"]) for r in C.window_scores(cohorts, events, "id", "y", "ey", "w").collect()}
    assert got == {"a": (4.5, 2, 3, 1), "b": (0.0, 0, 0, 0)}


def test_maturity(spark):
    row = spark.sql("select 2023 y").select(C.mature(F.col("y"), "2025-12-31").alias("a"), C.mature(F.col("y"), "2026-01-01").alias("b")).first()
    assert (row["a"], row["b"]) == (False, True)


def test_split_embargo(spark):
    rows = spark.range(1995, 2024).select(F.col("id").cast("int").alias("y"))
    got = {r["y"]: r["partition"] for r in C.temporal_split(rows, "y", 2018, 2021).collect()}
    assert [y for y, p in got.items() if p == "train_embargoed"] == [2017, 2018]
    assert [y for y, p in got.items() if p == "validation"] == [2019]
    assert [y for y, p in got.items() if p == "validation_embargoed"] == [2020, 2021]


def test_history_ignores_later_rows(spark):
    rows = [("a", y, float(y - 1990)) for y in range(1995, 2004)]
    one = C.lagged_history(spark.createDataFrame(rows, "b string, y int, v double"), "b", "y", "v")
    two = C.lagged_history(spark.createDataFrame([(b, y, v if y < 2003 else 99.0) for b, y, v in rows], "b string, y int, v double"), "b", "y", "v")
    assert {r["y"]: r["history"] for r in one.collect()} == {r["y"]: r["history"] for r in two.collect()}
