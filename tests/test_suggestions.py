"""Suggestion lists: what is shuffled grows with the rows, not with the pairs, and odd tables give the rows of the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortscore.plans import catalogs
from cohortscore.sources import catalogs as S
from compare import canon

COLUMNS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
ODD = {
    "keys with rows in several blocks": [(k, "n", "ab"[j % 2], "t", j % 3) for j in range(6) for k in (1, 3, 5, 60, 62, 4)],
    "rows that come again": [(k, "n", "a", "t", 1) for k in range(40, 70) for _ in range(k % 3 + 1)],
    "keys below zero": [(k, "n", "a", "t", 1) for k in range(-230, 240, 3)],
    "nothing to compare with": [(k, "n", "a", "t", k) for k in range(9)] + [(None, "n", "a", "t", 1), (1, "n", None, "t", 2), (2, "n", None, "t", 2), (51, "n", "b", "t", None), (50, "n", "b", "t", None)],
    "no candidates": [(k, "n", "a", "t", 1) for k in range(1, 99, 2)],
    "no rows": [],
}


@pytest.mark.parametrize("case", sorted(ODD))
def test_odd_tables(spark, tmp_path, case):
    spark.createDataFrame(ODD[case], COLUMNS).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert canon(catalogs.suggestion_lists(spark, str(tmp_path)).toPandas()) == canon(db.execute(catalogs.ORACLE["suggestion_lists"]).df())


def shuffled(spark, run) -> int:
    """Bytes of shuffle files that a call writes."""
    context, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    context.setJobGroup(name := f"shuffled-{id(run)}", "")
    run()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup(name)]
    return sum(store.lastStageAttempt(k).shuffleWriteBytes() for k in {k for j in jobs for k in j.stageIds})


def test_pairs_are_not_shuffled(spark, tmp_path):
    sent = {}
    for n in (2000, 8000):
        spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("a").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/{n}/part.parquet")
        sent[n] = shuffled(spark, lambda d=f"{tmp_path}/{n}": catalogs.suggestion_lists(spark, d).write.format("noop").mode("overwrite").save())
    assert 0 < sent[8000] < 6 * sent[2000] and sent[8000] < 100 * 8000, sent


def test_rows_that_read_alike_share_a_list(spark):
    rows = spark.createDataFrame([("x", 1, "ab"), ("y", 1, "ab"), ("z", 1, "q"), ("z", 2, "ab"), (None, 2, "ab"), ("w", 3, "ab"), ("v", 1, None)], "k string, b int, name string")
    candidates = spark.createDataFrame([(1, "abc"), (1, "b"), (1, "a"), (2, "ba"), (2, "b"), (2, None), (None, "ab")], "b int, c string")
    score = lambda name, c: F.size(F.array_intersect(F.split(name, ""), F.split(c, "")))
    got = {r["k"]: [tuple(s) for s in r["suggestions"]] for r in S.suggestions(rows, candidates, ["b"], "k", "name", "c", score, 1).collect()}
    assert got == {"x": [(2, "abc"), (1, "a"), (1, "b")], "y": [(2, "abc"), (1, "a"), (1, "b")], "z": [(2, "ba"), (1, "b")], None: [(2, "ba"), (1, "b")]}
