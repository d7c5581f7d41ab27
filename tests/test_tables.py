"""Sets of tables: switched together, joined without a shuffle; loads that the state store keeps apart."""

import pytest
from pyspark.sql import functions as F
from test_queries import SF, db  # noqa: F401

from cohortscore.functions import text as T
from cohortscore.operators import gold as G
from cohortscore.plans import gold as plans
from cohortscore.sources import tables as S
from cohortscore.streaming.incremental import load_once
from compare import canon


def test_gold_from_tables(spark, db):  # noqa: F811
    assert canon(plans.gold_from_tables(spark, SF).toPandas()) == canon(db.execute(plans.ORACLE["gold_from_tables"]).df())


def test_joins_of_a_set_move_no_row(spark, tmp_path):
    ids = spark.range(500).select((F.col("id") % 50).alias("k"), (F.col("id") / 50).cast("int").alias("y"), "id")
    sides = {"specs": ids.selectExpr("k", "y", "'b' AS brand", "'s' AS segment"), "accepted": ids.filter("k % 3 > 0").select("k", "y"), "scores": ids.selectExpr("k", "y", "double(id) AS score")}
    S.write_set(sides, dict.fromkeys(sides, ["k", "y"]), "moves", str(tmp_path), 4)
    got = S.read_set(spark, "moves", *sides)
    build = lambda t: G.build_gold(t["specs"], t["accepted"], t["scores"], ["k", "y"], "y", "brand", "segment", "score", "2001-12-31")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda t: build(t)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan(sides) and "hashpartitioning(k" not in plan(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert canon(build(got).toPandas()) == canon(build(sides).toPandas())


def test_a_set_is_switched_as_one(spark, tmp_path):
    one, two = spark.range(3).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    keys = {"a": ["k"], "b": ["k"]}
    with pytest.raises(ValueError):
        S.read_set(spark, "pair", "a")
    first = S.write_set({"a": one, "b": one.limit(0)}, keys, "pair", str(tmp_path), 2)
    old = S.read_set(spark, "pair", "a", "b")
    broken = two.withColumn("k", F.when(F.col("k") < 9, F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        S.write_set({"a": two, "b": broken}, keys, "pair", str(tmp_path), 2)
    assert S.current_version(spark, "pair") == first and S.read_set(spark, "pair", "a")["a"].count() == 3
    last = S.write_set({"a": two, "b": two}, keys, "pair", str(tmp_path), 2)
    assert last > first and {n: t.count() for n, t in S.read_set(spark, "pair", "a", "b").items()} == {"a": 5, "b": 5}
    assert old["a"].count() == 3 and old["b"].count() == 0
    S.drop_old(spark, "pair")
    assert S.versions(spark, "pair") == [last] and S.read_set(spark, "pair", "b")["b"].count() == 5
    for bad in ({}, {"a": one, "c": one}, {"a b": one}):
        with pytest.raises(ValueError):
            S.write_set(bad, keys | {"a b": ["k"]}, "pair", str(tmp_path), 2)


def test_load_once(spark, tmp_path):
    source, state, target = (str(tmp_path / x) for x in ("in", "state", "out"))
    schema, digest = "make string, year int, n long", T.request_digest(F.col("make"), F.col("year"))
    load = lambda: load_once(spark, source, schema, target, state, digest)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.createDataFrame([("Ford", 2015, 1), ("Kia", 2016, None), (None, None, 2**60)], schema).write.parquet(source)
    assert load() == 3 and load() == 3
    spark.createDataFrame([("kia ", 2016, 4), ("Seat", 2016, 5), ("seat", 2016, 5)], schema).write.mode("append").parquet(source)
    assert load() == 4
    assert {r["n"] for r in spark.read.parquet(target).collect()} == {1, None, 2**60, 5}
    assert list((tmp_path / "state/state/0").glob("*/*.zip")), "known digests are kept by RocksDB"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
