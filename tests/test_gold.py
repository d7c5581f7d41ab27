"""Labelled table, catalogs, contracts, registers, training and explanations: SQL on the smallest tables and literal cases."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from test_queries import SF, db  # noqa: F401

from cohortscore.functions import text as T
from cohortscore.operators import cohorts as C
from cohortscore.operators import gold as G
from cohortscore.operators import matching as M
from cohortscore.operators import models
from cohortscore.operators import training as R
from cohortscore.plans import catalogs, gold, training
from cohortscore.plans import queries as Q
from cohortscore.sources import catalogs as S
from cohortscore.streaming.incremental import load_new
from compare import canon

ALL = {**gold.QUERIES, **catalogs.QUERIES, **training.QUERIES}
SQL = {k: v for p in (gold, catalogs, training) for k, v in p.ORACLE.items() if k in ALL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):  # noqa: F811
    assert canon(ALL[name](spark, SF).toPandas()) == canon(db.execute(SQL[name]).df())


def test_keys(spark):
    rows = spark.createDataFrame([("Mercedes-Benz",), ("MercedesBenz",), ("Chevy",), ("ofﬁce ½",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.comparison_make(F.col("t"))).collect()] == ["mercedes benz", "mercedes benz", "chevrolet", "office 1 2", ""]
    assert T.column_name("Engine HP (cv)") == "engine_hp_cv"


def test_canonical_text_of_every_character(spark):
    letters = [c for c in map(chr, range(1, 0x20000)) if not "\ud800" <= c <= "\udfff"]
    rows = spark.createDataFrame([(f"a{c}b",) for c in letters], "t string")

    def folded(text):
        bare = "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x)).lower()
        return " ".join(re.findall("[a-z0-9]+", bare))

    got = rows.select("t", T.canonical_text(F.col("t")).alias("k")).collect()
    assert [(r["t"], r["k"]) for r in got if r["k"] != folded(r["t"])] == []
    assert {r["k"] for r in got} >= {"aivb", "akgb"}  # U+2163, U+338F


def test_heaviest_event_of_a_campaign(spark):
    rows = spark.createDataFrame([("v", "c", None, 1), ("v", "c", 2.0, 3), ("v", "c", 2.0, 2), ("v", "d", None, 9), ("v", "d", None, 8), (None, "c", 1.0, 7)], "id string, c string, w double, n int")
    best = C.best_of_campaign(rows, "id", "c", "w", ["n"])
    assert best.columns == rows.columns and sorted(r["n"] for r in best.collect()) == [2, 7, 8]


def test_scale_says_where_it_comes_from(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "s string, v double")
    asked = spark.createDataFrame([("a", 2.0), ("z", 3.0), (None, 3.0)], "s string, v double")
    got = C.scaled_index(asked, C.fit_scale(train, "s", "v"), "s", "v", origin="scale_origin").collect()
    assert {r["s"]: (r["scale_origin"], r["index_100"]) for r in got} == {"a": ("segment", 50.0), "z": ("global", 50.0), None: ("global", 50.0)}


def test_failed_responses_ask_for_an_audit(spark):
    schema = "id int, cand_id string, status string, audit_required boolean, advice string"
    matches = spark.createDataFrame([(1, "a", "auto_accepted", False, "ok"), (2, "b", "auto_accepted", False, "ok"), (3, "x", "manual_accepted", False, "ok"), (4, "b", "rejected", True, "no")], schema)
    replies = spark.createDataFrame([("a", "valid_zero_recalls", 1), ("b", "unverified_zero_result", 2)], "cand_id string, query_status string, extra int")
    got = {r["id"]: (r["status"], r["audit_required"], r["advice"]) for r in G.transfer_failures(matches, replies).collect()}
    assert got == {1: ("auto_accepted", False, "ok"), 2: ("unverified_zero_result", True, T.NO_LABEL), 3: ("query_failed", True, T.NO_LABEL), 4: ("rejected", True, "no")}
    twice = replies.unionByName(replies.limit(1))
    with pytest.raises(Exception, match="repeats a key"):
        G.transfer_failures(matches, twice).collect()


def test_serving_catalog_has_each_vehicle_once(spark):
    gold = spark.createDataFrame([("1", " Ford", "KA", "2001", 5.0, 2), ("1", "Ford", "Ka", "2001", 6.0, 1), ("2", None, "x", "2001", 7.0, 3)], "id string, make string, model string, y string, score double, n int")
    recent = spark.createDataFrame([("1", "Ford", "Ka", "2001", 4), ("3", "Seat", "Ibiza ", "2020", 5), ("4", "Seat", "Leon", "unknown", 6)], "id string, make string, model string, y string, n int")
    out = G.serving_catalog(gold, recent, ["id"], names=["make", "model"], year="y", order=["n"])
    got = sorted((r["id"], r["make"], r["model"], r["y"], r["score"], r["origin"]) for r in out.collect())
    assert got == [("1", "ford", "ka", 2001, 6.0, "gold"), ("3", "seat", "ibiza", 2020, None, "inference")]
    with pytest.raises(Exception, match="repeats a key"):
        G.serving_catalog(gold, recent.withColumn("seen", F.lit(1)), ["id"], ["seen"]).collect()


def test_events_without_campaign_stay_apart(spark):
    rows = spark.createDataFrame([("v", None, "Brakes!", 3.0, 1), ("v", " ", "brakes", 3.0, 2), ("v", None, "paint", 1.0, 3), ("v", "c", "x", 1.0, 4), ("v", "c", "y", 3.0, 5)], "id string, c string, d string, w double, n int")
    assert sorted(r["n"] for r in C.best_of_campaign(rows, "id", "c", "w", ["n"], "d").collect()) == [1, 3, 5]


def test_history_for_years_without_rows(spark):
    rows = spark.createDataFrame([("a", 2000, 2.0), ("a", 2001, 4.0)], "b string, y int, v double")
    asked = spark.createDataFrame([("a", 2004), ("z", 2004), ("z", 2010)], "b string, y int")
    got = {(r["b"], r["y"]): (r["history"], r["history_source"]) for r in C.lagged_history(rows, "b", "y", "v", asked=asked).collect()}
    assert got[("a", 2004)] == (3.0, "own") and got[("z", 2004)] == (3.0, "market") and got[("z", 2010)] == (None, None)


def test_matcher_guards(spark):
    rows = spark.createDataFrame([(1, "Ford", "F-150", 2015)], "id int, make string, model string, year int")
    catalog = spark.createDataFrame([(1, "ford", "F150", 2015, False)], "cand_id int, make string, model string, year int, verified boolean")
    for bad in ((rows.union(rows), catalog.withColumn("verified", F.lit(True))), (rows, catalog), (rows, catalog.union(catalog))):
        with pytest.raises(ValueError):
            M.match_entities(*bad, ())
    assert M.match_entities(rows, catalog, (), require_verified=False).first()["status"] == "auto_accepted"


@pytest.mark.parametrize("years,want", [(range(1995, 2024), {"train": set(range(1995, 2017)), "train_embargoed": {2017, 2018}, "validation": {2019}, "validation_embargoed": {2020, 2021}, "test": {2022, 2023}}), ([2020], {"train": {2020}}), ([2019, 2020], {"train_embargoed": {2019}, "validation": {2020}}), ([1995, 2000, 2005, 2010, 2015], {"train": {1995, 2000, 2005}, "validation": {2010}, "test": {2015}})])
def test_adaptive_split(spark, years, want):
    rows = spark.createDataFrame([(y,) for y in years], "y int")
    got = {}
    for r in R.adaptive_split(rows, "y", 2018, 2021).collect():
        got.setdefault(r["partition"], set()).add(r["y"])
    assert got == want


def test_ridge_attribution_adds_up(spark):
    train, test = training._parts(spark, SF)
    fitted = models.fit_ridge(train, ["y", "prio"], ["c_mktsegment", "brand"], "o_totalprice")
    first = train.orderBy("o_orderkey").limit(1)
    reference = first.select("y", "prio", "c_mktsegment", "brand").first().asDict()
    base = fitted.predict(first).first()["predicted"]
    out = R.ridge_attribution(fitted.predict(test), fitted, ["c_mktsegment", "brand"], reference, R.ridge_coefficients(fitted, ["c_mktsegment", "brand"], train))
    gap = F.abs(F.col("predicted") - base - sum(F.col(f"effect_{c}") for c in reference))
    assert out.count() > 0 and out.agg(F.max(gap)).first()[0] < 1e-5


def test_guards(spark):
    left = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="right side repeats"):
        G.checked_join(left, left.union(left).withColumnRenamed("v", "w"), ["k"]).collect()
    with pytest.raises(Exception, match="left side repeats"):
        G.checked_join(left.union(left), left.withColumnRenamed("v", "w"), ["k"], unique="both").count()
    none = spark.createDataFrame([(None, "x"), (None, "y"), (1, "z")], "k int, w string")
    assert sorted(map(tuple, G.checked_join(none, left, ["k"], unique="both").select("k", "w", "v").collect()), key=str) == [(1, "z", "a"), (None, "x", None), (None, "y", None)]
    assert G.checked_join(left, left.withColumnRenamed("v", "w"), ["k"], unique="both").count() == 1
    with pytest.raises(ValueError):
        G.in_scope(left, "v", "k", ["zzz"])
    windows = spark.createDataFrame([(1, 2, 3), (1, 1, 4), (2, 5, 6), (7, None, 9), (5, 6, 8)], "train_end int, validation_end int, test_end int")
    assert sorted(tuple(r)[:2] for r in R.window_violations(windows).collect()) == [("cuts_do_not_rise", 1), ("cuts_do_not_rise", 7), ("tests_overlap", 1)]
    with pytest.raises(ValueError):
        R.temporal_windows(left.withColumnRenamed("k", "y"), [(1, 1, 4)], "v", "v", "y", "y")
    assert G.without_outcomes(left, ["v"]).columns == ["k"]


def test_chosen_model_is_one_of_the_candidates(spark):
    assert training.chosen_model(spark, SF).first()["model"] in ("baseline", "ridge")


def test_sinks(spark, tmp_path):
    rows = Q._orders(spark, SF).select("o_orderkey", "y", "brand")
    S.write_raw(rows, str(tmp_path / "raw"))
    with pytest.raises(Exception, match="already exists"):
        S.write_raw(rows, str(tmp_path / "raw"))
    for _ in range(2):
        S.write_table(rows, str(tmp_path / "t"), "y")
    assert spark.read.parquet(str(tmp_path / "t")).count() == rows.count() and (tmp_path / "t" / "y=1997").exists()
    matches = spark.createDataFrame([("b", "m", "x", 1), ("a", "m", "x", 2)], "status string, make string, model string, year int")
    S.write_audit(matches, str(tmp_path / "a"))
    assert [r["status"] for r in spark.read.csv(str(tmp_path / "a"), header=True).collect()] == ["a", "b"]
    S.write_report(matches, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert S.result_export(matches, ["model"], "none").columns == ["status", "make", "year", "especificacion_model", "limitacion"]


def test_incremental_load(spark, tmp_path):
    at = [str(tmp_path / x) for x in ("in", "out", "state")]
    digest = T.request_digest(F.col("make"), F.col("year"))
    spark.createDataFrame([("Ford", 2015, 1), ("FORD", 2015, 2), ("Kia", 2016, 3)], "make string, year int, n int").write.parquet(at[0])
    assert load_new(spark, at[0], "make string, year int, n int", at[1], at[2], digest, ["n"]) == 2
    spark.createDataFrame([("kia", 2016, 4), ("Seat", 2016, 5)], "make string, year int, n int").write.mode("append").parquet(at[0])
    assert load_new(spark, at[0], "make string, year int, n int", at[1], at[2], digest, ["n"]) == 3
    assert sorted(r["n"] for r in spark.read.parquet(at[1]).collect()) == [1, 3, 5]
