"""Imputing ridge against numpy, persistence, importance, training as one operation, and the audit of saved models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortscore.operators import frozen as Z
from cohortscore.operators import models as M
from cohortscore.operators.estimators import prepare_features

FRAME = Z.Frame("id", "brand", "segment", "year", "raw", "mature", ("power", "cylinders"))


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 400
    df = pd.DataFrame({"id": [f"v{i}" for i in range(n)], "brand": rng.choice(["A", "b ", "C", "D"], n), "segment": rng.choice(["s", "t", "u"], n), "year": 2000 + np.arange(n) % 18})
    df["power"] = np.where(rng.random(n) < 0.2, np.nan, rng.integers(50, 300, n) + 0.5)
    df["cylinders"] = np.where(rng.random(n) < 0.1, np.nan, rng.integers(3, 9, n))
    df.loc[df.brand == "D", "power"] = np.nan  # no median of its own
    df["raw"] = np.abs(df.power.fillna(120) / 40 + (df.brand == "C") * 3 + rng.normal(0, 0.3, n))
    df["mature"] = True
    return spark.createDataFrame(df.astype(object).where(df.notna(), None), "id string, brand string, segment string, year int, power double, cylinders double, raw double, mature boolean").cache()


def test_ridge_with_nulls_equals_closed_form(spark, frame):
    pdf = prepare_features(frame, ["id", "year", "raw"], ["power", "cylinders"], ["brand", "segment"]).toPandas()
    train, later = pdf[pdf.year <= 2010].copy(), pdf[pdf.year > 2010].copy()

    def filled(df):
        out = df.copy()
        for c in ("power", "cylinders"):
            both, seg = train.groupby(["brand", "segment"])[c].median(), train.groupby("segment")[c].median()
            keys = list(zip(df.brand, df.segment))
            out[c] = df[c].fillna(pd.Series([both.get(k, np.nan) for k in keys], df.index)).fillna(df.segment.map(seg)).fillna(train[c].median()).fillna(0.0)
        return out

    a, b = filled(train), filled(later)

    def design(df):
        return np.column_stack([(df[c] - a[c].mean()) / a[c].std(ddof=0) for c in ("power", "cylinders")] + [(df[c] == v).astype(float) for c in ("brand", "segment") for v in sorted(a[c].unique())])

    x, mean, wide = design(a), a.raw.mean(), a.raw.std(ddof=0)
    mid = x.mean(axis=0)
    w = np.linalg.solve((x - mid).T @ (x - mid) + np.eye(x.shape[1]), (x - mid).T @ ((a.raw - mean) / wide))
    want = dict(zip(b.id, mean + wide * ((design(b) - mid) @ w)))
    rows = prepare_features(frame, ["id", "year", "raw"], ["power", "cylinders"], ["brand", "segment"])
    fitted = M.fit_ridge(rows.filter("year <= 2010"), ["power", "cylinders"], ["brand", "segment"], "raw", groups=("brand", "segment"))
    got = {r["id"]: r["predicted"] for r in fitted.predict(rows.filter("year > 2010")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_features_are_an_allow_list(spark):
    rows = spark.createDataFrame([(1, "2.5", " Ford ", 9.0), (2, "x", "\t", 9.0), (3, None, None, 9.0)], "id int, hp string, make string, recalls double")
    got = sorted(tuple(r) for r in prepare_features(rows, ["id"], ["hp"], ["make"]).collect())
    assert got == [(1, 2.5, "ford"), (2, None, "__unknown__"), (3, None, "__unknown__")]
    with pytest.raises(Exception, match="finite"):
        prepare_features(spark.createDataFrame([(1, float("inf"), "a")], "id int, hp double, make string"), ["id"], ["hp"], ["make"]).collect()


@pytest.fixture(scope="module")
def models(frame):
    return {k: Z.train_model(frame, FRAME, 2008, 2011, years=2, kinds=(k,) if k == "baseline" else ("baseline", k), trees=10, margin=-9.0) for k in ("baseline", "ridge")}


def test_saved_models_score_alike(spark, frame, models, tmp_path):
    for kind, model in models.items():
        model.save(str(tmp_path / kind))
        again = Z.Frozen.load(spark.newSession(), str(tmp_path / kind))
        assert again.facts == Z.json.loads(Z.json.dumps(dict(model.facts))) and again.fitted.kind == model.fitted.kind
        rows = prepare_features(frame, ["id"], FRAME.numbers, ["brand", "segment"])
        a = {r["id"]: r["predicted"] for r in model.fitted.predict(rows).collect()}
        b = {r["id"]: r["predicted"] for r in again.fitted.predict(rows).collect()}
        assert len(a) == 400 and a == b
        with pytest.raises(Exception, match="exist"):
            model.save(str(tmp_path / kind))


def test_the_audit_repeats_the_recorded_error_and_refuses_what_is_stale(spark, frame, models):
    for kind, model in models.items():
        got = {(r["dimension"], r["group"]): r for r in Z.audit_frozen(frame, model, small=60).collect()}
        whole = got["all", "all"]
        assert whole["n"] == model.facts["test"]["n"] == model.facts["split"]["test"]["rows"] and abs(whole["mae"] - model.facts["test"]["mae"]) < 1e-9
        assert sum(r["n"] for (d, _), r in got.items() if d == "brand") == whole["n"] and ("serving_support" in {d for d, _ in got}) == (model.fitted.kind == "baseline")
        assert {r["is_small"] for r in got.values()} == {True, False}
    model = models["baseline"]
    rules = lambda rows, **facts: {r["rule"] for r in Z.frozen_problems(rows, FRAME, {**model.facts, **facts}).collect()}
    assert rules(frame) == set()
    assert rules(frame.repartition(7)) == set()
    assert rules(frame.withColumn("raw", F.when(F.col("id") == "v1", 9.0).otherwise(F.col("raw")))) == {"fingerprint_differs"}
    assert rules(frame.union(frame.filter("id = 'v0'"))) == {"bad_id", "fingerprint_differs"}
    assert rules(frame.filter("id <> 'v399' AND id <> 'v13'")) >= {"fingerprint_differs", "test_count_differs"}
    assert rules(frame.withColumn("mature", F.col("id") != "v13")) == {"fingerprint_differs", "immature_test"}
    assert rules(frame, available_from=2050) == {"available_too_late"} and rules(frame, available_from=None) == {"available_too_late"}
    assert rules(frame, scale_last_year=2011) == {"scale_knows_test"}
    assert "no_test_partition" in rules(frame, split={**model.facts["split"], "test": {"rows": 0, "min_year": None, "max_year": None}})
    with pytest.raises(ValueError):
        Z.audit_frozen(frame.limit(10), model)


def test_denominators(models):
    facts = models["ridge"].facts
    assert Z.denominator_problems(facts) == []
    other = {**facts, "test": {**facts["test"], "n": 1}, "validation": {"ridge": {**facts["validation"]["ridge"], "n": 2}}}
    assert Z.denominator_problems(other) == ["test_denominator", "validation_denominator:ridge"]
    late = {**facts, "split": {**facts["split"], "test": {**facts["split"]["test"], "min_year": 1990}}}
    assert Z.denominator_problems(late) == ["years"]


def test_contract_stops_training(frame):
    for broken in (frame.withColumn("mature", F.lit(False)), frame.union(frame), frame.withColumn("raw", F.lit(-1.0))):
        with pytest.raises(ValueError):
            Z.train_model(broken, FRAME, 2008, 2011, years=2, kinds=("baseline",))


def test_importance(spark, frame):
    rows = prepare_features(frame, ["id", "raw"], FRAME.numbers, ["brand", "segment"])
    ridge = M.fit_ridge(rows, FRAME.numbers, ["brand", "segment"], "raw", groups=("brand", "segment"))
    forest = M.fit_forest(rows, FRAME.numbers, ["brand", "segment"], "raw", trees=10, groups=("brand", "segment"))
    weights = list(ridge.stage(M.LinearRegressionModel).coefficients)
    got = {r["feature"]: r for r in M.importance(ridge, rows).collect()}
    assert abs(got["power"]["importance"] - abs(weights[0]) / sum(map(abs, weights))) < 1e-6 and abs(got["power"]["signed_effect"] - weights[0] * ridge.scale["raw"][1]) < 1e-5
    assert abs(got["brand"]["importance"] - sum(map(abs, weights[2:6])) / sum(map(abs, weights))) < 1e-6
    for fitted in (ridge, forest):
        shares = {r["feature"]: r["importance"] for r in M.importance(fitted, rows).collect()}
        assert shares.keys() == {"power", "cylinders", "brand", "segment"} and abs(sum(shares.values()) - 1) < 1e-5 and shares["power"] > shares["segment"]
    base = M.fit_baseline(rows, "brand", "segment", "raw")
    assert [(r["feature"], r["importance"]) for r in M.importance(base, rows).collect()] == [("marca_y_categoria", 1.0)]


def test_explanations_by_model(spark, frame, models):
    train = C_labelled(frame, models["baseline"])
    reference = {"power": 120.0, "cylinders": 4.0, "brand": "a", "segment": "s"}
    some = frame.filter("year = 2015")
    base = Z.explanations(some, models["baseline"], train, reference).collect()
    assert len(base) == some.count() and all(r["place"] == 1 and r["value"] for r in base)
    got = Z.explanations(some, models["ridge"], train, reference, top=4).collect()
    assert len(got) == 4 * some.count() and {r["feature"] for r in got} == set(reference)
    asked = prepare_features(some, ["id"], FRAME.numbers, ["brand", "segment"])
    ridge = models["ridge"].fitted
    at = ridge.predict(spark.createDataFrame([tuple(reference.values())], "power double, cylinders double, brand string, segment string")).first()["predicted"]
    total = {}
    for r in got:
        total[r["id"]] = total.get(r["id"], 0) + r["effect"]
    assert all(abs(total[r["id"]] - (r["predicted"] - at)) < 1e-6 for r in ridge.predict(asked).collect())
    assert {r["value"] for r in got if r["feature"] == "power"} >= {None}


def C_labelled(frame, model):
    from cohortscore.operators import cohorts as C

    return C.scaled_index(frame.filter("year <= 2006"), model.scale, "segment", "raw")


def test_windows_train_and_select(spark, frame):
    got = {r["window"]: r for r in Z.window_results(frame, FRAME, [(2004, 2007, 2010), (2007, 2010, 2012), (2030, 2031, 2032)], years=2, kinds=("baseline", "ridge")).collect()}
    one, two, none = got["2004-2007-2010"], got["2007-2010-2012"], got["2030-2031-2032"]
    assert one["status"] == two["status"] == "evaluated" and one["n_test"] > 0 and one["model"] in ("baseline", "ridge")
    alone = Z.train_model(frame.filter("year <= 2010"), FRAME, 2004, 2007, adaptive=False, years=2, kinds=("baseline", "ridge"))
    assert (alone.facts["test"]["mae"], alone.facts["reason"]) == (one["mae"], one["reason"])
    assert none["status"] == "not_evaluable" and none["mae"] is None and none["reason"]
    with pytest.raises(ValueError):
        Z.window_results(frame, FRAME, [(2004, 2007, 2010), (2005, 2009, 2012)])
