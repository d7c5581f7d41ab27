"""Ridge against its closed form, Shapley values against their definition, the selection rule, reference scores against SQL."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_queries import SF, db  # noqa: F401

from cohortscore.operators import audits
from cohortscore.operators import models as M
from cohortscore.plans import modelling
from cohortscore.plans import queries as Q
from compare import canon


@pytest.mark.parametrize("name", sorted(modelling.ORACLE))
def test_against_sql(spark, db, name):  # noqa: F811
    assert canon(modelling.QUERIES[name](spark, SF).toPandas()) == canon(db.execute(modelling.ORACLE[name]).df())


def test_ridge_equals_closed_form(spark):
    rows = Q._orders(spark, SF).toPandas()
    train, later = rows[rows.y <= modelling.TRAIN_END], rows[rows.y > modelling.TRAIN_END]
    levels = {c: sorted(train[c].unique()) for c in ("c_mktsegment", "brand")}

    def design(df):
        numbers = [(df[c] - train[c].mean()) / train[c].std(ddof=0) for c in ("y", "prio")]
        return np.column_stack(numbers + [(df[c] == v).astype(float) for c in levels for v in levels[c]])

    x, mean, spread = design(train), train.o_totalprice.mean(), train.o_totalprice.std(ddof=0)
    t, mid = (train.o_totalprice - mean) / spread, x.mean(axis=0)
    w = np.linalg.solve((x - mid).T @ (x - mid) + np.eye(x.shape[1]), (x - mid).T @ t)
    want = dict(zip(later.o_orderkey, mean + spread * ((design(later) - mid) @ w)))
    got = {r["o_orderkey"]: r["predicted"] for r in modelling.ridge_predictions(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_forest_learns_a_step(spark):
    rows = spark.createDataFrame(pd.DataFrame({"x": range(60), "c": ["a", "b"] * 30, "t": [0.0] * 30 + [10.0] * 30}))
    out = M.fit_forest(rows, ["x"], ["c"], "t", trees=20).predict(rows).select(F.avg(F.abs(F.col("predicted") - F.col("t")))).first()[0]
    assert out < 1.0


def test_shapley_by_definition(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0, 5.0), (2, 0.0, 1.0, -1.0)], "id int, a double, b double, c double")
    ref = {"a": 1.0, "b": 1.0, "c": 1.0}
    got = M.shapley_values(rows, "id", ref, lambda df: df.withColumn("predicted", F.col("a") * F.col("b") + 2 * F.col("c"))).collect()
    for r, (_, a, b, c) in zip(sorted(got), ((1, 2.0, 3.0, 5.0), (2, 0.0, 1.0, -1.0))):
        effect_a = ((a - 1) + (a * b - b)) / 2
        assert abs(r["effect_a"] - effect_a) < 1e-9 and abs(r["effect_c"] - 2 * (c - 1)) < 1e-9
        assert abs(r["effect_a"] + r["effect_b"] + r["effect_c"] - (r["predicted"] - r["base"])) < 1e-9


def test_baseline_shapley_adds_up(spark):
    out = modelling.baseline_shapley(spark, SF)
    assert out.count() > 0
    assert out.filter("abs(base + effect_brand + effect_c_mktsegment - predicted) > 0.001").isEmpty()


@pytest.mark.parametrize("errors,chosen", [({"baseline": 2.0, "ridge": 1.0, "forest": 0.9}, "ridge"), ({"baseline": 2.0, "ridge": 1.0, "forest": 0.89}, "forest"), ({"baseline": 1.0, "ridge": 1.0, "forest": 1.0}, "baseline"), ({}, "baseline"), ({"baseline": 2.0, "forest": 1.0}, "baseline"), ({"forest": 1.0, "ridge": 0.0}, "ridge")])
def test_selection(errors, chosen):
    assert M.select_model(errors) == chosen


def test_exact_quantiles_of_skewed_ties_and_null_groups(spark):
    """Against numpy: a hot value, values far apart and close together, one value, a null group, nulls, and no rows."""
    rng = np.random.default_rng(3)
    groups = {"hot": np.r_[np.full(4000, 7.0), rng.normal(size=999)], "far": np.r_[1e12, 1 + rng.random(3000) * 1e-3, -1e9], "one": np.array([5.0]), None: np.round(rng.random(200), 1)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    fractions = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["g"]: r for r in audits.exact_quantiles(df, ["g"], "v", fractions).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got.keys() == groups.keys()
        for g, xs in groups.items():
            assert got[g]["n"] == len(xs) and np.allclose([got[g][f"q{i}"] for i in range(6)], np.quantile(xs, fractions), rtol=1e-12, atol=1e-12)
    every = audits.exact_quantiles(df, [], "v", [0.5]).collect()
    assert len(every) == 1 and every[0]["q0"] == np.median(np.concatenate(list(groups.values())))
    assert audits.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
