"""Queries of splits, selection, scoring and explanations, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscore.operators import cohorts as C
from cohortscore.operators import models as M
from cohortscore.operators import training as R
from cohortscore.plans import queries as Q
from cohortscore.plans.modelling import TRAIN_END, _reference

#: Means of a few prices often lie halfway between two roundings; a shift on both sides keeps engines from differing there.
SHIFT, COARSE = 1e-7, 0.00137
WINDOWS = ((1996, 1998, 1999), (1997, 1999, 2000), (1998, 2000, 2001))


def adaptive_split(spark, d):
    return R.adaptive_split(Q._orders(spark, d), "y", 2018, 2021, years=2).groupBy("partition", "strategy", "y").agg(F.count("*").alias("n"))


def relabelled_target(spark, d):
    rows = C.temporal_split(Q._orders(spark, d), "y", 1997, 1999, 2)
    return R.relabelled(rows, "c_mktsegment", "o_totalprice").select("o_orderkey", "partition", F.round("index_100", 4).alias("index_100"))


def _parts(spark, d):
    rows = Q._orders(spark, d)
    return rows.filter(f"y <= {TRAIN_END}"), rows.filter("y > 1999")


def _mean(train):
    return lambda df: C.hierarchical_mean(df, train, "brand", "c_mktsegment", "o_totalprice")


def prediction_frame(spark, d):
    train, test = _parts(spark, d)
    return R.prediction_frame(_mean(train)(test), "o_totalprice", "baseline", "test").select("o_orderkey", F.round(F.col("predicted") + COARSE, 2).alias("predicted"), F.round(F.col("absolute_error") + COARSE, 2).alias("absolute_error"), "model", "partition")


def batch_scores(spark, d):
    train, test = _parts(spark, d)
    scored = _mean(train)(test).withColumn("predicted", F.col("predicted") / 2000)
    return R.batch_scores(scored, "y", "baseline", None, 2001).select("o_orderkey", "score", "model", "retrospective")


def evidence_gate(spark, d):
    rows = Q._t(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") < 5).alias("supported"), F.when(F.col("c_nationkey") != 9, F.col("c_acctbal") > 0).alias("identity"), F.when(F.col("c_custkey") % 2 == 0, "own").when(F.col("c_custkey") % 3 == 0, "market").alias("source"))
    other = R.evidence_gate(rows, "supported", "identity", "source", model="ridge").withColumnRenamed("refusal", "ridge_refusal")
    return R.evidence_gate(other, "supported", "identity", "source").select("c_custkey", "refusal", "ridge_refusal")


def baseline_explanation(spark, d):
    train, test = _parts(spark, d)
    out = R.baseline_explanation(_mean(train)(test), train, "brand", "c_mktsegment", "o_totalprice")
    return out.select("o_orderkey", "level", "value", "direction", *[F.round(c, 3).alias(c) for c in ("baseline", "effect")])


def _effects(spark, d):
    train, test = _parts(spark, d)
    return R.counterfactual(test.select("o_orderkey", "brand", "c_mktsegment"), "o_orderkey", _reference(train), _mean(train))


def counterfactual_effects(spark, d):
    return _effects(spark, d).select("o_orderkey", *[F.round(F.col(c) + SHIFT, 3).alias(c) for c in ("predicted", "effect_brand", "effect_c_mktsegment")])


def top_factor(spark, d):
    effects = _effects(spark, d)
    effects = effects.withColumns({f"effect_{c}": F.round(F.col(f"effect_{c}") + SHIFT, 3) for c in ("brand", "c_mktsegment")})
    return R.factors(effects, "o_orderkey", ["brand", "c_mktsegment"], 1)


def explanation_sentences(spark, d):
    rows = Q._t(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") - 10).cast("double").alias("effect_brand"), (F.col("c_custkey") % 7 - 3).cast("double").alias("effect_market_segment"))
    return R.sentences(R.factors(rows, "c_custkey", ["brand", "market_segment"], 2), "c_custkey")


def baseline_sentences(spark, d):
    train, test = _parts(spark, d)
    rows = test.withColumn("o_totalprice", F.col("o_totalprice") / 4000)
    scored = C.hierarchical_mean(rows, train.withColumn("o_totalprice", F.col("o_totalprice") / 4000), "brand", "c_mktsegment", "o_totalprice")
    explained = R.baseline_explanation(scored, train.withColumn("o_totalprice", F.col("o_totalprice") / 4000), "brand", "c_mktsegment", "o_totalprice")
    return R.baseline_sentences(explained.withColumns({c: F.round(F.col(c) + SHIFT, 2) for c in ("predicted", "baseline")}).withColumn("effect", F.col("predicted") - F.col("baseline")), "o_orderkey")


def feature_importance(spark, d):
    return R.importance(_effects(spark, d), ["brand", "c_mktsegment"]).select("feature", F.round("importance", 4).alias("importance"))


def ridge_effects(spark, d):
    """Ridge attributions; tests hold that they add up to the prediction minus that of the reference."""
    train, test = _parts(spark, d)
    fitted = M.fit_ridge(train, ["y", "prio"], ["c_mktsegment", "brand"], "o_totalprice")
    reference = {**_reference(train), "y": 1996, "prio": 3}
    out = R.ridge_attribution(test, fitted, ["c_mktsegment", "brand"], reference, R.ridge_coefficients(fitted, ["c_mktsegment", "brand"], train))
    return out.select("o_orderkey", *[F.round(f"effect_{c}", 4).alias(f"effect_{c}") for c in ("y", "prio", "c_mktsegment", "brand")])


def temporal_windows(spark, d):
    out = R.temporal_windows(Q._orders(spark, d), WINDOWS, "brand", "c_mktsegment", "y", "o_totalprice", 2)
    return out.select("window", "status", "n_train", "n_test", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"))


def frozen_audit(spark, d):
    train, test = _parts(spark, d)
    out = R.frozen_audit(_mean(train)(test), train, "y", "o_totalprice", [[], ["brand"], ["c_mktsegment", "y"]], 1, small=120)
    return out.select("brand", "c_mktsegment", "y", "n", *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "bias")], "is_small", "is_consistent")


def chosen_model(spark, d):
    """The test errors of the model that validation chooses between the hierarchical mean and ridge."""
    rows = C.temporal_split(Q._orders(spark, d), "y", 1997, 1999, 2)
    ridge = lambda train: M.fit_ridge(train, ["y", "prio"], ["c_mktsegment", "brand"], "o_totalprice").predict
    name, _, predict, first = R.train_and_select(rows, {"baseline": _mean, "ridge": ridge}, "y", "o_totalprice", years=2)
    errors = C.error_summary(predict(rows.filter("partition = 'test'")), "o_totalprice", "predicted", [[]])
    return errors.select(F.lit(name).alias("model"), F.lit(first).alias("available_from"), "n", *[F.round(c, 2).alias(c) for c in ("mae", "rmse")])


NAMES = (adaptive_split, relabelled_target, prediction_frame, batch_scores, evidence_gate, baseline_explanation, counterfactual_effects, top_factor, explanation_sentences, baseline_sentences, feature_importance, ridge_effects, temporal_windows, frozen_audit, chosen_model)
QUERIES = {f.__name__: f for f in NAMES}

_FIT = Q._BASE + f""", t AS (SELECT * FROM o WHERE y <= {TRAIN_END}), m0 AS (SELECT brand, c_mktsegment, avg(o_totalprice) AS a FROM t GROUP BY 1, 2), m1 AS (SELECT brand, avg(o_totalprice) AS b FROM t GROUP BY 1), m2 AS (SELECT c_mktsegment, avg(o_totalprice) AS c FROM t GROUP BY 1), m3 AS (SELECT avg(o_totalprice) AS g FROM t),
  rf AS (SELECT (SELECT brand FROM t GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 1) AS rb, (SELECT c_mktsegment FROM t GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 1) AS rs) """
_AT = lambda name, brand, segment, source: f""", {name} AS (SELECT x.*, coalesce(a, b, c, g) AS p, CASE WHEN a IS NOT NULL THEN 'brand_segment' WHEN b IS NOT NULL THEN 'brand' WHEN c IS NOT NULL THEN 'segment' ELSE 'all' END AS level FROM {source} x CROSS JOIN rf CROSS JOIN m3 LEFT JOIN m0 ON m0.brand = {brand} AND m0.c_mktsegment = {segment} LEFT JOIN m1 ON m1.brand = {brand} LEFT JOIN m2 ON m2.c_mktsegment = {segment}) """
_LATE = "(SELECT * FROM o WHERE y > 1999)"
_SCORED = _FIT + _AT("e", "x.brand", "x.c_mktsegment", _LATE)
_CF = _SCORED + _AT("eb", "rb", "x.c_mktsegment", _LATE) + _AT("es", "x.brand", "rs", _LATE) + ", f AS (SELECT e.o_orderkey, e.p, e.p - eb.p AS x1, e.p - es.p AS x2 FROM e JOIN eb USING (o_orderkey) JOIN es USING (o_orderkey)) "
_DIR = lambda c: f"CASE WHEN {c} > 1e-9 THEN 'aumenta_indice' WHEN {c} < -1e-9 THEN 'reduce_indice' ELSE 'sin_efecto_apreciable' END"
_SAY = lambda label, c: f"'{label} ' || CASE WHEN {c} > 0 THEN 'eleva' WHEN {c} < 0 THEN 'reduce' ELSE 'apenas modifica' END || ' el índice (' || CASE WHEN {c} < 0 THEN '-' ELSE '+' END || abs({c})::int || '.0 puntos)'"


def _window(a: int, b: int, c: int) -> str:
    t = f"(SELECT * FROM o WHERE y <= {c} AND (y <= {a} AND y <= fv - 2 OR y > {a} AND y <= {b} AND y <= ft - 2))"
    return f"""SELECT '{a}-{b}-{c}' AS window, CASE WHEN n_train > 0 AND n_valid > 0 AND n_test > 0 THEN 'evaluated' ELSE 'not_evaluable' END AS status, n_train, n_test, CASE WHEN n_train > 0 AND n_valid > 0 AND n_test > 0 THEN mae END AS mae, CASE WHEN n_train > 0 AND n_valid > 0 AND n_test > 0 THEN rmse END AS rmse FROM (
      WITH f AS (SELECT min(y) FILTER (y > {a} AND y <= {b}) AS fv, min(y) FILTER (y > {b} AND y <= {c}) AS ft FROM o), s AS (SELECT o.*, fv, ft FROM o CROSS JOIN f WHERE y <= {c}),
      t AS (SELECT * FROM s WHERE y <= {a} AND y <= fv - 2 OR y > {a} AND y <= {b} AND y <= ft - 2), m0 AS (SELECT brand, c_mktsegment, avg(o_totalprice) AS a FROM t GROUP BY 1, 2), m1 AS (SELECT brand, avg(o_totalprice) AS b FROM t GROUP BY 1), m2 AS (SELECT c_mktsegment, avg(o_totalprice) AS c FROM t GROUP BY 1),
      e AS (SELECT coalesce(a, b, c, (SELECT avg(o_totalprice) FROM t)) - o_totalprice AS e FROM s LEFT JOIN m0 USING (brand, c_mktsegment) LEFT JOIN m1 USING (brand) LEFT JOIN m2 ON s.c_mktsegment = m2.c_mktsegment WHERE y > {b})
      SELECT (SELECT count(*) FROM t WHERE y <= {a}) AS n_train, (SELECT count(*) FROM t WHERE y > {a}) AS n_valid, (SELECT count(*) FROM e) AS n_test, round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse FROM e)"""


ORACLE = {
    "adaptive_split": Q._BASE + "SELECT CASE WHEN y <= 1998 THEN CASE WHEN y > 1997 THEN 'train_embargoed' ELSE 'train' END WHEN y = 1999 THEN 'validation_embargoed' ELSE 'test' END AS partition, 'adaptive_distinct_years' AS strategy, y, count(*) AS n FROM o GROUP BY 1, 2, 3",
    "relabelled_target": Q._BASE + ", t AS (SELECT c_mktsegment, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM o WHERE y <= 1996 GROUP BY 1) SELECT o_orderkey, CASE WHEN y <= 1997 THEN CASE WHEN y > 1996 THEN 'train_embargoed' ELSE 'train' END WHEN y <= 1999 THEN CASE WHEN y > 1998 THEN 'validation_embargoed' ELSE 'validation' END ELSE 'test' END AS partition, round(greatest(0, least(100, 50 - 10 * (o_totalprice - m) / d)), 4) AS index_100 FROM o JOIN t USING (c_mktsegment)",
    "prediction_frame": _SCORED + "SELECT o_orderkey, round(round(p, 4) + 0.00137, 2) AS predicted, round(round(abs(round(p, 4) - o_totalprice), 4) + 0.00137, 2) AS absolute_error, 'baseline' AS model, 'test' AS partition FROM e",
    "batch_scores": _SCORED + "SELECT o_orderkey, round(greatest(0, least(100, p / 2000)), 2) AS score, 'baseline' AS model, y < 2001 AS retrospective FROM e",
    "evidence_gate": "SELECT c_custkey, CASE WHEN c_nationkey >= 5 THEN 'unsupported_brand' END AS refusal, CASE WHEN c_nationkey = 9 OR c_acctbal <= 0 THEN 'identity_not_verified' WHEN c_custkey % 2 <> 0 THEN 'no_prior_cohorts' END AS ridge_refusal FROM customer",
    "baseline_explanation": _SCORED + f"SELECT o_orderkey, level, CASE level WHEN 'brand_segment' THEN brand || ' / ' || c_mktsegment WHEN 'brand' THEN brand WHEN 'segment' THEN c_mktsegment ELSE 'all' END AS value, {_DIR('p - g')} AS direction, round(g, 3) AS baseline, round(p - g, 3) AS effect FROM e CROSS JOIN m3",
    "counterfactual_effects": _CF + "SELECT o_orderkey, round(p + 1e-7, 3) AS predicted, round(x1 + 1e-7, 3) AS effect_brand, round(x2 + 1e-7, 3) AS effect_c_mktsegment FROM f",
    "top_factor": _CF + f", l AS (SELECT o_orderkey, unnest(['brand', 'c_mktsegment']) AS feature, unnest([round(x1 + 1e-7, 3), round(x2 + 1e-7, 3)]) AS effect FROM f) SELECT o_orderkey, feature, effect, 1 AS place, {_DIR('effect')} AS direction FROM l QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(effect) DESC, feature) = 1",
    "explanation_sentences": f"WITH x AS (SELECT c_custkey, c_nationkey - 10 AS a, c_custkey % 7 - 3 AS b FROM customer) SELECT c_custkey, CASE WHEN abs(a) >= abs(b) THEN {_SAY('Brand', 'a')} || '; ' || {_SAY('Market segment', 'b')} ELSE {_SAY('Market segment', 'b')} || '; ' || {_SAY('Brand', 'a')} END || '. Explicación determinista de asociaciones del modelo; no demuestra causalidad.' AS sentence FROM x",
    "baseline_sentences": _SCORED + ", q AS (SELECT o_orderkey, level, brand, c_mktsegment, round(p / 4000 + 1e-7, 2)::decimal(9,2) AS p, (SELECT round(g / 4000 + 1e-7, 2)::decimal(9,2) FROM m3) AS g FROM e) SELECT o_orderkey, 'El baseline utiliza ' || CASE level WHEN 'brand_segment' THEN 'marca y segmento: ' || brand || ' / ' || c_mktsegment WHEN 'brand' THEN 'marca: ' || brand WHEN 'segment' THEN 'segmento: ' || c_mktsegment ELSE 'media global: all' END || '. La estimación del grupo es ' || p || '/100, frente a ' || g || '/100 de la media global de entrenamiento (diferencia: ' || CASE WHEN p >= g THEN '+' ELSE '' END || (p - g) || ' puntos). " + R.BASELINE_LIMITS + "' AS sentence FROM q",
    "feature_importance": _CF + "SELECT 'brand' AS feature, round(avg(abs(x1)) / (avg(abs(x1)) + avg(abs(x2))), 4) AS importance FROM f UNION ALL SELECT 'c_mktsegment', round(avg(abs(x2)) / (avg(abs(x1)) + avg(abs(x2))), 4) FROM f",
    "temporal_windows": Q._BASE + " UNION ALL ".join(f"({_window(*w)})" for w in WINDOWS),
    "frozen_audit": _SCORED + "SELECT brand, c_mktsegment, y, count(*) AS n, round(avg(abs(p - o_totalprice)), 3) AS mae, round(sqrt(avg((p - o_totalprice) ** 2)), 3) AS rmse, round(avg(p - o_totalprice), 3) AS bias, count(*) < 120 AS is_small, false AS is_consistent FROM e GROUP BY GROUPING SETS ((), (brand), (c_mktsegment, y))",
}
_SHAP = _FIT + ", late AS (SELECT * FROM o WHERE y > 1997)" + _AT("e", "x.brand", "x.c_mktsegment", "late") + _AT("eb", "x.brand", "rs", "late") + _AT("es", "rb", "x.c_mktsegment", "late") + _AT("e0", "rb", "rs", "late")
#: Shapley values of two features: the mean of both orders in which they can be added.
ORACLE["baseline_shapley"] = _SHAP + "SELECT o_orderkey, round(e0.p + 1e-7, 4) AS base, round(e.p + 1e-7, 4) AS predicted, round(((eb.p - e0.p) + (e.p - es.p)) / 2 + 1e-7, 4) AS effect_brand, round(((es.p - e0.p) + (e.p - eb.p)) / 2 + 1e-7, 4) AS effect_c_mktsegment FROM e JOIN eb USING (o_orderkey) JOIN es USING (o_orderkey) JOIN e0 USING (o_orderkey)"
