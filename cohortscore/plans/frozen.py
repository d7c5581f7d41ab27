"""Queries of imputed features, saved models and their audit, windows that select and importance, and SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortscore.operators import frozen as Z
from cohortscore.operators import models as M
from cohortscore.operators.estimators import GroupMedianImputer, prepare_features
from cohortscore.plans import queries as Q

FRAME = Z.Frame("o_orderkey", "brand", "c_mktsegment", "y", "o_totalprice", "mature", ("prio", "items"))
WINDOWS = ((1996, 1998, 1999), (1997, 1999, 2000), (1998, 2000, 2001))


def _frame(spark, d):
    """Orders with the number of their items, which is null for every third; priorities of the first class are null."""
    items = Q._t(spark, d, "lineitem").filter("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("items"))
    rows = Q._orders(spark, d).withColumns({"prio": F.when(F.col("prio") > 1, F.col("prio")), "mature": F.lit(True)})
    return rows.join(items, "o_orderkey", "left")


def imputed_features(spark, d):
    rows = prepare_features(_frame(spark, d), ["o_orderkey", "y"], FRAME.numbers, FRAME.features()[1])
    imputer = GroupMedianImputer(columns=list(FRAME.numbers), brand="brand", segment="c_mktsegment").fit(rows.filter("y <= 1997"))
    return imputer.transform(rows).select("o_orderkey", "brand", "c_mktsegment", F.col("_f_prio").alias("prio"), F.col("_f_items").alias("items"))


def ridge_with_medians(spark, d):
    """Predictions of a ridge whose null numbers are filled with training medians; tests hold it against the closed form."""
    rows = prepare_features(_frame(spark, d), ["o_orderkey", "y", "o_totalprice"], FRAME.numbers, FRAME.features()[1])
    fitted = M.fit_ridge(rows.filter("y <= 1997"), FRAME.numbers, FRAME.features()[1], "o_totalprice", groups=("brand", "c_mktsegment"))
    return fitted.predict(rows.filter("y > 1997")).select("o_orderkey", F.round("predicted", 4).alias("predicted"))


def _saved(spark, model: Z.Frozen) -> Z.Frozen:
    """The model written to the shared folder and read again, as another session would."""
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cohortscore-model-{uuid.uuid4().hex}"
    model.save(path)
    return Z.Frozen.load(spark, path)


def frozen_model_audit(spark, d):
    rows = _frame(spark, d)
    model = _saved(spark, Z.train_model(rows, FRAME, 1997, 1999, years=2, kinds=("baseline",)))
    out = Z.audit_frozen(rows, model, small=200)
    return out.select("dimension", "group", "n", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("mae", "rmse", "bias")], "is_small")


def window_models(spark, d):
    """Every window trains three models, selects one and measures its test; tests hold a window against training it alone."""
    out = Z.window_results(_frame(spark, d), FRAME, WINDOWS, years=2, trees=20)
    return out.withColumns({c: F.round(c, 3) for c in ("mae", "rmse")})


def model_importance(spark, d):
    """Shares of a ridge and of a forest; tests hold them against the coefficients and that they sum to 1."""
    rows = prepare_features(_frame(spark, d), ["o_orderkey", "y", "o_totalprice"], FRAME.numbers, FRAME.features()[1]).filter("y <= 1997")
    fits = (M.fit_ridge(rows, FRAME.numbers, FRAME.features()[1], "o_totalprice", groups=("brand", "c_mktsegment")), M.fit_forest(rows, FRAME.numbers, FRAME.features()[1], "o_totalprice", trees=20, groups=("brand", "c_mktsegment")), M.fit_baseline(rows, "brand", "c_mktsegment", "o_totalprice"))
    out = [M.importance(f, rows) for f in fits]
    return out[0].unionByName(out[1]).unionByName(out[2])


NAMES = (imputed_features, ridge_with_medians, frozen_model_audit, window_models, model_importance)
QUERIES = {f.__name__: f for f in NAMES}

_F = Q._BASE + """, i AS (SELECT l_orderkey AS o_orderkey, count(*)::double AS items FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1),
  x AS (SELECT o.o_orderkey, o.y, o.o_totalprice, lower(trim(o.brand)) AS b, lower(trim(o.c_mktsegment)) AS s, o.c_mktsegment AS seg, CASE WHEN prio > 1 THEN prio::double END AS prio, items FROM o LEFT JOIN i USING (o_orderkey)) """
_SETS = (("all", "'all'"), ("brand", "b"), ("c_mktsegment", "s"), ("y", "y::varchar"), ("level", "level"), ("serving_support", "CASE WHEN level IN ('brand_segment', 'brand') THEN 'represented_brand' ELSE 'unrepresented_brand' END"))
ORACLE = {
    "imputed_features": _F + """, t AS (SELECT * FROM x WHERE y <= 1997), a AS (SELECT b, s, median(prio) AS p, median(items) AS n FROM t GROUP BY 1, 2), c AS (SELECT s, median(prio) AS p, median(items) AS n FROM t GROUP BY 1), g AS (SELECT median(prio) AS p, median(items) AS n FROM t)
      SELECT o_orderkey, x.b AS brand, x.s AS c_mktsegment, coalesce(prio, a.p, c.p, g.p, 0) AS prio, coalesce(items, a.n, c.n, g.n, 0) AS items FROM x CROSS JOIN g LEFT JOIN a ON x.b = a.b AND x.s = a.s LEFT JOIN c ON x.s = c.s""",
    "frozen_model_audit": _F + """, k AS (SELECT seg, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM x WHERE y <= 1996 GROUP BY 1),
      v AS (SELECT x.*, greatest(0, least(100, 50 - 10 * (o_totalprice - m) / d)) AS t FROM x JOIN k USING (seg)), f AS (SELECT * FROM v WHERE y <= 1996 OR y = 1998),
      m0 AS (SELECT b, s, avg(t) AS p0 FROM f GROUP BY 1, 2), m1 AS (SELECT b, avg(t) AS p1 FROM f GROUP BY 1), m2 AS (SELECT s, avg(t) AS p2 FROM f GROUP BY 1),
      e AS (SELECT v.b, v.s, v.y, coalesce(p0, p1, p2, (SELECT avg(t) FROM f)) - t AS e, CASE WHEN p0 IS NOT NULL THEN 'brand_segment' WHEN p1 IS NOT NULL THEN 'brand' WHEN p2 IS NOT NULL THEN 'segment' ELSE 'all' END AS level
            FROM v LEFT JOIN m0 ON v.b = m0.b AND v.s = m0.s LEFT JOIN m1 ON v.b = m1.b LEFT JOIN m2 ON v.s = m2.s WHERE y > 1999) """
    + " UNION ALL ".join(f"""SELECT '{n}' AS dimension, {c} AS "group", count(*) AS n, round(avg(abs(e)) + 1e-7, 4) AS mae, round(sqrt(avg(e * e)) + 1e-7, 4) AS rmse, round(avg(e) + 1e-7, 4) AS bias, count(*) < 200 AS is_small FROM e GROUP BY 2""" for n, c in _SETS),
}
