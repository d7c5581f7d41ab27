"""Queries of the regressors and attributions, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscore.operators import cohorts as C
from cohortscore.operators import models as M
from cohortscore.plans import queries as Q

TRAIN_END = 1997


def _reference(train) -> dict[str, str]:
    one = train.agg(F.mode("brand", True).alias("brand"), F.mode("c_mktsegment", True).alias("c_mktsegment")).first()
    return one.asDict()


def ridge_predictions(spark, d):
    rows = Q._orders(spark, d)
    fitted = M.fit_ridge(rows.filter(f"y <= {TRAIN_END}"), ["y", "prio"], ["c_mktsegment", "brand"], "o_totalprice")
    return fitted.predict(rows.filter(f"y > {TRAIN_END}")).select("o_orderkey", F.round("predicted", 4).alias("predicted"))


def baseline_shapley(spark, d):
    rows = Q._orders(spark, d)
    train = rows.filter(f"y <= {TRAIN_END}")
    later = rows.filter(f"y > {TRAIN_END}").select("o_orderkey", "brand", "c_mktsegment")
    predict = lambda r: C.hierarchical_mean(r, train, "brand", "c_mktsegment", "o_totalprice")
    out = M.shapley_values(later, "o_orderkey", _reference(train), predict)
    return out.select("o_orderkey", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("base", "predicted", "effect_brand", "effect_c_mktsegment")])


def mature_reference(spark, d):
    rows = Q._orders(spark, d)
    exact = rows.withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    return M.mature_reference(rows, exact, "brand", "c_mktsegment", "y", "price")


NAMES = (ridge_predictions, baseline_shapley, mature_reference)
QUERIES = {f.__name__: f for f in NAMES}
ORACLE = {
    "mature_reference": Q._BASE + """, k AS (SELECT DISTINCT brand, c_mktsegment, y FROM o),
      a AS (SELECT k.brand, k.c_mktsegment, k.y, sum(o_totalprice::decimal(18,2))::double / count(*) AS m FROM k JOIN o ON k.brand = o.brand AND k.c_mktsegment = o.c_mktsegment AND o.y <= k.y - 3 GROUP BY 1, 2, 3),
      b AS (SELECT k.brand, k.y, sum(o_totalprice::decimal(18,2))::double / count(*) AS m FROM (SELECT DISTINCT brand, y FROM k) k JOIN o ON k.brand = o.brand AND o.y <= k.y - 3 GROUP BY 1, 2),
      c AS (SELECT k.y, sum(o_totalprice::decimal(18,2))::double / count(*) AS m FROM (SELECT DISTINCT y FROM k) k JOIN o ON o.y <= k.y - 3 GROUP BY 1)
      SELECT k.brand, k.c_mktsegment, k.y, coalesce(a.m, b.m, c.m) AS reference, CASE WHEN a.m IS NOT NULL THEN 'brand_segment' WHEN b.m IS NOT NULL THEN 'brand' WHEN c.m IS NOT NULL THEN 'market' END AS level
      FROM k LEFT JOIN a ON k.brand = a.brand AND k.c_mktsegment = a.c_mktsegment AND k.y = a.y LEFT JOIN b ON k.brand = b.brand AND k.y = b.y LEFT JOIN c ON k.y = c.y""",
}
