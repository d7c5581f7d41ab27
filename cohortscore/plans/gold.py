"""Queries of the labelled table, catalogs and contracts, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscore.operators import checks as K
from cohortscore.operators import cohorts as C
from cohortscore.operators import gold as G
from cohortscore.operators.scratch import scratch_folder, settled
from cohortscore.plans import queries as Q
from cohortscore.sources.tables import read_set, write_set

AS_OF = "2001-12-31"
KEYS = ["c_custkey", "y"]
OUTCOMES = ("score", "n_in_window", "index_100")


def _specs(spark: SparkSession, d: str) -> DataFrame:
    return Q._orders(spark, d).select("c_custkey", "y", "brand", "c_mktsegment").distinct()


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("c_acctbal") < 3000, "rejected").otherwise("auto_accepted")
    return G.accepted_only(_specs(spark, d).select(*KEYS).join(Q._t(spark, d, "customer").select("c_custkey", status.alias("status")), "c_custkey"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    scores = Q.severity_window_score(spark, d).select(*KEYS, "score", "n_in_window")
    return G.build_gold(_specs(spark, d), _accepted(spark, d), scores, KEYS, "y", "brand", "c_mktsegment", "score", AS_OF)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in names})


def gold_table(spark, d):
    return _rounded(_gold(spark, d), "history", "index_100")


def gold_from_tables(spark, d):
    """The labelled table from a set of tables that were written, bucketed by its keys."""
    sides = {"specs": _specs(spark, d), "accepted": _accepted(spark, d), "scores": Q.severity_window_score(spark, d).select(*KEYS, "score", "n_in_window")}
    new = write_set(sides, dict.fromkeys(sides, KEYS), "cohort_sides", scratch_folder(spark), 8)
    t = read_set(spark, "cohort_sides", *sides, version=new)
    return _rounded(G.build_gold(t["specs"], t["accepted"], t["scores"], KEYS, "y", "brand", "c_mktsegment", "score", AS_OF), "history", "index_100")


def _inference(spark, d, gold=None):
    return G.inference_catalog(_specs(spark, d), _gold(spark, d) if gold is None else gold, "y", "brand", "score", AS_OF, outcomes=OUTCOMES)


def inference_catalog(spark, d):
    out = G.with_match(_inference(spark, d), _accepted(spark, d), KEYS)
    return _rounded(out, "history").withColumn("as_of", F.col("as_of").cast("string"))


def serving_catalog(spark, d):
    gold = settled(_gold(spark, d))  # both sides read it
    inference = _inference(spark, d, gold).select(*KEYS, "brand", "c_mktsegment", "is_complete")
    out = G.serving_catalog(gold.drop("history", "history_source"), inference, KEYS, ["is_complete"], ["brand", "c_mktsegment"], "y")
    return _rounded(out, "index_100")


def catalog_lookup(spark, d):
    names = Q._t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    catalog = Q._cohorts(spark, d).join(names, "c_custkey")
    asked = catalog.select(F.lower("c_mktsegment").alias("make"), F.when(F.col("c_custkey") % 3 == 0, F.lit("nobody")).otherwise(F.regexp_replace("c_name", "#", " ")).alias("model"), F.col("y").alias("year")).distinct()
    return G.catalog_lookup(asked, catalog, "c_mktsegment", "c_name", "y", ["c_custkey"])


def match_failures(spark, d):
    customers = Q._t(spark, d, "customer")
    matches = customers.select("c_custkey", F.col("c_custkey").alias("cand_id"), F.when(F.col("c_acctbal") < 3000, "rejected").otherwise("auto_accepted").alias("status"))
    replies = customers.filter("c_nationkey <> 0").select(F.col("c_custkey").alias("cand_id"), F.when(F.col("c_nationkey") < 8, "valid_with_recalls").when(F.col("c_nationkey") < 16, "valid_zero_recalls").otherwise("unverified_zero_result").alias("query_status"))
    return G.transfer_failures(matches, replies).select("c_custkey", "status", "audit_required", "advice")


def valid_rows_report(spark, d):
    rows = Q._orders(spark, d).select(F.when(F.col("prio") == 5, F.lit(" ")).otherwise(F.col("brand")).alias("brand"), F.when(F.col("o_orderkey") % 50 != 0, F.col("y")).alias("y"))
    return G.valid_rows(rows, ["brand"], "y", 1997)[1]


def scope_filter(spark, d):
    return G.in_scope(Q._orders(spark, d), "brand", "y", ["nation_1", " Nation_2 "], [1996, 1998]).groupBy("brand", "y").agg(F.count("*").alias("n"))


def incomplete_cohorts(spark, d):
    return G.complete_only(Q._cohorts(spark, d), "y", AS_OF)[1]


def catalog_contract(spark, d):
    rows = Q._t(spark, d, "part").select(F.col("p_partkey").alias("Source ID"), F.when(F.col("p_partkey") % 10 == 0, F.lit("NaN")).otherwise(F.col("p_brand")).alias("Make Name"), F.col("p_name").alias("Model"), F.col("p_size").alias("Year"))
    return G.catalog_contract(rows, {"id": ("source_id",), "make": ("make_name", "brand"), "model": (), "year": ("model_year",)}, "year", 10, 40)


def spec_quality(spark, d):
    rows = Q._orders(spark, d).withColumn("prio", F.when(F.col("prio") != 3, F.col("prio")))
    return K.spec_quality(rows, KEYS, ["o_totalprice", "prio"], "y")


def gold_contract(spark, d):
    rows = Q._orders(spark, d).withColumn("index_100", F.col("o_totalprice") / 3000)
    return K.gold_violations(rows, KEYS, "index_100", [*KEYS, "brand", "index_100"])


def inventory_contract(spark, d):
    rows = Q._t(spark, d, "lineitem").join(Q._t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_partkey", F.when(F.col("l_suppkey") % 20 != 0, F.col("p_brand")).alias("make"), "p_name", (1990 + F.col("p_size")).alias("year"))
    return K.inventory_violations(rows, "l_partkey", ["make", "p_name"], "year")


def publication_contract(spark, d):
    catalog = _specs(spark, d).filter("c_custkey % 11 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))
    return K.publication_violations(_gold(spark, d).select(*KEYS, "brand", "c_mktsegment"), catalog, KEYS, ["brand", "c_mktsegment"])


def _scored(spark, d):
    rows = Q._orders(spark, d)
    return C.hierarchical_mean(rows.filter("y > 1999"), rows.filter("y <= 1997"), "brand", "c_mktsegment", "o_totalprice")


def metric_recompute(spark, d):
    scored = _scored(spark, d).withColumn("part", F.col("y").cast("string"))
    e = F.col("predicted") - F.col("o_totalprice")
    stored = scored.filter("y < 2001 OR prio < 5").groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))
    out = K.recomputed_metrics(scored, stored, "part", "o_totalprice", "predicted")
    return _rounded(out, "own_mae", "own_rmse").select("part", "n_rows", F.round("own_mae", 3).alias("own_mae"), F.round("own_rmse", 3).alias("own_rmse"), "agrees")


def comparability_codes(spark, d):
    rows = Q._orders(spark, d).select("c_custkey", "c_mktsegment", F.when(F.col("prio") != 5, F.lit("v1")).alias("model_version"), F.when(F.col("y") < 1998, "a").otherwise("b").alias("scale_version"), (F.col("prio") == 4).alias("fallback"), (F.col("y") < 1996).alias("retro"), (F.col("prio") == 3).alias("synthetic"))
    return K.comparability(rows, "c_custkey", ["model_version", "scale_version"], "fallback", "retro", "synthetic", "c_mktsegment").select("c_custkey", F.array_join("codes", ",").alias("codes"))


def result_contract(spark, d):
    rows = Q._orders(spark, d).withColumns({"score": F.col("o_totalprice") / 3000 - 5, "answered": F.when(F.col("prio") == 1, F.lit("X")).otherwise(F.col("brand"))})
    return K.result_violations(rows, "score", ["brand", "y"], ["answered", "y"])


def progress_denominators(spark, d):
    parts = Q._t(spark, d, "part")
    totals = parts.agg(F.count("*").alias("total"), F.count("*").alias("variants"), F.countDistinct("p_name").alias("names"), F.countDistinct(F.when(F.col("p_size") < 10, F.col("p_name"))).alias("linked"))
    counts = parts.filter("p_size < 50").groupBy(F.col("p_type").alias("status")).agg(F.count("*").alias("n"))
    return K.denominator_violations(totals, counts, ["variants", "names", "linked"])


def origin_guard(spark, d):
    return K.origin_guard(Q._orders(spark, d).withColumn("synthetic", F.when(F.col("prio") != 2, F.col("y") == 1999)), "synthetic")


def date_quality(spark, d):
    day = F.date_format("l_shipdate", "dd/MM/yyyy")
    text = F.when(F.col("l_returnflag") == "R", F.lit(" ")).when(F.col("l_linenumber") == 7, F.concat(F.lit("99"), F.substring(day, 3, 8))).otherwise(day)
    rows = Q._t(spark, d, "lineitem").withColumn("t", text)
    return K.date_quality(rows, "t", F.try_to_timestamp(F.col("t"), F.lit("dd/MM/yyyy")))


def training_contract(spark, d):
    rows = _gold(spark, d).select("c_custkey", "y", F.when(F.col("c_custkey") % 9 == 0, F.col("score") - 3).otherwise(F.col("score")).alias("score"), F.when(F.col("c_custkey") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("history")).alias("history"), (F.col("y") < 1998).alias("ok"))
    return K.training_violations(rows, KEYS, "y", "score", ["history"], "ok", 1996, 2026)


NAMES = (gold_table, gold_from_tables, inference_catalog, serving_catalog, catalog_lookup, match_failures, valid_rows_report, scope_filter, incomplete_cohorts, catalog_contract, spec_quality, gold_contract, inventory_contract, publication_contract, metric_recompute, comparability_codes, result_contract, progress_denominators, origin_guard, date_quality, training_contract)
QUERIES = {f.__name__: f for f in NAMES}

_GOLD = Q._BASE + f""", sp AS (SELECT DISTINCT c_custkey, y, brand, c_mktsegment FROM o),
  sc AS (SELECT coh.c_custkey, y, coalesce(sum(weight) FILTER ({Q._IN}), 0.0) AS score, count(*) FILTER ({Q._IN}) AS n_in_window FROM coh LEFT JOIN ev ON coh.c_custkey = ev.c_custkey GROUP BY 1, 2),
  g0 AS (SELECT sp.*, score, n_in_window FROM sp JOIN sc USING (c_custkey, y) JOIN customer USING (c_custkey) WHERE customer.c_acctbal >= 3000 AND sp.y <= 1998),
  bm AS (SELECT brand, y, avg(score) AS m FROM g0 GROUP BY 1, 2), q AS (SELECT DISTINCT brand, y FROM sp),
  ow AS (SELECT q.brand, q.y, avg(m) AS own FROM q LEFT JOIN bm ON bm.brand = q.brand AND bm.y BETWEEN q.y - 5 AND q.y - 3 GROUP BY 1, 2),
  mk AS (SELECT q.y, avg(m) AS market FROM (SELECT DISTINCT y FROM q) q LEFT JOIN bm ON bm.y BETWEEN q.y - 5 AND q.y - 3 GROUP BY 1),
  h AS (SELECT brand, y, coalesce(own, market) AS history, CASE WHEN own IS NOT NULL THEN 'own' WHEN market IS NOT NULL THEN 'market' END AS history_source FROM ow JOIN mk USING (y)),
  st AS (SELECT c_mktsegment, avg(score) AS m, stddev_pop(score) AS d FROM g0 GROUP BY 1),
  gold AS (SELECT g0.*, history, history_source, round(greatest(0, least(100, 50 - 10 * (score - m) / d)), 4) AS index_100 FROM g0 JOIN st USING (c_mktsegment) LEFT JOIN h USING (brand, y)) """
_RULE = lambda name, test: f"SELECT '{name}' AS rule, count(*) FILTER ({test}) AS n"
_ERR = Q.ORACLE["group_mean_errors"].split("), e AS (")[0] + f"""), e AS (SELECT o.*, coalesce(a, b, c, (SELECT avg(o_totalprice) FROM t)) AS predicted FROM o LEFT JOIN m0 USING (brand, c_mktsegment) LEFT JOIN m1 USING (brand) LEFT JOIN m2 ON o.c_mktsegment = m2.c_mktsegment WHERE y > 1999) """
ORACLE = {
    "gold_table": _GOLD + "SELECT c_custkey, y, brand, c_mktsegment, score, n_in_window, round(history, 4) AS history, history_source, index_100 FROM gold",
    "gold_from_tables": _GOLD + "SELECT c_custkey, y, brand, c_mktsegment, score, n_in_window, round(history, 4) AS history, history_source, index_100 FROM gold",
    "inference_catalog": _GOLD + f"SELECT sp.c_custkey, sp.y, sp.brand, sp.c_mktsegment, round(history, 4) AS history, history_source, sp.y <= 1998 AS is_complete, '{AS_OF}' AS as_of, CASE WHEN customer.c_acctbal >= 3000 THEN 'auto_accepted' ELSE 'not_queried' END AS status FROM sp JOIN h USING (brand, y) JOIN customer ON sp.c_custkey = customer.c_custkey",
    "serving_catalog": _GOLD + "SELECT sp.c_custkey, sp.y, lower(trim(sp.brand)) AS brand, lower(trim(sp.c_mktsegment)) AS c_mktsegment, score, n_in_window, index_100, CASE WHEN gold.c_custkey IS NULL THEN 'inference' ELSE 'gold' END AS origin, sp.y <= 1998 AS is_complete FROM sp LEFT JOIN gold ON sp.c_custkey = gold.c_custkey AND sp.y = gold.y",
    "catalog_lookup": f"""WITH c AS (SELECT DISTINCT o_custkey AS c_custkey, year(o_orderdate) AS y, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
      a AS (SELECT DISTINCT lower(c_mktsegment) AS make, CASE WHEN c_custkey % 3 = 0 THEN 'nobody' ELSE replace(c_name, '#', ' ') END AS model, y AS year FROM c)
      SELECT make, model, year, c_custkey, c_custkey IS NOT NULL AS is_found FROM a LEFT JOIN c ON {Q._CANON('make')} = {Q._CANON('c_mktsegment')} AND {Q._CANON('model')} = {Q._CANON('c_name')} AND year = y""",
    "match_failures": "SELECT *, status NOT IN ('rejected', 'auto_accepted') AS audit_required, CASE WHEN status NOT IN ('rejected', 'auto_accepted') THEN 'No transferir una etiqueta: consulta fallida o cero sin verificar.' END AS advice FROM (SELECT c_custkey, CASE WHEN c_acctbal < 3000 THEN 'rejected' WHEN c_nationkey = 0 THEN 'query_failed' WHEN c_nationkey >= 16 THEN 'unverified_zero_result' ELSE 'auto_accepted' END AS status FROM customer)",
    "valid_rows_report": Q._BASE + "SELECT count(*) AS n_read, count(*) FILTER (prio = 5) AS blank_key, count(*) FILTER (prio <> 5 AND o_orderkey % 50 = 0) AS no_year, count(*) FILTER (prio <> 5 AND o_orderkey % 50 <> 0 AND y < 1997) AS early_year, count(*) FILTER (prio <> 5 AND o_orderkey % 50 <> 0 AND y >= 1997) AS n_kept FROM o",
    "scope_filter": Q._BASE + "SELECT brand, y, count(*) AS n FROM o WHERE brand IN (SELECT n_name FROM nation WHERE lower(n_name) IN ('nation_1', 'nation_2')) AND y IN (1996, 1998) GROUP BY 1, 2",
    "incomplete_cohorts": Q._BASE + "SELECT count(*) FILTER (y > 1998) AS n_incomplete FROM coh",
    "catalog_contract": "SELECT p_partkey::varchar AS id, p_brand AS make, p_name AS model, p_size AS year FROM part WHERE p_partkey % 10 <> 0 AND p_size BETWEEN 10 AND 40",
    "spec_quality": Q._BASE + "SELECT count(*) AS n, count(*) FILTER (c_custkey IS NULL OR y IS NULL) AS n_null_key, count(*) FILTER (o_totalprice IS NULL) AS null_o_totalprice, count(*) FILTER (prio = 3) AS null_prio, min(y) AS first_year, max(y) AS last_year, (SELECT count(*) FROM (SELECT 1 FROM o GROUP BY c_custkey, y HAVING count(*) > 1)) AS n_repeated FROM o",
    "gold_contract": Q._BASE + "SELECT 'empty' AS rule, 0 AS n UNION ALL SELECT 'repeated_key', (SELECT count(*) FROM o) - (SELECT count(*) FROM coh) UNION ALL SELECT 'index_out_of_range', (SELECT count(*) FROM o WHERE o_totalprice > 300000 OR o_totalprice < 0)",
    "inventory_contract": "WITH i AS (SELECT l_partkey, CASE WHEN l_suppkey % 20 <> 0 THEN p_brand END AS make, 1990 + p_size AS year FROM lineitem JOIN part ON l_partkey = p_partkey), b AS (SELECT l_partkey, count(*) AS c, count(DISTINCT coalesce(make, '')) AS d FROM i GROUP BY 1) "
    + _RULE("blank_field", "make IS NULL") + " FROM i UNION ALL " + _RULE("bad_year", "year < 1995") + " FROM i UNION ALL " + _RULE("repeated_id", "c > 1") + " FROM b UNION ALL " + _RULE("conflicting_id", "d > 1") + " FROM b",
    "publication_contract": _GOLD + "SELECT 'repeated_catalog_key' AS rule, 0 AS n UNION ALL " + _RULE("gold_not_in_catalog", "c_custkey % 11 = 0") + " FROM gold UNION ALL SELECT 'differs_brand', 0 UNION ALL " + _RULE("differs_c_mktsegment", "c_custkey % 11 <> 0 AND c_custkey % 7 = 0") + " FROM gold",
    "metric_recompute": _ERR + "SELECT y::varchar AS part, count(*) AS n_rows, round(avg(abs(predicted - o_totalprice)), 3) AS own_mae, round(sqrt(avg((predicted - o_totalprice) ** 2)), 3) AS own_rmse, y < 2001 AS agrees FROM e GROUP BY y",
    "comparability_codes": Q._BASE + "SELECT c_custkey, concat_ws(',', CASE WHEN bool_or(prio = 5) THEN 'missing_model_version' END, CASE WHEN min(y) < 1998 AND max(y) >= 1998 THEN 'different_scale_version' END, CASE WHEN bool_or(prio = 4) THEN 'fallback' END, CASE WHEN min(y) < 1996 THEN 'retrospective' END, CASE WHEN bool_or(prio = 3) AND NOT bool_and(prio = 3) THEN 'mixed_origin' END) AS codes FROM o GROUP BY 1",
    "result_contract": Q._BASE + _RULE("score_out_of_range", "o_totalprice / 3000 - 5 < 0 OR o_totalprice / 3000 - 5 > 100") + " FROM o UNION ALL " + _RULE("other_identity", "prio = 1") + " FROM o",
    "progress_denominators": "SELECT 'negative_count' AS rule, 0 AS n UNION ALL SELECT 'counts_do_not_add_up', CASE WHEN (SELECT count(*) FROM part WHERE p_size = 50) > 0 THEN 1 ELSE 0 END UNION ALL SELECT 'totals_out_of_order', 0",
    "origin_guard": Q._BASE + "SELECT bool_or(y = 1999 AND prio <> 2) AS is_synthetic, bool_or(y = 1999 AND prio <> 2) AND NOT bool_and(y = 1999 AND prio <> 2) AS is_mixed FROM o",
    "date_quality": "SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_missing, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber = 7) AS n_invalid FROM lineitem",
    "training_contract": _GOLD + "SELECT 'blank_id' AS rule, 0 AS n UNION ALL " + _RULE("bad_year", "y < 1996") + " FROM gold UNION ALL " + _RULE("bad_label", "c_custkey % 9 = 0 AND score < 3") + " FROM gold UNION ALL " + _RULE("incomplete", "y >= 1998") + " FROM gold UNION ALL " + _RULE("infinite_history", "c_custkey % 5 = 0") + " FROM gold UNION ALL SELECT 'repeated_id', 0",
}
