"""Queries that bind the operators to the tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscore.functions import text as T
from cohortscore.operators import audits as A
from cohortscore.operators import cohorts as C

#: Keyword classes, their weights, and words that are no part of a root name. Fixed values.
CLASSES = (("critical", ("hot", "old")), ("moderate", ("red", "blue")), ("low", ("small", "large")))
WEIGHTS = {"critical": 3.0, "moderate": 1.5, "low": 1.0, "unclassified": 1.0}
TRIMS = ("small", "large", "new", "old")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    customers = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"), "o_totalprice", F.col("o_orderpriority").substr(1, 1).cast("int").alias("prio"))
    return orders.join(customers.select("c_custkey", "c_mktsegment", F.col("n_name").alias("brand")), "c_custkey")


def _events(spark: SparkSession, d: str) -> DataFrame:
    name = T.keyword_class(F.col("p_name"), CLASSES)
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), T.class_weight(name, WEIGHTS).alias("weight"), name.alias("cls"))
    items = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.when(F.col("l_returnflag") != "R", F.year("l_shipdate")).alias("ship_year"))
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    return C.best_of_campaign(items.join(part, "l_partkey").join(orders, "l_orderkey"), "c_custkey", "l_partkey", "weight", ["l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey"])


def _cohorts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y")).distinct()


def canonical_text_docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.canonical_text(F.col("text")).alias("canonical"))


def entity_keys(spark, d):
    return _t(spark, d, "customer").select("c_custkey", T.entity_id(F.col("c_name"), F.col("c_mktsegment")).alias("id"), T.comparison_make(F.col("c_mktsegment")).alias("make_key"), T.comparison_model(F.col("c_name")).alias("model_key"), T.digits_of(F.col("c_name")).alias("digits"))


def model_root(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.root_name(F.col("p_name"), TRIMS).alias("root"))


def severity_class(spark, d):
    name = T.keyword_class(F.col("p_name"), CLASSES)
    return _t(spark, d, "part").select("p_partkey", name.alias("cls"), T.class_weight(name, WEIGHTS).alias("weight"))


def spec_aggregate(spark, d):
    return C.aggregate_specs(_orders(spark, d), ["c_custkey", "y"], ["o_totalprice", "prio"], "c_mktsegment")


def campaign_dedupe(spark, d):
    return _events(spark, d).select("c_custkey", "l_partkey", "l_orderkey", "l_linenumber", "weight", "ship_year")


def severity_window_score(spark, d):
    return C.window_scores(_cohorts(spark, d), _events(spark, d), "c_custkey", "y", "ship_year", "weight")


def severity_crosstab(spark, d):
    events = _events(spark, d).join(_cohorts(spark, d), "c_custkey").filter("ship_year >= y AND ship_year < y + 3")
    names = [name for name, _ in CLASSES] + ["unclassified"]
    counts = events.groupBy("c_custkey", "y").pivot("cls", names).agg(F.count("l_partkey"))
    return _cohorts(spark, d).join(counts, ["c_custkey", "y"], "left").na.fill(0, names)


def cohort_maturity(spark, d):
    return _cohorts(spark, d).select("c_custkey", "y", C.mature(F.col("y"), "2001-12-31").alias("is_mature"))


def brand_history(spark, d):
    return C.lagged_history(_orders(spark, d).withColumn("c", F.col("c_custkey")), "c", "y", "o_totalprice").select("c", "y", F.round("history", 6).alias("history"), "history_source")


def segment_index(spark, d):
    rows = _orders(spark, d)
    scale = C.fit_scale(rows.filter("y <= 1998"), "c_mktsegment", "o_totalprice")
    return C.scaled_index(rows, scale, "c_mktsegment", "o_totalprice").select("o_orderkey", F.round("index_100", 4).alias("index_100"))


def temporal_split(spark, d):
    return C.temporal_split(_orders(spark, d), "y", 1997, 1999, 2).groupBy("partition", "y").agg(F.count("*").alias("n"))


def group_mean_errors(spark, d):
    rows = _orders(spark, d)
    scored = C.hierarchical_mean(rows.filter("y > 1999"), rows.filter("y <= 1997"), "brand", "c_mktsegment", "o_totalprice")
    out = C.error_summary(scored, "o_totalprice", "predicted", [[], ["c_mktsegment"], ["y"], ["level"]])
    return out.select("c_mktsegment", "y", "level", "n", *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "bias")])


def coverage_sets(spark, d):
    rows = _orders(spark, d).withColumn("included", F.col("y") <= 1998)
    sets = rows.groupingSets([[], [F.col("brand")], [F.col("c_mktsegment")], [F.col("y")]], F.col("brand"), F.col("c_mktsegment"), F.col("y"))
    return sets.agg(F.count("*").alias("n"), F.count_if("included").alias("n_included"), F.round(F.avg(F.col("included").cast("int")), 6).alias("rate"))


def config_conflicts(spark, d):
    values = _t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n_rows"), F.countDistinct("l_quantity").alias("n_values"), F.min("l_quantity").alias("v"))
    return values.select("l_partkey", "l_suppkey", "n_rows", "n_values", F.when(F.col("n_values") == 1, F.col("v")).alias("value"), F.when(F.col("n_values") == 0, "missing").when(F.col("n_values") == 1, "single_value").otherwise("conflicting").alias("status"))


def eda_summary(spark, d):
    rows = _orders(spark, d)
    whole = rows.agg(F.count("*").alias("n"), F.countDistinct("brand").alias("brands"), F.countDistinct("c_mktsegment").alias("segments"), F.min("y").alias("first"), F.max("y").alias("last"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.corr("o_totalprice", "prio"), 6).alias("corr"))
    middle = A.exact_quantiles(rows, [], "o_totalprice", [0.5]).select(F.lit(1).alias("one"), F.round("q0", 4).alias("median"))
    return whole.withColumn("one", F.lit(1)).join(F.broadcast(middle), "one", "left").drop("one")  # one row each


def category_quantiles(spark, d):
    out = A.exact_quantiles(_orders(spark, d), ["c_mktsegment"], "o_totalprice", [0.0, 0.25, 0.5, 0.75, 1.0])
    return out.select("c_mktsegment", *[F.round(f"q{i}", 4).alias(f"q{i}") for i in range(5)])


def segment_context(spark, d):
    by_year = _orders(spark, d).groupBy("c_mktsegment", "y").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("c"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    older = Window.partitionBy("c_mktsegment").orderBy("y").rangeBetween(Window.unboundedPreceding, -1)
    return by_year.select("c_mktsegment", "y", F.round(F.sum("s").over(older) / F.sum("c").over(older), 4).alias("mean"), F.min("lo").over(older).alias("low"), F.max("hi").over(older).alias("high"))


def payload_rows(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def version_diff(spark, d):
    ids = _cohorts(spark, d).select("c_custkey", "y")
    old, new = ids.filter("y <= 1998").select("c_custkey").distinct(), ids.filter("y > 1998").select("c_custkey").distinct()
    added, removed = new.join(old, "c_custkey", "left_anti"), old.join(new, "c_custkey", "left_anti")
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))


NAMES = (canonical_text_docs, entity_keys, model_root, severity_class, spec_aggregate, campaign_dedupe, severity_window_score, severity_crosstab, cohort_maturity, brand_history, segment_index, temporal_split, group_mean_errors, coverage_sets, config_conflicts, eda_summary, category_quantiles, segment_context, payload_rows, version_diff)
QUERIES = {f.__name__: f for f in NAMES}

_CANON = lambda c: f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"
_PLAIN = f"replace({_CANON('p_name')}, 'air bag', 'airbag')"
_CLASS = f"CASE WHEN regexp_matches({_PLAIN}, '\\b(hot|old)s?\\b') THEN 'critical' WHEN regexp_matches({_PLAIN}, '\\b(red|blue)s?\\b') THEN 'moderate' WHEN regexp_matches({_PLAIN}, '\\b(small|large)s?\\b') THEN 'low' ELSE 'unclassified' END"
_JOINED = lambda c: f"regexp_replace(regexp_replace({_CANON(c)}, '([a-z]) ([0-9])', '\\1\\2', 'g'), '([0-9]) ([a-z])', '\\1\\2', 'g')"
_BASE = f"""WITH o AS (SELECT o_orderkey, o_custkey AS c_custkey, year(o_orderdate) AS y, o_totalprice, cast(substr(o_orderpriority, 1, 1) AS int) AS prio, c_mktsegment, n_name AS brand
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
coh AS (SELECT DISTINCT o_custkey AS c_custkey, year(o_orderdate) AS y FROM orders),
p AS (SELECT *, CASE cls WHEN 'critical' THEN 3.0::double WHEN 'moderate' THEN 1.5 ELSE 1.0 END AS weight FROM (SELECT p_partkey, {_CLASS} AS cls FROM part)),
ev AS (SELECT o_custkey AS c_custkey, l_partkey, l_orderkey, l_linenumber, weight, cls, CASE WHEN l_returnflag <> 'R' THEN year(l_shipdate) END AS ship_year
  FROM lineitem JOIN p ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  QUALIFY row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY weight DESC, l_orderkey, l_linenumber, l_shipdate, l_suppkey) = 1)
"""
_IN = "ship_year >= y AND ship_year < y + 3"
ORACLE = {
    "canonical_text_docs": f"SELECT doc_id, coalesce({_CANON('text')}, '') AS canonical FROM documents",
    "entity_keys": f"SELECT c_custkey, upper(replace({_CANON('c_name')}, ' ', '_') || '_' || replace({_CANON('c_mktsegment')}, ' ', '_')) AS id, {_CANON('c_mktsegment')} AS make_key, {_JOINED('c_name')} AS model_key, regexp_extract_all(c_name, '[0-9]+') AS digits FROM customer",
    "model_root": f"SELECT p_partkey, array_to_string(list_filter(string_split({_JOINED('p_name')}, ' '), lambda t: t NOT IN ('small', 'large', 'new', 'old')), ' ') AS root FROM part",
    "severity_class": _BASE + "SELECT p_partkey, cls, weight FROM p",
    "spec_aggregate": _BASE + ", m AS (SELECT c_custkey, y, c_mktsegment FROM (SELECT c_custkey, y, c_mktsegment, row_number() OVER (PARTITION BY c_custkey, y ORDER BY count(*) DESC, c_mktsegment) AS n FROM o GROUP BY 1, 2, 3) WHERE n = 1) SELECT c_custkey, y, count(*) AS n_rows, m.c_mktsegment, median(o_totalprice) AS o_totalprice_median, count(o_totalprice) AS o_totalprice_observed, median(prio) AS prio_median, count(prio) AS prio_observed FROM o JOIN m USING (c_custkey, y) GROUP BY 1, 2, 4",
    "campaign_dedupe": _BASE + "SELECT c_custkey, l_partkey, l_orderkey, l_linenumber, weight, ship_year FROM ev",
    "severity_window_score": _BASE + f"SELECT coh.c_custkey, y, coalesce(sum(weight) FILTER ({_IN}), 0.0) AS score, count(*) FILTER ({_IN}) AS n_in_window, count(*) FILTER (ev.c_custkey IS NOT NULL AND NOT coalesce({_IN}, false)) AS n_outside, count(*) FILTER (ev.c_custkey IS NOT NULL AND ship_year IS NULL) AS n_undated FROM coh LEFT JOIN ev ON coh.c_custkey = ev.c_custkey GROUP BY 1, 2",
    "severity_crosstab": _BASE + "SELECT coh.c_custkey, y, " + ", ".join(f"count(*) FILTER (cls = '{n}' AND {_IN}) AS {n}" for n in ("critical", "moderate", "low", "unclassified")) + " FROM coh LEFT JOIN ev ON coh.c_custkey = ev.c_custkey GROUP BY 1, 2",
    "cohort_maturity": _BASE + "SELECT c_custkey, y, DATE '2001-12-31' >= make_date(y + 3, 1, 1) AS is_mature FROM coh",
    "brand_history": _BASE + ", b AS (SELECT c_custkey AS c, y, avg(o_totalprice) AS m FROM o GROUP BY 1, 2), k AS (SELECT DISTINCT y FROM b), mk AS (SELECT k.y, avg(m) AS market FROM k LEFT JOIN b ON b.y BETWEEN k.y - 5 AND k.y - 3 GROUP BY 1), ow AS (SELECT x.c, x.y, avg(z.m) AS own FROM b x LEFT JOIN b z ON x.c = z.c AND z.y BETWEEN x.y - 5 AND x.y - 3 GROUP BY 1, 2) SELECT c, y, round(coalesce(own, market), 6) AS history, CASE WHEN own IS NOT NULL THEN 'own' WHEN market IS NOT NULL THEN 'market' END AS history_source FROM ow JOIN mk USING (y)",
    "segment_index": _BASE + ", s AS (SELECT c_mktsegment, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM o WHERE y <= 1998 GROUP BY 1) SELECT o_orderkey, round(greatest(0, least(100, 50 - 10 * (o_totalprice - m) / d)), 4) AS index_100 FROM o JOIN s USING (c_mktsegment)",
    "temporal_split": _BASE + "SELECT CASE WHEN y <= 1997 THEN CASE WHEN y > 1996 THEN 'train_embargoed' ELSE 'train' END WHEN y <= 1999 THEN CASE WHEN y > 1998 THEN 'validation_embargoed' ELSE 'validation' END ELSE 'test' END AS partition, y, count(*) AS n FROM o GROUP BY 1, 2",
    "group_mean_errors": _BASE + ", t AS (SELECT * FROM o WHERE y <= 1997), m0 AS (SELECT brand, c_mktsegment, avg(o_totalprice) AS a FROM t GROUP BY 1, 2), m1 AS (SELECT brand, avg(o_totalprice) AS b FROM t GROUP BY 1), m2 AS (SELECT c_mktsegment, avg(o_totalprice) AS c FROM t GROUP BY 1), e AS (SELECT o.c_mktsegment, y, CASE WHEN a IS NOT NULL THEN 'brand_segment' WHEN b IS NOT NULL THEN 'brand' WHEN c IS NOT NULL THEN 'segment' ELSE 'all' END AS level, coalesce(a, b, c, (SELECT avg(o_totalprice) FROM t)) - o_totalprice AS e FROM o LEFT JOIN m0 USING (brand, c_mktsegment) LEFT JOIN m1 USING (brand) LEFT JOIN m2 ON o.c_mktsegment = m2.c_mktsegment WHERE y > 1999) SELECT c_mktsegment, y, level, count(e) AS n, round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(e), 3) AS bias FROM e GROUP BY GROUPING SETS ((), (c_mktsegment), (y), (level))",
    "coverage_sets": _BASE + "SELECT brand, c_mktsegment, y, count(*) AS n, count(*) FILTER (y <= 1998) AS n_included, round(avg(CASE WHEN y <= 1998 THEN 1 ELSE 0 END), 6) AS rate FROM o GROUP BY GROUPING SETS ((), (brand), (c_mktsegment), (y))",
    "config_conflicts": "SELECT l_partkey, l_suppkey, count(*) AS n_rows, count(DISTINCT l_quantity) AS n_values, CASE WHEN count(DISTINCT l_quantity) = 1 THEN min(l_quantity) END AS value, CASE count(DISTINCT l_quantity) WHEN 0 THEN 'missing' WHEN 1 THEN 'single_value' ELSE 'conflicting' END AS status FROM lineitem GROUP BY 1, 2",
    "eda_summary": _BASE + "SELECT count(*) AS n, count(DISTINCT brand) AS brands, count(DISTINCT c_mktsegment) AS segments, min(y) AS first, max(y) AS last, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(corr(o_totalprice, prio), 6) AS corr FROM o",
    "category_quantiles": _BASE + "SELECT c_mktsegment, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS q{i}" for i, q in enumerate((0, 0.25, 0.5, 0.75, 1))) + " FROM o GROUP BY 1",
    "segment_context": _BASE + ", k AS (SELECT DISTINCT c_mktsegment, y FROM o) SELECT k.c_mktsegment, k.y, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM k LEFT JOIN o ON o.c_mktsegment = k.c_mktsegment AND o.y < k.y GROUP BY 1, 2",
    "payload_rows": "SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events",
    "version_diff": _BASE + ", a AS (SELECT DISTINCT c_custkey FROM coh WHERE y <= 1998), b AS (SELECT DISTINCT c_custkey FROM coh WHERE y > 1998) SELECT c_custkey, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT c_custkey, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
}
