"""Queries of linkage, evidence and audits, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscore.functions import text as T
from cohortscore.operators import audits as A
from cohortscore.operators import cohorts as C
from cohortscore.operators import matching as M
from cohortscore.plans import queries as Q

#: Types of parts that the catalog covers, as a prefix of the type's name. Fixed value.
COVERED = "[A-M]"
AS_OF, LAST_TRAIN, SAMPLE = "2001-12-31", 1998, 200
SCENARIOS = {
    "documented": {"critical": 3.0, "moderate": 1.5, "low": 1.0, "unclassified": 1.0},
    "equal": {"critical": 1.0, "moderate": 1.0, "low": 1.0, "unclassified": 1.0},
    "steep": {"critical": 5.0, "moderate": 2.0, "low": 1.0, "unclassified": 1.0},
    "classified_only": {"critical": 3.0, "moderate": 1.5, "low": 1.0, "unclassified": 0.0},
}


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return Q._t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("make"), F.col("p_name").alias("model"), F.col("p_size").alias("year"), F.col("p_type").rlike(f"^{COVERED}").alias("covered"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = _parts(spark, d)
    catalog = parts.filter("covered").select(F.col("p_partkey").alias("cand_id"), "make", "model", "year", F.lit(True).alias("verified"))
    return parts.filter("NOT covered").withColumnRenamed("p_partkey", "id"), catalog


def entity_match(spark, d):
    rows, catalog = _sides(spark, d)
    return M.match_entities(rows, catalog, Q.TRIMS)


def match_table(spark, d):
    rows, catalog = _sides(spark, d)
    sources = Q._t(spark, d, "part").select(F.col("p_partkey").alias("cand_id"), F.col("p_type").alias("source"))
    return M.match_table(rows, catalog.join(sources, "cand_id"), Q.TRIMS)


def match_summary(spark, d):
    return M.match_summary(entity_match(spark, d))


def inventory_resolution(spark, d):
    return M.resolve_inventory(*_sides(spark, d))


def two_stage_lookup(spark, d):
    entities = _parts(spark, d).select(F.col("p_partkey").alias("cand_id"), "make", "model", "year")
    asked = entities.select(F.upper("make").alias("make"), F.when(F.col("year") % 2 == 0, F.regexp_replace("model", " ", "-")).otherwise(F.upper("model")).alias("model"), (F.col("year") + F.when(F.col("year") > 45, 5).otherwise(0)).alias("year"))
    return M.two_stage_lookup(asked, entities)


def evidence_states(spark, d):
    cohorts = Q._cohorts(spark, d)
    bal = F.col("c_acctbal")
    status = F.when(bal < 0, "rejected").when(bal < 1000, "manual_review").when(bal < 2000, "no_candidate").when(bal < 3000, "query_failed").otherwise("auto_accepted")
    customers = Q._t(spark, d, "customer")
    ident = F.concat_ws("_", F.col("c_custkey").cast("string"), F.col("y").cast("string")).alias("id")
    matches = cohorts.join(customers.filter("c_acctbal <= 9000"), "c_custkey").select(ident, F.col("c_custkey").alias("cand_id"), status.alias("status"))
    seen = Q._events(spark, d).groupBy("c_custkey").agg(F.count("*").alias("n_events"))
    replies = customers.filter("c_nationkey <> 0").join(seen, "c_custkey", "left").select(F.col("c_custkey").alias("cand_id"), F.when(F.col("n_events") > 0, "valid_with_recalls").otherwise("valid_zero_recalls").alias("query_status"))
    scores = Q.severity_window_score(spark, d).join(customers.filter("c_acctbal BETWEEN 3000 AND 9000 AND c_nationkey <> 0").select("c_custkey"), "c_custkey")
    gold = scores.filter("y <= 1997").select(ident, "n_in_window")
    return M.evidence_states(cohorts.select(ident, "y"), matches, replies, gold, C.mature(F.col("y"), AS_OF))


def median_imputation(spark, d):
    rows = Q._orders(spark, d).withColumn("v", F.when(F.col("prio") != 1, F.col("o_totalprice")))
    return A.impute_medians(rows, rows.filter(f"y <= {LAST_TRAIN}"), "brand", "c_mktsegment", "v").select("o_orderkey", F.round("v_imputed", 4).alias("v_imputed"), "imputed_from")


def target_sensitivity(spark, d):
    segments = Q._t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    gold = Q.severity_crosstab(spark, d).join(segments, "c_custkey")
    out = A.sensitivity(gold, SCENARIOS, "documented", "c_mktsegment", "y", LAST_TRAIN)
    return out.select("scenario", "part", "n", *[F.round(c, 4).alias(c) for c in ("mean_shift", "max_shift", "rank_corr")], "changed_band")


def scope_sample(spark, d):
    return A.scope_sample(_parts(spark, d), "year", "make", ["model", "p_partkey"], SAMPLE).select("p_partkey", "year", "make", "position")


def table_fingerprint(spark, d):
    return A.fingerprint(Q._t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"])


NAMES = (entity_match, match_table, match_summary, inventory_resolution, two_stage_lookup, evidence_states, median_imputation, target_sensitivity, scope_sample, table_fingerprint)
QUERIES = {f.__name__: f for f in NAMES}

_ID = "c_custkey || '_' || y"
_WEIGHTS = ", ".join(f"('{name}', " + ", ".join(f"{w[c]}::double" for c in ("critical", "moderate", "low", "unclassified")) + ")" for name, w in SCENARIOS.items())
_LIMBS = " || '-' || ".join(f"sum(('0x' || substr(h, {1 + 16 * i}, 15))::bigint)::varchar" for i in range(4))
_LCS = lambda x, y: f"list_reduce(string_split({x}, ''), lambda above, ch: list_reduce(range(1, length({y}) + 1), lambda done, j: list_append(done, CASE WHEN substr({y}, j, 1) = ch THEN above[j] + 1 ELSE greatest(above[j + 1], done[-1]) END), [0::bigint]), list_transform(range(0, length({y}) + 1), lambda z: 0::bigint))[-1]"
_R = lambda x, y: f"2.0::double * {_LCS(x, y)} / (length({x}) + length({y}))"
_SETS = """ d AS (SELECT *, list_sort(list_intersect(wa, wb)) AS s, list_sort(list_filter(wa, lambda w: NOT list_contains(wb, w))) AS oa, list_sort(list_filter(wb, lambda w: NOT list_contains(wa, w))) AS ob
    FROM (SELECT *, list_distinct(string_split(key, ' ')) AS wa, list_distinct(string_split(c_key, ' ')) AS wb FROM names)),
  t AS (SELECT *, array_to_string(s, ' ') AS j, trim(array_to_string(s, ' ') || ' ' || array_to_string(oa, ' ')) AS pa, trim(array_to_string(s, ' ') || ' ' || array_to_string(ob, ' ')) AS pb FROM d),"""
_SIDES = f"""WITH r AS (SELECT p_partkey AS id, {Q._CANON('p_brand')} AS mk, p_size AS year, p_brand, p_name, {Q._JOINED('p_name')} AS key FROM part WHERE NOT regexp_matches(p_type, '^{COVERED}')),
  c AS (SELECT p_partkey AS cand_id, {Q._CANON('p_brand')} AS mk, p_size AS year, {Q._JOINED('p_name')} AS c_key FROM part WHERE regexp_matches(p_type, '^{COVERED}')),
  names AS (SELECT DISTINCT key, c_key FROM r JOIN c USING (mk, year)),{_SETS}
  sim AS (SELECT key, c_key, CASE WHEN len(oa) = 0 AND len(ob) = 0 OR j <> '' AND (len(oa) = 0 OR len(ob) = 0) THEN 100 ELSE round_even(100 * CASE WHEN j = '' THEN {_R('pa', 'pb')} ELSE greatest({_R('pa', 'pb')}, {_R('j', 'pa')}, {_R('j', 'pb')}) END, 0)::int END AS score FROM t),
  pr AS (SELECT r.id, r.key, c.cand_id, c.c_key, sim.score, key <> c_key AS other FROM r JOIN c USING (mk, year) JOIN sim USING (key, c_key)),
  b AS (SELECT *, count(*) OVER (PARTITION BY id, score) AS n_best, count(*) FILTER (NOT other) OVER (PARTITION BY id) AS n_exact FROM pr QUALIFY row_number() OVER (PARTITION BY id ORDER BY other, score DESC, c_key, cand_id) = 1),
  ro AS (SELECT *, array_to_string(list_filter(string_split(key, ' '), lambda t: t NOT IN ('small', 'large', 'new', 'old')), ' ') AS root, array_to_string(list_filter(string_split(c_key, ' '), lambda t: t NOT IN ('small', 'large', 'new', 'old')), ' ') AS c_root FROM b),
  m AS (SELECT r.id, cand_id, score, root <> '' AND root = c_root AS root_equal, n_exact::bigint AS n_exact, n_best, c_key AS cand_key,
    CASE WHEN score IS NULL THEN 'no_candidate' WHEN score >= 90 AND (root <> '' AND root = c_root OR NOT other AND n_exact = 1) AND NOT (n_exact > 1 OR other AND n_best > 1) THEN 'auto_accepted' WHEN score >= 75 THEN 'manual_review' ELSE 'rejected' END AS status,
    CASE WHEN score < 75 THEN '{T.ADVICE[0]}' WHEN root <> '' AND root = c_root THEN '{T.ADVICE[1]}' WHEN score IS NOT NULL THEN '{T.ADVICE[2]}' END AS advice FROM r LEFT JOIN ro USING (id)) """
ORACLE = {
    "entity_match": _SIDES + "SELECT * FROM m",
    "match_table": _SIDES + f"""SELECT r.id, r.p_brand AS make, r.p_name AS model, r.year, m.cand_id, cp.p_brand AS cand_make, cp.p_name AS cand_model, m.score, m.status, array_to_string(list_filter(string_split(r.key, ' '), lambda t: t NOT IN ('small', 'large', 'new', 'old')), ' ') AS root, ro.c_root AS cand_root,
      coalesce(m.root_equal, false) AS root_equal, coalesce(m.advice, '{T.NO_CANDIDATE}') AS advice, NULL AS decision, m.status <> 'auto_accepted' AS audit_required, CASE WHEN m.cand_id IS NOT NULL THEN true END AS cand_verified, cp.p_type AS cand_source
      FROM r JOIN m ON r.id = m.id LEFT JOIN ro ON r.id = ro.id LEFT JOIN part AS cp ON m.cand_id = cp.p_partkey""",
    "match_summary": _SIDES + "SELECT count(*) AS n, count(*) FILTER (status = 'auto_accepted') AS accepted, count(*) FILTER (status = 'manual_review') AS manual_review, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'no_candidate') AS no_candidate, round(1 - count(*) FILTER (status = 'auto_accepted') / count(*), 6) AS loss_rate, 1 - count(*) FILTER (status = 'auto_accepted') / count(*) > 0.4 AS alarm FROM m",
    "inventory_resolution": _SIDES + ", v AS (SELECT DISTINCT p_brand, p_name, mk, year, key FROM r), k AS (SELECT v.p_brand, v.p_name, v.year, count(c.cand_id) AS pool, count(*) FILTER (v.key = c.c_key) AS e, min(cand_id) FILTER (v.key = c.c_key) AS e_id, count(*) FILTER (score >= 75) AS s FROM v LEFT JOIN c ON v.mk = c.mk AND v.year = c.year LEFT JOIN sim ON v.key = sim.key AND c.c_key = sim.c_key GROUP BY 1, 2, 3) SELECT p_brand AS make, p_name AS model, year, CASE WHEN pool = 0 THEN 'no_same_make_year' WHEN e = 1 THEN 'exact_name' WHEN e > 1 THEN 'ambiguous_name' WHEN s > 0 THEN 'manual_review' ELSE 'no_model_match' END AS status, CASE WHEN e = 1 THEN e_id END AS cand_id, CASE WHEN e > 0 THEN e ELSE s END AS n_candidates FROM k",
    "two_stage_lookup": f"""WITH p AS (SELECT p_partkey, p_brand AS make, p_name AS model, p_size AS year FROM part),
      a AS (SELECT DISTINCT upper(make) AS make, CASE WHEN year % 2 = 0 THEN replace(model, ' ', '-') ELSE upper(model) END AS model, year + CASE WHEN year > 45 THEN 5 ELSE 0 END AS year FROM p),
      l AS (SELECT lower(make) AS m, lower(model) AS l, year, count(*) AS n1, min(p_partkey) AS c1 FROM p GROUP BY 1, 2, 3),
      k AS (SELECT {Q._CANON('make')} AS m, {Q._JOINED('model')} AS l, year, count(*) AS n2, min(p_partkey) AS c2 FROM p GROUP BY 1, 2, 3)
      SELECT a.make, a.model, a.year, CASE WHEN n1 IS NOT NULL THEN 'literal' WHEN n2 IS NOT NULL THEN 'normalised' END AS stage, CASE WHEN coalesce(n1, n2) = 1 THEN coalesce(c1, c2) END AS cand_id, coalesce(n1, n2, 0) AS n
      FROM a LEFT JOIN l ON lower(a.make) = l.m AND lower(a.model) = l.l AND a.year = l.year LEFT JOIN k ON {Q._CANON('a.make')} = k.m AND {Q._JOINED('a.model')} = k.l AND a.year = k.year""",
    "evidence_states": Q._BASE + f""", m AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'rejected' WHEN c_acctbal < 1000 THEN 'manual_review' WHEN c_acctbal < 2000 THEN 'no_candidate' WHEN c_acctbal < 3000 THEN 'query_failed' ELSE 'auto_accepted' END AS status FROM customer WHERE c_acctbal <= 9000),
      r AS (SELECT customer.c_custkey, CASE WHEN customer.c_custkey IN (SELECT c_custkey FROM ev) THEN 'valid_with_recalls' ELSE 'valid_zero_recalls' END AS q FROM customer WHERE c_nationkey <> 0),
      g AS (SELECT coh.c_custkey, coh.y, count(*) FILTER ({Q._IN}) AS n FROM coh JOIN customer ON coh.c_custkey = customer.c_custkey LEFT JOIN ev ON coh.c_custkey = ev.c_custkey WHERE c_acctbal BETWEEN 3000 AND 9000 AND c_nationkey <> 0 AND y <= 1997 GROUP BY 1, 2),
      s AS (SELECT coh.c_custkey, coh.y, coalesce(status, 'not_in_matching_scope') AS st, coalesce(CASE WHEN status = 'query_failed' THEN status WHEN status IS NOT NULL THEN q END, 'not_recorded') AS q, DATE '{AS_OF}' >= make_date(coh.y + 3, 1, 1) AS ok, g.n, coalesce(status, '') IN ('auto_accepted', 'query_failed') AS known
        FROM coh LEFT JOIN m ON coh.c_custkey = m.c_custkey LEFT JOIN r ON coh.c_custkey = r.c_custkey LEFT JOIN g ON coh.c_custkey = g.c_custkey AND coh.y = g.y)
      SELECT {_ID} AS id, CASE WHEN known THEN 'confirmed_by_matching' WHEN st = 'manual_review' THEN 'requires_review' ELSE 'unresolved' END AS identity_status, CASE WHEN known THEN q ELSE 'not_linked_to_verified_identity' END AS query_status, CASE WHEN ok THEN 'complete' ELSE 'incomplete' END AS window_status,
        CASE WHEN n IS NOT NULL THEN 'included' WHEN known AND q IN ('not_recorded', 'query_failed') THEN q WHEN known AND NOT ok THEN 'incomplete_window' WHEN known THEN 'eligible_identity_not_in_gold' ELSE st END AS primary_reason, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 0 THEN 'zero_in_window' ELSE 'positive_in_window' END AS window_outcome FROM s""",
    "median_imputation": Q._BASE + f""", r AS (SELECT *, CASE WHEN prio <> 1 THEN o_totalprice END AS v FROM o), t AS (SELECT * FROM r WHERE y <= {LAST_TRAIN}), m0 AS (SELECT brand, c_mktsegment, median(v) AS a FROM t GROUP BY 1, 2), m1 AS (SELECT c_mktsegment, median(v) AS b FROM t GROUP BY 1)
      SELECT o_orderkey, round(coalesce(v, a, b, (SELECT median(v) FROM t), 0), 4) AS v_imputed, CASE WHEN v IS NOT NULL THEN 'observed' WHEN a IS NOT NULL THEN 'brand_segment' WHEN b IS NOT NULL THEN 'segment' ELSE 'all' END AS imputed_from FROM r LEFT JOIN m0 ON r.brand = m0.brand AND r.c_mktsegment = m0.c_mktsegment LEFT JOIN m1 ON r.c_mktsegment = m1.c_mktsegment""",
    "target_sensitivity": Q._BASE + f""", k AS (SELECT coh.c_custkey, y, """ + ", ".join(f"count(*) FILTER (cls = '{c}' AND {Q._IN}) AS {c}" for c in ("critical", "moderate", "low", "unclassified")) + f""" FROM coh LEFT JOIN ev ON coh.c_custkey = ev.c_custkey GROUP BY 1, 2),
      w(scenario, w1, w2, w3, w4) AS (VALUES {_WEIGHTS}),
      s AS (SELECT scenario, k.c_custkey, y, c_mktsegment, critical * w1 + moderate * w2 + low * w3 + unclassified * w4 AS score FROM k JOIN customer ON k.c_custkey = customer.c_custkey CROSS JOIN w),
      f AS (SELECT scenario, c_mktsegment, avg(score) AS m, stddev_pop(score) AS d FROM s WHERE y <= {LAST_TRAIN} GROUP BY 1, 2),
      g AS (SELECT scenario, avg(score) AS gm, stddev_pop(score) AS gd FROM s WHERE y <= {LAST_TRAIN} GROUP BY 1),
      i AS (SELECT s.scenario, c_custkey, y, round(greatest(0, least(100, 50 - 10 * (score - coalesce(m, gm)) / CASE WHEN d > 0 THEN d WHEN gd > 0 THEN gd ELSE 1 END)), 6) AS v FROM s JOIN g ON s.scenario = g.scenario LEFT JOIN f ON s.scenario = f.scenario AND s.c_mktsegment = f.c_mktsegment),
      j AS (SELECT i.scenario, part, i.v, b.v AS r, rank() OVER (PARTITION BY i.scenario, part ORDER BY i.v) + (count(*) OVER (PARTITION BY i.scenario, part, i.v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY i.scenario, part ORDER BY b.v) + (count(*) OVER (PARTITION BY i.scenario, part, b.v) - 1) / 2.0 AS rr
        FROM i JOIN i AS b ON b.scenario = 'documented' AND i.c_custkey = b.c_custkey AND i.y = b.y JOIN (VALUES ('all', 0), ('after_train', {LAST_TRAIN})) AS p(part, lo) ON i.y > lo)
      SELECT scenario, part, count(*) AS n, round(avg(abs(v - r)), 4) AS mean_shift, round(max(abs(v - r)), 4) AS max_shift, round(corr(rv, rr), 4) AS rank_corr, count(*) FILTER ((CASE WHEN v >= 70 THEN 2 WHEN v >= 45 THEN 1 ELSE 0 END) <> (CASE WHEN r >= 70 THEN 2 WHEN r >= 45 THEN 1 ELSE 0 END)) AS changed_band FROM j GROUP BY 1, 2""",
    "scope_sample": f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_name, p_partkey) AS r FROM part),
      b AS (SELECT p_partkey, p_size AS year, p_brand AS make, row_number() OVER (PARTITION BY p_size ORDER BY r, p_brand, p_name, p_partkey) AS position FROM a) SELECT * FROM b ORDER BY position, year LIMIT {SAMPLE}""",
    "table_fingerprint": f"""WITH a AS (SELECT sha256(concat_ws(chr(31), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)) AS h FROM lineitem) SELECT count(*) AS n, sha256(count(*)::varchar || '-' || {_LIMBS}) AS digest FROM a""",
}
