"""Queries of registers, catalogs, identities and summaries, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortscore.functions import text as T
from cohortscore.plans import queries as Q
from cohortscore.sources import catalogs as S


def _register(spark, d):
    part = Q._t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("make"), "p_name")
    model = F.when(F.col("l_suppkey") % 10 != 0, F.col("p_name"))
    return Q._t(spark, d, "lineitem").join(part, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "make", model.alias("model"), F.year("l_shipdate").alias("year"), F.when(F.col("l_returnflag") == "R", "E").otherwise("V").alias("kind"))


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def bulk_vehicles(spark, d):
    return S.bulk_index(_register(spark, d), "V", 1995, 1999, ORDER)[1]


def bulk_metadata(spark, d):
    return S.bulk_index(_register(spark, d), "V", 1995, 1999, ORDER)[2]


def _named(spark, d):
    return Q._t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("make"), F.col("p_name").alias("model"), F.col("p_size").alias("year"), "p_type")


def catalog_union(spark, d):
    rows = _named(spark, d)
    return S.catalog_union(rows.filter("p_partkey % 3 = 0"), rows.filter("p_partkey % 3 <> 0").withColumn("model", F.upper("model")), ["p_partkey"]).select("p_partkey", "make", "model", "year", "catalog_source")


def catalog_candidates(spark, d):
    rows = _named(spark, d).withColumns({"asked_make": F.upper("make"), "asked_year": F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(F.col("year"))})
    return S.catalog_candidates(rows, F.col("asked_make"), F.col("asked_year"), ["p_partkey"]).select("p_partkey", "make", "model", "year")


def inventory_coverage(spark, d):
    rows = _named(spark, d).withColumn("v", F.when(F.col("p_partkey") % 6 != 0, F.col("year")))
    return S.inventory_coverage(rows, "make", "model", "year", "p_type", "v")


def test_rows(spark, d):
    rows = Q._t(spark, d, "lineitem").withColumn("power", F.when(F.col("l_linenumber") == 1, F.lit("bad")).when(F.col("l_linenumber") == 2, F.lit("-3")).when(F.col("l_linenumber") > 2, F.col("l_quantity").cast("string")))
    out = S.normalised_tests(rows.withColumn("y", F.lit(2026)), {"l_orderkey": "test", "l_linenumber": "row", "l_partkey": "configuration", "power": "power_hp", "y": "model_year"}, ["configuration"], "power_hp", "model_year")
    return out.groupBy("power_hp_status").agg(F.count("*").alias("n"), F.sum("power_hp").alias("total"))


def test_coverage(spark, d):
    return S.test_coverage(Q.config_conflicts(spark, d), "status", "n_rows")


def _responses(spark, d):
    return Q._t(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") < 20, F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 1000)).cast("int")).alias("n_results"), F.when(F.col("c_custkey") % 2 == 0, "recall_catalog").otherwise("independent").alias("catalog_source"), (F.col("c_nationkey") == 3).alias("failed"))


def query_status(spark, d):
    one = S.query_states(_responses(spark, d)).select("c_custkey", F.col("query_status"))
    return one.join(S.query_states(_responses(spark, d), direct=True).select("c_custkey", F.col("query_status").alias("direct_status")), "c_custkey")


def request_plan(spark, d):
    rows = _named(spark, d).withColumn("model", F.when(F.col("p_partkey") % 7 == 0, F.lit(" ")).otherwise(F.regexp_replace("model", " ", "-")))
    return S.request_plan(rows, ["p_partkey"])


def make_year_plan(spark, d):
    return S.request_plan(_named(spark, d), ["p_partkey"], by_model=False)


def run_manifest(spark, d):
    return S.run_manifest(Q._t(spark, d, "customer").select(F.when(F.col("c_acctbal") < 3000, "rejected").when(F.col("c_acctbal") < 4000, "manual_review").otherwise("auto_accepted").alias("status")))


def _identities(spark, d):
    rows = _named(spark, d)
    source = rows.filter("p_partkey % 2 = 0").withColumn("model", F.when(F.col("p_partkey") % 3 == 0, F.upper("model")).otherwise(F.col("model")))
    return S.independent_identities(rows.filter("p_partkey % 2 = 1"), source.withColumnRenamed("p_partkey", "source_id"), "p_partkey", "source_id")


def independent_identity(spark, d):
    return _identities(spark, d).select("p_partkey", "identity_status", "n_spellings", F.array_join("source_ids", ",").alias("source_ids"), "query_model", "recall_query_status", "label_eligible")


def identity_responses(spark, d):
    responses = Q._t(spark, d, "part").filter("p_partkey % 5 <> 0").select("p_partkey", F.greatest(F.lit(0), F.col("p_size") - 20).alias("n_results"), (F.col("p_size") == 50).alias("failed"))
    return S.identity_states(_identities(spark, d), responses, "p_partkey").select("p_partkey", "recall_query_status")


def exclusion_counts(spark, d):
    gold = _named(spark, d).filter("year < 20").select("p_partkey")
    return _identities(spark, d).join(gold, "p_partkey", "left_anti").groupBy("identity_status").agg(F.count("*").alias("n"))


def resolution_summary(spark, d):
    rows = _identities(spark, d).join(_named(spark, d), "p_partkey")
    return S.status_counts(rows, "identity_status", [[], ["make"], ["year"]], "model")


def cohort_trend(spark, d):
    index = Q.segment_index(spark, d).join(Q._orders(spark, d).select("o_orderkey", "y", "brand"), "o_orderkey")
    return index.groupingSets([[F.col("y")], [F.col("brand"), F.col("y")]], F.col("brand"), F.col("y")).agg(F.count("*").alias("n"), F.round(F.avg("index_100") + 1e-7, 3).alias("mean_index"))  # means of rounded values may lie halfway: the shift is on both sides


def corr_matrix(spark, d):
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    rows = Q._t(spark, d, "lineitem").withColumn("l_tax", F.when(F.col("l_returnflag") != "R", F.col("l_tax")))
    one = rows.agg(*[F.corr(a, b).alias(f"{a}:{b}") for a, b in pairs], *[F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in numbers])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{a}:{b}"), 5).alias("r"), (F.col(f"null:{a}") + F.col(f"null:{b}")).alias("n_null")) for a, b in pairs])))


def status_summary(spark, d):
    return Q._orders(spark, d).agg(F.count("*").alias("n"), F.min("y").alias("first"), F.max("y").alias("last"), F.bool_or(F.col("prio") == 1).alias("any_urgent"), F.bool_and(F.col("o_totalprice") > 0).alias("all_priced"))


def last_entries(spark, d):
    at = Window.partitionBy("c_custkey").orderBy(F.desc("y"), F.desc("brand"))
    distinct = Q._orders(spark, d).select("c_custkey", "y", "brand").distinct()
    return distinct.withColumn("place", F.row_number().over(at)).filter("place <= 2")


def category_keys(spark, d):
    raw = F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" É "), F.upper("source")))
    docs = Q._t(spark, d, "documents")
    return docs.select("doc_id", T.display_or_key(raw).alias("data_key"), T.model_category(raw).alias("model_key"), T.literal_key(raw).alias("literal"), T.flag(F.when(F.col("doc_id") % 2 == 0, F.lit(" SI ")).otherwise(F.col("lang"))).alias("is_flag"), T.first_text(F.when(F.col("doc_id") % 4 == 0, F.lit(" ")).otherwise(F.lit("a  b")), F.col("lang")).alias("first"))


def request_digests(spark, d):
    return _named(spark, d).select("p_partkey", T.request_digest(F.upper("make"), F.col("model"), F.col("year")).alias("digest"), T.description_of(F.col("make"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), F.col("model")).alias("description"))


def suggestion_lists(spark, d):
    rows = _named(spark, d)
    asked, pool = rows.filter("p_partkey % 2 = 1"), rows.filter("p_partkey % 2 = 0").select("make", "year", F.col("p_partkey").alias("cand_id"))
    remainder = F.when(F.col("least_id") >= 0, F.col("p_partkey") % 101).otherwise(F.col("p_partkey"))  # where no sum is negative, the score reads no more of a key
    asked = asked.crossJoin(pool.agg(F.min("cand_id").alias("least_id"))).select("p_partkey", "make", "year", remainder.alias("read"))  # one row on the right
    text = lambda listed: F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["s"].cast("string"), s["id"].cast("string"))), ",")
    return S.suggestions(asked, pool, ["make", "year"], "p_partkey", "read", "cand_id", lambda read, cand: (read + cand) % 101, 50, text)


NAMES = (bulk_vehicles, bulk_metadata, catalog_union, catalog_candidates, inventory_coverage, test_rows, test_coverage, query_status, request_plan, make_year_plan, run_manifest, independent_identity, identity_responses, exclusion_counts, resolution_summary, cohort_trend, corr_matrix, status_summary, last_entries, category_keys, request_digests, suggestion_lists)
QUERIES = {f.__name__: f for f in NAMES}

_ID = lambda *cs: " || '_' || ".join(f"upper(replace({Q._CANON(c)}, ' ', '_'))" for c in cs)
_REG = f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS make, CASE WHEN l_suppkey % 10 <> 0 THEN p_name END AS model, year(l_shipdate) AS year, CASE WHEN l_returnflag = 'R' THEN 'E' ELSE 'V' END AS kind FROM lineitem JOIN part ON l_partkey = p_partkey),
  k AS (SELECT *, {_ID('make', "coalesce(model, '')", 'year::varchar')} AS vehicle_id FROM r WHERE kind = 'V' AND year BETWEEN 1995 AND 1999) """
_P = "WITH p AS (SELECT p_partkey, p_brand AS make, p_name AS model, p_size AS year, p_type FROM part)"
_IDENT = _P + f""", s AS (SELECT p_partkey AS sid, make, year, CASE WHEN p_partkey % 3 = 0 THEN upper(model) ELSE model END AS model FROM p WHERE p_partkey % 2 = 0),
  g AS (SELECT {Q._CANON('make')} AS m, {Q._JOINED('model')} AS l, year, count(DISTINCT make || '/' || model) AS n, min(model) AS one, array_to_string(list_sort(list(DISTINCT sid::varchar)), ',') AS ids FROM s GROUP BY 1, 2, 3),
  i AS (SELECT p.*, CASE WHEN n IS NULL THEN 'absent_from_independent_inventory' WHEN n = 1 THEN 'exact_independent_identity' ELSE 'ambiguous_independent_identity' END AS identity_status, coalesce(n, 0) AS n_spellings, ids, one FROM p LEFT JOIN g ON {Q._CANON('p.make')} = m AND {Q._JOINED('p.model')} = l AND p.year = g.year WHERE p_partkey % 2 = 1) """
_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "tax", "l_linenumber")
ORACLE = {
    "bulk_vehicles": _REG + "SELECT vehicle_id, make, model, year, true AS verified FROM k QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1",
    "bulk_metadata": _REG + f"SELECT (SELECT count(*) FROM r) AS source_rows, count(*) AS kept_rows, count(DISTINCT vehicle_id) AS vehicles, count(DISTINCT {Q._CANON('make')}) AS makes FROM k",
    "catalog_union": _P + f"SELECT p_partkey, make, CASE WHEN p_partkey % 3 = 0 THEN model ELSE upper(model) END AS model, year, CASE WHEN p_partkey % 3 = 0 THEN 'recall_catalog' ELSE 'independent' END AS catalog_source FROM p QUALIFY row_number() OVER (PARTITION BY {Q._CANON('make')}, {Q._JOINED('model')}, year ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END, p_partkey) = 1",
    "catalog_candidates": _P + f"SELECT p_partkey, make, model, year FROM p WHERE p_partkey % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY {Q._CANON('make')}, {Q._JOINED('model')}, year ORDER BY p_partkey) = 1",
    "inventory_coverage": _P + "SELECT year, p_type, make, count(*) AS variants, count(DISTINCT make || '/' || model || '/' || year) AS names, count(*) FILTER (p_partkey % 6 = 0) AS n_missing, grouping(year) * 4 + grouping(p_type) * 2 + grouping(make) AS level FROM p GROUP BY GROUPING SETS ((), (year), (p_type), (make))",
    "test_rows": "SELECT CASE WHEN l_linenumber <= 2 THEN 'invalid' ELSE 'observed' END AS power_hp_status, count(*) AS n, sum(CASE WHEN l_linenumber > 2 THEN l_quantity END) AS total FROM lineitem GROUP BY 1",
    "test_coverage": f"WITH c AS ({Q.ORACLE['config_conflicts']}) SELECT count(*) AS configurations, sum(n_rows)::bigint AS n_tests, count(*) FILTER (status = 'single_value') AS single_value, count(*) FILTER (status = 'conflicting') AS conflicting, count(*) FILTER (status = 'missing') AS missing FROM c",
    "query_status": "WITH r AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 OR c_nationkey >= 20 THEN NULL ELSE greatest(0, floor(c_acctbal / 1000)) END AS n FROM customer) SELECT c_custkey, CASE WHEN n IS NULL THEN 'query_failed' WHEN n > 0 THEN 'valid_with_recalls' WHEN c_custkey % 2 = 0 THEN 'valid_zero_recalls' ELSE 'unverified_zero_result' END AS query_status, CASE WHEN n IS NULL THEN 'query_failed' WHEN n > 0 THEN 'unverified_with_recalls' ELSE 'unverified_zero_result' END AS direct_status FROM r",
    "request_plan": _P + f"SELECT make, replace(model, ' ', '-') AS model, year FROM p WHERE p_partkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY {Q._CANON('make')}, {Q._JOINED('model')}, year ORDER BY p_partkey) = 1",
    "make_year_plan": _P + f"SELECT make, year FROM p QUALIFY row_number() OVER (PARTITION BY {Q._CANON('make')}, year ORDER BY p_partkey) = 1",
    "run_manifest": "WITH m AS (SELECT CASE WHEN c_acctbal < 3000 THEN 'rejected' WHEN c_acctbal < 4000 THEN 'manual_review' ELSE 'auto_accepted' END AS status FROM customer), g AS (SELECT status, count(*) AS n FROM m GROUP BY 1) SELECT sum(n)::bigint AS n, round(sum(CASE WHEN status = 'auto_accepted' THEN 0 ELSE n END) / sum(n), 6) AS loss_rate, CASE WHEN round(sum(CASE WHEN status = 'auto_accepted' THEN 0 ELSE n END) / sum(n), 6) > 0.4 THEN 'loss_above_alarm' END AS warning, array_to_string(list_sort(list(status || '=' || n)), ';') AS statuses FROM g",
    "independent_identity": _IDENT + "SELECT p_partkey, identity_status, n_spellings, coalesce(ids, '') AS source_ids, CASE WHEN n_spellings = 1 THEN one END AS query_model, 'not_queried' AS recall_query_status, false AS label_eligible FROM i",
    "identity_responses": _IDENT + "SELECT i.p_partkey, CASE WHEN identity_status <> 'exact_independent_identity' THEN 'not_queried' WHEN i.p_partkey % 5 = 0 OR year = 50 THEN 'query_failed' WHEN year > 20 THEN 'campaigns_returned_review_required' ELSE 'empty_response_identity_only' END AS recall_query_status FROM i",
    "exclusion_counts": _IDENT + "SELECT identity_status, count(*) AS n FROM i WHERE year >= 20 GROUP BY 1",
    "resolution_summary": _IDENT + "SELECT identity_status, make, year, count(*) AS n, count(DISTINCT model) AS n_distinct FROM i GROUP BY GROUPING SETS ((identity_status), (identity_status, make), (identity_status, year))",
    "cohort_trend": Q._BASE + ", s AS (SELECT c_mktsegment, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM o WHERE y <= 1998 GROUP BY 1), x AS (SELECT brand, y, round(greatest(0, least(100, 50 - 10 * (o_totalprice - m) / d)), 4) AS v FROM o JOIN s USING (c_mktsegment)) SELECT brand, y, count(*) AS n, round(avg(v) + 1e-7, 3) AS mean_index FROM x GROUP BY GROUPING SETS ((y), (brand, y))",
    "corr_matrix": "WITH t AS (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS tax FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a.replace('tax', 'l_tax')}' AS a, '{b.replace('tax', 'l_tax')}' AS b, round(corr({a}, {b}), 5) AS r, count(*) FILTER ({a} IS NULL) + count(*) FILTER ({b} IS NULL) AS n_null FROM t" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]),
    "status_summary": Q._BASE + "SELECT count(*) AS n, min(y) AS first, max(y) AS last, bool_or(prio = 1) AS any_urgent, bool_and(o_totalprice > 0) AS all_priced FROM o",
    "last_entries": Q._BASE + "SELECT c_custkey, y, brand, row_number() OVER (PARTITION BY c_custkey ORDER BY y DESC, brand DESC) AS place FROM (SELECT DISTINCT c_custkey, y, brand FROM o) QUALIFY place <= 2",
    "category_keys": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'sin_categoria' ELSE trim('e ' || trim(regexp_replace(lower(strip_accents(source)), '[^a-z0-9]+', ' ', 'g'))) END AS data_key, CASE WHEN doc_id % 4 = 0 THEN 'sin_categoria' ELSE 'é ' || lower(source) END AS model_key, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'é ' || lower(source) END AS literal, doc_id % 2 = 0 OR lang IN ('true', '1', 'yes', 'si', 'sí') AS is_flag, CASE WHEN doc_id % 4 = 0 THEN lang ELSE 'a b' END AS first FROM documents",
    "request_digests": "SELECT p_partkey, substr(sha256(lower(p_brand) || chr(31) || lower(p_name) || chr(31) || p_size), 1, 12) AS digest, p_brand || ' ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END || ' ' || p_name AS description FROM part",
    "suggestion_lists": _P + ", j AS (SELECT a.p_partkey, b.p_partkey AS cand_id, (a.p_partkey + b.p_partkey) % 101 AS score FROM p a JOIN p b ON a.make = b.make AND a.year = b.year WHERE a.p_partkey % 2 = 1 AND b.p_partkey % 2 = 0) SELECT p_partkey, string_agg(score || ':' || cand_id, ',' ORDER BY score DESC, cand_id) AS suggestions FROM j WHERE score >= 50 GROUP BY 1",
}
