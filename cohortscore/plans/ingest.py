"""Queries of source rows, stored responses and the inventory, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortscore.plans import queries as Q
from cohortscore.sources import readers as R
from cohortscore.sources import responses as S
from cohortscore.sources.rows import numbered


def row_numbers(spark, d):
    return numbered(Q._t(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "row")


def _responses(spark, d):
    """A response for each part: two spellings of the names, an empty list, and three that say nothing."""
    key = F.col("p_partkey")
    part = Q._t(spark, d, "part")
    number = F.concat(key.cast("string"), F.lit("V"))
    day = F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), key.cast("int") % 3000), "dd/MM/yyyy")
    first = F.struct(number.alias("NHTSACampaignNumber"), day.alias("ReportReceivedDate"), F.concat(F.lit(" "), "p_type").alias("Component"), F.col("p_name").alias("Summary"), F.lit("").alias("Remedy"))
    other = F.struct(F.concat(number, F.lit("2")).alias("CAMPAIGN_NUMBER"), F.lit("2019-02-03").alias("reportdate"), F.col("p_brand").alias("consequence"))
    two = F.to_json(F.struct(F.lit(2).alias("Count"), F.array(F.to_json(first), F.to_json(other)).alias("results")))
    plain = F.replace(F.replace(F.replace(two, F.lit('"{'), F.lit("{")), F.lit('}"'), F.lit("}")), F.lit('\\"'), F.lit('"'))
    one = F.concat(F.lit('{"count": "1", "Results": ['), F.to_json(other), F.lit("]}"))
    payload = F.when(key % 6 == 0, plain).when(key % 6 == 1, one).when(key % 6 == 2, '{"results": []}').when(key % 6 == 3, '{"Count": 3, "results": [{}]}').when(key % 6 == 4, '{"error": "unavailable"}').otherwise(F.substring(plain, 1, 40))
    return part.select("p_partkey", F.col("p_brand").alias("make"), F.col("p_name").alias("model"), (F.col("p_size") + 1990).alias("year"), payload.alias("payload"))


def response_campaigns(spark, d):
    rows, _ = S.campaign_rows(_responses(spark, d), "payload", "make", "model", "year")
    return rows.select("vehicle_id", "year", "campaign", F.col("report_date").cast("string").alias("report_date"), "component", "consequence", "description")


def response_problems(spark, d):
    return S.campaign_rows(_responses(spark, d), "payload", "make", "model", "year")[1].select("p_partkey", "problem")


def _inventory(spark, d):
    """The parts as XML elements, with blank makes, bad years, ids given twice and odd cylinders, read again."""
    key = F.col("p_partkey")
    fields = F.struct(
        (key - F.when(key % 19 == 0, 1).otherwise(0)).cast("string").alias("id"), F.when(key % 17 == 0, "").otherwise(F.col("p_brand")).alias("make"), F.col("p_name").alias("model"),
        F.when(key % 11 == 0, "n/a").when(key % 13 == 0, "1990.5").otherwise((F.col("p_size") + 1980).cast("string")).alias("year"),
        F.when(key % 4 == 0, "").when(key % 4 == 1, "bad").when(key % 4 == 2, "-1").otherwise((F.col("p_size") % 12).cast("string")).alias("cylinders"),
    )
    element = F.to_xml(fields, {"rowTag": "vehicle"})
    return Q._t(spark, d, "part").select(F.from_xml(element, "id string, make string, model string, year string, cylinders string", {"rowTag": "vehicle"}).alias("v")).select("v.*")


def inventory_rows(spark, d):
    return R.inventory_rows(_inventory(spark, d)).select("id", "make", "year", "cylinders", "cylinders_original", "cylinders_status", "power_status", "prediction_eligible")


def inventory_problems(spark, d):
    return R.inventory_problems(_inventory(spark, d))


NAMES = (row_numbers, response_campaigns, response_problems, inventory_rows, inventory_problems)
QUERIES = {f.__name__: f for f in NAMES}

_ID = "upper(replace(p_brand, '#', '_') || '_' || replace(p_name, ' ', '_') || '_' || (p_size + 1990))"
_V = """WITH v AS (SELECT (p_partkey - (p_partkey % 19 = 0)::int)::varchar AS id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS make, CASE WHEN p_partkey % 11 = 0 THEN 'n/a' WHEN p_partkey % 13 = 0 THEN '1990.5' ELSE (p_size + 1980)::varchar END AS year,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'bad' WHEN 2 THEN '-1' ELSE (p_size % 12)::varchar END AS cylinders FROM part) """
ORACLE = {
    "row_numbers": "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER () AS row FROM lineitem",
    "response_campaigns": f"""SELECT {_ID} AS vehicle_id, p_size + 1990 AS year, p_partkey || 'V' AS campaign, (DATE '2015-01-01' + (p_partkey % 3000)::int)::varchar AS report_date, ' ' || p_type AS component, NULL AS consequence, trim(p_type) || ' ' || p_name AS description FROM part WHERE p_partkey % 6 = 0
      UNION ALL SELECT {_ID}, p_size + 1990, p_partkey || 'V2', '2019-02-03', NULL, p_brand, p_brand FROM part WHERE p_partkey % 6 < 2""",
    "response_problems": "SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN 'wrong_count' WHEN 4 THEN 'no_results' ELSE 'not_an_object' END AS problem FROM part WHERE p_partkey % 6 > 2",
    "inventory_rows": _V + """SELECT id, coalesce(make, '') AS make, year::int AS year, CASE WHEN try_cast(cylinders AS int) BETWEEN 0 AND 32 THEN cylinders::int END AS cylinders, cylinders AS cylinders_original,
      CASE WHEN cylinders = '' THEN 'missing' WHEN try_cast(cylinders AS int) BETWEEN 0 AND 32 THEN 'observed' ELSE 'invalid' END AS cylinders_status, 'not_provided_by_source' AS power_status, false AS prediction_eligible FROM v WHERE try_cast(year AS int) >= 1995 AND year NOT LIKE '%.%'""",
    "inventory_problems": _V + """SELECT 'blank_identity' AS rule, id AS key, 'make' AS detail FROM v WHERE make IS NULL UNION ALL SELECT 'bad_year', id, year FROM v WHERE year IN ('n/a', '1990.5') UNION ALL SELECT 'duplicate_id', id, count(*)::varchar FROM v GROUP BY id HAVING count(*) > 1""",
}
