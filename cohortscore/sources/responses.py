"""Stored JSON responses of a recall service: checked, flattened to one row per campaign, with names in any case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscore.functions import text as T
from cohortscore.sources.readers import report_date

#: Names under which a service gives each field, in order of priority. Fixed values.
FIELDS = {
    "component": ("Component", "component"),
    "summary": ("Summary", "summary"),
    "consequence": ("Consequence", "consequence"),
    "remedy": ("Remedy", "remedy"),
    "campaign": ("NHTSACampaignNumber", "CampaignNumber", "campaign_number"),
    "reported": ("ReportReceivedDate", "report_received_date", "ReportDate"),
}
DESCRIBES = ("component", "summary", "consequence", "remedy")


def field(entries: Column, names: Sequence[str]) -> Column:
    """The first value under one of the names: each name as it is written, then in any case; null values count as absent.

    `entries` is an array of `key, value`, as a JSON object has them; of keys that differ only in case the first with a value counts.
    """
    return F.coalesce(*[found for name in names for found in (_exact(entries, name), _folded(entries, name))])


def _exact(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: (e["key"] == name) & e["value"].isNotNull()), F.lit(0))["value"]


def _folded(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: (F.lower(e["key"]) == name.lower()) & e["value"].isNotNull()), F.lit(0))["value"]


def checked_responses(responses: DataFrame, payload: str) -> DataFrame:
    """`responses` with `results`, an array of the result objects as JSON texts, and `problem`: why a payload says nothing, or null.

    A payload is an object whose `results` (else `Results`) is a list of objects and whose `Count` (else `count`), if
    any, is their number. Anything else is no answer, so never a zero: `not_an_object`, `no_results`, `bad_result`,
    `wrong_count`. Texts that are no JSON, and nulls, are `not_an_object`.
    """
    v = F.try_parse_json(F.col(f"`{payload}`"))
    own = F.from_json(F.col(f"`{payload}`"), "map<string,string>")
    out = responses.withColumns({"_v": v, "_keys": F.map_keys(own)})
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    out = out.withColumn("_ok", is_object)
    named = lambda a, b: F.when(F.array_contains("_keys", a), F.try_variant_get("_v", f"$.{a}", "variant")).otherwise(F.try_variant_get("_v", f"$.{b}", "variant"))
    out = out.withColumns({"_list": F.when(F.col("_ok"), named("results", "Results")), "_count": F.when(F.col("_ok"), named("Count", "count"))})
    items = F.try_variant_get("_list", "$", "array<variant>")
    out = out.withColumn("_items", F.when(F.schema_of_variant("_list").startswith("ARRAY"), items))
    holes = F.exists("_items", lambda x: ~F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    declared = F.try_variant_get("_count", "$", "string")
    wrong = declared.isNotNull() & ~F.coalesce(F.trim(declared).try_cast("decimal(38,6)").cast("long") == F.size("_items"), F.lit(False))
    problem = F.when(~F.col("_ok"), "not_an_object").when(F.col("_items").isNull(), "no_results").when(holes, "bad_result").when(wrong, "wrong_count")
    out = out.withColumn("problem", problem).withColumn("results", F.when(F.col("problem").isNull(), F.transform("_items", lambda x: F.to_json(x))))
    return out.drop("_v", "_keys", "_ok", "_list", "_count", "_items")


def campaign_rows(responses: DataFrame, payload: str, make: str, model: str, year: str, identity: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row for each campaign of the good responses, the responses with a `problem`).

    A row has the request (`make, model, year`), `vehicle_id` (that of the response, else made of the request), the
    keys of make and model, every field of `FIELDS`, `description` (the texts of `DESCRIBES` that are not blank,
    trimmed, joined by a space) and `report_date`: day first, then ISO or eight digits, else null.
    """
    checked = checked_responses(responses, payload)
    asked = {"make": F.trim(F.col(make).cast("string")), "model": F.trim(F.col(model).cast("string")), "year": F.col(year).cast("int")}
    made = T.entity_id(asked["make"], asked["model"], asked["year"])
    rows = checked.filter("problem IS NULL").select(
        *[c.alias(n) for n, c in asked.items()], (F.coalesce(F.col(identity), made) if identity else made).alias("vehicle_id"),
        T.comparison_make(asked["make"]).alias("make_key"), T.comparison_model(asked["model"]).alias("model_key"), F.explode("results").alias("_r"),
    )
    rows = rows.withColumn("_e", F.map_entries(F.from_json("_r", "map<string,string>")))
    rows = rows.select("*", *[field(F.col("_e"), names).alias(n) for n, names in FIELDS.items()]).drop("_r", "_e")
    parts = F.filter(F.array(*[F.regexp_replace(F.col(c), "^\\s+|\\s+$", "") for c in DESCRIBES]), lambda x: x.isNotNull() & (x != ""))
    return rows.withColumns({"description": F.array_join(parts, " "), "report_date": report_date(F.col("reported"))}), checked.filter("problem IS NOT NULL").drop("results")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """`file, payload`: stored responses, one JSON text a file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))
