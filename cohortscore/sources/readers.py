"""Readers of the source files: every field as text first, checked, then cast; bad rows are returned, never dropped unseen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscore.sources.rows import numbered

#: Power of a horsepower in metric horsepowers. Fixed value.
HP_IN_CV = 745.6999 / 735.4988


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str], encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header: the named columns, renamed, as trimmed texts; blank ones are null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding=encoding, quote='"', escape='"')
    return raw.select(*[F.nullif(F.trim(F.regexp_replace(F.col(f"`{old}`"), "\\s+", " ")), F.lit("")).alias(new) for old, new in columns.items()])


def read_fields(spark: SparkSession, path: str, names: Sequence[str], encoding: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame]:
    """Tab-separated text without quotes: rows with exactly the named fields, trimmed, and the `file, line, text` of all others.

    One empty field at the end of a line is no field. `line` is the number of the line in its file, blank ones
    counted; blank lines are no rows. Good rows carry `file` and `line` too.
    """
    raw = spark.read.text(path)
    lines = numbered(raw.select("value", F.col("_metadata.file_path").alias("file"), "_metadata"), "line", per_file=True)
    # The text source passes bytes on as they are, so any encoding can be read from them.
    lines = lines.withColumn("text", F.decode(F.col("value").cast("binary"), encoding)).filter("text <> ''")
    parts = F.split("text", "\t", -1)
    fields = F.when((F.size(parts) == len(names) + 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, len(names))).otherwise(parts)
    lines = lines.withColumn("f", fields)
    good = lines.filter(F.size("f") == len(names)).select(*[F.trim(F.col("f")[i]).alias(n) for i, n in enumerate(names)], "file", "line")
    return good, lines.filter(F.size("f") != len(names)).select("file", "line", "text")


def read_payloads(spark: SparkSession, path: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Stored JSON responses, one a file: `file` and the fields of each result, and the files whose count is not their number of results.

    A response without results gives no row, which says nothing until its file is known to be good.
    """
    item = "struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">"
    raw = spark.read.schema(f"Count int, results array<{item}>, _bad string").json(path, multiLine=True, columnNameOfCorruptRecord="_bad")
    raw = raw.select(F.col("_metadata.file_path").alias("file"), "Count", "results", "_bad")
    holes = F.exists("results", lambda r: r.isNull())
    ok = F.col("_bad").isNull() & F.coalesce((F.size("results") == F.col("Count")) & F.col("results").isNotNull() & ~holes, F.lit(False))
    return raw.filter(ok).select("file", F.inline("results")), raw.filter(~ok).select("file")


def read_inventory(spark: SparkSession, path: str, row_tag: str, fields: Sequence[str]) -> DataFrame:
    """The named child elements of each `row_tag` element of an XML file, as trimmed texts, blank where absent.

    A file with a document type declaration, or an element that is no XML, is refused.
    """
    declared = spark.read.text(path).filter(F.upper("value").contains("<!DOCTYPE") | F.upper("value").contains("<!ENTITY"))
    if not declared.isEmpty():
        raise ValueError("the inventory declares a document type")
    schema = ", ".join(f"`{f}` string" for f in fields) + ", `_bad` string"
    raw = spark.read.format("xml").option("rowTag", row_tag).option("columnNameOfCorruptRecord", "_bad").schema(schema).load(path)
    bad = F.when(F.col("_bad").isNotNull(), F.raise_error(F.lit("an element of the inventory is no XML"))).otherwise(F.lit(""))
    return raw.select(*[F.concat(F.coalesce(F.trim(F.col(f"`{f}`")), F.lit("")), bad).alias(f) for f in fields])


def inventory_problems(rows: DataFrame, key: str = "id", make: str = "make", model: str = "model", year: str = "year") -> DataFrame:
    """`rule, key, detail` of the rows of an inventory of texts that break its rules: `blank_identity`, `bad_year`, `duplicate_id`.

    A year is a whole number from 1900 to 2100. Each row is named once a rule; an id given twice is one row. An empty
    inventory is `empty`.
    """
    names = [key, make, model, year]
    text = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names}
    blank = [F.when(text[c] == "", c) for c in names]
    value, _ = checked_number(text[year], 1900, 2100, whole=True)
    of = rows.select(text[key].alias("key"), F.array_join(F.array_compact(F.array(*blank)), ",").alias("blank"), F.when(text[year] != "", value.isNull()).alias("bad"), text[year].alias("year"))
    found = of.select("key", F.explode(F.array_compact(F.array(
        F.when(F.col("blank") != "", F.struct(F.lit("blank_identity").alias("rule"), F.col("blank").alias("detail"))),
        F.when(F.col("bad"), F.struct(F.lit("bad_year").alias("rule"), F.col("year").alias("detail"))),
    ))).alias("p")).select("p.rule", "key", "p.detail")
    twice = of.filter("key <> ''").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("rule"), "key", F.col("n").cast("string").alias("detail"))
    none = rows.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("empty").alias("rule"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))
    return found.unionByName(twice).unionByName(none)


def inventory_rows(rows: DataFrame, min_year: int = 1995, cylinders: str = "cylinders", year: str = "year") -> DataFrame:
    """Inventory rows of the years asked for, the year as a number and cylinders as a whole number from 0 to 32 with their state.

    `cylinders_original` is the text. Power, identity and recalls are not known from an inventory, and no row of it is
    eligible for a prediction; the columns say so. Check `inventory_problems` first: a row without a year goes here.
    """
    number, _ = checked_number(F.trim(F.col(year).cast("string")), 1900, 2100, whole=True)
    value, state = checked_number(F.col(cylinders), 0, 32, whole=True)
    typed = rows.withColumns({"cylinders_original": F.coalesce(F.col(cylinders), F.lit("")), year: number.cast("int"), cylinders: value.cast("int"), "cylinders_status": state})
    said = {"power_cv": F.lit(None).cast("double"), "power_status": F.lit("not_provided_by_source"), "identity_status": F.lit("pending_resolution"), "recall_status": F.lit("not_queried"), "prediction_eligible": F.lit(False)}
    return typed.filter(F.col(year) >= min_year).withColumns(said)


def checked_number(c: Column, least: float, most: float | None = None, whole: bool = False) -> tuple[Column, Column]:
    """A text as a finite number in bounds, else null; and `missing`, `invalid` or `observed`."""
    x = c.try_cast("double")
    ok = ~F.isnan(x) & (x >= least) & (x <= (most if most is not None else 1.7e308))
    ok = F.coalesce(ok & (x == F.floor(x)) if whole else ok, F.lit(False))
    return F.when(ok, x), F.when(F.coalesce(F.trim(c), F.lit("")) == "", "missing").when(ok, "observed").otherwise("invalid")


def first_known(aliases: Sequence[tuple[Column, str, str, float]]) -> Column:
    """The first alias, in order of priority, that holds a number: `(value, original, column, unit)`, value times its factor."""
    typed = [(c.try_cast("double"), name, unit, factor) for c, name, unit, factor in aliases]
    options = [F.when(x.isNotNull() & ~F.isnan(x), F.struct((x * factor).alias("value"), x.alias("original"), F.lit(name).alias("column"), F.lit(unit).alias("unit"))) for x, name, unit, factor in typed]
    return F.coalesce(*options)


def report_date(c: Column) -> Column:
    """A date written day first, or in ISO form, or as eight digits; else null."""
    forms = ("dd/MM/yyyy", "yyyy-MM-dd", "yyyyMMdd")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in forms])
