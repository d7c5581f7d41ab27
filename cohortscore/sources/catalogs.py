"""Official registers and catalogs as tables: bulk index, unions, inventory coverage, test rows, query states, request plans, sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscore.functions import text as T
from cohortscore.operators.matching import enforce, unverified
from cohortscore.sources.readers import checked_number

#: Tasks over which the rows of one block may go.
SPREAD = 8


def keep_first(rows: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in source order; all its columns stay together."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def bulk_index(register: DataFrame, kind: str, first: int, last: int, order: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, vehicles, metadata) of a register (`make, model, year, kind`): rows of the kind and years with keys and id;
    distinct vehicles in their first spelling, all of an official source; and one row of counts."""
    model = F.nullif(T.comparison_model(F.col("model")), F.lit(""))
    kept = register.filter((F.col("kind") == kind) & F.col("year").between(first, last))
    kept = kept.withColumns({"make_key": T.comparison_make(F.col("make")), "model_key": model, "vehicle_id": T.entity_id(F.col("make"), F.col("model"), F.col("year"))})
    vehicles = keep_first(kept, ["vehicle_id"], order).select("vehicle_id", "make", "model", "year", F.lit(True).alias("verified"))
    metadata = register.agg(F.count("*").alias("source_rows"), F.count_if((F.col("kind") == kind) & F.col("year").between(first, last)).alias("kept_rows"))
    counts = kept.agg(F.count_distinct("vehicle_id").alias("vehicles"), F.count_distinct("make_key").alias("makes"))
    return kept, vehicles, metadata.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row on each side


def catalog_candidates(rows: DataFrame, make: Column, year: Column, order: Sequence[str]) -> DataFrame:
    """Catalog rows (`make, model, year, asked_make, asked_year`) of the make and year that were asked for, each name once."""
    right = (T.comparison_make(F.col("make")) == T.comparison_make(make)) & (F.col("year") == year)
    return keep_first(rows.filter(right), [T.comparison_make(F.col("make")), T.comparison_model(F.col("model")), F.col("year")], order)


def catalog_union(campaigns: DataFrame, independent: DataFrame, order: Sequence[str]) -> DataFrame:
    """Both catalogs by name, each (make, model, year) once, that of the campaign catalog first."""
    both = campaigns.withColumn("catalog_source", F.lit("recall_catalog")).withColumn("_p", F.lit(0)).unionByName(independent.withColumn("catalog_source", F.lit("independent")).withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, [T.comparison_make(F.col("make")), T.comparison_model(F.col("model")), F.col("year")], ["_p", *order]).drop("_p")


def inventory_coverage(rows: DataFrame, make: str, model: str, year: str, category: str, number: str) -> DataFrame:
    """Variants, distinct names and what is missing, of all, by year, by category and by make."""
    sets = rows.withColumn("_name", F.struct(make, model, year)).groupingSets([[], [F.col(year)], [F.col(category)], [F.col(make)]], F.col(year), F.col(category), F.col(make))
    return sets.agg(F.count("*").alias("variants"), F.count_distinct("_name").alias("names"), F.count_if(F.col(number).isNull()).alias("n_missing"), F.grouping_id().alias("level"))


def normalised_tests(rows: DataFrame, names: dict[str, str], keys: Sequence[str], power: str, year: str) -> DataFrame:
    """Test rows under new names, power as a finite positive number or null with its state. One model year, no blank key."""
    out = rows.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])
    value, state = checked_number(F.col(power).cast("string"), 5e-324)
    out = out.withColumns({f"{power}_status": state, power: value})
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.coalesce(F.trim(F.col(k).cast("string")) == "", F.lit(True))
    one = out.agg(F.count_distinct(year).alias("years"), F.count_if(blank).alias("blanks"))
    enforce(one.filter("years > 1 OR blanks > 0"), "several model years or blank keys")
    return out


def test_coverage(configurations: DataFrame, status: str, n_rows: str) -> DataFrame:
    return configurations.agg(F.count("*").alias("configurations"), F.sum(n_rows).alias("n_tests"), *[F.count_if(F.col(status) == s).alias(s) for s in ("single_value", "conflicting", "missing")])


def query_states(responses: DataFrame, direct: bool = False) -> DataFrame:
    """Add `query_status` to stored responses (`n_results, catalog_source, failed`). A zero counts only for an identity of the campaign catalog."""
    some = "unverified_with_recalls" if direct else "valid_with_recalls"
    zero = F.lit(not direct) & F.coalesce(F.col("catalog_source") == "recall_catalog", F.lit(False))
    status = F.when(F.coalesce("failed", F.lit(False)) | F.col("n_results").isNull(), "query_failed").when(F.col("n_results") > 0, some).when(zero, "valid_zero_recalls").otherwise("unverified_zero_result")
    return responses.withColumn("query_status", status)


def identity_states(identities: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """What a stored response says of an exact independent identity: never a label."""
    joined = identities.join(responses.select(key, "n_results", "failed"), key, "left")
    failed = F.coalesce("failed", F.lit(False)) | F.col("n_results").isNull()
    state = F.when(failed, "query_failed").when(F.col("n_results") > 0, "campaigns_returned_review_required").otherwise("empty_response_identity_only")
    return joined.withColumn("recall_query_status", F.when(F.col("identity_status") == "exact_independent_identity", state).otherwise("not_queried")).drop("n_results", "failed")


def request_plan(rows: DataFrame, order: Sequence[str], by_model: bool = True, verified_only: bool = False) -> DataFrame:
    """The distinct requests for `make, model, year` (or make and year), the first spelling of each kept, trimmed.

    A name that is blank, or of signs alone so that its key is empty, asks for nothing."""
    if verified_only:
        enforce(unverified(rows), "a row is not verified")
    names = ["make", "model"] if by_model else ["make"]
    keys = {"_m": T.comparison_make(F.col("make")), **({"_l": T.comparison_model(F.col("model"))} if by_model else {})}
    some = rows.filter("year IS NOT NULL").withColumns(keys)
    for key in keys:
        some = some.filter(F.col(key) != "")
    first = keep_first(some, [*keys, "year"], order)
    return first.select(*[F.regexp_replace(F.col(c), "^\\s+|\\s+\\z", "").alias(c) for c in names], "year")


def independent_identities(rows: DataFrame, source: DataFrame, key: str, source_id: str) -> DataFrame:
    """`key, identity_status, n_spellings, source_ids, query_make, query_model` by equal normalised make, model and year.

    One raw spelling is exact and names the query, several are ambiguous, none is absent. Ids of the source are
    evidence of its variants alone: `recall_query_status` is `not_queried` and no row is eligible as a label. Keys of
    `rows` must be unique and not null.
    """
    enforce(rows.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)), "identities must be unique and not null")
    keys = lambda c: {"_m": T.comparison_make(F.col("make")), "_l": T.comparison_model(F.col("model"))}
    name = F.struct(F.col("make").alias("query_make"), F.col("model").alias("query_model"))
    spellings = source.withColumns(keys(source)).groupBy("_m", "_l", "year").agg(F.count_distinct("make", "model").alias("n"), F.min(name).alias("one"), F.array_sort(F.collect_set(F.col(source_id).cast("string"))).alias("source_ids"))
    found = rows.withColumns(keys(rows)).join(spellings, ["_m", "_l", "year"], "left")
    status = F.when(F.col("n").isNull(), "absent_from_independent_inventory").when(F.col("n") == 1, "exact_independent_identity").otherwise("ambiguous_independent_identity")
    said = [F.when(F.col("n") == 1, F.col(f"one.{c}")).alias(c) for c in ("query_make", "query_model")]
    return found.select(key, status.alias("identity_status"), F.coalesce("n", F.lit(0)).cast("long").alias("n_spellings"), F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"), *said, F.lit("not_queried").alias("recall_query_status"), F.lit(False).alias("label_eligible"))


def status_counts(rows: DataFrame, status: str, sets: Sequence[Sequence[str]], distinct: str | None = None) -> DataFrame:
    """Counts of a status for several groupings at once, and distinct values of one column."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = rows.groupingSets([[F.col(status), *map(F.col, s)] for s in sets], F.col(status), *map(F.col, keys))
    return grouped.agg(F.count("*").alias("n"), *([F.count_distinct(distinct).alias("n_distinct")] if distinct else []))


def suggestions(rows: DataFrame, candidates: DataFrame, block: Sequence[str], key: str, read: str, candidate: str, score: Callable[[Column, Column], Column], least: int, shown: Callable[[Column], Column] = lambda listed: listed) -> DataFrame:
    """Per key the candidates of its block of `least` points or more, as `shown` makes it of the ordered list: score from high to low, then id.

    `score` sees of a row no more than `read`, and a candidate's id. Rows of a block that read alike have one list, made
    beside the block's candidates and copied to their keys, so no pair is shuffled and memory holds a block's ids and one
    list. Only keys with unlike rows (other blocks, other `read`) have their lists gathered.
    """
    parts, same = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*block, "_part"]
    dealt = lambda df: df.repartition(parts, *same)  # noqa: E731  a number, or Spark merges partitions that are small until their lists are made
    spread = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part")
    pool = dealt(candidates.dropna(subset=list(block)).select(*block, candidate, spread)).groupBy(*same).agg(F.collect_list(candidate).alias("_pool"))
    places = rows.dropna(subset=list(block)).groupBy(key).agg(F.collect_list(F.struct(*block, read)).alias("_all"))
    places = places.select(key, "_all", F.array_distinct("_all").alias("_places"))

    enough = lambda c: score(F.col(read), c) >= least
    entry = lambda c: F.struct((-score(F.col(read), c)).alias("minus"), c.alias("id"))
    ordered = lambda found: shown(F.transform(F.sort_array(found), lambda x: F.struct((-x["minus"]).alias("s"), x["id"].alias("id")))).alias("suggestions")

    def lists(some: DataFrame) -> tuple[DataFrame, Column]:
        """Of each block and `read` the keys, and their list without order; a key that came `_n` times has all pairs as often."""
        each = some.select(key, "_all", F.explode("_places").alias("_p")).select(key, "_p.*", F.size(F.filter("_all", lambda x: x.eqNullSafe(F.col("_p")))).alias("_n"))
        alike = dealt(each.withColumn("_part", F.pmod(F.xxhash64(read), F.lit(SPREAD)).cast("int"))).groupBy(*same, read, "_n").agg(F.collect_list(F.struct(key)).alias("_keys"))
        found = F.transform(F.filter("_pool", enough), entry)
        return alike.join(pool, same).filter(F.exists("_pool", enough)), F.when(F.col("_n") == 1, found).otherwise(F.flatten(F.array_repeat(found, F.col("_n"))))

    one, found = lists(places.filter(F.size("_places") == 1))
    one = one.select("_keys", ordered(found)).select(F.inline("_keys"), "suggestions")
    more, found = lists(places.filter(F.size("_places") > 1))
    more = more.select("_keys", found.alias("_found")).select(F.inline("_keys"), "_found").groupBy(key).agg(F.flatten(F.collect_list("_found")).alias("_found"))
    return one.unionByName(more.select(key, ordered(F.col("_found"))))


def run_manifest(matches: DataFrame, alarm: float = 0.4) -> DataFrame:
    """One row: the number of rows, the loss rate, its warning, and a histogram of statuses as JSON."""
    counts = matches.groupBy("status").agg(F.count("*").alias("n"))
    lost = F.sum(F.when(F.col("status").isin("auto_accepted", "manual_accepted"), 0).otherwise(F.col("n"))) / F.sum("n")
    one = counts.agg(F.sum("n").alias("n"), F.round(lost, 6).alias("loss_rate"), F.array_sort(F.collect_list(F.concat_ws("=", "status", F.col("n").cast("string")))).alias("s"))
    return one.select("n", "loss_rate", F.when(F.col("loss_rate") > alarm, "loss_above_alarm").alias("warning"), F.array_join("s", ";").alias("statuses"))


def write_raw(rows: DataFrame, path: str) -> None:
    """Raw evidence is written once; a second write fails."""
    rows.write.mode("errorifexists").parquet(path)


def write_table(rows: DataFrame, path: str, *partition: str) -> None:
    """A derived table replaces its last version."""
    rows.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_audit(matches: DataFrame, path: str) -> None:
    matches.orderBy("status", "make", "model", "year").write.mode("overwrite").csv(path, header=True)


def write_report(rows: DataFrame, path: str) -> None:
    """A table of parameters or metrics as JSON lines."""
    rows.write.mode("overwrite").json(path)


def result_export(results: DataFrame, specs: Sequence[str], limitation: str) -> DataFrame:
    """One flat row per scored request: specs as `especificacion_*` columns, and the limitation beside each."""
    rest = [c for c in results.columns if c not in specs]
    return results.select(*rest, *[F.col(c).alias(f"especificacion_{c}") for c in specs], F.lit(limitation).alias("limitacion"))
