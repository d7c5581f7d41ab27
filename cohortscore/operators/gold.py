"""The labelled table, the catalogs for inference and serving, and lookups in them. Columns are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscore.functions import text as T
from cohortscore.operators import cohorts as C
from cohortscore.operators.guards import checked_join
from cohortscore.operators.matching import ACCEPTED, duplicate_keys, enforce


def valid_rows(rows: DataFrame, keys: Sequence[str], year: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows with keys that are not blank and a year from `least` on, and one row that counts those dropped by reason."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.coalesce(F.trim(F.col(k).cast("string")) == "", F.lit(True))
    no_year, early = F.col(year).isNull(), F.coalesce(F.col(year) < least, F.lit(False))
    report = rows.agg(F.count("*").alias("n_read"), F.count_if(blank).alias("blank_key"), F.count_if(~blank & no_year).alias("no_year"), F.count_if(~blank & early).alias("early_year"), F.count_if(~blank & ~no_year & ~early).alias("n_kept"))
    return rows.filter(~blank & ~no_year & ~early), report


def in_scope(rows: DataFrame, make: str, year: str, makes: Sequence[str] = (), years: Sequence[int] = ()) -> DataFrame:
    """Rows of the makes, whatever their case, and of the years; no makes or no years means all. Nothing left is an error."""
    out = rows.filter(F.lower(F.trim(make)).isin(*[m.strip().lower() for m in makes])) if makes else rows
    out = out.filter(F.col(year).isin(*years)) if years else out
    enforce(out.limit(1).agg(F.count("*").alias("n")).filter("n = 0"), "nothing is in scope")
    return out


def accepted_only(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("status").isin(*ACCEPTED))


def complete_only(rows: DataFrame, year: str, as_of: str, years: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows whose window has ended, and one row with the number of the others."""
    done = C.mature(F.col(year), as_of, years)
    return rows.filter(done), rows.agg(F.count_if(~F.coalesce(done, F.lit(False))).alias("n_incomplete"))


def mapped_events(events: DataFrame, mapping: DataFrame, official: str) -> DataFrame:
    """Events beside every entity that is linked to their official id; two entities may share one."""
    return mapping.join(events, official)


def build_gold(specs: DataFrame, accepted: DataFrame, scores: DataFrame, keys: Sequence[str], year: str, brand: str, segment: str, value: str, as_of: str, years: int = 3) -> DataFrame:
    """The labelled table: entities with an accepted identity and a complete window, their score, history and index.

    An entity without an accepted identity is left out, not zero; one with an identity and no event has score 0 already.
    """
    rows = specs.join(accepted.select(*keys).distinct(), list(keys), "left_semi")
    rows = checked_join(rows, scores, keys, "inner", unique="both")
    rows, _ = complete_only(rows, year, as_of, years)
    past = C.lagged_history(rows, brand, year, value, gap=years).select(brand, year, "history", "history_source")
    rows = rows.join(past, [brand, year], "left")
    return C.scaled_index(rows, C.fit_scale(rows, segment, value), segment, value)


def inference_catalog(specs: DataFrame, gold: DataFrame, year: str, brand: str, value: str, as_of: str, years: int = 3, outcomes: Sequence[str] = ()) -> DataFrame:
    """Every entity with its history from labelled cohorts and whether its window is complete, without any outcome column."""
    past = C.lagged_history(gold, brand, year, value, gap=years, asked=specs).select(brand, year, "history", "history_source")
    out = specs.join(past, [brand, year], "left").withColumns({"is_complete": C.mature(F.col(year), as_of, years), "as_of": F.lit(as_of).cast("date")})
    return without_outcomes(out, outcomes)


def without_outcomes(rows: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """The rows without columns that a prediction must not see."""
    return rows.drop(*outcomes)


def with_match(catalog: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    return catalog.join(matches, list(keys), "left").withColumn("status", F.coalesce("status", F.lit("not_queried")))


def serving_catalog(gold: DataFrame, inference: DataFrame, keys: Sequence[str], diagnostics: Sequence[str] = (), names: Sequence[str] = (), year: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Labelled rows, and those of the inference catalog that have no label; diagnostics come from the inference side.

    With diagnostics a key may be in each side once, or the join fails; without them the labelled row stays, then the
    first by `order`. `names` are trimmed and lower-cased, the year is a number; rows without one of these go.
    """
    both = gold.drop(*diagnostics).withColumn("origin", F.lit("gold")).unionByName(inference.drop(*diagnostics).join(gold, list(keys), "left_anti").withColumn("origin", F.lit("inference")), allowMissingColumns=True)
    if diagnostics:
        both = checked_join(both, inference.select(*keys, *diagnostics), keys, "left", unique="both")
    elif order:
        first = Window.partitionBy(*keys).orderBy("origin", *order)
        both = both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    both = both.withColumns({c: F.lower(F.trim(c)) for c in names})
    if year:
        both = both.withColumn(year, F.expr(f"try_cast(`{year}` AS int)"))
    return both.na.drop(subset=[*names, *([year] if year else [])]) if names or year else both


def catalog_lookup(requests: DataFrame, catalog: DataFrame, make: str, model: str, year: str, found: Sequence[str]) -> DataFrame:
    """Requests (`make, model, year`) beside the catalog rows of the same canonical names; `is_found` says whether there is one."""
    side = catalog.select(T.canonical_text(F.col(make)).alias("_m"), T.canonical_text(F.col(model)).alias("_l"), F.col(year).alias("_y"), *found, F.lit(True).alias("_f"))
    on = (T.canonical_text(F.col("make")) == F.col("_m")) & (T.canonical_text(F.col("model")) == F.col("_l")) & (F.col("year") == F.col("_y"))
    return requests.join(side, on, "left").withColumn("is_found", F.coalesce("_f", F.lit(False))).drop("_m", "_l", "_y", "_f")


def transfer_failures(matches: DataFrame, replies: DataFrame) -> DataFrame:
    """An accepted match whose response is no valid one takes the state of the response; no response is a failed one.

    Such a match is to be audited, and its `advice` says that no label follows from it. `audit_required` and `advice` of
    other matches stay as they are, or are false and null where `matches` has none.
    """
    valid = F.col("query_status").isin("valid_with_recalls", "valid_zero_recalls")
    failed = F.col("status").isin(*ACCEPTED) & ~F.coalesce(valid, F.lit(False))
    audit = F.col("audit_required") if "audit_required" in matches.columns else F.lit(False)
    advice = F.col("advice") if "advice" in matches.columns else F.lit(None).cast("string")
    told = {
        "status": F.when(failed, F.coalesce("query_status", F.lit("query_failed"))).otherwise(F.col("status")),
        "audit_required": failed | audit,
        "advice": F.when(failed, T.NO_LABEL).otherwise(advice),
    }
    return checked_join(matches, replies.select("cand_id", "query_status"), ["cand_id"]).withColumns(told).drop("query_status")


def catalog_contract(rows: DataFrame, aliases: dict[str, Sequence[str]], year: str, first: int, last: int) -> DataFrame:
    """Columns by the first alias present, blank-like words as null, years in range, no null key; `aliases` maps name to aliases."""
    known = {T.column_name(c): c for c in rows.columns}
    picked = {new: next((known[T.column_name(a)] for a in (new, *old) if T.column_name(a) in known), None) for new, old in aliases.items()}
    if missing := [n for n, c in picked.items() if c is None]:
        raise ValueError(f"missing columns: {missing}")
    clean = lambda c: F.when(~F.lower(F.trim(c)).isin("", "nan", "none", "null", "<na>"), F.trim(c))
    out = rows.select(*[F.col(c).cast("int").alias(n) if n == year else clean(F.col(c).cast("string")).alias(n) for n, c in picked.items()])
    return out.filter(F.col(year).between(first, last)).na.drop()


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return duplicate_keys(rows, *keys)
