"""Cohort operators: specs, windowed event scores, maturity, lagged history, scale, splits. Columns are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscore.functions.text import canonical_text


def aggregate_specs(rows: DataFrame, keys: list[str], numbers: list[str], category: str) -> DataFrame:
    """Per entity: medians and counts of what was observed, never imputed; the commonest category, the smallest on ties."""
    aggs = [F.count("*").alias("n_rows"), F.mode(category, True).alias(category)]
    for c in numbers:
        aggs += [F.median(c).alias(f"{c}_median"), F.count(c).alias(f"{c}_observed")]
    return rows.groupBy(*keys).agg(*aggs)


def best_of_campaign(events: DataFrame, entity: str, campaign: str, weight: str, order: list[str], description: str | None = None) -> DataFrame:
    """One event per entity and campaign: the heaviest, then the first in source order. Ties need a full order.

    An aggregation, not a window: each task sends one row a campaign, however many events a campaign has. Events without a campaign are told apart by their canonical `description`; without one they are one campaign.
    """
    key = F.nullif(F.trim(F.col(campaign).cast("string")), F.lit(""))
    if description:
        key = F.coalesce(key, F.concat(F.lit("description:"), canonical_text(F.col(description))))
    place = F.struct(F.col(weight).isNull(), -F.col(weight), *order)
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in events.columns]), place)
    return events.groupBy(F.col(entity).alias("_entity"), key.alias("_campaign")).agg(best.alias("_e")).select("_e.*")


def window_scores(cohorts: DataFrame, events: DataFrame, entity: str, year: str, event_year: str, weight: str, years: int = 3) -> DataFrame:
    """Per cohort: score and number of events in calendar years [y, y + years), 0 without any, and those outside or undated."""
    inside = F.coalesce((F.col(event_year) >= F.col(year)) & (F.col(event_year) < F.col(year) + years), F.lit(False))
    joined = cohorts.select(entity, year).join(events.select(entity, event_year, weight).withColumn("_e", F.lit(True)), entity, "left").withColumn("_in", inside)
    return joined.groupBy(entity, year).agg(
        F.coalesce(F.sum(F.when(F.col("_in"), F.col(weight))), F.lit(0.0)).alias("score"),
        F.count_if("_in").alias("n_in_window"),
        F.count_if(F.coalesce(F.col("_e"), F.lit(False)) & ~F.col("_in")).alias("n_outside"),
        F.count_if(F.coalesce(F.col("_e"), F.lit(False)) & F.col(event_year).isNull()).alias("n_undated"),
    )


def mature(year: Column, as_of: str, years: int = 3) -> Column:
    return F.lit(as_of).cast("date") >= F.make_date(year + years, F.lit(1), F.lit(1))


def lagged_history(rows: DataFrame, brand: str, year: str, value: str, gap: int = 3, lookback: int = 3, asked: DataFrame | None = None) -> DataFrame:
    """Per brand and year: mean of the brand's yearly means in [y - gap - lookback + 1, y - gap], else the market's, and which.

    `asked` (brand, year) adds years without rows, so that a cohort without a label has its history too.
    """
    yearly = rows.groupBy(brand, year).agg(F.avg(value).alias("mean"))
    if asked is not None:
        yearly = yearly.unionByName(asked.select(brand, year).distinct().join(yearly.select(brand, year), [brand, year], "left_anti").withColumn("mean", F.lit(None).cast("double")))
    frame = Window.orderBy(year).rangeBetween(-(gap + lookback - 1), -gap)
    own = yearly.withColumn("own", F.avg("mean").over(frame.partitionBy(brand)))
    by_year = yearly.groupBy(year).agg(F.sum("mean").alias("s"), F.count("mean").alias("c"))  # one row a year: the frame below sorts those only
    market = by_year.select(year, (F.sum("s").over(frame) / F.sum("c").over(frame)).alias("market"))
    out = own.join(F.broadcast(market), year)  # one row per calendar year
    return out.select(brand, year, "mean", F.coalesce("own", "market").alias("history"), F.when(F.col("own").isNotNull(), "own").when(F.col("market").isNotNull(), "market").alias("history_source"))


def fit_scale(train: DataFrame, segment: str, value: str) -> DataFrame:
    """Population mean and spread per segment and, as a null segment, of all; no spread falls back to all, then to 1."""
    sets = train.groupingSets([[F.col(segment)], []], F.col(segment)).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.grouping(segment).alias("_all"))
    whole = sets.filter("_all = 1").select(F.col("mean").alias("g_mean"), F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("g_std"), F.lit(0).alias("_all"))
    return sets.filter("_all = 0").join(F.broadcast(whole), "_all").select(segment, "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(F.col("g_std")).alias("std"), "g_mean", "g_std")


def scaled_index(rows: DataFrame, scale: DataFrame, segment: str, value: str, origin: str | None = None) -> DataFrame:
    """Add `index_100`: 50 - 10 z, clipped to 0..100, by the row's segment or, for unknown ones, by all; in the column that
    `origin` names, which of the two (`segment`, `global`) it was."""
    whole = scale.select("g_mean", "g_std").limit(1).withColumn("_k", F.lit(1))
    joined = rows.join(scale.select(segment, "mean", "std"), segment, "left").withColumn("_k", F.lit(1)).join(F.broadcast(whole), "_k").drop("_k")
    z = (F.col(value) - F.coalesce("mean", "g_mean")) / F.coalesce("std", "g_std")
    if origin:
        joined = joined.withColumn(origin, F.when(F.col("mean").isNotNull(), "segment").otherwise("global"))
    return joined.withColumn("index_100", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 - 10 * z))).drop("mean", "std", "g_mean", "g_std")


def temporal_split(rows: DataFrame, year: str, train_end: int, validation_end: int, years: int = 3) -> DataFrame:
    """Add `partition`: train, validation or test by year, embargoed where the label was not yet mature at the next part's first year."""
    first = rows.agg(F.min(F.when((F.col(year) > train_end) & (F.col(year) <= validation_end), F.col(year))).alias("v"), F.min(F.when(F.col(year) > validation_end, F.col(year))).alias("t")).first()
    first_v, first_t = first["v"] or first["t"], first["t"]
    y = F.col(year)
    train = F.when(y > first_v - years, "train_embargoed").otherwise("train") if first_v else F.lit("train")
    valid = F.when(y > first_t - years, "validation_embargoed").otherwise("validation") if first_t else F.lit("validation")
    return rows.withColumn("partition", F.when(y <= train_end, train).when(y <= validation_end, valid).otherwise("test"))


def hierarchical_mean(rows: DataFrame, train: DataFrame, brand: str, segment: str, value: str) -> DataFrame:
    """Add `predicted` and `level`: mean of brand and segment, else brand, else segment, else all training rows."""
    both = train.groupBy(brand, segment).agg(F.avg(value).alias("m0"))
    by_brand = train.groupBy(brand).agg(F.avg(value).alias("m1"))
    by_segment = train.groupBy(segment).agg(F.avg(value).alias("m2"))
    whole = train.agg(F.avg(value).alias("m3")).first()["m3"]
    out = rows.join(both, [brand, segment], "left").join(by_brand, brand, "left").join(by_segment, segment, "left")
    level = F.when(F.col("m0").isNotNull(), "brand_segment").when(F.col("m1").isNotNull(), "brand").when(F.col("m2").isNotNull(), "segment").otherwise("all")
    return out.withColumns({"predicted": F.coalesce("m0", "m1", "m2", F.lit(whole)), "level": level}).drop("m0", "m1", "m2")


def error_summary(rows: DataFrame, observed: str, predicted: str, sets: list[list[str]]) -> DataFrame:
    """n, MAE, RMSE and bias for each grouping set."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    e = F.col(predicted) - F.col(observed)
    grouped = rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
