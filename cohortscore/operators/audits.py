"""Audits and preparation: median imputation, target sensitivity, scope samples, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscore.operators.scratch import settled


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of each group: the keys, `n` and `q0`, `q1`, ... in the order of `fractions`.

    Values are counted first, then dealt in ranges of (group, value), so that a large group spreads over many tasks,
    and settled once. Sums of the parts say which part holds a wanted rank; only those parts are put in order.
    Null keys are a group; null values do not count, and a group without a value gives no row.
    """
    cell = F.struct(F.lit(0).alias("_"), *keys).alias("cell")
    values = rows.filter(F.col(value).isNotNull()).groupBy(cell, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    dealt = settled(values.repartitionByRange("cell", "v").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("cell", "part").agg(F.sum("n").alias("many"))
    group = Window.partitionBy("cell")
    sums = sums.withColumns({"before": F.sum("many").over(group.orderBy("part")) - F.col("many"), "total": F.sum("many").over(group)})
    at = [F.lit(float(f)) * (F.col("total") - 1) for f in fractions]
    ranks = F.array_distinct(F.array(*[side(a) for a in at for side in (F.floor, F.ceil)]))
    hit = sums.withColumn("place", F.explode(ranks)).filter(F.col("place").between(F.col("before"), F.col("before") + F.col("many") - 1))
    near = dealt.join(hit.select("cell", "part").distinct(), ["cell", "part"], "left_semi")
    ordered = near.withColumn("inner", F.sum("n").over(Window.partitionBy("cell", "part").orderBy("v")) - F.col("n"))
    rank = F.col("place") - F.col("before")
    found = hit.join(ordered, ["cell", "part"]).filter(rank.between(F.col("inner"), F.col("inner") + F.col("n") - 1)).select("cell", "total", "place", "v")
    sides = [F.max(F.when(F.col("place") == side(a), F.col("v"))).alias(f"{name}{i}") for i, a in enumerate(at) for name, side in (("a", F.floor), ("b", F.ceil))]
    between = [(F.col(f"a{i}") + F.when(F.col(f"a{i}") == F.col(f"b{i}"), 0.0).otherwise((a - F.floor(a)) * (F.col(f"b{i}") - F.col(f"a{i}")))).alias(f"q{i}") for i, a in enumerate(at)]
    return found.groupBy("cell", "total").agg(*sides).select(*[F.col("cell").getField(k).alias(k) for k in keys], F.col("total").alias("n"), *between)


def impute_medians(rows: DataFrame, train: DataFrame, brand: str, segment: str, value: str) -> DataFrame:
    """Add `{value}_imputed` and `imputed_from`: observed, else the training median of brand and segment, of segment, of all, else 0."""
    none = F.lit(None).cast("string")
    levels = [F.struct(F.lit(i).alias("_level"), b.cast("string").alias("_b"), s.cast("string").alias("_s")) for i, (b, s) in enumerate(((F.col(brand), F.col(segment)), (none, F.col(segment)), (none, none)))]
    keys = ["_level", "_b", "_s"]
    middle = exact_quantiles(train.select(F.col(value).alias("_v"), F.inline(F.array(*levels))), keys, "_v", [0.5])
    at = lambda i, *names: middle.filter(F.col("_level") == i).select(*names, F.col("q0").alias(f"_m{i}"))
    out = rows.join(at(0, F.col("_b").alias(brand), F.col("_s").alias(segment)), [brand, segment], "left").join(at(1, F.col("_s").alias(segment)), segment, "left")
    out = out.withColumn("_one", F.lit(1)).join(F.broadcast(at(2, F.lit(1).alias("_one"))), "_one", "left")  # one row
    origin = F.when(F.col(value).isNotNull(), "observed").when(F.col("_m0").isNotNull(), "brand_segment").when(F.col("_m1").isNotNull(), "segment").when(F.col("_m2").isNotNull(), "all").otherwise("zero")
    return out.withColumns({f"{value}_imputed": F.coalesce(value, "_m0", "_m1", "_m2", F.lit(0.0)), "imputed_from": origin}).drop("_one", "_m0", "_m1", "_m2")


def sensitivity(gold: DataFrame, scenarios: Mapping[str, Mapping[str, float]], base: str, segment: str, year: str, train_max: int) -> DataFrame:
    """How the index moves under other class weights: `scenario, part, n, mean_shift, max_shift, rank_corr, changed_band`.

    `gold` has one count column per class. The scale of each scenario is fitted on years up to `train_max` alone. Ranks
    come from counts of distinct values, so no window holds single rows. `rank_corr` is null where a side is constant.
    """
    names = list(scenarios)
    scores = [sum((F.col(c) * w for c, w in scenarios[x].items()), F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(names)]
    rows = gold.select(segment, year, *scores)
    fits = [f(f"s{i}").alias(f"{f.__name__}_{i}") for i in range(len(names)) for f in (F.avg, F.stddev_pop)]
    sets = rows.filter(F.col(year) <= train_max).groupingSets([[F.col(segment)], []], F.col(segment)).agg(*fits, F.grouping(segment).alias("_all"))
    own = sets.filter("_all = 0").drop("_all")
    whole = sets.filter("_all = 1").drop(segment).withColumnsRenamed({c: f"g_{c}" for c in sets.columns if c not in (segment, "_all")})
    scaled = rows.join(own, segment, "left").withColumn("_all", F.lit(1)).join(F.broadcast(whole), "_all")  # one row

    def index(i: int) -> Column:
        spread = [F.when(F.col(c) > 0, F.col(c)) for c in (f"stddev_pop_{i}", f"g_stddev_pop_{i}")]
        z = (F.col(f"s{i}") - F.coalesce(f"avg_{i}", f"g_avg_{i}")) / F.coalesce(*spread, F.lit(1.0))
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 - 10 * z)), 6)

    moved = scaled.select(year, index(names.index(base)).alias("r"), F.inline(F.array(*[F.struct(F.lit(x).alias("scenario"), index(i).alias("v")) for i, x in enumerate(names)])))
    parts = F.array_compact(F.array(F.lit("all"), F.when(F.col(year) > train_max, "after_train")))
    keys = ["scenario", "part"]
    counts = moved.select("scenario", F.explode(parts).alias("part"), "r", "v").groupBy(*keys, "r", "v").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    rank = lambda c: F.sum("n").over(group.orderBy(c).rangeBetween(Window.unboundedPreceding, 0)) - (F.sum("n").over(Window.partitionBy(*keys, c)) - 1) / 2
    mid = (F.sum("n").over(group) + 1) / 2
    counts = counts.withColumns({"x": rank("r") - mid, "y": rank("v") - mid})
    band = lambda c: F.when(F.col(c) >= 70, 2).when(F.col(c) >= 45, 1).otherwise(0)
    x, y, n, shift = F.col("x"), F.col("y"), F.col("n"), F.abs(F.col("v") - F.col("r"))
    spread = F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y))
    return counts.groupBy(*keys).agg(F.sum(n).alias("n"), (F.sum(n * shift) / F.sum(n)).alias("mean_shift"), F.max(shift).alias("max_shift"), F.when(spread > 0, F.sum(n * x * y) / spread).alias("rank_corr"), F.sum(F.when(band("r") != band("v"), n).otherwise(0)).alias("changed_band"))


def scope_sample(rows: DataFrame, year: str, make: str, order: Sequence[str], n: int) -> DataFrame:
    """`n` rows round robin over years, and within a year over makes; evenly spaced years if there are more years than `n`."""
    known = rows.filter(F.col(year).isNotNull())
    # Calendar years are few, so one task ranks them; from 0 to `last`, the place i of n nearest to each is a bound on the rank.
    ranked = known.select(year).distinct().withColumn("_place", F.dense_rank().over(Window.orderBy(year)) - 1)
    size = ranked.agg(F.max("_place").alias("_last"))
    step = F.greatest(F.lit(1), F.col("_last")) / F.lit(max(1, n - 1))
    wanted = size.select("_last", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i")).select("_last", F.when(F.col("_last") < n, F.col("_i")).otherwise(F.bround(F.col("_i") * step)).cast("int").alias("_place"))
    years = ranked.join(wanted.select("_place").distinct(), "_place", "left_semi").select(year)
    # No more than n rows of one year and make, nor n of one year, can be taken.
    of_make = known.join(F.broadcast(years), year, "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy(year, make).orderBy(*order))).filter(F.col("_r") <= n)
    placed = of_make.withColumn("position", F.row_number().over(Window.partitionBy(year).orderBy("_r", make, *order)))
    return placed.orderBy("position", year).limit(n).drop("_r")


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, `n, digest`: a hash of the rows as a multiset, whatever their order, partitions and integer types.

    Row hashes are added up in four limbs, which aggregates partially; nothing is sorted or gathered.
    """
    h = rows.select(F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256).alias("h"))
    limbs = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(30,0)").cast("string").alias(f"s{i}") for i in range(4)]
    return h.agg(F.count("*").alias("n"), *limbs).select("n", F.sha2(F.concat_ws("-", F.col("n").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("digest"))
