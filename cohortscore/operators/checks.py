"""Contracts of tables as violations: rows of a rule and what breaks it. `enforce` of the matching module makes them errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """`rule, n` for each rule, n rows that break it; one pass."""
    one = rows.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(name) for name, c in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])))


def spec_quality(rows: DataFrame, keys: Sequence[str], numbers: Sequence[str], year: str) -> DataFrame:
    """One row: rows, null keys, keys that occur more than once, nulls by number, first and last year."""
    nulls = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    twice = rows.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n_repeated"))
    main = rows.agg(F.count("*").alias("n"), F.count_if(nulls).alias("n_null_key"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in numbers], F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return main.withColumn("_k", F.lit(1)).join(twice.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row on each side


def gold_violations(gold: DataFrame, keys: Sequence[str], index: str, required: Sequence[str]) -> DataFrame:
    """`rule, n`: missing columns are an error; then an empty table, repeated keys, and indices that are null or outside 0 to 100."""
    if missing := [c for c in required if c not in gold.columns]:
        raise ValueError(f"missing columns: {missing}")
    repeated = gold.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"), F.lit("repeated_key").alias("rule")).select("rule", "n")
    empty = gold.limit(1).agg(F.lit("empty").alias("rule"), (1 - F.count("*")).alias("n"))
    outside = _counted(gold, {"index_out_of_range": ~F.col(index).between(0, 100)})
    return empty.unionByName(repeated).unionByName(outside)


def inventory_violations(rows: DataFrame, source_id: str, texts: Sequence[str], year: str, first: int = 1995, last: int = 2100) -> DataFrame:
    """`rule, n`: blank fields, years that are no integers in range, ids that repeat, ids with conflicting names."""
    whole = F.col(year).try_cast("double")
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in (source_id, *texts)])
    rules = {"blank_field": blank, "bad_year": ~((whole == F.floor(whole)) & whole.between(first, last))}
    by_id = rows.groupBy(source_id).agg(F.count("*").alias("c"), F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*texts, year)]).alias("d"))
    ids = by_id.agg(F.count_if(F.col("c") > 1).alias("repeated_id"), F.count_if(F.col("d") > 1).alias("conflicting_id"))
    ids = ids.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in ("repeated_id", "conflicting_id")])))
    return _counted(rows, rules).unionByName(ids)


def not_contained(inner: DataFrame, outer: DataFrame, keys: Sequence[str]) -> DataFrame:
    return inner.select(*keys).distinct().join(outer, list(keys), "left_anti")


def publication_violations(gold: DataFrame, catalog: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """`rule, n`: catalog keys that repeat, gold keys that the catalog lacks, and features that differ between both, nulls being equal."""
    repeated = catalog.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.lit("repeated_catalog_key").alias("rule"), F.count_if(F.col("c") > 1).alias("n"))
    lost = not_contained(gold, catalog, keys).agg(F.lit("gold_not_in_catalog").alias("rule"), F.count("*").alias("n"))
    both = gold.select(*keys, *[F.col(c).alias(f"_g_{c}") for c in features]).join(catalog.select(*keys, *features), list(keys))
    differ = _counted(both, {f"differs_{c}": ~F.col(f"_g_{c}").eqNullSafe(F.col(c)) for c in features})
    return repeated.unionByName(lost).unionByName(differ)


def recomputed_metrics(predictions: DataFrame, stored: DataFrame, part: str, observed: str, predicted: str, tolerance: float = 2e-4) -> DataFrame:
    """Stored `n, mae, rmse` of each part beside those of the prediction rows, and whether they agree, denominators exactly."""
    e = F.col(predicted) - F.col(observed)
    finite = ~F.isnan(e) & (F.abs(e) < float("inf"))
    own = predictions.filter(F.coalesce(finite, F.lit(False))).groupBy(part).agg(F.count("*").alias("n_rows"), F.avg(F.abs(e)).alias("own_mae"), F.sqrt(F.avg(e * e)).alias("own_rmse"))
    same = (F.col("n") == F.col("n_rows")) & (F.abs(F.col("mae") - F.col("own_mae")) <= tolerance) & (F.abs(F.col("rmse") - F.col("own_rmse")) <= tolerance)
    return stored.join(own, part, "full").withColumn("agrees", F.coalesce(same, F.lit(False)))


def comparability(results: DataFrame, group: str, versions: Sequence[str], fallback: str, retrospective: str, synthetic: str, segment: str) -> DataFrame:
    """`group, codes`: why the results of a group must not be compared; an empty list where they may."""
    aggs, codes = [], []
    for v in versions:
        aggs += [F.count_if(F.coalesce(F.trim(F.col(v).cast("string")), F.lit("")) == "").alias(f"_m_{v}"), F.count_distinct(v).alias(f"_d_{v}")]
        codes.append(F.when(F.col(f"_m_{v}") > 0, f"missing_{v}").when(F.col(f"_d_{v}") > 1, f"different_{v}"))
    for name, c in (("fallback", fallback), ("retrospective", retrospective)):
        aggs.append(F.bool_or(F.coalesce(c, F.lit(False))).alias(f"_{name}"))
        codes.append(F.when(F.col(f"_{name}"), name))
    of_segment = F.coalesce(segment, F.lit(""))
    aggs += [F.count_distinct(F.coalesce(synthetic, F.lit(False))).alias("_o"), F.count_distinct(of_segment).alias("_s")]
    codes += [F.when(F.col("_o") > 1, "mixed_origin"), F.when(F.col("_s") > 1, "different_segment")]
    return results.groupBy(group).agg(*aggs).select(group, F.array_compact(F.array(*codes)).alias("codes"))


def result_violations(results: DataFrame, score: str, asked: Sequence[str], answered: Sequence[str]) -> DataFrame:
    """`rule, n`: scores that are null or outside 0 to 100, and answers about another entity than was asked for."""
    other = reduce(lambda a, b: a | b, [~F.col(a).eqNullSafe(F.col(b)) for a, b in zip(asked, answered)])
    return _counted(results, {"score_out_of_range": ~F.col(score).between(0, 100), "other_identity": other})


def known_error(mae: Column) -> Column:
    """A stored error; a negative one is none."""
    return F.when(mae >= 0, mae)


def origin_guard(rows: DataFrame, synthetic: str) -> DataFrame:
    """One row: whether any row is synthetic, which marks the whole output, and whether origins are mixed. Null is real."""
    flag = F.coalesce(synthetic, F.lit(False))
    return rows.agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("is_synthetic"), F.coalesce(F.bool_or(flag) & ~F.bool_and(flag), F.lit(False)).alias("is_mixed"))


def denominator_violations(totals: DataFrame, counts: DataFrame, ordered: Sequence[str]) -> DataFrame:
    """`rule, n` of a one-row `totals` and `counts` (`status, n`): negative counts, statuses that do not add up, totals out of order."""
    one = counts.agg(F.sum("n").alias("_sum"), F.min("n").alias("_least")).withColumn("_k", F.lit(1)).join(totals.withColumn("_k", F.lit(1)), "_k")  # one row each
    falls = reduce(lambda a, b: a | b, [F.col(a) < F.col(b) for a, b in zip(ordered, ordered[1:])])
    return _counted(one, {"negative_count": (F.col("_least") < 0) | (F.col(ordered[-1]) < 0), "counts_do_not_add_up": F.col("_sum") != F.col("total"), "totals_out_of_order": falls})


def date_quality(rows: DataFrame, text: str, parsed: Column) -> DataFrame:
    missing = F.coalesce(F.trim(text), F.lit("")) == ""
    return rows.agg(F.count("*").alias("n"), F.count_if(missing).alias("n_missing"), F.count_if(~missing & parsed.isNull()).alias("n_invalid"))


def training_violations(rows: DataFrame, keys: Sequence[str], year: str, label: str, numbers: Sequence[str], complete: str, first: int, last: int) -> DataFrame:
    """`rule, n`: what must stop a training: empty or repeated ids, years out of range, labels that are missing, not finite or negative, incomplete cohorts."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(k).cast("string")) == "", F.lit(True)) for k in keys])
    y, v = F.col(year).cast("double"), F.col(label).cast("double")
    rules = {"blank_id": blank, "bad_year": ~((y == F.floor(y)) & y.between(first, last)), "bad_label": bad(v) | (v < 0), "incomplete": ~F.coalesce(complete, F.lit(False))}
    rules |= {f"infinite_{c}": F.coalesce(bad(F.col(c).cast("double")), F.lit(False)) for c in numbers}  # a null is imputed later
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.lit("repeated_id").alias("rule"), F.count_if(F.col("c") > 1).alias("n"))
    return _counted(rows, rules).unionByName(repeated)
