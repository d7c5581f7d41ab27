"""Training and scoring of regressors on cohorts: splits, targets, selection, evidence gates, explanations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscore.functions.text import direction
from cohortscore.operators import cohorts as C
from cohortscore.operators.matching import enforce
from cohortscore.operators.models import Fitted, select_model


def adaptive_cuts(rows: DataFrame, year: str, train_end: int, validation_end: int, adaptive: bool = True) -> tuple[int, int | None, str]:
    """(last training year, last validation year, strategy): the fixed cuts where all parts have rows, else 60/20/20 of the distinct years."""
    years = sorted(r[0] for r in rows.select(year).distinct().filter(F.col(year).isNotNull()).collect())  # calendar years
    parts = [[y for y in years if y <= train_end], [y for y in years if train_end < y <= validation_end], [y for y in years if y > validation_end]]
    if all(parts):
        return train_end, validation_end, "documented_fixed_years"
    if not adaptive or not years:
        return train_end, validation_end, "documented_fixed_years_incomplete"
    if len(years) == 1:
        return years[0], None, "single_year_train_only"
    if len(years) == 2:
        return years[0], years[1], "adaptive_distinct_years"
    n = len(years)
    train = min(max(1, n * 60 // 100), n - 2)
    return years[train - 1], years[train + min(max(1, n * 20 // 100), n - train - 1) - 1], "adaptive_distinct_years"


def adaptive_split(rows: DataFrame, year: str, train_end: int, validation_end: int, adaptive: bool = True, years: int = 3) -> DataFrame:
    """Add `partition` and `strategy`; labels that were not mature at the next part's first year are embargoed."""
    last_train, last_validation, strategy = adaptive_cuts(rows, year, train_end, validation_end, adaptive)
    out = C.temporal_split(rows, year, last_train, last_train if last_validation is None else last_validation, years)
    return out.withColumn("strategy", F.lit(strategy))


def relabelled(rows: DataFrame, segment: str, value: str) -> DataFrame:
    """Rebuild the index of every partition with the scale of `train` rows alone."""
    return C.scaled_index(rows, C.fit_scale(rows.filter("partition = 'train'"), segment, value), segment, value)


def prediction_frame(scored: DataFrame, observed: str, model: str, part: str) -> DataFrame:
    """Predictions to four places, their absolute error, the model and the partition."""
    return scored.withColumns({"predicted": F.round("predicted", 4), "absolute_error": F.round(F.abs(F.col("predicted") - F.col(observed)), 4), "model": F.lit(model), "partition": F.col(part) if part in scored.columns else F.lit(part)})


def batch_scores(scored: DataFrame, year: str, model: str, mae: float | None, available_from: int) -> DataFrame:
    """Scores of requests to two places in 0 to 100, with the model, its error, and whether the year came before the model could exist."""
    return scored.withColumns({"score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), "predicted")), 2), "model": F.lit(model), "mae": F.lit(mae).cast("double"), "retrospective": F.col(year) < available_from})


def evidence_gate(requests: DataFrame, supported: str, identity: str, history_source: str, official_catalog: bool = True, model: str = "baseline") -> DataFrame:
    """Add `refusal`: why a request gets no score, or null.

    With the baseline as the model, a brand it was not trained on is `unsupported_brand`, whatever else is known of it,
    and one that it was trained on needs nothing else. Other models need the official catalog, a verified identity and
    history of the brand's own earlier cohorts, in this order. Null evidence is no evidence.
    """
    known = F.coalesce(F.col(supported), F.lit(False))
    evidence = F.when(F.lit(not official_catalog), "no_official_catalog").when(~F.coalesce(F.col(identity), F.lit(False)), "identity_not_verified").when(F.coalesce(F.col(history_source), F.lit("")) != "own", "no_prior_cohorts")
    return requests.withColumn("refusal", F.when(~known, "unsupported_brand") if model == "baseline" else evidence)


def baseline_explanation(scored: DataFrame, train: DataFrame, brand: str, segment: str, value: str) -> DataFrame:
    """The group that the hierarchical mean used, its value, and how far it lies from the mean of all training rows."""
    whole = train.agg(F.avg(value).alias("baseline")).first()["baseline"]  # one number
    shown = F.when(F.col("level") == "brand_segment", F.concat_ws(" / ", brand, segment)).when(F.col("level") == "brand", F.col(brand)).when(F.col("level") == "segment", F.col(segment)).otherwise("all")
    effect = F.col("predicted") - F.lit(whole)
    return scored.withColumns({"value": shown, "baseline": F.lit(whole), "effect": effect, "direction": direction(effect)})


def ridge_coefficients(fitted: Fitted, categories: Sequence[str], train: DataFrame) -> dict[str, dict[str | None, float]]:
    """Coefficients in units of the target by source feature: one number for a number, one per level for a category."""
    regressor = fitted.stage(LinearRegressionModel)
    weights, spread = list(regressor.coefficients), fitted.scale[fitted.target][1]
    out = {c: {None: w * spread} for c, w in zip(fitted.numbers, weights)}
    at = len(fitted.numbers)
    for c, labels in zip(categories, fitted.stage(StringIndexerModel).labelsArray):
        out[c] = {label: w * spread for label, w in zip(labels, weights[at : at + len(labels)])}
        at += len(labels)
    return out


def ridge_attribution(rows: DataFrame, fitted: Fitted, categories: Sequence[str], reference: Mapping[str, object], coefficients: Mapping[str, Mapping]) -> DataFrame:
    """Add `effect_<feature>`: coefficient times the distance from the reference row, summed to the source feature."""
    scaled = fitted.standardised(rows)
    out = {}
    for c in fitted.numbers:
        mean, spread = fitted.scale[c]
        out[f"effect_{c}"] = F.lit(coefficients[c][None]) * (F.col(f"_z_{c}") - (float(reference[c]) - mean) / spread)
    for c in categories:
        table = F.create_map(*[F.lit(x) for pair in coefficients[c].items() for x in pair])
        out[f"effect_{c}"] = F.coalesce(table[F.col(c)], F.lit(0.0)) - F.lit(coefficients[c].get(reference[c], 0.0))
    return scaled.withColumns(out).drop(*[f"_z_{c}" for c in fitted.numbers])


def counterfactual(rows: DataFrame, row_id: str, reference: Mapping[str, object], predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`row_id, predicted` and `effect_<feature>`: the prediction minus that with one feature replaced by its reference; one pass."""
    types, features = dict(rows.dtypes), list(reference)
    copies = rows.withColumn("_i", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    copies = copies.withColumns({f: F.when(F.col("_i") == i, F.lit(reference[f]).cast(types[f])).otherwise(F.col(f)) for i, f in enumerate(features)})
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("predicted")))
    return predict(copies).groupBy(row_id).agg(at(-1).alias("predicted"), *[(at(-1) - at(i)).alias(f"effect_{f}") for i, f in enumerate(features)])


def factors(effects: DataFrame, row_id: str, features: Sequence[str], top: int) -> DataFrame:
    """`row_id, place, feature, effect, direction`: the `top` features by absolute effect, names settling ties."""
    long = effects.select(row_id, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"effect_{f}").alias("effect")) for f in features])))
    place = F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc(F.abs(F.col("effect"))), "feature"))
    return long.withColumn("place", place).filter(F.col("place") <= top).withColumn("direction", direction(F.col("effect")))


#: Names of features and of the groups of the baseline in sentences. Fixed values.
FEATURE_NAMES: Mapping[str, str] = {
    "marca": "la marca",
    "categoria_vehiculo": "la categoría del vehículo",
    "mediana_cilindros": "los cilindros",
    "mediana_cv": "la potencia",
    "hist_fiabilidad_marca": "el historial previo de la marca",
}
GROUP_NAMES = {"brand_segment": "marca y segmento", "brand": "marca", "segment": "segmento", "all": "media global"}
NO_FACTORS = "No hay factores explicativos disponibles para esta estimación."
ASSOCIATION = ". Explicación determinista de asociaciones del modelo; no demuestra causalidad."
BASELINE_LIMITS = "Potencia, cilindros e historial reciente no intervienen en este baseline; el perfil técnico se muestra únicamente como contexto. No distingue modelos dentro del mismo grupo ni demuestra causas de averías."


def feature_label(feature: Column) -> Column:
    """The name of a feature in words, its first letter alone in upper case."""
    names = F.create_map(*[F.lit(x) for pair in FEATURE_NAMES.items() for x in pair])
    words = F.lower(F.coalesce(names[feature], F.replace(feature, F.lit("_"), F.lit(" "))))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10_000))


def sentences(top_factors: DataFrame, row_id: str, rows: DataFrame | None = None) -> DataFrame:
    """`row_id, sentence`: one fixed sentence of the factors in order. With `rows`, those without a factor get a sentence too."""
    verb = F.when(F.col("effect") > 0, "eleva").when(F.col("effect") < 0, "reduce").otherwise("apenas modifica")
    said = F.format_string("%s %s el índice (%+.1f puntos)", feature_label(F.col("feature")), verb, F.col("effect"))
    parts = F.array_sort(F.collect_list(F.struct("place", said.alias("s"))))
    out = top_factors.groupBy(row_id).agg(F.concat(F.array_join(F.transform(parts, lambda p: p["s"]), "; "), F.lit(ASSOCIATION)).alias("sentence"))
    return out if rows is None else rows.select(row_id).distinct().join(out, row_id, "left").withColumn("sentence", F.coalesce("sentence", F.lit(NO_FACTORS)))


def baseline_sentences(explained: DataFrame, row_id: str) -> DataFrame:
    """`row_id, sentence` of rows with `level, value, predicted, baseline, effect`, as `baseline_explanation` gives them."""
    group = F.create_map(*[F.lit(x) for pair in GROUP_NAMES.items() for x in pair])[F.col("level")]
    said = F.format_string("El baseline utiliza %s: %s. La estimación del grupo es %.2f/100, frente a %.2f/100 de la media global de entrenamiento (diferencia: %+.2f puntos). %s", group, F.col("value"), F.col("predicted"), F.col("baseline"), F.col("effect"), F.lit(BASELINE_LIMITS))
    return explained.select(row_id, said.alias("sentence"))


def importance(effects: DataFrame, features: Sequence[str]) -> DataFrame:
    """`feature, importance`: mean absolute effects, summing to 1."""
    one = effects.agg(*[F.avg(F.abs(F.col(f"effect_{f}"))).alias(f) for f in features])
    total = sum((F.col(f) for f in features), F.lit(0.0))
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.when(total > 0, F.col(f) / total).otherwise(0.0).alias("importance")) for f in features])))


def window_violations(windows: DataFrame) -> DataFrame:
    """`rule, train_end, validation_end, test_end` of the windows that break the protocol; `windows` has the three years.

    `cuts_do_not_rise`: a year is null or not above the one before it. `tests_overlap`: the test years begin before those
    of the window before, in order of the validation's end, are over. A handful of rows, so one task orders them.
    """
    cuts = [F.col(c) for c in ("train_end", "validation_end", "test_end")]
    rises = F.coalesce((cuts[0] < cuts[1]) & (cuts[1] < cuts[2]), F.lit(False))
    over = F.lag("test_end").over(Window.orderBy(F.asc_nulls_last("validation_end"), "test_end", "train_end"))
    rules = F.array_compact(F.array(F.when(~rises, "cuts_do_not_rise"), F.when(F.col("_over") > cuts[1], "tests_overlap")))
    return windows.withColumn("_over", over).withColumn("rule", F.explode(rules)).select("rule", *cuts)


def temporal_windows(rows: DataFrame, windows: Sequence[tuple[int, int, int]], brand: str, segment: str, year: str, value: str, years: int = 3) -> DataFrame:
    """The baseline's test errors in each window: `window, status, n_train, n_test, mae, rmse`; a window without a part is not evaluable."""
    if not windows:
        raise ValueError("no windows")
    enforce(window_violations(rows.sparkSession.createDataFrame(windows, "train_end int, validation_end int, test_end int")), "the windows break the protocol")
    out = None
    for a, b, c in windows:
        part = C.temporal_split(rows.filter(F.col(year) <= c), year, a, b, years)
        train, test = part.filter("partition IN ('train', 'validation')"), part.filter("partition = 'test'")
        counts = part.agg(*[F.count_if(F.col("partition") == p).alias(f"n_{p}") for p in ("train", "validation", "test")])
        errors = C.error_summary(C.hierarchical_mean(test, train, brand, segment, value), value, "predicted", [[]]).select("mae", "rmse")
        ok = (F.col("n_train") > 0) & (F.col("n_validation") > 0) & (F.col("n_test") > 0)
        one = counts.withColumn("_k", F.lit(1)).join(errors.withColumn("_k", F.lit(1)), "_k", "left")  # one row each
        one = one.select(F.lit(f"{a}-{b}-{c}").alias("window"), F.when(ok, "evaluated").otherwise("not_evaluable").alias("status"), "n_train", "n_test", F.when(ok, F.col("mae")).alias("mae"), F.when(ok, F.col("rmse")).alias("rmse"))
        out = one if out is None else out.unionByName(one)
    return out


def frozen_audit(predictions: DataFrame, train: DataFrame, year: str, observed: str, sets: Sequence[Sequence[str]], n_recorded: int, years: int = 3, small: int = 30) -> DataFrame:
    """Errors of a frozen model by group with a small-group flag, and whether its test rows and years are those recorded and later than its labels."""
    last = train.agg(F.max(year).alias("y")).first()["y"]
    errors = C.error_summary(predictions, observed, "predicted", [list(s) for s in sets])
    one = predictions.agg(F.count("*").alias("_n"), F.min(year).alias("_first"))
    holds = (F.col("_n") == n_recorded) & (F.col("_first") >= (last or 0) + years)
    return errors.withColumn("is_small", F.col("n") < small).withColumn("_k", F.lit(1)).join(one.select(F.lit(1).alias("_k"), F.coalesce(holds, F.lit(False)).alias("is_consistent")), "_k").drop("_k")


def train_and_select(rows: DataFrame, fits: Mapping[str, Callable[[DataFrame], Callable[[DataFrame], DataFrame]]], year: str, observed: str, margin: float = 0.1, years: int = 3) -> tuple[str, dict, Callable, int]:
    """(name, errors, predictor, first year it is available) of the chosen model, for rows that already have `partition`.

    Each of `fits` takes training rows and gives a function that adds `predicted`. Models are judged on the validation
    rows; the chosen one is fitted again on training and validation rows.
    """
    train, validation = rows.filter("partition = 'train'"), rows.filter("partition = 'validation'")
    errors = {}
    for name, fit in fits.items():
        one = C.error_summary(fit(train)(validation), observed, "predicted", [[]]).first()
        errors[name] = None if one is None or not one["n"] else one["mae"]
    chosen = select_model(errors, margin)
    both = rows.filter("partition IN ('train', 'validation')")
    return chosen, errors, fits[chosen](both), (both.agg(F.max(year)).first()[0] or 0) + years
