"""Regressors, their selection, attributions, and reference scores from mature history."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from math import comb

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscore.operators.estimators import GroupMean, GroupMedianImputer, GroupMedianModel


@dataclass(frozen=True)
class Fitted:
    """A fitted model of one of three kinds. The pipeline does all of it, from nulls to the target's own unit, so it can be saved whole."""

    model: PipelineModel
    kind: str
    scale: Mapping[str, tuple[float, float]]
    numbers: tuple[str, ...]
    categories: tuple[str, ...]
    target: str

    def predict(self, rows: DataFrame, out: str = "predicted") -> DataFrame:
        """Add the prediction, and with the baseline the `level` it comes from. A category that training lacked has no effect of its own."""
        keep = [c for c in rows.columns if c != out and (c != "level" or self.kind != "baseline")]
        scored = self.model.transform(rows.select(*[F.col(f"`{c}`") for c in keep]))
        return scored.select(*[F.col(f"`{c}`") for c in keep], F.col("predicted").alias(out), *(["level"] if self.kind == "baseline" else []))

    def standardised(self, rows: DataFrame) -> DataFrame:
        """`rows` with `_z_<number>` as the model sees them: nulls filled, centred, divided by the training spread."""
        for stage in self.model.stages[:2]:
            if isinstance(stage, (GroupMedianModel, SQLTransformer)):
                rows = stage.transform(rows)
        return rows.drop(*[f"_f_{c}" for c in self.numbers])

    def stage(self, kind: type):
        return next(s for s in self.model.stages if isinstance(s, kind))


def _fit(kind: str, train: DataFrame, numbers: Sequence[str], categories: Sequence[str], target: str, regressor: Callable, groups: tuple[str, str] | None) -> Fitted:
    imputer = GroupMedianImputer(columns=list(numbers), brand=groups[0], segment=groups[1]).fit(train) if groups else None
    seen = {c: f"_f_{c}" if groups else c for c in numbers}
    rows = imputer.transform(train) if imputer else train
    every = {**seen, target: target}
    one = rows.agg(F.count("*").alias("n"), *[f(at).alias(f"{f.__name__}_{c}") for c, at in every.items() for f in (F.avg, F.stddev_pop)]).first()
    if not one["n"]:
        raise ValueError("no training rows")
    spread = lambda s: s if s is not None and s > 1e-12 else 1.0
    scale = {c: (one[f"avg_{c}"] or 0.0, spread(one[f"stddev_pop_{c}"])) for c in every}
    z = ", ".join(f"(`{at}` - {scale[c][0]!r}D) / {scale[c][1]!r}D AS `_z_{c}`" for c, at in seen.items())
    index = StringIndexer(inputCols=list(categories), outputCols=[f"_i_{c}" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc")
    # The slot kept for unknown categories is the one dropped, so all fitted levels stay and unknown ones are zeros.
    hot = OneHotEncoder(inputCols=[f"_i_{c}" for c in categories], outputCols=[f"_h_{c}" for c in categories], dropLast=True)
    vector = VectorAssembler(inputCols=[*[f"_z_{c}" for c in numbers], *[f"_h_{c}" for c in categories]], outputCol="_x")
    mean, wide = scale[target]
    estimator = regressor(one["n"]).setFeaturesCol("_x").setLabelCol("_t").setPredictionCol("_p")
    scaled = SQLTransformer(statement=f"SELECT *, {z} FROM __THIS__") if numbers else None
    stages = [*([scaled] if scaled else []), index, hot, vector, estimator, SQLTransformer(statement=f"SELECT *, _p * {wide!r}D + {mean!r}D AS predicted FROM __THIS__")]
    fitted = Pipeline(stages=stages).fit(rows.withColumn("_t", (F.col(target) - mean) / wide))
    return Fitted(PipelineModel([*([imputer] if imputer else []), *fitted.stages]), kind, scale, tuple(numbers), tuple(categories), target)


def fit_baseline(train: DataFrame, brand: str, segment: str, target: str) -> Fitted:
    """The mean of brand and segment, else of brand, else of segment, else of all training rows."""
    model = GroupMean(columns=[target], brand=brand, segment=segment).fit(train)
    return Fitted(PipelineModel([model]), "baseline", {}, (), (brand, segment), target)


def fit_ridge(train: DataFrame, numbers: Sequence[str], categories: Sequence[str], target: str, alpha: float = 1.0, groups: tuple[str, str] | None = None) -> Fitted:
    """Ridge regression in closed form, penalty `alpha` on the sum of squares, free intercept.

    With `groups` (brand, segment), null numbers are filled with training medians in training and scoring; without, numbers hold no nulls."""
    return _fit("ridge", train, numbers, categories, target, lambda n: LinearRegression(solver="normal", elasticNetParam=0.0, regParam=alpha / n, standardization=False), groups)


def fit_forest(train: DataFrame, numbers: Sequence[str], categories: Sequence[str], target: str, trees: int = 200, seed: int = 73, groups: tuple[str, str] | None = None) -> Fitted:
    """A random forest on 80 % of the features a split; leaves of one row below 20 training rows, else of two. `groups` as for ridge."""
    return _fit("forest", train, numbers, categories, target, lambda n: RandomForestRegressor(numTrees=trees, minInstancesPerNode=1 if n < 20 else 2, featureSubsetStrategy="0.8", seed=seed), groups)


def importance(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """`feature, importance, signed_effect, method` of a model: shares of its source features that sum to 1.

    Ridge has the absolute coefficients and their sum in units of the target, a forest its own importances; slots of
    the vector go back to their source by the names that the assembler gave them. The baseline is one factor. `rows`
    names the columns alone, none of it is read. A model without any weight has shares of 0.
    """
    spark = rows.sparkSession
    schema = "feature string, importance double, signed_effect double, method string"
    if fitted.kind == "baseline":
        return spark.createDataFrame([("marca_y_categoria", 1.0, None, "media_histórica_marca_segmento")], schema)
    attributes = fitted.model.transform(rows.limit(0)).schema["_x"].metadata["ml_attr"]["attrs"]
    slots = {a["idx"]: a["name"] for some in attributes.values() for a in some}
    if fitted.kind == "ridge":
        wide = fitted.scale[fitted.target][1]
        signed = [float(w) * wide for w in fitted.stage(LinearRegressionModel).coefficients]
        weights, method = [abs(w) for w in signed], "coeficientes_ridge"
    else:
        weights, method = list(fitted.stage(RandomForestRegressionModel).featureImportances.toArray()), "importancia_random_forest"
        signed = [None] * len(weights)
    sources = {f"_z_{c}": c for c in fitted.numbers}
    hot = sorted(fitted.categories, key=len, reverse=True)
    source = [sources.get(slots[i]) or next(c for c in hot if slots[i].startswith(f"_h_{c}_")) for i in range(len(weights))]
    long = spark.createDataFrame(list(zip(source, map(float, weights), signed)), "feature string, w double, s double")  # one row a slot
    known = spark.createDataFrame([(c,) for c in (*fitted.numbers, *fitted.categories)], "feature string")
    each = known.join(long.groupBy("feature").agg(F.sum("w").alias("w"), F.sum("s").alias("s")), "feature", "left")
    total = float(sum(weights))
    share = F.round(F.coalesce("w", F.lit(0.0)) / total, 6) if total > 0 else F.lit(0.0)
    effect = F.round(F.coalesce("s", F.lit(0.0)), 6) if fitted.kind == "ridge" else F.lit(None).cast("double")
    return each.select("feature", share.alias("importance"), effect.alias("signed_effect"), F.lit(method).alias("method"))


def select_model(errors: Mapping[str, float | None], margin: float = 0.1) -> str:
    return selection(errors, margin)[0]


def selection(errors: Mapping[str, float | None], margin: float = 0.1, validated: bool = True) -> tuple[str, str, float | None]:
    """(model, reason, share by which the forest's error is below ridge's) of `baseline, ridge, forest`.

    The least validation error wins, the simpler model on ties. The forest stands for election only against a ridge
    with a known error above 0, when its error is lower by more than `margin` of it. Without validation rows or any
    known error the baseline stays.
    """
    known = {k: float(errors[k]) for k in ("baseline", "ridge", "forest") if errors.get(k) is not None}
    if not validated:
        return "baseline", "no_validation", None
    forest = known.pop("forest", None)
    gain = (known["ridge"] - forest) / known["ridge"] if forest is not None and known.get("ridge", 0.0) > 0 else None
    worth = gain is not None and gain > margin
    if not known:
        return "baseline", "no_valid_metric", gain
    if worth:
        known["forest"] = forest
    chosen = min(known, key=known.__getitem__)  # in order of simplicity
    if chosen == "ridge" and gain is not None and not worth:
        return chosen, "forest_gain_below_margin", gain
    if chosen == "baseline" and worth:
        return chosen, "baseline_beats_eligible_forest", gain
    return chosen, "least_error", gain


def shapley_values(rows: DataFrame, row_id: str, reference: Mapping[str, object], predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`row_id, base, predicted` and `effect_<feature>`: exact Shapley values against one reference row, at most ten features.

    Every coalition is one copy of the row, all are predicted in one pass by `predict` (adds `predicted`), and an effect is
    a weighted sum over the coalitions: no pairs of coalitions are joined. Row ids are unique.
    """
    features, k = list(reference), len(reference)
    if not 1 <= k <= 10:
        raise ValueError("one to ten features")
    masks = rows.withColumn("_mask", F.explode(F.sequence(F.lit(0), F.lit(2**k - 1))))
    bit = [F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(k)]
    types = dict(rows.dtypes)
    masks = masks.withColumns({f: F.when(bit[i], F.col(f)).otherwise(F.lit(reference[f]).cast(types[f])) for i, f in enumerate(features)})
    weight = F.array(*[F.lit(1 / (k * comb(k - 1, s))) for s in range(k)])
    size = F.bit_count("_mask")
    signed = [F.when(bit[i], F.get(weight, size - 1)).otherwise(-F.get(weight, size)) * F.col("predicted") for i in range(k)]
    whole = [F.max(F.when(F.col("_mask") == m, F.col("predicted"))).alias(name) for m, name in ((0, "base"), (2**k - 1, "predicted"))]
    return predict(masks).groupBy(row_id).agg(*whole, *[F.sum(s).alias(f"effect_{f}") for s, f in zip(signed, features)])


def mature_reference(requests: DataFrame, rows: DataFrame, brand: str, segment: str, year: str, value: str, gap: int = 3) -> DataFrame:
    """Per distinct request `brand, segment, year`: mean of rows at least `gap` years older, of brand and segment, else brand, else all.

    `level` says which; without any it is null. Decimal values are summed exactly. Running sums over years stand for refitting each request year.
    """
    asked = requests.select(brand, segment, year).distinct()
    out = asked
    for name, keys in (("brand_segment", [brand, segment]), ("brand", [brand]), ("market", [])):
        sums = rows.groupBy(*keys, year).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
        both = sums.unionByName(asked.select(*keys, year).distinct().withColumns({"s": F.lit(0).cast(dict(sums.dtypes)["s"]), "c": F.lit(0)}))
        by_year = both.groupBy(*keys, year).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))  # market: one row a year
        older = Window.partitionBy(*keys).orderBy(year).rangeBetween(Window.unboundedPreceding, -gap)
        mean = by_year.select(*keys, year, (F.sum("s").over(older).cast("double") / F.nullif(F.sum("c").over(older), F.lit(0))).alias(f"_{name}"))
        out = out.join(mean, [*keys, year], "left")
    names = ("brand_segment", "brand", "market")
    level = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in names])
    return out.select(brand, segment, year, F.coalesce(*[f"_{n}" for n in names]).alias("reference"), level.alias("level"))
