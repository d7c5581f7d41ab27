"""Training as one operation, models that are saved and read again, and the audit of a saved model.

A frame to train on has one row for each `id` with brand, segment, year, the raw score that the target is made from, a
flag of mature labels, numbers and further categories. Its columns are named once, in a `Frame`.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortscore.functions.text import direction
from cohortscore.operators import audits as A
from cohortscore.operators import cohorts as C
from cohortscore.operators import models as M
from cohortscore.operators import training as R
from cohortscore.operators.checks import training_violations
from cohortscore.operators.estimators import prepare_features
from cohortscore.operators.matching import enforce
from cohortscore.operators.scratch import settled

TARGET = "index_100"


@dataclass(frozen=True)
class Frame:
    """The names of a training frame's columns."""

    id: str
    brand: str
    segment: str
    year: str
    raw: str
    mature: str
    numbers: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()

    def features(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(numbers, categories): what a model may see, and nothing else."""
        return self.numbers, tuple(dict.fromkeys((self.brand, self.segment, *self.categories)))

    def fingerprint(self, rows: DataFrame) -> str:
        """That of the columns of the contract, without the scaled target, whatever the order of rows."""
        columns = sorted({self.id, self.year, self.raw, self.mature, *self.numbers, *self.features()[1]})
        return A.fingerprint(rows, columns).first()["digest"]


@dataclass(frozen=True)
class Frozen:
    """A chosen model, the table of its target's scale, and what was recorded when it was made."""

    fitted: M.Fitted
    scale: DataFrame
    facts: Mapping[str, object]

    def save(self, path: str) -> None:
        """Write the model, the scale and the facts below `path`, once: a second write fails."""
        self.fitted.model.save(f"{path}/model")
        self.scale.write.parquet(f"{path}/scale")
        spark = self.scale.sparkSession
        spark.createDataFrame([(json.dumps(dict(self.facts), sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Frozen:
        """The model as it was saved, in this session or any later one."""
        facts = json.loads(spark.read.text(f"{path}/facts", wholetext=True).first()["value"])
        model = facts["model"]
        fitted = M.Fitted(PipelineModel.load(f"{path}/model"), model["kind"], {k: tuple(v) for k, v in model["scale"].items()}, tuple(model["numbers"]), tuple(model["categories"]), model["target"])
        return Frozen(fitted, spark.read.parquet(f"{path}/scale"), facts)


def _fits(frame: Frame, kinds: Sequence[str], trees: int) -> dict:
    numbers, categories = frame.features()
    groups = (frame.brand, frame.segment)
    every = {
        "baseline": lambda rows: M.fit_baseline(rows, *groups, TARGET),
        "ridge": lambda rows: M.fit_ridge(rows, numbers, categories, TARGET, groups=groups),
        "forest": lambda rows: M.fit_forest(rows, numbers, categories, TARGET, trees=trees, groups=groups),
    }
    return {k: every[k] for k in kinds}


def candidate_errors(rows: DataFrame, models: Mapping[str, M.Fitted], observed: str) -> dict[str, dict[str, float | None]]:
    """`n, mae, rmse` of each model over the rows with finite pairs: all models add their prediction to the same rows, and one
    aggregation measures them."""
    scored = rows
    for kind, fitted in models.items():
        scored = fitted.predict(scored, f"_p_{kind}").drop("level")
    aggregates = []
    for kind in models:
        e = F.col(f"_p_{kind}") - F.col(observed)
        e = F.when(~F.isnan(e) & (F.abs(e) < float("inf")), e)
        aggregates += [F.count(e).alias(f"n_{kind}"), F.avg(F.abs(e)).alias(f"mae_{kind}"), F.sqrt(F.avg(e * e)).alias(f"rmse_{kind}")]
    one = scored.agg(*aggregates).first()
    return {kind: {m: one[f"{m}_{kind}"] for m in ("n", "mae", "rmse")} for kind in models}


def train_model(rows: DataFrame, frame: Frame, train_end: int, validation_end: int, adaptive: bool = True, years: int = 3, margin: float = 0.1, kinds: Sequence[str] = ("baseline", "ridge", "forest"), trees: int = 200, first: int = 1995, last: int = 2100) -> Frozen:
    """Check the frame, split it, rebuild the target with the training scale, fit, select, fit again, and measure the test.

    A model sees the features of `frame` alone, filled and standardised by training rows. Candidates are measured on
    validation rows, the chosen one is fitted again on training and validation rows, and its error on test rows is
    recorded. A frame that breaks the contract, or without training rows, is refused. The scale of the target stays
    that of the training rows.
    """
    broken = training_violations(rows, [frame.id], frame.year, frame.raw, frame.numbers, frame.mature, first, last)
    enforce(broken.filter("n > 0"), "the training frame breaks its contract")
    last_train, last_validation, strategy = R.adaptive_cuts(rows, frame.year, train_end, validation_end, adaptive)
    split = C.temporal_split(rows, frame.year, last_train, last_train if last_validation is None else last_validation, years)
    scale = settled(C.fit_scale(split.filter("partition = 'train'"), frame.segment, frame.raw))
    numbers, categories = frame.features()
    labelled = C.scaled_index(split, scale, frame.segment, frame.raw)
    labelled = settled(prepare_features(labelled, [frame.id, frame.year, "partition", TARGET], numbers, categories))
    part = {p: labelled.filter(F.col("partition").isin(*of)) for p, of in (("train", ["train"]), ("validation", ["validation"]), ("both", ["train", "validation"]), ("test", ["test"]))}
    sizes = {r["partition"]: r.asDict() for r in labelled.groupBy("partition").agg(F.count("*").alias("rows"), F.min(frame.year).alias("min_year"), F.max(frame.year).alias("max_year")).collect()}
    none = {"rows": 0, "min_year": None, "max_year": None}
    if "train" not in sizes:
        raise ValueError("no training rows")
    fits = _fits(frame, kinds, trees)
    validated = "validation" in sizes
    errors = candidate_errors(part["validation"], {k: f(part["train"]) for k, f in fits.items()}, TARGET) if validated else {}
    chosen, reason, gain = M.selection({k: e["mae"] for k, e in errors.items()}, margin, validated)
    fitted = fits[chosen](part["both"])
    tested = candidate_errors(part["test"], {chosen: fitted}, TARGET)[chosen] if "test" in sizes else {"n": 0, "mae": None, "rmse": None}
    last_fit = max(sizes[p]["max_year"] for p in ("train", "validation") if p in sizes)
    facts = {
        "model": {"kind": fitted.kind, "scale": {k: list(v) for k, v in fitted.scale.items()}, "numbers": list(fitted.numbers), "categories": list(fitted.categories), "target": fitted.target},
        "frame": asdict(frame), "fingerprint": frame.fingerprint(rows), "strategy": strategy, "cuts": [last_train, last_validation], "window_years": years,
        "split": {p: {k: v for k, v in sizes.get(p, none).items() if k != "partition"} for p in ("train", "validation", "test", "train_embargoed", "validation_embargoed")},
        "validation": errors, "test": tested, "reason": reason, "forest_gain": gain, "available_from": last_fit + years, "scale_last_year": sizes["train"]["max_year"],
    }
    return Frozen(fitted, scale, facts)


def denominator_problems(facts: Mapping) -> list[str]:
    """What keeps the metrics of a training from publication: numbers of rows that its parts and its measures do not agree on.

    `test_denominator`: the test was measured over another number of rows than the part has. `validation_denominator`,
    with the model's name, likewise. `no_rows`: a part that a measure is stated for is empty. `years`: a part ends before
    it begins, or begins before the one before has ended.
    """
    split, found = facts["split"], []
    if facts["test"]["mae"] is not None and facts["test"]["n"] != split["test"]["rows"]:
        found.append("test_denominator")
    found += [f"validation_denominator:{k}" for k, e in facts["validation"].items() if e["mae"] is not None and e["n"] != split["validation"]["rows"]]
    if not split["train"]["rows"] or facts["validation"] and not split["validation"]["rows"]:
        found.append("no_rows")
    spans = [(p["min_year"], p["max_year"]) for p in (split["train"], split["validation"], split["test"]) if p["rows"]]
    if any(a > b for a, b in spans) or any(one[1] >= two[0] for one, two in zip(spans, spans[1:])):
        found.append("years")
    return found


def _test_rows(rows: DataFrame, frame: Frame, facts: Mapping) -> DataFrame:
    test = facts["split"]["test"]
    low, high = (test["min_year"], test["max_year"]) if test["rows"] else (1, 0)
    return rows.filter(F.col(frame.year).between(low, high))


def frozen_problems(rows: DataFrame, frame: Frame, facts: Mapping) -> DataFrame:
    """`rule, detail`: why a saved model cannot be audited on these rows; empty if it can.

    `bad_id` (null or repeated), `fingerprint_differs`, `no_test_partition`, `bad_year` (null or not whole),
    `test_count_differs`, `immature_test`, `available_too_late` (after the first test year), `scale_knows_test` (the
    scale's labels were not mature before it). One aggregation over the rows, one over their ids, and the fingerprint.
    """
    test, gap = facts["split"]["test"], facts["window_years"]
    year = F.col(frame.year).cast("double")
    one = rows.agg(F.count_if(F.col(frame.id).isNull()).alias("no_id"), F.count_if(~F.coalesce(year == F.floor(year), F.lit(False))).alias("bad_year"))
    of = _test_rows(rows, frame, facts).agg(F.count("*").alias("n"), F.min(frame.year).alias("first"), F.count_if(~F.coalesce(F.col(frame.mature), F.lit(False))).alias("immature"))
    twice = rows.groupBy(frame.id).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("repeated"))
    k = lambda df: df.withColumn("_k", F.lit(1))
    joined = k(one).join(k(of), "_k").join(k(twice), "_k")  # one row each
    now = frame.fingerprint(rows)
    available, scale_last = facts.get("available_from"), facts["scale_last_year"]

    def rule(name: str, broken: Column, detail: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))

    found = F.array_compact(F.array(
        rule("bad_id", (F.col("no_id") > 0) | (F.col("repeated") > 0), F.col("no_id") + F.col("repeated")),
        rule("fingerprint_differs", F.lit(now != facts["fingerprint"]), F.lit(now)),
        rule("no_test_partition", F.lit(not test["rows"]), F.lit("0")),
        rule("bad_year", F.col("bad_year") > 0, F.col("bad_year")),
        rule("test_count_differs", F.lit(bool(test["rows"])) & (F.col("n") != test["rows"]), F.col("n")),
        rule("immature_test", F.col("immature") > 0, F.col("immature")),
        rule("available_too_late", F.lit(available is None) | (F.lit(available) > F.col("first")), F.lit(available)),
        rule("scale_knows_test", F.lit(scale_last + gap) > F.col("first"), F.lit(scale_last)),
    ))
    return joined.select(F.explode(found).alias("p")).select("p.rule", "p.detail")


def audit_frozen(rows: DataFrame, model: Frozen, small: int = 30) -> DataFrame:
    """`dimension, group, n, mae, rmse, bias, is_small` of a saved model over the recorded test years: of all, by brand, segment
    and year, and for the baseline by the level that supports a score and by whether the brand is represented.

    The target is scaled by the saved table. Rows that `frozen_problems` objects to are refused. Nothing is fitted.
    """
    frame = Frame(**{k: tuple(v) if isinstance(v, list) else v for k, v in model.facts["frame"].items()})
    enforce(frozen_problems(rows, frame, model.facts), "the model cannot be audited on these rows")
    numbers, categories = frame.features()
    test = C.scaled_index(_test_rows(rows, frame, model.facts), model.scale, frame.segment, frame.raw)
    scored = model.fitted.predict(prepare_features(test, [frame.id, frame.year, TARGET], numbers, categories))
    sets = [[], [frame.brand], [frame.segment], [frame.year]]
    if model.fitted.kind == "baseline":
        shown = F.when(F.col("level").isin("brand_segment", "brand"), "represented_brand").otherwise("unrepresented_brand")
        scored = scored.withColumn("serving_support", shown)
        sets += [["level"], ["serving_support"]]
    keys = [s[0] for s in sets if s]
    errors = C.error_summary(scored.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys}), TARGET, "predicted", sets)
    dimension = F.coalesce(*[F.when(F.col(k).isNotNull(), k) for k in keys], F.lit("all"))
    return errors.select(dimension.alias("dimension"), F.coalesce(*keys, F.lit("all")).alias("group"), "n", "mae", "rmse", "bias", (F.col("n") < small).alias("is_small"))


def window_results(rows: DataFrame, frame: Frame, windows: Sequence[tuple[int, int, int]], years: int = 3, **options) -> DataFrame:
    """`window, status, reason, model, n_train, n_validation, n_test, mae, rmse`: training, selection and test of each window on its own.

    A window sees rows up to its last test year and scales its target by its own training rows, so errors of windows are
    not to be pooled. One that lacks a part, or whose frame is refused, is `not_evaluable` with its reason.
    """
    if not windows:
        raise ValueError("no windows")
    spark = rows.sparkSession
    enforce(R.window_violations(spark.createDataFrame(windows, "train_end int, validation_end int, test_end int")), "the windows break the protocol")
    out = []
    for a, b, c in windows:
        row = [f"{a}-{b}-{c}", "not_evaluable", None, None, 0, 0, 0, None, None]
        try:
            facts = train_model(rows.filter(F.col(frame.year) <= c), frame, a, b, adaptive=False, years=years, **options).facts
            row[4:7] = [facts["split"][p]["rows"] for p in ("train", "validation", "test")]
            if all(row[4:7]):
                row[1:4] = ["evaluated", facts["reason"], facts["model"]["kind"]]
                row[7:] = [facts["test"]["mae"], facts["test"]["rmse"]]
            else:
                row[2] = "a part has no rows"
        except ValueError as refused:
            row[2] = str(refused)
        out.append(tuple(row))
    return spark.createDataFrame(out, "window string, status string, reason string, model string, n_train long, n_validation long, n_test long, mae double, rmse double")


def explanations(rows: DataFrame, model: Frozen, train: DataFrame, reference: Mapping[str, object], top: int = 3) -> DataFrame:
    """`id, place, feature, value, effect, direction, method`: the factors of each score, by the way that fits the model.

    The baseline names the group it used and its distance from the mean of `train` (which has the target). Ridge has
    its coefficients times the distance from the reference row, the forest exact Shapley values against it. `value` is
    what was observed, null where nothing was. At most `top` factors by absolute effect, names settling ties.
    """
    frame = Frame(**{k: tuple(v) if isinstance(v, list) else v for k, v in model.facts["frame"].items()})
    numbers, categories = frame.features()
    asked = prepare_features(rows, [frame.id], numbers, categories)
    if model.fitted.kind == "baseline":
        told = R.baseline_explanation(model.fitted.predict(asked), train, frame.brand, frame.segment, TARGET)
        return told.select(frame.id, F.lit(1).alias("place"), F.col("level").alias("feature"), "value", "effect", "direction", F.lit("media_grupo_vs_media_global_train").alias("method"))
    if model.fitted.kind == "ridge":
        effects, method = R.ridge_attribution(asked, model.fitted, categories, reference, R.ridge_coefficients(model.fitted, categories, train)), "coeficiente_por_distancia"
    else:
        effects, method = M.shapley_values(asked, frame.id, reference, model.fitted.predict), "shapley_exacto"
    features = [*numbers, *categories]
    long = effects.select(frame.id, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"effect_{f}").alias("effect")) for f in features])))
    seen = asked.select(frame.id, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])))
    place = F.row_number().over(Window.partitionBy(frame.id).orderBy(F.desc(F.abs(F.col("effect"))), "feature"))
    best = long.withColumn("place", place).filter(F.col("place") <= top).withColumn("direction", direction(F.col("effect")))
    return best.join(seen, [frame.id, "feature"]).select(frame.id, "place", "feature", "value", "effect", "direction", F.lit(method).alias("method"))
