"""Stages of ML pipelines that hold a table of fitted groups, and can be saved with the pipeline and read in another session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscore.operators.audits import exact_quantiles
from cohortscore.operators.scratch import settled


class _Groups(Params):
    """What the stages have in common: the brand, the segment and the columns that they read."""

    brand = Param(Params._dummy(), "brand", "column of the brand", TypeConverters.toString)
    segment = Param(Params._dummy(), "segment", "column of the segment", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "columns that are summed up", TypeConverters.toListString)
    prefix = Param(Params._dummy(), "prefix", "what an output column's name has before the input's", TypeConverters.toString)

    def _of(self, name: str):
        return self.getOrDefault(name)


class _TableWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(DefaultParamsReader):
    def load(self, path: str):
        stage = super().load(path)
        stage.table = SparkSession.getActiveSession().read.parquet(f"{path}/table")
        return stage


class _TableModel(_Groups, Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted stage whose `table` has one row for each group: `level, brand, segment` and values. Level 0 is brand and
    segment, 1 segment, 2 brand, 3 all; the keys that a level lacks are null."""

    table: DataFrame

    def write(self) -> _TableWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> _TableReader:
        return _TableReader(cls)

    def _joined(self, rows: DataFrame, levels: Sequence[int], values: Sequence[str]) -> DataFrame:
        """`rows` with `_<value><level>` of the groups of each level. The last level is one row."""
        on = {0: ("brand", "segment"), 1: ("segment",), 2: ("brand",), 3: ()}
        for level in levels:
            keys = [(self._of(k), F.col(k)) for k in on[level]]
            at = self.table.filter(F.col("level") == level).select(*[c.alias(n) for n, c in keys], *[F.col(v).alias(f"_{v}{level}") for v in values])
            if keys:
                rows = rows.join(at, [n for n, _ in keys], "left")
            else:
                rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(at.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
        return rows


def _levels(rows: DataFrame, brand: str, segment: str, levels: Sequence[int]) -> DataFrame:
    """Every row once for each level, with `level, brand, segment` of its group; a null key belongs to no group of that key."""
    b, s, none = F.col(brand).cast("string"), F.col(segment).cast("string"), F.lit(None).cast("string")
    keys = {0: (b, s), 1: (none, s), 2: (b, none), 3: (none, none)}
    parts = [F.when(F.lit(level == 3) | (F.lit(level == 1) | b.isNotNull()) & (F.lit(level == 2) | s.isNotNull()), F.struct(F.lit(level).alias("level"), keys[level][0].alias("brand"), keys[level][1].alias("segment"))) for level in levels]
    return rows.withColumn("_g", F.explode(F.array_compact(F.array(*parts)))).select("*", "_g.level", "_g.brand", "_g.segment").drop("_g")


class GroupMedianModel(_TableModel):
    """Fills nulls with the training median of brand and segment, else of the segment, else of all, else 0."""

    def _transform(self, rows: DataFrame) -> DataFrame:
        columns, prefix = self._of("columns"), self._of("prefix")
        keep = rows.columns
        out = self._joined(rows, (0, 1, 3), columns)
        filled = {f"{prefix}{c}": F.coalesce(F.col(c).cast("double"), *[F.col(f"_{c}{level}") for level in (0, 1, 3)], F.lit(0.0)) for c in columns}
        return out.select(*[F.col(f"`{c}`") for c in keep], *[x.alias(n) for n, x in filled.items()])


class GroupMedianImputer(_Groups, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Exact medians of each column at three levels, from counts of values, so that no task holds a group's values.

    Nulls do not count; a column without any value has no median and is filled with 0.
    """

    @keyword_only
    def __init__(self, *, columns=None, brand=None, segment=None, prefix=None):
        super().__init__()
        self._setDefault(prefix="_f_")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, rows: DataFrame) -> GroupMedianModel:
        columns, brand, segment = (self._of(x) for x in ("columns", "brand", "segment"))
        # One long table, so that all columns are counted in the same shuffles.
        long = rows.select(F.col(brand).alias("_b"), F.col(segment).alias("_s"), F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns]))).filter("_v IS NOT NULL")
        levelled = _levels(long, "_b", "_s", (0, 1, 3)).select("_c", "level", "brand", "segment", "_v")
        middle = exact_quantiles(levelled, ["_c", "level", "brand", "segment"], "_v", [0.5])
        wide = middle.groupBy("level", "brand", "segment").agg(*[F.max(F.when(F.col("_c") == c, F.col("q0"))).alias(c) for c in columns])
        model = GroupMedianModel()._set(columns=columns, brand=brand, segment=segment, prefix=self._of("prefix"))
        model.table = settled(wide)
        return model


class GroupMeanModel(_TableModel):
    """Adds `<prefix>` and `level`: the training mean of brand and segment, else of brand, else of segment, else of all."""

    def _transform(self, rows: DataFrame) -> DataFrame:
        (value,) = self._of("columns")
        keep = [c for c in rows.columns if c not in (self._of("prefix"), "level")]
        out = self._joined(rows.select(*[F.col(f"`{c}`") for c in keep]), (0, 2, 1, 3), [value])
        mean = [F.col(f"_{value}{level}") for level in (0, 2, 1, 3)]
        level = F.when(mean[0].isNotNull(), "brand_segment").when(mean[1].isNotNull(), "brand").when(mean[2].isNotNull(), "segment").otherwise("all")
        return out.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(*mean).alias(self._of("prefix")), level.alias("level"))


class GroupMean(_Groups, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """The hierarchical baseline as a pipeline stage: means at four levels in one aggregation."""

    @keyword_only
    def __init__(self, *, columns=None, brand=None, segment=None, prefix=None):
        super().__init__()
        self._setDefault(prefix="predicted")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, rows: DataFrame) -> GroupMeanModel:
        (value,), brand, segment = (self._of(x) for x in ("columns", "brand", "segment"))
        levelled = _levels(rows.select(F.col(brand).alias("_b"), F.col(segment).alias("_s"), F.col(value).alias("_v")), "_b", "_s", (0, 1, 2, 3))
        model = GroupMeanModel()._set(columns=[value], brand=brand, segment=segment, prefix=self._of("prefix"))
        model.table = settled(levelled.groupBy("level", "brand", "segment").agg(F.avg("_v").alias(value)))
        return model


def prepare_features(rows: DataFrame, keys: Sequence[str], numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """`keys`, the numbers as doubles and the categories as lower-case trimmed texts: nothing else reaches a model.

    A number that is no number is null, and one that is not finite is an error. Blank and null categories are
    `__unknown__`. A missing column is an error of the plan.
    """
    def number(c: str):
        x = F.col(c).cast("string").try_cast("double")
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit(f"{c} must be finite or null"))).otherwise(x).cast("double").alias(c)

    def category(c: str):
        x = F.lower(F.regexp_replace(F.col(c).cast("string"), "^\\s+|\\s+\\z", ""))
        return F.coalesce(F.nullif(x, F.lit("")), F.lit("__unknown__")).alias(c)

    return rows.select(*keys, *map(number, numbers), *map(category, categories))
