"""What the operators of this subpackage have in common: scratch tables, word rules, column guards."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters: space, \t, \n, \v, \f, \r.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Shuffle files go when the write that needed them has ended: the Parquet table takes their place.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-cohortscore-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession):
    """The shuffle files of what is defined and run inside go as soon as it has run."""
    return _set(spark, CLEANUP, "true")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cohortscore/{name}-{uuid.uuid4().hex}"
    with _set(spark, CLEANUP, "true"):
        df.write.options(**options).parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing will read again: all that was made from them is itself written."""
    for df in tables:
        if (path := _path_of.pop(df, None)) in _written:
            _written.remove(path)
            _delete(df.sparkSession, path)


def drop_written(spark: SparkSession) -> int:
    """Delete the scratch tables of this driver. Call it once the results that read them are stored."""
    n = 0
    while _written:
        _delete(spark, _written.pop())
        n += 1
    return n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where Spark would write its expression into a lambda function for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_slices(batches, rows: int = 256):
    """Arrow batches in slices of few rows: what Python makes of a slice (word lists, arrays) stays small beside the batch."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)
