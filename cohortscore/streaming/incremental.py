"""Incremental load: what is new in a folder of stored responses is added to a table once, whatever is read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load_new(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, digest: Column, order: Sequence[str]) -> int:
    """Add the rows of new files to the table at `target`, one per digest, and return how many it has then.

    Files already seen are known from the checkpoint; a row whose digest the table has is left out, so a batch that runs
    again after a lost driver adds nothing twice. Of equal digests in one batch the first in `order` is kept.
    """

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("digest", digest)
        first = rows.groupBy("digest").agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*", "digest")
        some = spark.read.parquet(target).select("digest") if _exists(spark, target) else None
        (first if some is None else first.join(some, "digest", "left_anti")).select(*batch.columns, "digest").write.mode("append").parquet(target)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).count()


def load_once(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, digest: Column) -> int:
    """Like `load_new`, for targets too large to read at each load: known digests are in the query's state store.

    A load costs what its new files cost: their rows meet the state of their digest (RocksDB, on the executors' disks and
    in the checkpoint), and the target is only added to, by a sink that commits a batch once. The row of an earlier load
    stays; of equal digests in one load any one does, so that no row waits for another. The columns are those of
    `schema` and `digest`. Null parts of a digest are as `digest` takes them. Returns the rows the target has, from the
    footers of its files.
    """
    key, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(schema).parquet(source).withColumn("digest", digest).dropDuplicates(["digest"])
        query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, old)
    return spark.read.parquet(target).count()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
