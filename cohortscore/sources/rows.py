"""Row numbers of source files: counted per block of a file, added up, and given back to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(raw: DataFrame, name: str = "row", first: int = 1, per_file: bool = False) -> DataFrame:
    """`raw` with the number of each row as `name`, in the order of the files' paths and of the rows in them.

    `raw` is what a file source returns, before any filter, join or shuffle. Parquet knows the place of a row in its
    file. Of other sources each block of a file is read by one task in order, so rows are counted per block, the
    counts of the blocks before are added up, and a block's sum goes to its rows: no row is sorted or moved, and
    only tables with a row for each block and file pass a window. With `per_file` each file begins at `first`.
    Empty files have no rows and no numbers. A column called `name` is replaced.
    """
    known = {f.name for f in raw.select("_metadata").schema[0].dataType.fields}
    exact = "row_index" in known
    place = F.col("_metadata.row_index") if exact else F.monotonically_increasing_id()
    block = F.lit(0).cast("long") if exact else F.col("_metadata.file_block_start")
    kept = [c for c in raw.columns if c not in (name, "_metadata")]
    rows = raw.select(*[F.col(f"`{c}`") for c in kept], F.col("_metadata.file_path").alias("_file"), block.alias("_block"), place.alias("_place"))
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_place").alias("_least"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if not per_file:
        files = blocks.groupBy("_file").agg(F.sum("_n").alias("_n"))  # one row a file
        above = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        files = files.select("_file", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
        blocks = blocks.join(files, "_file")
    else:
        blocks = blocks.withColumn("_above", F.lit(0))
    number = F.col("_place") - F.col("_least") + F.col("_before") + F.col("_above") + first
    return rows.join(blocks.drop("_n"), ["_file", "_block"]).select(*[F.col(f"`{c}`") for c in kept], number.alias(name))
