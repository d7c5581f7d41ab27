"""Sets of named tables that are replaced together, bucketed so that joins by their keys move no row."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

_VERSION = re.compile(r"_v(\d+)$")


def _named(*names: str) -> None:
    if bad := [n for n in names if not re.fullmatch("[a-z][a-z0-9_]*", n)]:
        raise ValueError(f"not a table name: {bad}")


def versions(spark: SparkSession, group: str) -> list[int]:
    """The versions of which any table is there, written whole or not, in order."""
    _named(group)
    listed = [t.name for t in spark.catalog.listTables(pattern=f"{group}__*_v*")]
    return sorted({int(m[1]) for n in listed if (m := _VERSION.search(n))})


def current_version(spark: SparkSession, group: str) -> int | None:
    """The version that readers see; null before the first."""
    return spark.table(f"{group}__current").first()["version"] if spark.catalog.tableExists(f"{group}__current") else None


def write_set(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], group: str, root: str, buckets: int = 64) -> int:
    """Write the tables as a new version of the set `group` under `root`, then switch readers to it; return the version.

    Each table is dealt and sorted by its `keys` into as many buckets as the others, one file a bucket, so that tables
    with equal keys meet, and are grouped by them, without a shuffle. Keys are ids, which few rows share: rows of one key
    are in one bucket. The switch is one view, made after the last table is whole: a reader has all tables of
    one version, and a failed or repeated write changes nothing that is read. `buckets` is for the largest table and the
    same at every write of tables that are to be joined. An empty set is refused; an empty table is a table.
    """
    if not tables or set(tables) - set(keys):
        raise ValueError("a set has tables, and each has keys")
    _named(group, *tables)
    spark = next(iter(tables.values())).sparkSession
    new = max(versions(spark, group), default=0) + 1
    for name, rows in tables.items():
        table = f"{group}__{name}_v{new}"
        dealt = rows.repartition(buckets, *keys[name])
        dealt.write.bucketBy(buckets, *keys[name]).sortBy(*keys[name]).option("path", f"{root}/{table}").mode("overwrite").saveAsTable(table)
    spark.sql(f"CREATE OR REPLACE VIEW {group}__current AS SELECT {new} AS version")
    return new


def read_set(spark: SparkSession, group: str, *names: str, version: int | None = None) -> dict[str, DataFrame]:
    """The named tables of one version of the set, the current one if none is said."""
    _named(group, *names)
    at = version if version is not None else current_version(spark, group)
    if at is None:
        raise ValueError(f"no version of {group} is written")
    return {n: spark.table(f"{group}__{n}_v{at}") for n in names}


def drop_old(spark: SparkSession, group: str) -> list[int]:
    """Take the versions other than the current one out of the catalog; their files stay, as running readers may have them open."""
    now = current_version(spark, group)
    old = [v for v in versions(spark, group) if v != now]
    for t in spark.catalog.listTables(pattern=f"{group}__*_v*"):
        if int(_VERSION.search(t.name)[1]) in old:
            spark.sql(f"DROP TABLE {t.name}")
    return old
