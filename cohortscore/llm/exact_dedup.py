"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscore.llm.shared import text_or_empty, written


def _surviving(docs: DataFrame, text_col: str, prefix_chars: int) -> tuple[DataFrame, DataFrame]:
    """The lengths that occur twice, and of rows with such a length the (length, prefix hash) keys that occur twice.

    Both are written, so Spark knows their size when it plans the joins with them: a table under the session's
    broadcast threshold is broadcast and filters at the scan, where the next level reads only what it lets
    through; a larger one meets the rows in a shuffle.
    """
    lengths = docs.select(F.octet_length(text_or_empty(text_col)).alias("len")).groupBy("len").count().filter("count > 1").select("len")
    lengths = written(lengths, "exact-lengths")
    keys = _prefixed(docs, lengths, text_col, prefix_chars).select("len", "prefix").groupBy("len", "prefix").count().filter("count > 1").select("len", "prefix")
    return lengths, written(keys, "exact-prefixes")


def _prefixed(docs: DataFrame, lengths: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """Rows of `docs` whose length is in `lengths`, as `row, text, len, prefix`."""
    rows = docs.select(F.struct("*").alias("row"), text_or_empty(text_col).alias("text")).withColumn("len", F.octet_length("text"))
    return rows.join(lengths, "len", "left_semi").withColumn("prefix", F.xxhash64(F.substring("text", 1, prefix_chars)))


def _hashed(docs: DataFrame, lengths: DataFrame, keys: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """Rows that survive both levels, as `row, id, len, prefix, sha`: only their whole texts are hashed."""
    rows = _prefixed(docs, lengths, text_col, prefix_chars).join(keys, ["len", "prefix"], "left_semi")
    return rows.select("row", F.col(f"row.`{id_col}`").alias("id"), "len", "prefix", F.sha2("text", 256).alias("sha"))


def _groups(hashed: DataFrame) -> DataFrame:
    groups = hashed.groupBy("len", "prefix", "sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.filter("group_size > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128) -> DataFrame:
    """One row per group of two or more rows with equal texts: `len, prefix, sha, keep_id, group_size`.

    Level 1 counts rows by UTF-8 length alone. Level 2 reads a prefix of the rows whose length occurs twice
    and counts by (length, prefix hash). Level 3 hashes the whole text of the rows that survive both. Every
    level is a partial aggregation, so a group that holds a third of all rows meets as one row for each map
    task, and the survivors come back by semi joins.

    Null texts count as empty. The largest id stays; a null id stays only where the group has no other.
    """
    return _groups(_hashed(docs, *_surviving(docs, text_col, prefix_chars), id_col, text_col, prefix_chars))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128) -> DataFrame:
    """Decide for every row: `id, keep_id, group_size, kept, text_sha256`.

    Equal means identical UTF-8 bytes; null counts as empty; no text is altered or cut. The row with the
    largest id of a group stays. Rows repeated with one id and one text all carry that id, so they stay
    together. A row with a null id stays only when its whole group has null ids. No rows give no rows, and
    other columns of the input, whatever their names, play no part.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"))
    groups = exact_groups(docs, id_col, text_col, prefix_chars).select(F.col("sha").alias("text_sha256"), F.col("keep_id").alias("group_keep"), F.col("group_size").alias("n"))
    joined = rows.join(groups, "text_sha256", "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("group_keep"))
    return joined.select("id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Rows that repeat one id and one text stay as one only if `docs` had one.

    Rows that no length or prefix puts beside another pass without a hash of their text and, while the keys can
    be broadcast, without a shuffle; only survivors meet their groups.
    """
    lengths, keys = _surviving(docs, text_col, prefix_chars)
    hashed = _hashed(docs, lengths, keys, id_col, text_col, prefix_chars)
    groups = written(_groups(hashed).select("sha", "keep_id"), "exact-groups")
    stays = F.col("keep_id").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    text = text_or_empty(text_col)
    apart = docs.select(F.struct("*").alias("row"), F.octet_length(text).alias("len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"))
    apart = apart.join(keys, ["len", "prefix"], "left_anti")
    return apart.select("row.*").unionAll(hashed.join(groups, "sha", "left").filter(stays).select("row.*"))
