"""Line dedup: hashes of lines in ranges, sorted by document and position; each document gets a compressed keep bitmap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortscore.llm.shared import ascii_lower, let, text_or_empty, written

#: What is stripped from both ends of a line to make its key. Fixed values.
BLANKS = " \t\n\x0b\f\r"
HASH = ("h1", "h2")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def hashed_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """`h1, h2, id, text_key, pos` of the lines whose key has `min_chars` code points, in rows with an id."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _text_key(text).alias("text_key"), _lines(text).alias("lines")).filter("id IS NOT NULL")
    rows = rows.select("id", "text_key", F.posexplode("lines").alias("pos", "line"))  # the text is hashed once, not for each line
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    keyed = rows.select("id", "text_key", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "text_key", "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, text_key, n_dropped, drop_from, drop_to` of the rows that lose a line: runs of dropped lines, from line to before line.

    Hashes are dealt in ranges of (hash, id), so that a line in a third of all documents spreads over many tasks,
    and sorted by document and position; the stream marks the first occurrence in each document. Keys are then
    counted from one partial row a task, and the rows of repeated keys alone meet their documents.
    """
    dealt = hashed_lines(docs, min_chars, id_col, text_col).repartitionByRange(*HASH, "id").sortWithinPartitions(*HASH, "id", "pos")
    in_doc = Window.partitionBy(*HASH, "id").orderBy("pos")
    spots = written(dealt.withColumn("first", F.row_number().over(in_doc) == 1), "line-hashes")
    seen = spots.groupBy(*HASH).agg(F.count_if("first").alias("n"), F.max("id").alias("keep_id"))
    keys = written(seen.filter(F.col("n") >= min_docs).select(*HASH, "keep_id"), "line-keys")
    gone = spots.join(keys, list(HASH)).filter("id <> keep_id")
    at = gone.groupBy("id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    at = at.withColumn("runs", let(F.col("at"), _drop_runs))
    return at.select("id", "text_key", F.size("at").cast("long").alias("n_dropped"), "runs.drop_from", "runs.drop_to")


def _drop_runs(at: Column) -> Column:
    """Runs of ordered places, as arrays of their first places and of the places behind their last."""

    def lone(step: int):
        return lambda x, i: F.coalesce(F.get(at, i + step) != x + step, F.lit(True))

    return F.struct(F.filter(at, lone(-1)).alias("drop_from"), F.transform(F.filter(at, lone(1)), lambda x: x + 1).alias("drop_to"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", text: bool = False) -> DataFrame:
    """`id, n_lines, n_dropped, keep_runs` of every row, and the `kept` text with `text`.

    A text is split at line feeds. A line's key is the line without ASCII white space at its ends and with A-Z in
    lower case. Keys of `min_chars` code points or more that `min_docs` documents hold lose all their lines but
    those in the largest id that holds them. `keep_runs` is the keep bitmap as run lengths: lines kept, lines
    dropped, lines kept and so on, from the first line; it ends with a run of kept lines, which may be empty.

    Null and empty texts are one empty line. Rows with a null id are no document: they lose nothing and count for
    nothing. Rows that repeat an id are one document when documents are counted, and each has its own bitmap. Keys
    are compared by 128 bits of hash. No rows give no rows; other columns are unused.
    """
    drops = drop_bitmaps(docs, min_chars, min_docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text")).withColumn("text_key", _text_key(F.col("text")))
    joined = rows.join(drops, ["id", "text_key"], "left").withColumn("lines", _lines(F.col("text")))
    none = F.array().cast("array<int>")
    starts = F.concat(F.array(F.lit(0)), F.coalesce("drop_to", none))
    stops = F.concat(F.coalesce("drop_from", none), F.array(F.size("lines")))
    joined = joined.withColumns({"starts": starts, "stops": stops})
    bounds = F.flatten(F.zip_with("starts", "stops", lambda a, b: F.array(a, b)))
    runs = let(bounds, lambda at: F.transform(F.slice(at, 2, F.size(at) - 1), lambda x, i: x - F.get(at, i)))
    whole = let(F.col("lines"), lambda ls: F.array_join(F.flatten(F.zip_with("starts", "stops", lambda a, b: F.slice(ls, a + 1, b - a))), "\n"))
    kept = F.when(F.col("n_dropped").isNull(), F.col("text")).otherwise(whole)
    out = ["id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), runs.alias("keep_runs")]
    return joined.select(*out, *([kept.alias("kept")] if text else []))
