"""URL verdicts: longest-rule match, then a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscore.llm.shared import ascii_lower

WORDS_PER_BLOCK = 8
#: The filter is broadcast, so its size is fixed: at most 2^17 blocks of 64 bytes. A longer list only lets
#: more false positives through to the exact join.
MAX_BLOCKS = 1 << 17


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add `_url, _host, _path`: host after the first `://` in lower case, path up to `?` or `#`; both empty for null or no `://`."""
    df = pages.withColumn("_url", F.col(f"`{url_col}`"))
    rest = F.when(F.instr("_url", "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    df = df.withColumn("_host", ascii_lower(F.coalesce(F.regexp_extract(rest, "^([^/?#]*)", 1), F.lit(""))))
    return df.withColumn("_path", F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def canonical(host: Column, path: Column, url: Column) -> Column:
    """One spelling per page: host without a leading www. or m. and without :80 or :443, path without a last
    slash or .html, the query without tracking parameters (utm_*, ref, fbclid, gclid) and without the fragment."""
    bare = F.regexp_replace(F.regexp_replace(host, "^(?:www|m)\\.", ""), ":(?:80|443)$", "")
    trimmed = F.regexp_replace(F.regexp_replace(path, "/+$", ""), "\\.html?$", "")
    query = F.coalesce(F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)")))
    return F.concat(bare, trimmed, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule `(verdict, host, path)` that fits the host or a parent of it and starts the path; nulls if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first, so wrapped last
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS_PER_BLOCK)]


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter as a table `block, w0..w7`: each key sets one bit in each of the eight words of its block."""
    masked = listed.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(key)))])
    return masked.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS_PER_BLOCK)])


def url_filter(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", listed_url: str = "url", bits_per_key: int = 16
) -> DataFrame:
    """Judge every page: `id, host, path, rule, verdict, maybe_listed, listed`.

    A rule decides where one fits. Elsewhere a page whose canonical URL is on the list is blocked and any
    other is allowed. The list becomes a blocked Bloom filter (one 64-byte block per key, eight bits), sized
    by the list and capped at MAX_BLOCKS, the only thing broadcast. Pages that pass it, true hits and false
    positives, meet the list in an exact hash join; the others skip that join.

    Null and malformed URLs have empty host and path, fit no rule, are on no list and are allowed. An empty
    list blocks nothing. Rows repeated in either table stay repeated or count once. Other columns are unused.
    """
    keys = with_parts(listed.select(F.col(f"`{listed_url}`").alias("url"))).filter("_host <> ''").select(canonical(F.col("_host"), F.col("_path"), F.col("_url")).alias("key")).distinct()
    n = max(1, keys.count())
    n_blocks = 1 << min(MAX_BLOCKS.bit_length() - 1, max(0, (n * bits_per_key // 512).bit_length()))
    blocks = bloom_blocks(keys, "key", n_blocks)
    rows = with_parts(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")))
    rule, verdict = rule_columns(F.col("_host"), F.col("_path"), rules)
    rows = rows.select("id", F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), verdict.alias("ruled"), F.when(F.col("_host") != "", canonical(F.col("_host"), F.col("_path"), F.col("_url"))).alias("key"))
    probed = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).join(F.broadcast(blocks), "block", "left")
    hit = F.col("key").isNotNull() & F.col("w0").isNotNull()
    for i, m in enumerate(_masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    probed = probed.select("id", "host", "path", "rule", "ruled", "key", F.coalesce(hit, F.lit(False)).alias("maybe_listed"))
    possible = probed.filter("maybe_listed").join(keys.withColumn("found", F.lit(True)), "key", "left")
    both = possible.unionByName(probed.filter("NOT maybe_listed").withColumn("found", F.lit(False)))
    both = both.withColumn("listed", F.coalesce("found", F.lit(False)))
    return both.select("id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "maybe_listed", "listed")
