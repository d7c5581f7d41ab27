"""Similarity of names as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Letters in a machine word; a sum of two such words and a carry is no negative number.
BITS = 62
FULL = (1 << BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where Spark would write its expression into a lambda function for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _masks(letters: Column) -> Column:
    """Of each letter of an array of at most `BITS` letters the places where it stands, as a map of bit masks."""
    place = lambda c: lambda done, j: done.bitwiseOR(F.when(F.get(letters, j) == c, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
    of = lambda c: F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), F.lit(0).cast("long"), place(c))
    return let(F.array_distinct(letters), lambda some: F.map_from_arrays(some, F.transform(some, of)))


def _stepped(word: Column, mask: Column, carry: Column) -> tuple[Column, Column]:
    """A word of the table after one letter, and what it carries into the next word."""
    moved = word + word.bitwiseAND(mask) + carry
    return moved.bitwiseAND(F.lit(FULL)).bitwiseOR(word.bitwiseAND(F.bitwise_not(mask))), F.shiftright(moved, BITS)


def _mask(masks: Column, letter: Column) -> Column:
    return F.coalesce(masks[letter], F.lit(0).cast("long"))


def lcs_length(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence of two texts that are not empty.

    Bit-parallel: a column of the table is a word of bits, of which a zero is a step up, and each letter of `x` is
    one addition. Texts `y` longer than a word take one word after the other, with carries.
    """
    none = F.lit(0).cast("long")

    def one(masks: Column) -> Column:
        return BITS - F.bit_count(F.aggregate(F.split(x, ""), F.lit(FULL), lambda word, letter: _stepped(word, _mask(masks, letter), none)[0]))

    def many(tables: Column) -> Column:
        def row(words: Column, letter: Column) -> Column:
            def word(done: Column, i: Column) -> Column:
                value, carry = _stepped(F.get(words, i), _mask(F.get(tables, i), letter), done["carry"])
                return F.struct(F.array_append(done["words"], value).alias("words"), carry.alias("carry"))

            start = F.struct(F.array().cast("array<bigint>").alias("words"), none.alias("carry"))
            return F.aggregate(F.sequence(F.lit(0), F.size(tables) - 1), start, word)["words"]

        last = F.aggregate(F.split(x, ""), F.transform(tables, lambda _: F.lit(FULL)), row)
        return F.aggregate(last, F.lit(0), lambda n, word: n + BITS - F.bit_count(word))

    letters = F.split(y, "")
    blocks = F.sequence(F.lit(0), F.floor((F.length(y) - 1) / BITS).cast("int"))
    long = let(letters, lambda all_: let(F.transform(blocks, lambda i: _masks(F.slice(all_, i * BITS + 1, BITS))), many))
    return F.when(F.length(y) <= BITS, let(letters, lambda all_: let(_masks(all_), one))).otherwise(long)


def _ratio(x: Column, y: Column) -> Column:
    return 2 * lcs_length(x, y) / (F.length(x) + F.length(y))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100 for two keys of words between single spaces, by their sets of words.

    One set within the other is 100; one empty key is 0, two are 100. Else the best share of common
    letters among: all words of both sides, the common words first, and the common words against either side.
    """
    words = [F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))) for c in (a, b)]
    both = F.array_join(F.array_intersect(*words), " ")
    only = [F.array_except(words[0], words[1]), F.array_except(words[1], words[0])]
    x, y = (F.trim(F.concat_ws(" ", F.when(both != "", both), F.when(F.size(o) > 0, F.array_join(o, " ")))) for o in only)
    shared = F.greatest(_ratio(both, x), _ratio(both, y), _ratio(x, y))
    within = (F.size(only[0]) == 0) & (F.size(only[1]) == 0) | (both != "") & ((F.size(only[0]) == 0) | (F.size(only[1]) == 0))
    score = F.when(within, 1.0).when((F.size(words[0]) == 0) | (F.size(words[1]) == 0), 0.0).when(both == "", _ratio(x, y)).otherwise(shared)
    return F.bround(score * 100).cast("int")


def with_similarity(pairs: DataFrame, a: str, b: str, out: str = "score") -> DataFrame:
    """Add the similarity of two key columns, computed once for each distinct pair of different keys."""
    names = pairs.select(a, b).filter(F.col(a) != F.col(b)).distinct().withColumn(out, token_set_ratio(F.col(a), F.col(b)))
    return pairs.join(names, [a, b], "left").withColumn(out, F.when(F.col(a) == F.col(b), 100).otherwise(F.col(out)))
