"""Jaccard join in metric space: Voronoi cells around pivots, triangle-inequality windows, recursion.

The points are documents as sets of word shingles under the Jaccard distance. Nearly all documents of a large
corpus are at distance 1 from one another, so the mass at distance 1 is divided first: the first pivots are the
smallest non-empty sets, single shingles, rare ones before common ones. A set is at distance 1 - 1/n from each
of its n shingles and at 1 from all other pivots; ties go to the first, and a set within the radius can have its
own cell only among its first n - ceil(t n) + 1 shingles, the window to which it is replicated.

A cell of many sets is divided by the distance to the empty set (their size), and then by up to FAN of its own
documents, again and again. Near sets x, y have a symmetric difference of at most w = (|x| + |y|)(1 - t) / (1 + t),
and so at most that distance d between their counts by PLACES disjoint parts of the universe, a metric that needs no
sets. With m(x) the distance of x to its nearest pivot, a near pair with m(x) <= m(y) meets in the cell of x's nearest
pivot p, since d(y, p) <= m(x) + w <= m(y) + w: so every set goes to its nearest pivot's cell and, by the triangle
inequality, to those of the pivots no more than w further away. Sets within the radius of a pivot are one component
with it, and cells of a single component are done; the others are divided until they are small or do not shrink.
There, pairs of different components meet: those that differ too much in size, place in the window or counts are
ruled out where they meet, the others by counts in FINE parts, and what is left by the sets themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscore.llm.components import connected
from cohortscore.llm.shared import in_slices, release, written
from cohortscore.llm.shingle_words import distinct, hashed_texts, mix, shingles

#: Counters of the frequency sketch and words of the membership bitmap: what is broadcast has these sizes.
COUNTERS, BITMAP = 1 << 17, 1 << 17
#: Disjoint parts of the universe of shingles whose counts bound a distance from below: where cells meet, and once more before sets do.
PLACES, FINE = 64, 512
#: Cells of more sets than SMALL are divided by up to FAN pivots, unless a child keeps more than SHRINK of its parent.
SMALL, FAN, SHRINK = 48, 4, 0.9
_SHIFT = np.uint64(7)


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _counts(s: np.ndarray, places: int) -> np.ndarray:
    """How many shingles each of the places has, up to 127: a limit moves no two counts further apart."""
    part = s >> np.uint64(64 - places.bit_length() + 1)
    return np.minimum(np.bincount(part.astype(np.int64), minlength=places), 127).astype(np.int8)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat))


def rarity(rows: DataFrame, k: int) -> np.ndarray:
    """A level for each of COUNTERS parts of the shingles: 0 for the usual number of occurrences, two more for each doubling."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in in_slices(batches):
            found = shingles(*hashed_texts(batch["text"], lower=True), k)
            if found:
                total += np.bincount((np.concatenate(found) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for sums in batch["sums"].to_pylist():
                total += np.frombuffer(zlib.decompress(sums), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["part", "n"])

    parts = written(rows.select("text").mapInArrow(count, "sums binary"), "sketch")
    table = np.zeros(COUNTERS, np.int64)
    for r in parts.mapInArrow(add, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():  # COUNTERS rows
        table[r["part"]] = r["n"]
    release(parts)
    usual = max(1.0, float(np.median(table)))
    return np.clip(np.floor(2 * np.log2(np.maximum(table, 1) / usual + 1e-9)), 0, 120).astype(np.uint64)


def outlines(rows: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """`id, n, node, twin, odd, profile, keys` of `id, text`: a set's size, two hashes, how many of its shingles are usual,
    its counts by place, and the single-shingle pivots of its window, rare ones first.

    A copy of a set that the same task has seen has no profile and no keys.
    """

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in in_slices(batches):
            n, node, twin, odd, profile, keys = [], [], [], [], [], []
            for s in map(distinct, shingles(*hashed_texts(batch["text"], lower=True), k)):
                n.append(len(s))
                node.append(_node(s))
                twin.append(xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63))
                if not len(s) or node[-1] in seen:
                    odd.append(None)
                    profile.append(None)
                    keys.append(s[:0])
                    continue
                if len(seen) < 200_000:
                    seen.add(node[-1])
                level = levels[(s % np.uint64(COUNTERS)).astype(np.int64)]
                order = np.sort(level << np.uint64(57) | mix(s) >> _SHIFT)
                odd.append(int(np.count_nonzero(level == 0)))
                profile.append(_counts(s, PLACES))
                keys.append(order[: len(s) + (-percent * len(s)) // 100 + 1])
            flat = np.concatenate([p for p in profile if p is not None]) if any(p is not None for p in profile) else np.zeros(0, np.int8)
            ends = np.cumsum([0, *(0 if p is None else PLACES for p in profile)])
            cols = [batch["id"], pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(twin, pa.int64()), pa.array(odd, pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), _lists(keys)], ["id", "n", "node", "twin", "odd", "profile", "keys"])

    return rows.mapInArrow(outline, f"id {dict(rows.dtypes)['id']}, n int, node long, twin long, odd int, profile array<tinyint>, keys array<long>")


def _bits(ids: DataFrame) -> DataFrame:
    """A bitmap with every hash `h` as a table `w, b` of at most BITMAP rows."""
    place = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(BITMAP - 1))
    return ids.groupBy(place.alias("w")).agg(F.bit_or(_bit()).alias("b"))


def _bit() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))


def _hits(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose hash `h` the bitmap may have."""
    place = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(BITMAP - 1))
    return rows.withColumn("w", place).join(F.broadcast(bits), "w").filter(F.col("b").bitwiseAND(_bit()) != 0).select(*rows.columns)


class Points:
    """The documents of a corpus as sets: `rows` (`id, text`), their written `outlined` form and its `classes`, one row a set."""

    def __init__(self, rows: DataFrame, k: int, percent: int):
        self.rows, self.k, self.percent = rows, k, percent
        self.outlined = written(outlines(rows, k, percent, rarity(rows, k)), "outlines")
        sets = self.outlined.filter("n > 0")
        self.classes = sets.groupBy("node").agg(F.min("id").alias("least"), F.min("twin").alias("t0"), F.max("twin").alias("t1"))
        self.sets = sets.filter("profile IS NOT NULL")

    def profiled(self, nodes: DataFrame) -> DataFrame:
        """`node, odd, profile` of the given nodes, one row each."""
        return self.sets.select("node", "odd", "profile").join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("odd").alias("odd"), F.first("profile").alias("profile"))

    def _made(self, nodes: DataFrame) -> DataFrame:
        """The sets of the given nodes, `node, n, fine, hashes`, written, made from the text of one document each."""
        wanted = written(nodes.distinct().join(self.classes.select("node", "least"), "node").select("node", F.xxhash64("least").alias("h")), "wanted")
        k = self.k

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in in_slices(batches):
                found = [s for s in map(distinct, shingles(*hashed_texts(batch["text"], lower=True), k)) if len(s)]
                node = [_node(s) for s in found]
                new = [i for i, x in enumerate(node) if not (x in seen or len(seen) < 200_000 and seen.add(x))]
                fine = np.concatenate([_counts(found[i], FINE) for i in new]) if new else np.zeros(0, np.int8)
                fine = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1) * FINE, pa.int32()), pa.array(fine))
                yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in new], pa.int64()), pa.array([len(found[i]) for i in new], pa.int32()), fine, _lists([found[i] for i in new])], ["node", "n", "fine", "hashes"])

        some = _hits(self.rows.select(F.xxhash64("id").alias("h"), "text"), _bits(wanted)).select("text").mapInArrow(sets, "node long, n int, fine array<tinyint>, hashes array<long>")
        whole = written(some.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fine", "hashes")]), "whole-sets")
        release(wanted)
        return whole

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of the written, distinct pairs `a, b` that are near, written. Counts by FINE places come first: most pairs need no sets."""
        whole = self._made(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
        left, right = (whole.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("fine").alias(f"{x}_profile")) for x in "ab")
        alike = written(pairs.join(right, "b").join(left, "a").filter(_distance("a_", "b_") <= _width(self.percent, F.col("a_n") + F.col("b_n"))).select("a", "b"), "alike")

        def side(x: str) -> DataFrame:
            some = _hits(whole.withColumn("h", F.col("node")), _bits(alike.select(F.col(x).alias("h"))))
            return some.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}"))

        met = alike.join(side("b"), "b").join(side("a"), "a").withColumn("common", F.size(F.array_intersect("ha", "hb")))
        out = written(met.filter(F.col("common") * 100 >= self.percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "near")
        release(whole, alike)
        return out


def members_of(points: Points, percent: int) -> DataFrame:
    """`cell, node, n, pos`, written: the sets in the cells of single shingles that can hold a near pair.

    The smaller set of a near pair has their first common shingle in a short prefix, and sizes of a near pair are in
    the same or in neighbouring classes. One row a shingle tells which classes it has, and in which it has a short
    prefix; a set that is alone in its class and has no class beside it stays out. Classes of several rows stay in.
    """
    step, share = float(np.log(100 / percent)) + 1e-9, percent / (100 + percent)
    of_class = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(c, F.lit(0)))
    rows = points.sets.select("node", "n", F.posexplode("keys").alias("pos", "cell"))
    rows = rows.withColumns({"short": F.col("n") - F.col("pos") >= F.ceil(2 * share * F.col("n") - 1e-9), "c": F.least(of_class, F.lit(62))})
    cells = rows.groupBy("cell").agg(F.count("*").alias("many"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_or(bit(F.col("c"))).alias("has"), F.bit_or(F.when(F.col("short"), bit(F.col("c"))).otherwise(F.lit(0).cast("long"))).alias("shorts"))
    # `lone`: each class has one row, so only a neighbouring class can hold a partner.
    near_class = F.col("has").bitwiseAND(F.shiftrightunsigned("has", 1)) != 0
    cells = cells.filter("lo <> hi AND shorts <> 0").withColumn("lone", F.col("many") == F.bit_count("has"))
    cells = cells.filter(~F.col("lone") | near_class).select("cell", "has", "shorts", "lone")
    own, up, down = bit(F.col("c")), F.when(F.col("c") < 62, bit(F.col("c") + 1)).otherwise(F.lit(0).cast("long")), F.when(F.col("c") > 0, bit(F.col("c") - 1)).otherwise(F.lit(0).cast("long"))
    here = F.when(F.col("lone"), F.lit(0).cast("long")).otherwise(own)
    larger = F.col("shorts").bitwiseAND(here.bitwiseOR(down)) != 0  # a smaller partner with a short prefix
    smaller = F.col("short") & (F.col("has").bitwiseAND(here.bitwiseOR(up)) != 0)
    kept = rows.join(cells, "cell").filter(larger | smaller)
    return written(kept.groupBy("cell", "node").agg(F.first("n").alias("n"), F.first("pos").alias("pos")), "members")


def possible(percent: int, x: str = "x_", y: str = "y_") -> Column:
    """Whether a set x and a set y no larger, whose first common shingle has these places, can be near."""
    nx, ny, i, j = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}pos"), F.col(f"{y}pos")
    need = F.ceil(F.lit(percent) * (nx + ny) / (100 + percent) - 1e-9)
    return (ny <= nx) & (100 * ny >= percent * nx) & (nx - i >= need) & (ny - j >= need)


def _distance(x: str = "x_", y: str = "y_") -> Column:
    """The distance of two profiles, which no two sets fall below in their symmetric difference."""
    return F.aggregate(F.zip_with(f"{x}profile", f"{y}profile", lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda t, v: t + v)


def _width(percent: int, both: Column) -> Column:
    """The largest symmetric difference of a near pair with so many elements, counted on both sides."""
    return F.floor(both * (100 - percent) / (100 + percent) + 1e-9)


COLUMNS = ("cell", "node", "n", "pos", "own", "profile", "root", "main", "size")


def _sized(cells: DataFrame) -> DataFrame:
    """Rows of cells with two components or more and a set that is at home there, with the `size` of the cell and its largest component, `main`."""
    parts = cells.groupBy("cell", "root").agg(F.count("*").alias("c"), F.max("own").alias("o"))
    mixed = parts.groupBy("cell").agg(F.count("*").alias("roots"), F.max("o").alias("o"), F.sum("c").alias("size"), F.max_by("root", F.struct("c", "root")).alias("main")).filter("roots > 1 AND o").drop("roots", "o")
    return cells.drop("size", "main").join(mixed, "cell")


def _by_size(cells: DataFrame, percent: int) -> DataFrame:
    """Cells divided by the distance to the empty set: a set is at home in its size class, and a guest in the next smaller one."""
    step = float(np.log(100 / percent)) + 1e-9
    c = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    homes = cells.withColumn("home", F.explode(F.array(F.struct(c.alias("c"), F.lit(True).alias("own")), F.struct((c - 1).alias("c"), F.lit(False).alias("own")))))
    return homes.select(F.xxhash64("cell", "home.c").alias("cell"), "node", "n", "pos", "home.own", "root")


def _pairs(cells: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs `a, b` that meet in cells and that sizes, places and profiles leave possible; none inside one component."""
    rows = cells.withColumn("is_main", F.col("root") == F.col("main"))
    side = lambda x: rows.select("cell", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "pos", "own", "root", "is_main", "profile")])
    met = side("x").join(side("y").filter("y_own"), "cell").filter(possible(percent) & (F.col("x_root") != F.col("y_root")) & ~(F.col("x_is_main") & F.col("y_is_main")))
    met = met.filter(_distance() <= _width(percent, F.col("x_n") + F.col("y_n")))
    return met.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).distinct()


def _divided(cells: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """The children of cells, with their `parent`: each set in its nearest pivot's cell and in those of the window."""
    to = F.struct(_distance("", "p_").alias("d"), F.col("b"))
    each = cells.join(pivots, "cell").groupBy("cell", "node", "own").agg(F.first("n").alias("n"), F.first("pos").alias("pos"), F.collect_list(to).alias("to"))  # at most FAN
    reach = F.array_min(F.transform("to", lambda t: t.getField("d"))) + F.col("n") * (100 - percent) / percent + 1e-9
    homes = each.withColumn("reach", reach).withColumn("home", F.explode(F.expr("filter(to, t -> t.d <= reach)")))
    return homes.select(F.xxhash64("cell", "home.b").alias("cell"), "node", "n", "pos", "own", F.col("cell").alias("parent"))


def near_links(points: Points, percent: int) -> DataFrame:
    """Links `a, b` between set hashes that have the components of all pairs with a similarity of `percent` or more."""
    members = members_of(points, percent)
    sized = members.groupBy("cell").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("cell", "size")
    whole = members.join(sized, "cell").withColumns({"root": F.col("node"), "own": F.lit(True)})
    cells = whole.filter(F.col("size") <= SMALL).select("cell", "node", "n", "pos", "own", "root")
    cells = cells.unionByName(_by_size(whole.filter(F.col("size") > SMALL), percent))
    cells = written(_sized(cells).withColumn("main", F.lit(None).cast("long")), "cells")
    profiles = points.profiled(cells)
    release(members)
    plain, cells = cells, written(cells.join(profiles, "node"), "profiled-cells")
    release(plain)
    left = [cells.filter(F.col("size") <= SMALL).withColumn("main", F.lit(0).cast("long")).select(*COLUMNS)]  # nothing is known of them yet
    active, links, fan = cells.filter(F.col("size") > SMALL), None, 1
    while not active.isEmpty():
        # The same order in every cell, so that the cells of one group of near copies choose the same pivots, from its centre.
        slot, central = F.pmod(F.hash("root"), F.lit(fan)), F.struct("odd", F.hash("node"), "node")
        pivots = active.filter("own").groupBy("cell", slot.alias("slot")).agg(F.min_by("node", central).alias("b"), F.min_by("n", central).alias("p_n"), F.min_by("root", central).alias("p_root"), F.min_by("profile", central).alias("p_profile"))
        pivots = written(pivots.drop("slot"), "pivots")
        beside = active.join(pivots, "cell").filter((F.col("root") != F.col("p_root")) & (_distance("", "p_") <= _width(percent, F.col("n") + F.col("p_n"))))
        pairs = written(beside.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct(), "pivot-pairs")
        found = points.near(pairs)
        known, links = links, written(found if links is None else links.union(found), "links")
        roots = connected(links)
        rooted = lambda c: c.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        before = active
        active = written(_sized(rooted(active)).select(*COLUMNS, "odd"), "cells")
        if fan > 1:  # the first pivot of a cell only makes one component of a group of near copies
            children = written(_divided(active.filter(F.col("size") > SMALL), pivots, percent), "children")
            shares = children.groupBy("parent", "cell").agg(F.count("*").alias("c")).groupBy("parent").agg(F.max("c").alias("c"))
            whole_cells = active.join(shares.withColumnRenamed("parent", "cell"), "cell", "left")
            stays = F.coalesce(F.col("c") > SHRINK * F.col("size"), F.lit(True))
            left.append(written(whole_cells.filter(stays).select(*COLUMNS), "undivided"))
            keep = active.select("node", "own", "root", "odd", "profile", F.col("cell").alias("parent"))
            parts = children.join(whole_cells.filter(~stays).select(F.col("cell").alias("parent")).distinct(), "parent", "left_semi").join(keep, ["parent", "node", "own"])
            parts = written(_sized(parts.drop("parent")).select(*COLUMNS, "odd"), "cells")
            left.append(parts.filter(F.col("size") <= SMALL).select(*COLUMNS))
            release(children, active)
            active = parts.filter(F.col("size") > SMALL)
        else:
            left.append(active.filter(F.col("size") <= SMALL).select(*COLUMNS))
            active = active.filter(F.col("size") > SMALL)
        release(pairs, pivots, found, *([] if known is None else [known]), *([] if fan == 1 else [before]))
        fan = FAN
    found = points.near(written(_pairs(reduce(DataFrame.unionByName, left), percent), "pairs"))
    return found if links is None else links.union(found)


def jaccard_join(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_shingles, component_id` of every row: the smallest id that links lead to, itself included.

    Two texts link when 100 |x n y| >= percent |x u y| on their sets of distinct k-word shingles (A-Z in lower
    case, words between ASCII white space; fewer than k words make one shingle). Equal sets are one point and
    share a component; a null, empty or wordless text has no set and is its own component, whatever the
    others are. Ids may repeat; rows with a null id take part, and null is never the smallest. No rows give
    no rows; other columns are unused.
    """
    points = Points(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), k, percent)
    classes = points.classes
    if not classes.filter("t0 <> t1").isEmpty():
        raise RuntimeError("two different sets have one 64-bit hash")
    links = near_links(points, percent)
    roots = connected(links)
    least = classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = least.join(by_root, "root").select("node", "component_id")
    out = points.outlined.select("id", "n", "node").join(of_node, "node", "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component, with all their columns. Rows without words stay."""
    joined = jaccard_join(docs, percent, k, id_col, text_col).filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("stay")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"))
    return whole.join(joined, F.col("id").eqNullSafe(F.col("stay")), "left_semi").select("row.*")
