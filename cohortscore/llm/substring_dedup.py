"""Substring dedup: suffix automata of the documents that hold a passage first, streamed over by the others.

A reference shard is what the first document with a passage (the smallest id, its owner) has around it. Only
documents that share a sampled run of words with an owner are sent to its automaton, which is replicated over
as many tasks as its readers need; so no document meets the shards it has nothing in common with.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscore.llm.shared import in_slices, written
from cohortscore.llm.shingle_words import hashed_texts, window_hashes, word_hashes, word_lists

#: Words of the bitmap that picks documents before a shuffle: its broadcast has this size.
BITMAP = 1 << 17
#: Readers of one passage for each copy of its automaton.
READERS = 128


class Automaton:
    """The suffix automaton of token runs, which are kept apart by tokens that occur nowhere else."""

    def __init__(self, runs: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for i, run in enumerate(runs):
            for token in (*run, i):
                last = self._add(last, token)

    def _add(self, last: int, token: object) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(token) == q:
                    nxt[p][token] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        return cur

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """The maximal spans [from, to) covered by matches of `least` tokens or more, by matching statistics."""
        nxt, link, length = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        state = size = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            if size >= least:
                a = i - size + 1
                if out and a <= out[-1][1]:
                    out[-1] = (min(a, out[-1][0]), i + 1)
                else:
                    out.append((a, i + 1))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def seeds(rows: DataFrame, window: int) -> DataFrame:
    """`seed, id, uid, places`: of every window of words, the run of half its length with the smallest hash.

    Equal windows choose equal runs, wherever they stand, so two documents with a common window share a seed. A
    document has one row a seed, with all its places: a text that repeats itself is one reader of a passage.
    """
    half = window // 2
    reach = window - half + 1

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found, places, many, take = [], [], [], []
            hashes, bounds = hashed_texts(batch["text"])
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                if b - a < window:
                    continue
                h = window_hashes(hashes[a:b], half)
                at = np.unique(np.lib.stride_tricks.sliding_window_view(h, reach).argmin(axis=1) + np.arange(len(h) - reach + 1))
                order = at[np.argsort(h[at], kind="stable")]
                new = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
                found.append(h[order][new].view(np.int64))
                places.append(order.astype(np.int32))
                many.append(np.diff(np.append(new, len(order))))
                take.append(np.full(len(new), i))
            if found:
                rows_of = pa.array(np.concatenate(take))
                ends = pa.array(np.append(0, np.cumsum(np.concatenate(many))), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch["id"].take(rows_of), batch["uid"].take(rows_of), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places)))], ["seed", "id", "uid", "places"])

    return rows.mapInArrow(choose, f"seed long, id {dict(rows.dtypes)['id']}, uid long, places array<int>")


def _bits(uids: DataFrame) -> DataFrame:
    """A bitmap with every uid as a table `w, b` of at most BITMAP rows."""
    place, bit = _place()
    return uids.groupBy(place.alias("w")).agg(F.bit_or(bit).alias("b"))


def _place():
    place = F.shiftrightunsigned("uid", 6).bitwiseAND(F.lit(BITMAP - 1))
    return place, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("uid").bitwiseAND(F.lit(63)).cast("int"))


def _split(rows: DataFrame, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose uid the bitmap may have, the others)."""
    place, bit = _place()
    marked = rows.withColumn("w", place).join(F.broadcast(bits), "w", "left").withColumn("may", F.coalesce(F.col("b").bitwiseAND(bit) != 0, F.lit(False)))
    return marked.filter("may").select(*rows.columns), marked.filter("NOT may").select(*rows.columns)


def _segments(marked: DataFrame, window: int) -> DataFrame:
    """What documents send to automata: `owner, level, salt, reads, id, uid, start, at, words` from `id, uid, text, hits`."""
    half = window // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            take: list[int] = []
            owner, level, salt, reads, start, at, text = [], [], [], [], [], [], []
            ids, uids = batch["id"].to_pylist(), batch["uid"].to_pylist()
            for i, (words, hits) in enumerate(zip(word_lists(batch["text"].to_pylist()), batch["hits"].to_pylist())):
                by: dict[tuple, list[int]] = {}
                for hit in hits:
                    by.setdefault((hit["owner"], hit["level"]), []).extend(hit["places"])
                for (own, lv), places in by.items():
                    places.sort()
                    own_copy = ids[i] == own
                    for a, b in _merged([(max(0, p - window + half), min(len(words), p + window)) for p in places]):
                        inside = places[bisect_left(places, a) : bisect_left(places, b)]
                        for k in range(1 << lv) if own_copy else (uids[i] % (1 << lv),):
                            take.append(i)
                            owner.append(own)
                            level.append(lv)
                            salt.append(k)
                            reads.append(not own_copy)
                            start.append(a)
                            at.append([p - a for p in inside])
                            text.append(b" ".join(words[a:b]))
            rows_of = pa.array(take, pa.int64())
            kind = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(owner, kind), pa.array(level, pa.int32()), pa.array(salt, pa.int64()), pa.array(reads, pa.bool_()), batch["id"].take(rows_of), batch["uid"].take(rows_of), pa.array(start, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(text, pa.binary())], ["owner", "level", "salt", "reads", "id", "uid", "start", "at", "words"])

    kind = dict(marked.dtypes)["id"]
    return marked.mapInArrow(send, f"owner {kind}, level int, salt long, reads boolean, id {kind}, uid long, start int, at array<int>, words binary")


def _streamed(segments: DataFrame, window: int) -> DataFrame:
    """Stream segments over their owner's automaton: `id, uid, from, to, rest`.

    A row with a null `rest` is a span that the owner has. The others are windows at a seed that the owner has
    not, with their hash in `rest`: only documents that read the same owner can share them.
    """
    half = window // 2

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs, whole, automaton = None, [], b"", None
        for batch in in_slices(batches):
            take, a_of, b_of, rest = [], [], [], []
            cols = [batch[c].to_pylist() for c in ("owner", "level", "salt", "reads", "start", "at", "words")]
            for i, (owner, level, salt, reads, start, at, words) in enumerate(zip(*cols)):
                if key != (owner, level, salt):
                    key, runs, whole, automaton = (owner, level, salt), [], b"", None
                if not reads:
                    runs.append(words)
                    continue
                if not whole:
                    whole = b" \n ".join([b"", *runs, b""])  # no word has a line break
                tokens = words.split(b" ")
                n = len(tokens)
                if n >= window and b" " + words + b" " in whole:
                    found = [(0, n)]
                else:
                    if automaton is None:
                        automaton = Automaton([r.split(b" ") for r in runs])
                    found = automaton.spans(tokens, window)
                for a, b in found:
                    take.append(i)
                    a_of.append(start + a)
                    b_of.append(start + b)
                    rest.append(None)
                begun = np.zeros(max(0, n - window + 1), bool)
                for p in at:
                    begun[max(0, p - window + half) : p + 1] = True
                for a, b in found:
                    begun[a : max(a, b - window + 1)] = False
                left = np.flatnonzero(begun)
                if len(left):
                    h = window_hashes(word_hashes(tokens), window)[left].view(np.int64)
                    take.extend([i] * len(left))
                    a_of.extend((start + left).tolist())
                    b_of.extend((start + left + window).tolist())
                    rest.extend(h.tolist())
            rows_of = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"].take(rows_of), batch["uid"].take(rows_of), pa.array(a_of, pa.int32()), pa.array(b_of, pa.int32()), pa.array(rest, pa.int64())], ["id", "uid", "from", "to", "rest"])

    dealt = segments.repartition("owner", "level", "salt").sortWithinPartitions("owner", "level", "salt", "reads")
    return dealt.mapInArrow(stream, f"id {dict(segments.dtypes)['id']}, uid long, from int, to int, rest long")


def repeated_spans(rows: DataFrame, window: int) -> DataFrame:
    """`uid, spans`: the word spans of each row (`id, uid, text`) that also stand in a row with a smaller id."""
    found = written(seeds(rows.filter("id IS NOT NULL"), window), "seeds")
    shared = found.groupBy("seed").agg(F.min("id").alias("owner"), F.max("id").alias("top"), F.count("*").alias("n")).filter("owner <> top")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / READERS))).cast("int")
    hits = found.join(shared.select("seed", "owner", level.alias("level")), "seed").select("uid", "places", "owner", "level")
    per_row = written(hits.groupBy("uid").agg(F.collect_set(F.struct("places", "owner", "level")).alias("hits")), "seed-hits")
    some, _ = _split(rows, _bits(per_row))
    marked = some.join(per_row, "uid").select("id", "uid", "text", "hits").groupBy("uid").agg(*[F.first(c).alias(c) for c in ("id", "text", "hits")]).select("id", "uid", "text", "hits")
    out = written(_streamed(_segments(marked, window), window), "matches")
    rest = out.filter("rest IS NOT NULL").distinct()
    first = rest.groupBy("rest").agg(F.min("id").alias("first"), F.max("id").alias("top")).filter("first <> top").drop("top")
    late = rest.join(first, "rest").filter("id > first").select("uid", "from", "to")
    spans = out.filter("rest IS NULL").select("uid", "from", "to").union(late)
    return spans.groupBy("uid").agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def _cut(rows: DataFrame, text: bool) -> DataFrame:
    """`id, n_words, n_removed, kept_sha256[, kept]` of `id, text, spans`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            n, removed, sha, kept = [], [], [], []
            for words, spans in zip(word_lists(batch["text"].to_pylist()), batch["spans"].to_pylist()):
                n.append(len(words))
                for a, b in reversed(_merged([(x["from"], x["to"]) for x in spans or ()])):
                    del words[a:b]
                left = b" ".join(words)
                removed.append(n[-1] - len(words))
                sha.append(hashlib.sha256(left).hexdigest())
                if text:
                    kept.append(left.decode())
            cols = [batch["id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * text, ["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * text)

    return rows.mapInArrow(cut, f"id {dict(rows.dtypes)['id']}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text)


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", text: bool = False) -> DataFrame:
    """`id, n_words, n_removed, kept_sha256` of every row, and the `kept` words joined by spaces with `text`.

    A word goes when a run of `window` words that covers it also starts in a row with a smaller id. Runs are
    judged on the input, so a passage stays in its first document alone; a run repeated inside one document
    is no reason. Words are what stands between ASCII white space, unchanged.

    Steps: sampled seeds name the first document of every shared run (its owner); documents send what they
    have around common seeds to the owner's automaton and learn their maximal matches; windows that the owner
    lacks are compared among its readers by hash. Null and empty texts have no words. Rows with a null id
    neither remove nor lose words. Rows that repeat an id are one document and do not affect each other. No
    rows give no rows; other columns are unused.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("uid", F.xxhash64("id", "text"))
    spans = written(repeated_spans(rows, window), "spans")
    some, others = _split(rows, _bits(spans))
    none = F.lit(None).cast(dict(spans.dtypes)["spans"]).alias("spans")
    return _cut(some.join(spans, "uid", "left").select("id", "text", "spans"), text).unionByName(_cut(others.select("id", "text", none), text))
