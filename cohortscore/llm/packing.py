"""Sequence packing: exact complements by length sums, then best fit, planned on length counts alone."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscore.llm.bpe import Codec
from cohortscore.llm.shared import text_or_empty, written

Pattern = tuple[tuple[int, int], ...]  # (length, how many) in the order of their places

#: The added token of byte_bpe_50k.json and its id: tokenizers finds it in texts even without special tokens.
ADDED, ADDED_ID = "<|endoftext|>", 50256


def text_ids(codec: Codec, text: str) -> np.ndarray:
    """The ids that tokenizers gives for the json file: the parts around each ADDED apart, and its id between them."""
    out = []
    for part in text.split(ADDED):
        out += [codec.encode_to_numpy(part), np.array([ADDED_ID], "<u4")]
    return np.concatenate(out[:-1])


def plan(available: Mapping[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Fill sequences of `size` with the given number of pieces of each length: [(pattern, how many sequences)].

    From the longest length down, exact complements go first: one length that fills the gap, else a pair, else
    a triple, each consumed as often as the counts allow. What has no complement goes, again from the longest
    down, into the open sequences with the smallest gap that takes it, many at a time.

    The input has at most `size` entries, and each step uses up one length or one class of sequences, so the
    plan's size depends on `size` and not on the number of documents.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in available.items():
        left[length] = n
    out: list[tuple[Pattern, int]] = []

    def use(lengths: tuple[int, ...]) -> bool:
        need = Counter(lengths)
        n = min(int(left[x]) // k for x, k in need.items())
        if n > 0:
            out.append((tuple(sorted(need.items(), reverse=True)), n))
            for x, k in need.items():
                left[x] -= n * k
        return n > 0

    def pairs(gap: int) -> np.ndarray:
        """The longer halves of pairs of lengths that have pieces left and sum to the gap, the longest first."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        return a[(left[a] > 0) & (left[gap - a] > 0)] if gap > 1 else a[:0]

    for x in range(size, 0, -1):
        if not left[x]:
            continue
        gap = size - x
        if not gap:
            use((x,))
            continue
        use((x, gap))
        for a in pairs(gap):
            if not left[x]:
                break
            use((x, int(a), gap - int(a)))
        for a in range(gap - 2, (gap - 1) // 3, -1):
            if not left[x]:
                break
            if left[a]:
                for b in pairs(gap - a):
                    if b <= a:
                        use((x, a, int(b), gap - a - int(b)))
                    if not (left[x] and left[a]):
                        break

    gaps: list[int] = []  # of open sequences, ascending
    open_at: dict[int, list[tuple[Pattern, int]]] = {}

    def put(gap: int, pattern: Pattern, n: int) -> None:
        if gap == 0:
            out.append((pattern, n))
            return
        if gap not in open_at:
            insort(gaps, gap)
        open_at.setdefault(gap, []).append((pattern, n))

    for x in range(size, 0, -1):
        n = int(left[x])
        while n and (i := bisect_left(gaps, x)) < len(gaps):
            gap = gaps[i]
            pattern, m = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap], gaps[i]
            k = min(gap // x, n)  # so many of this length into each
            took = min(m, n // k)
            n -= took * k
            if m > took:
                put(gap, pattern, m - took)
            put(gap - k * x, (*pattern, (x, k)), took)
        if n:
            k = size // x
            if n // k:
                put(size - k * x, ((x, k),), n // k)
            if n % k:
                put(size - (n % k) * x, ((x, n % k),), 1)
    out.extend(x for gap in gaps for x in open_at[gap])
    return out


def places(patterns: list[tuple[Pattern, int]], size: int) -> dict[str, np.ndarray]:
    """The plan as ranges, sorted by (length, first): ranks first.. of a length go to sequences from `sequence` on, at `offset`."""
    rows, rank, base = [], Counter(), 0
    for pattern, n in patterns:
        at = 0
        for length, k in pattern:
            for _ in range(k):
                rows.append((length, rank[length], base, at))
                rank[length] += n
                at += length
        base += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), cols, strict=True))


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, size: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, ids: bool = False) -> DataFrame:
    """`id, piece, start, length, crc[, ids]`: each text's ids and `end_id`, cut into pieces of `size` of which the first may be shorter."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        tail = np.array([end_id], "<u4")
        for batch in batches:
            take, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                found = np.concatenate([text_ids(codec, text.as_py()), tail])
                first = (len(found) - 1) % size + 1
                at = 0
                for k, end in enumerate(range(first, len(found) + 1, size)):
                    part = found[at:end].tobytes()
                    take.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(part))
                    if ids:
                        raw.append(part)
                    at = end
            cols = [batch["id"].take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(raw, pa.binary())] if ids else []), ["id", "piece", "start", "length", "crc"] + ["ids"] * ids)

    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, crc long" + ", ids binary" * ids)


def pack(pieces: DataFrame, size: int, salts: int = 64) -> DataFrame:
    """Give every row of `pieces` (with `length` in 1..size) a `sequence_id` and an `offset`.

    Only the counts of the lengths (at most `size` numbers) reach the driver; the plan goes back as ranges of
    ranks within a length. Ranks are counted within (length, salt) and shifted by the counts of the salts
    before, so that a length which a third of all pieces have is ranked by many tasks. `salts` grows with the
    number of rows. `pieces` is read three times: pass a written table.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    salts = max(salts, sum(counts.values()) // 1_000_000)
    kind = pieces.schema
    table = places(plan(counts, size), size)
    spread = pieces.withColumn("salt", F.pmod(F.xxhash64(*[c for c in ("id", "piece", "crc") if c in pieces.columns]), F.lit(salts)))
    per_salt = spread.groupBy("length", "salt").count()
    before = per_salt.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    order = [c for c in ("id", "piece", "crc") if c in pieces.columns]
    ranked = spread.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    ranked = ranked.join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt").select(*pieces.columns, "rank")
    key = table["length"] * (1 << 40) + table["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(key, length * (1 << 40) + rank, "right") - 1
            cols = [*batch.columns[:-1], pa.array(table["sequence"][i] + rank - table["first"][i]), pa.array(table["offset"][i])]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, kind.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pack all texts: `id, piece, start, length, crc, sequence_id, offset`, gapless from offset 0 in every sequence.

    Null and empty texts are one piece that holds only `end_id`. Only texts with more than `size` ids are cut.
    Rows repeated with one id are packed each. No rows give no rows; other columns are unused.
    """
    return pack(written(token_pieces(docs, ranks_path, pattern, size, id_col, text_col, end_id), "pieces"), size)
