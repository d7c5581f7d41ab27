"""Byte-level BPE over documents: overlapping chunks, stitched where pre-token boundaries resynchronise."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortscore.llm.shared import text_or_empty

#: Texts up to so many characters are one chunk. Longer ones are cut into chunks that overlap by OVERLAP.
CHUNK, OVERLAP = 32_768, 1_024
#: A worker forgets its piece cache at so many entries (about 100 bytes each).
CACHE = 400_000

#: Matches from this length on bypass the encoder's own pattern.
LONG_MATCH = 10_000
_LONG_SPACE = regex.compile(r"\s{%d}" % LONG_MATCH)

_codecs: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """The ranks of a file, with a cache of pieces. One for each Python worker, vocabulary and pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.raw[i] = token
        self.decimal = [b"%d" % i for i in range(len(self.raw))]
        self.pieces: dict[str, list[int]] = {}

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> "Codec":
        if (ranks_path, pattern) not in _codecs:
            _codecs[ranks_path, pattern] = cls(ranks_path, pattern)
        return _codecs[ranks_path, pattern]

    def encode(self, text: str) -> list[int]:
        """The ids of each match of the pattern, one after the other."""
        found, known = self.pattern.findall(text), self.pieces
        if len(known) > CACHE:
            known.clear()
        for piece in set(found).difference(known):
            # A match is encoded as it is: the encoder's own pattern overflows its stack on a million of white space.
            known[piece] = self.encoding.encode_ordinary(piece) if len(piece) < LONG_MATCH else self.encoding._encode_single_piece(piece)
        return list(chain.from_iterable(map(known.__getitem__, found)))

    def encode_to_numpy(self, text: str) -> np.ndarray:
        """The same ids as unsigned 32-bit numbers, all of a text at once unless it has a long run of white space."""
        if _LONG_SPACE.search(text):
            return np.array(self.encode(text), "<u4")
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    def joined(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]


def _long_chunks(rows: DataFrame) -> DataFrame:
    """`uid, no, start, last, text`: the chunks of each long text, each with OVERLAP characters of the next."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch["uid"].to_pylist(), batch["text"]):
                text = text.as_py()
                for no, start in enumerate(range(0, len(text), CHUNK)):
                    yield pa.RecordBatch.from_pydict({"uid": pa.array([uid], pa.int64()), "no": pa.array([no], pa.int32()), "start": pa.array([start], pa.int64()), "last": [start + CHUNK >= len(text)], "text": [text[start : start + CHUNK + OVERLAP]]})

    return rows.mapInArrow(cut, "uid long, no int, start long, last boolean, text string")


def stitch_points(chunks: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`uid, no, from, to` of each chunk in characters of its text, null where two neighbours share no boundary.

    Whether a match begins at a place depends on the text from there on alone, so from the first boundary
    that both of two neighbours find in their overlap on they agree. The last two matches of a chunk that is
    not the last may be cut short by its end and do not count.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            out: dict[str, list] = {"uid": [], "no": [], "head": [], "tail": []}
            for uid, no, start, last, text in zip(*(batch[c].to_pylist() for c in ("uid", "no", "start", "last", "text"))):
                found = codec.starts(text)
                out["uid"].append(uid)
                out["no"].append(no)
                out["head"].append([start + p for p in found if 0 < p < OVERLAP] if no else [])
                out["tail"].append([] if last else [start + p for p in found[:-2] if p > CHUNK])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("uid", pa.int64()), ("no", pa.int32()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))]))

    found = chunks.mapInArrow(edges, "uid long, no int, head array<long>, tail array<long>")
    by_doc = Window.partitionBy("uid").orderBy("no")
    begun = found.withColumn("from", F.when(F.col("no") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by_doc)))))
    return begun.select("uid", "no", "from", F.lead("from").over(by_doc).alias("to"), F.max("no").over(Window.partitionBy("uid")).alias("top"), F.max(F.col("from").isNull()).over(Window.partitionBy("uid")).alias("torn"))


def _digests(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch["text"]:
                ids = codec.encode(text.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(codec.joined(ids)).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "text").mapInArrow(encode, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_pieces(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, uid, no, ids`: the token ids (little-endian uint32 bytes) of every stitched piece of every text, in `no` order."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text")).withColumn("uid", _uid())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            ids = [np.array(codec.encode(t.as_py()), "<u4").tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["no"], pa.array(ids, pa.binary())], ["uid", "no", "ids"])

    short = rows.filter(F.length("text") <= CHUNK).select("id", "uid", F.lit(0).alias("no"), "text")
    whole = rows.filter(F.length("text") > CHUNK)
    pieces = short.select("uid", "no", "text").unionByName(_stitched(whole, ranks_path, pattern)).mapInArrow(encode, "uid long, no int, ids binary")
    return rows.select("id", "uid").join(pieces.dropDuplicates(["uid", "no"]), "uid")


def _uid() -> Column:
    """What names a row while its parts are apart: the same whenever it is computed, and for rows that repeat id and text."""
    return F.xxhash64("id", "text")


def _stitched(whole: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`uid, no, text`: the pieces of long texts; a text in which two neighbours never agree is one piece."""
    chunks = _long_chunks(whole.select("uid", "text")).repartition("uid", "no").dropDuplicates(["uid", "no"])
    points = stitch_points(chunks, ranks_path, pattern)
    good = points.filter("NOT torn").drop("torn")
    cut = chunks.join(good, ["uid", "no"]).select("uid", "no", F.expr("substring(text, int(from - start) + 1, int(coalesce(to, start + length(text)) - from))").alias("text"))
    torn = whole.select("uid", "text").join(points.filter("torn AND no = 0").select("uid"), "uid", "left_semi").dropDuplicates(["uid"]).select("uid", F.lit(0).alias("no"), "text")
    return cut.unionByName(torn)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_tokens, ids_sha256, decoded_sha256` of every whole text, as one encoder would give.

    A text of at most CHUNK characters is one chunk and is finished where it is read. A longer one becomes
    overlapping chunks on different tasks; each finds its pre-token boundaries, neighbours are stitched at the
    first boundary both have, the pieces between stitches are encoded apart, and only ids meet again by text,
    where decoding concatenates each id's raw bytes. A long text with no common boundary in some overlap (one
    match of over OVERLAP characters) is encoded in one piece.

    Null and empty texts give no ids: n_tokens 0 and the digests of no bytes. Repeated rows stay repeated.
    No rows give no rows; other columns are unused.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    short = _digests(rows.filter(F.length("text") <= CHUNK), ranks_path, pattern)
    whole = rows.filter(F.length("text") > CHUNK).withColumn("uid", _uid())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            ids = [codec.encode(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["no"], pa.array([len(x) for x in ids], pa.int64()), pa.array(map(codec.joined, ids), pa.binary()), pa.array(map(codec.decode, ids), pa.binary())], ["uid", "no", "n", "ids", "raw"])

    pieces = _stitched(whole, ranks_path, pattern).mapInArrow(encode, "uid long, no int, n long, ids binary, raw binary")
    in_order = F.array_sort(F.collect_list(F.struct("no", "n", "ids", "raw")))
    parts = pieces.groupBy("uid").agg(in_order.alias("p"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda t, x: t + x.getField("n"))
    decimals = F.array_join(F.transform("p", lambda x: F.decode(x.getField("ids"), "ISO-8859-1")), " ")
    raw = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x.getField("raw"))), ""))
    met = parts.select("uid", total.alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"), F.sha2(raw, 256).alias("decoded_sha256"))
    return short.unionByName(whole.select("id", "uid").join(met, "uid").drop("uid"))
