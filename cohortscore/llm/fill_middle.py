"""Fill-in-middle transformation by block rotations inside one buffer, and its inverse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortscore.llm.shared import in_slices

#: Sentinels before the prefix, the suffix and the middle. Fixed values.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes exchanged at once by a reversal; what a rotation needs beside the buffer.
BLOCK = 1 << 16

_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_INNER = (np.arange(256) & 0xC0) == 0x80


def reverse(buf: np.ndarray, a: int, b: int) -> None:
    """Reverse buf[a:b] in place, a block from each end at a time."""
    while b - a > 1:
        k = min(BLOCK, (b - a) // 2)
        left = buf[a : a + k][::-1].copy()
        buf[a : a + k] = buf[b - k : b][::-1]
        buf[b - k : b] = left
        a, b = a + k, b - k


def rotate(buf: np.ndarray, a: int, m: int, b: int) -> None:
    """Exchange the neighbouring blocks buf[a:m] and buf[m:b] in place by three reversals."""
    reverse(buf, a, m)
    reverse(buf, m, b)
    reverse(buf, a, b)


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Byte offsets at which the units of a UTF-8 text begin: runs of A-Z and a-z, and every other code point."""
    letter = _LETTER[raw]
    begins = ~_INNER[raw]
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def transform(buf: bytearray, first: int, second: int, form: str) -> None:
    """Bring a text with cuts at two byte offsets into its form (`psm` or `spm`), inside the buffer."""
    buf[second:second] = SUFFIX
    buf[first:first] = MIDDLE
    buf[0:0] = PREFIX
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    view = np.frombuffer(buf, np.uint8)
    rotate(view, middle if form == "psm" else 0, suffix, len(view))


def restore(buf: bytearray, form: str) -> None:
    """Undo `transform` inside the buffer, from the sentinels alone: no text with a sentinel in it is ever transformed."""
    if form == "plain":
        return
    suffix, middle, prefix = buf.find(SUFFIX), buf.find(MIDDLE), buf.find(PREFIX)
    view = np.frombuffer(buf, np.uint8)
    if form == "psm":
        rotate(view, suffix, middle, len(view))
        middle, suffix = suffix, suffix + len(view) - middle
    else:
        rotate(view, 0, prefix, len(view))
        middle, suffix = middle - prefix, len(view) - prefix
    del view
    del buf[suffix : suffix + len(SUFFIX)]
    del buf[middle : middle + len(MIDDLE)]
    del buf[: len(PREFIX)]


def _draws(id_: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2^32 from the hash of the seed and the id; a null id is an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n, form, prefix_chars, middle_chars, output` of every row.

    A text's units are runs of A-Z and a-z, and every other code point alone; `n` counts them. Two cuts between
    units, drawn from a hash of the seed and the id, part it into prefix, middle and suffix. The forms are `psm`
    (sentinel and prefix, sentinel and suffix, sentinel and middle) and `spm` (suffix, prefix, middle), drawn
    likewise; `plain` is the text as it is, for the rest of the draws, for empty texts and for texts that hold a
    sentinel. Sentinels are put into a bytearray with the text, and its blocks change places by reversals.

    Null texts count as empty, and a null id as an empty one. Rows that repeat an id have the same draws, and
    rows that repeat id and text the same result. A very long text needs its bytes about twice in one task. No
    rows give no rows; other columns are unused.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    id_ = F.col(f"`{id_col}`")
    rows = docs.select(id_.alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), *_draws(id_, seed))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 64):
            n_of, forms, before, inside, outputs = [], [], [], [], []
            draws = [batch[f"h{i}"].to_pylist() for i in (1, 2, 3, 4)]
            for text, h1, h2, h3, h4 in zip(batch["text"], *draws):
                buf = bytearray(text.as_buffer())
                raw = np.frombuffer(buf, np.uint8)
                starts = unit_starts(raw)
                n = len(starts)
                form = "psm" if h4 % 100 >= spm_percent else "spm"
                if not buf or h3 % 100 >= fim_percent or any(s in buf for s in (PREFIX, SUFFIX, MIDDLE)):
                    form = "plain"
                n_of.append(n)
                forms.append(form)
                if form == "plain":
                    before.append(None)
                    inside.append(None)
                else:
                    first, second = (int(starts[c]) if c < n else len(buf) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
                    points = ~_INNER[raw]
                    before.append(int(points[:first].sum()))
                    inside.append(int(points[first:second].sum()))
                    del raw  # a buffer with a view on it cannot grow
                    transform(buf, first, second, form)
                outputs.append(bytes(buf))
            cols = [batch["id"], pa.array(n_of, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(outputs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = rows.mapInArrow(apply, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(rows: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """`rows` with the exact text rebuilt from form and output as `restored`, in place of a column of that name.

    A null output or form gives null; no rows give no rows.
    """
    names = [c for c in rows.columns if c != "restored"]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{form_col}`").alias("form"), F.col(f"`{output_col}`").cast("binary").alias("output"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 64):
            texts: list[bytes | None] = []
            for form, output in zip(batch["form"].to_pylist(), batch["output"]):
                if form is None or not output.is_valid:
                    texts.append(None)
                    continue
                buf = bytearray(output.as_buffer())
                restore(buf, form)
                texts.append(bytes(buf))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.binary())], ["row", "restored"])

    out = packed.mapInArrow(apply, f"row {packed.schema['row'].dataType.simpleString()}, restored binary")
    return out.select(*[F.col(f"row.`{c}`") for c in names], F.col("restored").cast("string"))
