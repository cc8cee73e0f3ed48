"""Texts of Arrow batches as byte arrays, and the words in them.

Inside a task the operators of this package work on whole columns of texts: one
array of UTF-8 bytes and the offsets of the texts in it. A null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at once; a longer single text is worked on alone.
SLICE_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes between the words ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Texts(NamedTuple):
    """Texts as bytes; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


class Words(NamedTuple):
    """Words of texts: byte ranges, and the range of words of each text."""

    starts: np.ndarray
    ends: np.ndarray
    text_offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.text_offsets)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.text_offsets) - 1), self.counts)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """The columns an operator reads, under fixed names; all others are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def texts_of(column: pa.Array) -> Texts:
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Batches cut into runs of rows of at most ``size`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = texts_of(batch.column(column)).offsets
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            part = batch.slice(at, end - at)
            yield part, texts_of(part.column(column))
            at = end


def per_slice(work: Callable[[pa.RecordBatch, Texts], dict]) -> Callable:
    """A ``mapInArrow`` function that turns each slice into columns by ``work``."""

    def run(batches):
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_pydict(work(part, texts))

    return run


def find_words(texts: Texts, separator: np.ndarray = BLANK) -> Words:
    """Maximal runs of bytes for which ``separator`` is false; none spans two texts."""
    n = len(texts.data)
    inner = np.zeros(n + 1, dtype=bool)
    np.logical_not(separator[texts.data], out=inner[:n])
    full = texts.lengths > 0
    opens = inner[:n].copy()
    opens[1:] &= ~inner[: n - 1] if n else True
    first = texts.offsets[:-1][full]
    opens[first] = inner[first]
    closes = inner[:n] & ~inner[1 : n + 1]
    last = texts.offsets[1:][full] - 1
    closes[last] = inner[last]
    starts = np.flatnonzero(opens)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, texts.offsets))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ranges, one after another, and the offsets of the ranges."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[index], offsets


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def distinct_words(texts: Texts, words: Words, separator: np.ndarray = BLANK) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, as binary values, and for each word the index of its value."""
    if not len(words.starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    coded = binary_array(texts.data[~separator[texts.data]], offsets).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def sums_by_text(values: np.ndarray, text_offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, 0 for a text that has none."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    if values.dtype.kind != "f":
        return total[text_offsets[1:]] - total[text_offsets[:-1]]
    out = np.zeros(len(text_offsets) - 1)
    full = np.diff(text_offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(values, text_offsets[:-1][full])
    return out
