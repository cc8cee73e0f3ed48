"""Removal of repeated passages of words: seed and extend.

A word goes if a window of ``length`` consecutive words that covers it also starts in a
document with a smaller id.

* *Seeds.* Of the 16-word grams of a window, the leftmost with the least hash is its anchor: windows with
  equal words have it at the same place. Consecutive windows with one anchor are a unit, on average
  18 of them. Units that hold the same words are told apart from others by a digest: all but those
  of the smallest document are repeated as a whole.
* *Extend.* Units with one anchor but different words are joined on the anchor, each distinct one
  with the unit of the smallest document only, so a group of n makes n rows. The match
  grows word by word to the left and to the right of the anchor, and is kept where it
  is maximal and has ``length`` words or more.
* *What is left.* Windows outside that match are not in the first document's unit, so they can only
  match each other: they meet by the digest of the words beside the anchor, and the smallest
  document of each digest keeps its window.

Every step is a sum or join on (anchor, digest) with one row per unit or window and task, never a pair of
documents; a hot anchor is split by its digests or by adaptive execution.

Words are maximal runs of other bytes than blanks, unchanged. Null and empty texts have no words. Rows
with a null id lose nothing and make nothing else go. Rows that repeat an id are one document: they do not
make each other go. A text of any length is read whole, alone in its slice. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.llm.arrow_text import Texts, binary_array, distinct_words, find_words, gather, id_and_text, slices
from gradeframe.llm.key_filter import bit_table, may_hold
from gradeframe.session import materialize, stored_tables

LENGTH = 50
SEED = 16
#: Of the polynomial digests; odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(texts: Texts, words) -> np.ndarray:
    values, codes = distinct_words(texts, words)
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in values.to_pylist()], dtype=np.uint64)
    return each[codes] if len(codes) else each


def _gram_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` words from each one on, by doubling; of fewer where they end early."""
    out, width, base = hashes.copy(), 1, BASE
    while width < SEED:
        longer = out * np.uint64(base)
        longer[: len(out) - width] += out[width:]
        out, width, base = longer, 2 * width, base * base & 0xFFFFFFFFFFFFFFFF
    return _mixed(out)


def _least_from(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each place on; of fewer where they end early."""
    least, span = values.copy(), 1
    while span < width:
        step = min(span, width - span)
        np.minimum(least[: len(least) - step], least[step:].copy(), out=least[: len(least) - step])
        span += step
    return least


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def _range_digests(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digest of the words of each range that does not depend on where the range is."""
    powers, back = (_powers(x, len(hashes) + 1) for x in (BASE, pow(BASE, -1, 1 << 64)))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(_mixed(hashes) * powers[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * back[starts]


class Units:
    """The units of the texts of a slice."""

    def __init__(self, texts: Texts, length: int = LENGTH):
        self.words = find_words(texts)
        counts = self.words.counts
        self.owner = self.first = self.size = self.anchor = np.zeros(0, np.int64)
        self.core = self.content = np.zeros(0, np.uint64)
        long_enough = np.flatnonzero(counts >= length)
        if not len(long_enough):
            return
        self.hashes = _word_hashes(texts, self.words)
        grams = _gram_hashes(self.hashes)
        low = np.uint64(0xFFFFFFFF)
        place = _least_from((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - SEED + 1) & low
        windows = counts[long_enough] - length + 1
        before = np.cumsum(windows) - windows
        starts = np.arange(windows.sum()) + np.repeat(self.words.text_offsets[:-1][long_enough] - before, windows)
        owner = np.repeat(long_enough, windows)
        anchor = place[starts].astype(np.int64)
        change = np.ones(len(starts), dtype=bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(change)
        self.size = np.diff(np.append(at, len(starts)))
        self.owner, self.first, self.anchor = owner[at], starts[at], anchor[at]
        self.core = grams[self.anchor]
        digest = _range_digests(self.hashes, self.first, self.first + self.size + length - 1)
        shape = (self.anchor - self.first) * 256 + self.size
        self.content = _mixed(digest + _mixed(shape.astype(np.uint64)))


def _text_digests(texts: Texts) -> np.ndarray:
    raw, edges = texts.data.tobytes(), texts.offsets.tolist()
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(edges, edges[1:])], dtype=np.uint64).view(np.int64)


def find_units(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, text_key, anchor, left, size, core, content`` of every unit: the place of its anchor, the
    words before it in the first window, the number of windows, and digests of anchor and words."""

    def run(batches):
        for part, texts in slices(batches):
            units = Units(texts, length)
            rows = pa.array(units.owner)
            offsets = units.words.text_offsets[units.owner]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id").take(rows),
                    "text_key": _text_digests(texts)[units.owner],
                    "anchor": pa.array(units.anchor - offsets, pa.int32()),
                    "left": pa.array(units.anchor - units.first, pa.int32()),
                    "size": pa.array(units.size, pa.int32()),
                    "core": units.core.view(np.int64),
                    "content": units.content.view(np.int64),
                }
            )

    schema = "doc_id long, text_key long, anchor int, left int, size int, core long, content long"
    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, schema)


def _contexts(docs: DataFrame, chosen: np.ndarray, length: int) -> DataFrame:
    """Of the units whose anchor may be chosen, one row per task and content: the hashes of the words
    before the anchor, nearest first, and of those after it."""
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        for part, texts in slices(batches):
            units = Units(texts, length)
            some = np.flatnonzero(may_hold(sent.value, units.core))
            if not len(some):
                continue
            ids = part.column("doc_id").to_numpy()[units.owner[some]]
            some = some[np.lexsort((ids, units.content[some], units.core[some]))]
            new = np.ones(len(some), dtype=bool)
            new[1:] = (units.core[some][1:] != units.core[some][:-1]) | (units.content[some][1:] != units.content[some][:-1])
            some = some[new]
            middle = units.anchor[some]
            bytes_, offsets = gather(units.hashes, units.first[some], middle)
            left = [x[::-1].tobytes() for x in np.split(bytes_, offsets[1:-1])]
            bytes_, offsets = gather(units.hashes, middle + SEED, units.first[some] + units.size[some] + length - 1)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id").take(pa.array(units.owner[some])),
                    "core": units.core[some].view(np.int64),
                    "content": units.content[some].view(np.int64),
                    "size": pa.array(units.size[some], pa.int32()),
                    "left": pa.array(left, pa.binary()),
                    "right": pa.array([x.tobytes() for x in np.split(bytes_, offsets[1:-1])], pa.binary()),
                }
            )

    schema = "doc_id long, core long, content long, size int, left binary, right binary"
    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, schema)


def _table_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row, filled up with 0, and how many each has."""
    data, offsets = (x := column.cast(pa.large_binary())).buffers()[2], np.frombuffer(x.buffers()[1], dtype=np.int64)
    offsets = offsets[x.offset : x.offset + len(x) + 1]
    counts = np.diff(offsets) // 8
    values = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint64) if counts.sum() else np.zeros(0, np.uint64)
    table = np.zeros((len(x), width), dtype=np.uint64)
    table[np.arange(width) < counts[:, None]] = values
    return table, counts


def _common(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """How many leading words of the rows are equal."""
    differ = np.concatenate([a != b, np.ones((len(a), 1), dtype=bool)], axis=1)
    return np.minimum(differ.argmax(axis=1), np.minimum(n_a, n_b))


def extend(batch: pa.RecordBatch, length: int = LENGTH) -> pa.RecordBatch:
    """Matches of units with the first one of their anchor, grown both ways from the anchor.

    A window is named by its words before the anchor. ``mask`` has the windows of the maximal match,
    if it is with a smaller document; ``places`` and ``digests`` describe the windows outside it.
    """
    width = length - SEED
    left, n_left = _table_of(batch.column("left"), width)
    right, n_right = _table_of(batch.column("right"), width)
    to_left = _common(left, n_left, *_table_of(batch.column("first_left"), width))
    to_right = _common(right, n_right, *_table_of(batch.column("first_right"), width))
    place = np.arange(width + 1)
    size = batch.column("size").to_numpy()
    own = (place <= n_left[:, None]) & (place > (n_left - size)[:, None])
    matched = own & (place <= to_left[:, None]) & (place >= (width - to_right)[:, None])
    matched &= (batch.column("doc_id").to_numpy() > batch.column("first_id").to_numpy())[:, None]
    weights = np.random.default_rng(50).integers(0, 1 << 63, size=(2, width), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = np.zeros((2, len(left), width + 1), dtype=np.uint64)
    for i, table in enumerate((left, right)):
        np.cumsum(_mixed(table) * weights[i], axis=1, out=sums[i, :, 1:])
    digests = _mixed(_mixed(sums[0] + place.astype(np.uint64)) + sums[1][:, ::-1])
    rest = own & ~matched
    offsets = np.concatenate([[0], np.cumsum(rest.sum(axis=1))]).astype(np.int32)
    mask = (matched.astype(np.uint64) << place.astype(np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
    columns = {c: batch.column(c) for c in ("core", "content", "doc_id")}
    return pa.RecordBatch.from_pydict(
        columns
        | {
            "mask": mask,
            "places": pa.ListArray.from_arrays(offsets, pa.array(np.nonzero(rest)[1], pa.int32())),
            "digests": pa.ListArray.from_arrays(offsets, pa.array(digests[rest].view(np.int64))),
        }
    )


def _extended(docs: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """``core, content, mask``: the windows, if any, of each mixed anchor's unit that a smaller document has."""
    fields = F.struct("doc_id", "content", "size", "left", "right")
    key = ["core", "content"]
    found = _contexts(docs, bit_table(mixed, "core"), length).join(mixed, "core", "left_semi")
    distinct = materialize(found.groupBy(*key).agg(F.min(fields).alias("x")).select("core", "x.*"))
    first = distinct.groupBy("core").agg(F.min(fields).alias("f")).select(
        "core", *(F.col(f"f.{c}").alias(f"first_{n}") for c, n in (("doc_id", "id"), ("content", "content"), ("left", "left"), ("right", "right")))
    )
    pairs = distinct.join(materialize(first), "core").filter("content != first_content")
    schema = "core long, content long, doc_id long, mask long, places array<int>, digests array<long>"
    grown = materialize(pairs.mapInArrow(lambda batches: (extend(b, length) for b in batches if b.num_rows), schema))
    window = F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("digests").alias("digest"))).alias("w")
    left = grown.select(*key, "doc_id", window).select(*key, "doc_id", "w.*")
    least = left.groupBy("core", "place", "digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    again = left.join(least.filter("least < most").drop("most"), ["core", "place", "digest"]).filter("doc_id > least")
    masks = grown.select(*key, "mask").unionByName(again.select(*key, F.expr("shiftleft(1L, place)").alias("mask")))
    return masks.groupBy(*key).agg(F.bit_or("mask").alias("mask")).filter("mask != 0")


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, text_key, spans``: the windows that go, as ``anchor`` (a word's place) and ``mask``; bit i
    is the window that starts i words before the anchor."""
    with stored_tables(docs.sparkSession):
        units = materialize(find_units(docs, length))
        key = ["core", "content"]
        contents = materialize(units.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")))
        mixed = materialize(contents.groupBy("core").count().filter("count > 1").select("core"))
        masks = _extended(docs, mixed, length)
        # written, so that the next join is one of two tables, which adaptive execution can split
        known = materialize(contents.join(masks, key, "left").filter("least < most OR mask IS NOT NULL"))
        every = F.expr("shiftleft(shiftleft(1L, size) - 1, left - size + 1)")
        mask = F.when(F.col("doc_id") > F.col("least"), every).otherwise(F.col("mask"))
        gone = units.join(known.select(*key, "least", "mask"), key).withColumn("mask", mask).filter("mask IS NOT NULL")
        # a text's spans are fewer than its words
        spans = gone.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("anchor", "mask")).alias("spans"))
        return materialize(spans, keep=True)


def _with_keys(docs: DataFrame) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField("text_key", T.LongType())])

    def run(batches):
        for part, texts in slices(batches):
            columns = {name: part.column(name) for name in part.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"text_key": _text_digests(texts)})

    return docs.mapInArrow(run, schema)


def _marks(spans: pa.ListArray, text_offsets: np.ndarray, length: int) -> np.ndarray:
    """Of each word of the slice, whether a window that goes covers it."""
    change = np.zeros(text_offsets[-1] + length + 1, dtype=np.int64)
    owner = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
    fields = spans.flatten()
    if len(fields):
        masks = fields.field("mask").to_numpy().astype("<i8")
        bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        span, place = np.nonzero(bits)
        begins = (text_offsets[owner] + fields.field("anchor").to_numpy())[span] - place
        np.add.at(change, begins, 1)
        np.add.at(change, begins + length, -1)
    return np.cumsum(change[: text_offsets[-1]]) > 0


def remove_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the other words, joined by one space) per row of ``docs``.

    Other columns are left out. ``length`` is at least ``SEED`` and at most ``SEED + 63``.
    """
    if not SEED <= length <= SEED + 63:
        raise ValueError(f"a window has {SEED} to {SEED + 63} words")
    read = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    spans = repeated_windows(read, length)
    joined = _with_keys(read).join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for part, texts in slices(batches):
            words = find_words(texts)
            gone = _marks(part.column("spans"), words.text_offsets, length)
            kept = ~gone
            total = np.concatenate([[0], np.cumsum(kept)])[words.text_offsets]
            data, offsets = gather(texts.data, words.starts[kept], words.ends[kept])
            spaced = np.insert(data, offsets[1:], ord(" "))  # one after each word
            ends = (offsets + np.arange(len(offsets)))[total]
            column = binary_array(spaced, ends).cast(pa.binary())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_words": words.counts,
                    "n_removed": words.counts - np.diff(total),
                    "kept": column.cast(pa.string()),
                }
            )

    done = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
    return done.withColumn("kept", F.expr("left(kept, length(kept) - 1)"))


def passage_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``remove_passages`` with the SHA-256 of the kept words for the words."""
    done = remove_passages(docs, length)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
