"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words, lower-cased for A-Z. A pattern is a window of
``WINDOW`` consecutive words of a benchmark item; an item of fewer words is one shorter
pattern. Patterns of one length are searched together:

* a *shift table* over hashed blocks of two words tells how far a search may move when
  the block at the end of its window ends no prefix of a pattern early enough;
* where the shift is 0, the *bucket* of the window's last block lists the patterns that
  end with it;
* a *direct comparison* of all the words of window and pattern confirms an occurrence.

All texts of a slice are searched in step: they are cut into lanes that overlap by a
window, and each step moves every lane by its own shift.

The benchmark is a small side. Its patterns are broadcast in blocks of
``block_patterns``; each further block is another pass over the documents, kept
apart by a written table, so that no task ever holds more than one block.

Null and empty texts have no words; null or empty items have no pattern. Repeated
rows of ``docs`` stay, each with its own result. An item id that occurs twice is one item.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.llm.arrow_text import LOWER, Texts, distinct_words, find_words, id_and_text, slices, sums_by_text
from gradeframe.session import materialize

WINDOW = 10
#: Patterns in one broadcast, some 100 MB with their words while the tables are built.
BLOCK_PATTERNS = 100_000
LANE_WORDS = 2048
TABLE_BITS = 17

#: Bytes outside the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def _words(texts: Texts):
    lowered = Texts(LOWER[texts.data], texts.offsets)
    words = find_words(lowered, SEPARATOR)
    return words, *distinct_words(lowered, words, SEPARATOR)


def _block_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class PatternSet:
    """Patterns of one length with their shift table and suffix buckets."""

    def __init__(self, patterns: np.ndarray, items: list[list[int]]):
        """``patterns``: word ids, one distinct pattern a row; ``items``: items of each."""
        length = patterns.shape[1]
        self.length = length
        self.block = min(2, length)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, dtype=np.int64)
        for end in range(self.block - 1, length):
            np.minimum.at(self.shift, self._hash_at(patterns, end), length - 1 - end)
        bucket = self._hash_at(patterns, length - 1)
        order = np.argsort(bucket, kind="stable")
        self.patterns = patterns[order]
        self.items = [items[i] for i in order]
        self.bucket_start = np.searchsorted(bucket[order], np.arange((1 << TABLE_BITS) + 1))

    def _hash_at(self, rows: np.ndarray, end) -> np.ndarray:
        return _block_hash(rows[:, end - self.block + 1], rows[:, end])

    def search(self, ids: np.ndarray, text_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the occurrences, and the pattern of each."""
        m = self.length
        counts = np.diff(text_offsets)
        lanes = np.where(counts >= m, -(-(counts - m + 1) // LANE_WORDS), 0)
        number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(text_offsets[:-1], lanes) + number * LANE_WORDS
        end = np.minimum(begin + LANE_WORDS, np.repeat(text_offsets[1:], lanes) - m + 1)  # of first words
        at, limit = begin + m - 1, end + m - 1
        places, which = [], []
        while len(at):
            hashed = _block_hash(ids[at - self.block + 1], ids[at])
            shift = self.shift[hashed]
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                first, last = self.bucket_start[hashed[hit]], self.bucket_start[hashed[hit] + 1]
                window = np.repeat(at[hit] - m + 1, last - first)
                candidate = np.arange(len(window)) + np.repeat(first - (np.cumsum(last - first) - (last - first)), last - first)
                same = np.ones(len(window), dtype=bool)
                for i in range(m):
                    same[same] = ids[window[same] + i] == self.patterns[candidate[same], i]
                places.append(window[same])
                which.append(candidate[same])
                shift[hit] = 1
            at = at + shift
            going = at < limit
            at, limit = at[going], limit[going]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(which)


class Searcher:
    """All patterns of a block of benchmark windows, by length."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list[int]]]):
        vocabulary = sorted({w for words, _ in windows for w in words})
        self.vocabulary = pa.array(vocabulary, pa.large_binary())
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        by_length = defaultdict(list)
        for words, items in windows:
            by_length[len(words)].append(([number[w] for w in words], items))
        self.sets = [
            PatternSet(np.array([p for p, _ in rows], dtype=np.int32), [i for _, i in rows]) for rows in by_length.values()
        ]

    def hits(self, dictionary: pa.Array, codes: np.ndarray, text_offsets: np.ndarray):
        """Marks of the hit words, and the items found in each text."""
        known = pc.index_in(dictionary, self.vocabulary).fill_null(-1).to_numpy() + 1
        ids = known[codes] if len(codes) else np.zeros(0, np.int64)
        ids = ids.astype(np.int32)
        change = np.zeros(len(ids) + 1, dtype=np.int64)
        found: dict[int, set[int]] = defaultdict(set)
        for patterns in self.sets:
            places, which = patterns.search(ids, text_offsets)
            np.add.at(change, places, 1)
            np.add.at(change, places + patterns.length, -1)
            owners = np.searchsorted(text_offsets, places, side="right") - 1
            for owner, pattern in set(zip(owners.tolist(), which.tolist())):
                found[owner].update(patterns.items[pattern])
        return np.cumsum(change[:-1]) > 0, found


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col="item_id", text_col="text") -> DataFrame:
    """The distinct patterns ``words`` with the sorted ids of the items that hold them."""
    read = id_and_text(benchmark, id_col, text_col).withColumnRenamed("doc_id", "item_id")
    schema = T.StructType([read.schema["item_id"], T.StructField("words", T.ArrayType(T.BinaryType()))])

    def run(batches):
        for part, texts in slices(batches):
            words, dictionary, codes = _words(texts)
            values = dictionary.to_pylist()
            ids, rows = [], []
            for i, (a, b) in enumerate(zip(words.text_offsets, words.text_offsets[1:])):
                own = [values[c] for c in codes[a:b]]
                cuts = [own[j : j + window] for j in range(max(1, len(own) - window + 1))] if own else []
                ids += [i] * len(cuts)
                rows += cuts
            yield pa.RecordBatch.from_pydict(
                {
                    "item_id": part.column("item_id").take(pa.array(ids, pa.int64())),
                    "words": pa.array(rows, pa.list_(pa.binary())),
                }
            )

    cut = read.mapInArrow(run, schema).filter("item_id IS NOT NULL")
    return cut.groupBy("words").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def _mark(docs: DataFrame, searcher: Broadcast, item_names: Broadcast, first: bool) -> DataFrame:
    """Adds the hits of one block to ``n_words``, ``hit`` (word numbers, packed) and ``items``."""
    fields = [*docs.schema.fields]
    if first:
        fields += [T.StructField("hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))]
        fields += [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())]

    def run(batches):
        search, names = searcher.value, item_names.value
        for part, texts in slices(batches):
            words, dictionary, codes = _words(texts)
            marks, found = search.hits(dictionary, codes, words.text_offsets)
            n = part.num_rows
            columns = {c: part.column(c) for c in part.schema.names}
            before = [None] * n if first else columns["hit"].to_pylist()
            items = [[] for _ in range(n)] if first else columns["items"].to_pylist()
            hit = [b""] * n
            any_hit = sums_by_text(marks, words.text_offsets) > 0
            for i in range(n):
                own = before[i] or b""
                if any_hit[i]:
                    a, b = words.text_offsets[i : i + 2]
                    packed = np.packbits(marks[a:b])
                    hit[i] = (packed | np.frombuffer(own, np.uint8)).tobytes() if own else packed.tobytes()
                else:
                    hit[i] = own
                if i in found:
                    items[i] = sorted({*items[i], *(names[j] for j in found[i])})
            columns |= {"hit": pa.array(hit, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}
            columns["n_words"] = pa.array(words.counts)
            columns["n_hit"] = pa.array([int(np.bitwise_count(np.frombuffer(h, np.uint8)).sum()) for h in hit], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, T.StructType(fields))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """``docs`` with ``hit``, ``items``, ``n_words`` and ``n_hit`` for its column ``text``.

    ``hit`` has a bit for each word, set if the word lies inside an occurrence of a
    pattern (empty: none does); ``items`` has the ids found, as sorted strings.
    """
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(benchmark, window))
    blocks = max(1, -(-windows.count() // block_patterns))
    out = docs
    for block in range(blocks):
        # one block of bounded size at a time comes to the driver
        part = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).select("words", "items").collect()
        names = sorted({i for r in part for i in r["items"]})
        number = {name: i for i, name in enumerate(names)}
        rows = [(tuple(bytes(w) for w in r["words"]), [number[i] for i in r["items"]]) for r in part]
        context = spark.sparkContext
        out = _mark(out, context.broadcast(Searcher(rows)), context.broadcast(names), first=block == 0)
        if block < blocks - 1:
            out = materialize(out)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` per row of ``docs``.

    Other columns are left out.
    """
    marked = find_hits(id_and_text(docs, id_col, text_col), benchmark, window)
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items"
    ).withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no pattern occurs."""
    columns = docs.columns
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*columns).alias("row"))
    kept = find_hits(packed, benchmark, window).filter(F.length("hit") == 0)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in columns])
