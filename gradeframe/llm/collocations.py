"""Phrases of words that keep together, counted by an FM-index per shard.

A shard is a run of texts of at most ``SHARD_BYTES``, or one longer text. Its words become
numbers, one stream with a 0 at the end of each piece. Two arrays are built from the stream, sorted
as deep as phrases are long: the words before each suffix (a Burrows-Wheeler transform), and the
same of the reversed stream. A phrase is an interval in both. Extending it to the
right reads the second one inside the interval: how often each word follows gives the counts and the
intervals of the longer phrases, and the words that are smaller give their place in the first
one; extending to the left is the mirror image. So phrases grow from words to pairs to
triples, only as deep as is asked for, and the intervals of a level are extended all at once.

Counts of shards are added up by phrase. Longer phrases are made only where they can be frequent:
a phrase is no more frequent than its parts, so words, then pairs, are added up
first, and a bit table of the frequent ones, of bounded size, goes to the next pass. Pairs are added up by
a 64-bit hash there. Nothing frequent is lost by that, and what passes is counted exactly.

A phrase of 2 or 3 words that occurs ``least`` times is a candidate. Cut into a first part and the rest, its
score is ``floor(1000000 a a / (l r))`` of the counts, at the lowest-scoring cut; all in decimals of 38 digits.
A candidate inside a longer one with at least half of its count goes.

A-Z are lower-cased. Null and empty texts have no words; a null language is ``und``. Repeated rows count again; ids
are not read. A very long text is a shard of its own, and a word of any length is one number. Equal scores are ordered by
count and then phrase, in bytes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.arrow_text import BLANK, LOWER, Texts, distinct_words, find_words, slices
from gradeframe.llm.key_filter import bit_table, may_hold
from gradeframe.session import materialize, stored_tables

SHARD_BYTES = 3 << 20
LEAST = 10
TOP = 2000

PIECE_END = np.zeros(256, dtype=bool)
PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
SEPARATOR = BLANK | PIECE_END


class Level(NamedTuple):
    """Phrases of one length: their words, first rows in both arrays, and counts."""

    words: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    count: np.ndarray


class _Side:
    """One of the two arrays: suffixes sorted by their first ``depth`` symbols, by the symbol before each."""

    def __init__(self, stream: np.ndarray, depth: int, symbols: int):
        rank = stream.astype(np.int64)
        for step in range(1, depth):
            following = np.zeros_like(rank)
            following[:-step] = stream[step:]
            rank = rank * symbols + following
            if step < depth - 1:
                _, rank = np.unique(rank, return_inverse=True)
        order = np.argsort(rank)
        self.before = stream[order - 1]  # of the first suffix: the 0 at the end
        #: Row of the suffix that begins with the symbol before.
        self.last_first = np.empty(len(stream), dtype=np.int64)
        self.last_first[np.argsort(self.before, kind="stable")] = np.arange(len(stream))

    def extend(self, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each interval and each symbol before it: the interval's number, the symbol, how often, the
        first row of the longer phrase here, and how many of the interval's rows have smaller symbols."""
        offsets = np.concatenate([[0], np.cumsum(counts)])
        rows = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], counts)
        owner = np.repeat(np.arange(len(starts)), counts)
        symbol = self.before[rows]
        order = np.argsort(owner * (int(self.before.max(initial=0)) + 1) + symbol, kind="stable")
        owner, symbol, rows = owner[order], symbol[order], rows[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(rows)))
        kept = symbol[at] > 0  # no phrase goes on over the end of a piece
        at, times = at[kept], times[kept]
        return owner[at], symbol[at], times, self.last_first[rows[at]], at - offsets[owner[at]]


class WordIndex:
    """A bidirectional index of a stream of word numbers from 1 on, with a 0 after each piece."""

    def __init__(self, stream: np.ndarray, longest: int):
        self.symbols = int(stream.max(initial=0)) + 1
        depth = max(1, longest - 1)
        self.forward = _Side(stream, depth, self.symbols)
        # the pieces end in 0 that way, too
        self.backward = _Side(np.append(stream[-2::-1], 0), depth, self.symbols)
        counts = np.bincount(stream, minlength=self.symbols)
        starts = np.cumsum(counts) - counts
        some = np.flatnonzero(counts[1:]) + 1
        self.words = Level(some[:, None], starts[some], starts[some], counts[some])

    def to_right(self, level: Level) -> Level:
        owner, symbol, times, row, smaller = self.backward.extend(level.backward, level.count)
        words = np.concatenate([level.words[owner], symbol[:, None]], axis=1)
        return Level(words, level.forward[owner] + smaller, row, times)

    def to_left(self, level: Level) -> Level:
        owner, symbol, times, row, smaller = self.forward.extend(level.forward, level.count)
        words = np.concatenate([symbol[:, None], level.words[owner]], axis=1)
        return Level(words, row, level.backward[owner] + smaller, times)


class _Shard:
    """The words of a shard: a number for each word of a language, and the stream of them."""

    def __init__(self, part: pa.RecordBatch, texts: Texts):
        texts = Texts(LOWER[texts.data], texts.offsets)
        words = find_words(texts, SEPARATOR)
        values, codes = distinct_words(texts, words, SEPARATOR)
        langs = part.column("lang").dictionary_encode()
        self.langs = langs.dictionary
        lang = langs.indices.to_numpy()[words.text_of]
        both, self.number = np.unique(codes * max(1, len(self.langs)) + lang, return_inverse=True)
        value, lang_of = np.divmod(both, max(1, len(self.langs)))
        self.lang_of, self.values = lang_of, values.take(pa.array(value))
        ends = np.concatenate([[0], np.cumsum(PIECE_END[texts.data])])[words.starts]
        new = np.ones(len(words.starts), dtype=bool)
        new[1:] = (ends[1:] != ends[:-1]) | (words.text_of[1:] != words.text_of[:-1])
        self.new_piece = new

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word of a language, as ``xxhash64(lang, word)`` gives it."""
        seeds = [xxhash.xxh64_intdigest(x, 42) for x in self.langs.to_pylist()]
        words = zip(self.values.to_pylist(), self.lang_of.tolist())
        return np.array([xxhash.xxh64_intdigest(w, seeds[i]) for w, i in words], dtype=np.uint64)

    def stream(self, kept: np.ndarray) -> np.ndarray:
        """Word numbers from 1 on, 0 for words that are not kept and after each piece."""
        number = np.where(kept[self.number], self.number + 1, 0) if len(self.number) else self.number
        return np.append(np.insert(number, np.flatnonzero(self.new_piece), 0)[1:], 0)

    def phrases(self, words: np.ndarray) -> pa.Array:
        """Phrases as one text each, the words, a tab and the language: what is shuffled is little more than that."""
        parts = [self.values.take(pa.array(words[:, i] - 1)) for i in range(words.shape[1])]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        lang = self.langs.take(pa.array(self.lang_of[words[:, 0] - 1])).cast(pa.string()).cast(pa.large_string()).cast(pa.large_binary())
        whole = pc.binary_join_element_wise(joined, lang, pa.scalar(b"\t", pa.large_binary()))
        return whole.cast(pa.binary()).cast(pa.string())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _pair_hashes(hashes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    first, second = hashes[pairs[:, 0] - 1], hashes[pairs[:, 1] - 1]
    # 48 bits, which shuffle as 6 bytes: pairs that share them only pass the filter together
    return _mixed(first * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(16)


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(F.col("text").cast("string").alias("text"), lang)


def _shards(batches) -> Iterator[_Shard]:
    for part, texts in slices(batches, size=SHARD_BYTES):
        yield _Shard(part, texts)


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, w0, n``: how often each word occurs."""

    def run(batches):
        for shard in _shards(batches):
            every = np.arange(1, len(shard.values) + 1)[:, None]
            n = np.bincount(shard.number, minlength=len(every)) if len(shard.number) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"phrase": shard.phrases(every), "n": n})

    return _summed(_texts(docs).mapInArrow(run, "phrase string, n long"), 1)


def _summed(rows: DataFrame, longest: int) -> DataFrame:
    """Counts of equal phrases, with the language and the words (null beyond the last one) apart."""
    sums = rows.groupBy("phrase").agg(F.sum("n").alias("n"))
    words = F.split(F.substring_index("phrase", "\t", 1), " ")
    lang = F.expr("substring(phrase, instr(phrase, '\\t') + 1)").alias("lang")
    return sums.select(lang, *[F.get(words, F.lit(i)).alias(f"w{i}") for i in range(longest)], "n")


def _pair_sums(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``key, n``: counts of the pairs of frequent words, by hash."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for shard in _shards(batches):
            hashes = shard.hashes()
            index = WordIndex(shard.stream(may_hold(sent.value, hashes)), 2)
            pairs = index.to_right(index.words)
            yield pa.RecordBatch.from_pydict({"key": _pair_hashes(hashes, pairs.words).view(np.int64), "n": pairs.count})

    return _texts(docs).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _phrase_sums(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, longest: int) -> DataFrame:
    """``lang, w0, w1, w2, n``: counts of the frequent pairs, and of the triples made of two of them."""
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches):
        for shard in _shards(batches):
            hashes = shard.hashes()
            index = WordIndex(shard.stream(may_hold(sent.value[0], hashes)), longest)
            two = index.to_right(index.words)
            kept = may_hold(sent.value[1], _pair_hashes(hashes, two.words))
            two = Level(*(x[kept] for x in two))
            known = np.sort(two.words[:, 0] * index.symbols + two.words[:, 1])
            found = [two]
            if longest > 2:
                three = index.to_left(two)
                head = three.words[:, 0] * index.symbols + three.words[:, 1]
                at = np.minimum(np.searchsorted(known, head), max(0, len(known) - 1))
                kept = known[at] == head if len(known) else np.zeros(0, dtype=bool)
                found.append(Level(*(x[kept] for x in three)))
            for level in found:
                yield pa.RecordBatch.from_pydict({"phrase": shard.phrases(level.words), "n": level.count})

    return _summed(_texts(docs).mapInArrow(run, "phrase string, n long"), longest)


def _scored(candidates: DataFrame, *cuts) -> DataFrame:
    """Adds ``l, r, score`` of the lowest-scoring cut, the first of equal ones."""
    def score(left: str, right: str):
        # exact for counts below 10 ** 15
        square = "cast(1000000 AS decimal(7,0)) * cast(a AS decimal(15,0)) * cast(a AS decimal(15,0))"
        return F.expr(f"({square}) div (cast({left} AS decimal(18,0)) * cast({right} AS decimal(18,0)))")

    options = [
        F.struct(score(left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
        for k, (left, right) in enumerate(cuts, 1)
    ]
    least = options[0] if len(options) == 1 else F.least(*options)
    return candidates.withColumn("best", least).select("*", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    with stored_tables(docs.sparkSession):
        words = materialize(word_counts(docs))
        n = words.groupBy("lang").agg(F.sum("n").alias("total"))
        frequent = materialize(words.filter(F.col("n") >= least).withColumn("key", F.xxhash64("lang", "w0")))
        word_bits = bit_table(frequent, "key")
        pairs = materialize(_pair_sums(docs, word_bits).filter(F.col("n") >= least).select("key"))
        phrases = materialize(_phrase_sums(docs, word_bits, bit_table(pairs, "key"), 3).filter(F.col("n") >= least))
        two = phrases.filter("w2 IS NULL").select("lang", "w0", "w1", F.col("n").alias("a"))
        three = phrases.filter("w2 IS NOT NULL").select("lang", "w0", "w1", "w2", F.col("n").alias("a"))

        def word(at: str, name: str) -> DataFrame:
            return frequent.select("lang", F.col("w0").alias(at), F.col("n").alias(name))

        def pair(at: str, then: str, name: str) -> DataFrame:
            return two.select("lang", F.col("w0").alias(at), F.col("w1").alias(then), F.col("a").alias(name))

        in_longer = three.select("lang", "w0", "w1", "a").unionByName(
            three.select("lang", F.col("w1").alias("w0"), F.col("w2").alias("w1"), "a")
        )
        in_longer = in_longer.groupBy("lang", "w0", "w1").agg(F.max("a").alias("longer"))
        alone = two.join(in_longer, ["lang", "w0", "w1"], "left").filter("longer IS NULL OR 100 * longer < 50 * a")
        twos = alone.join(word("w0", "f0"), ["lang", "w0"]).join(word("w1", "f1"), ["lang", "w1"])
        threes = (
            three.join(word("w0", "f0"), ["lang", "w0"])
            .join(word("w2", "f2"), ["lang", "w2"])
            .join(pair("w0", "w1", "f01"), ["lang", "w0", "w1"])
            .join(pair("w1", "w2", "f12"), ["lang", "w1", "w2"])
        )
        columns = ["lang", "a", "l", "r", "score"]
        every = _scored(twos, ("f0", "f1")).select(*columns, F.concat_ws(" ", "w0", "w1").alias("phrase")).unionByName(
            _scored(threes, ("f0", "f12"), ("f01", "f2")).select(*columns, F.concat_ws(" ", "w0", "w1", "w2").alias("phrase"))
        )
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase").cast("binary"))
        ranked = every.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
        return materialize(
            ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), keep=True
        )
