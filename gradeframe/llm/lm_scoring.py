"""Language-model scores: prediction by partial matching, and a smoothed unigram base.

The model is a trie of byte contexts up to ``ORDER`` symbols, pretrained on the rows
that may be learnt from. A text's symbols are its bytes and an end. A symbol is coded in the longest
context seen in training, with method C escapes: a context with ``n`` occurrences of ``u`` symbols
gives a symbol seen ``c`` times ``c / (n + u)`` and the escape ``u / (n + u)``. After an
escape the next shorter context is used with all symbols of the longer one excluded, since
they would have been coded there; after the last one the symbols never seen share evenly.

Tasks count the longest grams; a grouping adds them up, and shorter contexts are sums of
longer ones. The trie is sent to tasks in blocks of at most about ``BLOCK_CELLS`` cells, by the last two symbols
of the context; every block is one pass over the texts, which adds the symbols that
fall into it, with a written table between passes. Order 1 and below, at most 257 * 257 cells, go with each block.

The base is a sum over words and one end of log10((c + 0.1) / (N + 0.1 (V + 1))). Counts
of the ``FREQUENT_WORDS`` most frequent words at most are broadcast; other words are joined by the word.

Null and empty texts are the end alone. Rows with a null id are scored, but not learnt
from. Texts of any length are read whole; repeated rows stay. An empty table has no
rows; if nothing can be learnt from, all symbols are equally likely and the base is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.llm.arrow_text import LOWER, Texts, distinct_words, find_words, slices, sums_by_text
from gradeframe.session import materialize, release

ORDER = 4
EDGE = 256
SYMBOLS = 257
BITS = 9
BLOCK_CELLS = 4_000_000
FREQUENT_WORDS = 400_000
#: Distinct values a task gathers before it passes them on.
GATHERED = 500_000
#: Bytes of text, and symbols, worked on at once; each symbol takes some 100 bytes.
SLICE = 1 << 20


def _grams(texts: Texts, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The last ``order + 1`` symbols at each symbol of each text, packed, and the texts' ranges."""
    n_texts = len(texts.offsets) - 1
    starts = texts.offsets[:-1] + np.arange(n_texts) * (order + 1)
    stream = np.full(len(texts.data) + n_texts * (order + 1), EDGE, dtype=np.int64)
    place = np.arange(len(texts.data)) + np.repeat(np.arange(1, n_texts + 1) * (order + 1) - 1, texts.lengths)
    stream[place] = texts.data
    packed = np.zeros(len(stream), dtype=np.int64)
    for back in range(order + 1):
        packed[back:] |= stream[: len(stream) - back] << (BITS * back)
    coded = np.ones(len(stream), dtype=bool)
    for i in range(order):
        coded[starts + i] = False
    return packed[coded], texts.offsets + np.arange(n_texts + 1)


def _lowered_words(texts: Texts):
    lowered = Texts(LOWER[texts.data], texts.offsets)
    words = find_words(lowered)
    return words, *distinct_words(lowered, words)


def _added_up(parts: Iterator[tuple[pa.Array, np.ndarray]], name: str) -> Iterator[pa.RecordBatch]:
    """Counts of equal values added up inside the task, in bounded memory."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        table = pa.concat_tables(held).group_by(name, use_threads=False).aggregate([("n", "sum")])
        return table.rename_columns([name, "n"])

    size = 0
    for values, counts in parts:
        held.append(pa.table({name: values, "n": counts}))
        size += len(values)
        if size > GATHERED:
            held = [merged()]
            size = len(held[0])
            if size > GATHERED // 2:
                yield from held[0].to_batches()
                held, size = [], 0
    if held:
        yield from merged().to_batches()


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, n``: how often each context of ``order`` symbols is followed by each symbol."""

    def run(batches):
        parts = (np.unique(_grams(texts, order)[0], return_counts=True) for _, texts in slices(batches, size=SLICE))
        yield from _added_up(((pa.array(g), n) for g, n in parts), "gram")

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts, lower-cased for A-Z."""

    def counted(texts: Texts):
        _, dictionary, codes = _lowered_words(texts)
        return dictionary, np.bincount(codes, minlength=len(dictionary))

    def run(batches):
        parts = (counted(texts) for _, texts in slices(batches, size=SLICE))
        for batch in _added_up(((d, n) for d, n in parts if len(d)), "word"):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), batch.column(1)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Level(NamedTuple):
    """Contexts of one length, sorted, with the cells ``context, symbol``, sorted too."""

    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    #: What remains in the next shorter context without this one's symbols.
    rest_total: np.ndarray
    rest_distinct: np.ndarray
    cells: np.ndarray
    counts: np.ndarray
    #: log10 of a cell's share of its context, escape included.
    direct: np.ndarray


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys, -1 for those that are not there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def build_levels(grams: np.ndarray, counts: np.ndarray, low_grams: np.ndarray, low_counts: np.ndarray, order: int) -> list[Level]:
    """Levels 0 to ``order``; level 1 and 0 come from ``low_grams``, pairs of symbols."""
    cells = {order: _sum_by(grams, counts)}
    for k in range(order - 1, 1, -1):
        cells[k] = _sum_by(cells[k + 1][0] & ((1 << BITS * (k + 1)) - 1), cells[k + 1][1])
    cells[1] = _sum_by(low_grams, low_counts)
    cells[0] = _sum_by(cells[1][0] & ((1 << BITS) - 1), cells[1][1])
    levels: list[Level] = []
    for k in range(order + 1):
        keys, n = cells[k]
        contexts, total = _sum_by(keys >> BITS, n)
        owner = np.searchsorted(contexts, keys >> BITS)
        distinct = np.bincount(owner, minlength=len(contexts))
        if k == 0:
            rest_total = rest_distinct = np.zeros(len(contexts), dtype=np.int64)
        else:
            below = levels[k - 1]
            shorter = np.searchsorted(below.contexts, contexts & ((1 << BITS * (k - 1)) - 1))
            same = below.counts[np.searchsorted(below.cells, keys & ((1 << BITS * k) - 1))]
            taken = np.bincount(owner, weights=same, minlength=len(contexts)).astype(np.int64)
            rest_total = below.total[shorter] - taken
            rest_distinct = below.distinct[shorter] - distinct
        direct = np.log10(n / (total + distinct)[owner]) if len(n) else np.zeros(0)
        levels.append(Level(contexts, total, distinct, rest_total, rest_distinct, keys, n, direct))
    return levels


def log_probabilities(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of the last symbol of each gram after the ones before it."""
    out = np.zeros(len(grams))
    left = np.arange(len(grams))  # not coded yet
    escaped = np.zeros(len(grams), dtype=bool)
    total = np.zeros(len(grams), dtype=np.int64)  # of what an escape has left in the next context
    distinct = np.zeros(len(grams), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        keys = grams[left] & ((1 << BITS * (k + 1)) - 1)
        cell = _find(level.cells, keys)
        first = (cell >= 0) & ~escaped[left]
        out[left[first]] += level.direct[cell[first]]
        later = (cell >= 0) & escaped[left]
        rows = left[later]
        out[rows] += np.log10(level.counts[cell[later]] / (total[rows] + distinct[rows]))
        left, keys = left[cell < 0], keys[cell < 0]
        context = _find(level.contexts, keys >> BITS)
        rows, at = left[context >= 0], context[context >= 0]
        n = np.where(escaped[rows], total[rows], level.total[at])
        u = np.where(escaped[rows], distinct[rows], level.distinct[at])
        open_ = u > 0  # else nothing but the escape is left, and it is certain
        out[rows[open_]] += np.log10(u[open_] / (n[open_] + u[open_]))
        escaped[rows] = True
        total[rows], distinct[rows] = level.rest_total[at], level.rest_distinct[at]
    seen = int(levels[0].distinct[0]) if len(levels[0].distinct) else 0
    out[left] -= np.log10(max(1, SYMBOLS - seen))
    return out


def _block_of(grams, blocks: int):
    """Block of a gram, by the two symbols before its last."""
    pair = (grams >> BITS) & ((1 << 2 * BITS) - 1)
    mixed = pair * 40503 & 0xFFFF
    return mixed % blocks


class Words(NamedTuple):
    """The frequent words and what every text needs of the unigram base."""

    words: pa.Array
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def term(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def _frequent(vocabulary: DataFrame, ends: int, limit: int) -> Words:
    histogram = sorted(vocabulary.groupBy("n").count().collect(), key=lambda r: -r["n"])  # few rows: sums of n are the corpus
    kept, least = 0, None
    for row in histogram:
        if kept + row["count"] > limit:
            break
        kept, least = kept + row["count"], row["n"]
    table = vocabulary.filter(F.col("n") >= (least if least is not None else 1 << 62)).select("word", "n").toArrow()
    tokens = sum(r["n"] * r["count"] for r in histogram) + ends
    distinct = sum(r["count"] for r in histogram) + (ends > 0)
    words = table.column("word").combine_chunks().cast(pa.large_binary())
    return Words(words, table.column("n").to_numpy(), tokens, distinct, ends)


def _block_scores(texts: Texts, levels: list[Level], block: int, blocks: int) -> np.ndarray:
    """Of each text, the sum over the symbols whose context is in the block."""
    grams, ranges = _grams(texts, len(levels) - 1)
    logs = np.zeros(len(grams))
    for at in range(0, len(grams), SLICE):
        some = grams[at : at + SLICE]
        own = np.ones(len(some), dtype=bool) if blocks == 1 else _block_of(some, blocks) == block
        # each distinct gram is looked up once, and in order, which keeps the searches close together
        distinct, place = np.unique(some[own], return_inverse=True)
        logs[at : at + SLICE][own] = log_probabilities(distinct, levels)[place]
    return sums_by_text(logs, ranges)


def _first_pass(docs: DataFrame, frequent: Words, levels: list[Level], blocks: int) -> DataFrame:
    """Adds a row number, the base of frequent words and the end, the other words, and the first block's score."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, levels))
    new = "row long, n_tokens long, n_known long, base double, other array<binary>, times array<bigint>, score double"
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(new).fields])

    def run(batches):
        model, levels = sent.value
        number = TaskContext.get().partitionId() << 36
        for part, texts in slices(batches, size=SLICE):
            words, dictionary, codes = _lowered_words(texts)
            known = pc.index_in(dictionary, model.words).fill_null(-1).to_numpy()
            c = model.counts[known] if len(model.counts) else np.zeros(len(known))
            term = np.where(known >= 0, model.term(c), 0.0) if len(known) else np.zeros(0)
            end = np.array([model.ends])
            n_known = sums_by_text((known >= 0)[codes].astype(np.int64), words.text_offsets) + int(model.ends > 0)
            rare = np.flatnonzero(known[codes] < 0)
            owner = np.searchsorted(words.text_offsets, rare, side="right") - 1
            size = max(1, len(dictionary))
            pairs, times = np.unique(owner * size + codes[rare], return_counts=True)
            ranges = pa.array(np.searchsorted(pairs, np.arange(part.num_rows + 1) * size), pa.int32())
            other = dictionary.take(pa.array(pairs % size)).cast(pa.binary())
            columns = {name: part.column(name) for name in part.schema.names} | {
                "row": number + np.arange(part.num_rows),
                "n_tokens": words.counts + 1,
                "n_known": n_known,
                "base": sums_by_text(term[codes] if len(term) else np.zeros(0), words.text_offsets) + model.term(end),
                "other": pa.ListArray.from_arrays(ranges, other),
                "times": pa.ListArray.from_arrays(ranges, pa.array(times, pa.int64())),
                "score": _block_scores(texts, levels, 0, blocks),
            }
            number += part.num_rows
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, schema)


def _add_block(rows: DataFrame, levels: list[Level], block: int, blocks: int) -> DataFrame:
    """Adds to ``score`` the symbols whose context is in the block."""
    sent = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for part, texts in slices(batches, size=SLICE):
            score = part.column("score").to_numpy() + _block_scores(texts, sent.value, block, blocks)
            columns = {name: part.column(name) for name in part.schema.names} | {"score": score}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, rows.schema)


def score(docs: DataFrame, learn: str = "true", order: int = ORDER, block_cells: int = BLOCK_CELLS, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    ``learn`` is a condition on ``doc_id`` and ``text``. Other columns are left out.
    """
    read = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    train = read.filter(F.expr(learn))
    vocabulary = materialize(word_counts(train))
    grams = materialize(gram_counts(train, order))
    known = _frequent(vocabulary, train.count(), frequent)
    pair = F.col("gram").bitwiseAND((1 << 2 * BITS) - 1).alias("gram")
    low = grams.groupBy(pair).agg(F.sum("n").alias("n")).toArrow()  # at most 257 * 257 rows
    blocks = max(1, -(-grams.count() // block_cells))
    spot = F.shiftright("gram", BITS).bitwiseAND((1 << 2 * BITS) - 1)
    own = F.pmod((spot * 40503).bitwiseAND(0xFFFF), F.lit(blocks))
    rows = None
    for block in range(blocks):
        part = grams.filter(own == block).toArrow()
        columns = [t.column(c).to_numpy() for t in (part, low) for c in ("gram", "n")]
        levels = build_levels(*columns, order)
        before = rows
        rows = _add_block(rows, levels, block, blocks) if block else _first_pass(read, known, levels, blocks)
        rows = materialize(rows if block < blocks - 1 else rows.drop("text"))
        if before is not None:
            release(before)
    other = rows.select("row", F.explode(F.arrays_zip("other", "times")).alias("x")).select(
        "row", F.col("x.other").alias("word"), "x.times"
    )
    c = F.coalesce("n", F.lit(0))
    term = F.log10((c + 0.1) / F.lit(known.tokens + 0.1 * (known.distinct + 1))) * F.col("times")
    sums = other.join(vocabulary, "word", "left").groupBy("row").agg(
        F.sum(term).alias("rest"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more")
    )
    return rows.join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )
