"""Toxicity by a classifier chain over the presence of words.

The categories are predicted one after another. Each link of the chain is a logistic
regression over the words that a text holds, plus the probabilities of all earlier
categories. A later link is trained with *out-of-fold* probabilities: those of a model
that has not seen the row, so that it learns how far earlier predictions can be trusted.
After that each link is refitted on all training rows for prediction.

Training reads at most ``TRAINING_ROWS`` labelled documents, chosen by a hash of the id;
prediction reads every text whole. Words are runs of ASCII letters, digits and non-ASCII
characters, lower-cased for A-Z; the first bytes of a longer word (``HEADS``) are features
too, for inflected words. Near copies with equal labels are trained on once, or the labels
of one text would look like a rule: of rows that agree in all ``BAND`` least hashes of their
word triples, in one of ``BANDS`` bands, the one with the smallest id stays. That is done before
the sample is taken. Texts of fewer than three words are copies only if all their words are
equal. Of the features of the training rows only those in ``MIN_DOCS`` rows with a chi-square of
``MIN_CHI2`` or more over some category are used, at most ``FEATURES``, so that neither
chance nor the length of a text drowns the words that matter.

Null and empty texts hold no word and get the model's prior. Rows with a null label or a
null id are not trained on. If an id has several label rows, a category holds if any row says
so. A category with one value only in training gets that value as its probability; without any
training row every probability is 0. Repeated rows of ``docs`` each get a result.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.llm.arrow_text import (
    LOWER,
    Texts,
    binary_array,
    distinct_words,
    find_words,
    gather,
    id_and_text,
    slices,
    texts_of,
)
from gradeframe.session import materialize

TRAINING_ROWS = 20_000
FEATURES = 2_048
FOLDS = 3
#: A feature is in this many training rows.
MIN_DOCS = 3
#: Beyond what chance gives among features of that frequency.
MIN_CHI2 = 25.0
#: Texts with 90 % of their triples in common agree in a band in 93 of 100 cases, with half of them in 9.
BANDS = 3
BAND = 5
#: Bytes of the heads of words, and the mark of a head, which no word holds.
HEADS = (4, 6, 8)
HEAD = b"^"
THRESHOLD = 0.5

#: Bytes between words: white space and ASCII punctuation.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


class Link(NamedTuple):
    """One category: intercept, word weights, and weights of the earlier categories."""

    category: str
    intercept: float
    weights: np.ndarray
    chained: np.ndarray


class Chain(NamedTuple):
    words: pa.Array
    links: list[Link]


def _words(texts: Texts):
    lowered = Texts(LOWER[texts.data], texts.offsets)
    words = find_words(lowered, SEPARATOR)
    return words, *distinct_words(lowered, words, SEPARATOR)


def _features(texts: Texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct features of all texts; text and feature of every one that a text holds, once each."""
    words, dictionary, codes = _words(texts)
    spelled = texts_of(dictionary)
    found, owner, feature = [dictionary.cast(pa.large_binary())], words.text_of, codes
    owners, features = [owner], [feature]
    total = len(dictionary)
    for size in HEADS:
        longer = np.flatnonzero(spelled.lengths > size)
        starts = spelled.offsets[:-1][longer]
        heads = binary_array(*gather(spelled.data, starts, starts + size)).dictionary_encode()
        head_of = np.full(len(dictionary), -1, dtype=np.int64)
        head_of[longer] = heads.indices.to_numpy() + total
        found.append(pa.array([HEAD + h for h in heads.dictionary.to_pylist()], pa.large_binary()))
        total += len(heads.dictionary)
        head = head_of[codes]
        owners.append(owner[head >= 0])
        features.append(head[head >= 0])
    held = np.unique(np.concatenate(owners) * max(1, total) + np.concatenate(features))
    return pa.concat_arrays(found), held // max(1, total), held % max(1, total)


def _presence(texts: Texts, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and vocabulary number of every feature that a text holds, once each."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, owner, feature = _features(texts)
    known = pc.index_in(distinct, vocabulary).fill_null(-1).to_numpy()[feature]
    return owner[known >= 0], known[known >= 0]


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], limit: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, text, fold`` and the categories as 0/1 of a bounded, hash-ordered sample without copies."""
    known = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(
        *[F.max(F.col(c).cast("int")).alias(c) for c in categories]
    )
    read = id_and_text(docs)
    # texts stay where they are: only ids and sketches meet the labels
    sketched = _sketched(read.filter(F.col("doc_id").isNotNull())).drop("text").join(known, "doc_id")
    kept = _first_of_copies(sketched, categories).select("doc_id", *categories).distinct()
    rank = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    chosen = kept.withColumn("rank", rank).orderBy("rank", "doc_id").limit(limit).drop("rank")
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(FOLDS)).alias("fold")
    rows = read.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", fold, *categories)
    return without_copies(rows, categories)  # rows that repeat an id


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer of a multiplicative hash."""
    values = (values + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def _band_hashes(texts: Texts) -> list[np.ndarray]:
    """Per band and text one hash of the least hashes of its word triples."""
    words, dictionary, codes = _words(texts)
    word = np.array([zlib.crc32(w.as_buffer()) for w in dictionary], dtype=np.uint64)
    word = word[codes] if len(codes) else np.zeros(0, np.uint64)
    # three words from every place; beyond the end of its text a word is 0
    ends = np.repeat(words.text_offsets[1:], words.counts)
    after = lambda k: np.where(np.arange(len(word)) + k < ends, np.roll(word, -k), np.uint64(0))
    triples = _mixed(_mixed(_mixed(word, 1) + after(1), 2) + after(2), 3)
    # only whole triples, and one in a text of fewer words
    place = np.arange(len(word))
    triples = triples[(place + 2 < ends) | (place == np.repeat(words.text_offsets[:-1], words.counts))]
    sizes = np.where(words.counts > 0, np.maximum(words.counts - 2, 1), 0)
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    bands = []
    for band in range(BANDS):
        joined = np.zeros(len(sizes), dtype=np.uint64)
        for i in range(BAND):
            least = np.zeros(len(sizes), dtype=np.uint64)
            if len(starts):
                least[full] = np.minimum.reduceat(_mixed(triples, 4 + band * BAND + i), starts)
            joined = _mixed(joined + least, 5)
        bands.append(joined.view(np.int64))
    return bands


def _sketched(rows: DataFrame) -> DataFrame:
    """Adds the hashes of the bands to rows that have ``text``."""
    names = [f"band_{i}" for i in range(BANDS)]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches):
        for part, texts in slices(batches):
            columns = {c: part.column(c) for c in part.schema.names}
            yield pa.RecordBatch.from_pydict(columns | dict(zip(names, _band_hashes(texts))))

    return rows.mapInArrow(run, schema)


def _first_of_copies(sketched: DataFrame, categories: list[str]) -> DataFrame:
    """The row with the smallest id of those with equal categories that share a band."""
    kept = sketched
    for band in range(BANDS):
        keys = [f"band_{band}", *categories]
        others = [c for c in kept.columns if c not in (*keys, "doc_id")]
        first = F.min(F.struct("doc_id", *others)).alias("first")
        kept = kept.groupBy(*keys).agg(first).select(*keys, "first.*")
    return kept


def without_copies(rows: DataFrame, categories: list[str]) -> DataFrame:
    """One row of those near copies that have equal ``categories``."""
    return _first_of_copies(_sketched(rows), categories).select(*rows.columns)


def _word_counts(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Rows that hold a word, in all and per category."""
    schema = T.StructType(
        [T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]
        + [T.StructField(f"n_{c}", T.LongType()) for c in categories]
    )

    def run(batches):
        for part, texts in slices(batches):
            dictionary, owner, word = _features(texts)
            columns = {"word": dictionary, "n": np.bincount(word, minlength=len(dictionary))}
            for c in categories:
                label = part.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
                columns[f"n_{c}"] = np.bincount(word, weights=label[owner], minlength=len(dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_pydict(columns)

    sums = rows.mapInArrow(run, schema).groupBy("word").agg(
        F.sum("n").alias("n"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in categories]
    )
    return sums


def choose_words(rows: DataFrame, categories: list[str], features: int = FEATURES) -> list[bytes]:
    """The words of the training rows with the largest chi-square over any category."""
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    scores = []
    for c in categories:
        n, positive = F.lit(float(totals["n"])), F.lit(float(totals[c] or 0))
        expected = F.col("n") * positive / n
        spread = expected * (n - positive) / n * (n - F.col("n")) / n
        scores.append(F.coalesce(F.try_divide(F.pow(F.col(f"n_{c}") - expected, 2), spread), F.lit(0.0)))
    score = F.greatest(*scores) if len(scores) > 1 else scores[0]
    common = _word_counts(rows, categories).filter(F.col("n") >= MIN_DOCS)
    strong = common.withColumn("score", score).filter(F.col("score") >= MIN_CHI2)
    top = strong.orderBy(F.desc("score"), "word").limit(features)
    return sorted(bytes(r["word"]) for r in top.select("word").collect())


def _vectors(rows: DataFrame, vocabulary: pa.Array, categories: list[str]) -> DataFrame:
    keep = rows.drop("text")
    schema = T.StructType([*keep.schema.fields, T.StructField("words", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for part, texts in slices(batches):
            owner, word = _presence(texts, vocabulary)
            offsets = np.searchsorted(owner, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(word, pa.int32()))
            columns = {c: part.column(c) for c in part.schema.names if c != "text"} | {"words": lists}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, schema)


def _assembled(rows: DataFrame, size: int, earlier: list[str]) -> DataFrame:
    """Adds ``features``: word presence, then the probabilities of earlier categories."""

    @F.udf(VectorUDT())
    def vector(words, chained):
        extra = {size + i: p for i, p in enumerate(chained)}
        return SparseVector(size + len(chained), {w: 1.0 for w in words} | extra)

    chained = F.array(*[F.col(f"p_{c}") for c in earlier]) if earlier else F.array().cast("array<double>")
    return rows.withColumn("features", vector("words", chained))


def _fit(rows: DataFrame, category: str, size: int, earlier: list[str]) -> Link:
    values = {r[0]: r[1] for r in rows.groupBy(category).count().collect()}
    if len(values) < 2:
        constant = 50.0 if values and 1 in values else -50.0
        return Link(category, constant, np.zeros(size), np.zeros(len(earlier)))
    learner = LogisticRegression(
        featuresCol="features", labelCol=category, regParam=0.0003, elasticNetParam=0.0, standardization=False, maxIter=40
    )
    model = learner.fit(_assembled(rows, size, earlier).select("features", F.col(category).cast("double")))
    weights = model.coefficients.toArray()
    return Link(category, float(model.intercept), weights[:size], weights[size:])


def _with_probability(rows: DataFrame, link: Link, earlier: list[str]) -> DataFrame:
    """Adds ``p_<category>`` to training rows, from their word lists."""
    weights = F.split(F.lit(",".join(map(repr, link.weights.tolist()))), ",").cast("array<double>")
    margin = F.aggregate("words", F.lit(link.intercept), lambda s, w: s + F.element_at(weights, w + 1))
    for c, weight in zip(earlier, link.chained.tolist()):
        margin = margin + F.col(f"p_{c}") * F.lit(weight)
    return rows.withColumn(f"p_{link.category}", 1 / (1 + F.exp(-margin)))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], limit: int = TRAINING_ROWS) -> Chain:
    """Fit the links in the order of ``categories``, columns of ``labels`` that hold 0 or 1."""
    spark = docs.sparkSession
    sample = materialize(training_rows(docs, labels, categories, limit))
    vocabulary = choose_words(sample, categories)
    words = pa.array(vocabulary, pa.large_binary())
    size = max(1, len(vocabulary))
    # a bounded table in few partitions: each iteration of a fit is one small job
    few = spark.sparkContext.defaultParallelism
    rows = materialize(_vectors(sample, words, categories)).coalesce(few)
    links: list[Link] = []
    for i, category in enumerate(categories):
        earlier = categories[:i]
        links.append(_fit(rows, category, size, earlier))
        if i == len(categories) - 1:
            break
        parts = []
        for fold in range(FOLDS):
            link = _fit(rows.filter(F.col("fold") != fold), category, size, earlier)
            parts.append(_with_probability(rows.filter(F.col("fold") == fold), link, earlier))
        out_of_fold = parts[0]
        for part in parts[1:]:
            out_of_fold = out_of_fold.unionByName(part)
        rows = materialize(out_of_fold).coalesce(few)
    return Chain(words, links)


def _predict(texts: Texts, chain: Chain) -> list[np.ndarray]:
    n = len(texts.offsets) - 1
    owner, word = _presence(texts, chain.words)
    known: list[np.ndarray] = []
    for link in chain.links:
        margin = link.intercept + np.bincount(owner, weights=link.weights[word], minlength=n)
        for p, weight in zip(known, link.chained):
            margin = margin + p * weight
        known.append(1 / (1 + np.exp(-np.clip(margin, -700, 700))))
    return known


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` (which has ``text``) with ``p_<category>`` of every link."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by FEATURES
    names = [f"p_{link.category}" for link in chain.links]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, T.DoubleType()) for name in names]])

    def run(batches):
        model = sent.value
        for part, texts in slices(batches):
            columns = {c: part.column(c) for c in part.schema.names}
            yield pa.RecordBatch.from_pydict(columns | dict(zip(names, _predict(texts, model))))

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``p_<category>`` per category, and ``toxic``: the last one exceeds ``threshold``.

    Extra columns of either table are left out.
    """
    chain = fit_chain(docs, labels, categories)
    return score(id_and_text(docs), chain).drop("text").withColumn("toxic", F.col(f"p_{categories[-1]}") > threshold)


def clean_documents(
    docs: DataFrame, training_docs: DataFrame, labels: DataFrame, categories: list[str], threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected as toxic."""
    chain = fit_chain(training_docs, labels, categories)
    columns = docs.columns
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*columns).alias("row"))
    kept = score(packed, chain).filter(F.col(f"p_{categories[-1]}") <= threshold)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in columns])


def document_labels(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table ``labels`` as categories of a chain: low quality first, then toxicity."""
    rows = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return rows, ["low_quality", "toxic"]
