"""Language identification: first the family, then one-versus-one machines within it.

A text is represented by the shares of its hashed byte triples, after A-Z are lower-cased
and every other ASCII byte outside a-z has become a blank. Linear support vector machines
separate each pair of language families, and each pair of languages of one family. The
family with the most votes wins; then the language of that family with the most votes.

Machines are trained on at most about ``ROWS_PER_LANGUAGE`` documents of each language,
chosen by a hash of the id among those that may be learnt from; prediction reads every
text whole. A linear machine's margin is a sum of weights over the triples of the text,
so no vector is built for prediction.

A null text, or one without a letter, is ``und`` with score 0. If nothing can be learnt
from, every text is ``und``. A text with a letter but fewer than three bytes has no triple
and gets the machines' intercepts. Ties of votes go to the larger sum of margins, then to
the first name. Rows with a null id or language are not learnt from. Repeated rows stay.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.llm.arrow_text import Texts, id_and_text, slices
from gradeframe.session import materialize

ROWS_PER_LANGUAGE = 500
BUCKET_BITS = 13
SCALE = 30.0

# fixed values: families of languages by ISO 639-1 code; any other code is a family of its own
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
}

SYMBOL = np.arange(256, dtype=np.uint8)
SYMBOL[:128] = 0x20
SYMBOL[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
SYMBOL[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Machine(NamedTuple):
    """Separates two names: a margin above 0 votes for ``first``."""

    first: str
    second: str


class Model(NamedTuple):
    families: dict[str, list[str]]
    machines: list[Machine]
    intercepts: np.ndarray
    #: A row of margins for each bucket, and a row of zeros for places without a triple.
    weights: np.ndarray


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), f"only {language}")


def _buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the triple that begins at each byte, and triples per text."""
    n = len(texts.data)
    bucket = np.full(n, 1 << BUCKET_BITS, dtype=np.int64)
    if n >= 3:
        s = SYMBOL[texts.data].astype(np.uint32)
        packed = s[:-2] << 16 | s[1:-1] << 8 | s[2:]
        bucket[:-2] = (packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
        for back in (1, 2):
            ends = texts.offsets[1:][texts.lengths >= back] - back
            bucket[ends] = 1 << BUCKET_BITS
    return bucket, np.maximum(texts.lengths - 2, 0)


def _has_letter(texts: Texts) -> np.ndarray:
    marks = np.concatenate([[0], np.cumsum(ASCII_LETTER[texts.data])])
    found = marks[texts.offsets[1:]] > marks[texts.offsets[:-1]]
    letter = regex.compile(r"\p{L}")
    for i in np.flatnonzero(~found & (texts.lengths > 0)):
        raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = letter.search(raw) is not None
    return found


def training_rows(docs: DataFrame, learn: str, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``lang, words, shares`` of a bounded sample; ``learn`` is a condition on ``docs``."""
    allowed = docs.filter(F.expr(learn)).dropna(subset=["doc_id", "lang"])
    counts = {r["lang"]: r["count"] for r in allowed.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for language, count in counts.items():
        share = F.when(F.col("lang") == language, min(1.0, rows_per_language / count)).otherwise(share)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    schema = T.StructType(
        [
            T.StructField("lang", T.StringType()),
            T.StructField("bucket", T.ArrayType(T.IntegerType())),
            T.StructField("share", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches):
        for part, texts in slices(batches):
            bucket, total = _buckets(texts)
            lists, values = [], []
            for i in range(part.num_rows):
                own, times = np.unique(bucket[texts.offsets[i] : texts.offsets[i + 1]], return_counts=True)
                times = times[own < 1 << BUCKET_BITS]
                lists.append(own[own < 1 << BUCKET_BITS])
                values.append(times * (SCALE / max(1, total[i])))
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": part.column("lang").cast(pa.string()),
                    "bucket": pa.array(lists, pa.list_(pa.int32())),
                    "share": pa.array(values, pa.list_(pa.float64())),
                }
            )

    return allowed.filter(place < share).select("text", "lang").mapInArrow(run, schema)


def fit(docs: DataFrame, learn: str = "true", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Train all machines on the rows of ``docs`` (``doc_id, text, lang``) that meet ``learn``."""

    @F.udf(VectorUDT())
    def vector(bucket, share):
        return SparseVector(1 << BUCKET_BITS, bucket, share)

    sample = training_rows(docs, learn, rows_per_language).withColumn("features", vector("bucket", "share"))
    # a bounded table in few partitions: each iteration of a fit is one small job
    few = docs.sparkSession.sparkContext.defaultParallelism
    rows = materialize(sample.select("lang", "features")).coalesce(few)
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for language in languages:
        families.setdefault(family_of(language), []).append(language)
    machines, intercepts, weights = [], [], []
    tasks = [(a, b, families[a], families[b]) for a, b in combinations(sorted(families), 2)]
    tasks += [(a, b, [a], [b]) for members in families.values() for a, b in combinations(members, 2)]
    for a, b, left, right in tasks:
        chosen = rows.filter(F.col("lang").isin(left + right))
        labelled = chosen.select("features", F.col("lang").isin(left).cast("double").alias("label"))
        machine = LinearSVC(regParam=1e-4, maxIter=12, standardization=False).fit(labelled)
        machines.append(Machine(a, b))
        intercepts.append(machine.intercept)
        weights.append(np.append(machine.coefficients.toArray(), 0.0))
    table = np.stack(weights, axis=1) if weights else np.zeros(((1 << BUCKET_BITS) + 1, 0))
    return Model(families, machines, np.array(intercepts), table.astype(np.float32))


def _margins(texts: Texts, model: Model) -> np.ndarray:
    bucket, total = _buckets(texts)
    out = np.zeros((len(total), len(model.machines)))
    full = texts.lengths > 0
    if full.any():
        for k in range(len(model.machines)):
            each = model.weights[:, k][bucket]
            out[full, k] = np.add.reduceat(each, texts.offsets[:-1][full], dtype=np.float64)
    return out * (SCALE / np.maximum(1, total))[:, None] + model.intercepts


def _elect(names: list[str], margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winner of one-versus-one votes, and its mean logistic margin."""
    votes = np.zeros((len(margins), len(names)))
    strength = np.zeros_like(votes)
    for k, machine in enumerate(model.machines):
        if machine.first in names and machine.second in names:
            a, b = names.index(machine.first), names.index(machine.second)
            sure = 1 / (1 + np.exp(-np.clip(margins[:, k], -500, 500)))
            votes[:, a] += sure >= 0.5
            votes[:, b] += sure < 0.5
            strength[:, a] += sure
            strength[:, b] += 1 - sure
    winner = np.argmax(votes + strength / (2 * len(names)), axis=1)
    rivals = max(1, len(names) - 1)
    chance = strength[np.arange(len(margins)), winner] / rivals if len(names) > 1 else np.ones(len(margins))
    return winner, chance


def predict(texts: Texts, model: Model) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts.offsets) - 1
    names = np.full(n, "und", dtype=object)
    scores = np.zeros(n)
    if not model.families:
        return names, scores
    margins = _margins(texts, model)
    families = sorted(model.families)
    family, chance = _elect(families, margins, model)
    letters = _has_letter(texts)
    for i, name in enumerate(families):
        rows = np.flatnonzero((family == i) & letters)
        members = model.families[name]
        winner, within = _elect(members, margins[rows], model)
        names[rows] = np.array(members, dtype=object)[winner]
        scores[rows] = chance[rows] * within
    return names, scores


def identify(docs: DataFrame, learn: str = "true", rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``doc_id, lang_pred, score`` per row of ``docs`` (``doc_id, text, lang``).

    ``learn`` says which rows may be learnt from. Other columns are left out.
    """
    read = id_and_text(docs, "doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(read, learn, rows_per_language))
    schema = T.StructType(
        [read.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches):
        for part, texts in slices(batches):
            names, scores = predict(texts, sent.value)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": scores}
            )

    return read.select("doc_id", "text").mapInArrow(run, schema)
