"""Secret scanning: patterns, and Markov models of characters for strings without a pattern.

Everything is a column expression or a grouping. Base spans are the matches of three
patterns. Two first-order Markov models of characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples; periodic runs are a third class, whose chain
is that of the run itself. Runs of identifier characters are
cut at the base spans; every piece of ``RUN_LENGTH`` or more is a span of kind ``random`` if
its log-likelihood ratio, random against the likelier of the others, exceeds ``THRESHOLD``.

The query's labelled samples come from the documents: the values of base matches are
random strings, long runs without a digit are ordinary. At most ``SAMPLE_VALUES`` distinct
values of each are used, the first by a hash. Without samples of both labels no run is
random.

Positions are code points, ends exclusive. Null and empty texts have no span. Every text is
read whole; repeated rows stay, other columns of ``docs`` are left out or, by
``redact``, kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the kinds in their order, their patterns, and what a match must have
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 6
# a run of 20 or 24 characters in all: no shorter match hides a longer one of these kinds
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

RUN_LENGTH = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{RUN_LENGTH},}}"
SAMPLE_RUN = r"[A-Za-z0-9+/_=-]{16,}"
SAMPLE_VALUES = 20_000
THRESHOLD = 12.0
ALPHABET = 66
#: Share of each model that is uniform, so that no character is impossible.
UNIFORM = {True: 0.5, False: 0.1}

#: Share of a periodic run's pairs that may be new.
NEW_PAIR = 0.1

SPAN = "array<struct<start:int,kind:int,end:int>>"
def _none() -> Column:
    return F.array().cast(SPAN)



def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Matches of ``pattern`` as spans; ``keep`` tells from the matches' second groups which stay."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(found, F.char_length)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    good = F.transform(found, lambda x: F.lit(True)) if keep is None else keep
    step = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), good.alias("good"))
    step = F.filter(step, lambda x: x["size"].isNotNull())
    # one walk over the matches: place so far, and spans so far
    start = F.struct(F.lit(0).alias("at"), _none().alias("spans"))

    def walk(state, x):
        begin = state["at"] + x["gap"]
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["size"]).alias("end")))
        spans = F.when(x["good"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((begin + x["size"]).alias("at"), spans.alias("spans"))

    spans = F.aggregate(step, start, walk, lambda state: state["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then kind."""
    long_enough = F.transform(
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= ASSIGN_LENGTH
    )
    return F.array_sort(
        F.concat(_spans(text, ASSIGN, 0, long_enough), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    )


def _outside(run: Column, base: Column) -> Column:
    """The pieces of ``run`` between the base spans, which come by start, that are long enough."""
    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    start = F.struct(run["start"].alias("at"), _none().alias("pieces"))

    def piece(state, end):
        one = F.array(F.struct(state["at"].alias("start"), run["kind"].alias("kind"), end.alias("end")))
        return F.when(end - state["at"] >= RUN_LENGTH, F.concat(state["pieces"], one)).otherwise(state["pieces"])

    def walk(state, b):
        return F.struct(F.greatest(state["at"], b["end"]).alias("at"), piece(state, b["start"]).alias("pieces"))

    return F.aggregate(touching, start, walk, lambda state: piece(state, run["end"]))


def _cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def document_samples(docs: DataFrame, limit: int = SAMPLE_VALUES) -> DataFrame:
    """``value, secret`` from ``docs`` (``text``): a bounded number of distinct values of each label."""
    text = F.col("text")
    values = F.concat(
        F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= 16),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
    )
    secret = docs.filter(text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX)).select(F.explode(values).alias("value"))
    runs = docs.select(F.explode(F.regexp_extract_all(text, F.lit(SAMPLE_RUN), F.lit(0))).alias("value"))
    ordinary = runs.filter(~F.col("value").rlike("[0-9]"))
    first = lambda df: df.distinct().orderBy(F.xxhash64("value"), "value").limit(limit)
    labelled = first(secret).withColumn("secret", F.lit(True))
    return labelled.unionByName(first(ordinary).withColumn("secret", F.lit(False)))


def _pairs(value: Column, of_pair) -> Column:
    """``of_pair`` of each two characters in a row; the value is split into characters once."""
    characters = F.filter(F.split(value, ""), lambda c: c != "")
    first = F.slice(characters, 1, F.greatest(F.size(characters) - 1, F.lit(0)))
    return F.zip_with(first, F.slice(characters, 2, F.size(first)), of_pair)


class Models(list):
    """Log-likelihood ratio of each pair of ASCII characters, at ``128 * first + second``; ``random`` has
    the logarithms under the model of random strings alone."""

    random: list[float]


def train(samples: DataFrame) -> Models:
    """The two models, from ``samples`` with ``value`` and ``secret``. Characters outside ASCII are not counted."""
    pairs = samples.select("secret", F.explode(_pairs(F.col("value"), lambda a, b: F.concat(a, b))).alias("pair"))
    pairs = pairs.filter(r"pair rlike '^[\\x00-\\x7F]{2}$'")
    counts = pairs.groupBy("secret", "pair").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * 128 * 128 rows
    seen: dict[tuple[bool, str], int] = {}
    for row in counts:
        seen[row["secret"], row["pair"][0]] = seen.get((row["secret"], row["pair"][0]), 0) + row["n"]
    of_pair = {(r["secret"], r["pair"]): r["n"] for r in counts}

    of_second: dict[tuple[bool, str], int] = {}
    for row in counts:
        of_second[row["secret"], row["pair"][1]] = of_second.get((row["secret"], row["pair"][1]), 0) + row["n"]
    totals = {label: sum(n for (s, _), n in of_second.items() if s == label) for label in (True, False)}

    def log_probability(secret: bool, pair: str) -> float:
        """After a character that the label never shows, its characters by themselves count."""
        total = seen.get((secret, pair[0]), 0)
        part, whole = (of_pair.get((secret, pair), 0), total) if total else (of_second.get((secret, pair[1]), 0), totals[secret])
        share = part / whole
        uniform = UNIFORM[secret]
        return math.log((1 - uniform) * share + uniform / ALPHABET)

    ratios = Models([0.0] * (128 * 128))
    ratios.random = [0.0] * (128 * 128)
    if all(any(s == label for s, _ in seen) for label in (True, False)):
        for a in range(128):
            for b in range(128):
                pair = chr(a) + chr(b)
                ratios.random[128 * a + b] = log_probability(True, pair)
                ratios[128 * a + b] = ratios.random[128 * a + b] - log_probability(False, pair)
    return ratios


def log_likelihood_ratio(value: Column, models: Models) -> Column:
    """Random against what is likelier of an ordinary identifier and a periodic run, over all character pairs.

    A periodic run (a ruled line, a repeated word) is a chain of its own: a pair that is new in the value has the
    share ``NEW_PAIR`` of the alphabet's; a pair seen before has the rest, divided by the square of how many
    followers a character of the value has on average, so that a chain without a period is unlikely.
    """
    table = lambda values: F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
    pairs = _pairs(value, lambda a, b: F.ascii(a) * 128 + F.ascii(b))
    total = lambda values: F.aggregate(F.transform(pairs, lambda p: F.element_at(table(values), p + 1)), F.lit(0.0), lambda s, x: s + x)
    distinct = F.array_distinct(pairs)
    again, new = F.size(pairs) - F.size(distinct), F.size(distinct)
    firsts = F.size(F.array_distinct(F.transform(distinct, lambda p: F.floor(p / 128))))
    followers = F.greatest(new, F.lit(1)) / F.greatest(firsts, F.lit(1))
    periodic = again * F.log((1 - NEW_PAIR) / (followers * followers)) + new * math.log(NEW_PAIR / ALPHABET)
    return F.least(total(models), total(models.random) - periodic)


def scan(docs: DataFrame, models: Models, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (which has ``text``) with ``base`` and ``spans``: arrays of start, kind and end."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("base", base_spans(text)).withColumn("runs", _spans(text, RUN, 3))
    pieces = F.flatten(F.transform("runs", lambda run: _outside(run, F.col("base"))))
    random = F.filter(pieces, lambda s: log_likelihood_ratio(_cut(text, s), models) > threshold)
    spans = F.array_sort(F.concat("base", random))
    return found.withColumn("spans", spans).drop("runs")


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    )


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, text, base, spans`` per row; ``samples`` default to those of the documents."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scan(read, train(document_samples(read) if samples is None else samples))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the digest of base spans, and all spans as text."""
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its ``text`` replaced by ``mark``; ``n_chars``, if there is one, follows."""
    columns = docs.columns
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*columns).alias("row"))
    found = scan(packed, train(document_samples(packed)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def walk(state, s):
        gap = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        apart = F.struct(s["end"].alias("at"), F.concat(state["out"], gap, F.lit(mark)).alias("out"))
        within = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        # a span that overlaps the one before is under the same mark
        return F.when((state["out"] == "") | (s["start"] >= state["at"]), apart).otherwise(within)

    done = F.aggregate("spans", start, walk)
    rest = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.char_length("text")))
    changed = found.withColumn("clean", F.when(F.size("spans") > 0, rest).otherwise(F.col("text")))
    field = F.col("row").getField
    kept = {c: field(c) for c in columns} | {"text": F.col("clean")}
    if "n_chars" in columns:
        same = F.size("spans") == 0
        size = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
        kept["n_chars"] = F.when(same, field("n_chars")).otherwise(size)
    return changed.select(*[kept[c].alias(c) for c in columns])
