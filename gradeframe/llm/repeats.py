"""Removal of repeated byte strings, by suffix arrays over shards that share an anchor.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else
in the texts. Equal strings meet in one shard, whatever texts they are in:

* *Anchors.* Of the 32-byte grams of a string, the leftmost one with the least hash is its anchor. Equal
  strings have it at the same place, so strings are described by anchor and distance to it.
* *Units.* Consecutive strings with the same anchor, at most ``UNIT`` of them and
  aligned to the anchor, are a unit. All of them hold the unit's *core*, 337 of the 400 bytes; a shard is
  a core. A core that occurs once has no repeated string and ends here.
* *Pre-aggregation.* Equal units are one unit with a count. A unit that occurs twice has only
  repeated strings. If all units of a core are equal, that is all.
* *Suffix arrays.* Different units with the same core are joined, the core as a single symbol, their
  suffixes put in order by Lyndon groups (``suffix_groups``), and neighbours in that order
  compared: a string is repeated if a neighbour begins with the same symbols, or if its
  unit is counted twice.
* *Hot cores.* A core with more than ``HOT_UNITS`` different units is not put in one
  task: each of its strings becomes a row of its own, and equal strings are counted by their digest.

Texts with equal bytes have equal results, so results come back to texts by a 128-bit digest.

Null and empty texts, and those shorter than a string, lose nothing. Strings do not cross texts. Repeated rows
stay, and are each other's repetitions. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.llm.arrow_text import Texts, id_and_text, slices
from gradeframe.llm.suffix_groups import suffix_array
from gradeframe.session import materialize

LENGTH = 400
GRAM = 32
UNIT = 64
HOT_UNITS = 512
#: Bits of the filters that spare texts and units the shuffle; 8 MB each.
FILTER_BITS = 26
#: Units whose suffixes are put in order at once.
PART_UNITS = 512


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on, by doubling; 0 where they end early."""
    table = np.random.default_rng(32).integers(0, 1 << 63, size=256, dtype=np.uint64)
    out = table[data]
    base, width = 0x9E3779B97F4A7C15, 1
    while width < GRAM:
        longer = np.zeros_like(out)
        longer[: len(out) - width] = out[: len(out) - width] * np.uint64(base) + out[width:]
        out, width, base = longer, 2 * width, base * base & 0xFFFFFFFFFFFFFFFF
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xD6E8FEB86659FD93)


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """Anchor of the string of ``length`` bytes from each position on; valid where it does not end early."""
    window = length - GRAM + 1
    low = np.uint64(0xFFFFFFFF)
    least = (_gram_hashes(data) & ~low) | np.arange(len(data), dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        least[: len(least) - width] = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = window - width
    if rest:
        least[: len(least) - rest] = np.minimum(least[: len(least) - rest], least[rest:])
    return (least & low).astype(np.int64)


def find_units(texts: Texts, length: int = LENGTH, unit: int = UNIT) -> tuple[np.ndarray, ...]:
    """Text, first start, number of strings, core's start and core's number of every unit."""
    data, offsets = texts
    long_enough = np.flatnonzero(texts.lengths >= length)
    if not len(long_enough):
        return (np.zeros(0, np.int64),) * 5
    anchor = _anchors(data, length)
    counts = texts.lengths[long_enough] - length + 1
    firsts = offsets[:-1][long_enough]
    before = np.cumsum(counts) - counts
    starts = np.arange(counts.sum()) + np.repeat(firsts - before, counts)
    owner = np.repeat(long_enough, counts)
    number = (anchor[starts] - starts) // unit
    change = np.ones(len(starts), dtype=bool)
    change[1:] = (anchor[starts][1:] != anchor[starts][:-1]) | (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(change)
    size = np.diff(np.append(first, len(starts)))
    core = anchor[starts[first]] - unit * number[first]
    return owner[first], starts[first], size, core, number[first]


def _unit_rows(texts: Texts, length: int, unit: int):
    """Of each unit: text, start in it, strings, digests of core and content, and where it and its core start and end."""
    owner, start, size, core, number = find_units(texts, length, unit)
    raw = texts.data.tobytes()
    digest = xxhash.xxh3_64_intdigest
    core_length = length - unit + 1
    cores = [digest(raw[c : c + core_length], s) for c, s in zip(core.tolist(), number.tolist())]
    ends = start + size + length - 1
    contents = [digest(raw[a:b], c - a) for a, b, c in zip(start.tolist(), ends.tolist(), (core + unit).tolist())]
    signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
    return owner, start - texts.offsets[:-1][owner], size, signed(cores), signed(contents), start, core, ends


def _text_keys(texts: Texts) -> np.ndarray:
    raw = texts.data.tobytes()
    edges = texts.offsets.tolist()
    digests = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(edges, edges[1:]))
    return np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)


def _distinct(texts: Texts) -> tuple[Texts, np.ndarray, np.ndarray]:
    """The distinct texts, their keys, and how often each occurs."""
    keys = _text_keys(texts)
    _, first, times = np.unique(keys, axis=0, return_index=True, return_counts=True)
    raw = texts.data.tobytes()
    kept = [raw[texts.offsets[i] : texts.offsets[i + 1]] for i in first]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int64)
    return Texts(np.frombuffer(b"".join(kept), dtype=np.uint8), offsets), keys[first], times


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Bits set for all ``core`` values; its size does not depend on their number."""
    spot = F.col("core").bitwiseAND((1 << FILTER_BITS) - 1)
    word = F.shiftright(spot, 5).cast("int").alias("word")
    bit = F.expr("shiftleft(1L, cast(core & 31 AS int))")
    bits = keys.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    table[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint32)
    return table


def _passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = keys & ((1 << FILTER_BITS) - 1)
    return (table[spot >> 5] >> (spot & 31).astype(np.uint32)) & 1 > 0


def core_counts(docs: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """``core, mixed`` of every core that occurs more than once; mixed: in different units."""

    def run(batches):
        for _, texts in slices(batches):
            distinct, _, times = _distinct(texts)
            owner, _, _, core, content, *_ = _unit_rows(distinct, length, unit)
            yield pa.RecordBatch.from_pydict({"core": core, "content": content, "n": times[owner]})

    units = docs.select("text").mapInArrow(run, "core long, content long, n long")
    total = units.groupBy("core").agg(
        F.sum("n").alias("n"), F.min("content").alias("least"), F.max("content").alias("most")
    )
    return total.filter("n > 1").select("core", (F.col("least") != F.col("most")).alias("mixed"))


def _candidates(docs: DataFrame, repeated: np.ndarray, mixed: np.ndarray, length: int, unit: int) -> DataFrame:
    """The units whose core may be repeated; if it may be mixed, with the bytes before and after
    the core and a second digest of it."""
    sent = docs.sparkSession.sparkContext.broadcast((repeated, mixed))
    schema = "core long, content long, n long, key_a long, key_b long, start long, size int, check long, left binary, right binary"

    def run(batches):
        any_, several = sent.value
        for _, texts in slices(batches):
            distinct, keys, times = _distinct(texts)
            owner, start, size, core, content, begin, middle, end = _unit_rows(distinct, length, unit)
            chosen = np.flatnonzero(_passes(any_, core))
            needed = _passes(several, core[chosen])
            raw = distinct.data.tobytes()
            edges = list(zip(begin[chosen].tolist(), middle[chosen].tolist(), end[chosen].tolist(), needed.tolist()))
            core_length = length - unit + 1
            digest = xxhash.xxh3_64_intdigest
            check = [digest(raw[c : c + core_length], 1 << 32) - (1 << 63) if x else None for _, c, _, x in edges]
            owner = owner[chosen]
            yield pa.RecordBatch.from_pydict(
                {
                    "core": core[chosen],
                    "content": content[chosen],
                    "n": times[owner],
                    "key_a": keys[owner, 0],
                    "key_b": keys[owner, 1],
                    "start": start[chosen],
                    "size": pa.array(size[chosen], pa.int32()),
                    "check": pa.array(check, pa.int64()),
                    "left": pa.array([raw[a:c] if x else None for a, c, _, x in edges], pa.binary()),
                    "right": pa.array([raw[c + core_length : b] if x else None for _, c, b, x in edges], pa.binary()),
                }
            )

    return docs.select("text").mapInArrow(run, schema)


def repeated_strings(
    cores: list, lefts: list[bytes], rights: list[bytes], sizes: list[int], counts: list[int], unit: int = UNIT
) -> list[np.ndarray]:
    """Of each unit, which of its strings start a repetition, by one suffix array of all units.

    A core stands for all its bytes as one symbol of its own, so each string is ``unit`` symbols long.
    """
    numbers: dict = {}
    symbols: list[int] = []
    starts = []
    for core, left, right in zip(cores, lefts, rights):
        starts.append(len(symbols))
        symbols.extend(left)
        symbols.append(257 + numbers.setdefault(core, len(numbers)))
        symbols.extend(right)
        symbols.append(256)
    array = np.array(suffix_array(symbols), dtype=np.int64)
    text = np.array(symbols, dtype=np.int32)
    is_string = np.zeros(len(text), dtype=bool)
    for s, n in zip(starts, sizes):
        is_string[s : s + n] = True
    array = array[is_string[array]]
    repeated = np.zeros(len(text), dtype=bool)
    left, right = array[:-1], array[1:]
    steps = np.arange(unit)
    for at in range(0, len(left), 1 << 16):
        a, b = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
        near = text[a] == text[b]
        a, b = a[near], b[near]
        same = (text[a[:, None] + steps] == text[b[:, None] + steps]).all(axis=1)
        repeated[a[same]] = True
        repeated[b[same]] = True
    return [repeated[s : s + n] | (c > 1) for s, n, c in zip(starts, sizes, counts)]


def _as_mask(marks: np.ndarray) -> int:
    mask = sum(1 << i for i in np.flatnonzero(marks).tolist())
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _resolve(distinct: DataFrame, unit: int) -> DataFrame:
    """``core, check, content, mask``: the repeated strings of different units with a core, as bits."""
    parts = max(1, -(-distinct.count() // PART_UNITS))
    # every part has some 300 kB; a core's units are together and few
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("core"), F.lit(parts)))

    def work(table: pa.Table) -> pa.Table:
        names = ("core", "check", "left", "right", "size", "n")
        core, check, lefts, rights, sizes, counts = (table.column(c).to_pylist() for c in names)
        masks = [_as_mask(m) for m in repeated_strings(list(zip(core, check)), lefts, rights, sizes, counts, unit)]
        columns = {c: table.column(c) for c in ("core", "check", "content")}
        return pa.table(columns | {"mask": pa.array(masks, pa.int64())})

    return dealt.groupBy("part").applyInArrow(work, "core long, check long, content long, mask long")


def _resolve_hot(distinct: DataFrame, unit: int) -> DataFrame:
    """The same by one row a string, for cores with very many different units."""

    def strings(batches):
        for batch in batches:
            at, place, digests = [], [], []
            for i, row in enumerate(batch.select(["core", "check", "left", "right", "size"]).to_pylist()):
                core = row["core"].to_bytes(8, "little", signed=True) + row["check"].to_bytes(8, "little", signed=True)
                for j in range(row["size"]):
                    before = row["left"][j:]
                    string = core + bytes([len(before)]) + before + row["right"][: unit - 1 - len(before)]
                    at.append(i)
                    place.append(j)
                    digests.append(xxhash.xxh3_128_digest(string))
            rows = batch.select(["core", "check", "content", "n"]).take(pa.array(at, pa.int64()))
            columns = {name: rows.column(name) for name in rows.schema.names}
            yield pa.RecordBatch.from_pydict(
                columns | {"place": pa.array(place, pa.int32()), "string": pa.array(digests, pa.binary())}
            )

    each = materialize(
        distinct.mapInArrow(strings, "core long, check long, content long, n long, place int, string binary")
    )
    again = each.groupBy("string").agg(F.sum("n").alias("n")).filter("n > 1").select("string")
    bit = F.expr("shiftleft(1L, place)")
    return each.join(again, "string", "left_semi").groupBy("core", "check", "content").agg(F.bit_or(bit).alias("mask"))


def repeated_starts(docs: DataFrame, length: int = LENGTH, unit: int = UNIT, hot_units: int = HOT_UNITS) -> DataFrame:
    """``key_a, key_b, spans``: per distinct text, ``start`` and ``mask`` of its units with repeated strings."""
    cores = materialize(core_counts(docs, length, unit))
    found = materialize(_candidates(docs, _filter_of(cores), _filter_of(cores.filter("mixed")), length, unit))
    known = found.join(cores, "core")
    place = F.struct("start", "mask").alias("span")
    every = F.expr("CASE WHEN size = 64 THEN -1L ELSE ~shiftleft(-1L, size) END").alias("mask")
    whole = known.filter(~F.col("mixed")).select("key_a", "key_b", "start", every)
    mixed = materialize(known.filter("mixed").drop("mixed"))
    first = [F.first(c).alias(c) for c in ("left", "right", "size")]
    distinct = materialize(mixed.groupBy("core", "check", "content").agg(F.sum("n").alias("n"), *first))
    hot = distinct.groupBy("core").count().filter(F.col("count") > hot_units).select("core")
    masks = _resolve(distinct.join(hot, "core", "left_anti"), unit).unionByName(
        _resolve_hot(distinct.join(hot, "core", "left_semi"), unit)
    )
    solved = mixed.join(materialize(masks), ["core", "check", "content"]).filter("mask != 0").select("key_a", "key_b", "start", "mask")
    # a text's spans are as many as it is long
    return whole.unionByName(solved).groupBy("key_a", "key_b").agg(F.collect_set(place).alias("spans"))


def _removed(size: int, starts: np.ndarray, masks: np.ndarray, length: int) -> np.ndarray:
    """Marks of the bytes that a repeated string covers."""
    change = np.zeros(size + length + 64, dtype=np.int64)
    bits = np.unpackbits(masks.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    unit, place = np.nonzero(bits)
    begins = starts[unit] + place
    np.add.at(change, begins, 1)
    np.add.at(change, begins + length, -1)
    return np.cumsum(change[:size]) > 0


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` (which has ``text``) with the digest of each text."""
    schema = T.StructType([*docs.schema.fields, T.StructField("key_a", T.LongType()), T.StructField("key_b", T.LongType())])

    def run(batches):
        for part, texts in slices(batches):
            keys = _text_keys(texts)
            columns = {name: part.column(name) for name in part.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"key_a": keys[:, 0], "key_b": keys[:, 1]})

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) per row of ``docs``.

    Other columns are left out. ``unit`` is at most 64.
    """
    read = id_and_text(docs)
    found = repeated_starts(read, length, unit)
    joined = with_keys(read).join(found, ["key_a", "key_b"], "left").select("doc_id", "text", "spans")
    counts = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([read.schema["doc_id"], *counts, T.StructField("kept", T.BinaryType())])

    def run(batches):
        for part, texts in slices(batches):
            removed, spans, kept = [], [], []
            for i, found in enumerate(part.column("spans")):
                own = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
                if not found.is_valid:
                    removed.append(0)
                    spans.append(0)
                    kept.append(own.tobytes())
                    continue
                fields = found.values
                marks = _removed(len(own), fields.field("start").to_numpy(), fields.field("mask").to_numpy(), length)
                removed.append(int(marks.sum()))
                spans.append(int(marks[:1].sum() + (marks[1:] & ~marks[:-1]).sum()))
                kept.append(own[~marks].tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": texts.lengths,
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(spans, pa.int64()),
                    "kept": pa.array(kept, pa.binary()),
                }
            )

    return joined.mapInArrow(run, schema)


def repeat_digest(docs: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """``remove_repeats`` with the SHA-256 of the remaining bytes for the bytes."""
    done = remove_repeats(docs, length, unit)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
