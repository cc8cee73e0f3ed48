"""Best-fit packing of tokenized documents with certified bin counts.

Documents are tokenized once into pieces of at most ``capacity`` tokens, written to the
shared folder. Pieces are dealt to partitions of about ``PART_PIECES``; each partition packs
its own by best-fit decreasing and proves a lower bound on its bins with dual-feasible
functions: the area, the family that counts large pieces as whole bins and drops small
ones, and the rounding family. A partition whose count meets its bound is certified.

A partition with a gap gives all pieces of its bins that are not full to a pool; a certified
one gives its emptiest bin, since the bins of all partitions together are to be few. The
pool is dealt anew, so that partitions exchange documents, and packed again; rounds go on
while they save bins. A round that saves none is not applied.

A null or empty text is the one end id. Documents of more than ``capacity`` ids are cut
into full pieces and a last one, any others stay whole. Repeated rows are packed as often
as they occur, ties go to the earlier row. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from fractions import Fraction
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.llm.arrow_text import BLANK, LOWER, Texts, Words, distinct_words, find_words, id_and_text, slices
from gradeframe.session import materialize

CAPACITY = 4_096
END_ID = 1
#: Pieces packed by one task, some 2 MB.
PART_PIECES = 32_768
#: Word parts whose ids a worker process keeps, some 100 MB.
KEPT_WORDS = 500_000

#: Kinds of ASCII characters that the tokenizer never joins; non-ASCII letters go with letters.
LETTER, DIGIT, SIGN = 1, 2, 3
KIND = np.full(256, SIGN, dtype=np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
KIND[0x30:0x3A] = DIGIT
UNSAFE = np.zeros(256, dtype=bool)
UNSAFE[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F, *range(0x80, 0x100), *b"'<|>"]] = True


def _unsafe_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes that may join with what stands beside them: marks, quotes, most non-ASCII characters."""
    unsafe = UNSAFE[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # Latin letters, without the signs of times and division
    unsafe[lead] = unsafe[lead + 1] = False
    return unsafe


def split_words(texts: Texts) -> tuple[Texts, Words]:
    """Parts that the tokenizer encodes one by one, whatever stands beside them.

    It never joins characters across white space, nor letters, digits and other
    characters with each other, and it takes digits singly. A word with an unsafe byte
    stays whole; in others A-Z are lower-cased, as the tokenizer does.
    """
    words = find_words(texts, BLANK)
    marks = np.concatenate([[0], np.cumsum(_unsafe_bytes(texts.data))])
    safe = marks[words.ends] == marks[words.starts]
    change = np.zeros(len(texts.data) + 1, dtype=np.int8)
    change[words.starts[safe]] += 1
    change[words.ends[safe]] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    kind = KIND[texts.data]
    opens = np.zeros(len(texts.data), dtype=bool)
    opens[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    opens[words.starts] = True
    starts = np.flatnonzero(opens)
    following = np.append(starts[1:], len(texts.data))
    word = np.searchsorted(words.starts, starts, side="right") - 1
    ends = np.minimum(following, words.ends[word]) if len(starts) else starts
    data = np.where(inside, LOWER[texts.data], texts.data)
    return Texts(data, texts.offsets), Words(starts, ends, np.searchsorted(starts, texts.offsets))


class WordIds:
    """Ids of word parts; a part is tokenized the first time it is seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self):
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(0, dtype="<u4")
        self.ends = np.zeros(1, dtype=np.int64)

    def of(self, parts: list[bytes]) -> np.ndarray:
        """Numbers of the parts; part ``n`` has the ids from ``ends[n]`` up to ``ends[n + 1]``."""
        if len(self.number) > KEPT_WORDS:
            self._forget()
        new = [p for p in parts if p not in self.number]
        if new:
            encoding = self.tokenizer.encode([p.decode("utf-8") for p in new], is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.array(encoding.word_ids, dtype=np.int64), minlength=len(new))
            self.ids = np.concatenate([self.ids, np.array(encoding.ids, dtype="<u4")])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        return np.array([self.number[p] for p in parts], dtype=np.int64)


@lru_cache(maxsize=4)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def document_ids(texts: Texts, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id, and the offsets of the texts."""
    lowered, parts = split_words(texts)
    distinct, codes = distinct_words(lowered, parts, BLANK)
    known = _word_ids(path)
    numbers = known.of(distinct.to_pylist())[codes]
    sizes = np.diff(known.ends)[numbers]
    before = np.cumsum(sizes) - sizes
    index = np.arange(sizes.sum()) + np.repeat(known.ends[numbers] - before, sizes)
    totals = np.concatenate([[0], np.cumsum(sizes)])[parts.text_offsets]
    offsets = totals + np.arange(len(totals))
    out = np.full(offsets[-1], END_ID, dtype="<u4")
    word_place = np.ones(len(out), dtype=bool)
    word_place[offsets[1:] - 1] = False
    out[word_place] = known.ids[index]
    return out, offsets


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of all documents; map-only."""
    read = id_and_text(docs, id_col, text_col)
    long = T.LongType()
    names = ("start", "length", "ids_crc32")
    fields = [read.schema["doc_id"], T.StructField("piece", T.IntegerType()), *[T.StructField(n, long) for n in names]]

    def run(batches):
        for part, texts in slices(batches):
            ids, offsets = document_ids(texts, path)
            rows = []
            for i in range(part.num_rows):
                own = ids[offsets[i] : offsets[i + 1]]
                for number, start in enumerate(range(0, len(own), capacity)):
                    cut = own[start : start + capacity]
                    rows.append((i, number, start, len(cut), zlib.crc32(cut.tobytes())))
            owner, number, start, length, crc = (pa.array(c) for c in zip(*rows))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id").take(owner),
                    "piece": number.cast(pa.int32()),
                    "start": start,
                    "length": length,
                    "ids_crc32": crc,
                }
            )

    return read.mapInArrow(run, T.StructType(fields))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the fullest bin it fits."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: there is a bin with room r
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen, count = capacity, count, count + 1
        bins[i], offsets[i] = chosen, capacity - room
        left = room - length
        by_room[left].append(chosen)
        rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int, roundings: int = 12) -> int:
    """Bins that any packing needs, by dual-feasible functions of the lengths."""
    if not len(lengths):
        return 0
    values, counts = np.unique(lengths, return_counts=True)
    best = Fraction(int((values * counts).sum()), capacity)
    # pieces above capacity - e count as whole bins, those below e as nothing
    number, area = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(values * counts)])
    edges = values[values * 2 <= capacity]
    low = np.searchsorted(values, edges)
    high = np.searchsorted(values, capacity - edges, side="right")
    large = (number[-1] - number[high]) * capacity + area[high] - area[low]
    if len(large):
        best = max(best, Fraction(int(large.max()), capacity))
    over_half = int(counts[values * 2 > capacity].sum())
    best = max(best, Fraction(over_half))
    for k in range(1, roundings + 1):
        scaled = values * (k + 1)
        whole = scaled % capacity == 0
        exact = int((scaled[whole] // capacity * counts[whole]).sum())
        rounded = int((scaled[~whole] // capacity * counts[~whole]).sum())
        best = max(best, Fraction(exact, k + 1) + Fraction(rounded, k))
    return -(-best.numerator // best.denominator)


def _packed(pool: DataFrame, parts: int, capacity: int, number: int) -> DataFrame:
    """``pool`` dealt to ``parts`` partitions and packed in each; ``kept`` bins need no further round."""
    row = F.struct(F.monotonically_increasing_id(), F.lit(number))
    dealt = pool.withColumn("part", F.pmod(F.xxhash64(row), F.lit(parts)).cast("int"))
    added = {"sequence_id": T.LongType(), "offset": T.LongType(), "kept": T.BooleanType(), "certified": T.BooleanType()}
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(n, t) for n, t in added.items()]])

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        count = int(bins.max()) + 1
        fill = np.bincount(bins, weights=lengths, minlength=count)
        certified = count == lower_bound(lengths, capacity)
        kept = fill == capacity
        if certified:
            kept = np.ones(count, dtype=bool)
            kept[np.argmin(fill)] = fill.min() == capacity
        part = table.column("part")[0].as_py()
        sequence = (number << 52) + (part << 20) + bins
        for name, values in zip(added, (sequence, offsets, kept[bins], np.full(len(bins), certified))):
            table = table.append_column(name, pa.array(values))
        return table

    return dealt.groupBy("part").applyInArrow(pack, schema)


def pack(found: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length``."""
    columns = found.columns
    final = [*columns, "sequence_id", "offset"]

    def bins_of(df: DataFrame) -> tuple[int, int]:
        counted = df.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"))
        return tuple(counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first())

    pool = materialize(found)
    parts = max(1, -(-pool.count() // part_pieces))
    packed = materialize(_packed(pool, parts, capacity, 0))
    done = []
    for number in count(1):  # each round saves a bin or is the last
        released = packed.filter(~F.col("kept"))
        bins, left = bins_of(released) if parts > 1 else (0, 0)
        if not left:
            break
        parts = -(-left // part_pieces)
        again = materialize(_packed(released.select(columns), parts, capacity, number))
        if bins_of(again)[0] >= bins:
            break
        done.append(packed.filter("kept"))
        packed = again
    for rows in done:
        packed = packed.select(final).unionByName(rows.select(final))
    return packed.select(final)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces.

    Columns of ``docs`` other than its id and text are left out.
    """
    return pack(pieces(docs, path, capacity), capacity)
