"""Token counts of a byte-level BPE vocabulary by finite-state transducers.

Two deterministic transducers in cascade count the tokens of a text:

* The *splitter* reads characters and marks where a pre-token starts. Its maps from
  states to states form a finite monoid, so a chunk of text is one element of it:
  chunks are composed by table look-ups, a parallel prefix scan over the chunks gives
  the state at which each one is entered, and a second look-up pass emits the marks.
* The *merger* reads the bytes of a pre-token. Its state holds, for every suffix that
  may still grow into a longer token, the place in the vocabulary trie, the last token
  before the suffix and the token count there. Merging is decided between neighbouring
  tokens, so this is all that matters for the rest. Each transition carries the change
  of the token count. Transitions are compiled when they are first taken and kept for the
  life of a worker process; at ``MAX_TRANSITIONS`` all are forgotten, also within a text, and compiled anew as they are taken.

Null and empty texts have no tokens. Texts of any length are read whole; repeated rows
stay. Strings of special tokens inside a text count as the one special token, as the
tokenizer file defines them.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gradeframe.llm.arrow_text import Texts, binary_array, id_and_text, slices, sums_by_text, texts_of

CHUNK = 64
MAX_TRANSITIONS = 1_000_000

# Symbols and states of the splitter. The pattern it stands for is
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, STMD, RV, ELL, EE, END = range(11)
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_WHITE, LONG_SPACE, LONG_WHITE, QUOTED, QUOTED_RV, QUOTED_L) = range(11)
HERE, BEFORE = 1, 2  # a pre-token starts at this character, at the one before
LETTERS = (LETTER, STMD, RV, ELL, EE)


def _splitter_step(state: int, symbol: int) -> tuple[int, int]:
    """Next state and marks."""
    if symbol == END:
        return FRESH, BEFORE if state in (QUOTED_RV, QUOTED_L) else 0
    if state == QUOTED and symbol in (STMD, RV, ELL):
        return {STMD: FRESH, RV: QUOTED_RV, ELL: QUOTED_L}[symbol], 0
    if (state, symbol) in ((QUOTED_RV, EE), (QUOTED_L, ELL)):
        return FRESH, 0
    if state in (QUOTED_RV, QUOTED_L):  # the quote stood alone and letters began after it
        following, marks = _splitter_step(IN_LETTERS, symbol)
        return following, marks | BEFORE
    if symbol in (SPACE, WHITE):
        if state in (ONE_SPACE, ONE_WHITE, LONG_SPACE, LONG_WHITE):
            return (LONG_SPACE if symbol == SPACE else LONG_WHITE), 0
        return (ONE_SPACE if symbol == SPACE else ONE_WHITE), HERE
    kind = IN_LETTERS if symbol in LETTERS else IN_NUMBERS if symbol == NUMBER else IN_OTHERS
    if state == ONE_SPACE:
        return kind, 0
    if state == LONG_SPACE:
        return kind, BEFORE
    marks = HERE | (BEFORE if state == LONG_WHITE else 0)
    if state == kind or (state == QUOTED and kind == IN_OTHERS):
        return kind, 0
    return (QUOTED if symbol == QUOTE else kind), marks


@lru_cache(maxsize=1)
def _splitter():
    """Transitions, marks, the element of each symbol, products, and maps of all elements."""
    steps = [[_splitter_step(s, c) for c in range(11)] for s in range(11)]
    following = np.array([[x[0] for x in row] for row in steps], dtype=np.uint8)
    marks = np.array([[x[1] for x in row] for row in steps], dtype=np.uint8)
    identity = tuple(range(11))
    elements, order, at = {identity: 0}, [identity], 0
    letters = [tuple(following[:, c].tolist()) for c in range(11)]
    while at < len(order):  # closure under reading one more symbol
        for letter in letters:
            new = tuple(letter[s] for s in order[at])
            if new not in elements:
                elements[new] = len(order)
                order.append(new)
        at += 1
    maps = np.array(order, dtype=np.uint8)
    product = np.array([[elements[tuple(b[s] for s in a)] for b in order] for a in order], dtype=np.uint16)
    return following, marks, np.array([elements[x] for x in letters], np.uint16), product, maps


@lru_cache(maxsize=4)
def _character_symbols(path: str) -> np.ndarray:
    """Symbol of every code point, as the tokenizer file's own splitter tells letters, numbers and blanks apart.

    All code points in a row are split into runs of one kind; each run's kind shows in how its
    first character keeps to a letter, a number and a mark beside it.
    """
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in " '"]
    starts = [begin for _, (begin, _) in split("".join(map(chr, points)))]

    def apart(before: str, after: str) -> np.ndarray:
        """Of each run, whether its first character is apart from the one before it, and from the one after."""
        text = "".join(f"{before}{chr(points[i])}{after}" for i in starts)
        begins = np.zeros(3 * len(starts), dtype=bool)
        begins[[begin for _, (begin, _) in split(text)]] = True
        return begins.reshape(-1, 3)[:, 1:]

    letter = ~apart("a", "!")[:, 0]
    number = ~apart("1", "!")[:, 0]
    mark = ~apart("!", "a")[:, 0]
    kind = np.select([letter, number, mark], [LETTER, NUMBER, OTHER], WHITE)
    symbols = np.full(0x110000, OTHER, dtype=np.uint8)
    symbols[points] = np.repeat(kind, np.diff([*starts, len(points)]))
    for symbol, letters in ((SPACE, " "), (QUOTE, "'"), (STMD, "stmd"), (RV, "rv"), (ELL, "l"), (EE, "e")):
        symbols[[ord(c) for c in letters]] = symbol
    return symbols


def _code_points(data: np.ndarray, leads: np.ndarray) -> np.ndarray:
    lead = data[leads]
    points = lead.astype(np.int32)
    for first, last, keep, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        chosen = np.flatnonzero((lead >= first) & (lead < last))
        value = data[leads[chosen]].astype(np.int32) & keep
        for i in range(1, more + 1):
            value = (value << 6) | (data[leads[chosen] + i] & 0x3F)
        points[chosen] = value
    return points


def pretoken_starts(texts: Texts, tokenizer_path: str) -> np.ndarray:
    """Byte positions at which the pre-tokens of the texts start."""
    following, marks, letter_of, product, maps = _splitter()
    leads = np.flatnonzero((texts.data & 0xC0) != 0x80)
    symbols = _character_symbols(tokenizer_path)[_code_points(texts.data, leads)]
    # an END after each text, so that no pre-token spans two
    ends = np.searchsorted(leads, texts.offsets[1:]) + np.arange(1, len(texts.offsets))
    n = len(symbols) + len(ends)
    is_end = np.zeros(n, dtype=bool)
    is_end[ends - 1] = True
    stream = np.full(-(-n // CHUNK) * CHUNK, END, dtype=np.uint8)
    stream[:n][~is_end] = symbols
    lanes = np.ascontiguousarray(stream.reshape(-1, CHUNK).T)
    # each chunk as one element of the monoid
    whole = letter_of[lanes[0]]
    by_symbol = product[:, letter_of].ravel()
    for row in lanes[1:]:
        whole = by_symbol[whole.astype(np.intp) * 11 + row]
    # parallel prefix scan over the chunks
    step = 1
    while step < len(whole):
        whole = np.concatenate([whole[:step], product[whole[:-step], whole[step:]]])
        step *= 2
    state = np.full(lanes.shape[1], FRESH, dtype=np.uint8)
    state[1:] = maps[whole[:-1], FRESH]
    emitted = np.empty_like(lanes)
    marks, following = marks.ravel(), following.ravel().astype(np.intp) * 11
    state = state.astype(np.intp) * 11
    for i, row in enumerate(lanes):
        taken = state + row
        emitted[i] = marks[taken]
        state = following[taken]
    emitted = emitted.T.reshape(-1)[:n]
    start = (emitted & HERE) > 0
    start[:-1] |= (emitted[1:] & BEFORE) > 0
    return leads[start[~is_end]]


class Merger:
    """The transducer over the bytes of a pre-token, compiled as it is used."""

    def __init__(self, vocabulary: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]):
        self.merges = merges
        self.valid: dict[tuple[bytes, bytes], bool] = {}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for token in vocabulary:
            if self._merged(token) != [token]:
                continue  # never the result of merges
            node = 0
            for byte in token:
                if byte not in self.child[node]:
                    self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                node = self.child[node][byte]
            self.token[node] = token
        self._reset()

    def _reset(self, kept: tuple[tuple, ...] = ()):
        """Forget all transitions, and all states but the first one and those that are kept."""
        self.states: list[tuple] = [((0, b"", 0),), *kept]
        self.index = {state: i for i, state in enumerate(self.states)}
        self.valid.clear()
        self.bits = 12
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int64)
        self.size = 0

    def _merged(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.merges.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _adjacent(self, left: bytes, right: bytes) -> bool:
        """Whether merging ``left + right`` gives these two tokens."""
        if not left:
            return True
        pair = (left, right)
        if pair not in self.valid:
            self.valid[pair] = self._merged(left + right) == [left, right]
        return self.valid[pair]

    def _compile(self, state: int, byte: int) -> int:
        """Next state and change of the count, packed."""
        going, last, count = [], None, 0
        for node, before, behind in self.states[state]:
            node = self.child[node].get(byte)
            if node is None:
                continue
            token = self.token[node]
            if last is None and token is not None and self._adjacent(before, token):
                last, count = token, behind + 1
            if self.child[node]:
                going.append((node, before, behind))
        new = (*((node, before, behind - count) for node, before, behind in going), (0, last, 0))
        if new not in self.index:
            self.index[new] = len(self.states)
            self.states.append(new)
        return self.index[new] << 16 | (count + (1 << 15))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> np.int64(64 - self.bits)) & ((1 << self.bits) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Packed transitions; -1 where there is none yet."""
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _insert(self, keys: np.ndarray, values: np.ndarray):
        if (self.size + len(keys)) * 2 > len(self.keys):
            full = np.flatnonzero(self.keys != -1)
            keys = np.concatenate([self.keys[full], keys])
            values = np.concatenate([self.values[full], values])
            self.bits, self.size = int(4 * len(keys)).bit_length(), 0
            self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
            self.values = np.zeros(1 << self.bits, dtype=np.int64)
        for key, value, slot in zip(keys.tolist(), values.tolist(), self._slots(keys).tolist()):
            self._put(key, value, slot)

    def _put(self, key: int, value: int, slot: int):
        while self.keys[slot] != -1:
            slot = (slot + 1) & (len(self.keys) - 1)
        self.keys[slot], self.values[slot] = key, value
        self.size += 1

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state << 8 | byte
        packed = self._find(keys)
        missing = np.flatnonzero(packed < 0)
        if len(missing):
            new, inverse = np.unique(keys[missing], return_inverse=True)
            values = np.array([self._compile(key >> 8, key & 255) for key in new.tolist()])
            self._insert(new, values)
            packed[missing] = values[inverse]
        return packed >> 16, (packed & 0xFFFF) - (1 << 15)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; all of them are read in step, the longest first."""
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        reached = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        places = starts[order]
        state = np.zeros(len(order), dtype=np.int64)
        count = np.zeros(len(order), dtype=np.int64)
        for i, active in enumerate(reached.tolist()):
            state[:active], change = self.step(state[:active], data[places[:active] + i])
            count[:active] += change
            if self.size > MAX_TRANSITIONS:  # go on with the states that are in use
                used, state[:active] = np.unique(state[:active], return_inverse=True)
                first = bool(len(used)) and used[0] == 0
                self._reset(tuple(self.states[k] for k in used[int(first) :].tolist()))
                state[:active] += not first
        out = np.empty_like(count)
        out[order] = count
        return out


@lru_cache(maxsize=4)
def load_tokenizer(path: str) -> tuple[Merger, tuple[bytes, ...]]:
    """The merger of a tokenizer file, and its special strings, longest first."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    # fixed values: the printable stand-ins of bytes in byte-level vocabularies
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    raw = lambda s: bytes(byte_of[c] for c in s)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    merges = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
    special = {x["content"] for x in spec["added_tokens"]}
    vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    by_length = sorted((s.encode() for s in special), key=lambda s: (-len(s), s))
    return Merger(vocabulary, merges), tuple(by_length)


def _cut_specials(texts: Texts, specials: tuple[bytes, ...]) -> tuple[Texts, np.ndarray, np.ndarray]:
    """Texts without special strings, the text of each piece left, and specials per text."""
    found = np.zeros(len(texts.offsets) - 1, dtype=np.int64)
    raw = texts.data.tobytes()
    if not any(s in raw for s in specials):
        return texts, np.arange(len(found)), found
    pattern = regex.compile(b"|".join(map(regex.escape, specials)))
    pieces, owner = [], []
    for i in range(len(found)):
        parts = pattern.split(raw[texts.offsets[i] : texts.offsets[i + 1]])
        found[i] = len(parts) - 1
        pieces += parts
        owner += [i] * len(parts)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    return Texts(np.frombuffer(b"".join(pieces), dtype=np.uint8), offsets), np.array(owner), found


def count_tokens(texts: Texts, tokenizer_path: str) -> np.ndarray:
    merger, specials = load_tokenizer(tokenizer_path)
    pieces, owner, found = _cut_specials(texts, specials)
    starts = pretoken_starts(pieces, tokenizer_path)
    coded = binary_array(pieces.data, np.append(starts, len(pieces.data))).dictionary_encode()
    distinct = texts_of(coded.dictionary)
    counts = merger.counts(distinct.data, distinct.offsets[:-1], distinct.offsets[1:])[coded.indices.to_numpy()]
    per_piece = sums_by_text(counts, np.searchsorted(starts, pieces.offsets))
    return np.bincount(owner, weights=per_piece, minlength=len(found)).astype(np.int64) + found


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``; map-only.

    The ids keep their type, nulls included. Other columns are left out.
    """
    read = id_and_text(docs, id_col, text_col)
    schema = T.StructType(
        [read.schema["doc_id"]]
        + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
        + [T.StructField("over_limit", T.BooleanType())]
    )

    def run(batches):
        for part, texts in slices(batches):
            n_tokens = count_tokens(texts, tokenizer_path)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "n_bytes": texts.lengths, "n_tokens": n_tokens, "over_limit": n_tokens > limit}
            )

    return read.mapInArrow(run, schema)
