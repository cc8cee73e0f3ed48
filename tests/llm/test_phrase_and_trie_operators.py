"""Phrases, repeated passages and the prefix trie, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gradeframe.llm import collocations, key_filter, passages, prefix_trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- phrases ------------------------------------------------------------------------


def phrase_counts(rows):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, total


def expected_phrases(rows, least, top):
    counts, total = phrase_counts(rows)
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and 2 * b >= a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in candidates.items()):
                continue
            cuts = [(1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    names = ["new york", "new york city", "the", "a", "of course", "ÉTÉ Noir", "日本 語", "it's", "x"]
    rows = [(1, None, "en"), (2, "", "fr"), (3, " \t. ,\n", None), (4, "word " * 4000, "en"), (None, "new york! new york", None)]
    for i in range(200):
        text = "".join(rng.choice(names) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "-"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "fr", None, "und"])))
    return rows + rows[-3:]


@pytest.mark.parametrize("least, top", [(10, 2000), (2, 7)])
def test_collocations(make_docs, least, top):
    rows = phrase_rows()
    found = collocations.collocations(make_docs(*rows), least, top).collect()
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found)
    assert got == expected_phrases(rows, least, top)


def test_collocations_do_not_depend_on_the_shards(make_docs, monkeypatch):
    docs = make_docs(*phrase_rows())
    whole = sorted(map(tuple, collocations.collocations(docs.coalesce(1)).collect()))
    assert whole == sorted(map(tuple, collocations.collocations(docs.repartition(13)).collect())) and whole


def test_an_index_extends_both_ways():
    rng = random.Random(3)
    for _ in range(200):
        pieces = [[rng.randint(1, 4) for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 6))]
        stream = np.array([x for p in pieces for x in [*p, 0]])
        expected = [Counter(tuple(p[i : i + k]) for p in pieces for i in range(len(p) - k + 1)) for k in (1, 2, 3)]
        index = collocations.WordIndex(stream, 3)
        counts = lambda level: {tuple(w): n for w, n in zip(level.words.tolist(), level.count.tolist())}
        right, left = index.to_right(index.words), index.to_left(index.words)
        assert counts(index.words) == expected[0] and counts(right) == counts(left) == expected[1]
        for level in (index.to_right(right), index.to_left(right), index.to_right(left), index.to_left(left)):
            assert counts(level) == expected[2]


def test_collocations_of_nothing(make_docs):
    assert collocations.collocations(make_docs((1, None, None)).limit(0)).count() == 0
    assert collocations.collocations(make_docs((1, None, None), (2, "one two", "en"))).count() == 0


def test_bit_tables_hold_all_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, size=5000)
    table = key_filter.bit_table(spark.createDataFrame([(int(k),) for k in keys[:4000]], "key long"), "key")
    assert key_filter.may_hold(table, keys[:4000]).all() and key_filter.may_hold(table, keys[4000:]).mean() < 0.1
    assert not key_filter.may_hold(key_filter.bit_table(spark.createDataFrame([], "key long"), "key"), keys).any()


# --- passages -----------------------------------------------------------------------


def expected_passages(rows, length):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for i, text, *_ in rows]
    first = {}
    for i, words in texts:
        for j in range(len(words) - length + 1):
            if i is not None:
                key = tuple(words[j : j + length])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, words in texts:
        gone = set()
        for j in range(len(words) - length + 1):
            if i is not None and first[tuple(words[j : j + length])] < i:
                gone |= set(range(j, j + length))
        out.append((-1 if i is None else i, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return sorted(out)


def passage_rows():
    rng = random.Random(12)
    few = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    passage = [f"w{rng.randint(0, 50)}" for _ in range(400)]
    rows = [(1, None), (2, ""), (3, "a " * 49), (4, "a " * 50), (5, "b " * 51), (6, "b\n" * 200), (7, "a b " * 300), (8, "b a " * 300)]
    rows += [(9, " ".join(passage)), (9, " ".join(passage)), (None, " ".join(passage)), (None, "a " * 60)]
    rows += [(10, "é日本 " * 70), (11, "é日本 x " * 70), (12, "x é日本 " + "é日本\t" * 55), (13, few(20000) + " " + " ".join(passage[100:300]))]
    for i in range(20, 90):
        a, b = sorted(rng.sample(range(400), 2))
        words = passage[a:b]
        for j in range(len(words)):
            if rng.random() < 0.01:
                words[j] = "changed"
        rows.append((i, f"{few(rng.randint(0, 30))} {' '.join(words)} {few(rng.randint(0, 30))}"))
    return rows + rows[-2:]


@pytest.mark.parametrize("length", [50, 20])
def test_passages(make_docs, length):
    rows = passage_rows()
    found = passages.remove_passages(make_docs(*rows).repartition(5), length).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found)
    assert got == expected_passages(rows, length)


def test_passage_digest_of_odd_rows(make_docs, odd_rows):
    found = passages.passage_digest(make_docs(*odd_rows)).collect()
    expected = sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in expected_passages(odd_rows, 50))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found) == expected
    assert passages.passage_digest(make_docs((1, "x")).limit(0)).count() == 0


def test_many_different_texts_around_one_passage(make_docs):
    """A hot anchor: every document holds the passage between other words."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    noise = lambda: " ".join(rng.choice(["u", "v", "w"]) for _ in range(20))
    rows = [(i, f"{noise()} {passage} {noise()}") for i in range(300)]
    found = passages.remove_passages(make_docs(*rows)).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found)
    assert got == expected_passages(rows, 50) and sum(r[2] >= 60 for r in got) == 299


# --- prefix trie --------------------------------------------------------------------


def turn_key(turn, role, text):
    both = hashlib.md5((hashlib.md5((role or "").encode()).hexdigest() + (text or "")).encode()).digest()
    return (turn is not None, turn or 0, both)


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn_key(turn, role, text), (role or "", text or "")))
    lists = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = lists.get(base, [])[:h] + turns[h:]
    return lists, out


def expected_trie(lists):
    members = defaultdict(list)
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        (
            min(convs), len(path), min(members[path[:-1]]) if path else -1, len(convs), children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(lists[c]) == len(path)).encode()).hexdigest(),
        )
        for path, convs in members.items()
    )


def trie_rows(frame):
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


def conversation_rows():
    rng = random.Random(13)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 0, "user", "é日本"), (7, 0, "user", "é日本"), (8, 3, "a", "b"), (8, 3, "c", "b")]
    for c in [0, 100, 200, *range(1, 12), *range(101, 140), 305, 306, -5, -100]:
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(["hi", "hello", "", "x" * 50])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, path string, depth string, key string"


def test_rebuilt_conversations_and_their_trie(spark):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)
    lists = prefix_trie.with_shared_heads(prefix_trie.turn_lists(frame))
    assert trie_rows(prefix_trie.prefix_trie(lists)) == expected_trie(rebuilt(rows)[1])


def test_long_conversations_branch_and_end_anywhere(spark):
    rng = random.Random(14)
    rows = []
    for c in range(60):
        length, change = rng.randint(1, 75), rng.randint(0, 80)
        rows += [(c, t, "user", f"turn {t}" if t < change else f"turn {t} {rng.randint(0, 2)}") for t in range(length)]
    rows += [(1000 + c, t, "user", f"turn {t}") for c in range(40) for t in range(33)]
    rows += [(2000, t, "user", f"other {t}") for t in range(200)]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.turn_lists(frame))) == expected_trie(rebuilt(rows)[0])


def test_hashes_of_many_ends(spark, monkeypatch):
    """Ids of one node in many pieces and tasks."""
    frame = spark.range(5000).selectExpr("id AS conv_id", "0L AS turn", "'u' AS role", "'same' AS text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        found = prefix_trie.prefix_trie(prefix_trie.turn_lists(frame)).filter("depth = 1").first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found["ends_sha256"] == hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert (found["conv_id"], found["n_convs"], found["saved_tokens"]) == (0, 5000, 4999 * 4)


def test_no_conversations(spark):
    frame = spark.createDataFrame([(None, 1, "u", "t", "x", "y", "z")], SCHEMA)
    assert prefix_trie.prefix_trie(prefix_trie.turn_lists(frame)).count() == 0
    turnless = prefix_trie.turn_lists(spark.createDataFrame([(5, 1, "u", "t", "x", "y", "z")], SCHEMA)).selectExpr("conv_id", "slice(turns, 1, 0) AS turns")
    assert trie_rows(prefix_trie.prefix_trie(turnless)) == [(5, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())]
