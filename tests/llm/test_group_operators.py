"""Operators that compare documents or vectors, and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gradeframe.llm import decontamination, nearest, repeats, simhash
from gradeframe.llm.components import components
from gradeframe.llm.suffix_groups import lyndon_groups, suffix_array

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(3000):
        symbols = rng.choice([1, 2, 3, 5, 26])
        text = [rng.randrange(symbols) for _ in range(rng.randint(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_groups_share_their_lyndon_prefix():
    text = b"graindraining"
    groups, previous = lyndon_groups(text)
    smaller = [max((j for j in range(i) if text[j:] < text[i:]), default=-1) for i in range(len(text))]
    following = [next((j for j in range(i + 1, len(text)) if text[j:] < text[i:]), len(text)) for i in range(len(text))]
    assert previous == smaller
    prefixes = [{text[i : following[i]] for i in own} for own in groups]
    assert all(len(p) == 1 for p in prefixes)
    assert [*map(min, prefixes)] == sorted(map(min, prefixes))


def repeat_texts():
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(700))
    rows = [(1, None), (2, ""), (3, "a" * 39), (4, "a" * 40), (5, "b" * 41), (6, "xyz" * 60), (6, "xyz" * 60), (None, passage)]
    for i in range(10, 40):
        a, b = sorted(rng.sample(range(len(passage)), 2))
        noise = lambda: "".join(rng.choice("ghijkl") for _ in range(rng.randint(0, 90)))
        rows.append((i, noise() + passage[a:b] + noise() + "é" * rng.randint(0, 30)))
    return rows


@pytest.mark.parametrize("hot_units", [512, 2])
def test_repeats(make_docs, monkeypatch, hot_units):
    monkeypatch.setattr(repeats.repeated_starts, "__defaults__", (400, 64, hot_units))
    length, rows = 40, repeat_texts()
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    wanted = Counter()
    for (doc_id, _), own in zip(rows, raw):
        marks = np.zeros(len(own), dtype=bool)
        for p in range(len(own) - length + 1):
            if seen[own[p : p + length]] > 1:
                marks[p : p + length] = True
        kept = bytes(b for b, m in zip(own, marks) if not m)
        runs = len(re.findall("1+", "".join("01"[m] for m in marks.astype(int))))
        wanted[doc_id, len(own), int(marks.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    found = repeats.repeat_digest(make_docs(*rows), length, 8).collect()
    assert Counter(tuple(r) for r in found) == wanted


def test_repeats_at_full_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    raw = {r[0]: r[1].encode() for r in rows}
    seen = Counter(hash(r[p : p + 400]) for r in raw.values() for p in range(len(r) - 399))
    for row in repeats.remove_repeats(docs).collect():
        own = raw[row["doc_id"]]
        marks = np.zeros(len(own), dtype=bool)
        for p in range(len(own) - 399):
            if seen[hash(own[p : p + 400])] > 1:
                marks[p : p + 400] = True
        assert bytes(row["kept"]) == bytes(np.frombuffer(own, np.uint8)[~marks])


def test_repeats_of_nothing(make_docs, odd_rows):
    assert repeats.repeat_digest(make_docs()).count() == 0
    assert repeats.repeat_digest(make_docs(*odd_rows)).count() == len(odd_rows)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def copies(n=120):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 120))]
        rows.append((200 + i, " ".join(words)))
        if i % 3 == 0:
            rows.append((500 + i, " ".join(words) + " end"))
    return rows


def test_simhash(make_docs, odd_rows):
    rows = odd_rows + copies()
    prints = [fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = joined(pairs, len(rows))
    least = {r: min((i for (i, _), s in zip(rows, roots) if s == r and i is not None), default=None) for r in set(roots)}
    wanted = Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots))
    docs = make_docs(*rows)
    assert Counter(tuple(r) for r in simhash.simhash_groups(docs).collect()) == wanted
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least.values())
    assert simhash.simhash_groups(make_docs()).count() == 0


@pytest.mark.parametrize("query_rows", [16, simhash.QUERY_ROWS])
def test_shards_find_every_near_pair(spark, monkeypatch, query_rows):
    monkeypatch.setattr(simhash, "QUERY_ROWS", query_rows)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, size=150, dtype=np.uint64)
    values = set(centres.tolist())
    for c in centres[:60].tolist():  # chains of near fingerprints
        for _ in range(6):
            c ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            values.add(c)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), shard_size=40).collect()
    number = {s[0]: i for i, s in enumerate(signed)}
    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    assert joined([(number[a], number[b]) for a, b in found], len(values)) == joined(near, len(values))
    assert len(found) < 12 * len(values)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    roots = joined(pairs, 200)
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(found) == len({x for p in pairs if p[0] != p[1] for x in p})
    assert all(r["component"] == roots[r["node"]] for r in found)


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS_PER_LIST", 100)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 20))
    vectors = centres[rng.integers(12, size=900)] + 0.4 * rng.normal(size=(900, 20))
    vectors[300:450] = vectors[299]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [0.0] * 20), (1100, [float("nan")] * 20), (1150, [1.0] * 3), (None, vectors[0].tolist()), (1200, [None] * 20), (1250, [])]
    found = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    for query in range(0, 900, 50):
        own = sorted((r for r in found if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        cosine = unit @ unit[query]
        np.testing.assert_allclose([r["score"] for r in own], cosine[[r["vec_id"] for r in own]])
        assert [(r["score"], -r["vec_id"]) for r in own] == sorted(((r["score"], -r["vec_id"]) for r in own), reverse=True)
        exact = sorted((i for i in range(900) if i != query), key=lambda i: (-round(cosine[i], 12), i))[:5]
        hits += len({r["vec_id"] for r in own} & set(exact))
    assert len(found) == 18 * 5 and hits >= 0.9 * len(found)


def test_blocks_of_queries_bound_a_shard(spark, monkeypatch):
    """However many fingerprints query a shard, a task has its members and one block of them."""
    monkeypatch.setattr(simhash, "QUERY_ROWS", 100)
    for n in (2_000, 8_000):
        routed = spark.range(n).selectExpr("id % 2 AS shard", "id AS fp", "id < 80 AS home")
        groups = simhash.query_blocks(routed).groupBy("shard", "block").agg({"home": "count"}).collect()
        assert max(g[2] for g in groups) <= 40 + 200
        assert sum(g[2] for g in groups) == n - 80 + 40 * len(groups)


def test_index_rows_are_repeated_for_queries_of_their_list_only(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_ROWS", 10)
    for n in (1_000, 4_000):
        indexed = spark.range(n).selectExpr("id AS vec_id", "array(1.0D) AS vector", f"CAST(id % {n // 100} AS int) AS list")
        index_side, query_side = nearest.paired_blocks(indexed, indexed.filter("vec_id % 5 = 0"))
        assert index_side.count() == 2 * n and query_side.count() == n // 5


def test_nearest_widens_probes_and_counts_repeated_ids_once(spark, monkeypatch):
    """Five others are found from a tiny far cluster, and beside an id with many rows."""
    monkeypatch.setattr(nearest, "ROWS_PER_LIST", 50)
    monkeypatch.setattr(nearest, "needed_probes", lambda *_: 1)
    rng = np.random.default_rng(6)
    vectors = np.r_[rng.normal(size=(600, 16)) * 0.05 + 1, rng.normal(size=(2, 16)) * 0.01 - 1]
    rows = [(i + 1, v.tolist()) for i, v in enumerate(vectors[:600])] + [(700, vectors[600].tolist()), (750, vectors[601].tolist())]
    rows += [(3, vectors[49].tolist())] * 90  # nearest to query 50, many times
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("extra", F.lit(1))
    found = nearest.nearest(frame.withColumnRenamed("extra", "list")).collect()
    by_query = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(50, 751, 50)}
    assert all(len(set(ids)) == 5 and q not in ids for q, ids in by_query.items() if q != 650)
    assert by_query[700][0] == 750 and by_query[750][0] == 700 and by_query[50][0] == 3


def test_nearest_of_few(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    found = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(rows).collect()]
    assert sorted(found) == [(0, 1, 1), (0, 2, 2)]
    assert nearest.nearest(rows.limit(0)).count() == 0


def test_pipeline(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    rows, seen = docs, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in rows.collect()}
        rows = stage(spark, rows, tiny_dir)
        assert rows.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in rows.collect()}
        assert set(after) <= set(before)
        if name == "simhash near-dedup":
            prints = {i: fingerprint(t) for i, t in before.items()}
            kept = [prints[i] for i in after]
            assert all((a ^ b).bit_count() > 3 for n, a in enumerate(kept) for b in kept[:n])
        if name == "benchmark decontamination":
            found = decontamination.decontaminate(docs, spark.read.parquet(f"{tiny_dir}/benchmark.parquet"))
            hit = {r["doc_id"] for r in found.filter("contaminated").collect()}
            assert set(after) == set(before) - hit
        if name == "secret scans":
            assert set(after) == set(before)
            assert not any(re.search(r"token = \"[0-9a-f]{40}", t) for t in after.values())
        else:
            assert all(after[i] == seen[i] for i in after)
    packed = corpus_pipeline.run(spark, tiny_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_on_odd_and_empty_tables(spark, make_docs, odd_rows, tmp_path, rows):
    """Nulls in any column, repeated rows, clashing column names, and no rows at all."""
    docs = make_docs(*odd_rows)
    (docs if rows == "odd" else docs.limit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 1, 0), (7, 0, 1), (8, None, 0), (None, 0, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "no such words are in any of these texts here")], "item_id long, text string")
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs if rows == "odd" else docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, kept, str(tmp_path)).columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} <= {i for i, *_ in odd_rows}
    assert rows == "odd" or packed == []
