"""Approximate nearest neighbours by adaptive dimension scans over probed lists.

Vectors are scaled to length 1 and turned by a random rotation, after which the first
columns of a difference are a fair sample of the whole. The index has one list for each centroid of a
bounded sample; every vector is in the list of its nearest centroid, and lists are cut
into blocks of at most about ``BLOCK_ROWS`` by a hash of the id, so a popular list is many tasks.
A query probes the lists whose centroids are nearest, as many as hold the share ``recall`` of
the neighbours of ``TRIAL_QUERIES`` sampled vectors within the sample, and on until they hold k ids beside its own.

A task compares one block with one block of the queries that probe its list; a list's rows are repeated only for
its own queries' blocks. It scans the rotated columns
``STRIDE`` at a time: after each stride a candidate is abandoned if its partial distance,
scaled up to all columns, exceeds the query's present k-th distance so far that a normal
test (``EPSILON`` deviations) rejects that it is nearer. Rows come in chunks, and the k-th distance is
that of all chunks before. The cosine of survivors is computed
on the original vectors in double precision. The best k of all blocks are the result.

Rows with a null id, and vectors that are null, empty, zero, or hold a null or non-finite
component, take no part; nor do those whose length is not the most frequent one (of
equally frequent lengths the larger). Equal
scores are ranked by id. A repeated id is one id: its rows are no candidates for themselves, and as a
query its smallest vector counts. An empty table has no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.session import materialize

ROWS_PER_LIST = 2_048
MAX_LISTS = 4_096
#: Vectors from which centroids are fitted.
SAMPLE_ROWS = 20_000
BLOCK_ROWS = 8_192
QUERY_ROWS = 4_096
#: Most rows of a block that are compared before the bounds are tightened.
CHUNK_ROWS = 2_048
TRIAL_QUERIES = 500
RECALL = 0.97
STRIDE = 16
EPSILON = 2.1


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("vector", lambda x: x != 0)
    kept = rows.select("vec_id", vector.alias("vector")).filter(
        "vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0"
    )
    kept = kept.filter(~bad).filter(~zero)
    sizes = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.filter(F.size("vector") == (sizes["n"] if sizes else 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def rotation(size: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means over unit vectors."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centroids = distinct[rng.choice(len(distinct), size=min(lists, len(distinct)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centroids)
    return centroids


def needed_probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """Lists to probe, by where the neighbours of some sampled vectors are within the sample."""
    asked = sample[:: max(1, len(sample) // TRIAL_QUERIES)][:TRIAL_QUERIES]
    lists = np.argmax(sample @ centroids.T, axis=1)
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    rank = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    at = np.sort(np.take_along_axis(rank, lists[near], axis=1).ravel())
    return int(at[int(np.ceil(recall * len(at))) - 1]) + 1 if len(at) else len(centroids)


def scan_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """Query index, candidate index and cosine of each query's k best other ids among those that survive."""
    size = vectors.shape[1]
    turn = rotation(size)
    rows, asked = _unit(vectors) @ turn, _unit(queries) @ turn
    row_lengths, query_lengths = (np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (vectors, queries))
    stride = min(STRIDE, size)
    head = (asked[:, :stride] ** 2).sum(axis=1)[:, None]
    allowed = lambda d: (d / size) * (1 + EPSILON / np.sqrt(d)) ** 2 if d < size else 1.0
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    bound = np.full(len(asked), np.inf)
    at, step = 0, max(4 * k, 64)
    while at < len(rows):
        some = rows[at : at + step]
        partial = head + (some[:, :stride] ** 2).sum(axis=1)[None, :] - 2 * asked[:, :stride] @ some[:, :stride].T
        open_ = partial <= (bound * allowed(stride))[:, None] + 1e-9
        q, c = np.nonzero(open_ & (query_ids[:, None] != ids[None, at : at + step]))
        partial = partial[q, c]
        for done in range(stride, size, STRIDE):
            upto = min(done + STRIDE, size)
            partial = partial + ((asked[q, done:upto] - some[c, done:upto]) ** 2).sum(axis=1)
            near = partial <= bound[q] * allowed(upto) + 1e-9
            q, c, partial = q[near], c[near], partial[near]
        c = c + at
        score = np.einsum("ij,ij->i", queries[q], vectors[c]) / (query_lengths[q] * row_lengths[c])
        q, c, score = (np.concatenate(x) for x in zip(best, (q, c, score)))
        kept = _best(q, ids[c], score, k)
        best = q[kept], c[kept], score[kept]
        # the k-th distance so far, where there are k
        last = np.searchsorted(best[0], np.arange(len(asked)), side="right") - 1
        full = np.flatnonzero(np.bincount(best[0], minlength=len(asked)) == k)
        bound[full] = (2 - 2 * best[2][last[full]]) * (1 + 1e-9) + 1e-9
        at, step = at + step, min(2 * step, CHUNK_ROWS)
    return best


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best ids, best first, queries in order; a repeated id counts once."""
    order = np.lexsort((-score, ids, q))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[first]
    order = order[np.lexsort((ids[order], -score[order], q[order]))]
    sorted_q = q[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
    return order[rank < k]


def paired_blocks(indexed: DataFrame, probed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both ``(vec_id, vector, list)`` tables dealt by ``list, block, query_block``, so that each row of a list meets each of its queries once."""
    # bounded tables: one row a list
    blocks = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    asked = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("query_blocks"))
    sizes = F.broadcast(blocks.join(asked, "list"))  # a list that no query probes has no row
    block = F.pmod(F.xxhash64("vec_id", "vector"), "blocks").cast("int").alias("block")
    query_block = F.pmod(F.xxhash64("vec_id"), "query_blocks").cast("int").alias("query_block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index_side = indexed.join(sizes, "list").select("list", block, every("query_blocks").alias("query_block"), "vec_id", "vector")
    query_side = probed.join(sizes, "list").select("list", every("blocks").alias("block"), query_block, "vec_id", "vector")
    return index_side, query_side


def nearest(rows: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest by cosine of every query row.

    ``rows`` has ``vec_id`` and ``embedding``; ``is_query`` says which rows are queries.
    """
    spark = rows.sparkSession
    valid = materialize(usable(rows))
    n = valid.count()
    lists = int(min(MAX_LISTS, max(1, n // ROWS_PER_LIST)))
    place = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = valid.filter(place < min(1.0, SAMPLE_ROWS / max(1, n))).select("vector").limit(2 * SAMPLE_ROWS).toArrow()
    if not len(sample):
        sample = valid.select("vector").limit(SAMPLE_ROWS).toArrow()
    vectors = _matrix(sample.column("vector"))
    centroids = fit_centroids(_unit(vectors), lists) if len(vectors) else np.zeros((1, 0))
    probes = needed_probes(_unit(vectors), centroids, k, recall) if len(vectors) else 1
    sent = spark.sparkContext.broadcast(centroids)  # at most MAX_LISTS vectors

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                near = np.argmax(_unit(_matrix(batch.column("vector"))) @ sent.value.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], [*batch.schema.names, "list"])

    schema = "vec_id long, vector array<double>, list int"
    valid = valid.withColumn("vec_id", F.col("vec_id").cast("long"))
    indexed = materialize(valid.mapInArrow(assign, schema))
    # ids by the least of their lists (a repeated id may be in several): at most MAX_LISTS rows
    held = np.zeros(max(1, len(centroids)), dtype=np.int64)
    for row in indexed.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect():
        held[row["list"]] = row["count"]

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_unit(_matrix(batch.column("vector"))) @ sent.value.T), axis=1, kind="stable")
                covered = np.cumsum(held[near], axis=1)
                # the query itself may be one of the ids
                wanted = np.maximum(probes, (covered < k + 1).sum(axis=1) + 1)
                row, place = np.nonzero(np.arange(near.shape[1]) < wanted[:, None])
                again = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(near[row, place], pa.int32())], [*batch.schema.names, "list"])

    asked = valid.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    probed = materialize(asked.mapInArrow(probe, schema))
    index_side, query_side = paired_blocks(indexed, probed)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        vectors, queries = _matrix(left.column("vector")), _matrix(right.column("vector"))
        found = []
        step = max(1, (1 << 22) // len(ids))  # cells compared at once
        for at in range(0, len(query_ids), step):
            q, c, score = scan_block(vectors, ids, queries[at : at + step], query_ids[at : at + step], k)
            found.append((query_ids[at : at + step][q], ids[c], score))
        columns = (np.concatenate(x) for x in zip(*found))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    keys = ["list", "block", "query_block"]
    scanned = index_side.groupBy(*keys).cogroup(query_side.groupBy(*keys)).applyInArrow(
        scan, "query_id long, vec_id long, score double"
    )
    unique = scanned.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = unique.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
