"""SimHash near-duplicates: fingerprints, and exact links by vantage-point trees.

A text's fingerprint has a bit for each of 64 places, set if more than half of its shingles' hashes
have it. Fingerprints are linked at ``max_bits`` or fewer differing bits, exactly:

* A tree of vantage points is grown over a bounded sample. Each inner node splits by the
  Hamming distance to its vantage point, at the sample's median. The leaves are *shards*:
  every distinct fingerprint belongs to one, and by the triangle inequality a fingerprint
  within ``max_bits`` of a node's boundary also queries the shard beyond it.
* The fingerprints that query a shard grow faster than the shard, so they come in blocks of about ``QUERY_ROWS``:
  a task is one block with the shard's members, whatever the size of the corpus.
* In a shard a deeper vantage-point tree splits members into bands of equal distance. A query
  visits only bands within ``max_bits`` of its own distance; small bands are compared directly.
  No more than some 44,000 fingerprints lie within 3 bits of one, so a shard's work on each
  is bounded, whatever the groups.
* A shard returns links that join its near fingerprints into the same components as all of its
  pairs would, but no more than one a query, so that groups of copies never become all their pairs.

Equal fingerprints are one before that, so exact copies cost nothing. Components
across shards come from a distributed connected-components run.

Null, empty and blank texts have fingerprint 0 and are linked like any other. A text of
fewer words than a shingle has is one shingle. A component without any id but null has a
null id. Repeated rows stay, each with its result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.llm.arrow_text import LOWER, Texts, find_words, id_and_text, slices
from gradeframe.llm.components import components
from gradeframe.session import materialize

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints that a shard is meant to hold, and that the top tree is grown from.
SHARD_SIZE = 65_536
TREE_SAMPLE = 50_000
#: Fingerprints of other shards that query a shard in one task; its members are repeated for each such block.
QUERY_ROWS = 262_144
#: Cells of one direct comparison.
BLOCK = 1 << 22


def fingerprints(texts: Texts, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    lowered = Texts(LOWER[texts.data], texts.offsets)
    words = find_words(lowered)
    # the words of all texts, a space after each
    keep_to = np.cumsum(words.ends - words.starts + 1)
    begins = keep_to - (words.ends - words.starts + 1)
    joined = np.full(keep_to[-1] if len(keep_to) else 0, 0x20, dtype=np.uint8)
    place = np.ones(len(joined), dtype=bool)
    place[keep_to - 1] = False
    inner = np.zeros(len(lowered.data) + 1, dtype=np.int8)
    inner[words.starts] += 1
    inner[words.ends] -= 1
    joined[place] = lowered.data[np.cumsum(inner[:-1], dtype=np.int8).astype(bool)]
    raw = joined.tobytes()
    counts = words.counts
    n_shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    firsts = np.arange(n_shingles.sum()) + np.repeat(words.text_offsets[:-1] - (np.cumsum(n_shingles) - n_shingles), n_shingles)
    lasts = np.minimum(firsts + shingle, np.repeat(words.text_offsets[1:], n_shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], SEED) for a, b in zip(begins[firsts].tolist(), (keep_to[lasts] - 1).tolist())),
        dtype=np.uint64,
        count=len(firsts),
    )
    out = np.zeros(len(counts), dtype=np.uint64)
    edges = np.concatenate([[0], np.cumsum(n_shingles)])
    full = np.flatnonzero(n_shingles)
    if len(full):
        for bit in range(64):
            ones = (hashes >> np.uint64(bit)).astype(np.uint8) & 1
            votes = np.add.reduceat(ones, edges[full], dtype=np.int64)
            out[full] |= (votes * 2 > n_shingles[full]).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (which has ``text``) without its text and with ``fp``, the fingerprint as a signed long."""
    schema = T.StructType([*docs.drop("text").schema.fields, T.StructField("fp", T.LongType())])

    def run(batches):
        for part, texts in slices(batches):
            columns = {c: part.column(c) for c in part.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(columns | {"fp": fingerprints(texts, shingle).view(np.int64)})

    return docs.mapInArrow(run, schema)


def _distance(values: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint64(point)).astype(np.int16)


class Node(NamedTuple):
    """An inner node: distances up to ``radius`` go to child ``near``, others to ``far``; a negative child is shard ``-1 - child``."""

    point: int
    radius: int
    near: int
    far: int


def grow(sample: np.ndarray, shards: int, seed: int = 7) -> list[Node]:
    """A tree of vantage points with ``shards`` leaves, root first; empty for one shard."""
    rng = np.random.default_rng(seed)
    nodes: list[Node] = []
    leaves = 0

    def build(members: np.ndarray, wanted: int) -> int:
        nonlocal leaves
        distinct = np.unique(members)
        if wanted <= 1 or len(distinct) < 2:
            leaves += 1
            return -leaves
        best = None
        for point in rng.choice(distinct, size=min(8, len(distinct)), replace=False):
            distances = _distance(members, point)
            radius = int(np.sort(distances)[(len(distances) - 1) // 2])
            near = int((distances <= radius).sum())
            on_both = int((np.abs(distances - radius) <= MAX_BITS).sum())
            if near < len(members) and (best is None or on_both < best[0]):
                best = (on_both, point, radius, distances <= radius)
        if best is None:
            leaves += 1
            return -leaves
        _, point, radius, inside = best
        at = len(nodes)
        nodes.append(None)
        left = build(members[inside], wanted // 2)
        nodes[at] = Node(int(point), radius, left, build(members[~inside], wanted - wanted // 2))
        return at

    build(sample, shards)
    return nodes


def route(values: np.ndarray, tree: list[Node], slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the value and shard for every shard a ball of radius ``slack`` may touch."""
    if not tree:
        return np.arange(len(values)), np.zeros(len(values), np.int64)
    rows, leaves = [], []
    stack = [(0, np.arange(len(values)))]
    while stack:
        at, index = stack.pop()
        if not len(index):
            continue
        if at < 0:
            rows.append(index)
            leaves.append(np.full(len(index), -1 - at, dtype=np.int64))
            continue
        node = tree[at]
        distances = _distance(values[index], node.point)
        stack.append((node.near, index[distances <= node.radius + slack]))
        stack.append((node.far, index[distances > node.radius - slack]))
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*leaves, np.zeros(0, np.int64)])


class _Forest:
    """Disjoint sets over the fingerprints of a shard."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray):
        root = self.root
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            open_ = low != high
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(root, high[open_], low[open_])
            while True:  # halve paths until every entry is a root
                above = root[root]
                if np.array_equal(above, root):
                    break
                root[:] = above


def shard_links(values: np.ndarray, home: np.ndarray, max_bits: int, asks: np.ndarray | None = None, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(value, value)`` that connect all pairs of a home value and any value within ``max_bits``.

    ``values`` are distinct; ``home`` marks those that belong to the shard, ``asks`` those that query (by default all).
    """
    rng = np.random.default_rng(seed)
    forest = _Forest(len(values))
    stack = [(np.arange(len(values)) if asks is None else np.flatnonzero(asks), np.flatnonzero(home), 0)]
    while stack:
        queries, members, depth = stack.pop()
        if not len(queries) or not len(members):
            continue
        if len(queries) * len(members) <= BLOCK // 16 or depth > 12:
            rows = max(1, BLOCK // len(members))
            for i in range(0, len(queries), rows):
                part = queries[i : i + rows]
                near = np.bitwise_count(values[part][:, None] ^ values[members][None, :]) <= max_bits
                near &= forest.root[part][:, None] != forest.root[members][None, :]
                a, b = np.nonzero(near)
                forest.join(part[a], members[b])
            continue
        point = values[rng.choice(members)]
        to_members, to_queries = _distance(values[members], point), _distance(values[queries], point)
        for band in np.unique(to_members):
            stack.append((queries[np.abs(to_queries - band) <= max_bits], members[to_members == band], depth + 1))
    linked = np.flatnonzero(forest.root != np.arange(len(values)))
    return values[linked], values[forest.root[linked]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links ``(a, b)`` between the fingerprints ``fp`` of ``distinct``, enough for its components."""
    spark = distinct.sparkSession
    n = distinct.count()
    shards = max(1, -(-n // shard_size))
    share = min(1.0, TREE_SAMPLE / max(1, n))
    place = F.pmod(F.xxhash64("fp", F.lit("tree")), F.lit(1 << 20)) / float(1 << 20)
    sample = [r["fp"] for r in distinct.filter(place < share).select("fp").collect()]  # about TREE_SAMPLE at most
    tree = grow(np.sort(np.array(sample, dtype=np.int64).view(np.uint64)), shards)
    sent = spark.sparkContext.broadcast(tree)
    routed = T.StructType([T.StructField("shard", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("home", T.BooleanType())])

    def deal(batches):
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            index, leaf = route(values, sent.value, max_bits)
            own_index, own_leaf = route(values, sent.value, 0)
            home = np.zeros(len(values), dtype=np.int64)
            home[own_index] = own_leaf
            yield pa.RecordBatch.from_pydict(
                {"shard": leaf, "fp": values[index].view(np.int64), "home": home[index] == leaf}
            )

    def search(table: pa.Table) -> pa.Table:
        values, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy()
        # members meet each other in the first block only
        first = len(values) and table.column("block")[0].as_py() == 0
        a, b = shard_links(values, home, max_bits, np.ones(len(values), dtype=bool) if first else ~home)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = query_blocks(materialize(distinct.select("fp").mapInArrow(deal, routed)))
    return dealt.groupBy("shard", "block").applyInArrow(search, "a long, b long")


def query_blocks(routed: DataFrame) -> DataFrame:
    """``shard, block, fp, home``: the queries of a shard in blocks, its members in each."""
    foreign = routed.filter(~F.col("home"))
    blocks = materialize(foreign.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block")
    queries = foreign.join(blocks, "shard").select("shard", own, "fp", "home")
    return routed.filter("home").join(blocks, "shard", "left").select("shard", every, "fp", "home").unionByName(queries)


def near_duplicates(fingerprinted: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Adds to rows of ``doc_id, fp`` their ``component_id``, the smallest ``doc_id`` reachable
    over links, and ``component``, the fingerprint that stands for all that are linked."""
    rows = materialize(fingerprinted)
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(distinct, max_bits)).withColumnRenamed("node", "fp")
    named = distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named)
    leasts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(leasts, "component").select("fp", "component", "component_id"), "fp")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hexadecimal digits) and ``component_id`` per row of ``docs``."""
    found = near_duplicates(with_fingerprint(id_and_text(docs), shingle), max_bits)
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", fingerprint, "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each group: that of the smallest id.

    Of repeated rows of that id the first stays; a null id counts as larger than any other.
    """
    numbered = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number"))
    stored = materialize(numbered)
    small = id_and_text(stored, "row.doc_id", "row.text", "number")
    found = near_duplicates(with_fingerprint(small, shingle), max_bits)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "number")
    first = found.groupBy("component").agg(F.min_by("number", order).alias("number"))
    return stored.join(first.select("number"), "number", "left_semi").select("row.*")
