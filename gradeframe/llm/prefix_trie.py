"""The trie of conversation prefixes, by peeling turns off from the deepest level up.

A node is a distinct sequence of the first turns of conversations; its members are the
conversations that start with it. At each depth, from the largest one up, the conversations
that end there join the nodes that survived from below, equal ones are merged in one grouped sum, and
the last turn is taken off, which gives the level above. Counts, leaves and saved tokens are
added up on the way, so each level is read once and no subtree is ever gathered. Where no conversation
ends for some levels and the nodes' ancestors there stay apart, several turns are taken off at once.

* A sequence is named by a chain of digests, one a turn, computed from digests of the turns; texts are
  never shuffled. A row carries the chain of its last ``SEGMENT`` turns only, so long
  conversations cost no more a turn than short ones; every ``SEGMENT`` levels, one join fetches the
  next part of the chain.
* All grouping keys are digests with sums and least values, so a first turn that most conversations
  share is added up where the rows are. The turns of one conversation meet in one row, 32 bytes a turn.
* The ids that end at a node are sorted over all tasks, written as text there in pieces of
  ``PIECE`` ids, and only these pieces meet for the node's hash, which is a chain by definition; they are
  read one after another and not held.

Turns are ordered by turn, null first; equal ones by the digest of role and text, so repeated rows stay, and
are turns of their own. Null roles and texts are empty. Rows with a null conversation id belong to no
conversation and are left out. Other columns are left out. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.session import materialize, shared_subfolder, stored_tables

#: Turns of the chain that a row carries.
SEGMENT = 16
#: Conversation ids written as one text.
PIECE = 1 << 16
#: Bytes of a turn in a chain: the digest of the sequence up to it, and its length.
RECORD = 24
ROOT = bytes(RECORD)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: digest and code points of each turn, in order, per conversation."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.md5(role), text))).alias("digest")
    turn = F.struct(F.col("turn"), digest, F.length(text).alias("size"))
    lists = conversations.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
    ordered = F.sort_array(F.collect_list(turn))  # nulls first
    return lists.agg(F.transform(ordered, lambda t: F.struct(t["digest"], t["size"])).alias("turns"))


def with_shared_heads(lists: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that begin as their family's first one does.

    The first h turns are those of conversation ``c - c % family`` (all if fewer, none if absent), h being
    crc32 of the decimal id modulo ``heads``; c's own turns after its first h follow.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    first = lists.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    marked = lists.withColumns({"base": base, "h": h}).join(first, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return marked.select("conv_id", F.concat(head, own).alias("turns"))


def _chains(lists: DataFrame) -> DataFrame:
    """A row per conversation and segment of its turns: its records and the one before, the depth they reach,
    and whether the conversation ends there."""

    def run(batches):
        for batch in batches:
            ids, depths, paths, ends = [], [], [], []
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns")):
                fields = turns.values
                records = [ROOT]
                for digest, size in zip(fields.field("digest").to_pylist(), fields.field("size").to_pylist()):
                    key = hashlib.blake2b(records[-1][:16] + digest, digest_size=16).digest()
                    records.append(key + size.to_bytes(8, "big"))
                depth = len(records) - 1
                for begin in range(0, max(depth, 1), SEGMENT):
                    end = min(depth, begin + SEGMENT)
                    ids.append(conv)
                    depths.append(end)
                    paths.append(b"".join(records[begin : end + 1]))
                    ends.append(end == depth)
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array(ids, pa.int64()),
                    "depth": pa.array(depths, pa.int32()),
                    "path": pa.array(paths, pa.binary()),
                    "ends": pa.array(ends, pa.bool_()),
                }
            )

    return lists.mapInArrow(run, "conv_id long, depth int, path binary, ends boolean")


def _key(back: int):
    """Key of the ``back``-th last record of a path."""
    return F.expr(f"substring(path, octet_length(path) - {RECORD * back - 1}, 16)")


def _merged(rows: DataFrame) -> DataFrame:
    """The nodes of a level, from the conversations that end there and the nodes below, each with its parent's path."""
    sums = rows.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("children").alias("n_children"),
        F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"),
    )
    length = F.conv(F.hex(F.expr("substring(path, octet_length(path) - 7, 8)")), 16, 10).cast("long")
    return sums.select(
        "path",
        "conv_id",
        "n_convs",
        "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * length).alias("saved_tokens"),
    )


def _block(nodes: DataFrame, depth: int, low: int, floor: int) -> DataFrame:
    """The nodes of a level and, down to depth ``low``, those above, where no others join them: each has one
    child. Paths begin at depth ``floor``; the lowest nodes keep that of their parent in ``above``."""
    at = lambda d, more=0: f"{RECORD} * ({d} - {floor}) + {1 + more}"
    size = f"cast(conv(hex(substring(path, {at('i', 16)}, 8)), 16, 10) AS bigint)"
    passed = f"CASE WHEN d < {depth} THEN aggregate(sequence(d, {depth - 1}), 0L, (s, i) -> s + {size}) ELSE 0L END"
    return nodes.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(depth)))).select(
        F.col("d").alias("depth"),
        F.expr(f"substring(path, {at('d')}, 16)").alias("key"),
        F.expr(f"substring(path, {at('d - 1')}, 16)").alias("parent"),
        "conv_id",
        "n_convs",
        F.when(F.col("d") == depth, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.expr(passed)).alias("saved_tokens"),
        F.when(F.col("d") == low, F.expr(f"substring(path, 1, {RECORD * (low - floor)})")).alias("above"),
    )


def _stay_apart(rows: DataFrame, records: int) -> bool:
    """Whether different paths still differ in their first ``records`` records."""
    path = F.xxhash64("path")
    groups = rows.groupBy(F.expr(f"substring(path, 1, {RECORD * records})").alias("head"))
    return groups.agg(F.min(path).alias("a"), F.max(path).alias("b")).filter("a != b").isEmpty()


def _levels(chains: DataFrame, folder: str) -> DataFrame:
    """The nodes of all depths, written to ``folder`` block by block.

    A block is a level, or several levels between which no conversation ends and no nodes merge.
    """
    spark = chains.sparkSession
    zero = F.lit(0).cast("long")
    ended = chains.filter("ends").groupBy("depth", "path").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    ended = materialize(
        ended.withColumns({"children": zero, "n_leaves": zero, "saved_tokens": zero}).repartition("depth", "path"), by=["depth"]
    )
    ending = {r["depth"] for r in ended.select("depth").distinct().collect()}  # one number a level
    # paths that longer conversations go on from
    longer = chains.filter("NOT ends").groupBy("depth", "path").agg(F.lit(1).alias("one")).select("depth", "path", _key(1).alias("key"))
    longer = materialize(longer.repartition("depth", "key"), by=["depth"])
    columns = ["path", "conv_id", "n_convs", "children", "n_leaves", "saved_tokens"]
    schema = "depth int, key binary, parent binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    paths: list[str] = []

    def written(rows: DataFrame) -> DataFrame:
        paths.append(f"{folder}/{len(paths)}")
        rows.write.parquet(paths[-1])
        return spark.read.schema(f"{schema}, above binary").parquet(paths[-1])

    def parents_of(nodes: DataFrame, key: str) -> DataFrame:
        """What the lowest nodes of a block give to the nodes above, by path or key."""
        sums = [F.count(F.lit(1)).alias("children"), *(F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens"))]
        return nodes.filter("above IS NOT NULL").groupBy(F.col(key)).agg(F.min("conv_id").alias("conv_id"), *sums)

    deepest = max(ending, default=0)
    block = None
    for end in range(-(-deepest // SEGMENT) * SEGMENT, 0, -SEGMENT):
        floor, depth, live = end - SEGMENT, min(end, deepest), None
        if block is not None:
            above = parents_of(block, "parent").withColumnRenamed("parent", "key")
            live = above.join(longer.filter(F.col("depth") == end).drop("depth"), "key").select(*columns)
        while depth > floor:
            if depth in ending:
                own = ended.filter(F.col("depth") == depth).select(*columns)
                live = own if live is None else live.unionByName(own)
            low = max((d for d in ending if floor < d < depth), default=floor) + 1
            if low < depth and not _stay_apart(live, low - floor + 1):
                low = depth
            block = written(_block(_merged(live), depth, low, floor))
            live = parents_of(block, "above").withColumnRenamed("above", "path").select(*columns)
            depth = low - 1
    root = ended.filter("depth = 0").select(*columns)
    if block is not None:
        root = root.unionByName(parents_of(block, "above").withColumnRenamed("above", "path").select(*columns))
    none = F.lit(None).cast("binary")
    written(
        _merged(root).select(F.lit(0).alias("depth"), _key(1).alias("key"), none.alias("parent"), "*", none.alias("above")).drop("path")
    )
    return spark.read.schema(schema).parquet(*paths)


def _end_hashes(chains: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the nodes at which conversations end."""
    ends = chains.filter("ends").select(_key(1).alias("key"), "conv_id")

    def texts(batches):  # sorted by key and id
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), dtype="S16") if batch.num_rows else []
            ids = batch.column("conv_id")
            numbers = ids.cast(pa.string()).to_pylist()
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
            edges = sorted({*new, *range(0, len(numbers), PIECE), len(numbers)})
            pieces = list(zip(edges, edges[1:]))
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array([batch.column("key")[a].as_py() for a, _ in pieces], pa.binary()),
                    "first": pa.array([ids[a].as_py() for a, _ in pieces], pa.int64()),
                    "ids": pa.array([",".join(numbers[a:b]) for a, b in pieces], pa.string()),
                }
            )

    def hashes(batches):  # sorted by key and first id
        key, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _pairs(done)
        if state:
            yield _pairs([(key, state.hexdigest())])

    def _pairs(rows):
        keys, values = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(values, pa.string())})

    pieces = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = pieces.mapInArrow(texts, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, "key binary, ends_sha256 string")


def prefix_trie(lists: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conv_id, turns`` (``turn_lists``):

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes of its subtree), ``saved_tokens`` (over its subtree, members
    but one times the code points of the last text), ``ends_sha256`` (of the ids that end there).
    """
    spark = lists.sparkSession
    folder = shared_subfolder(spark, keep=True)
    with stored_tables(spark):
        chains = materialize(_chains(lists))
        nodes = _levels(chains, folder)
        ends = materialize(_end_hashes(chains), keep=True)
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends, "key", "left").join(parents, "parent", "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
