"""Merkle manifest of a table: digests from leaves to one root, proofs back to the leaves.

A leaf is the digest of a row's fields; the leaves of a tree ascend by key.  While a tree has several nodes, every
16 consecutive ones (the last run may be shorter, even one) become the digest of their concatenation.  What remains
is the tree's subroot; the subroots, ordered by tree, make the leaves of one more tree, whose remainder is the root.

Method: time-forward processing.  Nodes are labelled (tree, level, place) and every digest is a message to its
parent's label.  A queue ordered by label delivers the messages, so a parent is worked on when all its children have
been.  The queue is external: its runs are Spark's sorted shuffle files, labelled (tree, block of 4096 nodes), and
a task keeps only the part of one block in memory, a heap.  A block yields its top node; the top nodes of a tree
are the next round's messages, three levels for each round (25 billion rows need three rounds).  The reversed
sweep goes over the same blocks from the root down and delivers to each node the proof of the node above; a node
puts its own siblings in front.  A proof has, for every level, the digests left and right of the node.

Scale: a hot tree is as many blocks as it needs.  Places are given by one range sort of (tree, key): a task numbers
its own rows and only the first tree of a task can have begun in an earlier one, so a row for each task makes the
numbers global.  Rows carry digests, never texts; the driver sees one row for each task of the sort.  Rounds are
written to the shared folder and read again, so a lost executor costs its own tasks.

Cases: null fields are written as ``-``, others as byte count, colon and value; a null tree is a tree of its own and
comes first, trees are ordered bytewise; null keys come first, rows of one key are ordered by their digests, and
repeated rows are leaves of their own.  An empty table has no root and gives no rows.  Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized

ARITY, LEVELS = 16, 3                         # nodes under a parent; levels that a block spans
BLOCK = ARITY ** LEVELS
ROWS_IN_TASK = 400_000
OWN = ("tree", "idx", "digest", "key", "claim")
PROOF = "array<struct<left:string,right:string>>"


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(fields: Sequence[Column]) -> Column:
    """The leaf of a row, natively: each field as its UTF-8 byte count, a colon and its value, ``-`` if null."""
    def written(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[written(c) for c in fields]), 256)


def levels_of(nodes: list[str], whole: bool) -> list[list[str]]:
    """Digests of a block by level.  ``whole``: the block is its whole tree, so the sweep ends at a single node;
    otherwise it spans ``LEVELS`` levels whatever the number of nodes."""
    queue = [(0, place, d) for place, d in enumerate(nodes)]           # sorted, so already a heap
    levels = [nodes]
    while not (len(queue) == 1 if whole else queue[0][0] == LEVELS):
        level, parent, run = queue[0][0], queue[0][1] // ARITY, []
        while queue and queue[0][0] == level and queue[0][1] // ARITY == parent:
            run.append(heappop(queue)[2])
        if level + 1 == len(levels):
            levels.append([])
        levels[level + 1].append(digest(run))
        heappush(queue, (level + 1, parent, levels[level + 1][-1]))
    return levels


def delivered(levels: list[list[str]], above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Proofs of a block's nodes, given the proof of its top: the sweep of ``levels_of`` reversed."""
    proofs = [above]
    for level in reversed(levels[:-1]):
        proofs = [[("".join(level[i - i % ARITY:i]), "".join(level[i + 1:i - i % ARITY + ARITY])), *proofs[i // ARITY]]
                  for i in range(len(level))]
    return proofs


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, list[dict], pa.Schema]]:
    """(tree, block, rows, schema) of a sorted stream; a block has at most ``BLOCK`` nodes and a row above them."""
    key, rows, schema = None, [], None
    for b in batches:
        schema = b.schema
        for r in b.to_pylist():
            if (k := (r["tree"], r["block"])) != key:
                if rows:
                    yield *key, rows, schema
                key, rows = k, []
            rows.append(r)
    if rows:
        yield *key, rows, schema


def numbered(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (tree, key, digest, claim) with ``idx``, its place in its tree by (key, digest) from 0."""
    spark = nodes.sparkSession
    order = [F.col(c).asc_nulls_first() for c in ("tree", "key", "digest")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tree, at = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            own = []
            for t in b.column(b.schema.get_field_index("tree")).to_pylist():
                tree, at = t, at + 1 if t == tree else 0
                own.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * len(own), pa.int32()), pa.array(own, pa.int64())],
                                             names=[*b.schema.names, "task", "own"])
    t = materialize(nodes.repartitionByRange(sized(spark, nodes.count(), ROWS_IN_TASK), *order).sortWithinPartitions(*order)
                    .mapInArrow(place, f"{schema}, task int, own bigint"), name)
    per = t.groupBy("task", "tree").agg(F.count("*").alias("n"))
    edges = per.groupBy("task").agg(F.min(F.struct("tree", "n")).alias("lo"), F.max(F.struct("tree", "n")).alias("hi")).collect()
    before, last, carried = [], object(), 0                # a row for each task
    for e in sorted(edges, key=lambda e: e["task"]):
        came = carried if e["lo"]["tree"] == last else 0
        if came:
            before.append((e["task"], e["lo"]["tree"], came))
        last, carried = e["hi"]["tree"], e["hi"]["n"] + (came if e["hi"]["tree"] == e["lo"]["tree"] else 0)
    b = F.broadcast(spark.createDataFrame(before, "b_task int, b_tree string, came bigint"))
    return t.join(b, (F.col("task") == F.col("b_task")) & F.col("tree").eqNullSafe(F.col("b_tree")), "left") \
        .select(*nodes.columns, (F.col("own") + F.coalesce("came", F.lit(0))).alias("idx"))


def in_blocks(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt out by block and sorted by label."""
    return rows.repartition(sized(rows.sparkSession, n, ROWS_IN_TASK), "tree", "block").sortWithinPartitions("tree", "block", "idx")


def is_whole(block: int, nodes: list) -> bool:
    return block == 0 and len(nodes) < BLOCK


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The rounds of the upward sweep, ``nodes`` (tree, idx, digest and more) first; the last has one node for each tree."""
    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, rows, _ in blocks(batches):
            top = levels_of([r["digest"] for r in rows], is_whole(block, rows))[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.string()), pa.array([block], pa.int64()), pa.array([top])],
                                             names=["tree", "idx", "digest"])
    rounds = [nodes]
    while len(rounds) == 1 or not nodes.filter("idx > 0").isEmpty():
        labelled = nodes.select("tree", F.floor(F.col("idx") / BLOCK).cast("bigint").alias("block"), "idx", "digest")
        nodes = materialize(in_blocks(labelled, nodes.count()).mapInArrow(up, "tree string, idx bigint, digest string"), name)
        rounds.append(nodes)
    return rounds


def descend(rounds: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """The reversed sweep: ``rounds[0]``'s tree, idx, digest, key, claim with proof, subroot and root; ``tops`` has
    those three for the single node (idx 0) of each tree."""
    kind = rounds[0].schema["key"].dataType.simpleString()
    carried = f"tree string, idx bigint, digest string, key {kind}, claim string"

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, (top, *nodes), schema in blocks(batches):
            above = [(x["left"], x["right"]) for x in top["proof"]]
            proofs = delivered(levels_of([r["digest"] for r in nodes], is_whole(block, nodes)), above)
            own = [pa.array([r[c] for r in nodes], schema.field(c).type) for c in OWN]
            pieces = [x for p in proofs for x in p]
            ends = [0]
            for p in proofs:
                ends.append(ends[-1] + len(p))
            pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in pieces], pa.string()), pa.array([x[1] for x in pieces], pa.string())],
                                               ["left", "right"])
            extra = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                     pa.array([top["subroot"]] * len(nodes), pa.string()), pa.array([top["root"]] * len(nodes), pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *extra], names=[*OWN, "proof", "subroot", "root"])
    for i in range(len(rounds) - 2, -1, -1):
        nodes = rounds[i]
        for c, t in (("key", kind), ("claim", "string")):
            nodes = nodes if c in nodes.columns else nodes.withColumn(c, F.lit(None).cast(t))
        own = nodes.select(F.floor(F.col("idx") / BLOCK).cast("bigint").alias("block"), *OWN,
                           F.lit(None).cast(PROOF).alias("proof"), *[F.lit(None).cast("string").alias(c) for c in ("subroot", "root")])
        heads = tops.select("tree", F.col("idx").alias("block"), F.lit(-1).cast("bigint").alias("idx"),
                            F.lit(None).cast("string").alias("digest"), F.lit(None).cast(kind).alias("key"),
                            F.lit(None).cast("string").alias("claim"), F.col("proof").cast(PROOF).alias("proof"), "subroot", "root")
        tops = in_blocks(own.unionByName(heads), rounds[i].count()).mapInArrow(
            down, f"{carried}, proof {PROOF}, subroot string, root string")
        tops = materialize(tops, name) if i else tops
    return tops


def manifest(df: DataFrame, key: str, tree: str, leaf: Column, claim: Column | None = None) -> DataFrame:
    """key, tree, leaf, claim, subroot, root and proof (for each level, the digests left and right of the row's node,
    from the leaves up through the subroot to the root) of every row of ``df``.

    ``leaf`` is the digest of the row (``row_digest``); ``claim`` another digest to be held against the proof, the
    leaf itself by default."""
    rows = df.select(F.col(tree).cast("string").alias("tree"), F.col(key).alias("key"), leaf.alias("digest"),
                     (leaf if claim is None else claim).alias("claim"))
    rounds = climb(numbered(materialize(rows, "merkle-leaves"), "merkle-places"), "merkle-up")
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.lit(None).cast("string").alias("claim"))
    top = climb(numbered(subroots, "merkle-places"), "merkle-up")
    crown = top[-1].select("tree", "idx", F.array().cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"),
                           F.col("digest").alias("root"))
    above = materialize(descend(top, crown, "merkle-down"), "merkle-subroots") \
        .select(F.col("key").alias("tree"), F.lit(0).cast("bigint").alias("idx"), "proof", F.col("digest").alias("subroot"), "root")
    return descend(rounds, above, "merkle-down").select("key", "tree", F.col("digest").alias("leaf"), "claim", "subroot", "root", "proof")


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(claim: Column, proof: Column) -> Column:
    """The root that ``claim`` leads to: folded with its siblings level by level."""
    return F.aggregate(proof, claim, lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]), 256))
