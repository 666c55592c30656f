"""Prefix trie of conversations by fixed-length blocks of turns.

1. Every turn becomes a digest of its role and text; texts are not shuffled.
2. A conversation's turns are hashed in blocks of BLOCK turns, each block
   together with the digest of everything before it. Conversations are grouped
   by these block digests: one row for each distinct block after each distinct
   past, however many conversations share it.
3. Turn boundaries are refined on those groups only. A block that follows its
   past alone has its turns as nodes at once; where siblings diverge, the
   prefixes of the sibling blocks are merged by their digests.
4. Sums over subtrees need no walk: a conversation *owns* the nodes whose
   smallest member it is, the end of its path. What a node's subtree saves is
   the sum over its members of the code points before their own nodes, so it
   comes from one more grouping by block, as the number of leaves does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.common import materialize, portions, release

#: Turns of a block.
BLOCK = 4
#: Ids are hashed in pieces of a range of so many.
RANGE = 4096
ROOT = bytes(16)

NOTHING = hashlib.sha256(b"").hexdigest()


def keyed(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size) per row of ``turns`` (conv_id, turn, role, text).

    pos counts a conversation's rows from 0 by turn, nulls first, ties by
    digest; digest has 16 bytes of SHA-256 over role and text, size the text's
    code points. A null role or text counts as empty. Rows without a conv_id
    belong to no conversation and are left out; repeated rows are turns of
    their own. Other columns are ignored.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = turns.where(turns["conv_id"].isNotNull()).select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "digest", "size")


def rebuilt(rows: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """``keyed`` rows with each conversation's first h turns taken from the first of its hundred.

    h is crc32 of the decimal conv_id, modulo ``most``; a conversation's own
    turns after its first h follow.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    heads = rows.select("conv_id").distinct().withColumn("h", h).where("h > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    base = rows.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base")
    taken = heads.join(base, "base").where("pos < h").select("conv_id", "pos", "digest", "size")
    return taken.union(rows.where(F.col("pos") >= h))


def prefix_id(parent: bytes, turns: list[bytes]) -> bytes:
    """The id of the node that ``turns`` (at most a block) lead to from the node ``parent``."""
    return hashlib.blake2b(parent + b"".join(turns), digest_size=16).digest() if turns else parent


BLOCKS = pa.schema([("conv_id", pa.int64()), ("parent", pa.binary()), ("id", pa.binary()), ("depth", pa.int64()), ("before", pa.int64()), ("turns", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("last", pa.bool_())])
BLOCKS_SQL = "conv_id long, parent binary, id binary, depth long, before long, turns array<binary>, sizes array<long>, last boolean"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows sorted by conversation and place; one block is held at a time, whatever a conversation's length."""
    conv: int | None = None
    parent, depth, before = ROOT, 0, 0
    turns: list[bytes] = []
    sizes: list[int] = []
    out: list[tuple] = []

    def close(last: bool) -> None:
        nonlocal parent, depth, before, turns, sizes
        own = prefix_id(parent, turns)
        out.append((conv, parent, own, depth, before, turns, sizes, last))
        parent, depth, before = own, depth + len(turns), before + sum(sizes)
        turns, sizes = [], []

    def emit() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), BLOCKS)], schema=BLOCKS)
        out.clear()
        return made

    for batch in portions(batches, 4000):
        for c, digest, size in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "digest", "size"))):
            if c != conv:
                if conv is not None:
                    close(True)
                conv, parent, depth, before = c, ROOT, 0, 0
            elif len(turns) == BLOCK:
                close(False)
            turns.append(digest)
            sizes.append(size)
        if out:
            yield emit()
    if conv is not None:
        close(True)
        yield emit()


NODES = pa.schema([("group", pa.binary()), ("id", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("size", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("lone", pa.bool_())])
NODES_SQL = "group binary, id binary, parent binary, depth long, size long, before long, n long, least long, lone boolean"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each turn of each distinct block."""
    for batch in portions(batches, 1000):
        out = []
        for r in batch.to_pylist():
            parent, before = r["parent"], r["before"]
            for k, size in enumerate(r["sizes"], 1):
                own = prefix_id(r["parent"], r["turns"][:k])
                out.append((r["id"], own, parent, r["depth"] + k, size, before, r["n"], r["least"], r["lone"]))
                parent, before = own, before + size
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NODES)], schema=NODES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, joined by commas, from sorted pieces."""
    node, state = None, hashlib.sha256()
    ends: list[tuple[bytes, str]] = []
    for batch in portions(batches):
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != node:
                if node is not None:
                    ends.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in ends], pa.binary()), pa.array([e[1] for e in ends], pa.string())], names=["id", "ends_sha256"])
        ends = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["id", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) per node of ``ends`` (conv_id, id): its conversations' ids, ascending.

    Ids are put together by ranges first, so that what one task reads of a node
    is a string for every 4,096 ids, and hashes string after string.
    """
    piece = F.floor(F.col("conv_id") / RANGE)
    pieces = ends.groupBy("id", piece.alias("piece")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))
    return pieces.repartition("id").sortWithinPartitions("id", "piece").select("id", "ids").mapInArrow(_digests, "id binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie over ``rows`` (conv_id, pos, digest, size), and where each of ``conversations`` (conv_id) ends.

    Nodes: id, parent (null for the root), depth, conv_id (smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Ends: conv_id,
    id. A conversation without rows ends at the root; without conversations
    there is no node. A node's role and text are those of its conv_id's row at
    place depth - 1.
    """
    spark = rows.sparkSession
    blocks = materialize(rows.select("conv_id", "pos", "digest", "size").repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_blocks, BLOCKS_SQL))
    groups = blocks.groupBy("parent", "id").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), *(F.first(c).alias(c) for c in ("depth", "before", "turns", "sizes")))
    groups = materialize(groups)
    siblings = materialize(groups.groupBy("parent").agg((F.count("*") == 1).alias("lone")))
    refined = materialize(groups.join(siblings, "parent").mapInArrow(_nodes, NODES_SQL))
    keys = ["id", "parent", "depth", "size", "before"]
    alone = refined.where("lone").select(*keys, "n", "least")
    merged = refined.where("not lone").groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    nodes = materialize(alone.union(merged))
    release(groups, siblings)

    children = materialize(nodes.groupBy("parent").agg(F.count("*").alias("n_children")))
    owned = materialize(nodes.groupBy("least").agg(F.min("before").alias("own")))
    tips = nodes.join(children.select(F.col("parent").alias("id")), "id", "left_anti").select(F.col("least").alias("conv_id"), F.lit(1).alias("tip"))
    closed = blocks.where("last").select("conv_id", "id", (F.col("before") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    known = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    ends = materialize(known.join(closed, "conv_id", "left").select("conv_id", F.coalesce("id", F.lit(ROOT)).alias("id"), F.coalesce("total", F.lit(0)).alias("total")))
    weights = ends.join(owned.withColumnRenamed("least", "conv_id"), "conv_id", "left").join(tips, "conv_id", "left")
    weights = materialize(weights.select("conv_id", F.coalesce("own", "total").alias("spared"), F.coalesce("tip", F.lit(0)).alias("tip")))
    sums = blocks.select("conv_id", F.col("id").alias("group")).join(weights, "conv_id").groupBy("group").agg(F.sum("spared").alias("spared"), F.sum("tip").alias("tips"))
    sums = materialize(refined.select("group", "id").join(sums, "group").groupBy("id").agg(F.sum("spared").alias("spared"), F.sum("tips").alias("tips")))

    up = nodes.select(F.col("id").alias("parent"), F.col("least").alias("parent_conv_id"))
    whole = weights.agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.sum("spared").alias("spared"), F.sum("tip").alias("tips")).first()
    top = nodes.where("depth = 1").select(*nodes.columns, F.lit(whole["least"]).cast("long").alias("parent_conv_id"))
    body = nodes.where("depth > 1").join(up, "parent").select(*nodes.columns, "parent_conv_id").union(top)
    body = body.join(sums, "id").join(owned, "least").join(children.withColumnRenamed("parent", "id"), "id", "left")
    saved = F.col("spared") - F.col("own") - (F.col("n") - 1) * F.col("before")
    body = body.select("id", "parent", "depth", F.col("least").alias("conv_id"), "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("tips").alias("n_leaves"), saved.alias("saved_tokens"))
    if not whole["n"]:
        return body, ends.select("conv_id", "id")
    first = nodes.where("depth = 1").count()
    root = [(ROOT, None, 0, whole["least"], None, whole["n"], first, whole["tips"] or 1, whole["spared"])]
    root = spark.createDataFrame(root, "id binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    release(refined)
    return body.union(root), ends.select("conv_id", "id")


def trie_report(turns: DataFrame) -> DataFrame:
    """op12's columns for ``turns`` (conv_id, turn, role, text), every conversation rebuilt first.

    Null roles and texts are empty; rows without a conv_id are left out; an
    empty table has no nodes.
    """
    rows = materialize(keyed(turns))
    nodes, ends = prefix_trie(rebuilt(rows), rows.select("conv_id"))
    digests = materialize(end_digests(ends))
    release(rows)
    out = nodes.join(digests, "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_force(rows: list[tuple]) -> list[tuple]:
    """op12's rows from (conv_id, turn, role, text), node by node (for tests)."""
    import math
    import zlib

    own: dict[int, list] = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members: dict[tuple, list[int]] = {}
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members.setdefault(full[c][:d], []).append(c)
    children: dict[tuple, list[tuple]] = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in children[p])
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(full[c]) == len(p)).encode()).hexdigest()
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items()]
