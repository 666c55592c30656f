"""SimHash near-duplicate search with a Gray-order hierarchical index.

1. Every text becomes a 64-bit fingerprint: the majority of each bit over the
   hashes of its three-word shingles. Rows of one fingerprint collapse, so a
   group of copies costs one row from there on.
2. Fingerprints within three bits agree in one quarter at least. Each is
   indexed four times, rotated so that another quarter leads; the leading
   quarter is the top node of the index, and everything below it is sorted by
   Gray rank.
3. In a task the sorted fingerprints are the leaves of a tree of small groups.
   A node holds the bits on which all its members agree. Two nodes descend
   together: bits that are newly shared by both add to the differences counted
   above, and beyond three the whole pair of groups goes. Pairs of groups that
   are one component already are not descended either, so dense groups give a
   spanning forest of links and not their square.
4. A top node of more than BLOCK fingerprints is cut into ranges of the sorted
   sequence. Ranges are linked inside first; then ranges whose shared bits
   differ in three places at most meet two by two, but for those of one
   component.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import materialize, portions, release
from tracemill.llm.neardup import components

SHINGLE, SEED = 3, 42
#: Fingerprints of at most this many differing bits are linked.
NEAR = 3
#: Fingerprints of a range of a large top node, about, and of a smaller top node at most.
BLOCK = 32_768
#: Children of a node of the tree, and pairs of nodes that descend at once.
FAN, FRONT = 4, 1 << 15
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in parts that end before white space."""
    at = 0
    while at < len(data):
        found = _SPACE.search(data, at + PIECE)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def _votes(words: list[bytes]) -> np.ndarray:
    """How many hashes of the three-word shingles of ``words`` have each bit."""
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    end = (start + size)[SHINGLE - 1 :]
    total = np.zeros(64, np.int64)
    for i in range(0, len(end), 1 << 16):
        cut = [text[a:b] for a, b in zip(start[i : i + (1 << 16)].tolist(), end[i : i + (1 << 16)].tolist())]
        h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None) -> int:
    """The text's SimHash, unsigned (see op11's contract); zero without words."""
    votes, n, rest = np.zeros(64, np.int64), 0, []
    for piece in _pieces((text or "").encode().lower()):
        words = rest + piece.split()
        if len(words) >= SHINGLE:
            votes += _votes(words)
            n += len(words) - SHINGLE + 1
            words = words[1 - SHINGLE :]
        rest = words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(rest), SEED) if rest else 0
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        own = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row of ``docs`` (doc_id, text); fp holds the 64 bits as a signed number."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_prints, "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Places of codes in Gray order: neighbours in it differ in one bit."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _turned(fp: np.ndarray, quarter: int) -> np.ndarray:
    """Codes with the given quarter first."""
    s = np.uint64(16 * quarter)
    return fp if not quarter else (fp << s) | (fp >> (np.uint64(64) - s))


RANKED = "node int, rank long, fp long"


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        rank = np.concatenate([gray_rank(_turned(fp, q)) for q in range(4)])
        node = (rank >> np.uint64(48)).astype(np.int32) + np.repeat(np.arange(4, dtype=np.int32) << 16, len(fp))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(rank.view(np.int64)), pa.array(np.tile(fp, 4).view(np.int64))], names=["node", "rank", "fp"])


def ranked(prints: DataFrame) -> DataFrame:
    """(node, rank, fp), four rows a fingerprint of ``prints`` (fp): top node and Gray rank with each quarter leading."""
    return prints.select("fp").mapInArrow(_ranked, RANKED)


class GrayIndex:
    """The tree over fingerprints sorted by (top node, Gray rank).

    Level 0 has the codes. A node of a higher level has up to FAN neighbours of
    the level below, all of one top node; ``one`` has the bits that all its
    members have, ``shared`` those on which they agree.
    """

    def __init__(self, code: np.ndarray, node: np.ndarray):
        top = np.cumsum(np.r_[0, node[1:] != node[:-1]]) if len(node) else np.empty(0, np.int64)
        self.one, self.shared, self.first = [code], [np.full(len(code), _ALL)], [np.arange(len(code) + 1)]
        some, tops = code, int(top[-1]) + 1 if len(top) else 0
        while len(top) > tops:
            begin = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
            at = np.flatnonzero((np.arange(len(top)) - begin[top]) % FAN == 0)
            one, some = np.bitwise_and.reduceat(self.one[-1], at), np.bitwise_or.reduceat(some, at)
            self.first.append(np.r_[at, len(top)])
            self.one.append(one)
            self.shared.append(one | ~some)
            top = top[at]

    def extent(self, component: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Smallest and largest component below every node."""
        out = [(component, component)]
        for first in self.first[1:]:
            lo, hi = out[-1]
            out.append((np.minimum.reduceat(lo, first[:-1]), np.maximum.reduceat(hi, first[:-1])))
        return out

    def forest(self, pairs: tuple[np.ndarray, np.ndarray], component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of linked fingerprints, below the given pairs of top nodes, that join components; ``component`` is brought up to date."""
        extent, found = self.extent(component), []
        u, v = pairs
        top = len(self.one) - 1
        stack = [(top, u[i : i + FRONT], v[i : i + FRONT], None, None) for i in range(0, len(u), FRONT)]
        while stack:
            level, u, v, seen, count = stack.pop()
            lo, hi = extent[level]
            live = (lo[u] != hi[v]) | (hi[u] != lo[v])
            u, v = u[live], v[live]
            if seen is not None:
                seen, count = seen[live], count[live]
            one, shared = self.one[level], self.shared[level]
            both = shared[u] & shared[v]
            new = both if seen is None else both & ~seen
            more = np.bitwise_count((one[u] ^ one[v]) & new)
            count = more if count is None else count + more
            near = count <= NEAR
            u, v, seen, count = u[near], v[near], both[near], count[near]
            if not level:
                if len(u) and self._join(u, v, component, found):
                    extent = self.extent(component)
                continue
            stack += self._below(level, u, v, seen, count)
        ends = np.array(found, np.int64).reshape(-1, 2)
        return ends[:, 0], ends[:, 1]

    def _below(self, level: int, u: np.ndarray, v: np.ndarray, seen: np.ndarray, count: np.ndarray) -> list[tuple]:
        """Pairs of children, in portions; a group against itself comes off the stack first."""
        first = self.first[level]
        parts: list[list[np.ndarray]] = []
        for i in range(FAN):
            for j in range(FAN):
                x, y = first[u] + i, first[v] + j
                there = (x < first[u + 1]) & (y < first[v + 1]) & ((u != v) | (x <= y))
                if level == 1:
                    there &= x != y
                parts.append([x[there], y[there], seen[there], count[there]])
        x, y, seen, count = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(x == y, kind="stable")
        x, y, seen, count = x[order], y[order], seen[order], count[order]
        return [(level - 1, x[i : i + FRONT], y[i : i + FRONT], seen[i : i + FRONT], count[i : i + FRONT]) for i in range(0, len(x), FRONT)]

    @staticmethod
    def _join(u: np.ndarray, v: np.ndarray, component: np.ndarray, found: list[tuple[int, int]]) -> bool:
        """Unite the components of linked fingerprints; the links that did it are added to ``found``."""
        a, b = component[u], component[v]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return False
        a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        order = np.lexsort((b, a))
        fresh = order[np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for k in fresh.tolist():
            p, q = find(int(a[k])), find(int(b[k]))
            if p != q:
                root[max(p, q)] = min(p, q)
                found.append((int(u[apart[k]]), int(v[apart[k]])))
        names = np.unique(component)
        component[:] = np.array([find(x) for x in names.tolist()], component.dtype)[np.searchsorted(names, component)]
        return True


LINKS = "a long, b long"


def _links(fp: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    ends = np.stack([fp[u].view(np.int64), fp[v].view(np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(ends.max(0)), pa.array(ends.min(0))], names=["a", "b"])


def _codes(rank: np.ndarray) -> np.ndarray:
    rank = rank.view(np.uint64)
    return rank ^ (rank >> np.uint64(1))


def _fp(code: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The fingerprint of a turned code."""
    s = ((node >> 16) * 16).astype(np.uint64)
    return np.where(s == 0, code, (code >> s) | (code << ((np.uint64(64) - s) % np.uint64(64))))


def _inside(node: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """The forest of links inside each top node of sorted rows."""
    code = _codes(rank)
    index = GrayIndex(code, node)
    every = np.arange(len(index.one[-1]))
    fp = _fp(code, node)
    return _links(fp, *index.forest((every, every), np.arange(len(code))))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the top nodes of a sorted partition, about BLOCK rows at a time, each top node in one piece up to two BLOCKs."""
    node, rank = np.empty(0, np.int32), np.empty(0, np.int64)
    for batch in batches:
        node = np.r_[node, batch.column(0).to_numpy(zero_copy_only=False)]
        rank = np.r_[rank, batch.column(1).to_numpy(zero_copy_only=False)]
        while len(node) >= BLOCK:
            cut = int(np.searchsorted(node, node[-1]))  # the last top node may go on
            if not cut:
                if len(node) < 2 * BLOCK:
                    break
                cut = len(node)
            yield _inside(node[:cut], rank[:cut])
            node, rank = node[cut:], rank[cut:]
    if len(node):
        yield _inside(node, rank)


def _across(rows: pa.Table) -> pa.Table:
    """The forest of links between two ranges of one top node, or inside one range."""
    rank, fp, piece, label = (rows.column(c).to_numpy() for c in ("rank", "fp", "piece", "label"))
    order = np.lexsort((rank.view(np.uint64), piece))
    rank, piece, fp = rank[order], piece[order], fp[order].view(np.uint64)
    index = GrayIndex(_codes(rank), piece)
    component = np.unique(label[order], return_inverse=True)[1].astype(np.int64)
    last = len(index.one[-1]) - 1
    links = _links(fp, *index.forest((np.array([0]), np.array([last])), component))
    return pa.Table.from_batches([links])


def _hot_links(hot: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Links across the ranges of large top nodes that join components of ``labels``."""
    spark = hot.sparkSession
    labelled = materialize(hot.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    # members of a large component are ranges of their own, which need not meet one another
    large = materialize(labelled.groupBy("node", "label").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK).select("node", "label", F.lit(True).alias("pooled")))
    dealt = labelled.join(large, ["node", "label"], "left").withColumn("pool", F.when(F.col("pooled"), F.col("label")))
    parts = max(1, -(-rows // BLOCK))
    dealt = materialize(dealt.repartitionByRange(parts, "node", "pool", "rank").select("node", "pool", "rank", "fp", "label", F.spark_partition_id().alias("part")))
    # one row a range and top node; the key joins a null pool as well
    piece = F.xxhash64("node", "pool", "part")
    code = F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", 1))
    dealt = dealt.withColumn("piece", piece).withColumn("code", code)
    sums = dealt.groupBy("node", "piece").agg(F.max(F.col("pool").isNotNull()).alias("pooled"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_and("code").alias("one"), F.bit_or("code").alias("some"))
    sums = materialize(sums.withColumn("shared", F.col("one").bitwiseOR(F.bitwise_not("some"))))
    x, y = sums.alias("x"), sums.alias("y")
    differ = F.bit_count(F.col("x.one").bitwiseXOR(F.col("y.one")).bitwiseAND(F.col("x.shared")).bitwiseAND(F.col("y.shared")))
    open_ = (F.col("x.lo") != F.col("y.hi")) | (F.col("x.hi") != F.col("y.lo"))
    meet = x.join(y, F.col("x.node") == F.col("y.node")).where(F.col("x.piece") <= F.col("y.piece")).where(open_ & (differ <= NEAR))
    meet = materialize(meet.select(F.col("x.node").alias("node"), F.col("x.piece").alias("p"), F.col("y.piece").alias("q")))
    sides = meet.select("*", F.explode(F.array_distinct(F.array("p", "q"))).alias("piece"))
    groups = sides.join(dealt.select("node", "piece", "rank", "fp", "label"), ["node", "piece"]).select("node", "p", "q", "piece", "rank", "fp", "label")
    found = materialize(groups.groupBy("node", "p", "q").applyInArrow(_across, LINKS).distinct())
    release(labelled, large, dealt, sums, meet)
    return found


def near_links(prints: DataFrame) -> DataFrame:
    """(node, label): for every fingerprint of ``prints`` (fp, distinct) that has a link, the smallest fingerprint reachable."""
    rows = materialize(ranked(prints))
    # there are 4 * 65,536 top nodes at most, whatever the input: small enough to broadcast
    hot = F.broadcast(materialize(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)))
    cold = rows.select("node", "rank").join(hot.select("node"), "node", "left_anti")
    links = materialize(cold.repartition("node").sortWithinPartitions("node", F.col("rank")).mapInArrow(_stream, LINKS))
    n_hot = hot.agg(F.sum("n")).first()[0] or 0
    if n_hot:
        large = materialize(rows.join(hot.select("node"), "node", "left_semi"))
        parts = max(1, -(-n_hot // BLOCK))
        inside = materialize(large.select("node", "rank").repartitionByRange(parts, "node", "rank").sortWithinPartitions("node", "rank").mapInArrow(_stream, LINKS))
        labels = materialize(components(links.union(inside)))
        across = _hot_links(large, labels, n_hot)
        out = materialize(components(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(across)))
        release(large, inside, labels, across)
    else:
        out = materialize(components(links))
    release(rows, hot, links)
    return out.union(out.select(F.col("label").alias("node"), "label").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id per row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id whose text's fingerprint can be reached
    over links. Null, empty and blank texts have the fingerprint zero and are
    linked like any other. Each input row gives a row, linked by its own text:
    rows that repeat a doc_id with other texts may be in other components. A
    row with a null doc_id gets the smallest known id of its component, null if
    there is none. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = near_links(classes)
    linked = materialize(classes.join(labels.withColumnRenamed("node", "fp"), "fp"))
    least = materialize(linked.groupBy("label").agg(F.min("least").alias("component_id")))
    named = linked.select("fp", "label").join(least, "label").select("fp", "component_id")
    named = materialize(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    release(classes, labels, linked, least)
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[tuple[int | None, str, int | None]]:
    """The same rows with plain Python, shingle by shingle and pair by pair (for tests)."""
    prints = []
    for _, text in docs:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        sums = [sum(xxhash.xxh64(g.encode(), seed=42).intdigest() >> b & 1 for g in grams) for b in range(64)]
        prints.append(sum(1 << b for b in range(64) if 2 * sums[b] > len(grams)))
    kinds = sorted(set(prints))
    group = {k: {k} for k in kinds}
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for k in group[b]:
                    group[k] = group[a]
    least = {k: min((d for (d, _), p in zip(docs, prints) if p in group[k] and d is not None), default=None) for k in kinds}
    return [(d, f"{p:016x}", least[p]) for (d, _), p in zip(docs, prints)]
