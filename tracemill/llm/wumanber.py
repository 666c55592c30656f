"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of 13 consecutive words of the benchmark items (an
item with fewer words is one shorter window). Patterns of one length form a
group with a shift table over blocks of two words: a block that no pattern
holds lets the scan jump over the rest of a window, so most words of a
document are never looked at. Where the shift is zero, a bucket keyed by the
hash of the window's last words gives the few patterns to test, and words are
compared directly.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import free_prefix, materialize, portions, release

WINDOW = 13
#: Benchmark characters that one set of shift tables may hold; beyond it the benchmark is searched in several blocks.
BLOCK_CHARS = 8_000_000

#: Bytes that are no part of a word: ASCII but letters and digits.
GAPS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became lower case."""
    return text.encode().lower().translate(GAPS).split()


class WuManber:
    """Patterns of one length (in words) with their shift table and buckets."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        self.m = len(next(iter(patterns)))
        self.block = min(2, self.m)
        self.far = self.m - self.block + 1
        self.shift: dict[object, int] = {}
        self.buckets: dict[int, list[tuple[list[bytes], list[int]]]] = defaultdict(list)
        for p, owners in patterns.items():
            for end in range(self.block, self.m + 1):
                key = p[end - 1] if self.block == 1 else (p[end - 2], p[end - 1])
                self.shift[key] = min(self.shift.get(key, self.far), self.m - end)
            self.buckets[hash(p[-3:])].append(([*p], owners))

    def find(self, ws: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence in ``ws``."""
        m, n, far = self.m, len(ws), self.far
        shift, buckets, single = self.shift.get, self.buckets.get, self.block == 1
        at = m - 1
        while at < n:
            step = shift(ws[at] if single else (ws[at - 1], ws[at]), far)
            if step:
                at += step
                continue
            start = at - m + 1
            bucket = buckets(hash(tuple(ws[max(start, at - 2) : at + 1])))
            if bucket:
                window = ws[start : at + 1]
                for pattern, owners in bucket:
                    if pattern == window:
                        yield start, owners
            at += 1


def tables(items: list[tuple[int, str]]) -> list[WuManber]:
    """One search table per window length over (item_id, text) rows."""
    groups: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        ws = words(text or "")
        m = min(WINDOW, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            owners = groups[m][tuple(ws[i : i + m])]
            if item not in owners:
                owners.append(item)
    return [WuManber(g) for _, g in sorted(groups.items())]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches [start, end) in order, those that touch made one."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(merged[-1][1], b)
        else:
            merged.append((a, b))
    return merged


def scan(ws: list[bytes], found: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Covered stretches [start, end) in order, merged, and the items that occur."""
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    for t in found:
        for start, owners in t.find(ws):
            spans.append((start, start + t.m))
            items.update(owners)
    return united(spans), items


#: What a search adds to a row: covered stretches in word positions (merged, in order) and the items that occur.
FOUND = [("_w_words", pa.int64(), "long"), ("_w_starts", pa.list_(pa.int32()), "array<int>"), ("_w_ends", pa.list_(pa.int32()), "array<int>"), ("_w_items", pa.list_(pa.int64()), "array<long>")]


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in blocks of a bounded number of characters.

    Blocks are dealt by a hash of the row, and only one is on the driver at a
    time. One aggregate gives the size first; a usual benchmark is one block.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block_chars) if size else 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def occurrences(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, only_good: bool = False) -> DataFrame:
    """The rows of ``docs`` with the columns of FOUND (under more underscores where ``docs`` has such names); with ``only_good``, those that are not contaminated, without them.

    A null or empty text has no words. If the benchmark needs several blocks,
    every row is searched for one block after the other and keeps what was
    found so far, so that a row in is a row out at every size; the rows are
    written between two blocks, and a worker holds one block's tables.
    """
    spark = docs.sparkSession
    names, kinds, types = zip(*FOUND)
    more = free_prefix(docs.columns, "_w_")
    names = [more + n.removeprefix("_w_") for n in names]
    before: DataFrame | None = None
    out = docs
    blocks = item_blocks(benchmark, block_chars)
    block = next(blocks)
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        block = next(blocks, None)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, good=only_good and block is None) -> Iterator[pa.RecordBatch]:
            found = tables(shared.value)
            for batch in portions(batches):
                at = batch.schema.names.index("text")
                known = [batch.column(batch.schema.names.index(n)).to_pylist() for n in names[1:]] if names[0] in batch.schema.names else None
                cols: list[list] = [[], [], [], []]
                for i, text in enumerate(batch.column(at)):
                    ws = words(text.as_py() or "")
                    spans, hit = scan(ws, found)
                    if known:
                        spans, hit = united([*spans, *zip(known[0][i], known[1][i])]), hit | {*known[2][i]}
                    for c, v in zip(cols, (len(ws), [a for a, _ in spans], [b for _, b in spans], sorted(hit))):
                        c.append(v)
                keep = [n for n in batch.schema.names if n not in names]
                rows = batch.select(keep)
                if good:
                    hit_words = (sum(b) - sum(a) for a, b in zip(cols[1], cols[2]))
                    yield rows.filter(pa.array([not (h and h * 20 >= n) for h, n in zip(hit_words, cols[0])], pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, cols, kinds)], names=[*keep, *names])

        fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema]
        if not (only_good and block is None):
            fields += [f"{n} {t}" for n, t in zip(names, types)]
        out = out.mapInArrow(run, ", ".join(fields))
        if block is not None:
            out = materialize(out)
            if before is not None:
                release(before)
            before = out
    return out


def is_contaminated(n_words, n_hit):
    """Whether hit words are at least a twentieth of a document's words."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words and are never contaminated; an empty benchmark
    hits nothing; benchmark rows with a null id or text are left out; other
    columns of both tables are ignored. Rows that repeat, or have a null id,
    give a row each.
    """
    found = occurrences(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), benchmark, block_chars)
    hit = F.aggregate(F.zip_with("_w_starts", "_w_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    ids = F.array_join(F.array_sort(F.transform("_w_items", lambda x: x.cast("string"))), ",")
    out = found.select("doc_id", F.col("_w_words").alias("n_words"), hit.alias("n_hit"), F.size("_w_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return out.withColumn("contaminated", is_contaminated(F.col("n_words"), F.col("n_hit")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns.

    Every row gets its own verdict while it is read, without a join. Rows with
    null or empty texts stay; so do all rows if the benchmark is empty.
    """
    return occurrences(docs, benchmark, block_chars, only_good=True)


def brute_force(docs: list[tuple[int, str | None]], benchmark: list[tuple[int, str]]) -> list[tuple]:
    """The same rows by comparing every window with every position (for tests)."""
    out = []
    for doc, text in docs:
        ws = words(text or "")
        hit, items = set(), set()
        for item, other in benchmark:
            p = words(other or "")
            m = min(WINDOW, len(p))
            for i in range(len(p) - m + 1 if m else 0):
                for j in range(len(ws) - m + 1):
                    if ws[j : j + m] == p[i : i + m]:
                        hit.update(range(j, j + m))
                        items.add(item)
        sha = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(ws)))
    return out
