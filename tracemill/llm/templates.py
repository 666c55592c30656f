"""Line dedup with a fixed-depth template tree.

A line's place in the tree is its token count and its leading tokens; below
that leaf its tokens stand in up to eight segments. Tokens that hold a digit
are variable fields from the start. A segment that recurs in its leaf is a
constant of the template, any other segment is a variable field. Lines whose
template keeps at least half of its segments and recurs over documents that
are not copies of one another are dropped from all of them.

Copies are told apart by sketches (the smallest leaf of the document's other
lines, in three orders), so that a group of copies counts about once: whole
copies are left to near-dedup. The line under test has no part in them, and
the median of the three counts bears another recurring line that comes first.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import materialize, portions, release

DEPTH = 2
SEGMENTS = 8
#: Lines of fewer tokens are never dropped.
MIN_TOKENS = 4
#: Lines of so many tokens are long: they need fewer documents to count as recurring.
LONG_TOKENS = 10
MIN_DOCS_LONG, MIN_DOCS_SHORT = 3, 10
#: Distinct sketches in a hundred documents, at least: families of near copies have several, but few for their size.
MIN_SKETCH_PERCENT = 30
#: Recurring lines that are broadcast (8 bytes each), at most; more meet their documents in joins.
BROADCAST_VARIANTS = 4_000_000
#: Busy leaves that are broadcast (about 32 bytes each), at most; more meet the lines in a join.
BROADCAST_LEAVES = 2_000_000

# Odd factors that put leaves into independent orders.
ORDERS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

SKETCHES = [f"sketch{j}" for j in range(len(ORDERS))]
PLACES = [f"s{j}" for j in range(SEGMENTS)]
LINES = "doc_id long, text_hash long, leaf long, variant long, n_tokens int, lines array<int>, " + ", ".join([*(f"{c} int" for c in SKETCHES), *(f"{p} int" for p in PLACES)])
DIGIT = re.compile(rb"[0-9]")


def masked(token: bytes) -> bytes:
    """The token, or ``<*>`` if it holds a digit."""
    return b"<*>" if DIGIT.search(token) else token


def _hash(data: bytes) -> int:
    h = xxhash.xxh64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def masked_tokens(line: bytes) -> list[bytes]:
    """The tokens of a line, variable fields masked; none if they are too few."""
    tokens = line.split()
    if len(tokens) < MIN_TOKENS:
        return []
    return [*map(masked, tokens)] if DIGIT.search(line) else tokens


def variant_of(line: bytes) -> int | None:
    """The hash of a masked line; None if it has too few tokens."""
    tokens = masked_tokens(line)
    return _hash(b" ".join(tokens)) if tokens else None


def parse(text: str | None) -> dict[int, tuple[int, int, list[int], list[int]]]:
    """variant -> (leaf, n_tokens, line numbers, segments) of a text's lines with enough tokens."""
    out: dict[int, tuple[int, int, list[int], list[int]]] = {}
    for i, line in enumerate((text or "").encode().split(b"\n")):
        tokens = masked_tokens(line)
        n = len(tokens)
        if not n:
            continue
        variant = _hash(b" ".join(tokens))
        if variant in out:
            out[variant][2].append(i)
            continue
        k = min(SEGMENTS, n)
        cuts = [n * j // k for j in range(k + 1)]
        segments = [_hash(b" ".join(tokens[a:b])) >> 32 for a, b in zip(cuts, cuts[1:])]  # told apart within a leaf and place only
        out[variant] = (_hash(b"%d " % n + b" ".join(tokens[:DEPTH])), n, [i], segments)
    return out


def sketches_of(leaves: set[int]) -> dict[int, tuple[int, ...]]:
    """leaf -> the smallest other leaf of a document in every order (32 bits of it), 0 if there is none."""
    firsts = []
    for factor in ORDERS:
        keyed = sorted(((leaf * factor) & 0xFFFFFFFFFFFFFFFF, leaf) for leaf in leaves)[:2]
        firsts.append([((k >> 32) - (1 << 31), leaf) for k, leaf in keyed])
    return {leaf: tuple(next((k for k, other in first if other != leaf), 0) for first in firsts) for leaf in leaves}


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.int64()] * 4, pa.int32(), pa.list_(pa.int32()), *[pa.int32()] * len(ORDERS), *[pa.int32()] * SEGMENTS]
    names = ["doc_id", "text_hash", "leaf", "variant", "n_tokens", "lines", *SKETCHES, *PLACES]
    for batch in portions(batches):
        rows: list[tuple] = []
        for doc, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            found = parse(text.as_py())
            sketches = sketches_of({f[0] for f in found.values()})
            for variant, (leaf, n, lines, segments) in found.items():
                rows.append((doc, key, leaf, variant, n, lines, *sketches[leaf], *segments, *[None] * (SEGMENTS - len(segments))))
        cols = zip(*rows) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def least_docs():
    """How many documents a template must recur in, by its token count."""
    return F.when(F.col("n_tokens") >= LONG_TOKENS, MIN_DOCS_LONG).otherwise(MIN_DOCS_SHORT)


def busy_lines(lines: DataFrame, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """The lines whose leaf holds as many lines as a recurring template needs, as a written table.

    Most leaves hold a line or two, so only their counts are shuffled, summed
    up before. The busy leaves are broadcast up to a bound and joined by a
    shuffle beyond, where adaptive execution splits a hot leaf's lines.
    """
    busy = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.max("n_tokens").alias("n_tokens")).where(F.col("n") >= least_docs())
    busy = materialize(busy.select("leaf"))
    few = busy.count() <= broadcast_leaves
    found = materialize(lines.join(F.broadcast(busy) if few else busy, "leaf", "left_semi").select(*lines.columns))
    release(busy)
    return found


def recurring_variants(lines: DataFrame) -> DataFrame:
    """The variants (distinct masked lines) whose template recurs, of the lines of busy leaves.

    A line that a third of all documents share is one row after the first,
    map-side combined aggregation; copies are only counted where a template
    has enough constants.
    """
    variants = lines.groupBy("leaf", "variant").agg(F.count("*").alias("docs"), F.max("n_tokens").alias("n_tokens"), *(F.max(p).alias(p) for p in PLACES))
    variants = materialize(variants.select("leaf", "variant", "docs", "n_tokens", F.filter(F.array(*PLACES), lambda x: x.isNotNull()).alias("segments")))
    # constants: segments that recur at their place in the leaf
    places = variants.select("leaf", "variant", "n_tokens", "docs", F.size("segments").alias("k"), F.posexplode("segments").alias("place", "segment"))
    constant = places.groupBy("leaf", "place", "segment").agg(F.sum("docs").alias("n"), F.max("n_tokens").alias("n_tokens")).where(F.col("n") >= least_docs())
    constant = materialize(constant.select("leaf", "place", "segment"))
    kept = places.join(constant, ["leaf", "place", "segment"])
    template = kept.groupBy("leaf", "variant").agg(F.max("k").alias("k"), F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("place", "segment"))).alias("constants"))
    template = template.where(F.size("constants") * 2 >= F.col("k")).select("variant", "n_tokens", F.xxhash64("leaf", "constants").alias("template"))
    template = materialize(template)
    release(variants, constant)
    # a template's documents and copy groups over all its variants
    spread = lines.select("variant", *SKETCHES).join(template, "variant")
    spread = spread.groupBy("template", *SKETCHES).agg(F.count("*").alias("docs"), F.max("n_tokens").alias("n_tokens"))
    spread = spread.select("template", F.posexplode(F.array(*SKETCHES)).alias("order", "sketch"), "docs", "n_tokens")
    spread = spread.groupBy("template", "order", "sketch").agg(F.sum("docs").alias("docs"), F.max("n_tokens").alias("n_tokens"))
    total = spread.groupBy("template", "order").agg(F.sum("docs").alias("docs"), F.count("*").alias("groups"), F.max("n_tokens").alias("n_tokens"))
    total = total.groupBy("template").agg(F.max("docs").alias("docs"), F.sort_array(F.collect_list("groups"))[len(ORDERS) // 2].alias("groups"), F.max("n_tokens").alias("n_tokens"))
    recurring = total.where((F.col("groups") >= least_docs()) & (F.col("groups") * 100 >= F.col("docs") * MIN_SKETCH_PERCENT)).select("template")
    found = materialize(template.join(recurring, "template", "left_semi").select("variant"))
    release(template)
    return found


def dropped_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, lines) for the documents that lose lines, as a written table; lines count from 0."""
    hit = lines.select("doc_id", "text_hash", "variant", "lines").join(found, "variant")
    return materialize(hit.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("lines")).alias("lines")))


def without(text: str, bad: np.ndarray) -> str:
    """A text without the lines whose variants are in ``bad``, which is sorted."""
    lines = text.split("\n")
    hashes = np.fromiter((variant_of(line.encode()) or 0 for line in lines), np.int64, len(lines))
    gone = bad[np.minimum(np.searchsorted(bad, hashes), len(bad) - 1)] == hashes
    return "\n".join(line for line, out in zip(lines, gone) if not out) if gone.any() else text


def drop_in_place(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the recurring lines, which are looked up while the texts are read: documents are not shuffled."""
    bad = np.sort(np.array([r["variant"] for r in found.collect()], np.int64))
    if not len(bad):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            names, cols = batch.schema.names, [*batch.columns]
            at = names.index("text")
            old = cols[at].to_pylist()
            new = [t and without(t, shared.value) for t in old]
            cols[at] = pa.array(new, cols[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([n if a is b or a == b else len(b) for n, a, b in zip(cols[k].to_pylist(), old, new)]).cast(cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join(fields))


def dedup_lines(docs: DataFrame, broadcast_variants: int = BROADCAST_VARIANTS, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """``docs`` with recurring template lines taken out of ``text``; same columns, same rows.

    A document that loses lines also gets its ``n_chars``, if there is such a
    column, set to the new length. Null and empty texts stay as they are; a
    document that holds nothing but recurring lines keeps its row with an empty
    text. Rows that repeat are treated alike; a null doc_id is an id of its own.
    """
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    every = materialize(keyed.mapInArrow(_lines, LINES))
    lines = busy_lines(every, broadcast_leaves)
    release(every)
    found = recurring_variants(lines)
    if found.count() <= broadcast_variants:
        out = drop_in_place(docs, found)
        release(lines, found)
        return out
    lost = dropped_lines(lines, found)
    release(lines, found)
    lost = lost.toDF("_tm_id", "_tm_text", "_tm_lines")
    on = docs["doc_id"].cast("long").eqNullSafe(lost["_tm_id"]) & (F.xxhash64(docs["text"]) == lost["_tm_text"])
    out = docs.join(lost, on, "left")
    rest = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_tm_lines", i))
    out = out.withColumn("text", F.when(F.col("_tm_lines").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_tm_lines").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and text_sha256 (of what remains) per row of ``docs``.

    A null text has no lines and counts as empty.
    """
    base = docs.select("doc_id", "text")
    out = dedup_lines(base.withColumn("_tm_old", F.col("text")))
    count = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).otherwise(F.size(F.split(c, "\n", -1))).cast("long")
    out = out.select("doc_id", count(F.col("_tm_old")).alias("n_lines"), count(F.col("text")).alias("left_n"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.col("left_n")).alias("n_dropped"), "text_sha256")


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, str | None]:
    """What dedup_lines leaves of each text, by plain dictionaries (for tests)."""
    rows = {d: parse(t) for d, t in docs}
    docs_of, spread, shape = defaultdict(set), defaultdict(lambda: [defaultdict(int) for _ in ORDERS]), {}
    for d, found in rows.items():
        for v, (leaf, n, _, segments) in found.items():
            docs_of[v].add(d)
            shape[v] = leaf, n, segments

    def need(n: int) -> int:
        return MIN_DOCS_LONG if n >= LONG_TOKENS else MIN_DOCS_SHORT

    times = defaultdict(int)
    for v, (leaf, _, segments) in shape.items():
        for place in enumerate(segments):
            times[leaf, place] += len(docs_of[v])
    sketches = {d: sketches_of({f[0] for f in found.values()}) for d, found in rows.items()}
    template = {}
    for v, (leaf, n, segments) in shape.items():
        constants = tuple(p for p in enumerate(segments) if times[leaf, p] >= need(n))
        if constants and 2 * len(constants) >= len(segments):
            template[v] = leaf, constants
            for d in docs_of[v]:
                for counts, sketch in zip(spread[leaf, constants], sketches[d][leaf]):
                    counts[sketch] += 1
    groups = {t: sorted(map(len, counts))[len(ORDERS) // 2] for t, counts in spread.items()}
    good = {v for v, t in template.items() if groups[t] >= need(shape[v][1]) and 100 * groups[t] >= MIN_SKETCH_PERCENT * sum(spread[t][0].values())}
    out = {}
    for d, t in docs:
        bad = {i for v, found in rows[d].items() if v in good for i in found[2]}
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in bad) if bad else t
    return out
