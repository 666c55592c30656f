"""MinHash near-duplicate search with sequential Bayesian verification.

1. Every text becomes its set of five-word shingles, as 64-bit hashes. Texts
   with the same set collapse into one representative at once, so that a group
   of exact copies of any size costs one row from there on.
2. Representatives get a MinHash signature; bands of it are bucket keys.
3. Candidates are compared signature batch by signature batch. After each
   batch the posterior of the similarity (uniform prior, binomial matches)
   tells how likely 0.75 still is; a pair below the chosen miss probability is
   pruned. Survivors are verified on their full sets.
4. Buckets are first linked star by star: each text meets one centre, at first
   the text with the most bucket neighbours (the original of a group of edited
   copies), then a pseudo-random one, so a large group of near copies takes
   linear work a round. Rounds go on until few pairs are open. What the stars
   leave open is compared in full: all pairs of texts that share a bucket and
   still belong to different components. Large buckets are compared block by
   block, full sets included, and a pair of blocks gives a spanning forest of
   its verified links: fewer rows than texts, however many pairs there are. No
   candidate pair is left out, only pairs whose texts are known to be connected
   already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import HashCache, materialize, portions, release

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 40, 5
#: Chance that verification may prune a pair whose posterior still reaches the threshold.
MISS = 1e-6
#: Positions of the verification signature (one byte each), and those compared between two looks at the posterior.
CHECKS, BATCH = 512, 64
#: Buckets up to this size give their open pairs as rows; larger ones are compared in blocks, of which only verified links leave.
SMALL = 24
#: Texts, and shingles, of a block on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Star rounds at most. They end as soon as the pairs still open are at most OPEN_PAIRS times the bucket rows, or hardly shrink any more.
#: After the first round, pairs of large buckets may be as many as make a block a text on average: blocks compare them for less than a round costs.
STAR_ROUNDS, OPEN_PAIRS, BLOCK_PAIRS = 3, 2, BLOCK // 2

#: The pool of blocks for texts of small components.
NO_LABEL = -(1 << 63) + 1

_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of a hash family."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64-bit numbers (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, cache: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles (see op4's contract)."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    k = min(SHINGLE, n)
    h = w[: n - k + 1].copy()
    for i in range(1, k):
        h *= _MIX
        h += mixed(w[i : n - k + 1 + i])
    if k < SHINGLE:  # a short sequence is no shingle of a longer text
        h += np.uint64(k)
    return np.unique(mixed(h))


def signature(h: np.ndarray, n: int = BANDS * ROWS, seed: int = 20240229) -> np.ndarray:
    """Minimum of every permutation's upper 32 bits over a non-empty set."""
    a, b = permutations(n, seed)
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(h), 2048):
        part = h[i : i + 2048, None] * a
        part += b
        part >>= np.uint64(32)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different bands kept apart."""
    rows = sig.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for i in range(ROWS):
        h = mixed(h ^ rows[:, i]) * _MIX
    return h.view(np.int64)


def check_signature(h: np.ndarray) -> bytes:
    """A signature of its own for verification, one byte per permutation.

    Different minima agree in their byte once in 256 times, which raises the
    matches a little: no pair is pruned for it.
    """
    low = signature(h, CHECKS, 20240301) * _MIX
    return (low >> np.uint64(56)).astype(np.uint8).tobytes()


SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = HashCache()
    for batch in portions(batches):
        n, f1, f2, bands = [], [], [], []
        for text in batch.column(1):
            h = shingles(text.as_py(), cache)
            n.append(len(h))
            if len(h):
                f1.append(int(np.bitwise_xor.reduce(h).view(np.int64)))
                f2.append(int(mixed(h ^ _MIX).sum(dtype=np.uint64).view(np.int64)))
                bands.append(band_keys(signature(h)))
            else:
                for x in (f1, f2, bands):
                    x.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "f1", "f2", "bands"],
        )


SETS = "rep long, n long, shingles array<long>, sig binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = HashCache()
    for batch in portions(batches):
        sets = [shingles(text.as_py(), cache) for text in batch.column(1)]
        full = [i for i, h in enumerate(sets) if len(h)]
        sets = [sets[i] for i in full]
        rep = batch.column(0).take(pa.array(full, pa.int64()))
        flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([rep, pa.array([*map(len, sets)], pa.int64()), lists, pa.array([*map(check_signature, sets)], pa.binary())], names=["rep", "n", "shingles", "sig"])


@lru_cache(maxsize=4)
def least_matches(percent: int = PERCENT, miss: float = MISS, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """(positions compared, fewest matches to go on) at each look.

    With a uniform prior, m matches in n positions make the similarity
    Beta(m+1, n-m+1), and P(similarity >= t) is P(Binomial(n+1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(batch, CHECKS + 1, batch):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def survivors(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, done: int = 0) -> np.ndarray:
    """Places of the pairs (x[a], y[b]) of signatures that every look from ``done`` positions on lets through."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    at = 0
    for n, least in least_matches():
        for i in range(0, len(alive), 8192):
            k = alive[i : i + 8192]
            matches[k] += np.count_nonzero(x[a[k], at:n] == y[b[k], at:n], axis=1)
        at = n
        if n > done:
            alive = alive[matches[alive] >= least]
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CHECKS)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            every = np.arange(batch.num_rows)
            alive = pa.array(survivors(_signatures(batch.column(2)), _signatures(batch.column(3)), every, every))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], names=["a", "b"])


def bayes_filter(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) that sequential verification over signatures lets through."""
    left = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("x"))
    right = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_pairs, "a long, b long")


def _forest(rows: pa.Table) -> pa.Table:
    """Verified links between two blocks of one bucket (or in one block) that join different components.

    At most as many links as components less one: a link inside what earlier
    links of the task have joined is not looked for.
    """
    rep, label, pool, at = (rows.column(c).to_numpy() for c in ("rep", "label", "pool", "i"))
    p, i, q, j = (rows.column(c)[0].as_py() for c in ("p1", "i1", "p2", "i2"))
    same = (p, i) == (q, j)
    first, second = np.flatnonzero((pool == p) & (at == i)), np.flatnonzero((pool == q) & (at == j))
    sig = _signatures(rows.column("sig"))
    sets = rows.column("shingles").combine_chunks()
    off = sets.offsets.to_numpy().astype(np.int64)
    off -= off[0]
    size = np.diff(off)
    local: np.ndarray | None = None
    component = np.unique(label, return_inverse=True)[1]
    looks = least_matches()
    n0, least0 = looks[0]
    links: list[tuple[int, int]] = []
    for k in range(0, len(first), 32):
        part = first[k : k + 32]
        near = np.count_nonzero(sig[part, None, :n0] == sig[None, second, :n0], axis=2) >= least0
        near &= np.minimum(size[part, None], size[None, second]) * 100 >= np.maximum(size[part, None], size[None, second]) * PERCENT
        if same:
            near &= part[:, None] < second[None, :]
        for a, row in zip(part, near):
            b = second[row & (component[second] != component[a])]
            if not len(b):
                continue
            b = b[survivors(sig, sig, np.full(len(b), a), b, n0)]
            if not len(b):
                continue
            if local is None:  # shingles numbered within the task
                values, local = np.unique(sets.flatten().to_numpy(), return_inverse=True)
                marked = np.zeros(len(values), bool)
            mine = local[off[a] : off[a + 1]]
            marked[mine] = True
            starts = np.r_[0, np.cumsum(size[b])[:-1]]
            both = np.add.reduceat(marked[np.concatenate([local[off[x] : off[x + 1]] for x in b])], starts, dtype=np.int64)
            marked[mine] = False
            b = b[both * 100 >= (size[a] + size[b] - both) * PERCENT]
            found, where = np.unique(component[b], return_index=True)
            links += [(rep[a], rep[x]) for x in b[where]]
            component[np.isin(component, found)] = component[a]
    ends = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(ends.max(1) if len(ends) else ends[:, 0]), "b": pa.array(ends.min(1) if len(ends) else ends[:, 1])})


def block_links(labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """A spanning forest of the links across components for every two blocks of each bucket of ``labelled``.

    Texts of a bucket are dealt into blocks by hash, those of a large component
    into blocks of its own, which need not meet one another. A task gets two
    blocks with their signatures and full sets, so no group is unbounded and no
    pair is a row unless it is a link.
    """
    rows = labelled.join(sets.select("rep", "n"), "rep")
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("texts"), F.sum("n").alias("weight"))
    large = (F.col("texts") >= BLOCK) | (F.col("weight") >= BLOCK_SHINGLES)
    by_label = materialize(by_label.withColumn("pool", F.when(large, F.col("label")).otherwise(F.lit(NO_LABEL))))
    pools = by_label.groupBy("key", "pool").agg(F.sum("texts").alias("texts"), F.sum("weight").alias("weight"))
    blocks = F.ceil(F.greatest(F.col("texts") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    pools = materialize(pools.select("key", "pool", blocks.alias("blocks")))
    every = pools.select("key", "pool", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    x, y = every.toDF("key", "p1", "i1"), every.toDF("key", "p2", "i2")
    meet = x.join(y, "key").where("(p1 < p2 or (p1 = p2 and i1 <= i2)) and (p1 <> p2 or p1 = %d)" % NO_LABEL)
    meet = materialize(meet)
    sides = meet.select("*", F.explode(F.array_distinct(F.array(F.struct(F.col("p1").alias("pool"), F.col("i1").alias("i")), F.struct(F.col("p2").alias("pool"), F.col("i2").alias("i"))))).alias("side")).select("key", "p1", "i1", "p2", "i2", "side.*")
    dealt = labelled.join(by_label.select("key", "label", "pool"), ["key", "label"]).join(pools, ["key", "pool"])
    dealt = dealt.select("key", "pool", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("i"), "rep", "label")
    dealt = materialize(dealt.join(sides, ["key", "pool", "i"]))
    groups = dealt.join(sets.select("rep", "shingles", "sig"), "rep").groupBy("key", "p1", "i1", "p2", "i2")
    found = materialize(groups.applyInArrow(_forest, "a long, b long").distinct())
    release(by_label, pools, meet, dealt)
    return found


def exact_filter(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= union * PERCENT).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the smallest node reachable.

    Alternates large and small stars until every component is one star; rounds
    grow with the logarithm of a component's size. Every table of a round is
    written to the shared folder, and minima are written before they are joined,
    so that a join on a hot node has two exchanges and can be split. The result
    is a written table, too.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not are_stars(now):
        both = now.union(now.select("b", "a"))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")))
        down = materialize(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = materialize(down.groupBy("a").agg(F.min("b").alias("m")))
        new = materialize(down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct())
        release(now, low, down, least)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def are_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b), a > b, give each ``a`` one ``b`` that is no ``a`` itself: then ``b`` is the smallest node of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    seen = ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least"))
    return seen.where("n > 1 or (n = 1 and least = 0)").limit(1).count() == 0


def with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket members with the label of their component so far (their own id, if they have no link)."""
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))


def bucket_sizes(labelled: DataFrame) -> DataFrame:
    """(key, n, open) of the buckets that hold more than one component: texts, and pairs across components, counted without forming them."""
    n = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    both = n.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.sum(F.col("n").cast("decimal(19,0)") * F.col("n")).alias("q"))
    pairs = (F.col("n").cast("decimal(19,0)") * F.col("n") - F.col("q")).cast("decimal(38,0)")
    return materialize(both.where("labels > 1").select("key", "n", (pairs / 2).cast("decimal(38,0)").alias("open")))


def count_open(buckets: DataFrame) -> tuple[int, int, int]:
    """(texts, open pairs of small buckets, open pairs of large ones) of ``bucket_sizes``, a text counted once per bucket."""
    r = buckets.agg(F.sum("n"), *(F.sum(F.when(c, F.col("open"))) for c in (F.col("n") <= SMALL, F.col("n") > SMALL))).first()
    return int(r[0] or 0), int(r[1] or 0), int(r[2] or 0)


def neighbours(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """(rep, met): the bucket neighbours of every text, counted once per shared bucket."""
    return members.join(buckets.select("key", "n"), "key").groupBy("rep").agg(F.sum("n").alias("met"))


def star_pairs(labelled: DataFrame, buckets: DataFrame, round_: int) -> DataFrame:
    """At most one pair per text: the centre that it meets in most of its open buckets.

    A bucket's centre is its text with the most neighbours in the first round,
    and pseudo-random by bucket and round in later ones.
    """
    order = F.xxhash64("key", "rep", F.lit(round_))
    if not round_:
        labelled = labelled.join(materialize(neighbours(labelled, buckets)), "rep")
        order = F.struct(-F.col("met"), F.col("rep"))
    centre = labelled.groupBy("key").agg(F.min_by(F.struct("rep", "label"), order).alias("c"))
    centre = materialize(centre.select("key", "c.*").toDF("key", "centre", "centre_label"))
    met = labelled.join(centre, "key").where("label <> centre_label").groupBy("rep", "centre").agg(F.count("*").alias("n"))
    best = met.groupBy("rep").agg(F.max_by("centre", F.struct("n", F.xxhash64("rep", "centre"))).alias("centre"))
    return best.select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()


def open_pairs(labelled: DataFrame) -> DataFrame:
    """Every pair of texts that share a bucket and belong to different components.

    Pairs of components are formed first, then their members: texts of one
    component in a bucket are never paired with each other.
    """
    kinds = labelled.select("key", "label").distinct()
    x = kinds.select("key", F.col("label").alias("la"))
    y = kinds.select("key", F.col("label").alias("lb"))
    both = materialize(x.join(y, "key").where("la < lb"))
    left = labelled.select("key", F.col("label").alias("la"), F.col("rep").alias("p"))
    right = labelled.select("key", F.col("label").alias("lb"), F.col("rep").alias("q"))
    pairs = both.join(left, ["key", "la"]).join(right, ["key", "lb"])
    return pairs.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()


def grouped(docs: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """The rows of ``near_duplicates``, and the scratch tables that they are still read from."""
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    sketch = materialize(keyed.mapInArrow(_sketch, SKETCH))
    full = sketch.where("f1 is not null and doc_id is not null")
    same = ["f1", "f2", "n_shingles"]

    # one representative per distinct set; map-side combined, whatever the group's size
    classes = materialize(full.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    reps = full.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *same], "left_semi")
    reps = materialize(reps.select(F.col("doc_id").alias("rep"), "bands"))
    keys = materialize(sketch.select("doc_id", *same))
    release(sketch)
    full = keys.where("f1 is not null and doc_id is not null")

    buckets = reps.select(F.explode("bands").alias("key"), "rep")
    shared = materialize(buckets.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key"))
    members = materialize(buckets.join(shared, "key"))
    met = materialize(members.select(F.col("rep").alias("doc_id")).distinct())
    release(reps, shared)
    sets = materialize(keyed.join(met, "doc_id", "left_semi").mapInArrow(_sets, SETS))
    release(met)
    sigs = sets.select("rep", "sig")

    labels = left = None
    labelled = members.withColumn("label", F.col("rep"))
    for round_ in range(STAR_ROUNDS + 1):
        buckets = bucket_sizes(labelled)
        if labels is not None:  # a bucket of one component stays so: later rounds look at the open ones only
            every, labelled = labelled, materialize(labelled.join(buckets.select("key"), "key", "left_semi"))
            release(every)
        rows, few, many = count_open(buckets)
        n_open = few + many
        last = round_ == STAR_ROUNDS or n_open <= OPEN_PAIRS * rows or (left is not None and n_open > 0.9 * left)
        last = last or (round_ > 0 and few <= OPEN_PAIRS * rows and many <= BLOCK_PAIRS * rows)
        left = n_open
        if last:
            small = labelled.join(buckets.where(F.col("n") <= SMALL).select("key"), "key", "left_semi")
            close = materialize(bayes_filter(open_pairs(small), sigs))
            found = exact_filter(close, sets)
            if many:
                large = labelled.join(buckets.where(F.col("n") > SMALL).select("key"), "key", "left_semi")
                found = found.union(block_links(large, sets))
        else:
            close = materialize(bayes_filter(star_pairs(labelled, buckets, round_), sigs))
            found = exact_filter(close, sets)
        # components so far are stars; only they and the new links count
        links = found if labels is None else found.union(labels.select("node", "label"))
        now = components(links)
        release(buckets, close)
        if labels is not None:
            release(labels)
        labels = now
        if last:
            break
        every, labelled = labelled, materialize(with_labels(labelled.select("key", "rep"), labels))
        release(every)
    release(labelled, sets)

    out = full.select("doc_id", *same).join(classes, same)
    out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    rest = keys.where("f1 is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), (keys, classes, labels)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept per row of ``docs`` (doc_id, text).

    Texts of fewer than five words are one shingle, null and empty texts have
    none and are linked with nothing. A doc_id names one document: if rows
    repeat it with other texts, a link of any of them links the document. A row
    with a null doc_id is linked with nothing: its component_id is null and it
    is kept. Each input row gives a row; other columns are ignored.
    """
    return grouped(docs)[0]


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group, with their own columns.

    Rows with a null id, and texts without words, are linked with nothing and
    stay; rows that repeat an id stay or go together.
    """
    found, scratch = grouped(docs)
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias("_tm_id")).distinct())
    release(*scratch)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_tm_id"], "left_anti")


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int, bool]]:
    """The same rows by comparing all sets of word tuples (for tests)."""
    sets: dict[int, set] = {}
    for doc, text in docs:
        w = (text or "").encode().lower().split()
        k = min(SHINGLE, len(w))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= PERCENT * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [(d, len(sets[d]), find(d), find(d) == d) for d in ids]
