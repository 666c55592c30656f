"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library's trainer, one on windows
of toxic text, one on windows of ordinary text; both lie before one more that
is trained on ordinary text and gives the words that all text has. Every text
is cut into windows of a few words, and the difference of a window's two
compressed lengths tells which side it resembles. As most windows of a toxic
document are ordinary, the trainer gets passages that may tell the labels
apart, found in two ways: around words that are many times as frequent under
one label, and windows that common text does not explain, narrowed down in
rounds to those that the last dictionaries tell most toxic (on both sides, so
that the ordinary dictionary learns what is mistaken). Which two pairs of
dictionaries are used is decided on labelled documents.

The window differences of a document are summed up in a few numbers, and a
logistic curve over them, fitted on labelled documents and shifted so that the
best threshold lies at 0.7, is the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import held_out, materialize, release

WINDOW_WORDS = 5
LEVEL = 3
#: Distinct windows of each label that the dictionaries are trained on, about (spread by hash over all labelled rows), and their bytes at most.
TRAIN_WINDOWS = {0: 150_000, 1: 80_000}
TRAIN_BYTES = 400
#: Bytes of the common dictionary, and of each label's.
COMMON_BYTES, LABEL_BYTES = 112_640, (1024, 2048, 4096)
#: Trainer's segment and match length for the label's dictionaries: about two words, and a short word.
SEGMENT, MATCH = 24, 6
#: A word marks a label if it is in so many of its windows, and so many times as frequent as under the other.
LEAST_WINDOWS, RATIO = 8, 10
#: Share of the windows that the common dictionary compresses worst, which the first round is trained on; rounds; share of the windows that later rounds are trained on.
WORST_SHARE, ROUNDS, TELLING_SHARE = 0.2, 3, 0.1
#: Labels up to this number are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Labelled documents of each label that the round and the curve are fitted on, about.
FIT_DOCS = 2000
#: Where the calibrated threshold lies on the scale of scores.
THRESHOLD = 0.7
N_FEATURES = 8
#: Pairs of dictionaries that every text is measured with.
PAIRS = 2


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor that may refer to ``content``."""
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


@lru_cache(maxsize=(ROUNDS + 1) * len(LABEL_BYTES))
def compressors(ordinary: bytes, toxic: bytes):
    return compressor(ordinary).compress, compressor(toxic).compress


def windows(text: str) -> list[bytes]:
    """Runs of a few words, lower case, with blanks around them; the whole text."""
    ws = text.encode().lower().split()
    return [b" " + b" ".join(ws[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(ws), WINDOW_WORDS)]


def features(text: str, dictionaries: tuple[bytes, bytes]) -> list[float]:
    """Numbers that describe how a text's windows differ in compressed length."""
    ordinary, toxic = compressors(*dictionaries)
    d = [len(ordinary(w)) - len(toxic(w)) for w in windows(text)]
    if not d:
        return [0.0] * N_FEATURES
    n = len(d)
    top = sorted(d, reverse=True)[:5]
    over = [sum(x >= k for x in d) for k in (3, 4, 6)]
    return [min(top[0], 9) * 1.0, sum(min(x, 9) for x in top) / 5, *(k / n for k in over), math.log1p(over[0]), math.log1p(over[2]), math.log1p(n)]


def trained(windows: list[bytes], size: int, **options: int) -> bytes:
    """A dictionary of ``size`` bytes trained on ``windows``; of too few to train on, their last bytes."""
    try:
        return zstandard.train_dictionary(size, windows, **options).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[-size:]


def marked(sides: tuple[list[bytes], list[bytes]]) -> list[list[bytes]]:
    """The words that mark each label, every time with their neighbours."""
    counts = [Counter(u for w in ws for u in {*w.split()}) for ws in sides]
    out = []
    for ws, own, other in (*zip(sides, counts, counts[::-1]),):
        share = RATIO * len(ws) / max(1, len(sides[0]) + len(sides[1]) - len(ws))
        words = {u for u, n in own.items() if n >= LEAST_WINDOWS and n >= share * (other[u] + 0.5)}
        cut = ((w.split(), i) for w in ws for i, u in enumerate(w.split()) if u in words)
        out.append([b" " + b" ".join(x[max(0, i - 1) : i + 2]) + b" " for x, i in cut])
    return out


def train_dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The ordinary and the toxic dictionary of every size and choice of passages."""
    common = trained(ordinary, COMMON_BYTES)
    plain = compressor(common).compress
    sides = (ordinary, toxic)

    def worst(ws: list[bytes]) -> list[bytes]:
        """The windows that the common dictionary compresses worst for their length, as they come."""
        cost = np.array([len(plain(w)) / len(w) for w in ws])
        return [ws[i] for i in np.sort(np.argsort(-cost, kind="stable")[: max(1, int(WORST_SHARE * len(ws)))])] if ws else []

    def pair_of(passages: list[list[bytes]], size: int) -> tuple[bytes, bytes]:
        a, b = (trained(ws, size, k=SEGMENT, d=MATCH) + common for ws in passages)
        return a, b

    near, first = marked(sides), [worst(ws) for ws in sides]
    out = []
    for size in LABEL_BYTES:
        out.append(pair_of(near, size))
        chosen = first
        for _ in range(ROUNDS):
            out.append(pair_of(chosen, size))
            a, b = (compressor(d).compress for d in out[-1])
            gains = [np.array([len(a(w)) - len(b(w)) for w in ws]) for ws in sides]
            chosen = [[ws[i] for i in np.argsort(-gain, kind="stable")[: max(1, int(TELLING_SHARE * len(ws)))]] for ws, gain in zip(sides, gains)]
    return out


def sampled_windows(labelled: DataFrame) -> dict[int, list[bytes]]:
    """A bounded number of distinct windows of each label, spread by hash over all rows."""
    words = F.size(F.split("text", r"[\x20\x09-\x0D]+"))
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.sum(F.ceil(words / WINDOW_WORDS)).alias("n")).collect()}
    least = {k: min(1.0, TRAIN_WINDOWS.get(k, 0) / max(n, 1)) * (1 << 64) for k, n in counts.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(k, w) for k, text in zip(batch.column(0).to_pylist(), batch.column(1)) for w in windows(text.as_py()) if len(w) <= TRAIN_BYTES and xxhash.xxh64_intdigest(w) < least[k]}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([w for _, w in found], pa.binary())], names=["toxic", "w"])

    out: dict[int, list[bytes]] = {0: [], 1: []}
    for r in labelled.select("toxic", "text").mapInArrow(cut, "toxic int, w binary").distinct().collect():
        out.setdefault(r["toxic"], []).append(bytes(r["w"]))
    return {k: sorted(ws, key=xxhash.xxh64_intdigest) for k, ws in out.items()}


def area(score: np.ndarray, y: np.ndarray) -> float:
    """The share of (toxic, ordinary) pairs that a score puts in order, ties by half."""
    both = np.sort(score[y == 0])
    up = score[y == 1]
    return float((np.searchsorted(both, up, "left") + np.searchsorted(both, up, "right")).mean() / 2 / len(both)) if len(both) and len(up) else 0.5


def margins(x: np.ndarray, curve: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = curve
    return np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with a shift) of a logistic curve, its best threshold at THRESHOLD.

    With one label only there is nothing to learn, and the curve is flat.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for _ in range(25):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 1e-2 * np.eye(len(w))
            w -= np.linalg.solve(h, z.T @ (weight * (p - y)) + 1e-2 * w)
        margin = z @ w
        order = np.argsort(-margin, kind="stable")
        hits = np.cumsum(y[order])
        f = 2 * hits / (y.sum() + np.arange(1, len(y) + 1))
        best = int(np.argmax(f))
        after = margin[order[min(best + 1, len(y) - 1)]]
        w[-1] += math.log(THRESHOLD / (1 - THRESHOLD)) - (margin[order[best]] + after) / 2
    return mean, scale, w


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3) -> DataFrame:
    """doc_id, held_out, score and predicted per row of ``docs`` (doc_id, text).

    Learns from labelled documents outside the held-out fold. A null or empty
    text has no windows and gets the curve's value for that. If there is
    nothing to learn from (no labels, or one label only), every score is 0.5.
    Labels that are null count for nothing; ids with both labels count as both.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    marks = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    known = keyed.where(~held_out(F.col("doc_id"), modulus) & F.col("text").isNotNull()).join(marks, "doc_id")
    known = materialize(known.select("toxic", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("place")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = PAIRS * N_FEATURES
    flat = np.zeros(n), np.ones(n), np.zeros(n + 1)
    if len(counts) < 2:
        chosen, curve = [(b"", b"")] * PAIRS, flat
    else:
        sample = sampled_windows(known)
        pairs = train_dictionaries(sample[0], sample[1])
        dictionaries = spark.sparkContext.broadcast(pairs)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [[v for pair in dictionaries.value for v in features(t.as_py() or "", pair)] for t in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "place", "x"])

        # documents below a cut-off of their hash, so that no text leaves its task
        few = F.lit(False)
        for label, n in counts.items():
            few = few | ((F.col("toxic") == label) & (F.col("place") < int((1 << 40) * min(1.0, FIT_DOCS / n))))
        rows = known.where(few).repartition(32).select("toxic", "place", "text").mapInArrow(measure, "toxic int, place long, x array<double>").collect()
        rows.sort(key=lambda r: (r["place"], r["toxic"], r["x"]))
        x = np.array([r["x"] for r in rows]).reshape(len(rows), len(pairs), N_FEATURES)
        y = np.array([r["toxic"] for r in rows], float)
        half = np.arange(len(rows)) % 2 == 0
        used: list[int] = []
        for _ in range(PAIRS if half.any() else 0):
            joined = [x[:, [*used, k]].reshape(len(rows), -1) for k in range(len(pairs))]
            worth = [0.0 if k in used else sum(area(margins(z[~h], fit_curve(z[h], y[h])), y[~h]) for h in (half, ~half)) for k, z in enumerate(joined)]
            used.append(int(np.argmax(worth)))
        used = used or [0]
        chosen = [pairs[k] for k in used]
        z = x[:, used].reshape(len(rows), -1)
        curve = fit_curve(z, y) if len(rows) else flat
    release(known)
    shared = spark.sparkContext.broadcast((chosen, curve))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, curve = shared.value
        for batch in batches:
            x = np.array([[v for pair in pairs for v in features(t.as_py() or "", pair)] for t in batch.column(2)]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-margins(x, curve))), pa.float64())], names=["doc_id", "held_out", "score"])

    out = keyed.select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
