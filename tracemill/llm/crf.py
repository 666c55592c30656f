"""Language identification with a linear-chain conditional random field.

Every word of a text gets a language label. Words are described by affixes,
character n-grams and lexicon entries, hashed into one weight table; learned
transitions tie neighbouring words together. Forward-backward gives each
word's label probabilities in code-switched text, and their mean gives the
document's language. The field is trained on chains that are stitched together
from stretches of documents of known languages.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import held_out

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
ASCII_WORDS = re.compile(r"[a-z]+").findall
BUCKETS = 1 << 16
#: Labelled documents per language that the field is trained on, at most.
SAMPLE_DOCS = 200
#: Frequent words per language that make up the lexicon.
LEXICON = 300
#: Training chains at least, and for each language at least.
CHAINS, LANG_CHAINS = 2400, 600
CHAIN_WORDS, EPOCHS, BATCH_CHAINS, RATE = 48, 3, 64, 0.3
#: Words whose emissions a Python worker remembers; words per group of documents that are labelled together; characters cut into words at a time.
CACHE_WORDS, GROUP_WORDS, CHUNK_CHARS = 200_000, 100_000, 1_500_000

# Odd factors of the feature hash, and marks that keep kinds of features apart.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BIAS, PREFIX, SUFFIX, BIGRAM, TRIGRAM, ENTRY = range(6)


def cut(text: str) -> list[str]:
    """The words of a text in lower case: a letter, then letters and marks."""
    low = text.lower()
    return ASCII_WORDS(low) if low.isascii() else WORDS(low)


def buckets(h: np.ndarray, kind: int, length: int = 0) -> np.ndarray:
    """Places in the weight table of hashed features."""
    h = (h + np.uint64((kind * 16 + length + 1) * int(FACTOR) & 0xFFFFFFFFFFFFFFFF)) * MIX
    return ((h ^ (h >> np.uint64(29))) * FACTOR >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def features(words: list[str], lexicon: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, ascending; feature places) by kind of feature, for all ``words`` at once.

    Kinds: one for every word, prefixes of 1-3 and suffixes of 1-4 characters,
    bigrams, trigrams, and the word itself if the lexicon has it. Hashes run
    over the code points of all words in one array.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    every = np.arange(len(words))
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.cumsum(n) - n
    yield every, np.full(len(words), buckets(np.zeros(1, np.uint64), BIAS)[0])
    h = np.zeros(len(words), np.uint64)
    for k in (1, 2, 3):
        has = every[n >= k]
        h[has] = (h[has] + c[first[has] + k - 1]) * FACTOR
        yield has, buckets(h[has], PREFIX, k)
    h = np.zeros(len(words), np.uint64)
    for k in (1, 2, 3, 4):
        has = every[n >= k]
        h[has] = (h[has] + c[first[has] + n[has] - k]) * FACTOR
        yield has, buckets(h[has], SUFFIX, k)
    owner = np.repeat(every, n)
    left = np.repeat(first + n, n) - np.arange(len(c))  # characters from here to the word's end
    two = np.flatnonzero(left >= 2)
    pair = (c[two] * FACTOR + c[two + 1]) * FACTOR
    yield owner[two], buckets(pair, BIGRAM)
    longer = left[two] >= 3
    three = two[longer]
    yield owner[three], buckets((pair[longer] + c[three + 2]) * FACTOR, TRIGRAM)
    entry = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    yield every[entry >= 0], buckets(entry[entry >= 0].astype(np.uint64), ENTRY)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, filtered: list | None = None) -> np.ndarray:
    """Label probabilities (T, B, L) of B chains, longest first.

    emit: potentials (T, B, L), not negative; start (L) and move (L, L) too.
    ``filtered``, if given, gets the forward probabilities.
    """
    t_max, b, n = emit.shape
    alpha = np.zeros((t_max, b, n))
    alive = np.searchsorted(-lengths, -np.arange(t_max), side="left")  # chains longer than t
    a = start * emit[0]
    alpha[0] = a / a.sum(1, keepdims=True)
    for t in range(1, t_max):
        k = alive[t]
        a = (alpha[t - 1, :k] @ move) * emit[t, :k]
        alpha[t, :k] = a / a.sum(1, keepdims=True)
    if filtered is not None:
        filtered.append(alpha.copy())
    beta = np.ones((b, n))
    back = move.T
    for t in range(t_max - 2, -1, -1):
        k = alive[t + 1]
        x = (beta[:k] * emit[t + 1, :k]) @ back
        beta[:k] = x / x.sum(1, keepdims=True)
        alpha[t, :k] *= beta[:k]
        alpha[t, :k] /= alpha[t, :k].sum(1, keepdims=True)
    return alpha


class Field:
    """The weights: one row of label weights per feature bucket, start and transitions."""

    def __init__(self, langs: list[str], lexicon: list[str]):
        self.langs, self.lexicon = langs, {w: i for i, w in enumerate(lexicon)}
        n = len(langs)
        self.theta = np.zeros((BUCKETS, n))
        self.start = np.zeros(n)
        self.move = np.zeros((n, n))
        self.forget()

    def forget(self) -> None:
        """Empty the memory of words: word -> row of ``rows``, and how often each was met."""
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.rows = np.zeros((0, len(self.langs)))
        self.met = np.zeros(0, np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "rows", "met")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def emissions(self, words: list[str]) -> np.ndarray:
        """Summed feature weights of each word."""
        out = np.zeros((len(words), len(self.langs)))
        if words:
            for at, place in features(words, self.lexicon):
                if len(at):
                    own = np.r_[True, at[1:] != at[:-1]]
                    out[at[own]] += np.add.reduceat(self.theta[place], np.flatnonzero(own), axis=0)
        return out

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of ``self.rows`` for the words of every text; words met most often are remembered."""
        if len(self.known) > CACHE_WORDS:
            words = list(self.known)
            often = np.sort(np.argsort(-self.met, kind="stable")[: CACHE_WORDS // 2])
            rows, met = self.rows[often], self.met[often] // 2
            self.forget()
            for i in often:
                self.known[words[i]]
            self.rows, self.met = rows, met
        had = len(self.known)
        found = [np.fromiter(map(self.known.__getitem__, t), np.int64, len(t)) for t in texts]
        if len(self.known) > had:
            words = list(self.known)[had:]
            self.rows = np.concatenate([self.rows, self.emissions(words)])
            self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])
        if found:
            self.met += np.bincount(np.concatenate(found), minlength=len(self.met))
        return found

    def probabilities(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label probabilities (words, L) for every text with a word."""
        out: list[np.ndarray] = [np.zeros((0, len(self.langs)))] * len(texts)
        ids = self.ids(texts)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: -len(texts[i]))
        start, move = np.exp(self.start), np.exp(self.move)
        at = 0
        while at < len(order):
            t_max = len(texts[order[at]])
            group = order[at : at + max(1, GROUP_WORDS // t_max)]
            at += len(group)
            lengths = np.array([len(texts[i]) for i in group])
            emit = np.zeros((t_max, len(group), len(self.langs)))
            for j, i in enumerate(group):
                emit[: len(ids[i]), j] = self.rows[ids[i]]
            emit = np.exp(np.clip(emit - emit.max(2, keepdims=True), -60, 0))
            p = forward_backward(emit, lengths, start, move)
            for j, i in enumerate(group):
                out[i] = p[: lengths[j], j]
        return out

    def gradient(self, batch: list[tuple[list[str], np.ndarray]], grams=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, their rows of theta's gradient, start's and move's) of the negative log likelihood of labelled chains.

        ``grams`` may hold the feature places of every word.
        """
        n = len(self.langs)
        batch = sorted(batch, key=lambda c: -len(c[0]))
        lengths = np.array([len(w) for w, _ in batch])
        emit = np.zeros((lengths[0], len(batch), n))
        grams = grams or places([w for words, _ in batch for w in words], self.lexicon)
        flat = [grams[w] for words, _ in batch for w in words]
        cuts = np.cumsum([0, *map(len, flat)])[:-1]
        joined = np.concatenate(flat)
        summed = np.add.reduceat(self.theta[joined], cuts, axis=0)
        off = np.r_[0, np.cumsum(lengths)]
        for j in range(len(batch)):
            emit[: lengths[j], j] = summed[off[j] : off[j + 1]]
        emit = np.exp(np.clip(emit - emit.max(2, keepdims=True), -60, 0))
        move = np.exp(self.move)
        forward: list[np.ndarray] = []
        p = forward_backward(emit, lengths, np.exp(self.start), move, forward)
        d_word = np.zeros((off[-1], n))
        d_start, d_move = np.zeros(n), np.zeros((n, n))
        for j, (_, y) in enumerate(batch):
            own = p[: lengths[j], j].copy()
            own[np.arange(len(y)), y] -= 1
            d_word[off[j] : off[j + 1]] = own
            d_start += own[0]
            # expected transitions: what came before, the move, and what the later words make of it
            before = forward[0][: lengths[j] - 1, j]
            d_move += (before.T @ (p[1 : lengths[j], j] / (before @ move))) * move
            np.subtract.at(d_move, (y[:-1], y[1:]), 1)
        used, at = np.unique(joined, return_inverse=True)
        grad = np.zeros((len(used), n))
        np.add.at(grad, at, np.repeat(d_word, np.diff(np.r_[cuts, len(joined)]), axis=0))
        return used, grad, d_start, d_move

    def train(self, chains: list[tuple[list[str], np.ndarray]]) -> None:
        """Stochastic gradient ascent on the chains' log likelihood, steps scaled by past gradients."""
        seen = [np.full_like(x, 1e-8) for x in (self.theta, self.start, self.move)]
        grams = places([w for words, _ in chains for w in words], self.lexicon)

        def step(weights, sums, grad, at=slice(None)):
            sums[at] += grad**2
            weights[at] -= RATE * grad / np.sqrt(sums[at])

        for _ in range(EPOCHS):
            for k in range(0, len(chains), BATCH_CHAINS):
                batch = chains[k : k + BATCH_CHAINS]
                used, grad, d_start, d_move = self.gradient(batch, grams)
                scale = 1 / len(batch)
                step(self.theta, seen[0], grad * scale, used)
                step(self.start, seen[1], d_start * scale)
                step(self.move, seen[2], d_move * scale)


def places(words: list[str], lexicon: dict[str, int]) -> dict[str, np.ndarray]:
    """Feature places of every distinct word."""
    distinct = list(dict.fromkeys(words))
    at, place = (np.concatenate(x) for x in zip(*features(distinct, lexicon)))
    order = np.argsort(at, kind="stable")
    return dict(zip(distinct, np.split(place[order], np.searchsorted(at[order], np.arange(1, len(distinct))))))


def stitched(texts: dict[str, list[list[str]]], langs: list[str]) -> list[tuple[list[str], np.ndarray]]:
    """Chains of one to four stretches, each from a document of some language (fixed seed)."""
    rng = np.random.default_rng(11)
    chains = []
    for _ in range(max(CHAINS, LANG_CHAINS * len(langs))):
        words: list[str] = []
        labels: list[int] = []
        for _ in range(rng.integers(1, 5)):
            lang = int(rng.integers(len(langs)))
            docs = texts[langs[lang]]
            doc = docs[int(rng.integers(len(docs)))]
            size = int(rng.integers(4, CHAIN_WORDS // 2))
            at = int(rng.integers(max(1, len(doc) - size)))
            part = doc[at : at + size]
            words += part
            labels += [lang] * len(part)
        if words:
            chains.append((words, np.array(labels)))
    return chains


def train_field(train: DataFrame) -> Field | None:
    """A field from SAMPLE_DOCS (text, lang) rows of every language, spread by hash; None if there are none.

    Every language that a row names is learned, however rare, so the field
    (and what is collected here) grows with the number of languages alone.
    """
    known = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    spread = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1_000_000, int(1.2e6 * SAMPLE_DOCS / n) + 1))))
    rows = known.where(spread < F.element_at(share, F.col("lang"))).select("lang", "text", spread.alias("at")).dropDuplicates(["lang", "text"]).collect()
    texts: dict[str, list[list[str]]] = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["text"])):
        words = cut(r["text"])
        if words and len(texts.setdefault(r["lang"], [])) < SAMPLE_DOCS:
            texts[r["lang"]].append(words)
    texts = {k: v for k, v in texts.items() if v}
    if not texts:
        return None
    langs = sorted(texts)
    lexicon = sorted({w for ts in texts.values() for w, _ in Counter(w for t in ts for w in t).most_common(LEXICON)})
    field = Field(langs, lexicon)
    field.train(stitched(texts, langs))
    return field


def identify(docs: DataFrame, modulus: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_switches per row of ``docs`` (doc_id, text, lang).

    Learns from rows outside the held-out fold with a text and a lang. A text
    that is null or has no letter is ``und`` with score 0; without anything to
    learn from every text is. ``score`` is the mean probability of the
    predicted language over the words, ``n_switches`` counts label changes
    between neighbouring words. Repeated rows give repeated results; other
    columns are ignored.
    """
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", "lang")
    field = train_field(keyed.where(~held_out(F.col("doc_id"), modulus)).select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            rows: list[tuple[str, float, int]] = []
            texts: list[list[str]] = []
            size = 0

            def label() -> None:
                for p in field.probabilities(texts) if field else [np.zeros((0, 1))] * len(texts):
                    if not len(p):
                        rows.append(("und", 0.0, 0))
                        continue
                    mean = p.mean(0)
                    best = int(mean.argmax())
                    rows.append((field.langs[best], min(1.0, float(mean[best])), int((np.diff(p.argmax(1)) != 0).sum())))
                texts.clear()

            for t in batch.column(2):
                t = t.as_py() or ""
                texts.append(cut(t) if field else [])
                size += len(t)
                if size > CHUNK_CHARS:
                    label()
                    size = 0
            label()
            langs, scores, switches = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(switches, pa.int64())], names=["doc_id", "held_out", "lang_pred", "score", "n_switches"])

    return keyed.select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_switches long")
