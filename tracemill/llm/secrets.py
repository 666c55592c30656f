"""Secret scan: base patterns, and automata inferred from what they find.

The credentials that the base patterns label are samples of the formats in
use. From a bounded sample per kind a prefix tree of character classes is
built (the credentials themselves are never written or collected, only their
shapes), and states whose futures are statistically alike (Hoeffding bounds on
all transition and end frequencies, and on how long the rest is) are merged
into a probabilistic automaton. A state that too few credentials reach tells
nothing; it is merged with one as far from the start, or stays. Ordinary tokens
give an automaton in the same way. Every other token of every text is then
scored by its likelihood under each automaton; tokens as likely as the labelled
credentials, and by far likelier than under the ordinary automaton, become
spans of kind ``format``. A token is a run of the base patterns' characters; where the run as
a whole is no match, its parts between dots are tried.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The base patterns and the fewest characters that count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")
LEARNED = "format"

#: A token that may be a credential: the base patterns' characters, as long as their shortest credential.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
PART = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Shapes whose verdict a worker remembers, at most.
REMEMBERED = 200_000
#: Distinct labelled credentials of a kind that its automaton is learned from, and their length at most: what bounds the prefix tree.
SAMPLE, SAMPLE_CHARS = 1000, 200
#: Risk of the Hoeffding test; share of the labelled credentials that the score threshold lets go.
ALPHA, QUANTILE = 0.01, 0.05
#: Credentials that have to reach a state before its futures are held against those of states elsewhere.
EVIDENCE = 30
#: Bits by which a token has to be likelier as a credential than as an ordinary token.
MARGIN = 10
#: Exponents at which Chernoff's bound is taken.
TILTS = (1, 2, 4, 8)
#: What the sample calls tokens that no base span touches.
ORDINARY = "ordinary"
UNSEEN = 1e-4


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind as listed; ends are exclusive."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, spans: list[tuple[str, int, int, str]]) -> Iterator[list[tuple[int, int, str]]]:
    """For every token the (start, end, value) of itself without outer dots and of its parts between dots, without any that a base span touches."""
    for m in CANDIDATE.finditer(text):
        v, at = m[0], m.start()
        whole = v.strip(".")
        tries = [(at + v.index(whole), whole)] if len(whole) >= 8 else []
        if "." in whole:
            tries += [(p.start() + at, p[0]) for p in PART.finditer(v)]
        free = [(a, a + len(x), x) for a, x in tries if not any(s < a + len(x) and a < e for _, s, e, _ in spans)]
        if free:
            yield free


def learned_spans(text: str, spans: list[tuple[str, int, int, str]], likely) -> list[tuple[int, int]]:
    """(start, end) of the tokens that ``likely`` takes, of their parts where the whole is not taken."""
    out: list[tuple[int, int]] = []
    for tries in candidates(text, spans):
        for a, b, value in tries:
            if (not out or a >= out[-1][1]) and likely(classes(value)):
                out.append((a, b))
    return out


def classes(value: str) -> str:
    """One letter per character: digit, a-f, other lower case, A-F, other upper case; the rest as it is."""
    return "".join("d" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "f" < c <= "z" else "H" if "A" <= c <= "F" else "U" if "F" < c <= "Z" else c for c in value)


class Automaton:
    """A probabilistic automaton, merged from the prefix tree of a sample."""

    def __init__(self, sample: list[str], alpha: float = ALPHA):
        self.moves: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.ends = [0]
        self.depth = [0]
        self.tails: list[Counter[int]] = [Counter()]
        for s in sample:
            at = 0
            for k, c in enumerate(s):
                self.count[at][c] += 1
                self.tails[at][len(s) - k] += 1
                if c not in self.moves[at]:
                    self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    self.count.append(defaultdict(int))
                    self.ends.append(0)
                    self.depth.append(k + 1)
                    self.tails.append(Counter())
                at = self.moves[at][c]
            self.ends[at] += 1
            self.tails[at][0] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def alike(self, a: int, b: int) -> bool:
        """Whether the futures of two states agree, followed down the tree below ``b``; where few reach ``b``, whether they lie equally deep."""
        n, m = self.total(a), self.total(b)
        if min(n, m) < EVIDENCE and self.depth[a] != self.depth[b]:
            return False
        if n and m and any(self.differ(self.tails[a][r], n, self.tails[b][r], m) for r in {*self.tails[a], *self.tails[b]}):
            return False
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.total(x), self.total(y)
            if not n or not m:
                continue
            if self.differ(self.ends[x], n, self.ends[y], m):
                return False
            for c in {*self.count[x], *self.count[y]}:
                if self.differ(self.count[x].get(c, 0), n, self.count[y].get(c, 0), m):
                    return False
                if c in self.moves[x] and c in self.moves[y] and self.moves[x][c] != self.moves[y][c]:
                    todo.append((self.moves[x][c], self.moves[y][c]))
        return True

    def fold(self, into: int, state: int) -> None:
        """Add the tree below ``state`` to what is below ``into``."""
        todo = [(into, state)]
        while todo:
            x, y = todo.pop()
            self.ends[x] += self.ends[y]
            self.tails[x] += self.tails[y]
            for c, k in self.count[y].items():
                self.count[x][c] += k
            for c, child in self.moves[y].items():
                if c in self.moves[x]:
                    todo.append((self.moves[x][c], child))
                else:
                    self.moves[x][c] = child

    def _merge_all(self) -> None:
        red = [0]
        while True:
            known = {*red}
            blue = next(((p, c, q) for p in red for c, q in self.moves[p].items() if q not in known), None)
            if blue is None:
                break
            parent, c, q = blue
            for r in red:
                if self.alike(r, q):
                    self.moves[parent][c] = r
                    self.fold(r, q)
                    break
            else:
                red.append(q)
        place = {q: i for i, q in enumerate(red)}
        self.table = []
        for q in red:
            n = self.total(q) or 1
            shares = [k / n for k in (*self.count[q].values(), self.ends[q]) if k]
            tilted = tuple(math.log(sum(p ** (1 + t) for p in shares)) if shares else 0.0 for t in TILTS)
            self.table.append(({c: (place[t], math.log2(self.count[q][c] / n)) for c, t in self.moves[q].items()}, math.log2(max(self.ends[q] / n, UNSEEN)), tilted))
        del self.moves, self.count, self.ends, self.depth, self.tails

    def steps(self, s: str) -> tuple[float, int, int, float]:
        """Of the steps that the sample took, the end among them: their log2 likelihood and number; the number of other steps; and a bound (natural logarithm) of the chance that a walk through the same states is as likely."""
        at, gain, n, odd, sums = 0, 0.0, 0, 0, [0.0] * len(TILTS)
        walked = []
        for c in s:
            step = self.table[at][0].get(c)
            if step is None:
                odd += 1
                continue
            walked.append(at)
            at, n, gain = step[0], n + 1, gain + step[1]
        end = self.table[at][1]
        if end <= math.log2(UNSEEN):
            odd += 1
        else:
            walked.append(at)
            n, gain = n + 1, gain + end
        for q in walked:
            sums = [a + b for a, b in zip(sums, self.table[q][2])]
        return gain, n, odd, min(0.0, *(a - t * gain * math.log(2) for a, t in zip(sums, TILTS)))

    def score(self, s: str) -> float:
        """Mean log2 likelihood per symbol, the end counted as one."""
        gain, _, odd, _ = self.steps(s)
        return (gain + odd * math.log2(UNSEEN)) / (len(s) + 1)


@dataclass(frozen=True)
class Format:
    """An automaton with the score that most of its credentials reach."""

    automaton: Automaton
    least: float

    def takes(self, shape: str) -> bool:
        """Whether a shape is as likely as the credentials, less one step that none of them took (another length, say), and not likelier than a draw.

        A run of the most frequent class alone is likelier than nearly all
        walks through the same states; Chernoff's bound tells how rare it is.
        """
        gain, n, odd, chance = self.automaton.steps(shape)
        if odd > 1 or not n or gain < self.least * n + odd * math.log2(UNSEEN) / 2:
            return False
        return chance >= math.log(ALPHA)


def learn(samples: dict[str, list[str]]) -> tuple[list[Format], Automaton | None]:
    """The format of every kind with shapes of credentials, and the automaton of ordinary tokens if there are enough to tell."""
    out = []
    for kind, shapes in samples.items():
        if kind == ORDINARY:
            continue
        automaton = Automaton(shapes)
        scores = sorted(map(automaton.score, shapes))
        out.append(Format(automaton, scores[int(QUANTILE * len(scores))]))
    plain = samples.get(ORDINARY, [])
    return out, Automaton(plain) if len(plain) >= EVIDENCE else None


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, place, shape) of the SAMPLE labelled credentials of every kind, and of ordinary tokens, with the smallest hashes in a task."""
    least: dict[str, dict[int, str]] = {k: {} for k in (*KINDS, ORDINARY)}

    def cut(found: dict[int, str]) -> dict[int, str]:
        return {h: found[h] for h in sorted(found)[:SAMPLE]}

    for batch in batches:
        for text in batch.column(0):
            source = text.as_py() or ""
            spans = base_spans(source)
            plain = [(ORDINARY, a, b, v) for tries in candidates(source, spans) for a, b, v in tries[:1]]
            for kind, _, _, value in (*spans, *plain):
                if len(value) <= SAMPLE_CHARS:
                    found = least[kind]
                    found[xxhash.xxh64_intdigest(value) >> 1] = classes(value)
                    if len(found) > 4 * SAMPLE:
                        least[kind] = cut(found)
    rows = [(k, h, shape) for k, found in least.items() for h, shape in cut(found).items()]
    kinds = (pa.string(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "place", "shape"])


def samples_of(docs: DataFrame) -> dict[str, list[str]]:
    """kind -> shapes of a bounded number of distinct labelled credentials, spread by hash, from all of ``docs``."""
    found = docs.select("text").mapInArrow(_find, "kind string, place long, shape string").distinct()
    first = F.row_number().over(Window.partitionBy("kind").orderBy("place")) <= SAMPLE
    out: dict[str, list[str]] = {}
    for r in found.withColumn("first", first).where("first").orderBy("kind", "place").collect():
        out.setdefault(r["kind"], []).append(r["shape"])
    return out


class Verdicts(dict):
    """shape -> whether some format takes it and it is no ordinary token, remembered up to a bound."""

    def __init__(self, formats: list[Format], ordinary: Automaton | None):
        super().__init__()
        self.formats, self.ordinary = formats, ordinary

    def __missing__(self, shape: str) -> bool:
        best = max((f.automaton.score(shape) for f in self.formats if f.takes(shape)), default=None)
        value = best is not None and (self.ordinary is None or (best - self.ordinary.score(shape)) * (len(shape) + 1) >= MARGIN)
        if len(self) < REMEMBERED:
            self[shape] = value
        return value


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_format per row of ``docs``.

    ``spans`` has the base spans and the learned ones as kind:start:end, by
    start. A null text counts as empty and has no spans. Without labelled
    credentials there are no learned spans. Repeated rows give repeated
    results; other columns are ignored.
    """
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(learn(samples_of(keyed)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = Verdicts(*shared.value).__getitem__
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in (*KINDS, LEARNED)}
            shas, joined = [], []
            for source in batch.column(1):
                source = source.as_py() or ""
                spans = base_spans(source)
                base = [(a, KINDS.index(k), k, b) for k, a, b, _ in spans]
                more = [(a, len(KINDS), LEARNED, b) for a, b in (learned_spans(source, spans, likely) if shared.value[0] else ())]
                text = [",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(x)) for x in (base, base + more)]
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in base))
                counts[LEARNED].append(len(more))
                shas.append(hashlib.sha256(text[0].encode()).hexdigest())
                joined.append(text[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(shas, pa.string()), pa.array(joined, pa.string()), pa.array(counts[LEARNED], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"],
            )

    return keyed.mapInArrow(score, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans, by walking the text character by character as the contract states them (for tests)."""
    text = text or ""
    out = []
    body = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    lower = {u: low for u, low in zip(body[:26], body[26:52])}
    low = "".join(lower.get(c, c) for c in text)

    def run(at: int, allowed: str) -> int:
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    at = 0
    while at < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at)), None)
        end = None
        if word:
            p = at + len(word)
            p += text[p : p + 1] in ("'", '"')
            p = run(p, " ")
            if text[p : p + 1] in (":", "="):
                p = run(p + 1, " ")
                p += text[p : p + 1] in ("'", '"')
                stop = run(p, body)
                # a keyword match needs one character of the value; short values use up their text but don't count
                if stop > p:
                    end = stop
                    if stop - p >= 8:
                        out.append(("assign", at, stop))
        at = end or at + 1
    for kind, head, allowed, least in (("access", "AKIA", body[:26] + body[52:62], 16), ("hex", "", body[52:62] + "abcdef", 32)):
        at = 0
        while at < len(text):
            stop = run(at + len(head), allowed) if text.startswith(head, at) else at
            if stop > at + len(head):
                if stop - at >= least:
                    out.append((kind, at, stop))
                at = stop
            else:
                at += 1
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))
