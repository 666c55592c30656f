"""Repair of conversation structure over a suffix-shared word graph.

1. Turns become one symbol each: the role's initial where the grammar knows
   it, in capitals if the text breaks off, or x for a turn that must go. A
   conversation is a word of such symbols, its signature; equal signatures
   collapse, however many conversations have them.
2. Signatures are sorted by their reversed symbols. Signatures with a common
   ending then follow each other and share the nodes of that ending: a node is
   added once for each distinct ending of a range of the sorted words.
3. For a node and a state of the grammar the cheapest cost to go and the first
   edit of the ASCII-least cheapest audit are worked out when the node is
   added. Different edits have different letters, so the audit of a word is
   read by following first edits.
4. Audits go back to the conversations, and their turns are edited as they
   stream by. Only this last step moves texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm.common import materialize, portions, release

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
#: Before any turn, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: By state: the turn that the grammar asks for next (a system turn may come first), and the state after it.
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
#: By state: the state after keeping a turn of the given initial.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FINAL = (START, ASSISTANT)
NEVER = 1 << 60

BLANK, CUT = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


class WordGraph:
    """Endings of words, added from the end; the endings of the last word are a stack.

    Per node and state: the cost to go, the first edit's letter and the state
    after it. An ending shared with the word before keeps its nodes.
    """

    def __init__(self) -> None:
        self.word = ""
        self.cost, self.letter, self.state = array("q"), bytearray(), bytearray()
        self.nodes = 0
        self._add([(0, " ", s) if s in FINAL else (NEVER, " ", s) for s in range(4)])

    def _add(self, options: list[tuple[int, str, int]]) -> None:
        """A node with the given best options without insertion; insertions lead to other states of the node."""
        best = list(options)
        for s in (USER, ASSISTANT, START, SYSTEM):  # those that user and assistant offer each other cost more than what they had
            to = NEXT[s][0]
            best[s] = min(options[s], (INSERT + (options[to][0] if s in (USER, ASSISTANT) else best[to][0]), "I", to))
        self.cost.extend(b[0] for b in best)
        self.letter += "".join(b[1] for b in best).encode()
        self.state += bytes(b[2] for b in best)
        self.nodes += 1

    def audit(self, word: str) -> tuple[int, str]:
        """Cost and edits of ``word``; words come in the order of their reversed symbols."""
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[-1 - shared] == self.word[-1 - shared]:
            shared += 1
        del self.cost[4 * (shared + 1) :], self.letter[4 * (shared + 1) :], self.state[4 * (shared + 1) :]
        for symbol in reversed(word[: len(word) - shared]):
            after = self.cost[-4:]
            if symbol == "x":
                self._add([(DELETE + after[s], "D", s) for s in range(4)])
                continue
            more, initial = BROKEN * symbol.isupper(), symbol.lower()
            options = []
            for s in range(4):
                found = [(DELETE + after[s], "D", s), (REROLE + more + after[NEXT[s][0]], "R", NEXT[s][0])]
                if initial in KEPT[s]:
                    found.append((KEEP + more + after[KEPT[s][initial]], "K", KEPT[s][initial]))
                options.append(min(found))
            self._add(options)
        self.word = word
        at, s, edits = len(word), START, bytearray()
        while (letter := self.letter[4 * at + s]) != 32:
            edits.append(letter)
            s, at = self.state[4 * at + s], at - (letter != 73)  # I stays at its turn
        return self.cost[4 * len(word)], edits.decode()


AUDITS = "signature string, cost long, audit string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    graph = WordGraph()
    for batch in portions(batches, 4000):
        words = batch.column(0).to_pylist()
        made = [graph.audit(w) for w in words]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())], names=["signature", "cost", "audit"])


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) per distinct signature."""
    words = materialize(signatures.select("signature").distinct())
    back = F.reverse("signature")
    return words.repartitionByRange(back).sortWithinPartitions(back).select("signature").mapInArrow(_audits, AUDITS)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with the faults that crc32 of ``conv_id:turn`` deals them; nulls become one space."""
    conv, turn, role, text = (turns[c].alias(c) for c in ("conv_id", "turn", "role", "text"))
    rows = turns.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit(" ")).alias("role"), F.coalesce(text.cast("string"), F.lit(" ")).alias("text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("fault", F.pmod(F.crc32(name.cast("binary")), F.lit(20))).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def _digest() -> F.Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)), 1, 16)


HEADS = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), ("signature", pa.string())])
HEADS_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Head:
    """Counts and signature of one conversation; a byte a turn."""

    def __init__(self, conv: int | None):
        self.conv, self.faults, self.illegal, self.word = conv, dict.fromkeys("bdt", 0), 0, []
        self.low = self.high = self.turn = self.initial = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        if fault in self.faults:
            self.faults[fault] += 1
        if self.initial is not None and (self.initial, initial) not in LEGAL:
            self.illegal += 1
        self.initial = initial
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.word.append("x" if fault in "bd" else symbol.upper() if fault == "t" else symbol)

    def row(self) -> tuple:
        return (self.conv, self.high - self.low + 1 - self.turns if self.turns else 0, *self.faults.values(), self.illegal, "".join(self.word))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and signature of each conversation of sorted rows; a row without ``fault`` only names a conversation."""
    head: _Head | None = None
    done: list[tuple] = []

    def emit() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), HEADS)], schema=HEADS)
        done.clear()
        return made

    for batch in portions(batches, 4000):
        for conv, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault"))):
            if head is None or conv != head.conv:
                if head is not None:
                    done.append(head.row())
                head = _Head(conv)
            if fault is not None:
                head.add(turn, initial, fault)
        if done:
            yield emit()
    if head is not None:
        done.append(head.row())
        yield emit()


def heads(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """gaps, blank, duplicate, truncated, illegal and signature of each of ``conversations`` (conv_id), from ``turns`` without nulls in role and text.

    A turn is blank without any character but white space, else a duplicate if
    its role and text came earlier in its conversation, else truncated if its
    last character but white space is none of ``.!?``. Turns are ordered by
    turn (nulls first), then by digest. Texts are read here but not shuffled.
    """
    fault = F.when(~F.col("text").rlike(BLANK), "b").when(~F.col("text").rlike(CUT), "t").otherwise("-")
    rows = turns.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), _digest().alias("digest"), fault.alias("fault"))
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    rows = rows.withColumn("fault", F.when((F.col("fault") != "b") & again, "d").otherwise(F.col("fault")))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("initial", "string"), ("digest", "binary"), ("fault", "string"))]
    named = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct().select("conv_id", *nothing)
    rows = rows.union(named).repartition("conv_id")
    # repeated turns differ in nothing but their fault: the duplicate comes second
    rows = rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "digest", F.col("fault") == "d")
    return rows.select("conv_id", "turn", "initial", "fault").mapInArrow(_heads, HEADS_SQL)


def audited(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``heads`` with cost and audit: the edits of the cheapest repair, ASCII-least among equals."""
    found = materialize(heads(turns, conversations))
    best = materialize(audits(found))
    out = materialize(found.join(best, "signature").drop("signature"))
    release(found, best)
    return out


def edited(rows: Iterable[tuple[int | None, str | None, str | None, str | None]]) -> Iterator[tuple[int | None, str | None, str | None]]:
    """(conv_id, role, text) of repaired turns, from (conv_id, audit, role, text) where each conversation's audit comes before its turns.

    A conversation begins with a row of a null role and text.
    """
    conv, audit, at, state = None, "", 0, START

    def inserted() -> Iterator[tuple[int | None, str, str]]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state, role = NEXT[state]
            at += 1
            yield conv, role, ""

    for c, edits, role, text in rows:
        if edits is not None:
            yield from inserted()
            conv, audit, at, state = c, edits, 0, START
            yield conv, None, None
            continue
        yield from inserted()
        edit = audit[at]
        at += 1
        if edit == "K":
            state = KEPT[state][role[:1]]
            yield conv, role, text
        elif edit == "R":
            state, role = NEXT[state]
            yield conv, role, text
    yield from inserted()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in portions(batches):
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "turn", "role", "text"]
    out: list[tuple] = []
    held = n = 0
    for conv, role, text in edited(_read(batches)):
        if role is None:
            n = 0
            continue
        out.append((conv, n, role, text))
        n, held = n + 1, held + len(text)
        if len(out) >= 1000 or held > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    conv, state, first, begun = None, hashlib.sha256(), True, False
    for c, role, text in edited(_read(batches)):
        if role is None:
            if begun:
                done.append((conv, state.hexdigest()))
            conv, state, first, begun = c, hashlib.sha256(), True, True
            if len(done) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])
                done = []
            continue
        state.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    if begun:
        done.append((conv, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])


def _lined_up(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns in order; one shuffle, streamed."""
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "binary"))]
    rows = turns.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", _digest().alias("digest"), F.lit(1).alias("kind"))
    every = rows.union(plans.select("conv_id", "audit", *nulls, F.lit(0).alias("kind"))).repartition("conv_id")
    return every.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "digest").select("conv_id", "audit", "role", "text")


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the turns after the edits of ``plans`` (conv_id, audit), numbered from 0."""
    return _lined_up(turns, plans).mapInArrow(_turns, "conv_id long, turn long, role string, text string")


def repair_report(turns: DataFrame) -> DataFrame:
    """op13's columns for every conv_id of ``turns`` (conv_id, turn, role, text), damaged first.

    A null conv_id is a conversation of its own. Rows that repeat a turn are
    turns after each other; those of one turn with other texts are ordered by
    digest. Other columns are ignored; an empty table gives no rows.
    """
    rows = damaged(turns)
    plans = audited(rows, turns)
    digests = materialize(_lined_up(rows, plans).mapInArrow(_digests, "conv_id long, repaired_sha256 string"))
    found = plans.join(digests.withColumnRenamed("conv_id", "c"), plans["conv_id"].eqNullSafe(F.col("c")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def brute_force(rows: list[tuple]) -> list[tuple]:
    """op13's rows from (conv_id, turn, role, text) by shortest paths over edits, audits as strings (for tests)."""
    import heapq
    import re
    import zlib

    out: dict[int | None, list] = {}
    for c, t, role, text in rows:
        turns = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
        turns += [(t is not None, t or 0, tie, role, text)] * {0: 0, 3: 2}.get(k, 1)
    found = []
    for c, turns in out.items():
        turns.sort()
        seen, faults = set(), []
        for _, _, _, role, text in turns:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        known = {t for there, t, *_ in turns if there}
        initials = [role[:1] for _, _, _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:]))
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, made, lines = heapq.heappop(heap)
            if i == len(turns) and re.fullmatch("(s?(ua)+)?", made):
                break
            if (i, made[:1] == "s" and len(made) == 1, made[-1:]) in done:
                continue
            done.add((i, made[:1] == "s" and len(made) == 1, made[-1:]))
            options = [(5, "I", i, "u", "user:"), (5, "I", i, "a", "assistant:")]
            if i < len(turns):
                role, text, more = turns[i][3], turns[i][4], 5 * (faults[i] == "t")
                options.append((2, "D", i + 1, "", None))
                if faults[i] not in ("b", "d"):
                    options.append((more, "K", i + 1, role[:1] or "-", f"{role}:{text}"))
                    options += [(1 + more, "R", i + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
            for price, letter, j, initial, line in options:
                if not initial or re.fullmatch("s?(ua)*u?", made + initial):
                    heapq.heappush(heap, (cost + price, audit + letter, j, made + initial, lines + ((line,) if line is not None else ())))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        found.append((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return found
