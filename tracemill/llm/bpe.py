"""BPE encoding and decoding over a contiguous array of part ranks.

A word is held as an array of part boundaries with the merge rank of every
adjacent pair of parts beside it. The smallest rank is found by a scan, its inner
boundary is deleted, and only the two neighbouring ranks are looked up anew.
Words are short, so the scans stay within a few dozen numbers; a word of more
than LONG_WORD bytes keeps its parts linked in place and finds the smallest
rank by a heap, in the same order. Encoded words are remembered per Python worker up to ``CACHE_WORDS`` entries, stretches between
white space up to ``CACHE_CHUNKS``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm.common import portions

CACHE_WORDS = 150_000
CACHE_CHUNKS = 250_000
SEPARATORS = re.compile("[\x1c-\x1f]")
NO_RANK = 1 << 60
LONG_WORD = 200

# What the library's tables have beyond Unicode 15.1. Letters and numbers of Unicode 16.0:
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Lower-case forms of Unicode 17.0: first, last, distance.
NEW_LOWER = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte, as byte-level BPE defines it."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def letter_and_number() -> tuple[str, str]:
    """The insides of two character classes: the letters and the numbers of the library's tables, as ranges."""
    found = {"L": [list(r) for r in NEW_LETTERS], "N": [list(r) for r in NEW_NUMBERS]}
    for c in range(sys.maxunicode + 1):
        ranges = found.get(unicodedata.category(chr(c))[0])
        if ranges is not None:
            if ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found[k]) for k in "LN")


LOWER = {c: c + far for a, b, far in NEW_LOWER for c in range(a, b + 1)}


class WordBpe:
    """A word-end BPE vocabulary, read from the text of a tokenizers file."""

    def __init__(self, spec_text: str):
        spec = json.loads(spec_text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        token = self.vocab
        # pair of tokens -> rank and joined token, in one number
        self.joined = {token[a] << 20 | token[b]: rank << 20 | token[a + b] for rank, (a, b) in reversed([*enumerate(model["merges"])])}
        self.inner = [token[s] for s in byte_symbols()]
        self.final = [token[s + self.end] for s in byte_symbols()]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_parts = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        names = [n for n in spec["pre_tokenizer"]["pretokenizers"] if n["type"] == "Split"]
        # \s and the two classes are spelled out as the pattern's own engine reads them
        space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        letter, number = letter_and_number()
        pattern = names[0]["pattern"]["Regex"].replace(r"\s", space).replace(r"\p{L}", letter).replace(r"\p{N}", number)
        self.pieces = re.compile(pattern).findall
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one word, given as UTF-8.

        ``bounds[i]`` is where part i begins, ``parts[i]`` its token, and
        ``ranks[i]`` the rank of joining parts i and i + 1 (with the joined
        token in the low bits, so that one look-up gives both).
        """
        parts = [*map(self.inner.__getitem__, piece[:-1]), self.final[piece[-1]]]
        if len(parts) > LONG_WORD:
            return self.merge_long(parts)
        bounds = [*range(len(parts))]
        look = self.joined.get
        ranks = [look(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = new = least & 0xFFFFF
            del bounds[i + 1], parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = look(parts[i - 1] << 20 | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = look(new << 20 | parts[i + 1], NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, smallest rank first and then leftmost, for words of any length."""
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        look = self.joined.get
        ranks = [look(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])] + [NO_RANK]
        heap = [(r, i) for i, r in enumerate(ranks) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            if ranks[i] != least:
                continue
            gone = after[i]
            parts[i], parts[gone], ranks[gone] = least & 0xFFFFF, -1, NO_RANK
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0:
                    ranks[at] = look(parts[at] << 20 | parts[after[at]], NO_RANK) if after[at] < n else NO_RANK
                    if ranks[at] != NO_RANK:
                        heapq.heappush(heap, (ranks[at], at))
        return [p for p in parts if p >= 0]

    def word(self, piece: str) -> tuple[bytes, str]:
        """Ids of a piece as little-endian bytes, and their decoded text with a blank before each."""
        ids = self.merge(piece.encode())
        found = struct.pack(f"<{len(ids)}I", *ids), " " + " ".join(map(self.text_of.__getitem__, ids))
        if len(self.known) < CACHE_WORDS and len(piece) <= LONG_WORD:
            self.known[piece] = found
        return found

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() alone would turn a final sigma by its neighbours
                return "".join(map(str.lower, text))
        return text.lower()

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """What a stretch without white space gives; no piece reaches over white space."""
        known, word = self.known.get, self.word
        source = chunk
        if not chunk.isascii():
            chunk = chunk.translate(LOWER)
        found = [known(piece) or word(piece) for piece in self.pieces(chunk)]
        joined = (b"".join([a for a, _ in found]), "".join([b for _, b in found])) if len(found) != 1 else found[0]
        if len(self.chunks) < CACHE_CHUNKS and len(source) <= LONG_WORD:
            self.chunks[source] = joined
        return joined

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        parts = [text]
        if self.special_parts and "<|" in text:
            parts = self.special_parts.split(text)
        found: list[tuple[bytes, str]] = []
        seen, chunk = self.chunks.get, self.chunk
        for k, part in enumerate(parts):
            if k % 2:
                found.append((struct.pack("<I", self.specials[part]), " " + part))
            elif part:
                part = self.normalize(part)
                # split() also breaks at the four ASCII separators, which the pattern takes for symbols
                chunks = part.split() if not SEPARATORS.search(part) else [part]
                found += [seen(c) or chunk(c) for c in chunks]
        return b"".join([a for a, _ in found]), "".join([b for _, b in found])[1:]

    def ids(self, text: str) -> list[int]:
        raw = self.encode(text)[0]
        return [*struct.unpack(f"<{len(raw) // 4}I", raw)]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by blanks; ids without a token are left out."""
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)


@lru_cache(maxsize=2)
def tokenizer(spec_text: str) -> WordBpe:
    """One vocabulary per Python worker and file content."""
    return WordBpe(spec_text)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, spec_path: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests.

    Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256 (ids as
    little-endian unsigned 32-bit integers), decoded_sha256. A null text counts
    as empty: no tokens and the digests of no bytes. Rows that repeat give
    repeated results; a null doc_id stays null; other columns are ignored. The
    vocabulary file is read on the driver and broadcast: it has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(spec_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(shared.value)
        sha = hashlib.sha256
        for batch in portions(batches):
            count, a, b = [], [], []
            for text in batch.column(1):
                raw, decoded = bpe.encode(text.as_py() or "")
                count.append(len(raw) // 4)
                a.append(sha(raw).hexdigest())
                b.append(sha(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, spec_path: str) -> DataFrame:
    """doc_id, ids array<int> and decoded string of every whole text.

    Null and empty texts give no ids and an empty string. Rows that repeat give
    repeated results; a null doc_id stays null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(spec_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(shared.value)
        for batch in portions(batches):
            ids, out = [], []
            for text in batch.column(1):
                raw, decoded = bpe.encode(text.as_py() or "")
                ids.append([*struct.unpack(f"<{len(raw) // 4}I", raw)])
                out.append(decoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(out, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
