import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import sentence
from tracemill.llm import simhash


def same(found, docs):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(simhash.brute_force(docs), key=key)


def test_gray_order():
    rank = np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert (simhash.gray_rank(simhash._codes(rank.view(np.int64))) == rank).all()
    codes = simhash._codes(np.arange(1 << 12))
    assert (np.bitwise_count(codes[1:] ^ codes[:-1]) == 1).all()
    fp = rank
    for q in range(4):
        assert (simhash._fp(simhash._turned(fp, q), np.full(len(fp), q << 16)) == fp).all()


def test_long_text_in_pieces(monkeypatch):
    text = sentence(random.Random(2), 3000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert simhash.fingerprint(text) == whole
    assert f"{whole:016x}" == simhash.brute_force([(1, text)])[0][1]


def components_of(fp):
    label = list(range(len(fp)))
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 3).tolist():
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("spread", [4, 10, 24, 64])
def test_index_finds_all_links(spread):
    """Dense and thin groups: the forest has the components of all pairs."""
    rng = np.random.default_rng(spread)
    bits = rng.choice(48, min(spread, 48), replace=False)  # the first quarter is common: one top node
    flips = (rng.random((600, len(bits))) < 0.3).astype(np.uint64) << bits.astype(np.uint64)
    code = np.unique(np.bitwise_or.reduce(flips, axis=1) | np.uint64(0xBEEF << 48))
    rank = np.sort(simhash.gray_rank(code))
    out = simhash._inside(np.full(len(rank), 7, np.int32), rank.view(np.int64))
    code = simhash._codes(rank.view(np.int64))
    wanted = components_of(code)
    root = {int(c): int(c) for c in code.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = list(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and find(a) != find(b)
        root[find(a)] = find(b)
    got = [find(int(c)) for c in code.view(np.int64)]
    assert len(set(zip(got, wanted))) == len(set(got)) == len(set(wanted))


def test_stream_keeps_top_nodes_whole(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    node = np.repeat(np.arange(9, dtype=np.int32), [3, 8, 1, 6, 6, 2, 8, 8, 1])
    rank = np.concatenate([np.arange(n) for n in np.bincount(node)]).astype(np.int64)
    whole = simhash._inside(node, rank).num_rows
    for rows in (1, 5, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array(node[i : i + rows]), pa.array(rank[i : i + rows])], names=["node", "rank"]) for i in range(0, len(node), rows)]
        assert sum(b.num_rows for b in simhash._stream(iter(batches))) == whole


def test_odd_rows(odd, odd_rows):
    same(simhash.near_duplicates(odd), [r[:2] for r in odd_rows])


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(5)
    base = [sentence(rng, 300) for _ in range(3)]
    docs = []
    for i in range(150):
        words = base[0 if i % 3 else rng.randrange(3)].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "x" + str(rng.randrange(100))
        docs.append((i * 7 % 151, " ".join(words)))
    return docs + [(900 + i, sentence(rng, 40)) for i in range(60)]


def test_near_copies(spark, near_copies):
    same(simhash.near_duplicates(spark.createDataFrame(near_copies, "doc_id long, text string")), near_copies)


def test_large_top_nodes_meet_in_ranges(spark, near_copies, monkeypatch):
    """With ranges of four rows nearly every top node is cut; nothing is lost."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    same(simhash.near_duplicates(spark.createDataFrame(near_copies, "doc_id long, text string")), near_copies)


def test_query_against_brute_force(spark):
    from tracemill.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(queries()["op11_simhash_gray"](spark, sf), docs)
