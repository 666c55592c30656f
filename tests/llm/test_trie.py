import random

import pytest

from tracemill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, h int, n long, pos string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def same(found, rows):
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(trie.brute_force(rows), key=key)


def talks(rng, n, turns, words):
    """Conversations that part at different places, some of them copies."""
    out = []
    for c in range(n):
        for t in range(rng.randint(1, turns)):
            out.append((c * 37 % 401, t, "user" if t % 2 == 0 else "assistant", rng.choice(words)))
    return out


@pytest.mark.parametrize("turns,words", [(3, "ab"), (14, "a"), (9, ["é", "longer text", ""]), (30, "ab")])
def test_against_brute_force(spark, turns, words):
    rows = talks(random.Random(turns), 120, turns, words)
    same(trie.trie_report(rows_of(spark, rows)), rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, 3, "user", None), (5, 3, "user", None), (7, 1, None, "y"), (7, 1, None, "y"), (-3, 0, "user", "z" * 100_000)]
    rows += [(100, t, "u", str(t)) for t in range(700)] + [(101, 0, "u", "0"), (102, 0, "", ""), (250, 0, "a", "b"), (299, 0, "a", "b")]
    same(trie.trie_report(rows_of(spark, rows)), rows)


def test_turnless_and_empty(spark):
    # conversations without own turns after the first h, of a hundred without a first one
    rows = [(c, 0, "user", "hi") for c in range(1, 60)]
    same(trie.trie_report(rows_of(spark, rows)), rows)
    assert trie.trie_report(rows_of(spark, rows).limit(0)).collect() == []


def test_all_conversations_alike(spark):
    rows = [(c, t, "user", "same") for c in range(300) for t in range(6)]
    same(trie.trie_report(rows_of(spark, rows)), rows)


def test_ids_beyond_one_range(spark, monkeypatch):
    monkeypatch.setattr(trie, "RANGE", 7)
    rows = [(c, t, "user", "same") for c in range(-40, 90) for t in range(2)]
    same(trie.trie_report(rows_of(spark, rows)), rows)


def test_query_against_brute_force(spark):
    from tracemill.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries()["op12_prefix_trie"](spark, sf), rows)
