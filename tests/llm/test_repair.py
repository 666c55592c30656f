import itertools
import random

import pytest

from tracemill.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, digest int, fault string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "K", 1, "x") for r in rows], SCHEMA)


def same(found, rows):
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(repair.brute_force(rows), key=key)


def by_edits(word):
    """Cheapest cost and ASCII-least audit over all sequences of edits up to two insertions in a row."""
    import re

    best = None
    price = {"D": 2, "K": 0, "R": 1}
    for edits in itertools.product("DKR", repeat=len(word)):
        for gaps in itertools.product(range(3), repeat=len(word) + 1):
            places, cost = [], 5 * sum(gaps)
            audit = ""
            for k, n in enumerate(gaps):
                audit += "I" * n
                places += [None] * n
                if k < len(word):
                    audit += edits[k]
                    cost += price[edits[k]]
                    if edits[k] != "D":
                        cost += 5 * word[k].isupper()
                        places.append(word[k].lower() if edits[k] == "K" else None)
            if any(w == "x" and e != "D" for w, e in zip(word, edits)) or (best is not None and (cost, audit) >= best):
                continue
            for first in ("s", "u"):
                for start in {first, "u"}:
                    roles = "".join(p or ("u" if (k - (start == "s")) % 2 == 0 else "a") for k, p in enumerate(places))
                    if re.fullmatch("(s?(ua)+)?", roles):
                        best = (cost, audit)
    return best


def test_graph_against_all_edits():
    words = ["".join(w) for n in range(4) for w in itertools.product("suaUox", repeat=n)]
    words = random.Random(1).sample(words, 90) + ["", "s", "a", "A", "su", "as"]
    words.sort(key=lambda w: w[::-1])
    graph = repair.WordGraph()
    for w in words:
        assert graph.audit(w) == by_edits(w), w


def test_shared_endings_are_nodes_once():
    words = sorted({"uaua" + e for e in ("ua", "uaua", "")} | {"sua", "xua", "oua"}, key=lambda w: w[::-1])
    graph = repair.WordGraph()
    for w in words:
        graph.audit(w)
    assert graph.nodes == len({w[k:] for w in words for k in range(len(w) + 1)})


ROLES = ["user", "assistant", "system", "tool", "", None, "User", "ua"]
TEXTS = ["Fine.", "Broken off", "", "  \t\n", "Ask?", "Dots. \n", None, "é!", "\x85", "x\x1f"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(c, t + rng.randrange(2) * (t > 4), rng.choice(ROLES[: 3 + seed * 2]), rng.choice(TEXTS) if rng.random() < 0.5 else f"Text {t}.") for c in range(150) for t in range(rng.randint(1, 9))]
    same(repair.repair_report(rows_of(spark, rows)), rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 2, "user", "a."), (1, None, "user", "b."), (1, 4, "assistant", "c."), (1, 4, "assistant", "c."), (2, -3, "s", "."), (2, 9, "u", "!")]
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(2000)] + [(4, 0, "user", "long " * 200_000 + "."), (4, 1, "assistant", "ok.")]
    same(repair.repair_report(rows_of(spark, rows)), rows)


def test_empty(spark):
    assert repair.repair_report(rows_of(spark, [(1, 1, "u", "x")]).limit(0)).collect() == []


def test_repaired_turns(spark):
    rows = rows_of(spark, [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, "user", "So?"), (2, 0, "user", "")])
    plans = repair.audited(rows, rows)
    assert sorted(map(tuple, plans.select("conv_id", "cost", "audit").collect())) == [(1, 4, "RDR"), (2, 2, "D")]
    found = [tuple(r) for r in repair.repaired(rows, plans).orderBy("conv_id", "turn").collect()]
    assert found == [(1, 0, "user", "Hi."), (1, 1, "assistant", "So?")]


def test_query_against_brute_force(spark):
    from tracemill.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries()["op13_repair_dawg"](spark, sf), rows)
