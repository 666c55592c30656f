import pytest

import corpus_pipeline
from tests.helpers import same_as_duckdb
from tracemill.llm import bpe, neardup, templates, wumanber
from tracemill.llm.queries import BPE_FILE, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_duckdb(spark, name):
    same_as_duckdb(spark, queries()[name], oracle_sql()[name], SF)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [r for r in queries()["op7_quality_rules"](spark, SF).collect() if r["kept"]]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    now = templates.brute_force([(r["doc_id"], text[r["doc_id"]]) for r in kept])
    now = {d: now[d] for d, _, _, keep in neardup.brute_force([*now.items()]) if keep}
    now = {r[0]: now[r[0]] for r in wumanber.brute_force([*now.items()], bench) if not r[5]}
    own = bpe.WordBpe(bpe.read_spec(BPE_FILE))
    wanted = {d: len(own.ids(t)) for d, t in now.items()}
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == wanted


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name


ODD = "doc_id long, text string, lang string, source string, n_chars long, _q_words string, _Q_good int, _w_words string, _w_starts int"


@pytest.fixture(scope="module")
def odd_documents(spark, odd_rows):
    """Nulls, blanks, long texts, repeated rows and columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r[:5], "q", 1, "w", 2) for r in odd_rows], ODD)


def test_stages_on_odd_rows(spark, odd_documents):
    docs = odd_documents
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "encode":
            assert out.count() == docs.count()
            continue
        assert out.columns == docs.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert all(r[5:] == ("q", 1, "w", 2) for r in rows), name
        known = {(r[0], r[2], r[3], r[4]) for r in docs.collect()}
        assert {(r[0], r[2], r[3], r[4]) for r in rows} <= known and len(rows) <= before, name
        docs = spark.createDataFrame(rows, ODD)
        before = len(rows)
    assert before > 3


def test_several_benchmark_blocks_with_clashing_columns(spark, odd_documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda r: str(tuple(r))
    whole = sorted(wumanber.drop_contaminated(odd_documents, bench).collect(), key=key)
    assert whole == sorted(wumanber.drop_contaminated(odd_documents, bench, block_chars=3000).collect(), key=key)


def test_two_stages_lie_in_the_shared_folder(spark, tmp_path, monkeypatch):
    """Every finished stage is released, with what it wrote on its way."""
    from tracemill.llm import common

    seen = []
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))

    def watched(stage):
        def run(spark, docs, sf_dir):
            seen.append(len(list(tmp_path.iterdir())))
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(f)) for n, f in corpus_pipeline.STAGES])
    rows = corpus_pipeline.run(spark, SF).count()
    assert rows and seen == [0, 1, 1, 1, 1]
    assert len(list(tmp_path.iterdir())) == 1


def test_guard(tmp_path):
    """Without the text operators the entry module and its other queries still work."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[2]
    shutil.copytree(root / "tracemill", tmp_path / "tracemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'F16_log_features' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
