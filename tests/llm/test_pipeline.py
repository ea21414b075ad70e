"""The pipeline on a small corpus with a known answer, and the entry point without it."""

import os
import shutil
import subprocess
import sys

import pytest

import corpus_pipeline
from tests.llm.helpers import docs, prose
from tests.llm.test_packing import check

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """90 clean texts, 40 junk, copies of the first ten, leaks of three items, personal data."""
    at = str(tmp_path_factory.mktemp("sf"))
    items = [prose(9000 + i, 30) for i in range(3)]
    clean = [prose(k, 80 + k) for k in range(90)]
    junk = [" ".join(w.upper() + "!!" for w in prose(300 + k, 70).split()) for k in range(40)]
    copies = [c if k % 2 else c + " tail" for k, c in enumerate(clean[:10])]
    leaks = [f"{prose(600 + k, 50)} {items[k % 3]} {prose(700 + k, 50)}" for k in range(6)]
    private = [f"{prose(800 + k, 60)} a{k}@mail.example.com {prose(820 + k, 20)}" for k in range(4)]
    texts = clean + junk + copies + leaks + private + [None]
    d = docs(spark, texts)
    d.write.parquet(f"{at}/documents.parquet")
    y = [1] * 90 + [0] * 40
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, texts


def test_stages_decide_and_keep_columns(spark, corpus):
    at, texts = corpus
    own = spark.read.parquet(f"{at}/documents.parquet")
    names, kept = own.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = corpus_pipeline.materialise(stage(spark, own, at), "test")
        assert own.columns == names
        kept[name] = {r.doc_id: r.text for r in own.select("doc_id", "text").collect()}
    clean, copies, leaks, private, empty = set(range(90)), set(range(130, 140)), set(range(140, 146)), set(range(146, 150)), 150
    assert set(kept["quality classifier"]) - {empty} == clean | copies | leaks | private
    assert set(kept["near duplicates"]) - {empty} == clean | leaks | private
    assert set(kept["decontamination"]) - {empty} == clean | private
    last = kept["personal data"]
    assert set(last) - {empty} == clean | private
    assert all(("@" not in last[i] and "<EMAIL>" in last[i]) for i in private) and all(last[i] == texts[i] for i in clean)


def test_run_packs_what_the_stages_keep(spark, corpus):
    at, _ = corpus
    rows = corpus_pipeline.run(spark, at).collect()
    own = sorted({r.doc_id for r in rows})
    assert set(own) - {150} == set(range(90)) | set(range(146, 150))
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 4096) + 1


def test_rows_that_share_an_id_leave_one(spark, corpus):
    at, _ = corpus
    d = docs(spark, [prose(1, 40), prose(2, 40)]).unionByName(docs(spark, [prose(1, 40)]))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, at).collect()) == [0, 1]


def test_packing_of_the_last_stage(spark, corpus):
    at, texts = corpus
    own = docs(spark, [t for t in texts[:40]])
    assert check(corpus_pipeline.pack(spark, own, at).collect(), texts[:40]) >= 1


def test_entry_works_without_the_text_operators(tmp_path):
    for name in ("driftlog", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
