"""Every stage against brute force on what the stage before kept."""

import duckdb
import pytest
from fixtures import EXTRA
from test_dedup import groups, without_windows
from test_native import overlaps
from test_tokens import check_packing

import __spark_entry__ as driver
import corpus_pipeline
from tasteloom.llm import quality

FOLDER = "/root/testdata/sf0.001"


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def passed(spark, tmp_path_factory):
    """The input of each stage, and the result of the last, with extra columns all the way."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", *[f"'z' as {c}" for c in EXTRA])
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_are_kept(passed):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "harmonic_packing"]
    for df in passed[1:-1]:
        assert df.dtypes == passed[0].dtypes


def test_quality_stage(spark, passed):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.quality_scores(passed[0], labels).collect()}
    assert sorted(texts(passed[1])) == sorted(t for t in texts(passed[0]) if scores[t[0]] >= 0.3)
    bad = {i for i, q in duckdb.connect().execute(f"select doc_id, quality from '{FOLDER}/labels.parquet'").fetchall() if not q}
    kept = {i for i, _ in texts(passed[1])}
    assert len(bad & kept) <= 0.1 * len(bad) and 0 < len(kept) < 200


def test_near_dedup_stage(passed):
    rows = texts(passed[1])
    found = groups(rows)
    assert sorted(texts(passed[2])) == sorted(r for r in rows if found[r[0]] == r[0])


def test_substring_stage(passed):
    rows = texts(passed[2])
    before = dict(rows)
    want = [(i, kept if gone else before[i]) for i, n, gone, kept in without_windows(rows) if not (gone and not kept)]
    assert sorted(texts(passed[3])) == sorted(want)
    lengths = {r.doc_id: (r.n_chars, len(r.text)) for r in passed[3].collect()}
    assert all(a == b for a, b in lengths.values())


def test_decontamination_stage(passed):
    items = duckdb.connect().execute(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    rows = texts(passed[3])
    gone = {i for i, _ in overlaps(rows, items)}
    assert sorted(texts(passed[4])) == sorted(r for r in rows if r[0] not in gone)


def test_packing_stage(passed):
    check_packing(passed[5].collect(), texts(passed[4]), 4096)


def test_registered_query_runs_all_stages(spark, passed):
    rows = driver.queries()["pipeline"](spark, FOLDER).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, passed[5].collect()))


def test_without_the_packages_the_rest_works(tmp_path):
    """The entry module in a copy of the repository that lacks both folders and the pipeline."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(driver.__file__)
    shutil.copytree(f"{root}/tasteloom", tmp_path / "tasteloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') or k == 'pipeline' for k in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.stdout.split() == [str(len(driver.queries()) - 11), "False"], done.stderr
