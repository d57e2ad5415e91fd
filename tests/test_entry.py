"""The driver's contract, with and without the training-data operators."""

import importlib.util
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HAS_LLM = importlib.util.find_spec("shardflow.llm") is not None


def load():
    spec = importlib.util.spec_from_file_location("entry_under_test", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_flagship(spark):
    df = load().entry(spark)
    assert df.columns == ["key", "value"] and df.count() > 0


def test_oracles_have_queries():
    m = load()
    assert set(m.oracle_sql()) <= set(m.queries())
    if HAS_LLM:
        assert {n.split("_")[0] for n in m.queries() if n[:2] == "op" and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)}
        assert "pipeline" in m.queries()


def test_nothing_else_imports_the_operators():
    for d, _, names in os.walk(f"{ROOT}/shardflow"):
        for n in names:
            if n.endswith(".py") and "/llm" not in d:
                assert "shardflow.llm" not in open(f"{d}/{n}").read()


@pytest.mark.parametrize("names", [["corpus_pipeline.py", "shardflow/llm"], ["shardflow/llm"], ["corpus_pipeline.py"]])
def test_entry_without_the_operators(tmp_path, names):
    shutil.copytree(f"{ROOT}/shardflow", tmp_path / "shardflow", ignore=shutil.ignore_patterns("__pycache__"))
    for n in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{n}"):
            shutil.copy(f"{ROOT}/{n}", tmp_path)
    for n in names:
        p = tmp_path / n
        shutil.rmtree(p, True) if p.is_dir() else p.unlink(missing_ok=True)
    code = "import __spark_entry__ as m; q = m.queries(); assert 'word_count' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); m.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
