"""The driver's contract."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 80 and all(callable(f) for f in queries.values())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["address", "issuance_id", "ledger", "balance", "status", "beyond_coverage"]
    assert df.filter("status = 'success'").count() > 0


def test_without_the_optional_parts(monkeypatch):
    monkeypatch.setattr(__spark_entry__.importlib.util, "find_spec", lambda name: None)
    queries = __spark_entry__.queries()
    assert "rpt1_balance_at" in queries and not any(name.startswith("op") or name == "pipeline" for name in queries)
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


@pytest.mark.parametrize("gone", [("ledgerloom/llm", "tests/llm"), ("ledgerloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_after_deletion(tmp_path, gone):
    """What is left of a copy without the corpus folders still imports and names its queries."""
    root, copy = Path(__file__).resolve().parents[1], tmp_path / "copy"
    copy.mkdir()
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, copy)
    for name in ("ledgerloom", "tests"):
        shutil.copytree(root / name, copy / name, ignore=shutil.ignore_patterns("__pycache__"))
    for name in gone:
        shutil.rmtree(copy / name, ignore_errors=True) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, sql = json.loads(done.stdout)
    assert len(queries) >= 80 and set(sql) <= set(queries)
    assert not any(name.startswith("op") or name == "pipeline" for name in queries)
