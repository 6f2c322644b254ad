"""The entry without the optional parts: every other query stays."""

import json
import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

CODE = "import json, __spark_entry__ as E; print(json.dumps([sorted(E.queries()), sorted(E.oracle_sql())]))"


def listed(folder):
    out = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": folder})
    return [set(x) for x in json.loads(out.stdout.splitlines()[-1])]


@pytest.mark.parametrize("gone", [("fleetscope/llm",), ("corpus_pipeline.py",), ("fleetscope/llm", "corpus_pipeline.py")])
def test_entry_without_optional_parts(tmp_path, gone):
    from fleetscope.plans.registry import oracle_sql, spark_queries
    copy = str(tmp_path / "copy")
    skip = {os.path.join(ROOT, g) for g in gone}
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if os.path.join(d, n) in skip or n in (".git", "__pycache__")])
    queries, oracles = listed(copy)
    assert set(spark_queries()) <= queries and set(oracle_sql()) <= oracles
    assert "pipeline" not in queries and ("fleetscope/llm" not in gone or queries == set(spark_queries()))
