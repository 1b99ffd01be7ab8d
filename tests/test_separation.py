"""The ledger without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["hearthbook/llm"], ["hearthbook/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_the_rest_imports_alone(tmp_path, gone):
    out = tmp_path / "copy"
    shutil.copytree(ROOT / "hearthbook", out / "hearthbook", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, out / name)
    for name in gone:
        path = out / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = (
        "import __spark_entry__ as e, hearthbook.plans as p; q, s = e.queries(), e.oracle_sql();"
        "assert set(p.QUERIES) <= set(q) and set(s) <= set(q) and 'pipeline' not in q; print(len(q))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=out, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for file in (ROOT / "hearthbook").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT / "hearthbook").parts:
            assert "llm" not in file.read_text().replace("hearthbook-llm", "")
