"""The rest of the library works where the training-data folders are gone, and never imports them."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_entry_without_training_data_operators(tmp_path):
    shutil.copytree(REPO / "keyloom", tmp_path / "keyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(s) <= set(q) and not any(n.startswith('op') for n in q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.stdout.strip().endswith("fine"), done.stderr


def test_other_tests_without_training_data_operators(tmp_path):
    """All other tests can be collected, and those of the functions pass."""
    for folder in ("keyloom", "tests"):
        shutil.copytree(REPO / folder, tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(REPO / name, tmp_path)
    for what in (["tests", "--collect-only"], ["tests/test_functions.py"]):
        done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *what], cwd=tmp_path, capture_output=True, text=True)
        assert done.returncode == 0, done.stdout


def test_nothing_else_imports_them():
    for path in (REPO / "keyloom").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "llm" not in path.read_text(), path


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
