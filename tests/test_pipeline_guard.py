"""The rest works without the llm folders and the pipeline, and an error within them is not swallowed."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 30 and set(o) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"


@pytest.fixture
def bare(tmp_path):
    """A copy of the repository without what the driver deletes."""
    for name in ("fieldspark", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def run(home, *command):
    return subprocess.run([sys.executable, "-B", *command], cwd=home, capture_output=True, text=True, timeout=900)


def test_entry_imports_without_llm(bare):
    assert run(bare, "-c", CODE).returncode == 0
    (bare / "fieldspark/llm").mkdir()  # left behind empty
    assert run(bare, "-c", CODE).returncode == 0


def test_the_other_tests_pass_without_llm(bare):
    files = [f"tests/test_{name}.py" for name in ("bins", "vertical", "sources", "oracle")]
    done = run(bare, "-m", "pytest", *files, "-x", "-q", "-p", "no:cacheprovider", "-k", "not equals_sql or lon_wrap or bin_max")
    assert done.returncode == 0, done.stdout[-2000:]


def test_an_error_within_llm_is_raised(bare):
    (bare / "fieldspark/llm").mkdir()
    (bare / "fieldspark/llm/__init__.py").touch()
    (bare / "fieldspark/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    done = run(bare, "-c", CODE)
    assert done.returncode and "a_module_that_is_not_there" in done.stderr
