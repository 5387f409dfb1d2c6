"""The entry lists the library's own queries whatever optional modules are missing."""

import subprocess
import sys
from pathlib import Path

import pytest

from perilgrid.catalog import all_checks, all_queries

ROOT = str(Path(__file__).resolve().parents[1])


@pytest.mark.parametrize("missing", ["public_tokenizers", "perilgrid.llm", "corpus_pipeline", None])
def test_queries_without_optional_modules(missing):
    gone = f"import sys; sys.modules[{missing!r}] = None; " if missing else ""
    code = gone + "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    names, checks = (set(line.split()) for line in out.stdout.strip().splitlines()[-2:])
    assert set(all_queries()) <= names and set(all_checks()) <= checks <= names


def test_a_fault_of_our_own_is_not_hidden():
    code = "import sys; sys.modules['perilgrid.session'] = None; import __spark_entry__"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "perilgrid.session" in out.stderr
