"""The driver's contract, with and without the optional subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert {"p2_found", "p4_found", "p6_found", "p7_found", "p5_features"} <= set(q)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_subpackage():
    for f in (REPO / "loomlog").rglob("*.py"):
        if "llm" not in f.relative_to(REPO / "loomlog").parts:
            assert not re.search(r"loomlog\.llm|from \.llm|import llm", f.read_text()), f


def test_entry_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['loomlog.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q; print(len(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=60)
    assert got.returncode == 0, got.stderr
