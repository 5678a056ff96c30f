"""The driver's contract, with and without the text subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_session_and_without_text_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, '.')\nimport __spark_entry__ as e\nq = e.queries()\nassert len(q) > 100 and not any(x.startswith('op') for x in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_library_does_not_import_text_operators():
    for path in (ROOT / "faultline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "faultline.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
