import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def run(folder):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


def test_entry_with_and_without_the_subpackage(tmp_path):
    ignore = shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".hypothesis", ".pytest_cache")
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=ignore)
    shutil.rmtree(copy / "veritab" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    total, ops, pipeline, known = run(copy)
    assert int(total) >= 45 and (ops, pipeline, known) == ("0", "False", "True")


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "veritab").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "veritab.llm" not in path.read_text(), path
