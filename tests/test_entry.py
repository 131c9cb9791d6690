import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_parts(tmp_path):
    """A copy without the training-data subpackage still imports and has the genotype queries."""
    shutil.copytree(ROOT / "strandloom", tmp_path / "strandloom", ignore=shutil.ignore_patterns("llm"))
    (tmp_path / "strandloom" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) == len(e.oracle_sql()) >= 56 and 'pipeline' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).returncode == 0
