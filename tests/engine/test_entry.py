"""The registry without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path


def test_other_queries_work_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "sylvan", tmp_path / "sylvan", ignore=lambda d, names: [n for n in names if n == "__pycache__" or n == "llm" and Path(d).name == "sylvan"])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert len(q) > 60 and set(e.oracle_sql()) <= set(q)"
    for kept in (["__spark_entry__.py", "corpus_pipeline.py"], ["__spark_entry__.py"]):
        for p in tmp_path.glob("*.py"):
            p.unlink()
        for name in kept:
            if (root / name).exists():
                shutil.copy(root / name, tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
