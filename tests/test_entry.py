"""The driver's contract: every query is listed, with or without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"


def test_queries_without_the_optional_folders(tmp_path):
    for name in ("larkspur", "__spark_entry__.py", "corpus_pipeline.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif src.exists():
            shutil.copy(src, tmp_path / name)
    got = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert got.returncode == 0, got.stderr
    assert "bm25_topk" in got.stdout and "pipeline" not in got.stdout and "op1_" not in got.stdout


def test_oracles_name_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
