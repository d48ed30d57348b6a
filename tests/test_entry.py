"""The entry module with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LOOK = "import __spark_entry__ as e; names = set(e.queries()); print(len(names), sorted(set(e.oracle_sql()) - names), sorted(n for n in names if n.startswith('op') and n[2].isdigit() or n == 'pipeline'))"


def looked(folder) -> str:
    return subprocess.run([sys.executable, "-c", LOOK], cwd=folder, capture_output=True, text=True, check=True).stdout


def copied(folder, *without: str) -> str:
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in without:
        path = folder / name
        shutil.rmtree(path) if path.is_dir() else path.unlink()
    return looked(folder)


def test_imports_without_the_training_data_operators(tmp_path):
    assert "op1_" not in (bare := copied(tmp_path / "a", "atril/llm", "tests/llm")) and bare.endswith("[] []\n")
    assert copied(tmp_path / "b", "atril/llm", "tests/llm", "corpus_pipeline.py") == bare


def test_every_oracle_has_a_query():
    assert " [] " in looked(ROOT)
