"""The driver's entry points."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and all(0 <= r["auc"] <= 1 for r in rows)


def test_works_without_the_training_data_operators(tmp_path):
    """With the subpackage and the pipeline gone, the other queries are still registered."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "weftgraph", tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    for keep_pipeline in (False, True):
        if keep_pipeline and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
