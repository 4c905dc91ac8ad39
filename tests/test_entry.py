import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_without_the_training_data_subpackage(tmp_path):
    """The rest imports and lists its queries when the subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "sparkwell", tmp_path / "sparkwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_topk' in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
