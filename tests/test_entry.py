import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(callable(f) for f in __spark_entry__.queries().values())


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["pid", "z", "region_index"] and df.count() > 0


def test_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'points_ellipse_to_mllw' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
