import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 792
    assert df.columns == ["seq", "hash", "offset", "pfx", "key", "db_index", "table_name"]


def test_queries_and_sql():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q)


def test_imports_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "msgledger", tmp_path / "msgledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.oracle_sql()) > 40)"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert got.stdout.strip() == "[] True", got.stderr
