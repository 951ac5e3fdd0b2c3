"""Every query of the registry: against its SQL, or that it runs."""

import pytest
from compare import compare, connect

from docframe import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    if name in SQL:
        compare(spark, con, sf, QUERIES[name], SQL[name])
    else:
        df = QUERIES[name](spark, sf)
        assert df.columns and df.count() >= 0


def test_entry_without_the_llm_folders(tmp_path):
    """The registry of queries imports and answers where corpus_pipeline.py and the llm folder are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "docframe"), tmp_path / "docframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
