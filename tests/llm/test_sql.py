import compare
import pytest

from pagegrain.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert compare.difference((queries.queries() | queries.base_queries())[name](spark, sf_dir), compare.connect(sf_dir), queries.oracle_sql()[name]) is None


def test_thirteen_operators():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))


def test_entry_lives_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[2]
    for name in ("__spark_entry__.py", "pagegrain"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "pagegrain" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
