import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare, connection

from sortalis.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    got, want = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_the_entry_works_without_the_subpackage(tmp_path):
    root = Path(__file__).parent.parent
    for p in ("sortalis", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(root / p) if p.endswith(".py") else None
    code = "import sys; sys.modules['sortalis.llm'] = None; import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op')] and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).parent.parent / "sortalis"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "sortalis.llm" not in p.read_text()
