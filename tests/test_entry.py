import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from lumenframe import plans

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def same(a, b):
    return a is None and b is None or a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a)) or str(a) == str(b)


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_equals_sql(spark, name):
    rows = __spark_entry__.queries()[name](spark, DATA)
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(rows.columns)
    plain = lambda r: tuple(str(x) if isinstance(x, (int, bool)) or x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    a, b = sorted(map(plain, rows.select(*[f"`{n}`" for n in names]).collect())), sorted(map(plain, got.fetchall()))
    assert a == b


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 25


def test_the_rest_works_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'worksheet' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "lumenframe").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*llm", p.read_text(), re.M), p
