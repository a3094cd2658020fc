import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import oracle

import __spark_entry__
from larkspur.queries import load

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    made = QUERIES[name](spark, oracle.SF)
    result = duck.execute(ORACLES[name])
    expected = oracle.table([d[0] for d in result.description], result.fetchall())
    assert oracle.table(made.columns, [tuple(r) for r in made.collect()]) == expected
    assert expected[1], "the query is over no rows"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, oracle.SF).count() > 0


def test_without_the_training_data_operators(tmp_path):
    """The entry works where larkspur/llm and corpus_pipeline.py are gone."""
    import shutil
    import subprocess

    root = Path(__file__).parent.parent
    shutil.copytree(root / "larkspur", tmp_path / "larkspur", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and o and 'pipeline' not in q and not [x for x in q if x.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 18
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
