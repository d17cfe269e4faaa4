"""Every registered query of the scorecard side against its SQL."""

import pytest

import __spark_entry__ as entry
from oddsmill.plans import queries as Q

from . import compare


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_agrees_with_its_sql(spark, con, sf_dir, name):
    said = compare.differences(spark, con, name, Q.QUERIES[name], Q.SQL[name], sf_dir)
    assert said is None or said.startswith("~"), said


def test_every_query_is_registered():
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "oddsmill"), tmp_path / "oddsmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'woe_table' in e.queries() and not any(q.startswith('op1') for q in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
