"""The driver's contract: keys, SQL and the flagship query."""

import os
import subprocess
import sys

import __spark_entry__ as entry
from typeframe import queries as core

REPO = os.path.dirname(os.path.abspath(entry.__file__))


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.queries()) == set(core.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() == 25


def test_core_stands_alone(tmp_path):
    """Without the training-data operators the rest imports."""
    code = "import sys; sys.modules['typeframe.llm'] = None\nimport importlib.util as u; f = u.find_spec\nu.find_spec = lambda n, *a: None if n in ('typeframe.llm', 'corpus_pipeline') else f(n, *a)\nimport __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
