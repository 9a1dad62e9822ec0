"""A sample of the registered queries against their SQL; ``compare.py`` runs all of them."""

import pytest
from compare import differences
from conftest import SMALL

import __spark_entry__ as entry

CHECKED = [
    "performance_metrics", "clean_bars", "validate_bars", "equity_curve_ticks", "filled_panel", "correlation_matrix", "symbol_lookup", "regime_rule_labels",
    "chronological_split", "read_bars",
]


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", CHECKED)
def test_query_equals_sql(spark, con, key):
    assert differences(entry.queries()[key](spark, SMALL), con, entry.oracle_sql()[key]) == []


def test_entry(spark):
    assert {"symbol", "sharpe_ratio"} <= set(entry.entry(spark).columns)


def test_import_without_the_corpus_part(tmp_path):
    """The library and its queries work where the optional part has been taken away."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "barweave", tmp_path / "barweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
