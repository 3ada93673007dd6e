"""Driver contract: entry() runs the flagship on sf0.001; the registry is consistent."""

import importlib.util
import os
import subprocess
import sys

import pytest

import __spark_entry__ as E

pytestmark = pytest.mark.skipif(not os.path.isdir(E.SMOKE_DIR), reason="driver test data not present")


def test_entry_returns_top_twenty_with_suggestions(spark):
    df = E.entry(spark)
    assert df.columns == ["customer_id", "risk_label", "risk_score", "suggestion"]
    rows = df.collect()
    assert len(rows) == 20
    scores = [r.risk_score for r in rows]
    assert scores == sorted(scores, reverse=True) and all(0.0 <= s <= 1.0 for s in scores)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("gone, left", [("retentio.llm", False), ("corpus_pipeline", True)])
def test_an_absent_subpackage_or_pipeline_is_passed_over(gone, left):
    """Without the subpackage only the core is registered; without the pipeline alone, its operators stay."""
    present = importlib.util.find_spec("retentio.llm") is not None
    code = (f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as E; "
            "names = set(E.queries()); assert 'pipeline' not in names and 'orders_rfm' in names; "
            f"assert any(n.startswith('op1_') for n in names) == {left and present}")
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(E.__file__), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
