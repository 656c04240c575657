"""Entry points and a sample of registered queries against their SQL; ``BARFLOW_ALL=1`` runs all."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))
SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")

import __spark_entry__ as entry_points  # noqa: E402

SAMPLE = ["s2_bars_hourly", "k1_bar_positions", "j6_reconciled_positions", "e9_risk_gate", "m2_walk_forward", "t1_stream_bars"]
NAMES = sorted(entry_points.oracle_sql()) if os.environ.get("BARFLOW_ALL") else SAMPLE


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    out = entry_points.entry(spark)
    assert out.columns == ["symbol", "label", "n"] and out.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    from compare import connect, rows_of

    df = entry_points.queries()[name](spark, SF_DIR)
    cursor = connect(SF_DIR).execute(entry_points.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
