"""Registered queries against their SQL restatement.

By default a cross-section runs on the smallest tables; TEST_ALL=1 runs every query and
TEST_SF_DIR chooses the tables.
"""

import math
import os

import pytest

from tapewright.queries import ORACLES, QUERIES

SAMPLE = [
    "q00_leaders_against_market", "s02_bar_conform", "s03_panel_build", "s06_sheet_conform", "s08_column_aliases",
    "s11_delivery_conform", "s12_deals_conform", "s21_message_high_water", "w01_gap_segments", "w09_relative_strength",
    "w11_percentile_rank", "w12_score_deciles", "w17_horizon_labels", "w20_trade_resolution", "w22_leader_history",
    "w28_ledger_bar_walk", "w29_date_runs", "x04_pattern_score", "x11_total_score", "x12_reasoning_text",
    "x17_checks_and_tier", "a03_delivery_averages", "a09_decile_table", "a10_precision_at_10", "a16_parameter_search",
    "a20_weight_generation", "a23_mention_precedence", "a25_exit_rule_table", "a29_cohorts", "j02_sheet_assembly",
    "j12_next_own_bar", "j19_symbol_mentions", "d05_missing_ranges", "r05_recommendations",
    "st1_message_ingest", "st1b_mention_windows", "st2_ledger_stream", "st3_stream_upsert", "s20_screener_weights",
    "d02_previous_trading_day", "a34_ledger_context", "j17_sheet_diff", "a31_sheet_changes", "p06_setup_presets",
]


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}") + 0.0
    return value if isinstance(value, (int, bool)) else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: [(x is None, str(type(x)), x) for x in r if True])


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("TEST_ALL") else SAMPLE)
def test_matches_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert sorted(map(repr, got[1])) == sorted(map(repr, want[1]))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_import_needs_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
