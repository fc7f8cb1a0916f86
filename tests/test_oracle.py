"""Registered queries against their oracle. All of them with TIDEWISE_ALL=1, else a sample of every area."""

import os
import re

import pytest

from tests.oracle_check import compare, connect
from tidewise.plans.catalog import load

REGISTRY = load()
SAMPLE = """sector_bars_scan history_weekly registry_documents json_weights log_returns quantile_bins width_bins
effect_sentences moving_averages_ticks exponential_mean_ticks rsi growth_ticks forward_fill_ticks state_runs
macro_as_of exact_quantiles_raw feature_matrix scenario_run immediate_actions quick_shift backtest optimal_weights
holdings_valuation running_balance current_regime regime_statistics economic_cycle granger_lag_one
transfer_entropy graph_validation subgroup_effects unit_root_test weighted_ensemble stream_bars""".split()
ALL = os.environ.get("TIDEWISE_ALL") == "1"
SF = os.environ.get("TIDEWISE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in REGISTRY if ALL or n in SAMPLE])
def test_query(spark, con, name):
    result = compare(spark, con, REGISTRY[name], SF)
    assert result.startswith(("ok", "rows")), result


def test_every_inventory_id_is_registered():
    ids = {i for q in REGISTRY.values() for i in q.ids}
    expected = set()
    for letter, last in dict(S=11, P=23, F=10, J=12, A=28, W=21, T=9, U=6, C=10, E=12, M=10, R=10, X=9, N=11, L=6, V=1, ST=3).items():
        expected |= {f"{letter}{i}" for i in range(1, last + 1)}
    assert expected - ids == set()


def test_names_are_descriptive():
    assert not [n for n in REGISTRY if re.match(r"op\d", n) or "pipeline" in n]
