"""A cross-section of the registered queries against DuckDB at the smallest scale.

``python tests/oracle.py`` runs all of them at scale factor 0.01.
"""

from __future__ import annotations

import pytest
from oracle import compare, connect

from tallyforge.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "src6_dataset_fingerprint", "nrm5_parse_datetime_text", "prf6_numeric_kpis", "prf9_categorical_kpis", "prf14_validation_report",
    "prf26_classify_domain", "cln1_drop_duplicates", "kpi4_role_distinct", "trd2_period_growth", "trd10_pct_change_spikes",
    "agg7_correlation_matrix", "anm7_density_noise", "cht4_bar", "ml8_linear_forecast", "qa2_resolve_columns",
    "txt2_language_purity", "j4_latest_per_key", "u2_quota_check", "u4_rate_limit", "st1_stream_usage",
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    fn, text = REGISTRY[name]
    assert compare(spark, duck, name, fn, text, FOLDER) is None


def test_every_query_has_a_callable_and_no_forbidden_name():
    assert all(callable(fn) for fn, _ in REGISTRY.values())
    assert len(REGISTRY) > 150
