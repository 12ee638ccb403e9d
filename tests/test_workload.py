"""Registered queries beside their SQL on the smallest tables."""

import os

import pytest

from tools.check import compare, connect
from workload.all import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["would_skip_by_verdict", "gate_rule_decisions", "addressee_decisions", "parsed_intents",
          "student_headline", "act_thresholds", "voice_activity", "bench_summary",
          "conversation_snapshots", "linked_components", "voice_threshold_sweep", "teacher_labels",
          "decision_records", "addressee_explanations", "expanded_recipes", "extended_catalogue",
          "gate_shadow_report", "fast_slow_report", "addressee_auc", "gate_skip_threshold", "text_decisions"]
#: WORKLOAD=all runs every query that has SQL (some ten minutes); tools/check.py does so as well.
NAMES = sorted(ORACLES) if os.environ.get("WORKLOAD") == "all" else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    _, verdict = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert verdict == "ok"


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) and set(SAMPLE) <= set(ORACLES)
