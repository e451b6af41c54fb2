"""Registered queries against their SQL, with chunks far narrower than the data so that every edge is crossed."""

import pytest

import __spark_entry__ as entry
from driftline.plans.check import compare

SF = "/root/testdata/sf0.001"
NAMES = ["daily_state_budget", "r1_segments_min_duration", "r3_gaps_between_segments", "r5_mask_periods", "r8_reject_spans", "a1_segment_statistics", "i1_clip_children",
         "i3_merge_near_spans", "i6_complement", "i11_paint_samples", "j1_nearest_asof", "t9_fill_short_gaps", "a23_lag_curve", "w2_vedba", "w5_running_median", "w7_local_z",
         "z2_zero_offset", "k6_kernel_smooth", "h2_refine_peaks", "h8_conflict_pairs", "h14_candidate_features", "g9_context_filters", "l3_even_subsample"]


def test_every_query_has_a_callable_and_known_oracle():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200 and len(o) > 170


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(narrow, name):
    ok, note, _ = compare(narrow, SF, name)
    assert ok, note
