"""Named checks and ratios of the summaries, with what is missing and what is zero."""

from __future__ import annotations

from readloom.plans import summaries


def passed(df):
    return {r.check: r.passed for r in df.collect()}


def test_target_checks(spark):
    plan = spark.createDataFrame([(1, 3, 2, 50), (2, 1, 0, 70)], "query_id long, raw long, chain_inputs long, cost long")
    assert set(passed(summaries.target_checks(plan, "cost", 60.0, 2.0, 100.0)).values()) == {True}
    got = passed(summaries.target_checks(plan, "cost", 0.0, 2.0, None))
    assert not got["selected_cost_exceeds_boundary"] and not got["hot_request_below_selected_cost"] and got["selected_has_raw_overlaps"]
    assert not any(passed(summaries.target_checks(plan.limit(0), "cost", 1.0, 2.0, 5.0)).values())


def test_skip_timing(spark):
    selected = spark.createDataFrame([(1,), (2,), (2,)], "query_id long")
    control = spark.createDataFrame([(1, 30.0, 10.0), (3, 500.0, 1.0), (2, 40.0, None), (2, 10.0, 10.0)], "query_id long, chain double, divergence double")
    skipped = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0, 50.0, 5.0), (2, 1.0, 1.0, 1.0, 1.0, 30.0, 2.0), (3, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0)], "query_id long, placeholder double, rebuild double, compare double, substitution double, request double, kernel double")
    r = summaries.skip_timing(selected, control, skipped).first()
    assert (r.selected, r.missing, r.skipped) == (2, 0, 2) and (r.fill_ms, r.cold_ms, r.hot_ms) == (14.0, 94.0, 21.0)
    assert r.control_ms == 100.0 and (r.cold_ratio, r.hot_ratio, r.cold_faster, r.hot_faster) == (0.94, 0.21, True, True)
    assert set(passed(summaries.skip_checks(summaries.skip_timing(selected, control, skipped))).values()) == {True}
    none = summaries.skip_timing(selected, control.limit(0), skipped.limit(0))
    assert none.first().cold_ratio is None and not any(passed(summaries.skip_checks(none)).values())
