"""Closed forms against the folds they stand for."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetquery.operators import folds, intervals

FEW = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


@FEW
@given(st.lists(st.booleans(), min_size=1, max_size=30))
def test_streaks(spark, reports):
    risk = healthy = 0
    cleared = None
    for n, risky in enumerate(reports):
        if risky:
            risk, healthy = risk + 1, 0
        else:
            healthy += 1
            if healthy >= 2:
                risk, cleared = 0, n if cleared is None else min(cleared, n)
    df = spark.createDataFrame([(1, n, r) for n, r in enumerate(reports)], "k int, n int, risky boolean")
    got = folds.risk_streaks(df, "k", ["n"], F.col("risky"), F.col("n")).first()
    assert (got.risk_streak, got.healthy_streak, got.cleared_at) == (risk, healthy, cleared)


@FEW
@given(st.lists(st.floats(0.001, 1e4), min_size=1, max_size=40))
def test_ewma(spark, samples):
    state = 0.0
    for x in samples:
        state = x if state <= 0 else state * 0.8 + x * 0.2
    df = spark.createDataFrame([(1, n, x) for n, x in enumerate(samples)], "k int, n int, x double")
    assert folds.ewma(df, ["k"], ["n"], F.col("x"), 0.2).first().ewma == pytest.approx(state)


@FEW
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), max_size=25))
def test_coalesce(spark, spans):
    held = {p for s, n in spans for p in range(s, s + n)}
    want, at = [], None
    for p in sorted(held):
        if at is None or p != at:
            want.append([p, p + 1])
        want[-1][1] = at = p + 1
    df = spark.createDataFrame([(1, s, s + n) for s, n in spans], "k int, start long, end long")
    assert sorted([r.start, r.end] for r in intervals.coalesce(df, ["k"]).collect()) == want
