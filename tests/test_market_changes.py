"""Day levels from changes alone: against the day-by-entity panel and plain numpy."""

from __future__ import annotations

import collections
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.operators import ordering, panel, scans
from pricetide.plans import q_market, q_panel

SF = "/root/testdata/sf0.001"
DAY0 = dt.date(2024, 1, 1)


def days(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.mark.parametrize("seed", range(3))
def test_running_quantiles_against_numpy(spark, seed):
    rng = random.Random(seed)
    values = [0.0, -3.5, 1e-9, 100.0, 100.01, 100.02, 99.99, 250_000.0, 1e9, *(round(rng.uniform(90, 110), 2) for _ in range(20))]
    spans = [("k" if rng.random() < 0.7 else None, rng.choice(values), s := rng.randint(0, 30), s + rng.randint(0, 12)) for _ in range(200)]
    changes = [(k, v, days(s), 1) for k, v, s, _ in spans] + [(k, v, days(e + 1), -1) for k, v, _, e in spans]
    changes += [("k", None, days(3), 1), ("k", float("nan"), days(3), 1), ("z", 5.0, days(1), 1), ("z", 5.0, days(1), -1)]
    df = spark.createDataFrame(changes, "key string, v double, day date, by int")
    got = ordering.running_quantiles(df, ["key"], "day", "v", "by", {"low": 0.1, "mid": 0.5, "top": 1.0}, count="n", mean="mean")
    held = collections.defaultdict(list)
    for k, v, s, e in spans:
        for d in range(s, e + 1):
            held[k, days(d)].append(v)
    assert {(r.key, r.day): r.n for r in got.collect()} == {k: len(v) for k, v in held.items() if k[0]}
    for r in got.collect():
        own = held[r.key, r.day]
        assert (r.low, r.mid, r.top) == pytest.approx(tuple(np.quantile(own, [0.1, 0.5, 1.0])), rel=1e-12)
        assert r.mean == pytest.approx(np.mean(own), rel=1e-9, abs=1e-8)


def test_running_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "key string, v double, day date, by int")
    assert ordering.running_quantiles(df, ["key"], "day", "v", "by", {"mid": 0.5}).count() == 0


def test_spans_laid_out_are_the_panel(spark):
    spans = q_panel.spans_frame(spark, SF)
    laid = spans.select("population", "property_id", "price", F.explode(F.sequence("start_day", "end_day")).alias("day"))
    want = q_panel.panel_frame(spark, SF).select(*laid.columns)
    assert laid.exceptAll(want).count() == want.exceptAll(laid).count() == 0


def test_runs_merge_only_when_they_adjoin_at_one_value(spark):
    rows = [("a", 0, 2, 1.0), ("a", 3, 4, 1.0), ("a", 6, 6, 1.0), ("a", 7, 8, 2.0), ("a", 9, 9, None), ("a", 10, 11, None), ("b", 5, 5, 2.0)]
    df = spark.createDataFrame([(k, days(s), days(e), v) for k, s, e, v in rows], "k string, s date, e date, v double")
    got = sorted((r.k, (r.s - DAY0).days, (r.e - DAY0).days, r.v) for r in scans.merge_runs(df, ["k"], "s", "e", "v").collect())
    assert got == [("a", 0, 4, 1.0), ("a", 6, 6, 1.0), ("a", 7, 8, 2.0), ("a", 9, 11, None), ("b", 5, 5, 2.0)]


def test_market_lays_no_entity_out_over_days(spark):
    """What the market reads of an entity is its spans; only a tenant's calendar is a sequence of days."""
    spans = q_panel.spans_frame(spark, SF)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan
    market = q_market.market_frame(spark, SF)
    plan = market._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "property_id" not in plan  # levels were written by tenant and day
    assert spans.count() < q_panel.panel_frame(spark, SF).count()
