"""Properties that keep the library usable on a large cluster."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from gravitas.plans import catalog

PACKAGE = Path(__file__).resolve().parent.parent / "gravitas"
SOURCES = {p: p.read_text() for p in PACKAGE.rglob("*.py")}


@pytest.mark.parametrize("banned", [r"\.toPandas\(", r"localCheckpoint", r"crossJoin\(", r"\.rdd\b", r"F\.udf\(", r"\.sample\("])
def test_banned_calls(banned):
    assert not [str(p) for p, text in SOURCES.items() if re.search(banned, text)]


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["crosstab_counts", "risk_slots", "interaction_counts", "confusion_matrix", "severity_rate_by_hour", "domain_rules"]
)
def test_no_nested_loops(spark, sf, name):
    plan = executed(catalog.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark, sf):
    plan = executed(catalog.queries()["rush_hour_totals"](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_filters_reach_the_scan(spark, sf):
    from pyspark.sql import functions as F

    from gravitas.sources.accidents import events

    plan = executed(events(spark, sf).where(F.col("event_id") > 990).select("event_id"))
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,990)]" in plan
