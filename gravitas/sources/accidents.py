"""The accident table derived from the ``events`` table, and predictions on it made by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravitas.sources.tables import scan_table

# Integer arithmetic only, so that Spark and DuckDB give the same rows. Placeholders are spelt per engine.
ACCIDENTS_SQL = """
select event_id, {date} as crash_date,
  cast(case when event_id % 997 = 5 then 24 else hour(ts) end as int) as crash_hour,
  cast({day} as int) as crash_day_of_week, cast(month(ts) as int) as crash_month,
  case when event_id % 13 = 0 then null
       else case when user_id % 10 < 6 then 'CLEAR' else upper(event_type) end end as weather_condition,
  case when event_id % 5 < 3 then null else 'DEFECT_' || cast(user_id % 3 as {text}) end as road_defect,
  cast(case when event_id % 11 = 0 then null
       else 1 + user_id % 3 + case when event_id % 17 = 0 then 7 else 0 end end as bigint) as num_units,
  case when value >= 140 then 1 else 0 end as injuries_fatal,
  cast(floor(value / 90) as int) as injuries_incapacitating,
  cast(floor(value / 40) as int) as injuries_non_incapacitating,
  case when user_id % 4 = 0 then 1 else 0 end as injuries_reported_not_evident,
  cast(case when event_id % 19 = 0 then null else
    (case when value >= 140 then 1 else 0 end) + cast(floor(value / 90) as int) + cast(floor(value / 40) as int)
    + (case when user_id % 4 = 0 then 1 else 0 end) - (case when event_id % 101 = 3 then 1 else 0 end) end as int)
    as injuries_total,
  case when value >= 140 then 'FATAL' when value >= 90 then 'INCAPACITATING INJURY'
       when value >= 40 then 'NONINCAPACITATING INJURY' else 'NO INDICATION OF INJURY' end as most_severe_injury
from {events}
"""

def spark_accidents_sql(events: str) -> str:
    return ACCIDENTS_SQL.format(
        date="date_format(ts, 'MM/dd/yyyy hh:mm:ss a')", day="weekday(ts) + 1", text="string", events=events
    )


def duckdb_accidents_sql() -> str:
    return ACCIDENTS_SQL.format(
        date="strftime(ts, '%m/%d/%Y %I:%M:%S %p')", day="isodow(ts)", text="varchar", events="events"
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(spark, f"{sf_dir}/events.parquet")


def accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(spark_accidents_sql("{events}"), events=events(spark, sf_dir))


# Three rule-based stand-in models: on rows where the rule holds, the model predicts a shifted class.
SHIFT_RULES = {
    "Logistic Regression": "event_id % 5 = 0",
    "Decision Tree": "event_id % 7 = 0 or user_id % 9 = 0",
    "Random Forest": "event_id % 11 = 0",
}

CLASSED_SQL = """
select event_id, user_id,
  case when value >= 140 then 3 when value >= 90 then 2 when value >= 40 then 1 else 0 end as actual from {events}
"""

PREDICTED_SQL = "cast(case when shifted then (actual + 1 + event_id % 2) % 4 else actual end as int)"


def score_sql(k: int) -> str:
    """Score of class ``k``; the predicted class always has the highest."""
    return f"cast(1 + (event_id * {(3, 5, 7, 11)[k]}) % 17 + case when predicted = {k} then 20 else 0 end as double)"


def _probabilities() -> list[str]:
    return [f"s{k} / (s0 + s1 + s2 + s3) as p{k}" for k in range(4)]


def duckdb_predictions_ctes() -> list[tuple[str, str]]:
    per_model = " union all ".join(
        f"select event_id, actual, '{m}' as model, {rule} as shifted from classed" for m, rule in SHIFT_RULES.items()
    )
    scores = ", ".join(f"{score_sql(k)} as s{k}" for k in range(4))
    return [
        ("classed", CLASSED_SQL.format(events="events")),
        ("shifts", per_model),
        ("predicted_classes", f"select event_id, model, actual, {PREDICTED_SQL} as predicted from shifts"),
        ("predicted_scores", f"select *, {scores} from predicted_classes"),
        ("predictions", f"select event_id, model, actual, predicted, {', '.join(_probabilities())} from predicted_scores"),
    ]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the events table as scored by three stand-in models: model, actual, predicted, p0..p3."""
    classed = spark.sql(CLASSED_SQL.format(events="{events}"), events=events(spark, sf_dir))
    shifts = [F.struct(F.lit(m).alias("model"), F.expr(rule).alias("shifted")) for m, rule in SHIFT_RULES.items()]
    per_model = classed.select("event_id", "actual", F.inline(F.array(*shifts)))
    scored = per_model.withColumn("predicted", F.expr(PREDICTED_SQL)).selectExpr(
        "event_id", "model", "actual", "predicted", *[f"{score_sql(k)} as s{k}" for k in range(4)]
    )
    return scored.selectExpr("event_id", "model", "actual", "predicted", *_probabilities())
