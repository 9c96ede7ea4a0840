"""Column names, rules and thresholds of the road-accident preset."""

from __future__ import annotations

# Column contract of the accident table.
TARGET = "most_severe_injury"
DATE = "crash_date"
DATE_FORMAT = "MM/dd/yyyy hh:mm:ss a"
HOUR = "crash_hour"
DAY = "crash_day_of_week"
MONTH = "crash_month"
WEATHER = "weather_condition"
TOTAL = "injuries_total"

# Measures checked for outliers and capped.
OUTLIER_COLUMNS = ["injuries_total", "injuries_incapacitating", "injuries_non_incapacitating", "num_units"]

# Parts that must not add up to more than the injury total.
INJURY_PARTS = [
    "injuries_fatal",
    "injuries_incapacitating",
    "injuries_non_incapacitating",
    "injuries_reported_not_evident",
]
SEVERE_PARTS = ["injuries_fatal", "injuries_incapacitating"]

# Columns that get log1p when skew detection is off.
LOG_COLUMNS = ["injuries_total", "num_units"]

# Code to label.
DAY_NAMES = {1: "Monday", 2: "Tuesday", 3: "Wednesday", 4: "Thursday", 5: "Friday", 6: "Saturday", 7: "Sunday"}
DAY_ABBR = {1: "Mon", 2: "Tue", 3: "Wed", 4: "Thu", 5: "Fri", 6: "Sat", 7: "Sun"}
MONTH_ABBR = {
    1: "Jan", 2: "Feb", 3: "Mar", 4: "Apr", 5: "May", 6: "Jun",
    7: "Jul", 8: "Aug", 9: "Sep", 10: "Oct", 11: "Nov", 12: "Dec",
}
WEEKEND = (6, 7)

# Domain rules as (column, lowest, highest or None, description).
RULES = [
    ("crash_hour", 0, 23, "Hour of day (0-23)"),
    ("crash_day_of_week", 1, 7, "Day of week (1=Monday, 7=Sunday)"),
    ("crash_month", 1, 12, "Month (1-12)"),
    ("injuries_total", 0, None, "Total injuries (non-negative)"),
    ("injuries_fatal", 0, None, "Fatal injuries (non-negative)"),
]

# Thresholds of the profile and preparation steps.
STRONG_CORRELATION = 0.5
VERY_STRONG_CORRELATION = 0.8
COLLINEAR = 0.9
MOSTLY_NULL_PERCENT = 50.0
IQR_FACTOR = 1.5
SKEW_THRESHOLD = 1.0
BALANCED_BELOW = 2.0
SEVERE_FROM = 5.0
HIGH_CARDINALITY = 50
CATEGORICAL_BELOW = 20
SEED = 42
TEST_SIZE = 0.2
VALIDATION_SIZE = 0.1
NEIGHBOURS = 5
