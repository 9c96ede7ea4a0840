"""Queries of the profile: quality, distributions, contingency tables, correlations, outliers, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions.columns import decode, rounded
from gravitas.operators import correlation, crosstabs, distributions, outliers, quality, rules
from gravitas.plans.profile import Profile
from gravitas.plans.registry import on_accidents, query, r, with_ctes
from gravitas.sources.accidents import accidents
from gravitas.sources.tables import scan_table

COLUMNS = [
    "event_id", "crash_date", "crash_hour", "crash_day_of_week", "crash_month", "weather_condition", "road_defect",
    "num_units", "injuries_fatal", "injuries_incapacitating", "injuries_non_incapacitating",
    "injuries_reported_not_evident", "injuries_total", "most_severe_injury",
]
TEXT = ["crash_date", "weather_condition", "road_defect", "most_severe_injury"]
NUMERIC = [c for c in COLUMNS if c not in TEXT]
MEASURES = [
    "num_units", "injuries_fatal", "injuries_incapacitating", "injuries_non_incapacitating",
    "injuries_reported_not_evident", "injuries_total",
]
T = preset.TARGET


def union_all(parts) -> str:
    return " union all ".join(parts)


def null_cells() -> str:
    return " + ".join(f"sum(case when {c} is null then 1 else 0 end)" for c in COLUMNS)


@query(
    "dataset_overview",
    on_accidents(f"select count(*) as total_records, {len(COLUMNS) - 1}::bigint as features, "
                 f"count(distinct {T}) as target_classes from accidents"),
)
def _(spark, sf):
    return quality.dataset_overview(accidents(spark, sf), T)


DESCRIBED = f"(describe {on_accidents('select * from accidents')})"


@query(
    "dtype_summary",
    "select case column_type when 'VARCHAR' then 'string' when 'BIGINT' then 'bigint' else 'int' end as dtype, "
    f"count(*) as n_columns from {DESCRIBED} group by 1",
)
def _(spark, sf):
    return quality.dtype_summary(accidents(spark, sf))


@query(
    "select_by_type",
    "select column_name as feature, case column_type when 'VARCHAR' then 'categorical' else 'numeric' end as kind "
    f"from {DESCRIBED} where column_name <> '{T}'",
)
def _(spark, sf):
    return quality.select_by_type(accidents(spark, sf), T)


MISSING_TOTAL = f"select count(*) * {len(COLUMNS)} as cells, ({null_cells()})::bigint as missing_cells from accidents"


@query("missing_total", on_accidents(f"select cells, missing_cells, {r('missing_cells * 100.0 / cells')} as missing_percent from m",
                                     ("m", MISSING_TOTAL)))
def _(spark, sf):
    return rounded(quality.missing_total(accidents(spark, sf)).drop("complete_percent"))


@query("completeness", on_accidents(f"select {r('(cells - missing_cells) * 100.0 / cells')} as complete_percent from m",
                                    ("m", MISSING_TOTAL)))
def _(spark, sf):
    return rounded(quality.missing_total(accidents(spark, sf)).select("complete_percent"))


@query(
    "duplicate_rows",
    with_ctes(
        "select t as total_rows, t - d as duplicate_rows, " + r("(t - d) * 100.0 / t") + " as duplicate_percent from c",
        [
            ("k", "select * from lineitem union all select * from lineitem where l_linenumber = 1"),
            ("c", "select (select count(*) from k) as t, (select count(*) from (select distinct * from k)) as d"),
        ],
    ),
)
def _(spark, sf):
    lines = scan_table(spark, f"{sf}/lineitem.parquet")
    return rounded(quality.duplicate_rows(lines.unionAll(lines.where("l_linenumber = 1"))))


@query(
    "quality_metrics",
    on_accidents(
        f"select n as total_records, {len(COLUMNS)}::bigint as total_features, m as missing_values, n - d as duplicate_rows, "
        f"{len(NUMERIC)}::bigint as numeric_features, {len(TEXT)}::bigint as categorical_features, "
        f"{r(f'm * 100.0 / (n * {len(COLUMNS)})')} as missing_percentage from "
        f"(select count(*) as n, ({null_cells()})::bigint as m from accidents), "
        f"(select count(*) as d from (select distinct * from accidents))"
    ),
)
def _(spark, sf):
    return rounded(quality.quality_metrics(accidents(spark, sf)))


def describe_sql(table: str, cols: list[str], by: str | None = None, digits: int = 2) -> str:
    parts = []
    for c in cols:
        x = f"cast({c} as double)"
        parts.append(
            f"select {by + ', ' if by else ''}'{c}' as feature, count({c}) as count, {r(f'avg({x})', digits)} as mean, "
            f"{r(f'stddev_samp({x})', digits)} as std, {r(f'min({x})', digits)} as min, "
            f"{r(f'quantile_cont({x}, 0.25)', digits)} as p25, {r(f'quantile_cont({x}, 0.5)', digits)} as p50, "
            f"{r(f'quantile_cont({x}, 0.75)', digits)} as p75, {r(f'max({x})', digits)} as max from {table} "
            + (f"where {by} is not null group by {by}" if by else "")
        )
    return union_all(parts)


@query("describe_numeric", on_accidents(describe_sql("accidents", NUMERIC)))
def _(spark, sf):
    return rounded(distributions.describe_numeric(accidents(spark, sf), NUMERIC), 2)


LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_numeric_lineitem", describe_sql("lineitem", LINE_MEASURES, digits=4))
def _(spark, sf):
    return rounded(distributions.describe_numeric(scan_table(spark, f"{sf}/lineitem.parquet"), LINE_MEASURES), 4)


@query("describe_by_group", on_accidents(describe_sql("accidents", ["injuries_total"], T)))
def _(spark, sf):
    return rounded(distributions.describe_numeric(accidents(spark, sf), ["injuries_total"], [T]), 2)


@query(
    "boxplot_stats",
    f"select l_returnflag, count, min, p25, p50, p75, max from ({describe_sql('lineitem', ['l_extendedprice'], 'l_returnflag', 4)})",
)
def _(spark, sf):
    return rounded(distributions.boxplot_stats(scan_table(spark, f"{sf}/lineitem.parquet"), "l_extendedprice", "l_returnflag"), 4)


@query(
    "injury_stats_by_target",
    on_accidents(f"select {T}, mean, p50 as median, std from ({describe_sql('accidents', ['injuries_total'], T)})"),
)
def _(spark, sf):
    return rounded(distributions.injury_stats_by_target(accidents(spark, sf), T, "injuries_total"), 2)


def value_counts_sql(col: str, limit: int | None = None, table: str = "accidents") -> str:
    tail = f" order by n desc, value limit {limit}" if limit else ""
    return f"select {col} as value, count(*) as n from {table} where {col} is not null group by 1{tail}"


@query("value_counts", on_accidents(value_counts_sql("weather_condition", 15)))
def _(spark, sf):
    return distributions.value_counts(accidents(spark, sf), "weather_condition", 15)


MODE_SQL = "select {c} as m from accidents where {c} is not null group by {c} order by count(*) desc, {c} limit 1"


@query(
    "profile_categorical",
    on_accidents(
        "select value, n, " + r("n * 100.0 / t") + " as percent, u as unique_values, m as most_frequent, miss as missing "
        f"from ({value_counts_sql('weather_condition', 5)}), ({MODE_SQL.format(c='weather_condition')}), "
        "(select count(*) as t, count(distinct weather_condition) as u, "
        "count(*) - count(weather_condition) as miss from accidents)"
    ),
)
def _(spark, sf):
    return rounded(distributions.profile_categorical(accidents(spark, sf), "weather_condition"))


def class_share_sql(col: str, table: str) -> str:
    return (
        f"select {col} as value, count(*) as n, {r(f'count(*) * 100.0 / (select count(*) from {table})')} as percent "
        f"from {table} where {col} is not null group by 1"
    )


@query("target_distribution", on_accidents(class_share_sql("weather_condition", "accidents")))
def _(spark, sf):
    return rounded(distributions.target_distribution(accidents(spark, sf), "weather_condition"))


@query(
    "class_imbalance",
    on_accidents(
        f"select {r('max(p)')} as max_percent, {r('min(p)')} as min_percent, {r('max(n)::double / min(n)')} as ratio, "
        "max(n)::double / min(n) > 5 as significant, "
        "case when max(n)::double / min(n) < 2 then 'balanced' when max(n)::double / min(n) < 5 then 'moderate' "
        f"else 'severe' end as level from (select count(*) as n, count(*) * 100.0::double / (select count(*) from accidents) as p "
        f"from accidents where {T} is not null group by {T})"
    ),
)
def _(spark, sf):
    return rounded(distributions.class_imbalance(accidents(spark, sf), T))


def missing_sql(limit: int | None = None) -> str:
    inner = union_all(
        f"select '{c}' as feature, count(*) - count({c}) as missing_count, "
        f"{r(f'(count(*) - count({c})) * 100.0 / count(*)')} as missing_percent from accidents"
        for c in COLUMNS
    )
    tail = f" order by missing_count desc, feature limit {limit}" if limit else ""
    return f"select * from ({inner}) where missing_count > 0{tail}"


@query("missing_by_column", on_accidents(missing_sql(15)))
def _(spark, sf):
    return rounded(quality.missing_by_column(accidents(spark, sf), limit=15))


def pearson_sql(a: str, b: str, table: str) -> str:
    return (
        f"(select case when isnan(c) then null else {r('c')} end from "
        f"(select corr(cast({a} as double), cast({b} as double)) as c from {table}))"
    )


# The most-null columns are the same at every scale, because the nulls follow the id.
WORST = ["road_defect", "num_units", "weather_condition", "injuries_total"]


def missing_correlation_sql(threshold: float) -> str:
    return on_accidents(
        "select * from ("
        + union_all(
            f"select '{a}' as feature_1, '{b}' as feature_2, "
            f"{pearson_sql(f'({a} is null)::int', f'({b} is null)::int', 'accidents')} as correlation"
            for i, a in enumerate(WORST) for b in WORST[i + 1 :]
        )
        + f") where abs(correlation) > {threshold}"
    )


@query("missing_correlation", missing_correlation_sql(0.5))
def _(spark, sf):
    return rounded(quality.missing_correlation(accidents(spark, sf)))


@query("missing_correlation_weak", missing_correlation_sql(0.005))
def _(spark, sf):
    """The same with a low threshold, as few nulls of these columns go together."""
    return rounded(quality.missing_correlation(accidents(spark, sf), threshold=0.005))


@query(
    "hourly_distribution",
    on_accidents(
        "select crash_hour as code, crash_hour as label, n, crash_hour = first_value(crash_hour) over (order by n desc, "
        "crash_hour) as is_peak from (select crash_hour, count(*) as n from accidents where crash_hour is not null group by 1)"
    ),
)
def _(spark, sf):
    return distributions.hourly_distribution(accidents(spark, sf), "crash_hour")


@query(
    "rush_hour_totals",
    on_accidents(
        "select count(*) filter (where crash_hour between 7 and 9) as morning_rush, "
        "count(*) filter (where crash_hour between 17 and 19) as evening_rush, "
        "count(*) filter (where crash_hour >= 22 or crash_hour <= 6) as night from accidents"
    ),
)
def _(spark, sf):
    return distributions.rush_hour_totals(accidents(spark, sf), "crash_hour")


def case_of(col: str, labels: dict[int, str]) -> str:
    return "case " + col + " " + " ".join(f"when {k} then '{v}'" for k, v in labels.items()) + " end"


def marked_sql(col: str, label: str, table: str) -> str:
    return (
        f"select {col} as code, {label} as label, n, {col} = first_value({col}) over (order by n desc, {col}) as is_peak "
        f"from (select {col}, count(*) as n from {table} where {col} is not null group by 1)"
    )


@query(
    "daily_distribution",
    on_accidents(
        "select *, (select count(*) from accidents where crash_day_of_week in (6, 7)) as weekend_total, "
        "(select count(*) from accidents where crash_day_of_week between 1 and 5) as weekday_total from ("
        + marked_sql("crash_day_of_week", case_of("crash_day_of_week", preset.DAY_NAMES), "accidents") + ")"
    ),
)
def _(spark, sf):
    return distributions.daily_distribution(accidents(spark, sf), "crash_day_of_week")


@query(
    "monthly_distribution",
    with_ctes(marked_sql("m", case_of("m", preset.MONTH_ABBR), "o"), [("o", "select month(o_orderdate)::int as m from orders")]),
)
def _(spark, sf):
    orders = scan_table(spark, f"{sf}/orders.parquet").select(F.month("o_orderdate").alias("m"))
    return distributions.monthly_distribution(orders, "m")


@query(
    "category_top10",
    on_accidents(
        "select value, n, (select count(distinct weather_condition) from accidents) as n_categories, "
        f"value = ({MODE_SQL.format(c='weather_condition')}) as is_most_common "
        f"from ({value_counts_sql('weather_condition', 10)})"
    ),
)
def _(spark, sf):
    return distributions.category_top10(accidents(spark, sf), "weather_condition")


@query(
    "severity_rate_by_hour",
    on_accidents(
        "select hour, rows, severity_rate, hour = first_value(hour) over (order by severity_rate desc, hour) as is_peak "
        f"from (select h as hour, sum(n)::bigint as rows, {r('(sum(n) - max(n) filter (where t is not null)) * 100.0::double / sum(n)', 1)} "
        f"as severity_rate from (select crash_hour as h, {T} as t, count(*) as n from accidents group by 1, 2) "
        "where h is not null group by h)"
    ),
)
def _(spark, sf):
    return crosstabs.severity_rate_by_hour(accidents(spark, sf), "crash_hour", T)


def pairs_sql(a: str, b: str, table: str = "accidents") -> str:
    return f"select {a} as a, {b} as b, count(*) as n from {table} where {a} is not null and {b} is not null group by 1, 2"


def dense_sql(pairs: str = "p") -> str:
    return (
        f"select a, b, coalesce(n, 0) as n from (select distinct a from {pairs}) cross join (select distinct b from {pairs}) "
        f"left join {pairs} using (a, b)"
    )


@query("crosstab_counts", on_accidents(dense_sql(), ("p", pairs_sql("weather_condition", T))))
def _(spark, sf):
    return crosstabs.crosstab_counts(accidents(spark, sf), "weather_condition", T)


@query("cross_grid", on_accidents(dense_sql(), ("p", pairs_sql("crash_day_of_week", "crash_hour"))))
def _(spark, sf):
    return crosstabs.cross_grid(accidents(spark, sf), "crash_day_of_week", "crash_hour")


ROW_PCT = f"select a, b, {r('n * 100.0 / sum(n) over (partition by a)', 1)} as percent from ({dense_sql()})"


@query("crosstab_row_pct", on_accidents(ROW_PCT, ("p", pairs_sql("weather_condition", T))))
def _(spark, sf):
    return rounded(crosstabs.crosstab_row_pct(accidents(spark, sf), "weather_condition", T), 1)


@query(
    "share_of_group",
    on_accidents(f"select a, b, n, {r('n / sum(n) over (partition by b)::double')} as share from p",
                 ("p", pairs_sql("weather_condition", T))),
)
def _(spark, sf):
    from gravitas.operators.reshape import share_of_group

    return rounded(share_of_group(crosstabs.pair_counts(accidents(spark, sf), "weather_condition", T), "n", ["b"]))


@query(
    "stacked_histogram",
    on_accidents(
        f"select a as value, b as class, n from ({pairs_sql(case_of('crash_day_of_week', preset.DAY_ABBR), T)}) "
        f"union all select a::varchar, b, n from ({pairs_sql('crash_hour', T)})"
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    days = crosstabs.stacked_histogram(acc, "crash_day_of_week", T, decode(F.col("crash_day_of_week"), preset.DAY_ABBR))
    hours = crosstabs.stacked_histogram(acc, "crash_hour", T, F.col("crash_hour").cast("string"))
    return days.unionByName(hours)


TOP8 = ("best", "select a from p group by a order by sum(n) desc, a limit 8")


@query(
    "weather_top8_by_target",
    on_accidents(f"select * from ({dense_sql()}) where a in (select a from best)", ("p", pairs_sql("weather_condition", T)), TOP8),
)
def _(spark, sf):
    return crosstabs.top_rows_crosstab(accidents(spark, sf), "weather_condition", T, 8)


@query(
    "semi_top_k",
    with_ctes(
        f"select * from ({dense_sql()}) where a in (select a from best)",
        [("p", pairs_sql("p_brand", "p_size", "part")), TOP8],
    ),
)
def _(spark, sf):
    return crosstabs.top_rows_crosstab(scan_table(spark, f"{sf}/part.parquet"), "p_brand", "p_size", 8)


@query(
    "risk_slots",
    on_accidents(
        "select row_number() over (order by a, b)::int as slot_no, a as day, b as hour, "
        f"{case_of('a', preset.DAY_ABBR)} || ' ' || b || ':00' as slot, n, {r('th')} as threshold, count(*) over () as n_slots "
        "from g, (select avg(n) + stddev_pop(n) as th from g) where n > th",
        ("p", pairs_sql("crash_day_of_week", "crash_hour")), ("g", dense_sql()),
    ),
)
def _(spark, sf):
    return rounded(crosstabs.risk_slots(accidents(spark, sf), "crash_day_of_week", "crash_hour"))


TOP_FILTER = (
    "weather_condition in (select value from (" + value_counts_sql("weather_condition", 5) + ")) and crash_hour in "
    "(select value from (" + value_counts_sql("crash_hour", 8) + "))"
)


@query("filter_top_k_members", on_accidents(f"select event_id, weather_condition, crash_hour from accidents where {TOP_FILTER}"))
def _(spark, sf):
    kept = crosstabs.keep_top_values(accidents(spark, sf), {"weather_condition": 5, "crash_hour": 8})
    return kept.select("event_id", "weather_condition", "crash_hour")


@query(
    "weather_hour_interaction",
    on_accidents(dense_sql(), ("kept", f"select * from accidents where {TOP_FILTER}"),
                 ("p", pairs_sql("weather_condition", "crash_hour", "kept"))),
)
def _(spark, sf):
    kept = crosstabs.keep_top_values(accidents(spark, sf), {"weather_condition": 5, "crash_hour": 8})
    return crosstabs.crosstab_counts(kept, "weather_condition", "crash_hour")


RISK_CASE = (
    "case when crash_day_of_week in (6, 7) then 'Medium Risk (Weekend)' "
    "when crash_hour >= 22 or crash_hour <= 6 then 'High Risk (Night)' else 'Low Risk' end"
)


@query(
    "risk_category_severity",
    on_accidents(
        f"select a as risk_category, b as severity, percent, b = (select max(b) from p) as is_severe from ({ROW_PCT})",
        ("p", pairs_sql(RISK_CASE, T)),
    ),
)
def _(spark, sf):
    return rounded(crosstabs.risk_category_severity(accidents(spark, sf), "crash_hour", "crash_day_of_week", T), 1)


NIGHT = "(crash_hour >= 22 or crash_hour <= 6)"
RUSH = "(crash_hour between 7 and 9 or crash_hour between 17 and 19)"
WEATHER_MODE = MODE_SQL.format(c="weather_condition")


@query(
    "interaction_counts",
    on_accidents(
        f"select count(*) filter (where crash_day_of_week in (6, 7) and {NIGHT}) as weekend_nights, "
        f"{r(f'count(*) filter (where crash_day_of_week in (6, 7) and {NIGHT}) * 100.0 / count(*)')} as weekend_night_percent, "
        f"count(*) filter (where {RUSH} and weather_condition is distinct from ({WEATHER_MODE})) as rush_hour_bad_weather "
        "from accidents"
    ),
)
def _(spark, sf):
    return rounded(crosstabs.interaction_counts(accidents(spark, sf), "crash_hour", "crash_day_of_week", "weather_condition"))


@query(
    "filter_not_mode",
    on_accidents(f"select event_id, weather_condition from accidents where weather_condition is distinct from ({WEATHER_MODE})"),
)
def _(spark, sf):
    return crosstabs.not_mode(accidents(spark, sf), "weather_condition").select("event_id", "weather_condition")


def matrix_sql(cols: list[str], table: str) -> str:
    return union_all(
        f"select '{a}' as feature_1, '{b}' as feature_2, {pearson_sql(a, b, table)} as correlation"
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    )


@query("correlation_matrix", on_accidents(matrix_sql(NUMERIC, "accidents")))
def _(spark, sf):
    return rounded(correlation.correlation_matrix(accidents(spark, sf), NUMERIC))


@query("correlation_matrix_lineitem", matrix_sql(["l_linenumber", *LINE_MEASURES], "lineitem"))
def _(spark, sf):
    return rounded(correlation.correlation_matrix(scan_table(spark, f"{sf}/lineitem.parquet"), ["l_linenumber", *LINE_MEASURES]))


@query(
    "strong_correlations",
    on_accidents(
        "select feature_1, feature_2, correlation, case when abs(correlation) > 0.8 then 'Very Strong' else 'Strong' end as "
        f"strength from ({matrix_sql(NUMERIC, 'accidents')}) where abs(correlation) > 0.5 "
        "order by abs(correlation) desc, feature_1, feature_2 limit 10"
    ),
)
def _(spark, sf):
    return rounded(correlation.strong_correlations(correlation.correlation_matrix(accidents(spark, sf), NUMERIC)))


@query("multicollinearity", on_accidents(f"select * from ({matrix_sql(NUMERIC, 'accidents')}) where abs(correlation) > 0.9"))
def _(spark, sf):
    return rounded(correlation.multicollinearity(correlation.correlation_matrix(accidents(spark, sf), NUMERIC)))


def target_corr_sql(target: str) -> str:
    return union_all(
        f"select '{c}' as feature, {pearson_sql(c, target, 'accidents')} as correlation" for c in NUMERIC if c != target
    )


@query(
    "target_correlations",
    on_accidents(
        "(select * from c where correlation > 0 order by abs(correlation) desc, feature limit 5) union all "
        "(select * from c where correlation < 0 order by abs(correlation) desc, feature limit 5)",
        ("c", target_corr_sql("injuries_total")),
    ),
)
def _(spark, sf):
    return rounded(correlation.target_correlations(correlation.correlation_matrix(accidents(spark, sf), NUMERIC), "injuries_total"))


def outlier_summary_sql(cols: list[str], table: str) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"select '{c}' as feature, {r('q1')} as q1, {r('q3')} as q3, {r('lo')} as lower_bound, {r('hi')} as upper_bound, "
            f"{r(f'min({c})')} as min, {r(f'max({c})')} as max, count(*) filter (where {c} < lo or {c} > hi) as outliers, "
            f"{r(f'count(*) filter (where {c} < lo or {c} > hi) * 100.0 / count(*)')} as percent, "
            f"{r(f'min({c}) filter (where {c} < lo or {c} > hi)')} as min_outlier, "
            f"{r(f'max({c}) filter (where {c} < lo or {c} > hi)')} as max_outlier from {table}, ({bounds_sql(c, table)}) "
            "group by q1, q3, lo, hi"
        )
    return union_all(parts)


def bounds_sql(c: str, table: str, factor: float = 1.5) -> str:
    return (
        f"select q1, q3, q1 - {factor} * (q3 - q1) as lo, q3 + {factor} * (q3 - q1) as hi from "
        f"(select quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.75) as q3 from {table})"
    )


@query("outlier_iqr_summary", on_accidents(outlier_summary_sql(preset.OUTLIER_COLUMNS, "accidents")))
def _(spark, sf):
    return rounded(outliers.outlier_iqr_summary(accidents(spark, sf), preset.OUTLIER_COLUMNS))


@query("outlier_iqr_summary_lineitem", outlier_summary_sql(["l_extendedprice", "l_quantity"], "lineitem"))
def _(spark, sf):
    return rounded(outliers.outlier_iqr_summary(scan_table(spark, f"{sf}/lineitem.parquet"), ["l_extendedprice", "l_quantity"]))


@query(
    "outlier_records",
    on_accidents(
        f"select count(*) filter (where h >= 1) as any_outlier, {r('count(*) filter (where h >= 1) * 100.0 / count(*)')} as "
        "any_outlier_percent, count(*) filter (where h > 1) as multiple_outliers, sum(h)::bigint as outlier_instances from "
        "(select "
        + " + ".join(f"case when {c} < b{i}.lo or {c} > b{i}.hi then 1 else 0 end" for i, c in enumerate(preset.OUTLIER_COLUMNS))
        + " as h from accidents, "
        + ", ".join(f"({bounds_sql(c, 'accidents')}) b{i}" for i, c in enumerate(preset.OUTLIER_COLUMNS))
        + ")"
    ),
)
def _(spark, sf):
    return rounded(outliers.outlier_records(accidents(spark, sf), preset.OUTLIER_COLUMNS))


@query(
    "outlier_flags",
    on_accidents(
        "select feature, percent > 5 as cap_or_transform, coalesce(max_outlier > upper_bound * 3, false) as investigate, "
        f"feature = first_value(feature) over (order by percent desc, feature) as is_worst "
        f"from ({outlier_summary_sql(preset.OUTLIER_COLUMNS, 'accidents')})"
    ),
)
def _(spark, sf):
    return outliers.outlier_flags(outliers.outlier_iqr_summary(accidents(spark, sf), preset.OUTLIER_COLUMNS))


def rules_sql() -> str:
    parts = []
    for c, lo, hi, text in preset.RULES:
        bad = f"{c} < {lo}" + (f" or {c} > {hi}" if hi is not None else "")
        parts.append(
            f"select '{c}' as feature, '{text}' as rule, count(*) filter (where {bad}) as invalid_count, "
            f"case when count(*) filter (where {bad}) = 0 then 'PASS' else 'FAIL' end as status, "
            f"coalesce((select string_agg(v::varchar, ',' order by v) from "
            f"(select distinct {c} as v from accidents where {bad} order by 1 limit 5)), '') as examples from accidents"
        )
    return union_all(parts)


PARTS_SUM = " + ".join(f"coalesce({c}, 0)" for c in preset.INJURY_PARTS)
CONSISTENCY = (
    "select 'injuries_total_consistency' as feature, 'Total >= sum of categories' as rule, n as invalid_count, "
    "case when n = 0 then 'PASS' else 'FAIL' end as status "
    f"from (select count(*) filter (where injuries_total < {PARTS_SUM}) as n from accidents)"
)


@query("domain_rules", on_accidents(rules_sql()))
def _(spark, sf):
    return rules.domain_rules(accidents(spark, sf), preset.RULES)


@query("injury_consistency", on_accidents(CONSISTENCY))
def _(spark, sf):
    return rules.injury_consistency(accidents(spark, sf), preset.TOTAL, preset.INJURY_PARTS)


@query(
    "rules_summary",
    on_accidents(
        "select count(*) as n_rules, count(*) filter (where status = 'FAIL') as failed_rules, sum(i)::bigint as total_invalid from "
        f"(select status, invalid_count as i from ({rules_sql()}) union all select status, 0 from ({CONSISTENCY}))"
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    return rules.rules_summary(
        rules.domain_rules(acc, preset.RULES), rules.injury_consistency(acc, preset.TOTAL, preset.INJURY_PARTS)
    )


def bin_sql(c: str, by: str = "") -> str:
    return (
        f"select {by}coalesce(least(floor(({c} - lo) / nullif(hi - lo, 0) * 30) + 1, 30), 1)::int as bin, count(*) as n "
        f"from lineitem, (select min({c}) as lo, max({c}) as hi from lineitem) where {c} is not null group by all"
    )


@query(
    "histogram_bins",
    f"select i::int as bin, {r('lo + (hi - lo) / 30 * (i - 1)', 4)} as lower, {r('lo + (hi - lo) / 30 * i', 4)} as upper, "
    f"coalesce(n, 0) as n from range(1, 31) g(i) left join ({bin_sql('l_extendedprice')}) on bin = i, "
    "(select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)",
)
def _(spark, sf):
    return rounded(distributions.histogram_bins(scan_table(spark, f"{sf}/lineitem.parquet"), "l_extendedprice"), 4)


@query("group_density", bin_sql("l_extendedprice", "l_returnflag, "))
def _(spark, sf):
    return distributions.histogram_bins(scan_table(spark, f"{sf}/lineitem.parquet"), "l_extendedprice", by="l_returnflag")


CHECKS = (
    "select 'Missing Values' as \"check\", case when m = 0 then 'PASS' else 'FAIL' end as status, 'null cells: ' || m as details from s "
    "union all select 'Infinite Values', 'PASS', 'infinite cells: 0' "
    f"union all select 'Data Types', 'PASS', 'numbers: {len(NUMERIC)} of {len(COLUMNS)}' "
    "union all select 'Target Variable', case when c > 1 then 'PASS' else 'FAIL' end, 'classes: ' || c from s "
    "union all select 'Duplicate Rows', case when d = 0 then 'PASS' else 'WARN' end, 'copies: ' || d from s"
)
CHECK_FACTS = (
    "s",
    f"select ({null_cells()})::bigint as m, count(distinct {T}) as c, "
    "count(*) - (select count(*) from (select distinct * from accidents)) as d from accidents",
)


@query("post_prep_checks", on_accidents(CHECKS, CHECK_FACTS))
def _(spark, sf):
    return quality.post_prep_checks(accidents(spark, sf), T)


@query("validation_tally", on_accidents(f"select status, count(*) as n from ({CHECKS}) group by 1", CHECK_FACTS))
def _(spark, sf):
    return quality.validation_tally(quality.post_prep_checks(accidents(spark, sf), T))


@query(
    "eda_summary",
    on_accidents(
        f"select cells // {len(COLUMNS)} as total_records, {len(COLUMNS)}::bigint as features, {len(NUMERIC)}::bigint as "
        f"numeric_features, {len(TEXT)}::bigint as categorical_features, {r('missing_cells * 100.0 / cells')} as missing_percent, "
        "'rows: table = ' || printf('%.6g', (cells // 14)::double) || '; missing percent: table = ' || "
        "printf('%.6g', missing_cells * 100.0::double / cells) as insights from m",
        ("m", MISSING_TOTAL),
    ),
)
def _(spark, sf):
    profile = Profile(accidents(spark, sf))
    profile.initial_exploration()
    return rounded(profile.generate_summary().withColumn("insights", F.array_join("insights", "; ")))


