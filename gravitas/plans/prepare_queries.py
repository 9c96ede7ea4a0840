"""Queries of the preparation: imputation, capping, skew, features, encoding, scaling, resampling, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions.columns import rounded
from gravitas.operators import cap, encode, features, impute, knn, resample, scale, skew, split
from gravitas.operators.distributions import boxplot_stats
from gravitas.operators.split import class_counts
from gravitas.plans.profile_queries import MODE_SQL, NIGHT, NUMERIC, PARTS_SUM, T, WEATHER_MODE, bounds_sql, union_all
from gravitas.plans.registry import on_accidents, query, r
from gravitas.sources.accidents import accidents
from gravitas.sources.tables import scan_table

MEASURES = preset.OUTLIER_COLUMNS


def doubles(df, cols, *others):
    return rounded(df.select(*others, *[F.col(c).cast("double").alias(c) for c in cols]))


def as_double(cols) -> str:
    return ", ".join(f"{r(c)} as {c}" for c in cols)


# --- imputation


def median_sql(c: str, table: str = "accidents") -> str:
    return f"(select quantile_cont({c}::double, 0.5) from {table})"


def filled(c: str, fill: str) -> str:
    return f"{r(f'coalesce({c}::double, {fill})')} as {c}"


@query(
    "impute_auto",
    on_accidents(
        f"select event_id, coalesce(weather_condition, ({WEATHER_MODE})) as weather_condition, road_defect, "
        f"{filled('num_units', median_sql('num_units'))}, {filled('injuries_total', median_sql('injuries_total'))} from accidents"
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    out = impute.fit_auto(acc).transform(acc)
    return doubles(out, ["num_units", "injuries_total"], "event_id", "weather_condition", "road_defect")


@query(
    "impute_summary",
    on_accidents(
        "select 'weather_condition' as feature, 'mode' as method, "
        f"({WEATHER_MODE}) as fill_value, count(*) - count(weather_condition) as missing_count from accidents union all "
        + union_all(
            f"select '{c}', 'median', printf('%.6f', {median_sql(c)}), count(*) - count({c}) from accidents"
            for c in ("num_units", "injuries_total")
        )
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    return impute.fit_auto(acc).summary(acc)


@query(
    "impute_mode_median",
    on_accidents(
        f"select event_id, coalesce(weather_condition, ({WEATHER_MODE})) as weather_condition, "
        f"coalesce(road_defect, ({MODE_SQL.format(c='road_defect')})) as road_defect, "
        f"{filled('num_units', median_sql('num_units'))}, {filled('injuries_total', median_sql('injuries_total'))} from accidents"
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    out = impute.fit_auto(acc, mostly_null_percent=None).transform(acc)
    return doubles(out, ["num_units", "injuries_total"], "event_id", "weather_condition", "road_defect")


@query(
    "impute_drop",
    on_accidents("select event_id from accidents where weather_condition is not null and road_defect is not null "
                 "and num_units is not null and injuries_total is not null"),
)
def _(spark, sf):
    return impute.impute_drop(accidents(spark, sf)).select("event_id")


def ffill_sql(c: str) -> str:
    return f"last_value({c} ignore nulls) over (partition by crash_day_of_week order by event_id rows unbounded preceding) as {c}"


@query(
    "impute_ffill",
    on_accidents(f"select event_id, {ffill_sql('weather_condition')}, {ffill_sql('road_defect')}, {ffill_sql('num_units')} from accidents"),
)
def _(spark, sf):
    cols = ["weather_condition", "road_defect", "num_units"]
    acc = accidents(spark, sf).select("event_id", "crash_day_of_week", *cols)
    return impute.impute_ffill(acc, cols, "event_id", "event_id", ["crash_day_of_week"]).drop("crash_day_of_week")


@query(
    "impute_mean",
    on_accidents("select event_id, " + ", ".join(filled(c, f"(select avg({c}) from accidents)") for c in ("num_units", "injuries_total"))
                 + " from accidents"),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    out = impute.fit_mean(acc, ["num_units", "injuries_total"]).transform(acc)
    return doubles(out, ["num_units", "injuries_total"], "event_id")


# --- capping


def clipped(c: str, lo: str, hi: str) -> str:
    return f"{r(f'case when {c} is null then null else least(greatest({c}::double, {lo}), {hi}) end')} as {c}"


@query(
    "cap_iqr",
    on_accidents(
        "select event_id, " + ", ".join(clipped(c, f"b{i}.lo", f"b{i}.hi") for i, c in enumerate(MEASURES)) + " from accidents, "
        + ", ".join(f"({bounds_sql(c, 'accidents')}) b{i}" for i, c in enumerate(MEASURES))
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    return doubles(cap.fit_cap(acc, MEASURES, "iqr", 1.5).transform(acc), MEASURES, "event_id")


@query(
    "cap_iqr_lineitem",
    "select l_orderkey, " + clipped("l_extendedprice", "lo", "hi")
    + f" from lineitem, ({bounds_sql('l_extendedprice', 'lineitem', 0.4)})",
)
def _(spark, sf):
    li = scan_table(spark, f"{sf}/lineitem.parquet")
    return doubles(cap.fit_cap(li, ["l_extendedprice"], "iqr", 0.4).transform(li), ["l_extendedprice"], "l_orderkey")


def zscore_bounds(c: str, t: float) -> str:
    """Bounds so wide that nothing is clipped when the column has nulls or no outlier."""
    return (
        f"select case when on_ then m - {t} * s else -1e300 end as lo, case when on_ then m + {t} * s else 1e300 end as hi from "
        f"(select m, s, n = k and (select count(*) from accidents where abs(({c} - m) / nullif(p, 0)) > {t}) > 0 as on_ from "
        f"(select avg({c}) as m, stddev_samp({c}) as s, stddev_pop({c}) as p, count(*) as n, count({c}) as k from accidents))"
    )


@query(
    "cap_zscore",
    on_accidents(
        "select event_id, " + ", ".join(clipped(c, f"b{i}.lo", f"b{i}.hi") for i, c in enumerate(MEASURES)) + " from accidents, "
        + ", ".join(f"({zscore_bounds(c, 3.0)}) b{i}" for i, c in enumerate(MEASURES))
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    return doubles(cap.fit_cap(acc, MEASURES, "zscore", 3.0).transform(acc), MEASURES, "event_id")


def mad_bounds(c: str, t: float) -> str:
    return (
        f"select case when mad > 0 then m - {t} * mad / 0.6745::double else -1e300 end as lo, "
        f"case when mad > 0 then m + {t} * mad / 0.6745::double else 1e300 end as hi from (select m, (select "
        f"quantile_cont(abs({c} - m)::double, 0.5) from accidents) as mad from (select {median_sql(c)} as m))"
    )


@query(
    "cap_mad",
    on_accidents(
        "select event_id, " + ", ".join(clipped(c, f"b{i}.lo", f"b{i}.hi") for i, c in enumerate(MEASURES)) + " from accidents, "
        + ", ".join(f"({mad_bounds(c, 3.5)}) b{i}" for i, c in enumerate(MEASURES))
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    return doubles(cap.fit_cap(acc, MEASURES, "robust", 3.5).transform(acc), MEASURES, "event_id")


@query("cap_none", on_accidents(f"select event_id, {as_double(MEASURES)} from accidents"))
def _(spark, sf):
    acc = accidents(spark, sf)
    return doubles(cap.fit_cap(acc, MEASURES, "none").transform(acc), MEASURES, "event_id")


@query(
    "cap_summary",
    on_accidents(
        "select * from ("
        + union_all(
            f"select '{c}' as feature, count(*) filter (where {c} < lo or {c} > hi) as outliers_detected, "
            f"{r(f'count(*) filter (where {c} < lo or {c} > hi) * 100.0 / count(*)')} as outliers_percent, 'iqr' as method, "
            f"{r('lo')} as lower_bound, {r('hi')} as upper_bound from accidents, ({bounds_sql(c, 'accidents')}) group by lo, hi"
            for c in MEASURES
        )
        + ") where outliers_detected > 0"
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    return rounded(cap.fit_cap(acc, MEASURES).summary(acc))


@query(
    "cap_before_after",
    on_accidents(
        union_all(
            f"select {T}, '{stage}' as stage, count(x) as count, {r('min(x)')} as min, {r('quantile_cont(x, 0.25)')} as p25, "
            f"{r('quantile_cont(x, 0.5)')} as p50, {r('quantile_cont(x, 0.75)')} as p75, {r('max(x)')} as max from "
            f"(select {T}, {expr} as x from accidents, ({bounds_sql('num_units', 'accidents')})) group by 1"
            for stage, expr in (
                ("before", "num_units::double"),
                ("after", "case when num_units is null then null else least(greatest(num_units::double, lo), hi) end"),
            )
        )
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    capped = cap.fit_cap(acc, ["num_units"]).transform(acc)
    parts = [
        boxplot_stats(df, "num_units", T).withColumn("stage", F.lit(s)) for s, df in (("before", acc), ("after", capped))
    ]
    return rounded(parts[0].unionByName(parts[1]))


# --- skew

INJURY_COUNTS = [c for c in NUMERIC if c not in ("event_id",)]


def skew_sql(x: str) -> str:
    return f"coalesce(case when min({x}) = max({x}) then 0 else skewness({x}::double) end, 0)"


@query(
    "skewness",
    on_accidents(
        "select feature, skewness from ("
        + union_all(
            f"select '{c}' as feature, min({c}) as lowest, {r(skew_sql(c))} as skewness from accidents" for c in INJURY_COUNTS
        )
        + ") where lowest >= 0"
    ),
)
def _(spark, sf):
    return rounded(skew.skewness(accidents(spark, sf), INJURY_COUNTS))


SKEWED = [
    "num_units", "injuries_fatal", "injuries_incapacitating", "injuries_non_incapacitating", "injuries_reported_not_evident",
]


@query(
    "log1p_skewed",
    on_accidents(
        "select event_id, "
        + ", ".join(
            r(f"case when (select {skew_sql(c)} from accidents) > 1.0 or (select {skew_sql(c)} from accidents) < -1.0 "
              f"then ln(1 + {c}::double) else {c}::double end") + f" as {c}"
            for c in SKEWED
        )
        + f", {r('injuries_total')} as injuries_total from accidents"
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    out = skew.apply_log1p(acc, skew.skewed_columns(acc, INJURY_COUNTS))
    return doubles(out, [*SKEWED, "injuries_total"], "event_id")


@query(
    "skew_improvement",
    on_accidents(
        union_all(
            f"select '{c}' as feature, {r('b')} as skew_before, {r('a')} as skew_after, {r('abs(b) - abs(a)')} as improvement from "
            f"(select {skew_sql(c)} as b, {skew_sql(f'ln(1 + {c}::double)')} as a from accidents)"
            for c in ("num_units", "injuries_incapacitating", "injuries_non_incapacitating")
        )
    ),
)
def _(spark, sf):
    cols = ["num_units", "injuries_incapacitating", "injuries_non_incapacitating"]
    return rounded(skew.skew_improvement(accidents(spark, sf), cols))


# --- features


@query(
    "datetime_features",
    on_accidents(
        "select event_id, year(t)::int as crash_year, month(t)::int as crash_month, day(t)::int as crash_day, "
        "hour(t)::int as crash_hour_from_date from (select event_id, try_strptime(case when event_id % 23 = 0 then 'unknown' "
        "else crash_date end, '%m/%d/%Y %I:%M:%S %p') as t from accidents)"
    ),
)
def _(spark, sf):
    broken = F.when(F.col("event_id") % 23 == 0, "unknown").otherwise(F.col("crash_date"))
    acc = accidents(spark, sf).withColumn("crash_date", broken)
    out = features.datetime_features(acc, "crash_date")
    return out.select("event_id", "crash_year", "crash_month", "crash_day", "crash_hour_from_date")


TIME_SQL = (
    f"{NIGHT}::int as is_night, (crash_hour between 7 and 9)::int as is_morning_rush, "
    "(crash_hour between 17 and 19)::int as is_evening_rush, case when crash_hour between 6 and 11 then 0 "
    "when crash_hour between 12 and 17 then 1 when crash_hour between 18 and 21 then 2 else 3 end as time_period"
)


@query("time_flags", on_accidents(f"select event_id, {TIME_SQL} from accidents"))
def _(spark, sf):
    out = features.time_flags(accidents(spark, sf), "crash_hour")
    return out.select("event_id", "is_night", "is_morning_rush", "is_evening_rush", "time_period")


@query("is_weekend", on_accidents("select event_id, (crash_day_of_week in (6, 7))::int as is_weekend from accidents"))
def _(spark, sf):
    return features.weekend_flag(accidents(spark, sf), "crash_day_of_week").select("event_id", "is_weekend")


@query(
    "injury_features",
    on_accidents(
        "select event_id, (injuries_fatal + injuries_incapacitating > 0)::int as has_severe_injury, "
        f"case when injuries_total = -1 then case when {PARTS_SUM} > 0 then 'inf'::double end "
        f"else {r(f'({PARTS_SUM})::double / (injuries_total + 1)')} end as injury_rate from accidents"
    ),
)
def _(spark, sf):
    out = features.injury_features(accidents(spark, sf), preset.TOTAL, preset.INJURY_PARTS, preset.SEVERE_PARTS)
    return rounded(out.select("event_id", "has_severe_injury", "injury_rate"))


BAD = f"(weather_condition is distinct from ({WEATHER_MODE}))::int"
RISK = f"({NIGHT}::int + (crash_day_of_week in (6, 7))::int + {BAD})"


@query("bad_weather", on_accidents(f"select event_id, {BAD} as bad_weather from accidents"))
def _(spark, sf):
    return features.bad_weather(accidents(spark, sf), "weather_condition").select("event_id", "bad_weather")


@query(
    "risk_score",
    on_accidents(f"select risk_score, count(*) as n, {r('count(*) * 100.0 / sum(count(*)) over ()')} as percent from "
                 f"(select {RISK} as risk_score from accidents) group by 1"),
)
def _(spark, sf):
    return rounded(features.risk_distribution(features.engineer(accidents(spark, sf))))


@query(
    "interaction_features",
    on_accidents(
        f"select event_id, {RISK} as risk_score, {NIGHT}::int * {BAD} as night_bad_weather, "
        f"(crash_day_of_week in (6, 7))::int * {NIGHT}::int as weekend_night from accidents"
    ),
)
def _(spark, sf):
    out = features.engineer(accidents(spark, sf), create_interactions=True)
    return out.select("event_id", "risk_score", "night_bad_weather", "weekend_night")


# --- encoding

TEXT_COLUMNS = ["crash_date", "weather_condition", "road_defect", "most_severe_injury"]


def codes_cte(c: str) -> tuple[str, str]:
    return (
        f"codes_{c}",
        f"select {c} as v, row_number() over (order by {c}) - 1 as code from (select distinct {c} from accidents where {c} is not null)",
    )


def coded(null_code: str) -> str:
    cols = ", ".join(
        f"case when a.{c} is null then {null_code.format(c=c)} else codes_{c}.code end as {c}" for c in TEXT_COLUMNS
    )
    joins = " ".join(f"left join codes_{c} on a.{c} = codes_{c}.v" for c in TEXT_COLUMNS)
    return f"select a.event_id, {cols} from accidents a {joins}"


@query("encode_label", on_accidents(coded("(select count(*) from codes_{c})"), *[codes_cte(c) for c in TEXT_COLUMNS]))
def _(spark, sf):
    acc = accidents(spark, sf)
    return encode.fit_label(acc, TEXT_COLUMNS).transform(acc).select("event_id", *TEXT_COLUMNS)


@query("encode_codes", on_accidents(coded("-1"), *[codes_cte(c) for c in TEXT_COLUMNS]))
def _(spark, sf):
    acc = accidents(spark, sf)
    return encode.fit_label(acc, TEXT_COLUMNS).transform(acc, null_code=-1).select("event_id", *TEXT_COLUMNS)


@query(
    "encode_cardinality",
    on_accidents(
        union_all(
            f"select '{c}' as feature, count(distinct {c}) as unique_values, ({MODE_SQL.format(c=c)}) as most_frequent, "
            f"count(distinct {c}) > 50 as high_cardinality from accidents"
            for c in TEXT_COLUMNS
        )
    ),
)
def _(spark, sf):
    return encode.encode_cardinality(accidents(spark, sf), TEXT_COLUMNS)


@query(
    "encode_onehot",
    on_accidents("select event_id, " + ", ".join(f"coalesce((road_defect = 'DEFECT_{i}')::int, 0) as road_defect_DEFECT_{i}"
                                                 for i in range(3)) + " from accidents"),
)
def _(spark, sf):
    return encode.onehot(accidents(spark, sf).select("event_id", "road_defect"), "road_defect")


CLASSES = ["FATAL", "INCAPACITATING INJURY", "NO INDICATION OF INJURY", "NONINCAPACITATING INJURY"]


@query(
    "encode_target",
    on_accidents(
        "select a.event_id, "
        + ", ".join(f"{r(f's{i}')} as weather_condition_share_{i}" for i in range(4))
        + " from accidents a join (select weather_condition as k, "
        + ", ".join(f"avg(({T} = '{c}')::int) as s{i}" for i, c in enumerate(CLASSES))
        + " from accidents group by 1) s on a.weather_condition is not distinct from s.k"
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf).select("event_id", "weather_condition", T)
    return rounded(encode.encode_target(acc, "weather_condition", T, CLASSES).drop(T))


KIND_COLUMNS = ["crash_hour", "crash_day_of_week", "weather_condition", "num_units", "event_id"]


@query(
    "feature_kind",
    on_accidents(
        union_all(
            f"select '{c}' as feature, case when {'true' if c in TEXT_COLUMNS else 'false'} or count(distinct {c}) < 20 "
            "then 'categorical' else 'continuous' end as kind from accidents"
            for c in KIND_COLUMNS
        )
    ),
)
def _(spark, sf):
    return encode.feature_kind(accidents(spark, sf), KIND_COLUMNS)


@query(
    "input_domain",
    on_accidents(
        union_all(
            [
                f"select distinct '{c}' as feature, 'categorical' as kind, {c}::varchar as value, null::double as lowest, "
                f"null::double as highest, null::double as mean from accidents where {c} is not null"
                for c in ("weather_condition", "num_units")
            ]
            + [
                f"select '{c}', 'continuous', null, {r(f'min({c})')}, {r(f'max({c})')}, {r(f'avg({c})')} from accidents"
                for c in ("crash_hour", "event_id")
            ]
        )
    ),
)
def _(spark, sf):
    return rounded(encode.input_domain(accidents(spark, sf), ["weather_condition", "num_units", "crash_hour", "event_id"]))


# --- scaling

SCALED = ["crash_hour", "crash_day_of_week", "crash_month", "num_units", "injuries_non_incapacitating"]


@query(
    "detect_binary",
    on_accidents(
        union_all(
            f"select '{c}' as feature, count(distinct {c}) = 2 and min({c}) = 0 and max({c}) = 1 and count({c}) = count(*) "
            "as is_binary from accidents"
            for c in NUMERIC
        )
    ),
)
def _(spark, sf):
    return scale.detect_binary(accidents(spark, sf), NUMERIC)


def scaled_sql(centre: str, width: str) -> str:
    cols = ", ".join(
        r(f"({c} - (select {centre.format(c=c)} from accidents)) / coalesce(nullif((select {width.format(c=c)} from accidents), 0), 1)")
        + f" as {c}"
        for c in SCALED
    )
    return on_accidents(f"select event_id, {cols} from accidents")


QUARTILES = "quantile_cont({c}::double, 0.75) - quantile_cont({c}::double, 0.25)"


@query("scale_standard", scaled_sql("avg({c})", "stddev_pop({c})"))
def _(spark, sf):
    acc = accidents(spark, sf)
    return doubles(scale.fit_scale(acc, SCALED, exclude_binary=True).transform(acc), SCALED, "event_id")


@query("scale_robust", scaled_sql("quantile_cont({c}::double, 0.5)", QUARTILES))
def _(spark, sf):
    acc = accidents(spark, sf)
    return doubles(scale.fit_scale(acc, SCALED, "robust", True).transform(acc), SCALED, "event_id")


@query("scale_minmax", scaled_sql("min({c})", "(max({c}) - min({c}))"))
def _(spark, sf):
    acc = accidents(spark, sf)
    return doubles(scale.fit_scale(acc, SCALED, "minmax", True).transform(acc), SCALED, "event_id")


@query(
    "scale_report",
    on_accidents(
        union_all(
            f"select '{c}' as feature, "
            + ", ".join(
                f"{r(f'{f}({x})')} as {n}_{stage}"
                for stage, x in (("before", c), ("after", "z"))
                for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
            )
            + f" from (select {c}, ({c} - (select avg({c}) from accidents)) / "
            f"coalesce(nullif((select stddev_pop({c}) from accidents), 0), 1) as z from accidents)"
            for c in SCALED
        )
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    return rounded(scale.scale_report(acc, scale.fit_scale(acc, SCALED)))


# --- splits

ORDERED = (
    "ordered",
    f"select event_id, {T} as c, row_number() over (partition by {T} order by md5(event_id || ':42')) as rn, "
    f"count(*) over (partition by {T}) as n from accidents",
)
SPLIT_CTES = [
    ORDERED,
    ("q", "select *, floor(n * 0.2::double + 0.5) as test_n from ordered"),
    ("q2", "select *, test_n + floor((n - test_n) * 0.1::double + 0.5) as val_n from q"),
    ("splits", "select event_id, c, case when rn <= test_n then 'test' when rn <= val_n then 'validation' else 'train' end as split from q2"),
]


@query("split_stratified", on_accidents("select event_id, split from splits", *SPLIT_CTES))
def _(spark, sf):
    return split.split_stratified(accidents(spark, sf), T, "event_id").select("event_id", "split")


@query(
    "split_class_distribution",
    on_accidents(f"select split, c as class, count(*) as n, {r('count(*) / sum(count(*)) over (partition by split)')} as share "
                 "from splits group by 1, 2", *SPLIT_CTES),
)
def _(spark, sf):
    return rounded(split.split_class_distribution(split.split_stratified(accidents(spark, sf), T, "event_id"), T))


FOLD = " ".join(f"when rn <= n * {i + 1} // 5 then {i}" for i in range(5))


@query("cv_stratified", on_accidents(f"select event_id, case {FOLD} end as fold from ordered", ORDERED))
def _(spark, sf):
    return split.stratified_folds(accidents(spark, sf), T, "event_id", 5).select("event_id", "fold")


# --- neighbours and resampling

KNN_FEATURES = ["crash_hour", "crash_day_of_week", "num_units", "injuries_reported_not_evident"]
POINTS = (
    "points",
    f"select event_id as id, {T} as c, [crash_hour::double, crash_day_of_week::double, coalesce(num_units, 1)::double, "
    "injuries_reported_not_evident::double] as vec from accidents",
)
BIGGEST = "(select max(n) from (select count(*) as n from points group by c))"
SIZES = ("sizes", f"select c, count(*) as n, {BIGGEST} - count(*) as missing from points group by c")


def knn_points(spark, sf):
    acc = accidents(spark, sf).withColumn("num_units", F.coalesce("num_units", F.lit(1)))
    return acc.select("event_id", T, *[F.col(c).cast("double").alias(c) for c in KNN_FEATURES])


NEAREST = (
    "select id, place, neighbour_id, {d} as distance from (select x.vec_id as id, y.vec_id as neighbour_id, "
    "list_distance(x.embedding::double[], y.embedding::double[]) as d, row_number() over (partition by x.vec_id "
    "order by d, y.vec_id)::int as place from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id) where place <= 5"
).format(d=r("d"))


def near_embeddings(spark, sf, cell_rows=None):
    emb = scan_table(spark, f"{sf}/embeddings.parquet")
    points = emb.select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("g"), F.col("embedding").cast("array<double>").alias("vec")
    )
    return rounded(knn.neighbour_pairs(knn.nearest_neighbours(points, preset.NEIGHBOURS, cell_rows=cell_rows)).drop("g"))


@query("knn_self_join", NEAREST)
def _(spark, sf):
    return near_embeddings(spark, sf)


@query("knn_self_join_small_cells", NEAREST)
def _(spark, sf):
    """Cells of 50 vectors: the tree of cells has several levels here already."""
    return near_embeddings(spark, sf, 50)


# Same-class neighbours of every row of a smaller class; equally near ones by id.
CLASS_NEAR = (
    "class_near",
    "select x.id, x.c, x.vec, y.id as nid, y.vec as nvec, row_number() over (partition by x.id order by "
    "list_distance(x.vec, y.vec), y.id) as place from points x join sizes s on s.c = x.c and s.missing > 0 "
    "join points y on y.c = x.c and y.id <> x.id qualify place <= 5",
)


def drawn_ctes(reps: tuple[str, str]) -> list[tuple[str, str]]:
    """Synthetic rows of bases with ``reps`` draws: neighbour and place on the segment from the md5 of the draw."""
    return [
        POINTS, SIZES, CLASS_NEAR, reps,
        ("draws", "select id, unnest(range(reps::bigint)) as draw from reps where reps > 0"),
        ("keys", "select id, draw, md5(id || ':' || draw || ':42') as k from draws"),
        ("made", "select n.id as base_id, n.nid as neighbour_id, n.c, n.vec, n.nvec, "
                 "('0x' || substr(k, 9, 8))::bigint / 4294967296.0::double as lam from keys "
                 "join class_near n on n.id = keys.id and n.place = ('0x' || substr(k, 1, 8))::bigint % 5 + 1"),
    ]


MADE = "select null::bigint as event_id, base_id, neighbour_id, true as is_synthetic, c as most_severe_injury, " + ", ".join(
    f"{r(f'vec[{i + 1}] + lam * (nvec[{i + 1}] - vec[{i + 1}])')} as {c}" for i, c in enumerate(KNN_FEATURES)
) + " from made union all select id, null, null, false, c, " + ", ".join(
    r(f"vec[{i + 1}]") for i in range(len(KNN_FEATURES))
) + " from points"

SMOTE_REPS = (
    "reps",
    "select p.id, s.missing // s.n + case when row_number() over (partition by p.c order by md5(p.id || ':42')) <= s.missing % s.n "
    "then 1 else 0 end as reps from points p join sizes s using (c) where s.missing > 0",
)


def made_rows(spark, sf, method, strategy="auto"):
    rows = knn_points(spark, sf)
    wanted = strategy(class_counts(rows, T)) if callable(strategy) else strategy
    out = resample.resample(rows, T, "event_id", KNN_FEATURES, method, trace=True, strategy=wanted)
    return doubles(out, KNN_FEATURES, "event_id", "base_id", "neighbour_id", "is_synthetic", T)


@query("resample_smote", on_accidents(MADE, *drawn_ctes(SMOTE_REPS)))
def _(spark, sf):
    return made_rows(spark, sf, "smote")


def smote_ctes(missing: str) -> list[tuple[str, str]]:
    """Synthetic rows where ``missing`` says how many rows a class lacks."""
    ctes = drawn_ctes(SMOTE_REPS)
    return [ctes[0], ("sizes", f"select c, count(*) as n, {missing} as missing from points group by c"), *ctes[2:]]


ONE = f"case when row_number() over (order by count(*), c) = 1 then {BIGGEST} - count(*) else 0 end"


@query("resample_minority", on_accidents(MADE, *smote_ctes(ONE)))
def _(spark, sf):
    return made_rows(spark, sf, "smote", "minority")


@query("resample_to_sizes", on_accidents(MADE, *smote_ctes(f"greatest({BIGGEST} // 2 - count(*), 0)")))
def _(spark, sf):
    """Every class grows to half of the largest at least."""
    return made_rows(spark, sf, "smote", lambda counts: {c: max(n, max(counts.values()) // 2) for c, n in counts.items()})


def others_cte(k: int) -> tuple[str, str]:
    """Rows of another class among the k nearest of all rows."""
    return (
        "others",
        "select id, c, sum((c <> oc)::int) as others from (select x.id, x.c, y.c as oc, row_number() over (partition by x.id "
        "order by list_distance(x.vec, y.vec), y.id) as place from points x join sizes s on s.c = x.c and s.missing > 0 "
        f"join points y on y.id <> x.id qualify place <= {k}) group by all",
    )


ADASYN_REPS = (
    "reps",
    "select id, round_even((others / 5.0::double) / sum(others / 5.0::double) over (partition by c) * missing::double, 0) as reps "
    "from others join sizes using (c)",
)
DANGER_REPS = (
    "reps",
    "select id, missing // m + case when rn <= missing % m then 1 else 0 end as reps from (select id, c, count(*) over "
    "(partition by c) as m, row_number() over (partition by c order by md5(id || ':42')) as rn from others "
    "where others >= 5 and others < 10) join sizes using (c)",
)


def with_others(reps, k):
    parts = drawn_ctes(reps)
    return [*parts[:3], others_cte(k), *parts[3:]]


@query("resample_adasyn", on_accidents(MADE, *with_others(ADASYN_REPS, 5)))
def _(spark, sf):
    return made_rows(spark, sf, "adasyn")


@query("resample_borderline", on_accidents(MADE, *with_others(DANGER_REPS, 10)))
def _(spark, sf):
    return made_rows(spark, sf, "borderline")


@query(
    "resample_report",
    on_accidents(
        f"select c as class, n as before, n + missing as after, missing as change, "
        f"{r('max(n) over () / min(n) over ()')} as ratio_before, 1.0::double as ratio_after from sizes", POINTS, SIZES,
    ),
)
def _(spark, sf):
    rows = knn_points(spark, sf)
    return rounded(resample.resample_report(rows, resample.resample(rows, T, "event_id", KNN_FEATURES), T))


