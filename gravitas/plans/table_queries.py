"""Queries of sources, sinks, projections, filters, joins, limits, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions import columns as C
from gravitas.functions.columns import rounded
from gravitas.operators import crosstabs, reshape, split
from gravitas.plans.prepare_queries import SPLIT_CTES
from gravitas.plans.profile_queries import (
    COLUMNS, MEASURES, NIGHT, PARTS_SUM, RISK_CASE, RUSH, T, case_of, pairs_sql, union_all,
)
from gravitas.plans.registry import on_accidents, query, r, with_ctes
from gravitas.session import cached, case_sensitive, fresh_path
from gravitas.sources import sinks, tables
from gravitas.sources.accidents import accidents
from gravitas.sources.tables import scan_table

ALL = f"select {', '.join(COLUMNS)} from accidents"


@query("scan_table", on_accidents(ALL))
def _(spark, sf):
    return accidents(spark, sf)


@query("scan_table_csv", on_accidents(ALL))
def _(spark, sf):
    acc = accidents(spark, sf)
    path = fresh_path(spark, "csv")
    acc.write.option("header", True).option("nullValue", "NA").csv(path)
    return scan_table(spark, path, "csv", acc.schema)


@query(
    "scan_table_inferred",
    on_accidents(ALL),
)
def _(spark, sf):
    path = fresh_path(spark, "csv")
    acc = accidents(spark, sf)
    acc.write.option("header", True).option("nullValue", "NaN").csv(path)
    return scan_table(spark, path, "csv")


@query("scan_resolve", "select count(*) as n from events")
def _(spark, sf):
    found, _ = tables.scan_resolve(
        spark, [(f"{sf}/prepared.parquet", "parquet"), (f"{sf}/splits.parquet", "parquet"), (f"{sf}/events.parquet", "parquet")]
    )
    return found.agg(F.count("*").alias("n"))


def saved_splits(spark, sf) -> str:
    path = fresh_path(spark, "splits")
    done = split.split_stratified(accidents(spark, sf), T, "event_id")
    sinks.sink_splits(done, path, T, preset.TEST_SIZE, preset.VALIDATION_SIZE, preset.SEED)
    return path


@query("scan_splits", on_accidents("select split, event_id, c as most_severe_injury from splits", *SPLIT_CTES))
def _(spark, sf):
    parts = tables.scan_splits(spark, f"{saved_splits(spark, sf)}/data", T)
    tables.same_columns(parts["train"], parts["test"])
    return reshape.union_all(*[df.select(F.lit(n).alias("split"), "event_id", T) for n, df in parts.items()])


@query(
    "sink_table",
    on_accidents(
        f"select u.pos, u.feature, '{T}' as target_variable, (select count(*) from accidents) as n_rows, {len(COLUMNS)}::bigint as n_columns "
        f"from (select unnest(range({len(COLUMNS)})) as pos, unnest([{', '.join(repr(c) for c in COLUMNS)}]) as feature) u"
    ),
)
def _(spark, sf):
    path = fresh_path(spark, "prepared")
    info = sinks.sink_table(accidents(spark, sf), path, T)
    kept = sinks.read_back(spark, path)
    named = info.select("target_variable", F.posexplode("feature_names").alias("pos", "feature"))
    return named.select(
        F.col("pos").cast("bigint"), "feature", "target_variable", F.lit(kept.count()).alias("n_rows"),
        F.lit(len(kept.columns)).cast("bigint").alias("n_columns"),
    )


@query(
    "sink_splits",
    on_accidents(f"select split, count(*) as samples, {len(COLUMNS) - 1}::bigint as features from splits group by 1", *SPLIT_CTES),
)
def _(spark, sf):
    done = split.split_stratified(accidents(spark, sf), T, "event_id")
    return sinks.sink_splits(done, fresh_path(spark, "splits"), T, preset.TEST_SIZE, preset.VALIDATION_SIZE, preset.SEED)


@query("cache_source", on_accidents(f"select {T}, count(*) as n from accidents group by 1"))
def _(spark, sf):
    with cached(accidents(spark, sf)) as kept:
        sizes = split.class_counts(kept, T)
    return spark.createDataFrame(list(sizes.items()), f"{T} string, n bigint")


# --- projections and filters


@query("project_features", on_accidents(f"select {', '.join(c for c in COLUMNS if c != T)} from accidents"))
def _(spark, sf):
    return accidents(spark, sf).drop(T)


@query("sample_head", on_accidents("select event_id, weather_condition, num_units from accidents order by event_id limit 10"))
def _(spark, sf):
    return reshape.sample_head(accidents(spark, sf).select("event_id", "weather_condition", "num_units"), ["event_id"], 10)


@query("filter_range", on_accidents(f"select event_id, crash_hour from accidents where {NIGHT} or {RUSH}"))
def _(spark, sf):
    h = F.col("crash_hour")
    kept = accidents(spark, sf).where(C.is_night(h) | C.is_morning_rush(h) | C.is_evening_rush(h))
    return kept.select("event_id", "crash_hour")


@query("filter_isin", on_accidents("select event_id, crash_day_of_week from accidents where crash_day_of_week in (6, 7)"))
def _(spark, sf):
    return accidents(spark, sf).where(F.col("crash_day_of_week").isin(*preset.WEEKEND)).select("event_id", "crash_day_of_week")


@query("case_precedence", on_accidents(f"select event_id, {RISK_CASE} as risk_category from accidents"))
def _(spark, sf):
    risk = crosstabs.risk_category(F.col("crash_hour"), F.col("crash_day_of_week"))
    return accidents(spark, sf).select("event_id", risk.alias("risk_category"))


@query(
    "map_codes",
    with_ctes(
        f"select o_orderkey, {case_of('m', preset.MONTH_ABBR)} as month_name, {case_of('d', preset.DAY_NAMES)} as day_name from o",
        [("o", "select o_orderkey, month(o_orderdate) as m, isodow(o_orderdate) as d from orders")],
    ),
)
def _(spark, sf):
    orders = scan_table(spark, f"{sf}/orders.parquet")
    return orders.select(
        "o_orderkey",
        C.decode(F.month("o_orderdate"), preset.MONTH_ABBR).alias("month_name"),
        C.decode(F.weekday("o_orderdate") + 1, preset.DAY_NAMES).alias("day_name"),
    )


@query("row_sum", on_accidents(f"select event_id, {PARTS_SUM} + coalesce(num_units, 0) as total from accidents"))
def _(spark, sf):
    return accidents(spark, sf).select("event_id", C.row_sum([*preset.INJURY_PARTS, "num_units"]).alias("total"))


# --- joins


@query("join_by_row_id", "select doc_id, n_chars, quality, toxic from documents join labels using (doc_id)")
def _(spark, sf):
    docs = scan_table(spark, f"{sf}/documents.parquet").select("doc_id", "n_chars")
    labels = scan_table(spark, f"{sf}/labels.parquet")
    return reshape.join_by_row_id(docs, labels, "doc_id").select("doc_id", "n_chars", "quality", "toxic")


@query(
    "left_join_default",
    on_accidents(
        "select a.w as weather_condition, a.n as all_rows, coalesce(b.n, 0) as fatal_rows from "
        "(select weather_condition as w, count(*) as n from accidents group by 1) a left join "
        "(select weather_condition as w, count(*) as n from accidents where injuries_fatal > 0 and num_units > 9 group by 1) b "
        "on a.w is not distinct from b.w"
    ),
)
def _(spark, sf):
    acc = accidents(spark, sf)
    left = acc.groupBy("weather_condition").agg(F.count("*").alias("all_rows"))
    few = acc.where("injuries_fatal > 0 and num_units > 9").groupBy("weather_condition").agg(F.count("*").alias("fatal_rows"))
    return reshape.left_join_default(left, few, "weather_condition", {"fatal_rows": 0})


# --- limits and order


@query("top_k", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 20")
def _(spark, sf):
    li = scan_table(spark, f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return reshape.top_k(li, "l_extendedprice", 20, ["l_orderkey", "l_linenumber"])


@query("n_largest", with_ctes("select a, sum(n)::bigint as total from p group by a order by total desc, a limit 8",
                              [("p", pairs_sql("p_brand", "p_size", "part"))]))
def _(spark, sf):
    counts = crosstabs.pair_counts(scan_table(spark, f"{sf}/part.parquet"), "p_brand", "p_size")
    return reshape.top_k(counts.groupBy("a").agg(F.sum("n").alias("total")), "total", 8, ["a"])


@query(
    "sort_by_abs",
    "select c_custkey, c_acctbal, row_number() over (order by abs(c_acctbal) desc, c_custkey)::int as place from customer "
    "order by place limit 15",
)
def _(spark, sf):
    cust = scan_table(spark, f"{sf}/customer.parquet").select("c_custkey", "c_acctbal")
    best = reshape.top_k(cust, "c_acctbal", 15, ["c_custkey"], absolute=True)
    from pyspark.sql import Window

    # Fifteen rows are left, so numbering them in one window is small.
    place = F.row_number().over(Window.orderBy(F.abs("c_acctbal").desc(), "c_custkey"))
    return reshape.sort_by_abs(best.withColumn("place", place), "c_acctbal", ["c_custkey"])


@query(
    "arg_max",
    "select o_orderstatus, first(p order by n desc, p) as commonest_priority from "
    "(select o_orderstatus, o_orderpriority as p, count(*) as n from orders group by 1, 2) group by 1",
)
def _(spark, sf):
    orders = scan_table(spark, f"{sf}/orders.parquet")
    counts = orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.groupBy("o_orderstatus").agg(reshape.arg_max("o_orderpriority", "n").alias("commonest_priority"))


@query(
    "rank_average",
    with_ctes(
        "select p_brand, n, (rank() over (order by n desc) + (count(*) over (partition by n) - 1) / 2.0)::double as place from b",
        [("b", "select p_brand, count(*) as n from part group by 1")],
    ),
)
def _(spark, sf):
    brands = scan_table(spark, f"{sf}/part.parquet").groupBy("p_brand").agg(F.count("*").alias("n"))
    return brands.withColumn("place", reshape.average_rank(F.col("n"), []))


# --- sets and shapes


@query("union_all", "select c_custkey as id, 'customer' as kind, c_acctbal as balance from customer union all select s_suppkey, 'supplier', s_acctbal from supplier")
def _(spark, sf):
    cust = scan_table(spark, f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    supp = scan_table(spark, f"{sf}/supplier.parquet").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return reshape.union_all(cust, supp)


@query("unpivot", on_accidents(union_all(f"select event_id, '{c}' as variable, {c}::bigint as value from accidents" for c in MEASURES)))
def _(spark, sf):
    wide = accidents(spark, sf).select("event_id", *[F.col(c).cast("bigint").alias(c) for c in MEASURES])
    return reshape.unpivot(wide, ["event_id"], MEASURES)


FLAGS = ["A", "N", "R"]


@query(
    "transpose",
    union_all(
        f"select '{m}' as metric, " + ", ".join(f"{r(f'{f} filter (where l_returnflag = {chr(39)}{k}{chr(39)})', 4)} as {k}" for k in FLAGS)
        + " from lineitem"
        for m, f in (("mean_price", "avg(l_extendedprice)"), ("mean_quantity", "avg(l_quantity)"))
    ),
)
def _(spark, sf):
    per_flag = scan_table(spark, f"{sf}/lineitem.parquet").groupBy("l_returnflag").agg(
        F.avg("l_extendedprice").alias("mean_price"), F.avg("l_quantity").alias("mean_quantity")
    )
    return rounded(reshape.transpose(per_flag, "l_returnflag", ["mean_price", "mean_quantity"], FLAGS), 4)


@query(
    "crosstab_wide",
    with_ctes(
        "select a, " + ", ".join(f"coalesce(sum(n) filter (where b = '{k}'), 0)::bigint as {k}" for k in FLAGS) + " from p group by a",
        [("p", pairs_sql("l_linenumber", "l_returnflag", "lineitem"))],
    ),
)
def _(spark, sf):
    # Columns a and A: only a case-sensitive session can write the table or read it by name.
    return crosstabs.crosstab_wide(scan_table(case_sensitive(spark), f"{sf}/lineitem.parquet"), "l_linenumber", "l_returnflag", FLAGS)


# --- scalar functions


@query(
    "functions_math",
    "select event_id, " + r("ln(1 + value)") + " as log1p_value, " + r("abs(value - 30)") + " as distance, "
    + r("value", 1) + " as rounded, " + r("least(greatest(value, 5), 80)") + " as clipped, "
    "false as is_infinite, (value > 90)::int * (user_id % 2)::int as product from events",
)
def _(spark, sf):
    v = F.col("value")
    ev = scan_table(spark, f"{sf}/events.parquet")
    return rounded(
        ev.select(
            "event_id", F.log1p(v).alias("log1p_value"), F.abs(v - 30).alias("distance"), F.round(v, 1).alias("rounded"),
            C.clip(v, 5, 80).alias("clipped"), (F.abs(v) == float("inf")).alias("is_infinite"),
            (C.flag(v > 90) * (F.col("user_id") % 2).cast("int")).alias("product"),
        )
    )


@query(
    "functions_null",
    on_accidents(
        "select event_id, num_units is null as is_null, weather_condition is not null as is_known, "
        "coalesce(num_units, 0) as filled from accidents where injuries_total is not null"
    ),
)
def _(spark, sf):
    return accidents(spark, sf).na.drop(subset=["injuries_total"]).select(
        "event_id", F.col("num_units").isNull().alias("is_null"), F.col("weather_condition").isNotNull().alias("is_known"),
        F.coalesce("num_units", F.lit(0)).alias("filled"),
    )


@query(
    "functions_text_json",
    on_accidents(
        "select event_id, replace(replace(replace(most_severe_injury || ' (Tuned)', ' ', '_'), '(', ''), ')', '') as file_name, "
        "'{\"hour\":' || crash_hour || ',\"day\":' || crash_day_of_week || '}' as info from accidents"
    ),
)
def _(spark, sf):
    name = F.concat(F.col(T), F.lit(" (Tuned)"))
    clean = F.regexp_replace(F.regexp_replace(name, " ", "_"), r"[()]", "")
    info = F.to_json(F.struct(F.col("crash_hour").alias("hour"), F.col("crash_day_of_week").alias("day")))
    return accidents(spark, sf).select("event_id", clean.alias("file_name"), info.alias("info"))
