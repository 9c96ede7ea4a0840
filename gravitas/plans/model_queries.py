"""Queries of metrics, ranking, training, selection and scoring.

Metrics run on three stand-in models whose predictions follow from fixed rules over the events table, so that SQL can
check them; training and scoring run MLlib on the accident table without the injury columns, which give the class away.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gravitas.functions.columns import pearson, rounded
from gravitas.operators import metrics, models, ranking
from gravitas.plans.prepare import Preparation, prepare_splits
from gravitas.plans.prepare_queries import SPLIT_CTES
from gravitas.plans.profile_queries import T, describe_sql, union_all
from gravitas.plans.registry import on_accidents, on_predictions, query, r
from gravitas.plans.training import Training
from gravitas.session import fresh_path
from gravitas.sources import sinks
from gravitas.sources.accidents import accidents, events, predictions, spark_accidents_sql
from gravitas.streaming import saved, score

BY = ["model"]


def probs():
    return F.array(*[F.col(f"p{k}") for k in range(4)])


@query(
    "class_weights",
    on_accidents(f"select {T} as class, count(*) as n, {r('(select count(*) from accidents) / (4.0::double * count(*))')} as weight "
                 "from accidents group by 1"),
)
def _(spark, sf):
    return rounded(models.class_weights(accidents(spark, sf), T))


# --- metrics from the confusion matrix

PAIRS = "select model, actual, predicted, count(*) as n from predictions group by all"
GRID = (
    "select m.model, a.k as actual, p.k as predicted, coalesce(n, 0) as n from (select distinct model from predictions) m, "
    "(select distinct actual as k from predictions) a, (select distinct actual as k from predictions) p "
    f"left join ({PAIRS}) c on c.model = m.model and c.actual = a.k and c.predicted = p.k"
)


@query(
    "confusion_matrix",
    on_predictions(f"select model, actual, predicted, n, {r('n * 100.0 / sum(n) over (partition by model, actual)')} as percent from ({GRID})"),
)
def _(spark, sf):
    return rounded(metrics.confusion_matrix(predictions(spark, sf), "actual", "predicted", BY))


PER_CLASS = (
    "per_class",
    "select model, k, t, p, h, coalesce(h / nullif(p, 0)::double, 0) as prec, coalesce(h / nullif(t, 0)::double, 0) as rec, "
    "coalesce(2 * h / nullif(t + p, 0)::double, 0) as f1 from (select model, k, count(*) filter (where actual = k) as t, "
    "count(*) filter (where predicted = k) as p, count(*) filter (where actual = k and predicted = k) as h "
    "from predictions, (select unnest(range(4)) as k) group by 1, 2)",
)
RESULT_SQL = (
    "select model, s, sum(h)::double / s as acc, avg(rec) filter (where t > 0) as bal, sum(t * prec) / s as prec, "
    "sum(t * rec) / s as rec, sum(t * f1) / s as f1, sum(t * p)::double as tp, sum(t * t)::double as tt, "
    "sum(p * p)::double as pp, sum(h)::double as c from per_class join (select model, sum(t)::double as s from per_class "
    "group by 1) using (model) group by model, s"
)
FIGURES = ("figures", RESULT_SQL)
FORMULAS = {
    "Accuracy": "acc",
    "Balanced_Accuracy": "bal",
    "Precision": "prec",
    "Recall": "rec",
    "F1_Score": "f1",
    "Matthews_Corr": "coalesce((c * s - tp) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0), 0)",
    "Cohen_Kappa": "(c / s - tp / (s * s)) / nullif(1 - tp / (s * s), 0)",
}


def metric_query(name: str, wanted: list[str]) -> None:
    sql = "select model, " + ", ".join(f"{r(FORMULAS[m])} as {m}" for m in wanted) + " from figures"

    @query(name, on_predictions(sql, PER_CLASS, FIGURES))
    def _(spark, sf):
        return rounded(metrics.metric(predictions(spark, sf), "actual", "predicted", wanted, BY))


metric_query("metric_accuracy", ["Accuracy"])
metric_query("metric_balanced_accuracy", ["Balanced_Accuracy"])
metric_query("metric_weighted_prf", ["Precision", "Recall", "F1_Score"])
metric_query("metric_mcc", ["Matthews_Corr"])
metric_query("metric_kappa", ["Cohen_Kappa"])

LOSS = "select model, -avg(ln(greatest(case actual when 0 then p0 when 1 then p1 when 2 then p2 else p3 end, 2.2e-16))) as l from predictions group by 1"


@query("metric_log_loss", on_predictions(f"select model, {r('l')} as Log_Loss from ({LOSS})"))
def _(spark, sf):
    return rounded(metrics.log_loss(predictions(spark, sf), "actual", probs(), BY))


@query(
    "classification_report",
    on_predictions(
        f"select model, k::varchar as label, {r('prec', 3)} as precision, {r('rec', 3)} as recall, {r('f1', 3)} as f1, t::double as support "
        f"from per_class union all select model, 'accuracy', {r('acc', 3)}, {r('acc', 3)}, {r('acc', 3)}, {r('acc', 3)} from figures "
        f"union all select model, 'macro avg', {r('avg(prec)', 3)}, {r('avg(rec)', 3)}, {r('avg(f1)', 3)}, sum(t)::double from per_class group by 1 "
        f"union all select model, 'weighted avg', {r('prec', 3)}, {r('rec', 3)}, {r('f1', 3)}, s from figures",
        PER_CLASS, FIGURES,
    ),
)
def _(spark, sf):
    return rounded(metrics.classification_report(predictions(spark, sf), "actual", "predicted", BY), 3)


# --- curves

SCORES = (
    "scores",
    union_all(
        f"select model, {k} as class, p{k} as score, count(*) filter (where actual = {k}) as pos, "
        f"count(*) filter (where actual <> {k}) as neg from predictions group by 1, 2, 3"
        for k in range(4)
    ),
)
ROC = (
    "roc",
    "select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model, class) as np, "
    "sum(neg) over (partition by model, class) as nn from scores window w as (partition by model, class order by score desc)",
)


def scores(spark, sf):
    return metrics.one_vs_rest(predictions(spark, sf), "actual", probs(), 4, BY)


@query("roc_cumulative", on_predictions(f"select model, class, {r('score', 9)} as score, pos, neg, tp::bigint as tp, fp::bigint as fp from roc", SCORES, ROC))
def _(spark, sf):
    return rounded(metrics.roc_cumulative(scores(spark, sf), BY), 9)


@query(
    "roc_points",
    on_predictions(
        f"select model, class, {r('score', 9)} as score, {r('fp / nn::double', 9)} as fpr, {r('tp / np::double', 9)} as tpr from "
        "(select *, lead(pos) over w as next_pos, lead(neg) over w as next_neg, lag(pos) over w as last_pos from roc "
        "window w as (partition by model, class order by score desc)) "
        "where next_pos is null or last_pos is null or pos * next_neg <> neg * next_pos "
        "union all select distinct model, class, null::double, 0.0::double, 0.0::double from scores", SCORES, ROC,
    ),
)
def _(spark, sf):
    return rounded(metrics.roc_points(scores(spark, sf), BY), 9)


@query(
    "roc_auc",
    on_predictions(f"select model, class, {r('sum(neg * (2 * tp - pos) / 2.0::double) / (max(np) * max(nn))::double')} as auc from roc group by 1, 2",
                   SCORES, ROC),
)
def _(spark, sf):
    return rounded(metrics.roc_auc(scores(spark, sf), BY))


@query(
    "score_confidence",
    on_predictions("select event_id, model, case when greatest(p0, p1, p2, p3) > 0.7 then 'High' "
                   "when greatest(p0, p1, p2, p3) > 0.5 then 'Medium' else 'Low' end as confidence from predictions"),
)
def _(spark, sf):
    return predictions(spark, sf).select("event_id", "model", metrics.confidence(probs()).alias("confidence"))


# --- tables of results of the stand-in models; their time is a sum over the ids, in place of a clock

TIME_MODULUS = {"Logistic Regression": 5, "Decision Tree": 7, "Random Forest": 11}
TIME_SQL = "sum(event_id % case model " + " ".join(f"when '{m}' then {k}" for m, k in TIME_MODULUS.items()) + " end) / 1000.0"
TIMES = ("times", f"select model, cast({TIME_SQL} as double) as t from predictions group by 1")
RESULTS = (
    "results",
    'select model as "Model", t as Training_Time, ' + ", ".join(f"{f} as {m}" for m, f in FORMULAS.items())
    + " from figures join times using (model)",
)
RESULT_CTES = [PER_CLASS, FIGURES, TIMES, RESULTS]


def results(spark, sf):
    pred = predictions(spark, sf)
    clock = pred.groupBy("model").agg(F.expr(f"cast({TIME_SQL} as double)").alias("Training_Time"))
    figures = metrics.summary(metrics.outcome_counts(pred, "actual", "predicted", BY), BY)
    return figures.join(F.broadcast(clock), "model").withColumnRenamed("model", "Model")


@query(
    "compare_models",
    on_predictions(
        union_all(f"select \"Model\", {r('Training_Time')} as Training_Time, '{m}' as metric, {r(m)} as value from results" for m in ranking.COMPARED),
        *RESULT_CTES,
    ),
)
def _(spark, sf):
    return rounded(ranking.compare_models(results(spark, sf)))


def rank_sql(x: str, order: str) -> str:
    return f"(rank() over (order by {x} {order}) + (count(*) over (partition by {x}) - 1) / 2.0)::double"


@query(
    "model_ranking",
    on_predictions(
        f"select *, {rank_sql('round(Average_Rank, 9)', 'asc')} as Overall_Rank from (select *, "
        f"({' + '.join(m + '_Rank' for m in ranking.COMPARED)}) / {len(ranking.COMPARED)} as Average_Rank from (select \"Model\", "
        + ", ".join(f"{rank_sql(f'round({m}, 9)', 'desc')} as {m}_Rank" for m in ranking.COMPARED) + " from results))",
        *RESULT_CTES,
    ),
)
def _(spark, sf):
    return ranking.model_ranking(results(spark, sf))


def best_sql(m: str) -> str:
    return (
        f"select '{m}' as metric, (select \"Model\" from results order by round({m}, 9) desc, \"Model\" limit 1) as \"Model\", "
        f"{r(f'max({m})')} as score from results"
    )


@query("select_best_model", on_predictions(best_sql("F1_Score"), *RESULT_CTES))
def _(spark, sf):
    return rounded(ranking.select_best_model(results(spark, sf)))


@query("best_per_metric", on_predictions(union_all(best_sql(m) for m in ranking.REPORTED), *RESULT_CTES))
def _(spark, sf):
    return rounded(ranking.best_per_metric(results(spark, sf)))


@query(
    "training_time_summary",
    on_predictions(
        f"select {r('sum(Training_Time)')} as total_time, {r('avg(Training_Time)')} as mean_time, "
        '(select "Model" from results order by Training_Time, "Model" limit 1) as fastest, '
        f"{r('min(Training_Time)')} as fastest_time, "
        '(select "Model" from results order by Training_Time desc, "Model" limit 1) as slowest, '
        f"{r('max(Training_Time)')} as slowest_time from results",
        *RESULT_CTES,
    ),
)
def _(spark, sf):
    return rounded(ranking.training_time_summary(results(spark, sf)))


# Stand-in importance: how closely a column follows the actual class among a model's rows.
IMPORTANT = ["event_id", "predicted", "p0", "p1", "p2", "p3"]


def importances(spark, sf):
    per = predictions(spark, sf).groupBy("model").agg(*[F.abs(pearson(F.col(c), F.col("actual"))).alias(c) for c in IMPORTANT])
    return per.withColumnRenamed("model", "Model").unpivot(["Model"], IMPORTANT, "Feature", "Importance")


@query(
    "mean_importance_top5",
    on_predictions(
        f"select feature as Feature, {r('avg(i)')} as Importance from (select *, row_number() over (partition by model order by "
        "round(i, 9) desc, feature) as place from imp) where place <= 10 group by 1 order by round(avg(i), 9) desc, 1 limit 5",
        ("imp", union_all(f"select model, '{c}' as feature, abs(corr({c}, actual)) as i from predictions group by 1" for c in IMPORTANT)),
    ),
)
def _(spark, sf):
    return rounded(ranking.mean_importance_top5(importances(spark, sf)))


CV_CTES = [
    ("by_fold", "select *, event_id % 5 as fold from predictions"),
    (
        "fold_class",
        "select model, fold, k, t, p, h, coalesce(h / nullif(p, 0)::double, 0) as prec, coalesce(h / nullif(t, 0)::double, 0) as rec, "
        "coalesce(2 * h / nullif(t + p, 0)::double, 0) as f1 from (select model, fold, k, count(*) filter (where actual = k) as t, "
        "count(*) filter (where predicted = k) as p, count(*) filter (where actual = k and predicted = k) as h "
        "from by_fold, (select unnest(range(4)) as k) group by 1, 2, 3)",
    ),
    (
        "fold_figures",
        "select model, fold, sum(h)::double / sum(t) as Accuracy, sum(t * prec) / sum(t) as \"Precision\", "
        "sum(t * rec) / sum(t) as Recall, sum(t * f1) / sum(t) as F1 from fold_class group by 1, 2",
    ),
    (
        "cv",
        'select model as "Model", '
        + ", ".join(f'avg("{m}") as CV_{m}_Mean, stddev_pop("{m}") as CV_{m}_Std' for m in ("Accuracy", "Precision", "Recall", "F1"))
        + " from fold_figures group by 1",
    ),
]


def cv_table(spark, sf):
    folded = predictions(spark, sf).withColumn("fold", F.col("event_id") % 5)
    per_fold = metrics.metric(folded, "actual", "predicted", ["Accuracy", "Precision", "Recall", "F1_Score"], ["model", "fold"])
    return models.cv_summary(per_fold.withColumnRenamed("model", "Model"))


@query(
    "cv_summary",
    on_predictions(
        'select "Model", ' + ", ".join(f"{r(f'CV_{m}_{k}')} as CV_{m}_{k}" for m in ("Accuracy", "Precision", "Recall", "F1") for k in ("Mean", "Std"))
        + " from cv", *CV_CTES,
    ),
)
def _(spark, sf):
    return rounded(cv_table(spark, sf))


@query(
    "model_advice",
    on_predictions(
        "select max(F1_Score) - min(F1_Score) < 0.05 as similar, max(F1_Score) < 0.8 as weak, "
        '(select "Model" from results order by round(F1_Score / Training_Time, 9) desc, "Model" limit 1) as most_efficient, '
        "coalesce((select string_agg(\"Model\", ', ' order by \"Model\") from cv where CV_F1_Std > 0.05), '') as unstable, "
        "(select count(*) from cv where CV_F1_Std > 0.05) as n_unstable, "
        '(select "Model" from cv order by round(CV_F1_Mean, 9) desc, "Model" limit 1) as best_cv_model, '
        f"(select {r('max(CV_F1_Mean)')} from cv) as best_cv_f1 from results",
        *RESULT_CTES, *CV_CTES,
    ),
)
def _(spark, sf):
    return rounded(ranking.model_advice(results(spark, sf), cv_table(spark, sf)))


@query("results_describe", on_predictions(describe_sql("results", list(FORMULAS), digits=6), *RESULT_CTES))
def _(spark, sf):
    return rounded(ranking.results_describe(results(spark, sf), list(FORMULAS)))


# --- MLlib: training and scoring

INPUTS = ["event_id", "crash_date", "crash_hour", "crash_day_of_week", "weather_condition", "road_defect", "num_units", T]


def model_rows(spark, sf):
    return accidents(spark, sf).select(*INPUTS)


def training(spark, sf, names, profile=models.JOB):
    done = prepare_splits(model_rows(spark, sf))
    run = Training(done.parts["train"], done.parts["test"], done.fitted.features, T, done.parts["validation"])
    run.define_models(profile, names)
    return run, done


def fitted_results(spark, sf, names, profile=models.JOB):
    run, _ = training(spark, sf, names, profile)
    return rounded(run.train_and_evaluate().drop("Training_Time"))


@query("fit_logistic")
def _(spark, sf):
    return fitted_results(spark, sf, ["Logistic Regression"])


@query("fit_tree")
def _(spark, sf):
    return fitted_results(spark, sf, ["Decision Tree"])


@query("fit_forest")
def _(spark, sf):
    return fitted_results(spark, sf, ["Random Forest"])


@query("train_and_evaluate")
def _(spark, sf):
    run, _ = training(spark, sf, None)
    return rounded(run.train_and_evaluate())


@query(
    "training_facts",
    on_accidents(
        'select m as "Model", c as class, (select count(*) from splits where split = \'train\') as train_samples, '
        "(select count(*) from splits where split = 'test') as test_samples, (select count(distinct c) from splits where split = 'train') as classes, "
        "count(*) as support, true as probabilities_add_up, true as likeliest_predicted, case when m <> 'Logistic Regression' then 1.0::double end as importance "
        "from splits, (values ('Logistic Regression'), ('Decision Tree'), ('Random Forest')) as t(m) where split = 'test' group by m, c",
        *SPLIT_CTES,
    ),
)
def _(spark, sf):
    """What must hold for any models fitted on the splits, read off the training log, the predictions and importances."""
    run, _ = training(spark, sf, None)
    run.train_and_evaluate()
    p, names = F.col("probability"), F.array(*[F.lit(c) for c in run.ready.classes])
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    facts = run.predictions.groupBy("Model", F.element_at(names, F.col("actual") + 1).alias("class")).agg(
        F.count("*").alias("support"), F.bool_and(F.abs(total - 1) < 1e-9).alias("probabilities_add_up"),
        F.bool_and(F.element_at(p, F.col("predicted") + 1) == F.array_max(p)).alias("likeliest_predicted"),
    )
    every = models.feature_importance(spark, run.trained, run.features, k=len(run.features))
    importance = every.groupBy("Model").agg(F.sum("Importance").alias("importance"))
    log = run.training_log().select("Model", "train_samples", "test_samples", "classes")
    return rounded(log.join(facts, "Model").join(importance, "Model", "left"))


@query("cv_scores")
def _(spark, sf):
    run, _ = training(spark, sf, None)
    return rounded(run.perform_cross_validation("event_id"))


@query("tune_hyperparameters")
def _(spark, sf):
    run, _ = training(spark, sf, None)
    return rounded(run.tune_hyperparameters("event_id"))


@query("feature_importance")
def _(spark, sf):
    run, _ = training(spark, sf, ["Decision Tree", "Random Forest"])
    run.train_and_evaluate()
    return rounded(models.feature_importance(spark, run.trained, run.features))


@query("feature_coefficients")
def _(spark, sf):
    run, _ = training(spark, sf, ["Logistic Regression"])
    run.train_and_evaluate()
    model = run.trained.models["Logistic Regression"]
    return rounded(models.feature_coefficients(spark, model, run.features, run.ready.classes))


@query("sink_model")
def _(spark, sf):
    run, _ = training(spark, sf, None)
    run.train_and_evaluate()
    return run.save_best_model(fresh_path(spark, "models")).drop("written_at", "model_file")


@query("model_catalog")
def _(spark, sf):
    run, _ = training(spark, sf, None)
    run.train_and_evaluate()
    path = fresh_path(spark, "models")
    run.save_best_model(path)
    run.pipelines()["Decision Tree"].write().save(f"{path}/undescribed/model")
    return sinks.model_catalog(spark, path).drop("uid")


#: Where the scorer of a folder of tables was saved, by application and folder.
SCORERS: dict[tuple[str, str], str] = {}


def scorer(spark, sf):
    """A tree fitted and saved with its preparation, once per application, and loaded each time; it turns raw rows into
    scored ones."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in SCORERS:
        run, done = training(spark, sf, ["Decision Tree"])
        run.train_and_evaluate()
        path = fresh_path(spark, "scorer")
        saved.save_scorer(done.fitted, run.pipelines()["Decision Tree"], run.ready.classes, "event_id", path, spark)
        SCORERS[at] = path
    return saved.load_scorer(spark, SCORERS[at])


@query("score_batch")
def _(spark, sf):
    return rounded(scorer(spark, sf)(model_rows(spark, sf)).drop("probability"))


@query("score_stream")
def _(spark, sf):
    apply = scorer(spark, sf)
    schema = events(spark, sf).schema

    def transform(stream):
        return apply(spark.sql(spark_accidents_sql("{events}"), events=stream).select(*INPUTS))

    out = score.score_stream(
        spark, f"{sf}/events.parquet*", schema, transform, fresh_path(spark, "scored"), fresh_path(spark, "offsets")
    )
    return rounded(out.drop("probability"))


# --- the preparation as a whole


def prepared(spark, sf):
    prep = Preparation(accidents(spark, sf))
    prep.transform_datetime()
    prep.handle_missing_values()
    prep.outlier_treatment()
    prep.feature_engineering()
    prep.encode_features()
    return prep


ADDED = (
    "is_night, is_morning_rush, is_evening_rush, time_period, is_weekend, has_severe_injury, injury_rate, bad_weather, "
    "risk_score, night_bad_weather, weekend_night"
)


@query(
    "prep_log",
    on_accidents(
        "select step, action, case when no > 1 then n end as rows_before, cols_before, n as rows_after, cols_after, details from ("
        "select 1 as no, 'data_loading' as step, 'loaded_data' as action, null::int as cols_before, 14 as cols_after, 'rows: ' || n as details from s "
        "union all select 2, 'datetime', 'extract_features', 14, 16, 'columns: year, month, day, hour' "
        "union all select 3, 'missing_values', 'imputation', 16, 16, 'columns: ' || c || ', cells: ' || cells from s "
        "union all select 4, 'outlier_treatment', 'iqr_capping', 16, 16, 'columns: 4' "
        f"union all select 5, 'feature_engineering', 'create_features', 16, 27, 'added: {ADDED}' "
        "union all select 6, 'feature_encoding', 'auto_encoding', 27, 27, 'columns: 3'), s",
        (
            "s",
            "select n, (w > 0)::int + (u > 0)::int + (i > 0)::int as c, w + u + i as cells from (select count(*) as n, "
            "count(*) - count(weather_condition) as w, count(*) - count(num_units) as u, count(*) - count(injuries_total) as i from accidents)",
        ),
    ),
)
def _(spark, sf):
    return prepared(spark, sf).prep_log()


@query("prep_summary")
def _(spark, sf):
    return prepared(spark, sf).generate_preparation_summary()


@query(
    "prepare_splits",
    on_accidents("select split, c as most_severe_injury, count(*) as n from splits group by 1, 2", *SPLIT_CTES),
)
def _(spark, sf):
    done = prepare_splits(model_rows(spark, sf))
    parts = [df.select(F.lit(n).alias("split"), T) for n, df in done.parts.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("split", T).agg(F.count("*").alias("n"))


