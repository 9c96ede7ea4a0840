"""Writing prepared tables, splits and models, each next to a small JSON table that describes it."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gravitas.operators.ranking import select_best_model
from gravitas.sources.tables import scan_table

LOG_SCHEMA = (
    "step string, action string, rows_before long, cols_before int, rows_after long, cols_after int, details string"
)


def write_info(spark: SparkSession, path: str, schema: str, values: tuple) -> None:
    info = spark.createDataFrame([values], schema).withColumn("written_at", F.current_timestamp().cast("string"))
    info.coalesce(1).write.mode("overwrite").json(path)


def sink_table(
    df: DataFrame, path: str, target: str, original_shape: tuple[int, int] | None = None,
    log: Sequence[tuple] = (), encoder_classes: Mapping[str, int] | None = None,
) -> DataFrame:
    """Write the table to ``path/data`` and its description to ``path/info``; the description as a table."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/data")
    rows = spark.read.parquet(f"{path}/data").count()
    schema = (
        "original_shape array<long>, final_shape array<long>, target_variable string, "
        f"preparation_steps array<struct<{LOG_SCHEMA.replace(' ', ':').replace(',:', ',')}>>, "
        "encoders_info map<string,int>, feature_names array<string>"
    )
    values = (
        list(original_shape) if original_shape else None, [rows, len(df.columns)], target, list(log),
        dict(encoder_classes or {}), df.columns,
    )
    write_info(spark, f"{path}/info", schema, values)
    return spark.read.schema(schema + ", written_at string").json(f"{path}/info")


def sink_splits(df: DataFrame, path: str, target: str, test_size: float, validation_size: float, seed: int) -> DataFrame:
    """Write a table with a ``split`` column, one folder per split; sizes per split as a table."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    features = [c for c in df.columns if c not in ("split", target)]
    sizes = spark.read.parquet(f"{path}/data").groupBy("split").agg(F.count("*").alias("samples")).withColumn(
        "features", F.lit(len(features)).cast("bigint")
    )
    info = {r["split"]: r["samples"] for r in sizes.collect()}
    write_info(
        spark, f"{path}/info",
        "test_size double, validation_size double, random_state int, stratified boolean, splits_info map<string,long>, "
        "target_variable string, feature_names array<string>",
        (test_size, validation_size, seed, True, info, target, features),
    )
    return sizes


def folder_name(model: str) -> str:
    """The name without characters that a path should not hold."""
    return re.sub(r"[^A-Za-z0-9_.-]", "", re.sub(r"\s", "_", model))


def sink_model(
    results: DataFrame, pipelines: Mapping[str, PipelineModel], path: str, metric: str = "F1_Score",
    tuned: Mapping[str, PipelineModel] | None = None,
) -> DataFrame:
    """Save the best model by a metric with its figures; tuned ones are called ``NAME (Tuned)`` in the results."""
    spark = results.sparkSession
    best = select_best_model(results, metric).first()
    known = dict(pipelines) | {f"{n} (Tuned)": m for n, m in (tuned or {}).items()}
    if best["Model"] not in known:
        raise ValueError(f"best model {best['Model']!r} is not among {sorted(known)}")
    model = known[best["Model"]]
    folder = f"{path}/{folder_name(best['Model'])}"
    model.write().overwrite().save(f"{folder}/model")
    row = results.where(F.col("Model") == best["Model"]).first().asDict()
    figures = {k: float(v) for k, v in row.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    classifier = model.stages[-1]
    params = {p.name: str(v) for p, v in classifier.extractParamMap().items()}
    schema = (
        "model_name string, selection_metric string, selection_score double, model_type string, model_file string, "
        "performance_metrics map<string,double>, feature_count int, model_parameters map<string,string>"
    )
    values = (
        best["Model"], metric, float(best["score"]), type(classifier).__name__, folder, figures, classifier.numFeatures, params,
    )
    write_info(spark, f"{folder}/info", schema, values)
    return spark.read.schema(schema + ", written_at string").json(f"{folder}/info")


CATALOG = (
    "name string, class string, uid string, model_name string, selection_metric string, selection_score double, "
    "model_type string, feature_count int, performance_metrics map<string,double>"
)


def _matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any file has such a path; also false if the folder is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def model_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Saved models with what their description says; one whose description is missing or unreadable is still listed."""
    if not _matches(spark, f"{path}/*/model/metadata/part-*"):
        return spark.createDataFrame([], CATALOG)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/(?:model/metadata|info)/[^/]+$", 1)
    found = spark.read.text(f"{path}/*/model/metadata/part-*").select(
        folder.alias("name"), F.get_json_object("value", "$.class").alias("class"), F.get_json_object("value", "$.uid").alias("uid")
    )
    if not _matches(spark, f"{path}/*/info/part-*"):
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(CATALOG).fields[3:]]
        return found.select("*", *blank)
    described = (
        spark.read.text(f"{path}/*/info/part-*")
        .select(
            folder.alias("name"),
            F.from_json(
                "value",
                "model_name string, selection_metric string, selection_score double, model_type string, feature_count int, "
                "performance_metrics map<string,double>",
            ).alias("i"),
        )
        .select("name", "i.*")
    )
    return found.join(described, "name", "left")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return scan_table(spark, f"{path}/data")
