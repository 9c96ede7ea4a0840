"""Scoring of whole tables and of unbounded input with the same saved model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gravitas.operators.metrics import confidence


def score_batch(df: DataFrame, model: PipelineModel, features: Sequence[str], classes: Sequence[str], row_id: str) -> DataFrame:
    """Class, probabilities and confidence per row; a missing feature counts as 0. Works on streams as well."""
    ready = df.select(row_id, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    labels = F.array(*[F.lit(c) for c in classes])
    scored = model.transform(ready).withColumn("p", vector_to_array("probability"))
    return scored.select(
        row_id,
        F.element_at(labels, F.col("prediction").cast("int") + 1).alias("predicted"),
        F.col("p").alias("probability"),
        F.array_max("p").alias("max_probability"),
        confidence(F.col("p")).alias("confidence"),
    )


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files of a folder or pattern as they arrive; a stream never infers its schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write what is there now to Parquet and stop; a later run with the same checkpoint goes on from there."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def score_stream(
    spark: SparkSession, path: str, schema: T.StructType, transform, out: str, checkpoint: str
) -> DataFrame:
    """Score every row that arrives. Each row is scored by itself, so there is no state and no watermark."""
    run_available(transform(read_stream(spark, path, schema)), out, checkpoint)
    return spark.read.parquet(out)
