"""A fitted preparation and its model in one folder, so that another session can score raw rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from gravitas.operators import cap, encode, impute, scale
from gravitas.operators.outliers import outside
from gravitas.plans.prepare import Fitted
from gravitas.streaming.score import score_batch


@dataclass(frozen=True)
class Scorer:
    """Raw rows, of a table or a stream, to classes with probabilities."""

    fitted: Fitted
    pipeline: PipelineModel
    classes: list[str]
    row_id: str

    def __call__(self, raw: DataFrame) -> DataFrame:
        return score_batch(self.fitted.transform(raw), self.pipeline, self.fitted.features, self.classes, self.row_id)


def save_scorer(fitted: Fitted, pipeline: PipelineModel, classes: Sequence[str], row_id: str, path: str, spark: SparkSession) -> None:
    """Write the model, the code tables and everything else that was learned; an existing folder is an error."""
    pipeline.write().save(f"{path}/model")
    known = fitted.encoder.tables if fitted.encoder else {}
    state = {
        "fills": fitted.imputer.fills, "usual_weather": fitted.usual_weather, "cap_method": fitted.capper.method,
        "bounds": {c: (lo, hi) for c, (lo, hi, _) in fitted.capper.bounds.items()}, "logged": fitted.logged,
        "codes": {c: (n, small) for c, (_, n, small) in known.items()}, "scale_method": fitted.scaler.method,
        "scale": fitted.scaler.params, "features": fitted.features, "classes": list(classes), "row_id": row_id,
    }
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{path}/state")
    for c, (table, _, _) in known.items():
        table.write.parquet(f"{path}/codes/{c}")


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    state = json.loads(spark.read.text(f"{path}/state").first()["value"])
    tables = {c: (spark.read.parquet(f"{path}/codes/{c}"), n, small) for c, (n, small) in state["codes"].items()}
    fitted = Fitted(
        impute.Imputer({c: tuple(v) for c, v in state["fills"].items()}),
        state["usual_weather"],
        cap.Capper(state["cap_method"], {c: (lo, hi, outside(c, lo, hi)) for c, (lo, hi) in state["bounds"].items()}),
        state["logged"],
        encode.LabelEncoder(tables) if tables else None,
        scale.Scaler(state["scale_method"], {c: tuple(v) for c, v in state["scale"].items()}),
        state["features"],
    )
    return Scorer(fitted, PipelineModel.load(f"{path}/model"), state["classes"], state["row_id"])
