"""Training, comparison, selection and scoring on prepared splits."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from gravitas import preset
from gravitas.operators import models, ranking
from gravitas.sources import sinks


class Training:
    """The three classifiers on one set of splits; results are tables, fitted models stay with the session."""

    def __init__(self, train: DataFrame, test: DataFrame, features: list[str], target: str = preset.TARGET, validation: DataFrame | None = None):
        self.target, self.features = target, features
        self.train_rows, self.test_rows, self.validation_rows = train, test, validation
        self.ready = models.prepare(train, target, features)
        self.estimators: dict = {}
        self.profile = models.JOB
        self.tuned: dict[str, PipelineModel] = {}
        self.results = self.trained = self.predictions = self.cv = None

    def define_models(self, profile: models.Profile = models.JOB, names: list[str] | None = None) -> dict:
        self.profile = profile
        every = models.define_models(self.ready.n_rows, profile)
        self.estimators = {n: e for n, e in every.items() if names is None or n in names}
        return self.estimators

    def _scored_frame(self, rows: DataFrame) -> DataFrame:
        return models.assembler(self.features).transform(self.ready.indexer.transform(rows))

    def _models(self, n_rows: int) -> dict:
        return {n: e for n, e in models.define_models(n_rows, self.profile).items() if n in self.estimators}

    def _fit(self, estimators: dict) -> tuple:
        held = self._scored_frame(self.validation_rows) if self.validation_rows is not None else None
        return models.train_and_evaluate(self.ready, self._scored_frame(self.test_rows), estimators, held)

    def perform_cross_validation(self, row_id: str, folds: int = 5) -> DataFrame:
        """Weights and penalties follow from the rows that each fold is fitted on."""

        self.cv = models.cross_validate(self.train_rows, self.target, row_id, self.features, self._models, folds)
        return self.cv

    def tune_hyperparameters(self, row_id: str, grid: dict = models.GRID, folds: int = 5) -> DataFrame:
        """Search settings of all models; the best of each is fitted on all training rows.

        The fitted ones join the results as ``NAME (Tuned)`` and may be saved as the best model.
        """
        search = models.tune(self.train_rows, self.target, row_id, self.features, self._models, grid, folds)
        best = {r["Model"]: r["params"] for r in search.where("is_best").collect()}
        settings = {n: next(s for s in grid[n] if models.settings_text(s) == text) for n, text in best.items()}
        chosen = {f"{n} (Tuned)": models.with_settings(self.estimators[n], s) for n, s in settings.items()}
        results, trained, _ = self._fit(chosen)
        self.tuned = {n: models.as_pipeline(self.ready, trained.models[f"{n} (Tuned)"]) for n in settings}
        self.results = results if self.results is None else self.results.unionByName(results)
        return search

    def train_and_evaluate(self) -> DataFrame:
        self.results, self.trained, self.predictions = self._fit(self.estimators)
        return self.results

    def training_log(self) -> DataFrame:
        """Rows, features, classes and seconds of each fitted model."""
        return models.training_log(self.test_rows, self.trained, self.test_rows.count())

    def pipelines(self) -> dict[str, PipelineModel]:
        return {n: models.as_pipeline(self.ready, m) for n, m in self.trained.models.items()}

    def compare_models(self) -> DataFrame:
        return ranking.compare_models(self.results)

    def get_best_model_name(self, metric: str = "F1_Score") -> str:
        return ranking.select_best_model(self.results, metric).first()["Model"]

    def save_best_model(self, path: str, metric: str = "F1_Score") -> DataFrame:
        fitted = self.pipelines() if self.trained else {}
        return sinks.sink_model(self.results, fitted, path, metric, self.tuned)

    def generate_analysis_report(self) -> dict[str, DataFrame]:
        spark = self.results.sparkSession
        importances = models.feature_importance(spark, self.trained, self.features)
        return {
            "best_per_metric": ranking.best_per_metric(self.results),
            "training_time": ranking.training_time_summary(self.results),
            "ranking": ranking.model_ranking(self.results),
            "advice": ranking.model_advice(self.results, self.cv),
            "mean_importance": ranking.mean_importance_top5(importances),
            "performance": ranking.results_describe(self.results, [c for c in self.results.columns if c != "Model"]),
        }


