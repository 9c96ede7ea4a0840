"""Preparation of an accident table: single steps with a log, and the run that keeps test rows out of every fit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravitas import preset
from gravitas.functions.columns import numeric_columns, require, string_columns
from gravitas.operators import cap, encode, features, impute, quality, resample, scale, skew, split
from gravitas.operators.distributions import mode_of
from gravitas.session import cached, fresh_path
from gravitas.sources import sinks
from gravitas.sources.tables import scan_table


class Preparation:
    """Steps on one table; each replaces ``df`` and is logged. Rows need a unique id for splits and resampling."""

    def __init__(self, df: DataFrame, target: str = preset.TARGET, row_id: str = "event_id"):
        require(df, target, row_id)
        self.df = self.original = df
        self.target, self.row_id = target, row_id
        self.rows = df.count()
        self.log: list[tuple] = []
        self.encoders: dict[str, int] = {}
        self._note("data_loading", "loaded_data", None, f"rows: {self.rows}")

    @classmethod
    def load_data(cls, spark: SparkSession, path: str, fmt: str = "csv", target: str = preset.TARGET, row_id: str = "event_id"):
        return cls(scan_table(spark, path, fmt), target, row_id)

    def _note(self, step: str, action: str, before: tuple[int, int] | None, details: str) -> None:
        rows, cols = before if before else (None, None)
        self.log.append((step, action, rows, cols, self.rows, len(self.df.columns), details))

    def _shape(self) -> tuple[int, int]:
        return self.rows, len(self.df.columns)

    def _features(self, cols: list[str]) -> list[str]:
        return [c for c in cols if c not in (self.target, self.row_id)]

    def handle_missing_values(self, strategy: str = "auto", order: str | None = None, by: list[str] | None = None) -> DataFrame:
        before = self._shape()
        if strategy in ("auto", "mode_median"):
            fitted = impute.fit_auto(self.df, preset.MOSTLY_NULL_PERCENT if strategy == "auto" else None)
            self.df = fitted.transform(self.df)
            details = f"columns: {len(fitted.fills)}, cells: {sum(n for *_, n in fitted.fills.values())}"
        elif strategy == "drop":
            self.df = impute.impute_drop(self.df)
            self.rows = self.df.count()
            details = f"rows left out: {before[0] - self.rows}"
        elif strategy == "forward_fill":
            cols = self._features(self.df.columns)
            cols = [c for c in cols if c != order and c not in (by or [])]
            self.df = impute.impute_ffill(self.df, cols, order or self.row_id, self.row_id, by or [])
            details = f"columns: {len(cols)}"
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
        self._note("missing_values", "imputation", before, details)
        return self.df

    def outlier_treatment(self, method: str = "iqr", threshold: float = preset.IQR_FACTOR) -> DataFrame:
        before = self._shape()
        cols = [c for c in preset.OUTLIER_COLUMNS if c in self.df.columns]
        fitted = cap.fit_cap(self.df, cols, method, threshold)
        self.df = fitted.transform(self.df)
        self._note("outlier_treatment", f"{method}_capping", before, f"columns: {len(fitted.bounds)}")
        return self.df

    def data_transformation(self, auto_detect_skew: bool = True, skew_threshold: float = preset.SKEW_THRESHOLD) -> DataFrame:
        before = self._shape()
        numeric = self._features(numeric_columns(self.df))
        if auto_detect_skew:
            cols = skew.skewed_columns(self.df, numeric, skew_threshold)
        else:
            cols = [c for c in preset.LOG_COLUMNS if c in numeric]
        self.df = skew.apply_log1p(self.df, cols)
        self._note("data_transformation", "log_transformation", before, f"columns: {len(cols)}")
        return self.df

    def transform_datetime(self, fmt: str = preset.DATE_FORMAT) -> DataFrame:
        before = self._shape()
        if preset.DATE in self.df.columns:
            self.df = features.datetime_features(self.df, preset.DATE, fmt)
            self._note("datetime", "extract_features", before, "columns: year, month, day, hour")
        return self.df

    def feature_engineering(self, create_interactions: bool = True) -> DataFrame:
        before = self._shape()
        had = set(self.df.columns)
        self.df = features.engineer(self.df, create_interactions)
        new = [c for c in self.df.columns if c not in had]
        self._note("feature_engineering", "create_features", before, f"added: {', '.join(new)}")
        return self.df

    def encode_features(self, encoding_strategy: str = "auto") -> DataFrame:
        before = self._shape()
        text = string_columns(self.df)
        if encoding_strategy in ("auto", "label"):
            fitted = encode.fit_label(self.df, text)
            self.encoders = fitted.classes()
            self.df = fitted.transform(self.df)
        elif encoding_strategy == "onehot":
            for c in self._features(text):
                self.df = encode.onehot(self.df, c)
        elif encoding_strategy == "target":
            classes = sorted(split.class_counts(self.df, self.target))
            for c in self._features(text):
                self.df = encode.encode_target(self.df, c, self.target, classes)
        else:
            raise ValueError(f"unknown strategy {encoding_strategy!r}")
        self._note("feature_encoding", f"{encoding_strategy}_encoding", before, f"columns: {len(text)}")
        return self.df

    def scale_features(self, scaling_method: str = "standard", exclude_binary: bool = True) -> DataFrame:
        before = self._shape()
        cols = self._features(numeric_columns(self.df))
        fitted = scale.fit_scale(self.df, cols, scaling_method, exclude_binary)
        self.df = fitted.transform(self.df)
        self._note("feature_scaling", f"{scaling_method}_scaling", before, f"columns: {len(fitted.params)}")
        return self.df

    def handle_imbalance(self, method: str = "smote", strategy: str | float | dict = "auto") -> DataFrame:
        before = self._shape()
        cols = self._features(numeric_columns(self.df))
        self.df = resample.resample(self.df, self.target, self.row_id, cols, method, strategy=strategy)
        self.rows = self.df.count()
        self._note("imbalance_handling", f"{method}_resampling", before, f"rows: {before[0]} to {self.rows}")
        return self.df

    def validate_data_quality(self) -> DataFrame:
        return quality.post_prep_checks(self.df, self.target)

    def prep_log(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(self.log, sinks.LOG_SCHEMA)

    def generate_preparation_summary(self) -> DataFrame:
        """Shapes, steps, nulls and copies before and after, and the final kinds of columns."""
        names = ["total_records", "total_features", "missing_values", "duplicate_rows"]
        first = quality.quality_metrics(self.original).select(*[F.col(n).alias(f"{n}_before") for n in names])
        last = quality.quality_metrics(self.df)
        after = last.select(*[F.col(n).alias(f"{n}_after") for n in names], "numeric_features", "categorical_features")
        return after.withColumn("b", first.select(F.struct("*")).scalar()).select(
            "b.*", *after.columns, F.lit(len(self.log)).cast("bigint").alias("steps_completed")
        )

    def save_model_ready_data(self, path: str) -> DataFrame:
        shape = (self.original.count(), len(self.original.columns))
        return sinks.sink_table(self.df, path, self.target, shape, self.log, self.encoders)

    def save_train_test_splits(
        self, path: str, test_size: float = preset.TEST_SIZE, validation_size: float = preset.VALIDATION_SIZE
    ) -> DataFrame:
        done = split.split_stratified(self.df, self.target, self.row_id, test_size, validation_size)
        sizes = sinks.sink_splits(done, path, self.target, test_size, validation_size, preset.SEED)
        self._note("train_test_split", "create_splits", self._shape(), f"Created splits in {path}")
        return sizes


@dataclass
class Fitted:
    """Everything learned from training rows, to be applied to any other rows."""

    imputer: impute.Imputer
    usual_weather: str | None
    capper: cap.Capper
    logged: list[str]
    encoder: encode.LabelEncoder | None
    scaler: scale.Scaler
    features: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = _dated(df)
        out = features.engineer(self.imputer.transform(out), True, self.usual_weather)
        out = skew.apply_log1p(self.capper.transform(out), self.logged)
        if self.encoder:
            out = self.encoder.transform(out, unknown_code=-1)
        return self.scaler.transform(_finite(out))


def _dated(df: DataFrame) -> DataFrame:
    return features.datetime_features(df, preset.DATE) if preset.DATE in df.columns else df


def _finite(df: DataFrame) -> DataFrame:
    """An endless rate, left by an injury total of -1, becomes 0."""
    if "injury_rate" not in df.columns:
        return df
    rate = F.col("injury_rate")
    return df.withColumn("injury_rate", F.when(rate.isNull() | (F.abs(rate) == float("inf")), 0.0).otherwise(rate))


def fit_preparation(train: DataFrame, target: str, row_id: str) -> Fitted:
    """Fit every step on training rows, in the order they are applied.

    Each fit is a pass; the rows are kept meanwhile, so that no pass parses dates or recomputes the split again. Every
    column that is not mostly null gets a fill, also for nulls that only later rows have; mostly null numbers are no
    features.
    """
    with cached(_dated(train)) as raw:
        imputer = impute.fit_auto(raw.drop(target, row_id), every=True)
        out = imputer.transform(raw)
        usual = mode_of(out, preset.WEATHER).first()["mode"] if preset.WEATHER in out.columns else None
        out = features.engineer(out, True, usual)
        measures = [c for c in preset.OUTLIER_COLUMNS if c in out.columns]
        capper = cap.fit_cap(out, measures)
        out = capper.transform(out)
        logged = skew.skewed_columns(out, measures) if measures else []
        out = skew.apply_log1p(out, logged)
        text = string_columns(out, [target])
        encoder = encode.fit_label(out, text) if text else None
        out = _finite(encoder.transform(out, unknown_code=-1) if encoder else out)
        gaps = [c for c in numeric_columns(raw) if c not in imputer.fills]
        numeric = numeric_columns(out, [target, row_id, "split", "fold", *gaps])
        scaler = scale.fit_scale(out, numeric, exclude_binary=True)
    return Fitted(imputer, usual, capper, logged, encoder, scaler, numeric)


@dataclass
class Splits:
    fitted: Fitted
    path: str
    parts: dict[str, DataFrame]


def prepare_splits(df: DataFrame, target: str = preset.TARGET, row_id: str = "event_id", method: str = "none") -> Splits:
    """Split first, fit on the training rows, apply to all, resample the training rows only, write once, read back.

    The written table cuts the lineage before training starts.
    """
    spark = df.sparkSession
    parted = split.split_stratified(df, target, row_id)
    fitted = fit_preparation(parted.where("split = 'train'").drop("split"), target, row_id)
    ready = fitted.transform(parted).select(row_id, target, "split", *fitted.features)
    path = fresh_path(spark, "prepared")
    sinks.sink_splits(ready, path, target, preset.TEST_SIZE, preset.VALIDATION_SIZE, preset.SEED)
    table = spark.read.parquet(f"{path}/data")
    parts = {s: table.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")}
    parts["train"] = resample.resample(parts["train"], target, row_id, fitted.features, method).drop("is_synthetic")
    return Splits(fitted, path, parts)
