"""The whole profile of an accident table, step by step, with its findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gravitas import preset
from gravitas.functions.columns import numeric_columns, require
from gravitas.operators import correlation, crosstabs, distributions, outliers, quality, rules
from gravitas.sources.tables import scan_table


class Profile:
    """Analyses of one table. Each returns tables by name and adds its findings; the input is never changed."""

    def __init__(self, df: DataFrame, target: str = preset.TARGET):
        require(df, target)
        self.df = df
        self.target = target
        #: Findings as (kind, subject, figure).
        self.found: list[tuple[str, str, float]] = []

    @classmethod
    def load_data(cls, spark: SparkSession, path: str, fmt: str = "csv", target: str = preset.TARGET) -> Profile:
        return cls(scan_table(spark, path, fmt), target)

    def _has(self, *cols: str) -> bool:
        return all(c in self.df.columns for c in cols)

    def initial_exploration(self) -> dict[str, DataFrame]:
        out = {"dtypes": quality.dtype_summary(self.df), "quality": quality.quality_metrics(self.df)}
        numeric = numeric_columns(self.df)
        if numeric:
            out["describe"] = distributions.describe_numeric(self.df, numeric)
        row = quality.missing_total(self.df).first()
        self.found.append(("rows", "table", row["cells"] // len(self.df.columns)))
        self.found.append(("missing percent", "table", row["missing_percent"] or 0))
        return out

    def target_distribution(self) -> dict[str, DataFrame]:
        dist = distributions.target_distribution(self.df, self.target)
        top = dist.orderBy("n", ascending=False).first()
        if top:
            self.found.append(("largest class percent", str(top["value"]), top["percent"]))
        return {"distribution": dist, "imbalance": distributions.class_imbalance(self.df, self.target)}

    def missing_value_analysis(self) -> dict[str, DataFrame]:
        missing = quality.missing_by_column(self.df)
        worst = missing.first()
        if worst:
            self.found.append(("highest missing percent", worst["feature"], worst["missing_percent"]))
        return {"missing": missing, "patterns": quality.missing_correlation(self.df)}

    def univariate_analysis(self) -> dict[str, DataFrame]:
        out = {}
        if self._has(preset.HOUR):
            out["hourly"] = distributions.hourly_distribution(self.df, preset.HOUR)
            out["rush_hours"] = distributions.rush_hour_totals(self.df, preset.HOUR)
            peak = out["hourly"].where("is_peak").first()
            if peak:
                self.found.append(("rows in the busiest hour", str(peak["code"]), peak["n"]))
        if self._has(preset.DAY):
            out["daily"] = distributions.daily_distribution(self.df, preset.DAY)
        if self._has(preset.MONTH):
            out["monthly"] = distributions.monthly_distribution(self.df, preset.MONTH)
        if self._has(preset.WEATHER):
            out["weather"] = distributions.category_top10(self.df, preset.WEATHER)
            usual = out["weather"].where("is_most_common").first()
            if usual:
                self.found.append(("rows in the usual weather", str(usual["value"]), usual["n"]))
        return out

    def bivariate_analysis(self) -> dict[str, DataFrame]:
        out = {}
        if self._has(preset.HOUR):
            out["hour_by_target"] = crosstabs.stacked_histogram(self.df, preset.HOUR, self.target)
            out["severity_rate"] = crosstabs.severity_rate_by_hour(self.df, preset.HOUR, self.target)
            peak = out["severity_rate"].where("is_peak").first()
            if peak:
                self.found.append(("highest severity percent by hour", str(peak["hour"]), peak["severity_rate"]))
        if self._has(preset.DAY):
            out["day_by_target"] = crosstabs.crosstab_row_pct(self.df, preset.DAY, self.target)
        if self._has(preset.WEATHER):
            out["weather_by_target"] = crosstabs.top_rows_crosstab(self.df, preset.WEATHER, self.target, 8)
        if self._has(preset.TOTAL):
            out["injuries_by_target"] = distributions.injury_stats_by_target(self.df, self.target, preset.TOTAL)
        return out

    def multivariate_analysis(self) -> dict[str, DataFrame]:
        out = {}
        if self._has(preset.HOUR, preset.DAY):
            out["risk_slots"] = crosstabs.risk_slots(self.df, preset.DAY, preset.HOUR)
            n = out["risk_slots"].count()
            if n:
                self.found.append(("busy day and hour slots", "table", n))
            out["risk_category"] = crosstabs.risk_category_severity(self.df, preset.HOUR, preset.DAY, self.target)
        if self._has(preset.WEATHER, preset.HOUR):
            kept = crosstabs.keep_top_values(self.df, {preset.WEATHER: 5, preset.HOUR: 8})
            out["weather_by_hour"] = crosstabs.crosstab_counts(kept, preset.WEATHER, preset.HOUR)
        if self._has(preset.WEATHER, preset.HOUR, preset.DAY):
            out["interactions"] = crosstabs.interaction_counts(self.df, preset.HOUR, preset.DAY, preset.WEATHER)
        return out

    def correlation_analysis(self) -> dict[str, DataFrame]:
        numeric = numeric_columns(self.df)
        if len(numeric) < 2:
            return {}
        matrix = correlation.correlation_matrix(self.df, numeric)
        out = {
            "matrix": matrix,
            "strong": correlation.strong_correlations(matrix),
            "collinear": correlation.multicollinearity(matrix),
        }
        if self.target in numeric:
            out["target"] = correlation.target_correlations(matrix, self.target)
        top = out["strong"].first()
        if top:
            self.found.append(("strongest correlation", f"{top['feature_1']}, {top['feature_2']}", top["correlation"]))
        return out

    def outlier_detection(self) -> dict[str, DataFrame]:
        cols = [c for c in preset.OUTLIER_COLUMNS if self._has(c)]
        if not cols:
            return {}
        bounds = outliers.iqr_bounds(self.df, cols)
        summary = outliers.outlier_iqr_summary(self.df, cols, bounds)
        out = {
            "summary": summary,
            "records": outliers.outlier_records(self.df, cols, bounds),
            "flags": outliers.outlier_flags(summary),
        }
        worst = summary.orderBy("percent", ascending=False).first()
        if worst:
            self.found.append(("highest outlier percent", worst["feature"], worst["percent"]))
        return out

    def domain_validation(self) -> dict[str, DataFrame]:
        known = [r for r in preset.RULES if self._has(r[0])]
        out = {"ranges": rules.domain_rules(self.df, known)}
        parts = [c for c in preset.INJURY_PARTS if self._has(c)]
        if self._has(preset.TOTAL) and len(parts) > 1:
            out["consistency"] = rules.injury_consistency(self.df, preset.TOTAL, parts)
            out["summary"] = rules.rules_summary(out["ranges"], out["consistency"])
        total = out["ranges"].agg({"invalid_count": "sum"}).first()[0] or 0
        self.found.append(("values outside their range", "table", total))
        return out

    def generate_summary(self) -> DataFrame:
        return quality.eda_summary(self.df, self.insights)

    @property
    def insights(self) -> list[str]:
        return [f"{kind}: {subject} = {figure:.6g}" for kind, subject, figure in self.found]

    def findings(self) -> DataFrame:
        """The findings so far, in the order they were made."""
        rows = [(i, kind, subject, float(figure)) for i, (kind, subject, figure) in enumerate(self.found, 1)]
        return self.df.sparkSession.createDataFrame(rows, "ordinal int, kind string, subject string, figure double")

    def run_complete_analysis(self) -> dict[str, dict[str, DataFrame]]:
        steps = [
            self.initial_exploration, self.target_distribution, self.missing_value_analysis, self.univariate_analysis,
            self.bivariate_analysis, self.multivariate_analysis, self.correlation_analysis, self.outlier_detection,
            self.domain_validation,
        ]
        out = {s.__name__: s() for s in steps}
        out["summary"] = {"summary": self.generate_summary()}
        return out


