"""The whole analysis of one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame

from vistrata.functions.columns import numeric_columns
from vistrata.functions.names import underscore_names
from vistrata.operators.cleaning import clean
from vistrata.operators.forecast import collect_forecasts, forecast, forecast_summary
from vistrata.operators.isolation import anomaly_overview, anomaly_sample, detect
from vistrata.operators.layouts import time_values
from vistrata.operators.profile import carry_facts, with_facts
from vistrata.operators.series import detect_metrics, detect_time_column, prepare_series
from vistrata.operators.statistics import full_statistics
from vistrata.plans import charts
from vistrata.plans.kpis import kpis
from vistrata.plans.summary import dataset_profile, dataset_summary, profile_text
from vistrata.session import stage

SAMPLE_ROWS = 10


@dataclass
class Dashboard:
    """Everything one run produced, as frames; nothing is shared between runs."""
    cleaned: DataFrame
    cleaning_report: DataFrame
    kpis: DataFrame
    charts: dict[str, object] = field(default_factory=dict)
    summary: dict[str, DataFrame] = field(default_factory=dict)
    labelled: DataFrame | None = None
    anomalies: dict[str, DataFrame] = field(default_factory=dict)
    forecasts: DataFrame | None = None
    forecast_summary: DataFrame | None = None
    sections: DataFrame | None = None
    profile: dict[str, DataFrame] = field(default_factory=dict)
    profile_lines: DataFrame | None = None

    def frames(self) -> dict[str, DataFrame]:
        """Every frame by its path, as in `charts.histograms.bins`."""
        out = {}

        def walk(path: str, value: object) -> None:
            if isinstance(value, DataFrame):
                out[path] = value
            elif isinstance(value, dict):
                for key, part in value.items():
                    walk(f"{path}.{key}", part)

        for f in fields(self):
            walk(f.name, getattr(self, f.name))
        return out


def dashboard(df: DataFrame, exclude: Sequence[str] = (), pairs: Sequence[tuple[str, str]] | None = None,
              time_column: str | None = None, metrics: Sequence[str] | None = None, seed: int = 0) -> Dashboard:
    """Clean, then figures, charts, summary, anomalies, forecasts and profile.

    The cleaned frame is staged once. Forecasts and profile read the labelled frame, where `anomaly` is one
    more numeric column, as figures and charts come before it.
    """
    result = clean(df, exclude)
    # One scan gathers what every later step asks about columns.
    frame = with_facts(stage(underscore_names(result.frame), "dashboard"))
    out = Dashboard(frame, result.report, kpis(frame))
    statistics = None
    if numeric_columns(frame):
        # Histograms, scatters, correlation and summary share one set of column statistics.
        statistics = stage(full_statistics(frame), "statistics")
        out.charts["histograms"] = charts.chart_histograms(frame, statistics)
        out.charts["scatters"] = charts.chart_scatters(frame, statistics)
        out.charts["correlation"] = charts.chart_correlation(frame, statistics)
    out.charts["bars"] = charts.chart_bars(frame)
    out.charts["pies"] = charts.chart_pies(frame)
    out.charts["group_means"] = charts.chart_group_means(frame, pairs)
    out.summary = dataset_summary(frame, statistics)

    labelled = frame
    if numeric_columns(frame):
        found = detect(frame, seed=seed)
        labelled = out.labelled = carry_facts(frame, found.labelled, extra=["anomaly"])
        rows = found.anomalies
        out.anomalies = {"rows": rows, "sample": anomaly_sample(found, SAMPLE_ROWS),
                         "overview": anomaly_overview(rows)}
        out.charts["anomaly_scatter"] = charts.anomaly_scatter(labelled)

    time_column = time_column or detect_time_column(labelled)
    if time_column:
        metrics = metrics or detect_metrics(labelled, time_column)
        made = stage(forecast(prepare_series(labelled, time_column, metrics)), "forecast")
        out.forecasts, out.forecast_summary = collect_forecasts(made), forecast_summary(made)
        # From here on the time column is one, whatever text it was read as.
        timed = labelled.withColumn(time_column, time_values(labelled, time_column))
        labelled = carry_facts(labelled, timed, less=[time_column])
        out.labelled = labelled if out.labelled is not None else None
    out.charts = charts.staged_points(out.charts)
    out.sections = charts.chart_sections(charts.chart_index(out.charts, out.forecasts))
    # The lines read every part once more.
    out.profile = {name: stage(part, "profile") for name, part in dataset_profile(labelled).items()}
    out.profile_lines = profile_text(out.profile)
    return out
