"""Rolling-origin backtests of seasonal-naive forecasts, all series in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surety.schemas import ContractError, require_columns

# Fixed values of the backtest.
SEASON, HORIZON, ORIGINS, INTERVAL_ALPHA = 7, 7, 4, 0.10


@dataclass(frozen=True)
class PlanningGate:
    """Fixed values of the planning gate."""

    max_mape: float = 0.20
    max_wape: float = 0.20
    min_backtest_points: int = 28
    min_interval_coverage: float = 0.85
    require_noninferior_wape_to_benchmark: bool = True


@dataclass(frozen=True)
class MapeGate:
    """The older gate on MAPE alone."""

    max_mape: float = 0.20
    min_holdout_points: int = 28


def long_series(daily: DataFrame, metrics: list[str], keys: list[str] = ()) -> DataFrame:
    """(series, date, value) rows from a wide daily table; keys prefix the metric's name."""
    name = F.concat_ws(":", *[F.col(k) for k in keys], "metric")
    wide = daily.select(*keys, "date", *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot([*keys, "date"], metrics, "metric", "value").select(name.alias("series"), "date", "value")


def mature_history(gold: DataFrame, silver: DataFrame, boundary_event: str = "first_open") -> DataFrame:
    """Gold up to each product's last boundary event: later days see outcomes but no new users."""
    last = silver.where(F.col("event_type") == boundary_event).groupBy("product").agg(F.max(F.to_date("event_ts")).alias("_last"))
    return gold.join(last, "product").where(F.col("date") <= F.col("_last")).drop("_last")


def _numbered(series: DataFrame) -> DataFrame:
    by = Window.partitionBy("series")
    ordered = by.orderBy("date")
    return series.withColumn("i", F.row_number().over(ordered)).withColumn("n", F.count("*").over(by)).withColumn("back", F.lag("value", SEASON).over(ordered)).withColumn("back_date", F.lag("date", SEASON).over(ordered))


def check_series(series: DataFrame, origins: int = ORIGINS) -> None:
    """Refuse repeated dates, values missing, not finite or negative, and short series: one aggregate."""
    require_columns(series, ("series", "date", "value"), "series")
    bad = F.count_if(F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0) | (F.col("value") == float("inf")))
    need = SEASON + origins * HORIZON + 1
    wrong = series.groupBy("series").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"), bad.alias("bad")).where((F.col("n") != F.col("days")) | (F.col("bad") > 0) | (F.col("n") < need)).limit(1).collect()
    if wrong:
        raise ContractError(f"series {wrong[0]['series']!r} has {wrong[0]['n']} points on {wrong[0]['days']} days, {wrong[0]['bad']} of them invalid; {need} are needed")


def seasonal_holdout(series: DataFrame, holdout: int = 28) -> DataFrame:
    """The last ``holdout`` points beside the value one season before."""
    return _numbered(series).where(F.col("i") > F.col("n") - holdout).select("series", "date", F.col("value").alias("actual"), F.col("back").alias("forecast"))


def rolling_origin(series: DataFrame, origins: int = ORIGINS, alpha: float = INTERVAL_ALPHA) -> DataFrame:
    """Forecasts of the last ``origins`` x HORIZON points, each from what its origin could see.

    The interval's radius is an order statistic of the absolute seasonal residuals
    before the origin; the benchmark repeats the last value before it.  A series, which
    has a point a day, is one array; all origins are cut from it without a join.
    """
    at = lambda i: F.element_at("points", i.cast("int"))
    points = series.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("points"))
    seen = points.withColumn("origin_index", F.explode(F.sequence(F.lit(1), F.lit(origins)))).withColumn("upto", F.size("points") - (origins - F.col("origin_index") + 1) * HORIZON).where(F.col("upto") > SEASON)
    residuals = F.transform(F.slice("points", SEASON + 1, F.col("upto") - SEASON), lambda x, i: F.abs(x["value"] - at(i + 1)["value"]))
    ranked = seen.withColumn("r", F.array_sort(residuals)).withColumn("m", F.size("r").cast("long"))
    radius = F.element_at("r", F.least(F.col("m"), F.ceil((F.col("m") + 1) * F.lit(1.0 - alpha))).cast("int"))
    ahead = ranked.select("series", "origin_index", "points", "upto", radius.alias("interval_radius"), F.col("m").alias("calibration_points"), F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("horizon_day"))
    target, source, last = at(F.col("upto") + F.col("horizon_day")), at(F.col("upto") + F.col("horizon_day") - SEASON), at(F.col("upto"))
    out = ahead.select("series", "origin_index", last["date"].alias("origin_date"), target["date"].alias("target_date"), source["date"].alias("seasonal_source_date"), "horizon_day", target["value"].alias("actual"), source["value"].alias("forecast"), last["value"].alias("benchmark_forecast"), "interval_radius", "calibration_points")
    return out.select(
        *out.columns[:9], F.greatest(F.lit(0.0), F.col("forecast") - F.col("interval_radius")).alias("interval_low"), (F.col("forecast") + F.col("interval_radius")).alias("interval_high"), "interval_radius", "calibration_points",
    )


def mape(forecast: str) -> Column:
    """Mean absolute percentage error over non-zero actuals; null without any."""
    return F.avg(F.try_divide(F.abs(F.col("actual") - F.col(forecast)), F.abs("actual")))


def wape(forecast: str) -> Column:
    """Summed absolute error over summed actuals; null if those are zero."""
    return F.try_divide(F.sum(F.abs(F.col("actual") - F.col(forecast))), F.sum(F.abs("actual")))


def evaluate_mape(holdout: DataFrame, gate: MapeGate = MapeGate()) -> DataFrame:
    sums = holdout.groupBy("series").agg(F.count("*").alias("points"), mape("forecast").alias("mape"))
    reason = F.when(F.col("points") < gate.min_holdout_points, "insufficient holdout").when(F.col("mape").isNull(), "MAPE not estimable").when(F.col("mape") > gate.max_mape, "MAPE exceeds its limit").otherwise("planning gate passed")
    return sums.withColumn("reason", reason).withColumn("approved", F.col("reason") == "planning gate passed")


def evaluate_plan(backtest: DataFrame, gate: PlanningGate = PlanningGate(), alpha: float = INTERVAL_ALPHA) -> DataFrame:
    """Four gates for each series; all must pass."""
    sums = backtest.groupBy("series").agg(
        F.countDistinct("origin_index").alias("origins"), F.max("horizon_day").alias("horizon_days"), F.count("*").alias("backtest_points"),
        mape("forecast").alias("mape"), wape("forecast").alias("wape"), mape("benchmark_forecast").alias("benchmark_mape"), wape("benchmark_forecast").alias("benchmark_wape"),
        F.avg(F.col("actual").between(F.col("interval_low"), F.col("interval_high")).cast("double")).alias("interval_coverage"),
    )
    sure = lambda c: F.coalesce(c, F.lit(False))
    gates = {
        "enough_backtest_gate": F.col("backtest_points") >= gate.min_backtest_points,
        "absolute_accuracy_gate": sure((F.col("mape") <= gate.max_mape) & (F.col("wape") <= gate.max_wape)),
        "benchmark_gate": sure(F.col("wape") <= F.col("benchmark_wape") + 1e-15) if gate.require_noninferior_wape_to_benchmark else F.lit(True),
        "interval_coverage_gate": sure(F.col("interval_coverage") >= gate.min_interval_coverage),
    }
    failures = {"enough_backtest_gate": "too few backtest points", "absolute_accuracy_gate": "absolute accuracy fails", "benchmark_gate": "worse than the last value", "interval_coverage_gate": "interval coverage too low"}
    out = sums.withColumn("relative_wape_improvement", F.try_divide(F.col("benchmark_wape") - F.col("wape"), F.col("benchmark_wape"))).withColumn("interval_nominal_coverage", F.lit(1 - alpha)).withColumns(gates)
    out = out.withColumn("approved", F.expr(" AND ".join(gates)))
    return out.withColumn("reason", F.when(F.col("approved"), "forecast eligible for planning").otherwise(F.concat_ws("; ", *[F.when(~F.col(g), text) for g, text in failures.items()])))


def reconciliation(backtest: DataFrame) -> DataFrame:
    """Each origin's plan against what came."""
    sums = backtest.groupBy("series", "origin_index", "origin_date").agg(F.min("target_date").alias("target_start_date"), F.max("target_date").alias("target_end_date"), F.sum("forecast").alias("planned_total"), F.sum("actual").alias("actual_total"), F.sum("benchmark_forecast").alias("benchmark_total"))
    error = F.col("planned_total") - F.col("actual_total")
    return sums.withColumn("signed_error", error).withColumn("absolute_pct_error", F.try_divide(F.abs(error), F.abs("actual_total")))


def replay(published: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Published backtests with the affected series replaced."""
    return published.join(recomputed.select("series").distinct(), "series", "left_anti").unionByName(recomputed)


def decision_contract(gate: PlanningGate = PlanningGate()) -> dict:
    return {"version": "2.0", "season_days": SEASON, "horizon_days": HORIZON, "rolling_origins": ORIGINS, "interval_nominal_coverage": 1 - INTERVAL_ALPHA, "planning_gate": gate.__dict__, "weighted_score_used": False, "future_data_leakage_allowed": False}
