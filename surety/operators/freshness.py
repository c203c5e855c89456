"""Event time against processing time: lateness, snapshots, revisions and watermark choice.

All candidates and snapshots of a watermark study are one plan.  Settled and snapshot
Gold come from one grouping that keeps each user's first arrival, and candidates only
filter the resulting cells by date.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surety.schemas import ContractError, require_columns

CANDIDATE_HOURS = (24.0, 48.0, 72.0, 96.0)
#: Delays of one class differ in so many low bits of their microseconds.
DELAY_BITS = 24
REVISED_METRICS = ("dau", "paid_subscription", "revenue_gbp")


@dataclass(frozen=True)
class LatenessPolicy:
    allowed_lateness_hours: float = 48.0


@dataclass(frozen=True)
class RiskBudget:
    """Fixed values of the watermark budget."""

    max_late_event_fraction: float = 0.005
    max_revised_metric_cell_fraction: float = 0.01
    max_abs_revenue_revision_gbp: float = 10.0
    max_abs_paid_subscription_revision: float = 1.0


def _instant(value: datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def processing_frame(events: DataFrame, check: bool = False) -> DataFrame:
    """Events with ``ingested_at`` (their own time where absent); ``check`` refuses arrivals before the event."""
    require_columns(events, ("event_ts",), "events")
    filled = F.coalesce("ingested_at", "event_ts") if "ingested_at" in events.columns else F.col("event_ts")
    events = events.withColumn("ingested_at", filled)
    if check and events.where("ingested_at < event_ts").limit(1).count():
        raise ContractError("some events arrive before they happen")
    return events


def delay_micros() -> Column:
    return F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("event_ts").cast("timestamp"))


def delay_hours() -> Column:
    """Exact to the microsecond, as a double."""
    return delay_micros() / F.lit(3.6e9)


def with_lateness(events: DataFrame, policy: LatenessPolicy = LatenessPolicy()) -> DataFrame:
    events = processing_frame(events).withColumn("ingestion_delay_hours", delay_hours())
    return events.withColumn("late_beyond_watermark", F.col("ingestion_delay_hours") > policy.allowed_lateness_hours)


def late_arrival_summary(events: DataFrame, policy: LatenessPolicy = LatenessPolicy()) -> DataFrame:
    """Exact delay quantiles by product and type, without a group's values in one place.

    Delays are counted by their leading bits; only the few classes that hold a wanted rank
    are counted by value, and running sums within them find it.
    """
    keys, wide = ["product", "event_type"], 1 << DELAY_BITS
    frame = with_lateness(events, policy).select(*keys, "late_beyond_watermark", delay_micros().alias("micros")).withColumn("class", F.floor(F.col("micros") / wide))
    counted = frame.groupBy(*keys, "class").agg(F.count("*").alias("n"), F.count_if("late_beyond_watermark").alias("late"), F.max("micros").alias("most"))
    by = Window.partitionBy(*keys)
    ranked = counted.withColumn("upto", F.sum("n").over(by.orderBy("class"))).withColumn("events", F.sum("n").over(by))
    places = {name: edge((F.col("events") - 1) * F.lit(p)) for name, p, edge in (("a0", 0.5, F.floor), ("a1", 0.5, F.ceil), ("b0", 0.95, F.floor), ("b1", 0.95, F.ceil))}
    ranked = ranked.withColumns(places)
    here = lambda name: (F.col(name) >= F.col("upto") - F.col("n")) & (F.col(name) < F.col("upto"))
    wanted = ranked.where(here("a0") | here("a1") | here("b0") | here("b1")).select(*keys, "class", (F.col("upto") - F.col("n")).alias("before"), *places)
    values = frame.join(wanted, [*keys, "class"]).groupBy(*keys, "class", "micros", "before", *places).agg(F.count("*").alias("n"))
    values = values.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "class").orderBy("micros")))
    found = values.groupBy(*keys).agg(*[(F.max(F.when(here(name), F.col("micros"))) / 3.6e9).alias(name) for name in places])
    sums = counted.groupBy(*keys).agg(F.sum("n").alias("events"), F.sum("late").alias("late_beyond_watermark"), (F.max("most") / 3.6e9).alias("delay_max_hours"))
    between = lambda a, b, p: F.col(a) + (F.col(b) - F.col(a)) * ((F.col("events") - 1) * F.lit(p) - F.floor((F.col("events") - 1) * F.lit(p)))
    return sums.join(found, keys).select(
        *keys, "events", "late_beyond_watermark", between("a0", "a1", 0.5).alias("delay_p50_hours"), between("b0", "b1", 0.95).alias("delay_p95_hours"), "delay_max_hours",
        (F.col("late_beyond_watermark").cast("double") / F.col("events")).alias("late_fraction"),
    )


def available_as_of(events: DataFrame, as_of: datetime | str) -> DataFrame:
    return processing_frame(events).where(F.col("ingested_at") <= _instant(as_of))


def watermark_date(as_of: datetime, policy: LatenessPolicy = LatenessPolicy()):
    """The last final event date: the date of ``as_of`` less the allowed lateness."""
    return (as_of - timedelta(seconds=round(policy.allowed_lateness_hours * 3600))).date()


def late_after_snapshot(events: DataFrame, as_of: datetime, policy: LatenessPolicy = LatenessPolicy()) -> DataFrame:
    """Events on final dates that a snapshot at ``as_of`` misses."""
    final = F.lit(watermark_date(as_of, policy))
    late = with_lateness(events, policy).where((F.to_date("event_ts") <= final) & (F.col("ingested_at") > _instant(as_of)))
    return late.select("event_id", "user_id", "product", "event_type", "event_ts", F.to_date("event_ts").alias("event_date"), "ingested_at", "ingestion_delay_hours", _instant(as_of).alias("processing_as_of"), final.alias("watermark_event_date"), "revenue_gbp")


def _moments(as_of: Iterable[datetime]) -> list[datetime]:
    moments = sorted(set(as_of))
    if not moments:
        raise ContractError("at least one snapshot is needed")
    return moments


def _missed_by(moments: list[datetime]) -> Column:
    """How many snapshots, the earliest first, were taken before a row arrived."""
    return F.size(F.filter(F.array(*[_instant(m) for m in moments]), lambda m: m < F.col("ingested_at")))


def revision_cells(events: DataFrame, as_of: Iterable[datetime]) -> DataFrame:
    """Snapshot and settled value of every metric cell, for each snapshot, from one scan.

    A user counts in a snapshot if their first arrival of a kind does, so a first grouping
    keeps that for each user and day, and revenue by arrival class; no event is repeated
    for a snapshot.
    """
    moments = _moments(as_of)
    frame = processing_frame(events).withColumn("_missed", _missed_by(moments))
    first = lambda kind: F.min(F.when((F.col("event_type") == kind) & F.col("user_id").isNotNull(), F.col("_missed")))
    spent = lambda j: F.sum(F.when((F.col("event_type") == "purchase") & (F.col("_missed") == j), F.col("revenue_gbp")).otherwise(0.0))
    classes = range(len(moments) + 1)
    users = frame.groupBy("product", F.to_date("event_ts").alias("date"), "user_id").agg(first("app_open").alias("dau"), first("paid_subscription").alias("paid_subscription"), *[spent(j).alias(f"r{j}") for j in classes])
    seen = lambda name, w: F.count_if(F.col(name) < w).cast("double")
    count = len(moments) + 1
    whole = users.groupBy("product", "date").agg(
        *[seen(m, w).alias(f"{m}_{w}") for m in REVISED_METRICS[:2] for w in range(1, count + 1)], *[F.sum(f"r{j}").alias(f"r{j}") for j in classes],
    )
    upto = lambda w: sum((F.col(f"r{j}") for j in range(1, w)), F.col("r0"))
    value = lambda m, w: upto(w) if m == "revenue_gbp" else F.col(f"{m}_{w}")
    cell = lambda w, m, at: F.struct(F.lit(w).alias("window_index"), _instant(at).alias("processing_as_of"), F.lit(m).alias("metric"), value(m, w).alias("snapshot_value"), value(m, count).alias("settled_value"))
    cells = F.array(*[cell(w, m, at) for w, at in enumerate(moments, 1) for m in REVISED_METRICS])
    both = whole.select("product", "date", F.inline(cells))
    return both.withColumn("revision", F.col("settled_value") - F.col("snapshot_value")).withColumn("changed_after_watermark", F.abs("revision") > 1e-12)


def metric_revision_report(events: DataFrame, as_of: datetime, policy: LatenessPolicy = LatenessPolicy()) -> DataFrame:
    """Cells that were final at ``as_of``, with what later arrivals changed."""
    final = F.lit(watermark_date(as_of, policy))
    cells = revision_cells(events, [as_of]).where(F.col("date") <= final)
    return cells.select("product", "date", "metric", "snapshot_value", "settled_value", "revision", F.try_divide("revision", F.abs("snapshot_value")).alias("revision_pct"), "changed_after_watermark", "processing_as_of", final.alias("watermark_event_date"))


def revision_summary(revisions: DataFrame) -> DataFrame:
    sums = revisions.groupBy("product", "metric").agg(F.count("*").alias("finalized_dates"), F.count_if("changed_after_watermark").alias("revised_dates"), F.sum("revision").alias("total_revision"), F.max(F.abs("revision")).alias("max_abs_revision"))
    return sums.withColumn("revised_date_fraction", F.col("revised_dates").cast("double") / F.col("finalized_dates"))


def watermark_backtest(events: DataFrame, as_of: Iterable[datetime], hours: Iterable[float] = CANDIDATE_HOURS, budget: RiskBudget = RiskBudget()) -> DataFrame:
    """One risk row for each snapshot and candidate lateness, with its gates.

    The late fraction counts only events on dates that the candidate had declared final.
    """
    spark = events.sparkSession
    hours = sorted(set(map(float, hours)))
    if not hours or hours[0] <= 0:
        raise ContractError("candidate hours must be positive")
    moments = spark.createDataFrame(list(enumerate(_moments(as_of), 1)), "window_index int, processing_as_of timestamp_ntz")
    candidates = spark.createDataFrame([(h, round(h * 3600)) for h in hours], "allowed_lateness_hours double, lateness_s long")
    grid = moments.crossJoin(candidates).withColumn("watermark_event_date", F.to_date(F.col("processing_as_of") - F.expr("make_dt_interval(0, 0, 0, lateness_s)")))
    grid = F.broadcast(grid.drop("lateness_s"))  # snapshots x candidates rows
    keys = ["window_index", "allowed_lateness_hours"]
    # Events fold to counts by date, delay class and arrival first; candidates meet those, not the events.
    frame = processing_frame(events).select(F.to_date("event_ts").alias("event_date"), delay_hours().alias("delay"), "ingested_at")
    steps = F.size(F.filter(F.array(*map(F.lit, hours)), lambda h: h < F.col("delay")))
    arrivals = _missed_by(_moments(as_of))
    folded = frame.groupBy("event_date", steps.alias("late_for"), arrivals.alias("missed_by")).agg(F.count("*").alias("n"))
    number = F.array_position(F.array(*map(F.lit, hours)), F.col("allowed_lateness_hours"))
    is_late, is_final = F.col("late_for") >= number, F.col("event_date") <= F.col("watermark_event_date")
    counted = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    counts = folded.crossJoin(grid).groupBy(*keys, "processing_as_of", "watermark_event_date").agg(
        F.sum("n").alias("settled_stream_events"),
        counted(is_final).alias("finalizable_events"),
        counted(is_final & is_late).alias("late_beyond_watermark_events"),
        counted(is_late).alias("whole_stream_late_beyond_watermark_events"),
        counted(is_final & (F.col("missed_by") >= F.col("window_index"))).alias("late_missing_from_finalized_snapshot"),
    )
    cells = revision_cells(events, as_of).drop("processing_as_of").join(grid, "window_index").where("date <= watermark_event_date")
    worst = lambda metric: F.coalesce(F.max(F.when(F.col("metric") == metric, F.abs("revision"))), F.lit(0.0))
    risks = cells.groupBy(*keys).agg(
        F.countDistinct("date").alias("finalized_calendar_dates"), F.count("*").alias("finalized_metric_cells"), F.count_if("changed_after_watermark").alias("revised_metric_cells"),
        worst("dau").alias("max_abs_dau_revision"), worst("revenue_gbp").alias("max_abs_revenue_revision_gbp"), worst("paid_subscription").alias("max_abs_paid_subscription_revision"),
    )
    out = counts.join(risks, keys, "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = out.withColumns(
        {
            "finalization_lag_days": F.col("allowed_lateness_hours") / 24.0,
            "late_event_fraction": ratio("late_beyond_watermark_events", "finalizable_events"),
            "whole_stream_late_event_fraction": ratio("whole_stream_late_beyond_watermark_events", "settled_stream_events"),
            "revised_metric_cell_fraction": ratio("revised_metric_cells", "finalized_metric_cells"),
        }
    )
    gates = {
        "passes_late_event_fraction": F.col("late_event_fraction") <= budget.max_late_event_fraction,
        "passes_revised_metric_cell_fraction": F.col("revised_metric_cell_fraction") <= budget.max_revised_metric_cell_fraction,
        "passes_revenue_revision": F.col("max_abs_revenue_revision_gbp") <= budget.max_abs_revenue_revision_gbp,
        "passes_paid_subscription_revision": F.col("max_abs_paid_subscription_revision") <= budget.max_abs_paid_subscription_revision,
    }
    out = out.withColumns(gates).withColumn("feasible", F.expr(" AND ".join(gates)))
    best = out.groupBy("window_index").agg(F.min(F.when(F.col("feasible"), F.col("allowed_lateness_hours"))).alias("_best"))
    return out.join(best, "window_index").withColumn("selected_in_window", F.coalesce(F.col("allowed_lateness_hours") == F.col("_best"), F.lit(False))).drop("_best")


def stability_summary(backtest: DataFrame) -> DataFrame:
    sums = backtest.groupBy("allowed_lateness_hours").agg(
        F.countDistinct("window_index").alias("windows"), F.count_if("feasible").alias("feasible_windows"), F.count_if("selected_in_window").alias("selected_windows"),
        F.avg("late_event_fraction").alias("mean_late_event_fraction"), F.max("late_event_fraction").alias("max_late_event_fraction"),
        F.avg("revised_metric_cell_fraction").alias("mean_revised_metric_cell_fraction"), F.max("revised_metric_cell_fraction").alias("max_revised_metric_cell_fraction"),
        F.max("max_abs_revenue_revision_gbp").alias("max_abs_revenue_revision_gbp"), F.max("max_abs_paid_subscription_revision").alias("max_abs_paid_subscription_revision"),
    )
    return sums.withColumn("feasibility_rate", F.col("feasible_windows").cast("double") / F.col("windows")).withColumn("stable_all_windows", F.col("feasible_windows") == F.col("windows"))


def select_policy(grid: DataFrame, budget: RiskBudget = RiskBudget()) -> dict:
    """The shortest candidate that passes every gate of one snapshot's grid, or none."""
    row = grid.where("feasible").orderBy("allowed_lateness_hours").limit(1).collect()
    return {"status": "selected" if row else "no_candidate_meets_budget", "selected_lateness_hours": row[0]["allowed_lateness_hours"] if row else None, "selected_watermark_event_date": str(row[0]["watermark_event_date"]) if row else None, "weighted_score_used": False, "budget": asdict(budget)}


def select_stable_policy(summary: DataFrame, budget: RiskBudget = RiskBudget()) -> dict:
    """The shortest candidate feasible in every window, or none; the budget is never relaxed."""
    row = summary.where("stable_all_windows").orderBy("allowed_lateness_hours").limit(1).collect()
    return {"status": "selected" if row else "no_candidate_stable_in_all_windows", "selected_lateness_hours": row[0]["allowed_lateness_hours"] if row else None, "selected_feasibility_rate": row[0]["feasibility_rate"] if row else None, "weighted_score_used": False, "budget": asdict(budget)}


def lateness_contract(as_of: datetime, policy: LatenessPolicy = LatenessPolicy()) -> dict:
    return {**asdict(policy), "processing_as_of": str(as_of), "watermark_event_date": str(watermark_date(as_of, policy)), "finalization_rule": "event date <= watermark_event_date", "late_after_finalization_action": "keyed backfill, reconciled"}
