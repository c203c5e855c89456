"""Statistical certification of watermark candidates, and how much evidence it would take."""

from __future__ import annotations

import math
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from surety.functions import stats
from surety.operators.freshness import RiskBudget
from surety.schemas import ContractError, require_columns

#: The family's error rate and the bounds taken from each grid row.
FAMILY_ALPHA, BOUNDS_PER_ROW = 0.05, 2


@F.pandas_udf(DoubleType())
def _upper(successes: pd.Series, trials: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([stats.binomial_upper(int(k), int(n), float(a)) if n and n > 0 else None for k, n, a in zip(successes, trials, alpha)], dtype="float64")


def uncertainty_grid(grid: DataFrame, budget: RiskBudget = RiskBudget(), family_alpha: float = FAMILY_ALPHA) -> tuple[DataFrame, dict]:
    """Simultaneous upper bounds for both proportions of every row; maxima stay hard gates."""
    require_columns(grid, ("finalizable_events", "late_beyond_watermark_events", "finalized_metric_cells", "revised_metric_cells", "max_abs_revenue_revision_gbp", "max_abs_paid_subscription_revision"), "grid")
    if not 0 < family_alpha < 1:
        raise ContractError("family_alpha must lie between 0 and 1")
    rows = grid.count()
    if not rows:
        raise ContractError("the grid is empty")
    alpha = family_alpha / (rows * BOUNDS_PER_ROW)
    out = grid.withColumns(
        {
            "late_event_fraction_upper": _upper("late_beyond_watermark_events", "finalizable_events", F.lit(alpha)),
            "revised_metric_cell_fraction_upper": _upper("revised_metric_cells", "finalized_metric_cells", F.lit(alpha)),
        }
    )
    gates = {
        "passes_late_event_upper": F.col("late_event_fraction_upper") <= budget.max_late_event_fraction,
        "passes_revised_metric_cell_upper": F.col("revised_metric_cell_fraction_upper") <= budget.max_revised_metric_cell_fraction,
        "passes_revenue_revision_hard_gate": F.col("max_abs_revenue_revision_gbp") <= budget.max_abs_revenue_revision_gbp,
        "passes_paid_subscription_revision_hard_gate": F.col("max_abs_paid_subscription_revision") <= budget.max_abs_paid_subscription_revision,
    }
    out = out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in gates.items()}).withColumn("certified_under_binomial_model", F.expr(" AND ".join(gates)))
    return out, {"family_alpha": family_alpha, "family_confidence_level": 1 - family_alpha, "correction": "bonferroni", "simultaneous_one_sided_bounds": rows * BOUNDS_PER_ROW, "per_bound_alpha": alpha, "weighted_score_used": False, "budget": asdict(budget)}


def uncertainty_summary(grid: DataFrame) -> DataFrame:
    peaks = ("late_event_fraction", "late_event_fraction_upper", "revised_metric_cell_fraction", "revised_metric_cell_fraction_upper")
    sums = grid.groupBy("allowed_lateness_hours").agg(
        F.countDistinct("window_index").alias("windows"), F.count_if("feasible").alias("observed_feasible_windows"), F.count_if("certified_under_binomial_model").alias("certified_windows"),
        *[F.max(c).alias(f"max_{c}") for c in peaks], F.max("max_abs_revenue_revision_gbp").alias("max_abs_revenue_revision_gbp"), F.max("max_abs_paid_subscription_revision").alias("max_abs_paid_subscription_revision"),
    )
    share = lambda c: F.col(c).cast("double") / F.col("windows")
    return sums.withColumns({"observed_feasibility_rate": share("observed_feasible_windows"), "certification_rate": share("certified_windows"), "certified_all_windows": F.col("certified_windows") == F.col("windows")})


def select_certified(summary: DataFrame, contract: dict) -> dict:
    row = summary.where("certified_all_windows").orderBy("allowed_lateness_hours").limit(1).collect()
    return {"status": "selected" if row else "no_candidate_certified_familywise_95", "selected_lateness_hours": row[0]["allowed_lateness_hours"] if row else None, "per_bound_alpha": contract["per_bound_alpha"], "weighted_score_used": False}


def planning_rates(grid: DataFrame) -> DataFrame:
    """Worst rates and median daily evidence of each candidate: what a plan starts from."""
    per_day = lambda c: F.expr(f"percentile(try_divide(cast({c} AS double), nullif(finalized_calendar_dates, 0)), 0.5D)")
    return grid.groupBy("allowed_lateness_hours").agg(
        F.max("late_event_fraction").alias("planning_late_event_rate"), F.max("revised_metric_cell_fraction").alias("planning_revised_metric_cell_rate"),
        F.max("max_abs_revenue_revision_gbp").alias("max_abs_revenue_revision_gbp"), F.max("max_abs_paid_subscription_revision").alias("max_abs_paid_subscription_revision"),
        per_day("finalizable_events").alias("median_finalizable_events_per_day"), per_day("finalized_metric_cells").alias("median_metric_cells_per_day"),
    )


def evidence_plan(grid: DataFrame, budget: RiskBudget = RiskBudget(), family_alpha: float = FAMILY_ALPHA, most: int = stats.MOST_TRIALS) -> list[dict]:
    """One plan a candidate: sample sizes that certify both rates if they stay as observed.

    The search runs on the driver over one row a candidate; events are never collected.
    """
    shape = grid.agg(F.countDistinct("allowed_lateness_hours").alias("c"), F.countDistinct("window_index").alias("w")).first()
    if not shape["c"]:
        raise ContractError("the grid is empty")
    alpha = family_alpha / (shape["c"] * shape["w"] * BOUNDS_PER_ROW)
    plans = []
    for r in planning_rates(grid).orderBy("allowed_lateness_hours").collect():
        plan = {**r.asDict(), "per_bound_alpha": alpha}
        reasons, days = [], []
        for kind, rate, limit, speed, n_name, cycle_name, day_name in (
            ("late", "planning_late_event_rate", budget.max_late_event_fraction, "median_finalizable_events_per_day", "required_late_event_trials", "late_event_audited_cycle_trials", "estimated_calendar_days_for_late_bound"),
            ("revision", "planning_revised_metric_cell_rate", budget.max_revised_metric_cell_fraction, "median_metric_cells_per_day", "required_revised_metric_cells", "revised_cell_audited_cycle_trials", "estimated_calendar_days_for_revision_bound"),
        ):
            below = r[rate] < limit
            target = stats.stable_trials(r[rate], limit, alpha, most) if below else None
            plan[f"{kind}_rate_below_budget"] = below
            plan[n_name], plan[cycle_name] = target or (None, None)
            plan[f"{kind}_trial_requirement_exceeds_search_cap"] = below and target is None
            plan[day_name] = math.ceil(target[0] / r[speed]) if target and r[speed] else None
            days.append(plan[day_name])
            if not below:
                reasons.append(f"{kind} rate is at or above its budget")
            elif target is None:
                reasons.append(f"{kind} target lies beyond {most:,} trials")
        for name, value, most_allowed in (("revenue", "max_abs_revenue_revision_gbp", budget.max_abs_revenue_revision_gbp), ("paid", "max_abs_paid_subscription_revision", budget.max_abs_paid_subscription_revision)):
            plan[f"{name}_hard_gate_passes"] = r[value] <= most_allowed
            if r[value] > most_allowed:
                reasons.append(f"{name} revision breaks its hard gate")
        plan["evidence_requirement_quantified"] = plan["required_late_event_trials"] is not None and plan["required_revised_metric_cells"] is not None
        plan["evidence_only_addressable"] = not reasons and plan["evidence_requirement_quantified"]
        both = max(days) if None not in days else None
        plan["estimated_calendar_days_for_both_proportions"] = both
        plan["estimated_calendar_years_for_both_proportions"] = both / 365.25 if both is not None else None
        plan["planning_interpretation"] = "; ".join(reasons) or "only more evidence is missing"
        plans.append(plan)
    return plans


def select_evidence(plans: list[dict]) -> dict:
    """The shortest candidate that lacks nothing but evidence."""
    fit = sorted((p for p in plans if p["evidence_only_addressable"]), key=lambda p: p["allowed_lateness_hours"])
    return {"status": "selected" if fit else "no_candidate_evidence_only_addressable", "selected_lateness_hours": fit[0]["allowed_lateness_hours"] if fit else None, "estimated_calendar_days_for_both_proportions": fit[0]["estimated_calendar_days_for_both_proportions"] if fit else None}
