"""Independent checks of built evidence: each returns the names of what fails, none if all holds.

They recompute from the frames they are given and import no operator that made them,
apart from the statistics that bounds are checked with.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surety.functions import stats
from surety.functions.canonical import canonical_sha256
from surety.schemas import EVENT_TYPES, PRODUCTS

CLOSE = 1e-9


def _failing(df: DataFrame, **wrong: Column) -> list[str]:
    """Names of conditions that hold for any row: one aggregate."""
    row = df.agg(*[F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False)).alias(n) for n, c in wrong.items()]).first()
    return [n for n in wrong if row[n]]


def _named(**wrong: bool) -> list[str]:
    return [n for n, is_wrong in wrong.items() if is_wrong]


def build(tables: Mapping[str, DataFrame]) -> list[str]:
    """Row accounting, denominators and definitions of the controlled lane."""
    q = tables["quality_report"].first()
    silver, gold, ledger, rejected = (tables[n] for n in ("silver_events", "gold_daily_metrics", "retention_maturity_ledger", "rejected_events"))
    out = _named(row_accounting=q["rows_raw"] != q["rows_certified"] + q["rows_rejected"], certified_rows=silver.count() != q["rows_certified"], rejected_rows=rejected.count() != q["rows_rejected"])
    out += _failing(rejected, reject_reason_missing=F.coalesce("reject_reason", F.lit("")) == "")
    out += _failing(silver, processing_before_event=F.col("ingested_at") < F.col("event_ts"), unknown_product=~F.col("product").isin(*PRODUCTS), unknown_event=~F.col("event_type").isin(*EVENT_TYPES), negative_revenue=F.col("revenue_gbp") < 0)
    out += _failing(gold, legacy_below_dau=F.col("dau_legacy_any_event") < F.col("dau"), delta=F.col("dau_definition_delta") != F.col("dau_legacy_any_event") - F.col("dau"), conversion=(F.col("first_open") > 0) & (F.abs(F.col("conversion_first_open") * F.col("first_open") - F.col("paid_subscription")) > CLOSE))
    mature = F.col("mature")
    out += _failing(
        ledger, mature_denominator=mature & ((F.col("eligible_users") != F.col("cohort_users")) | (F.col("excluded_users") != 0)), immature_denominator=~mature & ((F.col("eligible_users") != 0) | (F.col("excluded_users") != F.col("cohort_users"))),
        immature_returns=~mature & (F.col("retained_users").isNotNull() | F.col("retention_rate").isNotNull()), retained=mature & (F.col("retained_users") > F.col("cohort_users")), boundary=mature != (F.col("target_date") <= F.col("analysis_as_of")),
    )
    cells = gold.groupBy("product", "date").count()
    return out + _failing(cells, gold_key=F.col("count") > 1)


def watermark(grid: DataFrame, decision: Mapping | None = None) -> list[str]:
    """Monotone counts, fractions, gates and the shortest feasible choice of each window."""
    by = Window.partitionBy("window_index").orderBy("allowed_lateness_hours")
    rows = grid.withColumn("_before", F.lag("finalizable_events").over(by)).withColumn("_late", F.lag("whole_stream_late_beyond_watermark_events").over(by)).withColumn("_chosen", F.min(F.when(F.col("feasible"), F.col("allowed_lateness_hours"))).over(Window.partitionBy("window_index")))
    gates = [F.col(c) for c in ("passes_late_event_fraction", "passes_revised_metric_cell_fraction", "passes_revenue_revision", "passes_paid_subscription_revision")]
    out = _failing(
        rows, finalizable_not_monotone=F.col("finalizable_events") > F.col("_before"), late_not_monotone=F.col("whole_stream_late_beyond_watermark_events") > F.col("_late"), finalizable_exceeds_stream=F.col("finalizable_events") > F.col("settled_stream_events"),
        late_fraction=(F.col("finalizable_events") > 0) & (F.abs(F.col("late_event_fraction") * F.col("finalizable_events") - F.col("late_beyond_watermark_events")) > 1e-6), cells=F.col("revised_metric_cells") > F.col("finalized_metric_cells"),
        gates=F.col("feasible") != (gates[0] & gates[1] & gates[2] & gates[3]), selection=F.col("selected_in_window") != F.coalesce(F.col("allowed_lateness_hours") == F.col("_chosen"), F.lit(False)),
    )
    if decision is not None:
        every = grid.groupBy("allowed_lateness_hours").agg(F.min("feasible").alias("ok")).where("ok").agg(F.min("allowed_lateness_hours")).first()[0]
        out += _named(stable_choice=decision["selected_lateness_hours"] != every, weighted_score=decision["weighted_score_used"] is not False)
    return out


def uncertainty(grid: DataFrame, contract: Mapping) -> list[str]:
    """Bounds above their points, Bonferroni accounting, gates without compensation, and the tail at each bound."""
    gates = [F.col(c) for c in ("passes_late_event_upper", "passes_revised_metric_cell_upper", "passes_revenue_revision_hard_gate", "passes_paid_subscription_revision_hard_gate")]
    out = _failing(
        grid, late_upper=F.col("late_event_fraction_upper") < F.col("late_event_fraction") - 1e-15, cell_upper=F.col("revised_metric_cell_fraction_upper") < F.col("revised_metric_cell_fraction") - 1e-15,
        range=~F.col("late_event_fraction_upper").between(0, 1) | ~F.col("revised_metric_cell_fraction_upper").between(0, 1), components=F.col("certified_under_binomial_model") != (gates[0] & gates[1] & gates[2] & gates[3]), certified_infeasible=F.col("certified_under_binomial_model") & ~F.col("feasible"),
    )
    rows = grid.collect()  # a row a candidate and window
    out += _named(bounds=contract["simultaneous_one_sided_bounds"] != 2 * len(rows), alpha=abs(contract["per_bound_alpha"] * 2 * len(rows) - contract["family_alpha"]) > 1e-15, rectangular=len({(r["window_index"], r["allowed_lateness_hours"]) for r in rows}) != len({r["window_index"] for r in rows}) * len({r["allowed_lateness_hours"] for r in rows}))
    tails = [stats.binomial_tail(r[k], r[n], r[u]) for r in rows for k, n, u in (("late_beyond_watermark_events", "finalizable_events", "late_event_fraction_upper"), ("revised_metric_cells", "finalized_metric_cells", "revised_metric_cell_fraction_upper")) if 0 <= r[k] < r[n]]
    return out + _named(tail=any(abs(t - contract["per_bound_alpha"]) > 1e-6 for t in tails))


def evidence(plans: Iterable[Mapping], limits: Mapping[str, float], alpha: float) -> list[str]:
    """Sample sizes that pass while the cycle before them does not wholly, and addressable only without any other fault."""
    out = []
    for p in plans:
        for kind, rate, n, limit in (("late", "planning_late_event_rate", "required_late_event_trials", limits["late"]), ("revision", "planning_revised_metric_cell_rate", "required_revised_metric_cells", limits["revision"])):
            if p[f"{kind}_rate_below_budget"] != (p[rate] < limit):
                out.append(f"{kind}_budget")
            if p[n] is not None and not stats.upper_within(stats.planned_count(p[rate], p[n]), p[n], limit, alpha):
                out.append(f"{kind}_target")
            if p[n] is not None and p[n] > 1 and stats.upper_within(stats.planned_count(p[rate], p[n] - 1), p[n] - 1, limit, alpha):
                out.append(f"{kind}_not_least")
        whole = p["late_rate_below_budget"] and p["revision_rate_below_budget"] and p["revenue_hard_gate_passes"] and p["paid_hard_gate_passes"] and p["evidence_requirement_quantified"]
        if p["evidence_only_addressable"] != whole:
            out.append("addressable")
    return sorted(set(out))


def forecasts(series: DataFrame, backtest: DataFrame, evaluation: DataFrame, season: int = 7, horizon: int = 7) -> list[str]:
    """Every point from what its origin could see, intervals around forecasts, and the evaluation recomputed."""
    points = series.select("series", F.col("date").alias("_date"), F.col("value").alias("_value"))
    seen = backtest.join(points.withColumnRenamed("_date", "target_date"), ["series", "target_date"], "left").withColumnRenamed("_value", "_actual").join(points.withColumnRenamed("_date", "seasonal_source_date"), ["series", "seasonal_source_date"], "left").withColumnRenamed("_value", "_source").join(points.withColumnRenamed("_date", "origin_date"), ["series", "origin_date"], "left")
    out = _failing(
        seen, actual=~F.col("actual").eqNullSafe(F.col("_actual")), source=~F.col("forecast").eqNullSafe(F.col("_source")), benchmark=~F.col("benchmark_forecast").eqNullSafe(F.col("_value")), leakage=F.col("seasonal_source_date") > F.col("origin_date"),
        before_target=F.col("origin_date") >= F.col("target_date"), horizon=~F.col("horizon_day").between(1, horizon), interval=~F.col("forecast").between(F.col("interval_low") - CLOSE, F.col("interval_high") + CLOSE) | (F.col("interval_low") < 0),
    )
    error = F.abs(F.col("actual") - F.col("forecast"))
    again = backtest.groupBy("series").agg(F.count("*").alias("_n"), F.try_divide(F.sum(error), F.sum(F.abs("actual"))).alias("_wape"))
    gates = [F.col(c) for c in ("enough_backtest_gate", "absolute_accuracy_gate", "benchmark_gate", "interval_coverage_gate")]
    return out + _failing(evaluation.join(again, "series"), points=F.col("_n") != F.col("backtest_points"), wape=F.abs(F.col("_wape") - F.col("wape")) > CLOSE, approved=F.col("approved") != (gates[0] & gates[1] & gates[2] & gates[3]))


def migration(gold: DataFrame, replay: DataFrame, decisions: Mapping[str, Mapping]) -> list[str]:
    """The replay row by row, and decisions as the conjunction of their gates."""
    both = replay.join(gold.select("product", "date", "dau", "dau_legacy_any_event"), ["product", "date"], "full_outer")
    out = _failing(both, replay=~F.col("current_dau").eqNullSafe(F.col("dau")) | ~F.col("candidate_dau").eqNullSafe(F.col("dau_legacy_any_event")), delta=F.col("dau_delta_users") != F.col("dau_legacy_any_event") - F.col("dau"))
    gates = lambda d: all(v for k, v in d.items() if k.endswith("_gate"))
    return out + _named(approval=any(d["approved"] != gates(d) or (d["action"] == "APPROVE") != d["approved"] for d in decisions.values()), breaking_approved=any(d["classification"] == "BREAKING" and d["approved"] for d in decisions.values()))


def pricing(users: DataFrame, estimates: DataFrame, integrity: Mapping, decision: Mapping, margin: float = -0.03) -> list[str]:
    """Arm sizes and the paid difference recomputed; the action follows from the gates alone."""
    r = users.agg(F.count("*").alias("n"), F.sum(F.col("treatment").cast("long")).alias("k"), F.avg(F.when(F.col("treatment") == 1, F.col("paid_subscription_30d"))).alias("p1"), F.avg(F.when(F.col("treatment") == 0, F.col("paid_subscription_30d"))).alias("p0")).first()
    by = {x["metric"]: x for x in estimates.collect()}
    paid, revenue = by["paid_subscription_30d"], by["revenue_gbp_30d"]
    gates = (integrity["passes"], revenue["ci_low"] > 0, paid["ci_low"] > margin)
    action = "invalid" if not gates[0] else "rollout" if gates[1] and gates[2] else "hold"
    return _named(users=integrity["n_total"] != r["n"] or integrity["n_treatment"] != r["k"], srm=abs(stats.binomial_two_sided(r["k"], r["n"], 0.5) - integrity["p_value"]) > CLOSE, paid_effect=abs(paid["effect"] - (r["p1"] - r["p0"])) > CLOSE, interval=not paid["ci_low"] <= paid["effect"] <= paid["ci_high"], action=decision["action"] != action)


def impact(plan: Mapping, scenario: DataFrame, summary: Mapping, margin: float = -0.03) -> list[str]:
    """The planned arm clears the margin and one user fewer does not; totals; nothing is authorised on hold."""
    n, z = plan["equal_allocation_target_per_arm"], stats.normal_quantile(0.975)
    p0, p1 = plan["observed_control_rate"], plan["observed_treatment_rate"]
    low = lambda k: p1 - p0 - z * ((p0 * (1 - p0) + p1 * (1 - p1)) / (k - 1)) ** 0.5
    total = scenario.agg(F.sum("hypothetical_treated_users")).first()[0]
    out = _named(target=n is not None and low(n) <= margin, least=n is not None and n > 2 and low(n - 1) > margin, users=summary["counterfactual_treated_users"] != total, authorised=not summary["decision_authorised_rollout"] and summary["authorised_treated_users"] != 0)
    return out + _failing(scenario, treated=F.abs(F.col("hypothetical_treated_users") - F.col("eligible_users") * F.col("hypothetical_adoption_share")) > 0.5)


def invalidation(nodes: Iterable[Mapping], found: Mapping[str, Mapping], roots: Mapping[str, str]) -> list[str]:
    """Reachability recomputed over the serialised graph."""
    nodes = list(nodes)
    stale = {n["node_id"] for n in nodes if roots.get(n["node_id"], n["fingerprint"]) != n["fingerprint"]}
    direct = set(stale)
    while True:
        more = {n["node_id"] for n in nodes if set(n["dependencies"]) & stale} - stale
        if not more:
            break
        stale |= more
    wanted = {n["node_id"]: "DIRECT_STALE" if n["node_id"] in direct else "DOWNSTREAM_STALE" if n["node_id"] in stale else "FRESH" for n in nodes}
    return _named(statuses={k: v["status"] for k, v in found.items()} != wanted, actions=any((v["effective_action"] == "STALE") != (wanted[k] != "FRESH") for k, v in found.items()), count=len(wanted) != len(nodes))


def revalidation(scenarios: DataFrame) -> list[str]:
    """Stale and fresh nodes add up, only a carried-through adoption rebuilds, and what is blocked stays stale."""
    total = F.col("initial_fresh_nodes") + F.col("initial_stale_nodes")
    done = F.col("final_status") == "REVALIDATED"
    return _failing(
        scenarios, accounting=F.col("final_fresh_nodes") + F.col("final_stale_nodes") != total, rebuilt=done & ((F.col("revalidated_nodes") != F.col("initial_stale_nodes")) | (F.col("final_stale_nodes") != 0)), reused=F.col("reused_nodes") != F.col("initial_fresh_nodes"),
        blocked=F.col("final_status").startswith("BLOCKED") & (F.col("final_stale_nodes") != F.col("initial_stale_nodes")), work=~done & ((F.col("revalidated_nodes") > 0) | (F.col("forecast_series_recomputed") > 0)),
    )


def incident(summary: DataFrame) -> list[str]:
    return _failing(summary, accounting=F.col("gold_rows_recomputed") + F.col("gold_rows_reused") != F.col("gold_rows"), outside=F.col("changed_outside_lineage") > 0, repaired=~F.col("repaired_equals_clean"), changed=F.col("gold_rows_changed") > F.col("gold_rows_recomputed"))


def retail(lines: DataFrame, daily: DataFrame, profile: DataFrame) -> list[str]:
    """Totals against the lines, a calendar without gaps, and the profile's counts."""
    bought = F.col("is_purchase_line")
    a = lines.agg(F.sum(F.when(bought, F.col("line_value_gbp"))).alias("revenue"), F.sum(F.when(bought, F.col("quantity"))).alias("units"), F.count_if(bought).alias("n"), F.count("*").alias("rows")).first()
    b = daily.agg(F.sum("revenue_gbp").alias("revenue"), F.sum("units").alias("units"), F.sum("purchase_lines").alias("n"), F.count("*").alias("days"), F.countDistinct("date").alias("dates"), F.date_diff(F.max("date"), F.min("date")).alias("span")).first()
    p = profile.first()
    return _named(revenue=abs(a["revenue"] - b["revenue"]) > 1e-3, units=abs(a["units"] - b["units"]) > 1e-6, purchase_lines=a["n"] != b["n"], calendar=b["days"] != b["span"] + 1 or b["dates"] != b["days"], rows=p["source_rows"] != a["rows"], purchases=p["purchase_line_rows"] != a["n"])


def incremental(work: DataFrame, months: int, rows: int) -> list[str]:
    """A repetition scans nothing, a resumption what is left, a repair one month, an audit every hash."""
    w = {r["scenario"]: r for r in work.collect()}
    return _named(
        no_op=w["no_op"]["rows_scanned"] != 0 or w["no_op"]["processed_partitions"] != 0, resumed=w["interrupted"]["rows_scanned"] + w["resumed"]["rows_scanned"] != rows, partitions=w["interrupted"]["processed_partitions"] + w["resumed"]["processed_partitions"] != months,
        repaired=w["repaired"]["processed_partitions"] != 1 or not 0 < w["repaired"]["rows_scanned"] < rows, audit=w["audited"]["source_hashes"] != months or w["audited"]["rows_scanned"] != 0,
    )


def reporting(response: Mapping, daily: DataFrame, manifest: Mapping[str, Mapping]) -> list[str]:
    """Rows of a response against daily metrics, its digest, and its partitions' bindings."""
    asked, metrics = response["query"], response["query"]["metrics"]
    known = {r["date"].isoformat(): r for r in daily.where(F.col("date").between(F.lit(asked["start_date"]).cast("date"), F.lit(asked["end_date"]).cast("date"))).collect()}
    differs = any(abs(float(row[m]) - float(known[row["date"]][m] if row["date"] in known else 0)) > 1e-6 for row in response["data"] for m in metrics)
    import hashlib
    import json

    digest = hashlib.sha256(json.dumps({"query": asked, "data": response["data"]}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return _named(rows=response["row_count"] != len(response["data"]), values=differs, digest=digest != response["response_sha256"], bindings=any(manifest[p["partition_key"]]["sha256"] != p["source_sha256"] for p in response["partition_provenance"]))


def contract(scenarios: DataFrame) -> list[str]:
    return _failing(scenarios, rows_changed=(F.col("rows_returned") > 0) & ~F.col("same_rows_as_default"), unknown_served=(F.col("schema_version") == "2.0") & (F.col("rows_returned") > 0), fields=F.col("has_contract") & (F.col("schema_version") == "1.0"))


def workload(scenarios: DataFrame) -> list[str]:
    return _failing(scenarios, healthy=~F.col("healthy_results_unchanged"), hot=F.col("hot_payloads") != 1, succeeded=F.col("succeeded") != 12)


#: Parts of names that tell a measured time, which is never a claim.
TIMING = ("seconds", "elapsed", "wall", "latency", "duration")


def claims(observed: Mapping[str, object], pinned: Mapping[str, object]) -> list[str]:
    """Pinned numbers against observed ones; a time among the pinned is refused, as is one that nothing observed."""
    out = [f"timing:{k}" for k in sorted(pinned) if any(t in k.lower() for t in TIMING)]
    out += [f"missing:{k}" for k in sorted(pinned) if k not in observed]
    return out + [f"value:{k}" for k in sorted(pinned) if k in observed and canonical_sha256(observed[k]) != canonical_sha256(pinned[k])]
