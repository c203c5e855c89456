"""One query per operator over the star-schema tables; ``oracle`` holds their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.operators import certification, experiment, forecast, freshness, governance, incident, metrics, pipeline, quality, retail, store
from surety.plans import builds
from surety.session import scratch_uri
from surety.sources import adapters, generate

Query = Callable[[SparkSession, str], DataFrame]
SNAPSHOTS = [datetime(2024, 1, d, 23, 59, 59, 999999) for d in (16, 23, 30)]
MIDMONTH = SNAPSHOTS[1]
INCIDENT = ("notes_app", "photo_editor", "app_open")
WINDOW = store.MetricQuery(date(1996, 11, 28), date(1997, 1, 4), ("revenue_gbp", "orders"))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits: sums in another order differ in the last one."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def bronze(spark, sf_dir):
    return adapters.bronze_events(spark, sf_dir)


def judged(spark, sf_dir):
    return quality.judged_events(bronze(spark, sf_dir), "ingest_seq")


def silver(spark, sf_dir):
    return quality.certified(judged(spark, sf_dir)).drop("ingest_seq")


def gold(spark, sf_dir):
    return metrics.daily_metrics(silver(spark, sf_dir))


def lines(spark, sf_dir):
    return adapters.retail_lines(spark, sf_dir)


def retail_series(spark, sf_dir):
    return forecast.long_series(retail.daily_metrics(lines(spark, sf_dir)), ["revenue_gbp", "orders", "units", "active_customers"])


def gold_series(spark, sf_dir):
    certified = silver(spark, sf_dir)
    return forecast.long_series(forecast.mature_history(metrics.daily_metrics(certified), certified), ["dau", "paid_subscription", "revenue_gbp"], ["product"])


def backtest(spark, sf_dir):
    return forecast.rolling_origin(retail_series(spark, sf_dir))


def watermark_grid(spark, sf_dir):
    return freshness.watermark_backtest(silver(spark, sf_dir), SNAPSHOTS)


def kept_silver(spark, sf_dir):
    """Silver written once, for plans that start from it several times."""
    path, df = scratch_uri(spark, "silver"), silver(spark, sf_dir)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def incident_events(spark, sf_dir):
    certified = kept_silver(spark, sf_dir)
    return incident.inject_routing_error(certified, *INCIDENT, incident.incident_window(metrics.daily_metrics(certified), certified, INCIDENT[0]))


def selective(spark, sf_dir):
    events, ledger = incident_events(spark, sf_dir)
    fixed = incident.correct_routing(events, ledger)
    return incident.selective_gold(metrics.daily_metrics(events), fixed, incident.affected_cells(ledger))


def supersession(spark, sf_dir):
    events, ledger = incident_events(spark, sf_dir)
    series = lambda e: forecast.long_series(metrics.daily_metrics(e), ["dau"], ["product"])
    evaluated = lambda e: _round(forecast.evaluate_plan(forecast.rolling_origin(series(e), origins=3), forecast.PlanningGate(min_backtest_points=21)))
    found = incident.supersession_ledger(evaluated(events), evaluated(incident.correct_routing(events, ledger)))
    return found.select("decision_id", "metric", "evidence_state", "status", "superseded_by", "supersedes", "supersession_reason", "evidence_changed")


def designs(spark, sf_dir):
    """Design candidates from suppliers: shares and information by key, risks from the balance."""
    return adapters.read(spark, sf_dir, "supplier").selectExpr(
        "0.1D + 0.1D * (s_suppkey % 8) AS treatment_share", "cast(1000 + 37 * s_suppkey AS int) AS balanced_equivalent_information", "cast(30 + s_suppkey % 400 AS double) AS readout_days",
        "1000.0D + s_suppkey % 1200 AS es95_gbp_per_1000", "cast(s_suppkey % 9 AS double) AS unsafe_exposure_per_1000", "(s_suppkey % 10) / 10.0D AS tail_concentration",
    )


def lineage(spark, sf_dir):
    """Staleness over the three proposals, by reachability in SQL."""
    forecasts = {p: {"approved": True} for p in ("file_transfer", "notes_app", "photo_editor")}
    nodes = governance.evidence_graph(governance.event_contract(), forecasts, {"action": "hold"}, {"planning_status": "counterfactual_only"})
    cases = {name: governance.surfaces(proposal) for name, proposal in governance.proposals().items()}
    return governance.propagate_sql(spark, nodes, cases).groupBy("proposal", "status").agg(F.count("*").alias("nodes"))


def monthly(spark, sf_dir):
    return retail.dated_metrics(lines(spark, sf_dir).withColumn("month", retail.partition_key()), "month")


def built_store(spark, sf_dir):
    """(folder, manifest) of a store of the lines' months, materialised."""
    folder = scratch_uri(spark, "store")
    manifest = store.write_canonical(lines(spark, sf_dir), f"{folder}/lines")
    store.run_incremental(spark, f"{folder}/lines", manifest, f"{folder}/metrics", f"{folder}/state.json")
    return folder, manifest


def window_frame(spark, sf_dir):
    """What the store serves: two months' partitions, verified, read and filled."""
    folder, manifest = built_store(spark, sf_dir)
    with store.MetricStore(spark, f"{folder}/metrics", f"{folder}/state.json", manifest) as served:
        return served.frame(WINDOW)


def persisted(spark, sf_dir):
    """Rows of each table that a run of the pipeline leaves."""
    made = pipeline.run_pipeline(bronze(spark, sf_dir), scratch_uri(spark, "tables"), "ingest_seq")
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in made.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


def backfilled(spark, sf_dir):
    rows = silver(spark, sf_dir).select("event_id", "product", "revenue_gbp")
    patch = rows.where("event_id LIKE '%7'").withColumn("revenue_gbp", F.col("revenue_gbp") + 1.0).unionByName(rows.where("event_id LIKE '%03'").withColumn("event_id", F.concat(F.lit("new-"), "event_id")))
    return quality.backfill(rows, patch)


def users(spark, sf_dir):
    return adapters.experiment_users(spark, sf_dir)


def customer_ids(spark, sf_dir):
    raw = "CASE WHEN c_custkey % 5 = 0 THEN 'nan' WHEN c_custkey % 5 = 1 THEN ' ' || cast(c_custkey AS string) || '.0' WHEN c_custkey % 5 = 2 THEN '' WHEN c_custkey % 5 = 3 THEN NULL ELSE cast(c_custkey AS string) END"
    rows = adapters.read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{raw} AS raw")
    return rows.select("c_custkey", adapters.customer_id(F.col("raw")).alias("customer_id"))


def schema_changes(spark, sf_dir):
    rows = [(m["proposal"], m["classification"], m["action"], len(m["additions"]), len(m["breaking_changes"])) for m in store.schema_migrations()]
    return spark.createDataFrame(rows, "proposal string, classification string, action string, additions long, breaking long")


def selection(spark, sf_dir):
    summary = freshness.stability_summary(watermark_grid(spark, sf_dir))
    return summary.where("stable_all_windows").orderBy("allowed_lateness_hours").limit(1).select("allowed_lateness_hours", "windows", "feasible_windows")


def evidence_plans(spark, sf_dir):
    plans = certification.evidence_plan(watermark_grid(spark, sf_dir))
    names = ["allowed_lateness_hours", "required_late_event_trials", "required_revised_metric_cells", "evidence_only_addressable", "planning_interpretation"]
    return spark.createDataFrame([tuple(p[n] for n in names) for p in plans], "allowed_lateness_hours double, required_late_event_trials long, required_revised_metric_cells long, evidence_only_addressable boolean, planning_interpretation string")


def streamed_daily(spark, sf_dir):
    """Closed days of a Structured Streaming run over the events table."""
    from surety.streaming.certify import daily_active_stream

    raw = spark.readStream.schema(adapters.read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    typed = raw.selectExpr("cast(user_id % 3 AS string) AS product", "cast(user_id AS string) AS user_id", "CASE WHEN event_type = 'view' THEN 'app_open' ELSE event_type END AS event_type", "ts AS event_ts")
    return _finished(spark, daily_active_stream(typed))


def _finished(spark, stream):
    """All that a stream of the rows available now appends, from files in the shared folder."""
    folder = scratch_uri(spark, "stream")
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def streamed_silver(spark, sf_dir):
    """Certified rows of a Structured Streaming run over the events table, each event_id once."""
    from surety.streaming.certify import silver_stream

    raw = spark.readStream.schema(adapters.read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    copies = raw.withColumn("copy", F.explode(F.when(F.col("event_id") % 40 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    typed = copies.selectExpr("concat('e', event_id) AS event_id", "CASE WHEN event_id % 97 = 0 THEN ' ' ELSE concat('u', user_id) END AS user_id", "CASE WHEN event_id % 131 = 0 THEN 'mystery' ELSE 'notes_app' END AS product", "CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'app_open' END AS event_type", "ts AS event_ts", "CASE WHEN event_type = 'purchase' OR event_id % 139 = 0 THEN value ELSE 0.0D END AS revenue_gbp")
    return _finished(spark, silver_stream(typed)).select("event_id", "user_id", "product", "event_type", F.round("revenue_gbp", 6).alias("revenue_gbp"))


BOUNDS = ["late_event_fraction_upper", "revised_metric_cell_fraction_upper", "passes_late_event_upper", "passes_revised_metric_cell_upper", "passes_revenue_revision_hard_gate", "passes_paid_subscription_revision_hard_gate", "certified_under_binomial_model"]

QUERIES: dict[str, Query] = {
    "q_silver_sql": lambda s, d: _round(silver(s, d)),
    "q_certify_rejects": lambda s, d: quality.quality_report(judged(s, d)),
    "q_rejected_rows": lambda s, d: quality.rejected(judged(s, d)).select("event_id", "ingest_seq", "reject_reason", "event_ts_parsed", "ingested_at_parsed", F.round("revenue_gbp_parsed", 6).alias("revenue_gbp_parsed")),
    "q_reconcile_revenue": lambda s, d: _round(quality.reconcile_revenue(bronze(s, d), silver(s, d)), 4),
    "q_backfill": lambda s, d: _round(backfilled(s, d)),
    "m_daily_sql": lambda s, d: _round(gold(s, d)),
    "m_dau_migration": lambda s, d: _round(metrics.dau_migration(gold(s, d))),
    "m_dau_migration_summary": lambda s, d: _round(metrics.dau_migration_summary(gold(s, d))),
    "m_retention_ledger_sql": lambda s, d: _round(metrics.retention_ledger(silver(s, d))),
    "m_activity_retention": lambda s, d: _round(metrics.activity_retention(metrics.retention_ledger(silver(s, d)))),
    "m_retention_summary": lambda s, d: _round(metrics.retention_summary(metrics.activity_retention(metrics.retention_ledger(silver(s, d))))),
    "m_retention_maturity_summary": lambda s, d: _round(metrics.retention_maturity_summary(metrics.retention_ledger(silver(s, d)))),
    "m_portfolio_conversion": lambda s, d: _round(metrics.portfolio_conversion(silver(s, d))),
    "time_with_lateness": lambda s, d: _round(freshness.with_lateness(silver(s, d)).select("event_id", "ingestion_delay_hours", "late_beyond_watermark")),
    "time_late_summary": lambda s, d: _round(freshness.late_arrival_summary(silver(s, d))),
    "time_available_as_of": lambda s, d: freshness.available_as_of(silver(s, d), MIDMONTH).groupBy("product").agg(F.count("*").alias("events")),
    "time_late_snapshot": lambda s, d: _round(freshness.late_after_snapshot(silver(s, d), MIDMONTH)),
    "time_revision_report": lambda s, d: _round(freshness.metric_revision_report(silver(s, d), MIDMONTH).drop("processing_as_of"), 4),
    "time_revision_summary": lambda s, d: _round(freshness.revision_summary(freshness.metric_revision_report(silver(s, d), MIDMONTH)), 4),
    "time_rolling_backtest": lambda s, d: _round(watermark_grid(s, d).drop("processing_as_of")),
    "time_stability": lambda s, d: _round(freshness.stability_summary(watermark_grid(s, d)), 4),
    "time_select_stable": selection,
    "s_uncertainty_grid": lambda s, d: _round(certification.uncertainty_grid(watermark_grid(s, d))[0].select("window_index", "allowed_lateness_hours", *BOUNDS)),
    "s_uncertainty_summary": lambda s, d: _round(certification.uncertainty_summary(certification.uncertainty_grid(watermark_grid(s, d))[0])),
    "s_planning_rates": lambda s, d: _round(certification.planning_rates(watermark_grid(s, d)), 4),
    "s_evidence_plan": evidence_plans,
    "f_mature_history": lambda s, d: forecast.mature_history(gold(s, d), silver(s, d)).select("product", "date", "dau"),
    "f_seasonal_naive": lambda s, d: _round(forecast.seasonal_holdout(retail_series(s, d)), 4),
    "f_evaluate_legacy": lambda s, d: _round(forecast.evaluate_mape(forecast.seasonal_holdout(retail_series(s, d)))),
    "f_conformal_radius": lambda s, d: _round(backtest(s, d).select("series", "origin_index", "interval_radius", "calibration_points").distinct(), 4),
    "f_rolling_origin": lambda s, d: _round(backtest(s, d), 4),
    "f_evaluate_plan": lambda s, d: _round(forecast.evaluate_plan(backtest(s, d))),
    "f_reconciliation": lambda s, d: _round(forecast.reconciliation(backtest(s, d)), 4),
    "f_bundle": lambda s, d: _round(forecast.evaluate_plan(forecast.rolling_origin(gold_series(s, d), origins=3))),
    "e_diff_means": lambda s, d: _round(experiment.difference_in_means(users(s, d), "revenue_gbp_30d"), 3),
    "e_diff_props": lambda s, d: _round(experiment.difference_in_proportions(users(s, d), "paid_subscription_30d")),
    "e_ancova": lambda s, d: _round(experiment.adjusted_effect(users(s, d), "revenue_gbp_30d", "pre_revenue_gbp_30d"), 3),
    "e_evaluate": lambda s, d: _round(experiment.evaluate(users(s, d))[0], 3),
    "i_scenario": lambda s, d: _round(experiment.rollout_scenario(experiment.difference_in_means(users(s, d), "revenue_gbp_30d")).drop("effect", "ci_low", "ci_high"), 0),
    "r_alloc": lambda s, d: _round(experiment.allocation(designs(s, d))),
    "r_candidate": lambda s, d: _round(experiment.passing_designs(experiment.allocation(designs(s, d)))),
    "r_variance_info": lambda s, d: _round(experiment.allocation(designs(s, d)).select("total_users", "treatment_users", experiment.adjusted_information(F.col("control_users"), F.col("treatment_users"), F.lit(1.5)).alias("information"))),
    "g_shadow": lambda s, d: _round(governance.shadow_replay(gold(s, d))),
    "g_shadow_summary": lambda s, d: _round(governance.shadow_summary(governance.shadow_replay(gold(s, d)))),
    "g_forecast_impact": lambda s, d: _round(governance.forecast_impact(gold(s, d), silver(s, d), 3)),
    "v_candidate_forecasts": lambda s, d: _round(governance.candidate_forecasts(gold(s, d), silver(s, d), 3)),
    "d_propagate": lineage,
    "n_window": lambda s, d: incident.incident_window(gold(s, d), silver(s, d), INCIDENT[0]),
    "n_inject": lambda s, d: incident_events(s, d)[1].drop("event_ts"),
    "n_correct": lambda s, d: incident.correct_routing(*incident_events(s, d)).select("event_id", "product", "event_type", "event_ts"),
    "n_affected": lambda s, d: incident.affected_cells(incident_events(s, d)[1]),
    "n_selective_gold": lambda s, d: _round(selective(s, d)),
    "n_changed": lambda s, d: incident.changed_cells(_round(metrics.daily_metrics(incident_events(s, d)[0])), _round(gold(s, d))),
    "n_supersession": supersession,
    "x_customer_norm": customer_ids,
    "x_quality": lambda s, d: retail.source_profile(lines(s, d)),
    "x_partition_key": lambda s, d: lines(s, d).groupBy(retail.partition_key().alias("partition_key")).agg(F.count("*").alias("rows")),
    "x_aggregate": lambda s, d: _round(monthly(s, d), 4),
    "x_daily": lambda s, d: _round(retail.daily_metrics(lines(s, d)), 4),
    "x_materialise": lambda s, d: _round(store.materialised_daily(s, built_store(s, d)[0] + "/metrics"), 4),
    "x_semantic": lambda s, d: _round(retail.semantic_comparison(lines(s, d)), 4),
    "t_query": lambda s, d: _round(window_frame(s, d), 4),
    "k_classify": schema_changes,
    "stream_daily_active": streamed_daily,
    "stream_silver": streamed_silver,
    "p_run_pipeline": persisted,
    "src_generate_events": lambda s, d: generate.generate_events(s, days=30).groupBy("product", "event_type").agg(F.count("*").alias("events")),
    "src_generate_experiment": lambda s, d: generate.generate_experiment(s, 1_000).groupBy("treatment").agg(F.count("*").alias("users")),
    "src_product_config": lambda s, d: generate.product_parameters(s),
    "b_invalidation": lineage,
    "b_dau_forecasts": lambda s, d: _round(governance.evaluated_definitions(gold(s, d), silver(s, d), {"current": "dau"}, 3).drop("definition")),
    "b_revalidation": lambda s, d: builds.revalidation(s, d),
    "b_incident": lambda s, d: builds.incident_summary(s, d),
    "b_incremental": lambda s, d: builds.incremental_work(s, d),
    "b_reporting": lambda s, d: builds.reporting_work(s, d),
    "b_contract": lambda s, d: builds.contract_scenarios(s, d),
    "b_workload": lambda s, d: builds.workload_scenarios(s, d),
}
