"""Scenario tables over whole lanes: what was recomputed, reused, selected or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.functions.canonical import canonical_sha256, frame_sha256
from surety.operators import experiment, forecast, governance, incident, metrics, retail, store
from surety.plans import queries as q
from surety.session import scratch_uri
from surety.sources.files import write_csv, write_json


def workbench(spark: SparkSession, events: DataFrame, users: DataFrame, folder: str, sequence: str | None = None, origins: int = forecast.ORIGINS) -> dict:
    """The controlled lane from Bronze to decisions: tables below ``folder``, and what was decided."""
    from surety.operators import pipeline

    tables = pipeline.run_pipeline(events, f"{folder}/tables", sequence)
    silver, gold = tables["silver_events"], tables["gold_daily_metrics"]
    ledger = metrics.retention_ledger(silver)
    tables["retention_maturity_ledger"] = ledger
    tables["dau_definition_migration"] = metrics.dau_migration(gold)
    series = forecast.long_series(forecast.mature_history(gold, silver), ["dau", "paid_subscription", "revenue_gbp"], ["product"])
    tables["forecast_evaluations"] = forecast.evaluate_plan(forecast.rolling_origin(series, origins))
    estimates, integrity, decision = experiment.evaluate(users)
    tables["pricing_estimates"] = estimates
    for name in ("retention_maturity_ledger", "dau_definition_migration", "forecast_evaluations", "pricing_estimates"):
        write_csv(tables[name], f"{folder}/{name}")
    decided = {"event_contract": governance.event_contract(), "integrity": integrity.__dict__, "decision": decision.__dict__}
    write_json(f"{folder}/decisions.json", decided)
    return {"tables": tables, **decided}


def reference_build(spark: SparkSession, events: DataFrame, users: DataFrame, folder: str, sequence: str | None = None, origins: int = forecast.ORIGINS) -> dict:
    """The workbench, then the governance of its contract: proposals, shadow replay, forecast impact and migration decisions."""
    built = workbench(spark, events, users, folder, sequence, origins)
    silver, gold = built["tables"]["silver_events"], built["tables"]["gold_daily_metrics"]
    built["migration"] = migration(gold, silver, origins)
    write_json(f"{folder}/migration.json", built["migration"])
    write_json(f"{folder}/registry.json", governance.registry())
    return built


def migration(gold: DataFrame, silver: DataFrame, origins: int = forecast.ORIGINS) -> dict[str, dict]:
    """A decision for each proposal; only a change of meaning moves the metric or its forecasts."""
    replay = governance.shadow_replay(gold)
    largest = governance.shadow_summary(replay).agg(F.max(F.abs("portfolio_weighted_dau_delta_pct"))).first()[0] or 0.0
    changed = governance.forecast_impact(gold, silver, origins).agg(F.max("eligibility_changed")).first()[0] or False
    out = {}
    for name, proposal in sorted(governance.proposals().items()):
        kind, compatible, _ = governance.classify(governance.event_contract(), proposal)
        moves = kind == "SEMANTIC"
        out[name] = governance.decide_migration(kind, compatible, largest if moves else 0.0, changed if moves else False)
    return out


def revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scenarios of a contract change: nothing to do, blocked twice, and an explicit adoption carried through."""
    gold, silver = q.gold(spark, sf_dir), q.silver(spark, sf_dir)
    decisions = migration(gold, silver, 3)
    current = [r.asDict() for r in q._round(governance.evaluated_definitions(gold, silver, {"current": "dau"}, 3)).orderBy("product").collect()]  # a row a product
    adopted = [r.asDict() for r in q._round(governance.candidate_forecasts(gold, silver, 3)).orderBy("product").collect()]
    nodes = governance.evidence_graph(governance.event_contract(), {r["product"]: r for r in current}, {"action": "hold"}, {"planning_status": "counterfactual_only"})
    rows = []
    for scenario, proposal, adopt in (("additive_noop", "add_optional_country", False), ("semantic_silent_replacement", "broaden_dau_to_any_event", False), ("semantic_explicit_versioned_adoption", "broaden_dau_to_any_event", True), ("breaking_producer_change", "rename_required_event_id", True)):
        contract = governance.proposals()[proposal]
        kind, _, _ = governance.classify(governance.event_contract(), contract)
        roots = governance.surfaces(contract)
        found = governance.propagate(nodes, roots)
        plan = governance.plan_revalidation(nodes, found, kind, decisions[proposal]["action"], adopt)
        stale, status, left = sum(f["status"] != governance.FRESH for f in found.values()), plan.status, 0
        if plan.status == "READY":
            prints, actions = governance.replacements(nodes, roots, adopted)
            governance.verify_fresh(governance.apply_revalidation(nodes, plan, prints, actions), roots)
            status = governance.complete(plan).status
        elif plan.status != "NOOP":
            left = stale
        done = status == "REVALIDATED"
        rows.append((scenario, proposal, kind, decisions[proposal]["action"], adopt, plan.status, status, len(nodes) - stale, stale, len(plan.rebuild) if done else 0, len(plan.reused), len(nodes) - left, left, len(adopted) if done else 0))
    names = "scenario string, proposal string, classification string, migration_action string, explicit_adoption boolean, plan_status string, final_status string, initial_fresh_nodes long, initial_stale_nodes long, revalidated_nodes long, reused_nodes long, final_fresh_nodes long, final_stale_nodes long, forecast_series_recomputed long"
    return spark.createDataFrame(rows, names)


def incident_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: events touched, Gold cells recomputed and reused, and whether the repaired Gold is the clean one."""
    silver = q.silver(spark, sf_dir)
    clean = q._round(metrics.daily_metrics(silver))
    events, ledger = q.incident_events(spark, sf_dir)
    cells = incident.affected_cells(ledger)
    fixed = incident.correct_routing(events, ledger)
    repaired = q._round(incident.selective_gold(metrics.daily_metrics(events), fixed, cells))
    changed = incident.changed_cells(clean, q._round(metrics.daily_metrics(events)))
    outside = changed.join(cells, ["product", "date"], "left_anti").count()
    same = frame_sha256(clean) == frame_sha256(repaired)
    total, touched, hit, moved = clean.count(), cells.count(), ledger.count(), changed.count()
    row = (hit, total, touched, total - touched, moved, outside, same)
    return spark.createDataFrame([row], "events_touched long, gold_rows long, gold_rows_recomputed long, gold_rows_reused long, gold_rows_changed long, changed_outside_lineage long, repaired_equals_clean boolean")


def retail_lane(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, DataFrame]:
    """Profile, daily metrics, semantic comparison and forecasts of the retail lines, as CSV below ``folder``."""
    lines = q.lines(spark, sf_dir)
    daily = retail.daily_metrics(lines)
    found = {"quality": retail.source_profile(lines), "daily": daily, "semantics": retail.semantic_comparison(lines), "forecasts": forecast.evaluate_plan(forecast.rolling_origin(forecast.long_series(daily, ["revenue_gbp", "orders", "units", "active_customers"])))}
    for name, df in found.items():
        write_csv(df, f"{folder}/{name}")
    return found


#: Partitions after which the interrupted run stops, and the place of the damaged one in the months' order.
STOP_AFTER, DAMAGED = 7, 2


def incremental_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work of a run that is interrupted, resumed, repeated, repaired and audited: partitions and rows."""
    folder = scratch_uri(spark, "work")
    places = (f"{folder}/lines", f"{folder}/metrics", f"{folder}/state.json")
    manifest = store.write_canonical(q.lines(spark, sf_dir), places[0])
    months = sorted(manifest)
    run = lambda **more: store.run_incremental(spark, places[0], manifest, places[1], places[2], **more)
    rows = []
    try:
        done = run(stop_after=STOP_AFTER)
    except store.Interrupted:
        kept = store.state_frame(spark, places[2]).agg(F.count("*").alias("n"), F.coalesce(F.sum("source_rows"), F.lit(0)).alias("rows")).first()
        done = store.RunStats(kept["n"], 0, kept["rows"], 0)
    rows.append(("interrupted", done))
    rows += [("resumed", run()), ("no_op", run())]
    if len(months) > DAMAGED:
        store.corrupt_partition(places[1], months[DAMAGED])
    rows += [("repaired", run()), ("audited", run(audit=True))]
    return spark.createDataFrame([(name, s.processed_partitions, s.skipped_partitions, s.rows_scanned, s.source_hashes_computed) for name, s in rows], "scenario string, processed_partitions long, skipped_partitions long, rows_scanned long, source_hashes long")


def reporting_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions selected and rows returned by windows of several lengths, and a tampered store that is refused."""
    folder, manifest = q.built_store(spark, sf_dir)
    places = (f"{folder}/metrics", f"{folder}/state.json", manifest)
    asked = [("one_week", store.MetricQuery(q.date(1996, 12, 1), q.date(1996, 12, 7), retail.METRICS)), ("across_months", q.WINDOW), ("year", store.MetricQuery(q.date(1996, 1, 1), q.date(1996, 12, 31), ("orders",)))]
    rows = []
    with store.MetricStore(spark, *places) as served:
        for name, query in asked:
            _, work = served.query(query, "1.1")
            rows.append((name, work.partitions_selected, work.metric_files_hashed, work.rows_returned, False))
        store.corrupt_partition(places[0], "1996-12")
        try:
            served.query(asked[0][1])
            refused = False
        except store.ReportingError:
            refused = True
    return spark.createDataFrame([*rows, ("tampered", 0, 0, 0, refused)], "scenario string, partitions_selected long, partitions_hashed long, rows_returned long, refused boolean")


def contract_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both response schemas over one window: the rows stay, the newer one says what it is."""
    folder, manifest = q.built_store(spark, sf_dir)
    rows = []
    with store.MetricStore(spark, f"{folder}/metrics", f"{folder}/state.json", manifest) as served:
        kept = {}
        for version in store.SCHEMAS:
            response, work = served.query(q.WINDOW, version)
            kept[version] = canonical_sha256(response["data"])
            rows.append((version, work.rows_returned, len(response), "contract" in response, kept[version] == kept[store.DEFAULT_SCHEMA]))
        try:
            served.query(q.WINDOW, "2.0")
        except store.ReportingError:
            rows.append(("2.0", 0, 0, False, False))
    return spark.createDataFrame(rows, "schema_version string, rows_returned long, top_level_fields long, has_contract boolean, same_rows_as_default boolean")


def workload_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests one by one, at once, with failures among them, and after these: the same healthy results."""
    folder, manifest = q.built_store(spark, sf_dir)
    with store.MetricStore(spark, f"{folder}/metrics", f"{folder}/state.json", manifest) as served:
        healthy = store.reference_workload(*served.available)
        bad = store.failure_workload(served.available[0])
        serial = store.execute_serial(served, healthy)
        wanted = store.workload_digest(serial)
        runs = {"serial": serial, "concurrent": store.execute_concurrent(served, healthy), "with_failures": store.execute_concurrent(served, [x for pair in zip(healthy, [*bad, *bad, *bad, *bad]) for x in pair]), "after_failures": store.execute_concurrent(served, healthy)}
    rows = []
    for name, found in runs.items():
        ok = {r["request_id"]: r for r in found if r["status"] == "SUCCESS"}
        hot = {r["response_payload_sha256"] for r in ok.values() if r["request_id"].startswith("hot-")}
        rows.append((name, len(found), len(ok), sum(r["partitions_selected"] for r in ok.values()), sum(r["rows_returned"] for r in ok.values()), len(hot), store.workload_digest(ok.values()) == wanted))
    return spark.createDataFrame(rows, "scenario string, requests long, succeeded long, partitions_selected long, rows_returned long, hot_payloads long, healthy_results_unchanged boolean")
