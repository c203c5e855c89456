"""Cases on literal frames: certification order, frozen values, governance, store and workload."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from surety.functions import canonical, stats
from surety.operators import experiment, freshness, governance, incident, metrics, quality, retail, store
from surety.plans import queries
from surety.schemas import ContractError
from surety.sources.adapters import canonical_lines


def test_reject_reasons_in_order(spark):
    rows = [("e1", "u1", "notes_app", "app_open", "2026-01-01 00:00:00", "0", 0), ("e1", " ", "x", "y", "never", "-1", 1), ("e2", "u2", "notes_app", "app_open", "2026-01-01 00:00:00", "3", 2)]
    events = spark.createDataFrame(rows, "event_id string, user_id string, product string, event_type string, event_ts string, revenue_gbp string, seq int")
    ok, report, bad = quality.certify_with_rejects(events, "seq")
    assert [r["event_id"] for r in ok.collect()] == ["e1"]
    assert {r["seq"]: r["reject_reason"] for r in bad.collect()} == {1: "duplicate_event_id;missing_identity;invalid_timestamp;invalid_revenue;unknown_product;unknown_event_type;non_purchase_revenue", 2: "non_purchase_revenue"}
    assert report.first()["rows_rejected"] == 2 and report.first()["invalid_ingestion_timestamp_rows"] == 0
    with pytest.raises(ContractError):
        quality.certify(events.drop("user_id"))


def test_backfill_twice_changes_nothing(spark):
    current = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "event_id string, revenue_gbp double")
    patch = spark.createDataFrame([("b", 5.0), ("c", 7.0)], current.schema)
    once = quality.backfill(current, patch)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, quality.backfill(once, patch).collect())) == [("a", 1.0), ("b", 5.0), ("c", 7.0)]


def test_immature_cohorts_show_no_returns(spark):
    rows = [("u1", "first_open", datetime(2026, 1, 1)), ("u1", "app_open", datetime(2026, 1, 8)), ("u2", "first_open", datetime(2026, 1, 5)), ("u2", "app_open", datetime(2026, 1, 12)), ("u3", "first_open", datetime(2026, 1, 9))]
    silver = spark.createDataFrame([("notes_app", *r) for r in rows], "product string, user_id string, event_type string, event_ts timestamp_ntz")
    ledger = {r["cohort_date"].day: r for r in metrics.retention_ledger(silver, [7]).collect()}
    assert ledger[1]["retention_rate"] == 1.0 and ledger[5]["retained_users"] is None and ledger[5]["excluded_users"] == 1


def test_binomial_statistics():
    assert abs(stats.binomial_upper(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-13
    exact = sum(math.comb(50, i) * 0.3**i * 0.7 ** (50 - i) for i in range(13))
    assert abs(stats.binomial_tail(12, 50, 0.3) - exact) < 1e-13
    assert stats.passing_trials(1 / 333, 0.01, 0.05 / 72) == 1853 and stats.stable_trials(1 / 333, 0.01, 0.05 / 72) == (2011, 333)
    assert stats.count_cycle(1 / 49) == 49 and stats.count_cycle(0) == 1 and stats.passing_trials(0.02, 0.01, 0.05) is None
    pmf = [math.comb(20, i) * 0.5**20 for i in range(21)]
    assert abs(stats.binomial_two_sided(4, 20, 0.5) - sum(p for p in pmf if p <= pmf[4] * (1 + 1e-7))) < 1e-13
    assert abs(stats.normal_quantile(0.975) - 1.9599639845400536) < 1e-12


def test_watermark_grid_at_sf001(spark):
    grid = queries.watermark_grid(spark, "/root/testdata/sf0.01")
    rows = {(r["window_index"], r["allowed_lateness_hours"]): r for r in grid.collect()}
    r = rows[2, 24.0]
    assert (r["finalizable_events"], r["late_beyond_watermark_events"], r["revised_metric_cells"], r["finalized_metric_cells"], round(r["max_abs_revenue_revision_gbp"], 2)) == (7002, 179, 5, 198, 43.64)
    assert [h for (w, h), x in sorted(rows.items()) if x["selected_in_window"]] == [96.0, 96.0, 48.0]
    assert freshness.select_stable_policy(freshness.stability_summary(grid))["selected_lateness_hours"] == 96.0


def test_staleness_of_the_three_proposals():
    nodes = governance.evidence_graph(governance.event_contract(), {p: {"approved": True} for p in "abc"}, {"action": "hold"}, {"planning_status": "counterfactual_only"})
    assert len(nodes) == 16
    seen = {}
    for name, proposal in governance.proposals().items():
        kind, compatible, _ = governance.classify(governance.event_contract(), proposal)
        found = governance.propagate(nodes, governance.surfaces(proposal))
        seen[name] = (kind, sum(f["status"] != "FRESH" for f in found.values()), governance.plan_revalidation(nodes, found, kind, "WITHHOLD").status)
    assert seen == {"add_optional_country": ("ADDITIVE", 0, "NOOP"), "rename_required_event_id": ("BREAKING", 13, "BLOCKED_PRODUCER_INCOMPATIBLE"), "broaden_dau_to_any_event": ("SEMANTIC", 8, "BLOCKED_EXPLICIT_ADOPTION_REQUIRED")}
    roots = governance.surfaces(governance.proposals()["broaden_dau_to_any_event"])
    found = governance.propagate(nodes, roots)
    plan = governance.plan_revalidation(nodes, found, "SEMANTIC", "WITHHOLD", adopted=True)
    fresh = governance.apply_revalidation(nodes, plan, {n: roots.get(n, "new") for n in plan.rebuild})
    governance.verify_fresh(fresh, roots)
    assert governance.complete(plan).status == "REVALIDATED" and len(plan.reused) == 8
    with pytest.raises(ContractError):
        governance.apply_revalidation(nodes, plan, {})
    with pytest.raises(ContractError):
        governance.ordered([governance.Node("a", "", ("b",), "", ""), governance.Node("b", "", ("a",), "", "")])


def test_tampered_ledger_is_refused(spark, sf_dir):
    events, ledger = queries.incident_events(spark, sf_dir)
    with pytest.raises(ContractError):
        incident.correct_routing(events, ledger.withColumn("event_type", ledger.event_id))
    for wrong in (ledger.withColumn("event_id", F.concat("event_id", F.lit("x"))), ledger.unionByName(ledger), ledger.withColumn("incident_product", F.lit("file_transfer"))):
        with pytest.raises(ContractError):
            incident.correct_routing(events, wrong)


def lines(spark):
    rows = [(1, "100", "A", None, 2.0, datetime(2010, 1, 1, 9), 10.0, "7"), (2, "101", "B", None, 1.0, datetime(2010, 1, 3, 9), 5.0, None), (3, "C102", "A", None, -1.0, datetime(2010, 2, 3, 9), 10.0, "7"), (4, "103", "A", None, 1.0, datetime(2010, 2, 4, 9), 3.0, "8")]
    return canonical_lines(spark.createDataFrame([(*r, "UK", "s") for r in rows], "source_row_id long, invoice_no string, stock_code string, description string, quantity double, invoice_ts timestamp_ntz, unit_price_gbp double, customer_id string, country string, source_sheet string"))


def test_retail_days_and_semantics(spark):
    daily = {r["date"]: r for r in retail.daily_metrics(lines(spark)).collect()}
    assert len(daily) == 35 and daily[date(2010, 1, 2)]["orders"] == 0 and daily[date(2010, 1, 1)]["revenue_gbp"] == 20.0 and daily[date(2010, 1, 3)]["active_customers"] == 0
    assert {r["metric"]: r["replacement_action"] for r in retail.semantic_comparison(lines(spark)).collect()}["revenue_gbp"] == "WITHHOLD_AS_DROP_IN_REPLACEMENT"


def test_store_noop_resume_repair_and_queries(spark, tmp_path):
    root, out, state = (f"file://{tmp_path}/{n}" for n in ("lines", "metrics", "state.json"))
    manifest = store.write_canonical(lines(spark), root)
    assert {m: e["rows"] for m, e in manifest.items()} == {"2010-01": 2, "2010-02": 2}
    with pytest.raises(store.Interrupted):
        store.run_incremental(spark, root, manifest, out, state, stop_after=1)
    assert store.run_incremental(spark, root, manifest, out, state, audit=True) == store.RunStats(1, 1, 2, 2)
    assert store.run_incremental(spark, root, manifest, out, state) == store.RunStats(0, 2, 0, 0)
    retail.assert_parity(store.materialised_daily(spark, out), retail.on_calendar(retail.dated_metrics(lines(spark))))
    asked = store.MetricQuery(date(2010, 1, 2), date(2010, 2, 3), ("orders", "revenue_gbp"))
    with store.MetricStore(spark, out, state, manifest) as served:
        response, work = served.query(asked, "1.1")
        assert work.partitions_selected == 2 and response["row_count"] == 33 and sum(d["orders"] for d in response["data"]) == 1
        requests = [store.Request(f"r{i}", "c", asked) for i in range(3)] + [store.Request("bad", "c", store.MetricQuery(asked.start_date, asked.end_date, ("profit",))), store.Request("old", "c", asked, "2.0")]
        serial = store.execute_serial(served, requests)
        assert [r["status"] for r in serial] == ["SUCCESS"] * 3 + ["ERROR"] * 2
        assert store.workload_digest(serial) == store.workload_digest(store.execute_concurrent(served, requests, 4)[::-1])
        for wrong in (store.MetricQuery(asked.end_date, asked.start_date, ("orders",)), store.MetricQuery(date(2009, 1, 1), asked.end_date, ("orders",)), store.MetricQuery(asked.start_date, asked.end_date, ("orders", "orders"))):
            with pytest.raises(store.ReportingError):
                served.query(wrong)
    damaged = next((tmp_path / "metrics" / "month=2010-02").glob("part-*"))
    damaged.write_bytes(damaged.read_bytes() + b"x")
    with pytest.raises(store.ReportingError):
        store.MetricStore(spark, out, state, manifest)
    assert store.run_incremental(spark, root, manifest, out, state) == store.RunStats(1, 1, 2, 0)
    store.MetricStore(spark, out, state, manifest)


def test_schema_changes_and_hashes():
    assert [(m["classification"], m["action"]) for m in store.schema_migrations()] == [("ADDITIVE", "APPROVE"), ("BREAKING", "WITHHOLD"), ("BREAKING", "WITHHOLD")]
    assert canonical.canonical_sha256({"b": 1, "a": date(2020, 1, 1)}) == canonical.canonical_sha256({"a": "2020-01-01", "b": 1})
    with pytest.raises(ValueError):
        canonical.canonical_sha256(float("nan"))


def test_experiment_decisions(spark, sf_dir):
    estimates, integrity, decision = experiment.evaluate(queries.users(spark, sf_dir))
    assert estimates.count() == 2 and integrity.passes and decision.action in ("hold", "rollout")
    plan = experiment.guardrail_plan(queries.users(spark, sf_dir))
    n = plan["equal_allocation_target_per_arm"]
    if n and n > 2:
        bound = lambda k: experiment.projected_lower(plan["observed_control_rate"], plan["observed_treatment_rate"], k, stats.normal_quantile(0.975))
        assert bound(n) > -0.03 >= bound(n - 1)


def test_rest_imports_without_the_training_operators():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['surety.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
