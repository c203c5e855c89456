"""Whole lanes: generated events, builds, their checks, and checks that notice tampering."""

import csv
import io
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from surety import cli
from surety.functions import canonical, stats
from surety.operators import certification, experiment, forecast, freshness, governance, incident, pipeline, retail, store
from surety.plans import builds, checks, queries
from surety.schemas import ContractError
from surety.sources import files, generate

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def events(spark):
    return generate.generate_events(spark, days=60).cache()


def test_generated_events_repeat_and_fit_their_parameters(spark, events):
    again = generate.generate_events(spark, days=60).repartition(7)
    assert canonical.frame_sha256(events) == canonical.frame_sha256(again) != canonical.frame_sha256(generate.generate_events(spark, days=60, seed=1))
    assert canonical.frame_sha256(events.where("event_ts < '2026-01-20'").where("event_type = 'first_open'")) == canonical.frame_sha256(generate.generate_events(spark, days=19).where("event_type = 'first_open'"))
    n = {(r["product"], r["event_type"]): r["n"] for r in events.where("user_id is not null").groupBy("product", "event_type").agg(F.countDistinct("event_id").alias("n")).collect()}
    for name, daily, trial, paid, *_ in generate.PRODUCT_ROWS:
        users = n[name, "first_open"]
        assert abs(users - 60 * daily) < 5 * (60 * daily) ** 0.5 and abs(n[name, "trial_start"] / users - trial) < 0.03 and abs(n[name, "paid_subscription"] / n[name, "trial_start"] - paid) < 0.05
    late = events.agg(F.avg((F.col("ingested_at") > F.col("event_ts") + F.expr("interval 48 hours")).cast("double"))).first()[0]
    assert 0.003 < late < 0.007 and events.where("ingested_at < event_ts").count() == 0
    assert generate.generate_events(spark, days=5, faults=False).groupBy("event_id").count().where("count > 1").count() == 0


def test_reference_build_holds_and_tampering_shows(spark, events, tmp_path):
    users = generate.generate_experiment(spark)
    built = builds.reference_build(spark, events.withColumn("seq", F.monotonically_increasing_id()), users, f"file://{tmp_path}/build", "seq")
    tables = built["tables"]
    assert checks.build(tables) == []
    q = tables["quality_report"].first()
    assert q["duplicate_event_rows"] > 0 and q["missing_identity_rows"] > 0 and q["rows_rejected"] < 0.1 * q["rows_raw"]
    bad = tables["retention_maturity_ledger"].withColumn("eligible_users", F.col("eligible_users") + 1)
    assert checks.build({**tables, "retention_maturity_ledger": bad}) == ["mature_denominator", "immature_denominator"]
    gold, silver = tables["gold_daily_metrics"], tables["silver_events"]
    replay = governance.shadow_replay(gold)
    assert checks.migration(gold, replay, built["migration"]) == [] and checks.migration(gold, replay.withColumn("candidate_dau", F.lit(0)), built["migration"]) == ["replay"]
    assert {k: v["action"] for k, v in built["migration"].items()} == {"add_optional_country": "APPROVE", "broaden_dau_to_any_event": "WITHHOLD", "rename_required_event_id": "WITHHOLD"}
    estimates = tables["pricing_estimates"]
    assert checks.pricing(users, estimates, built["integrity"], built["decision"]) == [] and checks.pricing(users, estimates, built["integrity"], {"action": "rollout" if built["decision"]["action"] != "rollout" else "hold"}) == ["action"]
    series = forecast.long_series(forecast.mature_history(gold, silver), ["dau"], ["product"])
    backtest = forecast.rolling_origin(series)
    assert checks.forecasts(series, backtest, forecast.evaluate_plan(backtest)) == [] and "leakage" in checks.forecasts(series, backtest.withColumn("origin_date", F.date_sub("origin_date", 9)), forecast.evaluate_plan(backtest))
    plan = experiment.guardrail_plan(users)
    scenario = experiment.rollout_scenario(estimates.where("metric = 'revenue_gbp_30d'"))
    assert checks.impact(plan, scenario, experiment.impact_summary(scenario, built["decision"]["action"])) == []
    assert json.loads((tmp_path / "build" / "registry.json").read_text())["proposals"]["rename_required_event_id"]["classification"] == "BREAKING"
    assert len(spark.read.csv(f"file://{tmp_path}/build/forecast_evaluations", header=True).collect()) == 9
    incident.assert_frozen(gold, gold.withColumn("revenue_gbp", F.col("revenue_gbp") + 1e-13))
    for wrong in (gold.withColumn("revenue_gbp", F.col("revenue_gbp") + 1e-9), gold.limit(3), gold.withColumn("dau", F.lit(None).cast("long"))):
        with pytest.raises(ContractError):
            incident.assert_frozen(gold, wrong)


def test_pipeline_tables_are_in_the_catalog(spark, tmp_path, sf_dir):
    made = pipeline.run_pipeline(queries.bronze(spark, sf_dir), f"file://{tmp_path}/t", "ingest_seq", "surety_test_")
    assert list(made) == list(pipeline.TABLES)
    for name in pipeline.TABLES:
        assert spark.table(f"surety_test_{name}").count() == made[name].count()
        spark.sql(f"DROP TABLE surety_test_{name}")
    pipeline.register({"gold": made["gold_daily_metrics"]}, "v_")
    assert spark.sql("SELECT count(*) FROM v_gold").first()[0] == made["gold_daily_metrics"].count()


def test_watermark_and_evidence_checks(spark):
    grid = queries.watermark_grid(spark, SMALL).cache()
    decision = freshness.select_stable_policy(freshness.stability_summary(grid))
    assert checks.watermark(grid, decision) == [] and checks.watermark(grid, {**decision, "selected_lateness_hours": 24.0}) == ["stable_choice"]
    assert checks.watermark(grid.withColumn("feasible", ~F.col("feasible"))) != []
    bounded, contract = certification.uncertainty_grid(grid)
    assert checks.uncertainty(bounded, contract) == [] and "late_upper" in checks.uncertainty(bounded.withColumn("late_event_fraction_upper", F.lit(0.0)), contract)
    plans = certification.evidence_plan(grid)
    alpha = plans[0]["per_bound_alpha"]
    found = checks.evidence(plans, {"late": 0.005, "revision": 0.01}, alpha)
    assert set(found) <= {"late_not_least", "revision_not_least"}  # a saw-tooth may pass one trial earlier and fail within its cycle
    small = {**plans[0], "late_rate_below_budget": not plans[0]["late_rate_below_budget"]}
    assert "late_budget" in checks.evidence([small], {"late": 0.005, "revision": 0.01}, alpha)


def test_governance_scenarios(spark):
    scenarios = builds.revalidation(spark, SMALL)
    assert checks.revalidation(scenarios) == [] and {r["scenario"]: (r["final_status"], r["revalidated_nodes"], r["reused_nodes"]) for r in scenarios.collect()} == {
        "additive_noop": ("NOOP", 0, 16), "semantic_silent_replacement": ("BLOCKED_EXPLICIT_ADOPTION_REQUIRED", 0, 8), "semantic_explicit_versioned_adoption": ("REVALIDATED", 8, 8), "breaking_producer_change": ("BLOCKED_PRODUCER_INCOMPATIBLE", 0, 3),
    }
    assert checks.revalidation(scenarios.withColumn("final_stale_nodes", F.lit(5))) != []
    nodes = governance.evidence_graph(governance.event_contract(), {p: {"approved": True} for p in "abc"}, {"action": "hold"}, {"planning_status": "counterfactual_only"})
    for proposal in governance.proposals().values():
        roots = governance.surfaces(proposal)
        found = governance.propagate(nodes, roots)
        assert checks.invalidation(governance.serialise(nodes), found, roots) == []
        assert checks.invalidation(governance.serialise(nodes), {k: {**v, "status": "FRESH"} for k, v in found.items()}, roots) == (["statuses"] if any(v["status"] != "FRESH" for v in found.values()) else [])
    assert checks.incident(builds.incident_summary(spark, SMALL)) == []


def test_retail_lane_and_store_checks(spark, tmp_path, sf_dir):
    found = builds.retail_lane(spark, sf_dir, f"file://{tmp_path}/retail")
    lines = queries.lines(spark, sf_dir)
    assert checks.retail(lines, found["daily"], found["quality"]) == [] and checks.retail(lines, found["daily"].where("orders > 0").limit(50), found["quality"]) != []
    months = lines.select(retail.partition_key().alias("m")).distinct().count()
    assert checks.incremental(builds.incremental_work(spark, sf_dir), months, lines.count()) == []
    assert checks.contract(builds.contract_scenarios(spark, sf_dir)) == [] and checks.workload(builds.workload_scenarios(spark, sf_dir)) == []
    folder, manifest = queries.built_store(spark, sf_dir)
    with store.MetricStore(spark, f"{folder}/metrics", f"{folder}/state.json", manifest) as served:
        response, work = served.query(queries.WINDOW, "1.1")
    assert work.partitions_selected == 3 and checks.reporting(response, found["daily"], manifest) == []
    assert checks.reporting({**response, "row_count": 1}, found["daily"], manifest) == ["rows"]
    out = io.StringIO()
    assert cli.main(["--store", folder, "--start", "1996-12-01", "--end", "1996-12-03", "--metrics", "orders,units", "--format", "csv"], out, spark) == 0
    rows = list(csv.DictReader(io.StringIO(out.getvalue())))
    assert [r["date"] for r in rows] == ["1996-12-01", "1996-12-02", "1996-12-03"] and set(rows[0]) == {"date", "orders", "units"}
    out = io.StringIO()
    cli.main(["--store", folder, "--start", "1996-12-01", "--end", "1996-12-03", "--metrics", "orders", "--schema-version", "1.1"], out, spark)
    assert json.loads(out.getvalue())["schema_version"] == "1.1"
    with pytest.raises(SystemExit):
        cli.main(["--store", folder, "--start", "1996-12-01", "--end", "1996-12-03", "--metrics", "orders", "--schema-version", "9"], out, spark)
    assert store.state_frame(spark, f"{folder}/state.json").count() == months
    assert set(store.output_hashes(spark, f"{folder}/metrics", sorted(manifest)[:2])) == set(sorted(manifest)[:2])


def test_a_crash_loses_one_group_of_months(spark, monkeypatch, sf_dir):
    folder, manifest = queries.built_store(spark, sf_dir)
    places = (f"{folder}/lines", manifest, f"{folder}/other", f"{folder}/other.json")
    monkeypatch.setattr(store, "COMMIT_MONTHS", 20)
    own, calls = store.write_json, []

    def once(uri, value):
        if len(calls) == 2:
            raise OSError("the driver is lost")
        calls.append(uri)
        own(uri, value)

    monkeypatch.setattr(store, "write_json", once)
    with pytest.raises(OSError):
        store.run_incremental(spark, *places)
    monkeypatch.setattr(store, "write_json", own)
    left = store.run_incremental(spark, *places)
    assert left.skipped_partitions == 40 and left.processed_partitions == len(manifest) - 40


def test_hashes_and_manifests(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / "data").mkdir(exist_ok=True)
        (tmp_path / "data" / f"part-{k}").write_bytes(bytes([k]) * (1 << k))
    uri = f"file://{tmp_path}/data"
    here = files.folder_hashes(spark, [uri, f"file://{tmp_path}/none"])
    monkeypatch.setattr(files, "FEW_BYTES", 0)
    assert files.folder_hashes(spark, [uri, f"file://{tmp_path}/none"]) == here and here[f"file://{tmp_path}/none"] is None
    files.write_manifest(spark, uri, f"file://{tmp_path}/manifest.json")
    manifest = spark.createDataFrame(files.read_json(f"file://{tmp_path}/manifest.json")["files"], "path string, bytes long, sha256 string")
    assert canonical.manifest_failures(manifest, canonical.file_manifest(spark, uri)).count() == 0
    (tmp_path / "data" / "part-0").write_bytes(b"\1")
    (tmp_path / "data" / "part-1").write_bytes(b"longer")
    (tmp_path / "data" / "part-2").unlink()
    assert {r["path"][-1]: r["failure"] for r in canonical.manifest_failures(manifest, canonical.file_manifest(spark, uri)).collect()} == {"0": "sha256", "1": "size", "2": "missing"}
    with pytest.raises(ContractError):
        files.write_manifest(spark, f"file://{tmp_path}/empty", f"file://{tmp_path}/m.json")
    found = files.provenance(str(tmp_path / "data" / "part-0"), str(tmp_path / "data" / "part-1"), ["s"], "u", "d", "l")
    assert found["archive_bytes"] == 1 and found["ingestion_timestamp_available"] is False
    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "k int, t string, x double")
    assert canonical.frame_sha256(df) == canonical.frame_sha256(df.repartition(3).select("x", "k", "t")) != canonical.frame_sha256(df.unionByName(df))
    assert checks.claims({"rows": 3}, {"rows": 3}) == [] and checks.claims({"rows": 3}, {"rows": 4, "elapsed_seconds": 1}) == ["timing:elapsed_seconds", "missing:elapsed_seconds", "value:rows"]


def test_contracts_as_data():
    assert store.schema_registry()["schemas"][0]["row"] == [["date", "date"]] and store.reporting_contract()["max_query_days"] == 366
    asked = store.reference_workload(date(2009, 12, 1), date(2011, 12, 9))
    assert len(asked) == 12 and len({r.request_id for r in asked}) == 12 and store.request_dict(asked[0])["query"]["metrics"] == ["revenue_gbp", "orders"]
    assert all((r.query.end_date - r.query.start_date).days < 366 for r in asked) and [r.expected_success for r in store.failure_workload(date(2010, 1, 1))] == [False] * 3
    assert abs(stats.binomial_upper(3, 50, 0.05) - 0.1478) < 1e-3
