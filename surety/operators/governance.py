"""Contracts, their changes, and the evidence that goes stale with them."""

from __future__ import annotations

import copy
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.functions.canonical import canonical_sha256
from surety.operators.forecast import ORIGINS, evaluate_plan, mature_history, rolling_origin
from surety.schemas import EVENT_TYPES, PRODUCTS, ContractError

#: Fixed value: the largest relative metric change that a migration may bring.
TOLERANCE = 0.01
METRICS = ("dau", "revenue_gbp", "paid_subscription")
FRESH, DIRECT, DOWNSTREAM = "FRESH", "DIRECT_STALE", "DOWNSTREAM_STALE"


def event_contract() -> dict:
    # The contract's keys, names and lists.  The rules are this engine's own words.
    return {
        "version": "1.2",
        "grain": "one product event per row",
        "required_columns": ["event_id", "event_ts", "event_type", "product", "revenue_gbp", "user_id"],
        "generated_processing_time_column": "ingested_at",
        "legacy_processing_time_fallback": "if ingested_at is absent, certification treats arrival time as event_ts",
        "optional_dimensions": ["platform", "source"],
        "allowed_products": sorted(PRODUCTS),
        "allowed_event_types": sorted(EVENT_TYPES),
        "activity_event": "app_open",
        "rules": {
            "event_id": "one row per identifier; later rows are rejected",
            "user_id": "non-empty identity",
            "event_ts": "parseable event time in UTC",
            "ingested_at": "parseable processing time, not before the event",
            "revenue_gbp": "numeric and non-negative",
            "revenue_scope": "revenue only on purchases",
            "active_use": "a day's active use is an app_open",
        },
    }


def proposals() -> dict[str, dict]:
    """Three controlled changes of the event contract: additive, breaking, semantic."""
    additive, breaking, semantic = (copy.deepcopy(event_contract()) for _ in range(3))
    additive["optional_dimensions"].append("country")
    breaking["required_columns"] = sorted("event_uuid" if c == "event_id" else c for c in breaking["required_columns"])
    breaking["rules"]["event_uuid"] = breaking["rules"].pop("event_id")
    semantic["activity_event"] = "any_certified_event"
    semantic["rules"]["active_use"] = "a day's active use is any certified event"
    return {"add_optional_country": additive, "rename_required_event_id": breaking, "broaden_dau_to_any_event": semantic}


def classify(current: Mapping, proposed: Mapping) -> tuple[str, bool, tuple[str, ...]]:
    """(BREAKING, SEMANTIC, ADDITIVE or NO_CHANGE; producer compatible; what differs)."""
    listed = ("required_columns", "allowed_products", "allowed_event_types", "optional_dimensions")
    old, new = ({k: set(c.get(k, ())) for k in listed} for c in (current, proposed))
    differs = lambda *keys: [f"{k} changed" for k in keys if current.get(k) != proposed.get(k)]
    gone = lambda *keys: [f"{k} lost {sorted(old[k] - new[k])}" for k in keys if old[k] - new[k]]
    levels = (
        ("BREAKING", ["required_columns changed"] if old["required_columns"] != new["required_columns"] else []),
        ("BREAKING", differs("grain", "generated_processing_time_column")),
        ("BREAKING", gone("allowed_products", "allowed_event_types")),
        ("SEMANTIC", differs("activity_event", "rules", "legacy_processing_time_fallback")),
        ("BREAKING", gone("optional_dimensions")),
        ("ADDITIVE", [f"{k} gained {sorted(new[k] - old[k])}" for k in listed[1:] if new[k] - old[k]]),
    )
    kind, reasons = next(((k, r) for k, r in levels if r), ("NO_CHANGE", ["identical"]))
    return kind, kind != "BREAKING", tuple(reasons)


def shadow_replay(gold: DataFrame) -> DataFrame:
    """Current against any-event activity on the same certified rows."""
    delta = F.col("dau_legacy_any_event") - F.col("dau")
    return gold.select(
        "product", "date", F.col("dau").alias("current_dau"), F.col("dau_legacy_any_event").alias("candidate_dau"), delta.alias("dau_delta_users"), F.try_divide(delta.cast("double"), F.col("dau")).alias("dau_relative_delta"),
        F.col("paid_subscription").alias("current_paid_subscription"), F.col("paid_subscription").alias("candidate_paid_subscription"), F.lit(0).cast("long").alias("paid_delta"),
        F.col("revenue_gbp").alias("current_revenue_gbp"), F.col("revenue_gbp").alias("candidate_revenue_gbp"), F.lit(0.0).alias("revenue_delta_gbp"),
    )


def shadow_summary(replay: DataFrame) -> DataFrame:
    sums = replay.groupBy("product").agg(
        F.count("*").alias("days"), F.sum("current_dau").cast("double").alias("current_dau_total"), F.sum("candidate_dau").cast("double").alias("candidate_dau_total"),
        F.max(F.abs("dau_relative_delta")).alias("max_daily_abs_dau_delta_pct"), F.max(F.abs("paid_delta")).cast("double").alias("max_abs_paid_delta"), F.max(F.abs("revenue_delta_gbp")).alias("max_abs_revenue_delta_gbp"),
    )
    return sums.withColumn("portfolio_weighted_dau_delta_pct", F.try_divide("candidate_dau_total", "current_dau_total") - 1.0)


def decide_migration(kind: str, compatible: bool, largest_delta: float, eligibility_changed: bool, tolerance: float = TOLERANCE) -> dict:
    """APPROVE only if producers, metric and forecast gates all pass."""
    gates = {"producer_compatible_gate": compatible, "metric_invariance_gate": largest_delta <= tolerance, "forecast_eligibility_gate": not eligibility_changed}
    ok = all(gates.values())
    return {"classification": kind, **gates, "approved": ok, "action": "APPROVE" if ok else "WITHHOLD", "reason": "; ".join(k for k, v in gates.items() if not v) or "all gates pass"}


@dataclass(frozen=True)
class Node:
    node_id: str
    kind: str
    dependencies: tuple[str, ...]
    fingerprint: str
    baseline_action: str


def surfaces(contract: Mapping) -> dict[str, str]:
    """Fingerprints of what evidence depends on: the producers' shape and each metric's meaning.

    Optional dimensions are in none of them, so adding one makes nothing stale.
    """
    rules = contract.get("rules", {})
    parts = {
        "contract:producer_shape": {k: sorted(contract[k]) if isinstance(contract.get(k), list) else contract.get(k) for k in ("grain", "required_columns", "generated_processing_time_column", "legacy_processing_time_fallback")},
        "semantic:dau": {"activity_event": contract.get("activity_event"), "rule": rules.get("active_use")},
        "semantic:revenue_gbp": {"rule": rules.get("revenue_gbp"), "scope": rules.get("revenue_scope")},
        "semantic:paid_subscription": {"event_types": sorted(contract.get("allowed_event_types", ()))},
    }
    return {k: canonical_sha256(v) for k, v in parts.items()}


def evidence_graph(contract: Mapping, forecasts: Mapping[str, Mapping], experiment: Mapping, impact: Mapping) -> tuple[Node, ...]:
    """The 16 nodes from contract surfaces to decisions; ``forecasts``: row by product."""
    if len(forecasts) != 3:
        raise ContractError("three products' forecasts are needed")
    roots = surfaces(contract)
    nodes = [Node(k, "contract_surface" if k.startswith("contract") else "metric_semantics", (), v, "CERTIFIED") for k, v in roots.items()]
    for m in METRICS:
        needs = ("contract:producer_shape", f"semantic:{m}")
        nodes.append(Node(f"metric:{m}", "certified_metric", needs, canonical_sha256([m, *(roots[n] for n in needs)]), "CERTIFIED"))
    for product in sorted(forecasts):
        row, ok = forecasts[product], bool(forecasts[product]["approved"])
        nodes.append(Node(f"forecast:{product}:dau", "forecast_evidence", ("metric:dau",), canonical_sha256(row), "APPROVE" if ok else "WITHHOLD"))
        nodes.append(Node(f"planning:{product}:dau", "planning_decision", (f"forecast:{product}:dau",), canonical_sha256([product, ok]), "PLAN" if ok else "WITHHOLD"))
    allowed = bool(impact.get("decision_authorised_rollout"))
    nodes += [
        Node("experiment:pricing", "experiment_decision", ("metric:revenue_gbp", "metric:paid_subscription"), canonical_sha256(experiment), str(experiment["action"]).upper()),
        Node("impact:pricing", "impact_plan", ("experiment:pricing",), canonical_sha256(impact), str(impact["planning_status"]).upper()),
        Node("authorisation:pricing", "authorisation_decision", ("experiment:pricing", "impact:pricing"), canonical_sha256([allowed, impact.get("authorised_treated_users")]), "AUTHORISE" if allowed else "WITHHOLD"),
    ]
    ordered(nodes)
    return tuple(nodes)


def ordered(nodes: Iterable[Node]) -> list[Node]:
    """Dependencies first; repeated or unknown ids and cycles are refused."""
    nodes = list(nodes)
    left = {n.node_id: n for n in nodes}
    if len(left) != len(nodes):
        raise ContractError("a node id repeats")
    if unknown := {d for n in nodes for d in n.dependencies} - set(left):
        raise ContractError(f"unknown dependencies {sorted(unknown)}")
    out: list[Node] = []
    while left:
        ready = [n for n in left.values() if not any(d in left for d in n.dependencies)]
        if not ready:
            raise ContractError("the evidence graph has a cycle")
        for n in ready:
            out.append(left.pop(n.node_id))
    return out


def propagate(nodes: Iterable[Node], candidates: Mapping[str, str]) -> dict[str, dict]:
    """Status of every node once some fingerprints change; a direct change outranks an inherited one."""
    nodes = ordered(nodes)
    if unknown := set(candidates) - {n.node_id for n in nodes}:
        raise ContractError(f"unknown nodes {sorted(unknown)}")
    found: dict[str, dict] = {}
    for n in nodes:
        direct = candidates.get(n.node_id, n.fingerprint) != n.fingerprint
        stale = tuple(d for d in n.dependencies if found[d]["status"] != FRESH)
        status = DIRECT if direct else DOWNSTREAM if stale else FRESH
        found[n.node_id] = {"status": status, "stale_dependencies": stale, "effective_action": n.baseline_action if status == FRESH else "STALE"}
    return found


def propagate_sql(spark: SparkSession, nodes: Iterable[Node], cases: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """(proposal, node_id, status): the same as reachability over an edge table, for graphs of any size and all cases at once."""
    nodes = ordered(nodes)
    rows = [(name, n.node_id, found.get(n.node_id, n.fingerprint) != n.fingerprint) for name, found in cases.items() for n in nodes]
    edges = spark.createDataFrame([(d, n.node_id) for n in nodes for d in n.dependencies], "parent string, child string")
    return spark.sql(REACHABLE, nodes=spark.createDataFrame(rows, "proposal string, node_id string, changed boolean"), edges=edges)


REACHABLE = """
WITH RECURSIVE stale(proposal, node_id) AS (
    SELECT proposal, node_id FROM {nodes} WHERE changed
    UNION ALL
    SELECT s.proposal, e.child FROM stale s JOIN {edges} e ON e.parent = s.node_id
), hit AS (SELECT DISTINCT proposal, node_id FROM stale)
SELECT n.proposal, n.node_id, CASE WHEN n.changed THEN 'DIRECT_STALE' WHEN h.node_id IS NOT NULL THEN 'DOWNSTREAM_STALE' ELSE 'FRESH' END AS status
FROM {nodes} n LEFT JOIN hit h ON h.proposal = n.proposal AND h.node_id = n.node_id
"""


@dataclass(frozen=True)
class Revalidation:
    status: str
    steps: tuple[tuple[str, str], ...] = ()
    reused: tuple[str, ...] = ()
    blocked_reason: str | None = None
    rebuild: tuple[str, ...] = field(default=())


def plan_revalidation(nodes: Iterable[Node], found: Mapping[str, dict], kind: str, action: str, adopted: bool = False) -> Revalidation:
    """The least governed rebuild; a silent change of meaning stays blocked until it is adopted."""
    stale = [n.node_id for n in ordered(nodes) if found[n.node_id]["status"] != FRESH]
    reused = tuple(sorted(set(found) - set(stale)))
    if not stale:
        return Revalidation("NOOP", reused=reused)
    if kind == "BREAKING":
        return Revalidation("BLOCKED_PRODUCER_INCOMPATIBLE", reused=reused, blocked_reason="producers must change or be adapted first")
    if kind == "SEMANTIC" and action != "APPROVE" and not adopted:
        return Revalidation("BLOCKED_EXPLICIT_ADOPTION_REQUIRED", reused=reused, blocked_reason="the new meaning must be adopted explicitly")
    steps = tuple((n, "ADOPT_GOVERNED_ROOT" if found[n]["status"] == DIRECT else "REBUILD_EVIDENCE") for n in stale)
    return Revalidation("READY", steps, reused, None, tuple(stale))


def apply_revalidation(nodes: Iterable[Node], plan: Revalidation, fingerprints: Mapping[str, str], actions: Mapping[str, str] = {}) -> tuple[Node, ...]:
    """A new graph, only if every stale node and no other is replaced."""
    if plan.status == "NOOP" and not fingerprints and not actions:
        return tuple(nodes)
    if plan.status != "READY" or set(fingerprints) != set(plan.rebuild) or set(actions) - set(plan.rebuild):
        raise ContractError("the replacements do not match a ready plan")
    return tuple(replace(n, fingerprint=fingerprints[n.node_id], baseline_action=actions.get(n.node_id, n.baseline_action)) if n.node_id in fingerprints else n for n in nodes)


def verify_fresh(nodes: Iterable[Node], roots: Mapping[str, str]) -> None:
    stale = [k for k, v in propagate(nodes, roots).items() if v["status"] != FRESH]
    if stale:
        raise ContractError(f"still stale: {sorted(stale)}")


def complete(plan: Revalidation) -> Revalidation:
    if plan.status != "READY":
        raise ContractError("only a ready plan can be completed")
    return replace(plan, status="REVALIDATED")


def registry() -> dict:
    """The current contract, and each proposal with its classification."""
    current = event_contract()
    found = {}
    for name, proposal in sorted(proposals().items()):
        kind, compatible, reasons = classify(current, proposal)
        found[name] = {"contract": proposal, "classification": kind, "producer_compatible": compatible, "reasons": list(reasons)}
    return {"current": current, "proposals": found}


def serialise(nodes: Iterable[Node]) -> list[dict]:
    """The graph as plain data, nodes in their order."""
    return [{**asdict(n), "dependencies": list(n.dependencies)} for n in nodes]


def dau_series(gold: DataFrame, silver: DataFrame, definitions: Mapping[str, str]) -> DataFrame:
    """Mature daily use by product under several definitions: series ``<product>:dau|<definition>``."""
    history = mature_history(gold, silver)
    values = F.array(*[F.struct(F.lit(name).alias("definition"), F.col(column).cast("double").alias("value")) for name, column in definitions.items()])
    rows = history.select("product", "date", F.inline(values))
    return rows.select(F.concat("product", F.lit(":dau|"), "definition").alias("series"), "date", "value")


def evaluated_definitions(gold: DataFrame, silver: DataFrame, definitions: Mapping[str, str], origins: int = ORIGINS) -> DataFrame:
    """Forecast evaluations of daily use, one row a product and definition, all series in one plan."""
    found = evaluate_plan(rolling_origin(dau_series(gold, silver, definitions), origins))
    return found.select(F.split_part("series", F.lit(":"), F.lit(1)).alias("product"), F.split_part("series", F.lit("|"), F.lit(2)).alias("definition"), *[c for c in found.columns if c != "series"])


def forecast_impact(gold: DataFrame, silver: DataFrame, origins: int = ORIGINS) -> DataFrame:
    """What any-event activity would do to each product's forecast, and whether its eligibility changes."""
    found = evaluated_definitions(gold, silver, {"current": "dau", "candidate": "dau_legacy_any_event"}, origins)
    of = lambda name, c: F.max(F.when(F.col("definition") == name, F.col(c))).alias(f"{name}_{c}")
    wide = found.groupBy("product").agg(*[of(name, c) for c in ("wape", "benchmark_wape", "interval_coverage", "approved") for name in ("current", "candidate")])
    cutoff = mature_history(gold, silver).groupBy("product").agg(F.max("date").alias("observation_cutoff"))
    return wide.join(cutoff, "product").withColumn("eligibility_changed", F.col("current_approved") != F.col("candidate_approved"))


def candidate_forecasts(gold: DataFrame, silver: DataFrame, origins: int = ORIGINS) -> DataFrame:
    """Forecast evaluations under the adopted meaning of daily use."""
    return evaluated_definitions(gold, silver, {"adopted": "dau_legacy_any_event"}, origins).drop("definition")


def replacements(nodes: Iterable[Node], roots: Mapping[str, str], forecasts: Iterable[Mapping]) -> tuple[dict[str, str], dict[str, str]]:
    """(fingerprints, actions) of what an adopted meaning of daily use rebuilds; ``forecasts``: a row a product."""
    old = {n.node_id: n for n in nodes}
    needs = ("contract:producer_shape", "semantic:dau")
    prints = {"semantic:dau": roots["semantic:dau"], "metric:dau": canonical_sha256(["dau", *(roots[n] for n in needs)])}
    actions = {k: old[k].baseline_action for k in prints}
    for row in forecasts:
        product, ok = row["product"], bool(row["approved"])
        prints[f"forecast:{product}:dau"], actions[f"forecast:{product}:dau"] = canonical_sha256(dict(row)), "APPROVE" if ok else "WITHHOLD"
        prints[f"planning:{product}:dau"], actions[f"planning:{product}:dau"] = canonical_sha256([product, ok]), "PLAN" if ok else "WITHHOLD"
    return prints, actions
