"""Misrouted events: injection, verified correction, selective recomputation, supersession."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.operators.forecast import HORIZON, ORIGINS, mature_history
from surety.operators.metrics import daily_metrics
from surety.schemas import ContractError, require_columns


def incident_window(gold: DataFrame, silver: DataFrame, product: str, origin: int = 2, origins: int = ORIGINS) -> DataFrame:
    """One row (start, end): the horizon of the ``origin``-th of the last ``origins`` forecasts of a product's mature history."""
    days = mature_history(gold, silver).where(F.col("product") == product).groupBy().agg(F.array_sort(F.collect_list("date")).alias("days"))  # one a day
    first = F.size("days") - (origins - origin + 1) * HORIZON
    whole = days.select(F.get("days", first).alias("start"), F.get("days", first + HORIZON - 1).alias("end"))
    return whole.where(F.date_diff("end", "start") == HORIZON - 1)


def inject_routing_error(silver: DataFrame, source: str, target: str, event_type: str, window: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with the error, ledger of what it touched); the rows stay schema-valid.

    ``window`` has one row (start, end); without a row, or ending before it starts, it touches nothing.
    """
    if source == target:
        raise ContractError("needs two products")
    at = F.broadcast(window.groupBy().agg(F.first("start").alias("_start"), F.first("end").alias("_end")))  # one row always
    events = silver.crossJoin(at)
    hit = F.coalesce((F.col("product") == source) & (F.col("event_type") == event_type) & F.to_date("event_ts").between(F.col("_start"), F.col("_end")), F.lit(False))
    ledger = events.where(hit).select("event_id", "event_ts", F.to_date("event_ts").alias("event_date"), "event_type", F.lit(source).alias("original_product"), F.lit(target).alias("incident_product"))
    return events.withColumn("product", F.when(hit, target).otherwise(F.col("product"))).select(*silver.columns), ledger


def verify_ledger(events: DataFrame, ledger: DataFrame) -> None:
    """Refuse repeated ids on either side, unknown ones, and rows that no longer are what the ledger says: one grouping by id."""
    fields = ["event_id", "product", "event_type", "date"]
    one = events.select("event_id", "product", "event_type", F.to_date("event_ts").alias("date"), F.lit(1).alias("e"), F.lit(0).alias("l"))
    two = ledger.select("event_id", F.col("incident_product").alias("product"), "event_type", F.col("event_date").alias("date"), F.lit(0).alias("e"), F.lit(1).alias("l"))
    sides = one.unionByName(two).groupBy("event_id").agg(F.sum("e").alias("e"), F.sum("l").alias("l"), *[f(c).alias(f"{n}_{c}") for c in fields[1:] for n, f in (("a", F.min), ("b", F.max))], *[F.count(c).alias(f"n_{c}") for c in fields[1:]])
    differs = [~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) | (F.col(f"n_{c}") != 2) for c in fields[1:]]
    wrong = (F.col("e") > 1) | (F.col("l") > 1) | ((F.col("l") == 1) & ((F.col("e") == 0) | differs[0] | differs[1] | differs[2]))
    if sides.where(wrong).limit(1).count():
        raise ContractError("the ledger does not match the events, or an id repeats")


def correct_routing(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Restore products by event_id; a ledger that no longer matches the events is refused."""
    require_columns(ledger, ("event_id", "event_type", "event_date", "original_product", "incident_product"), "ledger")
    verify_ledger(events, ledger)
    fixed = events.join(ledger.select("event_id", F.col("original_product").alias("_product")), "event_id", "left")
    return fixed.withColumn("product", F.coalesce("_product", "product")).select(*events.columns)


def affected_cells(ledger: DataFrame) -> DataFrame:
    """Every (product, date) that lost or gained an event."""
    return ledger.select(F.explode(F.array("original_product", "incident_product")).alias("product"), F.col("event_date").alias("date")).distinct()


def selective_gold(incident_gold: DataFrame, corrected: DataFrame, cells: DataFrame) -> DataFrame:
    """Gold with only the affected cells recomputed, from the events of those cells alone."""
    touched = corrected.withColumn("_day", F.to_date("event_ts")).join(cells.select("product", F.col("date").alias("_day")), ["product", "_day"], "left_semi").drop("_day")
    return incident_gold.join(cells, ["product", "date"], "left_anti").select(*incident_gold.columns).unionByName(daily_metrics(touched))


def changed_cells(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("product", "date")) -> DataFrame:
    """Keys whose rows differ, nulls compared as values."""
    values = [c for c in before.columns if c not in keys]
    pair = before.select(*keys, F.struct(*values).alias("_a")).join(after.select(*keys, F.struct(*values).alias("_b")), list(keys), "full_outer")
    return pair.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def supersession_ledger(incident: DataFrame, corrected: DataFrame, key: str = "series") -> DataFrame:
    """Published decisions, superseded where the evidence behind them changed at all.

    Two rows for a changed decision (the old one and its successor), one otherwise.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        others = sorted(c for c in df.columns if c != key)
        row = F.to_json(F.struct(*others), {"ignoreNullFields": "false"})
        return df.select(F.col(key).alias("metric"), F.when(F.col("approved"), "PLAN").otherwise("WITHHOLD").alias(f"{name}_action"), F.sha2(row, 256).alias(f"{name}_sha"))

    both = side(incident, "old").join(side(corrected, "new"), "metric")
    changed, moved = F.col("old_sha") != F.col("new_sha"), F.col("old_action") != F.col("new_action")
    old_id, new_id = F.concat("metric", F.lit("|incident")), F.concat("metric", F.lit("|corrected"))
    none, why = F.lit(""), F.lit("SOURCE_DATA_CORRECTION")
    first = F.struct(old_id.alias("decision_id"), F.lit("incident_published").alias("evidence_state"), F.col("old_action").alias("action"), F.when(changed, "SUPERSEDED").otherwise("ACTIVE_UNCHANGED").alias("status"), F.when(changed, new_id).otherwise(none).alias("superseded_by"), none.alias("supersedes"), F.when(changed, why).otherwise(none).alias("supersession_reason"))
    second = F.struct(new_id.alias("decision_id"), F.lit("corrected_replay").alias("evidence_state"), F.col("new_action").alias("action"), F.lit("ACTIVE").alias("status"), none.alias("superseded_by"), old_id.alias("supersedes"), why.alias("supersession_reason"))
    rows = both.select("metric", changed.alias("evidence_changed"), (changed & moved).alias("action_changed"), F.explode(F.when(changed, F.array(first, second)).otherwise(F.array(first))).alias("d"))
    return rows.select("d.*", "metric", "evidence_changed", "action_changed")


def assert_frozen(current: DataFrame, frozen: DataFrame, keys: tuple[str, ...] = ("product", "date"), tolerance: float = 1e-12) -> None:
    """Same keys, same nulls, and numbers within ``tolerance``: what a round trip through text may change, and no more."""
    if set(current.columns) != set(frozen.columns):
        raise ContractError("the frozen table has other columns")
    values = [c for c in current.columns if c not in keys]
    one, two = (df.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in values]).alias(name)) for df, name in ((current, "_a"), (frozen, "_b")))
    differs = [F.col(f"_a.{c}").isNull() != F.col(f"_b.{c}").isNull() for c in values] + [F.coalesce(F.abs(F.col(f"_a.{c}") - F.col(f"_b.{c}")) > tolerance, F.lit(False)) for c in values]
    wrong = F.col("_a").isNull() | F.col("_b").isNull()
    for d in differs:
        wrong = wrong | d
    if one.join(two, list(keys), "full_outer").where(wrong).limit(1).count() or current.count() != frozen.count():
        raise ContractError("the frozen table differs")
