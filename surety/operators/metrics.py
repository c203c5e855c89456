"""Gold daily metrics, metric contracts, retention with maturity, and conversion."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.schemas import ContractError, require_columns

HORIZONS = (7, 30)


@dataclass(frozen=True)
class MetricContract:
    name: str
    grain: str
    numerator: str
    denominator: str | None = None


@dataclass(frozen=True)
class RetentionContract:
    name: str
    horizon_days: int
    return_event: str = "app_open"
    cohort_event: str = "first_open"


METRIC_CONTRACTS = (
    MetricContract("conversion_first_open", "product,date", "paid_subscription", "first_open"),
    MetricContract("conversion_trial_start", "product,date", "paid_subscription", "trial_start"),
    MetricContract("dau", "product,date", "distinct users with app_open"),
    MetricContract("revenue_gbp", "product,date", "sum of purchase revenue"),
)
RETENTION_CONTRACTS = tuple(RetentionContract(f"d{n}_activity_retention", n) for n in HORIZONS)


def daily_metrics(silver: DataFrame) -> DataFrame:
    """One row per product and date, by two aggregations and no distinct expansion.

    First one row per (product, date, user) with a flag for each event type, combined
    before its shuffle; then sums over users.  The second grouping needs no row per
    event, so a product or day with a third of all events costs its users only.
    """
    require_columns(silver, ("product", "user_id", "event_type", "event_ts", "revenue_gbp"), "certified events")
    flags = {"dau": "app_open", "first_open": "first_open", "trial_start": "trial_start", "paid_subscription": "paid_subscription"}
    users = silver.groupBy("product", F.to_date("event_ts").alias("date"), "user_id").agg(
        *[F.max(F.when(F.col("event_type") == kind, 1).otherwise(0)).alias(name) for name, kind in flags.items()],
        F.sum(F.when(F.col("event_type") == "purchase", F.col("revenue_gbp")).otherwise(0.0)).alias("revenue_gbp"),
    )
    gold = users.groupBy("product", "date").agg(
        *[F.sum(F.when(F.col("user_id").isNotNull(), F.col(name))).cast("long").alias(name) for name in flags],
        F.count("user_id").alias("dau_legacy_any_event"),
        F.sum("revenue_gbp").alias("revenue_gbp"),
    )
    delta = F.col("dau_legacy_any_event") - F.col("dau")
    return gold.select(
        "product", "date", "dau", "dau_legacy_any_event", delta.alias("dau_definition_delta"), F.try_divide(delta.cast("double"), F.col("dau")).alias("dau_definition_delta_pct"),
        "first_open", "trial_start", "paid_subscription", "revenue_gbp",
        F.try_divide(F.col("paid_subscription").cast("double"), F.col("first_open")).alias("conversion_first_open"),
        F.try_divide(F.col("paid_subscription").cast("double"), F.col("trial_start")).alias("conversion_trial_start"),
    )


def dau_migration(gold: DataFrame) -> DataFrame:
    return gold.select("product", "date", "dau", "dau_legacy_any_event", "dau_definition_delta", "dau_definition_delta_pct")


def dau_migration_summary(gold: DataFrame) -> DataFrame:
    return gold.groupBy("product").agg(
        F.count("*").alias("days"),
        F.avg("dau").alias("mean_dau"),
        F.avg("dau_legacy_any_event").alias("mean_dau_legacy"),
        F.expr("percentile(dau_definition_delta, 0.95D)").alias("p95_delta"),
        F.avg("dau_definition_delta_pct").alias("mean_delta_pct"),
    )


def retention_ledger(silver: DataFrame, horizons: Iterable[int] = HORIZONS, boundary_event: str | None = "first_open") -> DataFrame:
    """Every cohort and horizon, mature or not; immature ones show no returns.

    The boundary is each product's latest ``boundary_event`` date (of any event if None).
    """
    horizons = sorted(set(horizons))
    if not horizons or horizons[0] <= 0:
        raise ContractError("horizons must be positive")
    day = silver.select("product", "user_id", "event_type", F.to_date("event_ts").alias("day"))
    boundary = (day.where(F.col("event_type") == boundary_event) if boundary_event else day).groupBy("product").agg(F.max("day").alias("analysis_as_of"))
    cohort = day.where("event_type = 'first_open'").groupBy("product", "user_id").agg(F.min("day").alias("cohort_date"))
    targets = cohort.withColumn("horizon_days", F.explode(F.array(*map(F.lit, horizons)))).withColumn("target_date", F.date_add("cohort_date", F.col("horizon_days")))
    active = day.where("event_type = 'app_open'").select("product", "user_id", F.col("day").alias("target_date"), F.lit(1).alias("returned")).distinct()
    grid = targets.join(active, ["product", "user_id", "target_date"], "left").join(boundary, "product")
    keys = ["product", "cohort_date", "horizon_days", "target_date", "analysis_as_of"]
    sums = grid.groupBy(*keys).agg(F.count("*").alias("cohort_users"), F.sum(F.coalesce("returned", F.lit(0))).alias("seen"))
    mature = F.col("target_date") <= F.col("analysis_as_of")
    return sums.select(
        *keys, mature.alias("mature"), F.when(mature, "mature").otherwise("immature").alias("maturity_status"), "cohort_users",
        F.when(mature, F.col("cohort_users")).otherwise(0).cast("long").alias("eligible_users"), F.when(mature, 0).otherwise(F.col("cohort_users")).cast("long").alias("excluded_users"),
        F.when(mature, F.col("seen")).alias("retained_users"), F.when(mature, F.col("seen").cast("double") / F.col("cohort_users")).alias("retention_rate"),
        F.when(mature, "").otherwise("target_date_after_analysis_as_of").alias("exclusion_reason"),
    )


def activity_retention(ledger: DataFrame) -> DataFrame:
    return ledger.where("mature").select("product", "cohort_date", "horizon_days", "eligible_users", "retained_users", "retention_rate")


def retention_summary(retention: DataFrame) -> DataFrame:
    sums = retention.groupBy("product", "horizon_days").agg(F.sum("eligible_users").alias("eligible_users"), F.sum("retained_users").alias("retained_users"))
    return sums.withColumn("retention_rate", F.try_divide(F.col("retained_users").cast("double"), F.col("eligible_users")))


def retention_maturity_summary(ledger: DataFrame) -> DataFrame:
    sums = ledger.groupBy("product", "horizon_days", "analysis_as_of").agg(
        F.count("*").alias("cohorts"), F.count_if("mature").alias("mature_cohorts"), F.count_if(~F.col("mature")).alias("immature_cohorts"),
        F.sum("cohort_users").alias("cohort_users"), F.sum("eligible_users").alias("eligible_users"), F.sum("excluded_users").alias("excluded_users"),
    )
    return sums.withColumn("eligible_user_fraction", F.try_divide(F.col("eligible_users").cast("double"), F.col("cohort_users")))


def portfolio_conversion(silver: DataFrame) -> DataFrame:
    """Two ratios of distinct users over the whole portfolio; null without a denominator."""

    def ever(kind: str) -> Column:
        return F.max(F.when(F.col("event_type") == kind, 1).otherwise(0))

    users = silver.where("user_id IS NOT NULL").groupBy("user_id").agg(ever("paid_subscription").alias("paid"), ever("first_open").alias("opened"), ever("trial_start").alias("trial"))
    sums = users.agg(*[F.sum(c).cast("double").alias(c) for c in ("paid", "opened", "trial")])
    return sums.select(F.try_divide("paid", "opened").alias("paid_conversion_from_first_open"), F.try_divide("paid", "trial").alias("paid_conversion_from_trial_start"))
