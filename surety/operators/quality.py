"""Certification of events with explicit reject reasons, reconciliation and backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surety.schemas import EVENT_TYPES, PRODUCTS, ContractError, require_columns

REQUIRED = ("event_id", "user_id", "product", "event_type", "event_ts", "revenue_gbp")


def _timestamp(name: str) -> Column:
    return F.try_to_timestamp(F.col(name).cast("string")).cast("timestamp_ntz")


def _checks(explicit_ingestion: bool) -> list[tuple[str, str, Column]]:
    """(reason, counter, condition) in the order in which reasons are written."""
    revenue, late = F.col("_revenue"), F.lit(explicit_ingestion)
    known = lambda name, allowed: F.coalesce(F.col(name).isin(*allowed), F.lit(False))
    return [
        ("duplicate_event_id", "duplicate_event_rows", F.col("_again")),
        ("missing_identity", "missing_identity_rows", F.trim(F.coalesce("user_id", F.lit(""))) == ""),
        ("invalid_timestamp", "invalid_timestamp_rows", F.col("_event_ts").isNull()),
        ("invalid_ingestion_timestamp", "invalid_ingestion_timestamp_rows", late & F.col("_ingested_at").isNull()),
        ("ingestion_before_event", "ingestion_before_event_rows", late & F.coalesce(F.col("_ingested_at") < F.col("_event_ts"), F.lit(False))),
        ("invalid_revenue", "invalid_revenue_rows", revenue.isNull() | F.isnan(revenue) | (revenue < 0)),
        ("unknown_product", "unknown_product_rows", ~known("product", PRODUCTS)),
        ("unknown_event_type", "unknown_event_type_rows", ~known("event_type", EVENT_TYPES)),
        ("non_purchase_revenue", "non_purchase_revenue_rows", ~F.coalesce(F.col("event_type") == "purchase", F.lit(False)) & (F.coalesce(F.nanvl(revenue, F.lit(0.0)), F.lit(0.0)) != 0)),
    ]


def judged_events(events: DataFrame, sequence: str | None = None) -> DataFrame:
    """Every row with its reasons (``reject_reason``, empty if it passes) and parsed values.

    Of rows with one event_id the first by ``sequence``, a column of distinct values,
    stands; the others are duplicates even where the first is itself rejected.  The least
    value of each id is combined before it moves and meets only repeated ids, so a hot or
    null id is no task of its own.  Without ``sequence`` the order is the parsed time.
    """
    require_columns(events, REQUIRED, "events")
    explicit = "ingested_at" in events.columns
    if not explicit:
        events = events.withColumn("ingested_at", F.col("event_ts"))
    parsed = events.withColumns({"_event_ts": _timestamp("event_ts"), "_ingested_at": _timestamp("ingested_at"), "_revenue": F.expr("try_cast(revenue_gbp AS double)")})
    if sequence:
        firsts = events.groupBy(F.col("event_id").alias("_id")).agg(F.min(sequence).alias("_first"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
        parsed = parsed.join(firsts, F.col("event_id").eqNullSafe(F.col("_id")), "left").withColumn("_again", F.coalesce(F.col(sequence) > F.col("_first"), F.lit(False)))
    else:
        order = Window.partitionBy("event_id").orderBy(F.col("_event_ts").asc_nulls_last(), "event_id")
        parsed = parsed.withColumn("_again", F.row_number().over(order) > 1)
    checks = _checks(explicit)
    parsed = parsed.withColumns({f"_{counter}": condition for _, counter, condition in checks})
    return parsed.withColumn("reject_reason", F.concat_ws(";", *[F.when(F.col(f"_{counter}"), reason) for reason, counter, _ in checks]))


def certified(judged: DataFrame) -> DataFrame:
    """Silver: the rows without a reason, with typed columns."""
    keep = [c for c in judged.columns if not c.startswith("_") and c != "reject_reason"]
    typed = {"event_ts": F.col("_event_ts"), "ingested_at": F.col("_ingested_at"), "revenue_gbp": F.col("_revenue")}
    return judged.where("reject_reason = ''").select(*[typed[c].alias(c) if c in typed else F.col(c) for c in keep])


def rejected(judged: DataFrame) -> DataFrame:
    """The rows with a reason, as they came, beside their parsed values."""
    keep = [c for c in judged.columns if not c.startswith("_")]
    return judged.where("reject_reason <> ''").select(*keep, F.col("_event_ts").alias("event_ts_parsed"), F.col("_ingested_at").alias("ingested_at_parsed"), F.col("_revenue").alias("revenue_gbp_parsed"))


def quality_report(judged: DataFrame) -> DataFrame:
    """One row of counters; a row counts under each of its reasons, but once as rejected."""
    counters = [counter for _, counter, _ in _checks(True)]
    return judged.agg(
        F.count("*").alias("rows_raw"),
        *[F.count_if(F.col(f"_{c}")).alias(c) for c in counters],
        F.count_if(F.col("reject_reason") != "").alias("rows_rejected"),
        F.count_if(F.col("reject_reason") == "").alias("rows_certified"),
    )


def certify_with_rejects(events: DataFrame, sequence: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(certified, report, rejected)."""
    judged = judged_events(events, sequence)
    return certified(judged), quality_report(judged), rejected(judged)


def certify(events: DataFrame, sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(certified, report)."""
    return certify_with_rejects(events, sequence)[:2]


def reconcile_revenue(raw: DataFrame, silver: DataFrame) -> DataFrame:
    """Raw against certified purchase revenue by product; ``overstatement_pct`` is in percent."""
    value = F.coalesce(F.nanvl(F.expr("try_cast(revenue_gbp AS double)"), F.lit(0.0)), F.lit(0.0))

    def side(df: DataFrame, name: str) -> DataFrame:
        bought = df.where("event_type = 'purchase' AND product IS NOT NULL")
        return bought.select("product", *[(value if c == name else F.lit(0.0)).alias(c) for c in ("raw", "certified")])

    total = side(raw, "raw").unionByName(side(silver, "certified")).groupBy("product").agg(F.sum("raw").alias("raw_revenue_gbp"), F.sum("certified").alias("certified_revenue_gbp"))
    over = F.col("raw_revenue_gbp") - F.col("certified_revenue_gbp")
    return total.select("*", over.alias("overstatement_gbp"), F.try_divide(100.0 * over, F.col("certified_revenue_gbp")).alias("overstatement_pct"))


def backfill(current: DataFrame, corrections: DataFrame, key: str = "event_id") -> DataFrame:
    """Replace rows by key and add new keys; a second application changes nothing."""
    for df in (current, corrections):
        require_columns(df, [key], "backfill")
    return current.join(corrections.select(key), key, "left_anti").select(*current.columns).unionByName(corrections)


def require_unique(df: DataFrame, keys: list[str], label: str) -> None:
    """Refuse repeated keys: one aggregate and at most one row to the driver."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ContractError(f"{label} repeats {keys}")
