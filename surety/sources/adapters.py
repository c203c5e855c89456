"""Bronze events, retail lines and experiment users from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PRODUCT = "CASE WHEN event_id % 131 = 0 THEN 'mystery' WHEN user_id % 3 = 0 THEN 'photo_editor' WHEN user_id % 3 = 1 THEN 'notes_app' ELSE 'file_transfer' END"
_TYPE = "CASE WHEN event_id % 137 = 0 THEN 'mystery_event' WHEN event_type = 'signup' THEN 'first_open' WHEN event_type = 'view' THEN 'app_open' WHEN event_type = 'click' THEN 'trial_start' WHEN event_type = 'error' THEN 'paid_subscription' ELSE 'purchase' END"
_REVENUE = "CASE WHEN event_id % 139 = 0 THEN 1.5D WHEN event_type = 'purchase' AND event_id % 89 = 0 THEN -value WHEN event_type = 'purchase' THEN value ELSE 0.0D END"
_DELAY = "CASE WHEN (event_id * 7919) % 1000 < 550 THEN 0 WHEN (event_id * 7919) % 1000 < 750 THEN 1 WHEN (event_id * 7919) % 1000 < 850 THEN 2 WHEN (event_id * 7919) % 1000 < 930 THEN 6 WHEN (event_id * 7919) % 1000 < 975 THEN 24 WHEN (event_id * 7919) % 1000 < 995 THEN 36 ELSE 96 END"


def bronze_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events with exact duplicates, missing identities, unknown names and bad clocks.

    ``ingest_seq`` is the arrival order that a table has no other trace of.
    """
    raw = read(spark, sf_dir, "events")
    copies = raw.withColumn("copy", F.explode(F.when(F.col("event_id") % 40 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return copies.selectExpr(
        "concat('e', lpad(cast(event_id as string), 10, '0')) AS event_id",
        "CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('u', lpad(cast(user_id as string), 8, '0')) END AS user_id",
        f"{_PRODUCT} AS product",
        f"{_TYPE} AS event_type",
        "CASE WHEN event_id % 149 = 0 THEN 'not-a-time' ELSE cast(ts AS string) END AS event_ts",
        f"cast(ts + make_dt_interval(0, CASE WHEN event_id % 211 = 0 THEN -5 ELSE {_DELAY} END) AS string) AS ingested_at",
        f"{_REVENUE} AS revenue_gbp",
        "event_id * 2 + copy AS ingest_seq",
    )


def retail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical retail lines: one row per order line, returns as cancellations."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return canonical_lines(
        lines.selectExpr(
            "l_orderkey * 10 + l_linenumber AS source_row_id",
            "concat(CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END, cast(l_orderkey AS string)) AS invoice_no",
            "cast(l_partkey AS string) AS stock_code",
            "cast(NULL AS string) AS description",
            "l_quantity AS quantity",
            "o_orderdate AS invoice_ts",
            "l_extendedprice / l_quantity AS unit_price_gbp",
            "l_extendedprice AS line_value_gbp",
            "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE cast(o_custkey AS string) END AS customer_id",
            "cast(o_custkey % 25 AS string) AS country",
            "l_linestatus AS source_sheet",
        )
    )


def canonical_lines(lines: DataFrame) -> DataFrame:
    """Add the derived flags of a retail line; the line's value is given or quantity times price."""
    if "line_value_gbp" not in lines.columns:
        lines = lines.withColumn("line_value_gbp", F.col("quantity") * F.col("unit_price_gbp"))
    cancelled = F.upper(F.coalesce("invoice_no", F.lit(""))).startswith("C")
    bought = F.col("invoice_no").isNotNull() & F.col("invoice_ts").isNotNull() & ~cancelled & (F.col("quantity") > 0) & (F.col("unit_price_gbp") > 0)
    lines = lines.withColumn("is_cancellation", cancelled).withColumn("is_purchase_line", F.coalesce(bought, F.lit(False)))
    return lines.withColumn("is_identified_purchase_line", F.col("is_purchase_line") & F.col("customer_id").isNotNull())


def customer_id(raw):
    """Trimmed id without a spreadsheet's ``.0``; the usual words for nothing are null."""
    bare = F.regexp_replace(F.trim(raw.cast("string")), r"\.0$", "")
    return F.when(~bare.isin("", "nan", "NaN", "None", "<NA>"), bare)


def experiment_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms of customers with revenue before and after the experiment's start."""
    spent = (
        read(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.sum(F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), F.col("o_totalprice"))).alias("pre"),
            F.sum(F.when(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), F.col("o_totalprice"))).alias("post"),
            F.max(F.when(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"), 1).otherwise(0)).alias("paid"),
        )
    )
    users = read(spark, sf_dir, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return users.selectExpr(
        "concat('x', lpad(cast(c_custkey AS string), 6, '0')) AS experiment_user_id",
        "cast(c_custkey % 2 AS int) AS treatment",
        "coalesce(pre, 0.0D) AS pre_revenue_gbp_30d",
        "coalesce(post, 0.0D) AS revenue_gbp_30d",
        "coalesce(paid, 0) AS paid_subscription_30d",
    )
