"""Retail lines: source profile, daily metrics on a gap-free calendar, semantic comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surety.schemas import ContractError

METRICS = ("revenue_gbp", "orders", "units", "purchase_lines", "active_customers")
#: Fixed value: the largest relative change of a drop-in replacement.
TOLERANCE = 0.01


def source_profile(lines: DataFrame) -> DataFrame:
    """One row of counts; exact duplicates are counted by two hashes of whole rows (128 bits), nulls as values."""
    content = [c for c in lines.columns if c != "source_row_id"]
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in content]  # a hash passes over nulls
    copies = lines.groupBy(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit("b"), *marked).alias("b")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("exact_duplicate_rows_excluding_source_id"))
    profile = lines.agg(
        F.count("*").alias("source_rows"), F.min("invoice_ts").cast("string").alias("date_min"), F.max("invoice_ts").cast("string").alias("date_max"),
        F.countDistinct("invoice_no").alias("distinct_invoices"), F.countDistinct("stock_code").alias("distinct_stock_codes"), F.countDistinct("country").alias("distinct_countries"), F.countDistinct("source_sheet").alias("source_sheets"),
        F.count_if(F.col("customer_id").isNull()).alias("missing_customer_rows"), F.count_if(F.col("invoice_ts").isNull()).alias("missing_invoice_timestamp_rows"), F.count_if("is_cancellation").alias("cancellation_rows"),
        F.count_if(F.col("quantity") <= 0).alias("nonpositive_quantity_rows"), F.count_if(F.col("unit_price_gbp") <= 0).alias("nonpositive_unit_price_rows"),
        F.count_if("is_purchase_line").alias("purchase_line_rows"), F.count_if("is_identified_purchase_line").alias("identified_purchase_line_rows"),
    )
    return profile.crossJoin(copies)


def partition_key():
    return F.coalesce(F.date_format("invoice_ts", "yyyy-MM"), F.lit("_invalid_ts"))


def dated_metrics(lines: DataFrame, *keys: str) -> DataFrame:
    """The five metrics of each timestamped date, from one scan.

    A first grouping by (date, invoice, customer) combines before its shuffle; its groups,
    once as invoices and once as customers, are then counted by a second one.
    """
    bought = F.col("is_purchase_line")
    parts = lines.where("invoice_ts IS NOT NULL").groupBy(*keys, F.to_date("invoice_ts").alias("date"), "invoice_no", "customer_id").agg(
        F.sum(F.when(bought, F.col("line_value_gbp")).otherwise(0.0)).alias("revenue"), F.sum(F.when(bought, F.col("quantity")).otherwise(0.0)).alias("units"), F.count_if(bought).alias("lines"),
    )
    side = lambda order, name, *sums: F.struct(F.lit(order).alias("order"), F.col(name).alias("name"), *[x.alias(n) for x, n in zip(sums, ("revenue", "units", "lines"))], (F.col("lines") > 0).alias("some"))
    none = F.lit(0.0)
    sides = parts.select(*keys, "date", F.inline(F.array(side(True, "invoice_no", F.col("revenue"), F.col("units").cast("double"), F.col("lines")), side(False, "customer_id", none, none, F.lit(0).cast("long")))))
    named = sides.groupBy(*keys, "date", "order", "name").agg(F.sum("revenue").alias("revenue"), F.sum("units").alias("units"), F.sum("lines").alias("lines"), F.max("some").alias("some"))
    counted = F.col("some") & F.col("name").isNotNull()
    return named.groupBy(*keys, "date").agg(
        F.round(F.sum("revenue"), 6).alias("revenue_gbp"), F.count_if(F.col("order") & counted).alias("orders"), F.sum("units").alias("units"),
        F.sum("lines").alias("purchase_lines"), F.count_if(~F.col("order") & counted).alias("active_customers"),
    )


def on_calendar(daily: DataFrame) -> DataFrame:
    """Every day from the first to the last, zeros where nothing happened.

    Each day brings the empty days up to the next one, so ``daily``, one row a date, is read once.
    """
    rows = daily.where("date IS NOT NULL").withColumn("_next", F.lead("date").over(Window.orderBy("date")))
    rows = rows.withColumn("_day", F.explode(F.sequence("date", F.coalesce(F.date_sub("_next", 1), "date"), F.expr("interval 1 day"))))
    return rows.select(F.col("_day").alias("date"), *[F.coalesce(F.when(F.col("_day") == F.col("date"), F.col(m)), F.lit(0).cast(daily.schema[m].dataType)).alias(m) for m in METRICS])


def daily_metrics(lines: DataFrame) -> DataFrame:
    """Calendar from the first to the last purchase date."""
    return on_calendar(dated_metrics(lines.where("is_purchase_line")))


def reaggregate(partitions: DataFrame) -> DataFrame:
    """Partition aggregates to portfolio days; summing counts is sound as a date lies in one month."""
    sums = partitions.groupBy("date").agg(*[F.sum(m).alias(m) for m in METRICS])
    return on_calendar(sums.select("date", F.round("revenue_gbp", 6).alias("revenue_gbp"), F.col("orders").cast("long"), F.col("units").cast("double"), F.col("purchase_lines").cast("long"), F.col("active_customers").cast("long")))


def semantic_comparison(lines: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Two definitions side by side, each with and without the purchase rules."""
    timed = F.col("invoice_ts").isNotNull()
    signed = timed & F.col("quantity").isNotNull() & F.col("unit_price_gbp").isNotNull()
    sums = lines.agg(
        F.sum(F.when(F.col("is_purchase_line"), F.col("line_value_gbp"))).alias("r0"), F.sum(F.when(signed, F.col("line_value_gbp"))).alias("r1"),
        F.countDistinct(F.when(F.col("is_identified_purchase_line"), F.col("customer_id"))).cast("double").alias("c0"), F.countDistinct(F.when(timed, F.col("customer_id"))).cast("double").alias("c1"),
    )
    two = sums.select(F.expr("stack(2, 'revenue_gbp', r0, r1, 'active_customer_population', c0, c1) AS (metric, current_value, candidate_value)"))
    out = two.withColumn("relative_delta", F.try_divide(F.col("candidate_value") - F.col("current_value"), F.abs("current_value"))).withColumn("tolerance", F.lit(float(tolerance)))
    out = out.withColumn("backward_compatible", F.coalesce(F.abs("relative_delta") <= tolerance, F.lit(False)))
    return out.withColumn("replacement_action", F.when(F.col("backward_compatible"), "APPROVE_BACKWARD_COMPATIBLE").otherwise("WITHHOLD_AS_DROP_IN_REPLACEMENT"))


def assert_parity(a: DataFrame, b: DataFrame) -> None:
    """Exact equality as multisets of rows."""
    b = b.select(*a.columns)
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ContractError("the results differ")
