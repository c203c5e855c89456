"""Bronze to Gold with persisted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from surety.operators import metrics, quality

#: The tables that a run writes, in this order.
TABLES = ("bronze_events", "silver_events", "rejected_events", "gold_daily_metrics", "revenue_reconciliation", "quality_report")


def run_pipeline(events: DataFrame, folder: str, sequence: str | None = None, prefix: str | None = None) -> dict[str, DataFrame]:
    """Certify, aggregate and reconcile ``events``; each table is written below ``folder`` once and read back.

    Later tables start from the files of earlier ones.  With ``prefix`` they are also
    created, or replaced, in the session's catalog under ``<prefix><table>``.
    """
    spark = events.sparkSession
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder}/{name}"
        if prefix is None:
            df.write.mode("overwrite").parquet(path)
        else:
            df.write.mode("overwrite").option("path", path).saveAsTable(f"{prefix}{name}")
        out[name] = spark.read.schema(df.schema).parquet(path)
        return out[name]

    bronze = keep("bronze_events", events)
    judged = quality.judged_events(bronze, sequence)
    silver = keep("silver_events", quality.certified(judged))
    keep("rejected_events", quality.rejected(judged))
    keep("gold_daily_metrics", metrics.daily_metrics(silver))
    keep("revenue_reconciliation", quality.reconcile_revenue(bronze, silver))
    keep("quality_report", quality.quality_report(judged))
    return out


def register(frames: dict[str, DataFrame], prefix: str = "") -> None:
    """Make frames known to SQL under their names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
