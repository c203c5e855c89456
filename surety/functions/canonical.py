"""Canonical JSON and file hashes."""

from __future__ import annotations

import hashlib
import json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_sha256(value) -> str:
    """SHA-256 of sorted, compact UTF-8 JSON; NaN is refused, dates are ISO text."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=lambda x: x.isoformat() if hasattr(x, "isoformat") else x.item())
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_sha256(value) -> str:
    """SHA-256 of sorted, compact JSON with escapes: the form of responses and digests."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def frame_sha256(df: DataFrame) -> str:
    """Logical hash of a table: whatever files, partitions or order held its rows.

    Each row's SHA-256, as JSON with sorted columns, goes into sums of its eight parts, which
    are combined where the rows are; only the sums and the count reach the driver.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substr("h", F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *[F.sum(part(k)).alias(f"s{k}") for k in range(8)]).first()
    return canonical_sha256([",".join(sorted(df.columns)), sums["n"], *[str(sums[f"s{k}"] or 0) for k in range(8)]])


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below ``path``, read in pieces on the executors."""
    from surety.sources.files import file_digests, list_files

    return file_digests(spark, list_files(path))


def manifest_failures(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """``missing``, ``size`` or ``sha256`` for each listed file that differs, the first that applies."""
    seen = observed.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    failure = F.when(F.col("_bytes").isNull(), F.lit("missing")).when(F.col("_bytes") != F.col("bytes"), F.lit("size")).when(F.col("_sha256") != F.col("sha256"), F.lit("sha256"))
    return manifest.join(seen, "path", "left").select("path", failure.alias("failure")).where("failure IS NOT NULL")
