"""Controlled event streams and experiments, drawn on the executors.

Every draw is a hash of the seed, the name of its stream and the row's own identity, so
a stream can be added or a range regenerated without moving any other draw, and any
partitioning gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the controlled products: users a day, share that tries, share of those that pays, price,
# and the return curve's peak, floor and decay in days.
PRODUCT_SCHEMA = "name string, daily_users double, trial_share double, paid_share double, price_gbp double, peak double, floor double, decay_days double"
PRODUCT_ROWS = (
    ("photo_editor", 92.0, 0.37, 0.49, 9.99, 0.32, 0.06, 16.0),
    ("notes_app", 78.0, 0.33, 0.52, 7.99, 0.38, 0.09, 28.0),
    ("file_transfer", 84.0, 0.29, 0.46, 11.99, 0.27, 0.04, 12.0),
)
# The seed, the days of acquisition, the days on which a user may return.
SEED, DAYS, RETURN_DAYS = 2206, 120, 30
# Shares of platforms, sources and arrival delays in hours.
PLATFORMS = (("ios", 0.43), ("android", 0.39), ("web", 0.18))
CHANNELS = (("organic", 0.46), ("paid_search", 0.25), ("social", 0.19), ("referral", 0.10))
DELAYS = ((0, 0.55), (1, 0.20), (2, 0.10), (6, 0.08), (24, 0.045), (36, 0.020), (96, 0.005))
# Fixed values of the faults: copies of purchases, and rows (not of use) that lose their identity.
COPIED, NAMELESS = 0.10, 0.002
START = "2026-01-01 00:00:00"


def product_parameters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRODUCT_ROWS), PRODUCT_SCHEMA)


def uniform(seed: int, stream: str, *identity: Column | str) -> Column:
    """A number in (0, 1) that belongs to a stream and an identity."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), *identity), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def _choice(u: Column, shares) -> Column:
    out, upto = None, 0.0
    for value, share in shares:
        upto += share
        out = F.when(u < upto, value) if out is None else out.when(u < upto, value)
    return out.otherwise(shares[-1][0])


def _whole(u: Column, low: int, high: int) -> Column:
    """An integer from ``low`` to ``high`` - 1."""
    return (F.floor(u * (high - low)) + low).cast("long")


def acquired_users(spark: SparkSession, days: int, seed: int, products: DataFrame) -> DataFrame:
    """One row a user: a day's number of them is Poisson, counted from exponential gaps."""
    slot = F.explode(F.sequence(F.lit(1), F.ceil(F.col("daily_users") + 10 * F.sqrt("daily_users") + 10).cast("int")))
    cells = products.crossJoin(spark.range(days).withColumnRenamed("id", "day"))  # products x days
    gaps = lambda upto: F.aggregate(F.sequence(F.lit(1), upto), F.lit(0.0), lambda a, k: a - F.log(uniform(seed, "gap", "name", "day", k)) / F.col("daily_users"))
    users = cells.withColumn("slot", slot).where(gaps(F.col("slot")) <= 1)
    who = ["name", "day", "slot"]
    return users.withColumns({
        "user_id": F.concat(F.lit("u"), F.substr(F.md5(F.concat_ws("|", *who)), F.lit(1), F.lit(12))),
        "platform": _choice(uniform(seed, "platform", *who), PLATFORMS), "source": _choice(uniform(seed, "source", *who), CHANNELS),
        "opened": F.col("day") * 1440 + _whole(uniform(seed, "minute", *who), 0, 1440),
    })


def generate_events(spark: SparkSession, days: int = DAYS, seed: int = SEED, faults: bool = True, products: DataFrame | None = None) -> DataFrame:
    """Bronze events: both clocks, four funnel steps and daily use; with faults, copied purchases and lost identities."""
    users = acquired_users(spark, days, seed, products if products is not None else product_parameters(spark))
    who = ["name", "day", "slot"]
    event = lambda kind, minute, revenue=F.lit(0.0): F.struct(F.lit(kind).alias("event_type"), minute.cast("long").alias("minute"), revenue.alias("revenue_gbp"))
    comes_back = lambda lag: uniform(seed, "return", *who, lag) < F.col("floor") + F.col("peak") * F.exp(-lag / F.col("decay_days"))
    returns = F.transform(F.filter(F.sequence(F.lit(1), F.lit(RETURN_DAYS)), comes_back), lambda lag: event("app_open", (F.col("day") + lag) * 1440 + _whole(uniform(seed, "return minute", *who, lag), 0, 1440)))
    tried = F.col("opened") + 60 * _whole(uniform(seed, "trial hour", *who), 1, 36)
    paid = tried + 1440 * _whole(uniform(seed, "paid day", *who), 1, 8)
    tries = uniform(seed, "trial", *who) < F.col("trial_share")
    pays = tries & (uniform(seed, "paid", *who) < F.col("paid_share"))
    none = F.array().cast("array<struct<event_type:string,minute:bigint,revenue_gbp:double>>")
    steps = F.concat(
        F.array(event("first_open", F.col("opened")), event("app_open", F.col("opened") + 1)), returns, F.when(tries, F.array(event("trial_start", tried))).otherwise(none),
        F.when(pays, F.array(event("paid_subscription", paid), event("purchase", paid + 1, F.col("price_gbp")))).otherwise(none),
    )
    rows = users.select("user_id", F.col("name").alias("product"), "platform", "source", F.posexplode(steps).alias("step", "e")).select("*", "e.*")
    rows = rows.withColumn("event_id", F.concat(F.lit("e"), F.substr("user_id", F.lit(2)), F.lpad(F.col("step").cast("string"), 3, "0")))
    rows = rows.withColumn("event_ts", F.expr(f"timestamp_ntz '{START}' + make_dt_interval(0, 0, minute)"))
    delay = 60 * _choice(uniform(seed, "delay", "event_id"), DELAYS) + _whole(uniform(seed, "delay minute", "event_id"), 0, 60)
    rows = rows.withColumn("ingested_at", F.col("event_ts") + F.make_dt_interval(F.lit(0), F.lit(0), delay.cast("int")))
    columns = ["event_id", "user_id", "product", "event_type", "event_ts", "ingested_at", "platform", "source", "revenue_gbp"]
    if faults:
        copies = F.when((F.col("event_type") == "purchase") & (uniform(seed, "copy", "event_id") < COPIED), 2).otherwise(1)
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
        lost = (F.col("event_type") != "app_open") & (uniform(seed, "identity", "event_id", "copy") < NAMELESS)
        rows = rows.withColumn("user_id", F.when(~lost, F.col("user_id")))
    return rows.select(*columns)


def generate_experiment(spark: SparkSession, per_arm: int = 4_000, seed: int = SEED) -> DataFrame:
    """Two arms of equal size with revenue before and after, and a paid outcome slightly lower in the treated arm."""
    if per_arm < 2:
        raise ValueError("an arm needs two users")
    rows = spark.range(2 * per_arm)
    normal = F.sqrt(-2 * F.log(uniform(seed, "radius", "id"))) * F.cos(2 * math.pi * uniform(seed, "angle", "id"))
    gamma = -3.0 * (F.log(uniform(seed, "g1", "id")) + F.log(uniform(seed, "g2", "id")) + 0.2 * F.log(uniform(seed, "g3", "id")))  # about a shape of 2.2 and a scale of 3
    rows = rows.withColumn("treatment", F.pmod(F.row_number().over(_by_hash(seed)), F.lit(2)).cast("int")).withColumn("pre_revenue_gbp_30d", gamma)
    paid = uniform(seed, "outcome", "id") < F.when(F.col("treatment") == 1, 0.192).otherwise(0.20)
    revenue = F.greatest(F.lit(0.0), 1.5 + 0.75 * F.col("pre_revenue_gbp_30d") + 0.75 * F.col("treatment") + 3.2 * normal)
    return rows.select(F.concat(F.lit("pricing_"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("experiment_user_id"), "treatment", "pre_revenue_gbp_30d", revenue.alias("revenue_gbp_30d"), paid.cast("int").alias("paid_subscription_30d"))


def _by_hash(seed: int):
    from pyspark.sql import Window

    return Window.orderBy(F.xxhash64(F.lit(seed), F.lit("arm"), "id"), "id")  # a table of the experiment's size, which the caller chose
