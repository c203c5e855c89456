"""Month partitions with durable state: no-op, resume, repair, and queries checked before they read."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.functions.canonical import ascii_sha256
from surety.operators import retail
from surety.schemas import ContractError
from surety.sources.files import folder_hashes, read_json, write_json

#: Fixed values of the serving contract.
STATE_VERSION, LONGEST_QUERY_DAYS, WORKERS = "1", 366, 8
#: Months that one job of a run materialises and commits.
COMMIT_MONTHS = 12
INTEGER_METRICS = ("orders", "purchase_lines", "active_customers")
SCHEMA_FAMILY, DEFAULT_SCHEMA, LATEST_SCHEMA = "retail-metrics-response", "1.0", "1.1"


class Interrupted(RuntimeError):
    """A run stopped on purpose after some partitions."""


class ReportingError(ContractError):
    """A request or store that breaks the serving contract."""


@dataclass(frozen=True)
class RunStats:
    processed_partitions: int
    skipped_partitions: int
    rows_scanned: int
    source_hashes_computed: int


def _part(root: str, month: str) -> str:
    return f"{root}/month={month}"


def write_canonical(lines: DataFrame, root: str) -> dict[str, dict]:
    """Month partitions of canonical lines and their manifest (rows and byte hash by month).

    One shuffle that is rebalanced by size: a month with a third of all lines is several
    files.  The rows are counted from the files written, which their footers tell.
    """
    keyed = lines.withColumn("month", retail.partition_key())
    keyed.hint("rebalance", "month").sortWithinPartitions("month", "source_row_id").write.mode("overwrite").option("compression", "zstd").partitionBy("month").parquet(root)
    written = lines.sparkSession.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(root)
    rows = {str(r["month"]): r["count"] for r in written.groupBy(F.col("month").cast("string").alias("month")).count().collect()}  # one row a month
    hashes = folder_hashes(lines.sparkSession, [_part(root, m) for m in rows])
    manifest = {m: {"rows": n, "sha256": hashes[_part(root, m)]} for m, n in sorted(rows.items())}
    write_json(f"{root}-manifest.json", manifest)
    return manifest


def verify_manifest(spark: SparkSession, root: str, manifest: dict[str, dict]) -> None:
    """The expensive audit: every partition's bytes, read on the executors."""
    found = folder_hashes(spark, [_part(root, m) for m in manifest])
    for month, entry in manifest.items():
        if found[_part(root, month)] != entry["sha256"]:
            raise ContractError(f"partition {month} differs from the manifest")


def _state(uri: str) -> dict:
    state = read_json(uri, {"version": STATE_VERSION, "partitions": {}})
    if state.get("version") != STATE_VERSION:
        raise ContractError(f"state version {state.get('version')!r} is not supported")
    return state


def run_incremental(spark: SparkSession, root: str, manifest: dict[str, dict], metrics: str, state_uri: str, stop_after: int | None = None, audit: bool = False) -> RunStats:
    """Aggregate only months that are missing, revised at the source, or damaged.

    Stale months are done COMMIT_MONTHS at a time, one Spark job for each group, and the
    state is committed once its files are in place: a crash loses a group at most.
    """
    state = _state(state_uri)
    done = state["partitions"]
    if audit:
        verify_manifest(spark, root, manifest)

    def reusable(month: str) -> bool:
        was, entry = done.get(month), manifest[month]
        bound = bool(was) and was["status"] == "complete" and was["source_sha256"] == entry["sha256"] and was["source_rows"] == entry["rows"]
        return bound and was["metric_sha256"] is not None and was["metric_sha256"] == held[_part(metrics, month)]

    held = folder_hashes(spark, [_part(metrics, m) for m in manifest if m in done])
    stale = [m for m in sorted(manifest) if not reusable(m)]
    todo = stale if stop_after is None else stale[:stop_after]
    for first in range(0, len(todo), COMMIT_MONTHS):
        group = todo[first : first + COMMIT_MONTHS]
        lines = spark.read.option("basePath", root).parquet(*[_part(root, m) for m in group]).withColumn("month", F.col("month").cast("string"))
        daily = retail.dated_metrics(lines, "month")
        daily.repartition("month").sortWithinPartitions("month", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("month").parquet(metrics)
        made = folder_hashes(spark, [_part(metrics, m) for m in group])
        for m in group:
            done[m] = {"status": "complete", "source_rows": manifest[m]["rows"], "source_sha256": manifest[m]["sha256"], "metric_sha256": made[_part(metrics, m)]}
        write_json(state_uri, state)
    if stop_after is not None and len(todo) >= stop_after:
        raise Interrupted(f"stopped after {len(todo)} partitions")
    return RunStats(len(todo), len(manifest) - len(todo), sum(manifest[m]["rows"] for m in todo), len(manifest) if audit else 0)


def materialised_daily(spark: SparkSession, metrics: str) -> DataFrame:
    return retail.reaggregate(spark.read.parquet(metrics))


@dataclass(frozen=True)
class ResponseSchema:
    version: str
    sections: dict[str, dict[str, str]]


# Fixed values of the response schemas.
_BASE = {
    "top_level": {"schema_version": "string", "data_product_version": "string", "dataset": "string", "query": "object", "availability": "object", "partition_provenance": "array", "row_count": "integer", "response_sha256": "sha256", "data": "array"},
    "query": {"start_date": "date", "end_date": "date", "metrics": "array[string]"},
    "availability": {"start_date": "date", "end_date": "date", "no_ingestion_time_claim": "boolean"},
    "partition_provenance": {"partition_key": "string", "source_sha256": "sha256", "metric_sha256": "sha256"},
    "row": {"date": "date"},
    "metric": {"revenue_gbp": "float", "orders": "integer", "units": "float", "purchase_lines": "integer", "active_customers": "integer"},
}
_CONTRACT = {"schema_family": "string", "requested_schema_version": "string", "backward_compatible_via_negotiation": "array[string]", "metric_catalog_sha256": "sha256"}
SCHEMAS = {
    "1.0": ResponseSchema("1.0", _BASE),
    "1.1": ResponseSchema("1.1", {**_BASE, "top_level": {**_BASE["top_level"], "contract": "object"}, "contract": _CONTRACT}),
}


def response_schema(version: str) -> ResponseSchema:
    if version not in SCHEMAS:
        raise ReportingError(f"schema {version!r} is not one of {sorted(SCHEMAS)}")
    return SCHEMAS[version]


def classify_schema(base: ResponseSchema, candidate: ResponseSchema) -> tuple[str, list[str], list[str]]:
    """(BREAKING, ADDITIVE or IDENTICAL; what was added; what breaks)."""
    fields = lambda s: {f"{k}.{n}": t for k, part in s.sections.items() for n, t in part.items()}
    old, new = fields(base), fields(candidate)
    added = sorted(new.keys() - old.keys())
    broken = sorted([f"{k}:removed" for k in old.keys() - new.keys()] + [f"{k}:type:{old[k]}->{new[k]}" for k in old.keys() & new.keys() if old[k] != new[k]])
    return "BREAKING" if broken else "ADDITIVE" if added else "IDENTICAL", added, broken


def with_field(schema: ResponseSchema, section: str, name: str, version: str, new_name: str | None = None, new_type: str | None = None) -> ResponseSchema:
    """A candidate schema with one field renamed or retyped."""
    if name not in schema.sections[section]:
        raise ContractError(f"{section} has no field {name!r}")
    changed = {new_name or n if n == name else n: new_type or t if n == name else t for n, t in schema.sections[section].items()}
    return replace(schema, version=version, sections={**schema.sections, section: changed})


def schema_migrations() -> list[dict]:
    """Three proposals for the response; only additions are approved."""
    base = SCHEMAS["1.0"]
    found = []
    for name, candidate in (
        ("add_contract_metadata", SCHEMAS["1.1"]),
        ("rename_row_count_to_rows", with_field(base, "top_level", "row_count", "2.0-candidate", new_name="rows")),
        ("change_orders_integer_to_float", with_field(base, "metric", "orders", "2.0-candidate-orders-float", new_type="float")),
    ):
        kind, added, broken = classify_schema(base, candidate)
        found.append({"proposal": name, "classification": kind, "action": "APPROVE" if kind == "ADDITIVE" else "WITHHOLD", "additions": added, "breaking_changes": broken})
    return found


def metric_catalog() -> list[dict[str, str]]:
    units = {"revenue_gbp": "GBP", "orders": "orders", "units": "units", "purchase_lines": "lines", "active_customers": "customers"}
    return [{"name": m, "dtype": "integer" if m in INTEGER_METRICS else "float", "unit": units[m]} for m in retail.METRICS]


def check_response(response: dict, version: str, metrics: tuple[str, ...]) -> None:
    """Exact fields of every part of a response."""
    sections = response_schema(version).sections

    def exact(part: dict, names: Iterable[str], where: str) -> None:
        if set(part) != set(names):
            raise ReportingError(f"{where} has fields {sorted(part)}, not {sorted(names)}")

    exact(response, sections["top_level"], "response")
    for key in ("query", "availability", "contract"):
        if key in sections:
            exact(response[key], sections[key], key)
    for row in response["partition_provenance"]:
        exact(row, sections["partition_provenance"], "partition_provenance")
    for row in response["data"]:
        exact(row, ("date", *metrics), "data")
    if response["schema_version"] != version:
        raise ReportingError("the response names another schema version")


def schema_dict(schema: ResponseSchema) -> dict:
    """A response schema as plain data, fields as [name, type] pairs."""
    return {"version": schema.version, **{part: [list(x) for x in fields.items()] for part, fields in schema.sections.items()}}


def schema_registry() -> dict:
    return {"schema_family": SCHEMA_FAMILY, "default_schema_version": DEFAULT_SCHEMA, "latest_schema_version": LATEST_SCHEMA, "supported_schema_versions": list(SCHEMAS), "schemas": [schema_dict(s) for s in SCHEMAS.values()]}


def reporting_contract() -> dict:
    """What the store promises to those who query it."""
    return {
        "version": STATE_VERSION, "default_schema_version": DEFAULT_SCHEMA, "latest_schema_version": LATEST_SCHEMA, "supported_schema_versions": list(SCHEMAS),
        "grain": "one row a calendar date", "partition_key": "calendar month of the event date", "max_query_days": LONGEST_QUERY_DAYS, "metric_allowlist": list(retail.METRICS),
        "missing_day_policy": "a day without purchases is a row of zeros", "integrity_rule": "the bytes of the selected partitions and their bindings to source and state are verified before they are read",
        "partition_pruning_rule": "only months that the window touches are read", "execution_isolation_rule": "each request has a Spark session of its own", "point_in_time_claim": False,
    }


def state_frame(spark: SparkSession, state_uri: str) -> DataFrame:
    """The durable state, one row a partition."""
    rows = [(m, x["status"], x["source_rows"], x["source_sha256"], x["metric_sha256"]) for m, x in sorted(_state(state_uri)["partitions"].items())]
    return spark.createDataFrame(rows, "partition_key string, status string, source_rows long, source_sha256 string, metric_sha256 string")


def output_hashes(spark: SparkSession, metrics: str, months: Iterable[str]) -> dict[str, str | None]:
    return {m: h for m, h in zip(months, folder_hashes(spark, [_part(metrics, m) for m in months]).values())}


def corrupt_partition(metrics: str, month: str) -> str:
    """Append a byte to one of a partition's files, for tests of repair; returns the file."""
    from surety.sources.files import file_system, list_files

    found = list_files(_part(metrics, month), "part-")
    if not found:
        raise ContractError(f"partition {month} has no files")
    system, path = file_system(found[0])
    with system.open_input_stream(path) as f:
        data = f.read()
    with system.open_output_stream(path) as f:
        f.write(data + b"\0")
    return found[0]


@dataclass(frozen=True)
class MetricQuery:
    start_date: date
    end_date: date
    metrics: tuple[str, ...]


@dataclass(frozen=True)
class QueryWork:
    partitions_selected: int
    partition_keys: tuple[str, ...]
    metric_files_hashed: int
    rows_returned: int


def months_between(start: date, end: date) -> tuple[str, ...]:
    return tuple(f"{n // 12:04d}-{n % 12 + 1:02d}" for n in range(start.year * 12 + start.month - 1, end.year * 12 + end.month))


class MetricStore:
    """Bounded queries over month partitions; bytes are verified before Spark reads them."""

    def __init__(self, spark: SparkSession, metrics: str, state_uri: str, manifest: dict[str, dict]):
        self.spark, self.metrics, self.manifest = spark, metrics, manifest
        self.state = _state(state_uri)["partitions"]
        if not manifest or set(manifest) != set(self.state):
            raise ReportingError("manifest and state name different partitions")
        months = sorted(manifest)
        ends = sorted({months[0], months[-1]})
        self._provenance(ends)
        low, high = self._read(ends).agg(F.min("date"), F.max("date")).first()
        if low is None:
            raise ReportingError("the store has no dates")
        self.available = low, high

    def __enter__(self) -> MetricStore:
        return self

    def __exit__(self, *_) -> None:
        """Nothing is held open."""

    def _read(self, months: Iterable[str], spark: SparkSession | None = None) -> DataFrame:
        return (spark or self.spark).read.parquet(*[_part(self.metrics, m) for m in months])

    def _provenance(self, months: Iterable[str]) -> list[dict[str, str]]:
        """Bindings of the months, whose bytes are hashed before Spark reads them."""
        out, held = [], folder_hashes(self.spark, [_part(self.metrics, m) for m in months])
        for month in months:
            was, entry, found = self.state[month], self.manifest[month], held[_part(self.metrics, month)]
            if was["status"] != "complete" or was["source_sha256"] != entry["sha256"] or was["source_rows"] != entry["rows"]:
                raise ReportingError(f"partition {month} is not bound to its source")
            if found is None or found != was["metric_sha256"]:
                raise ReportingError(f"partition {month} does not have its recorded bytes")
            out.append({"partition_key": month, "source_sha256": entry["sha256"], "metric_sha256": found})
        return out

    def _check(self, q: MetricQuery) -> None:
        low, high = self.available
        for wrong, why in (
            (q.start_date > q.end_date, "the window ends before it starts"),
            ((q.end_date - q.start_date).days >= LONGEST_QUERY_DAYS, f"the window is longer than {LONGEST_QUERY_DAYS} days"),
            (q.start_date < low or q.end_date > high, f"the window leaves {low}..{high}"),
            (not q.metrics, "no metric is asked for"),
            (len(set(q.metrics)) != len(q.metrics), "a metric repeats"),
            (set(q.metrics) - set(retail.METRICS), "a metric is unknown"),
        ):
            if wrong:
                raise ReportingError(why)

    def frame(self, q: MetricQuery, spark: SparkSession | None = None) -> DataFrame:
        """The window's days with zeros where nothing happened; only its months are read."""
        spark = spark or self.spark
        months = months_between(q.start_date, q.end_date)
        if gone := [m for m in months if m not in self.state]:
            raise ReportingError(f"no partitions {gone}")
        values = self._read(months, spark).where(F.col("date").between(F.lit(q.start_date), F.lit(q.end_date))).select("date", *q.metrics)
        days = spark.range(1).select(F.explode(F.sequence(F.lit(q.start_date), F.lit(q.end_date), F.expr("interval 1 day"))).alias("date"))
        return days.join(values, "date", "left").select("date", *[F.coalesce(m, F.lit(0)).alias(m) for m in q.metrics])

    def query(self, q: MetricQuery, schema_version: str = DEFAULT_SCHEMA, spark: SparkSession | None = None) -> tuple[dict, QueryWork]:
        response_schema(schema_version)
        self._check(q)
        months = months_between(q.start_date, q.end_date)
        if gone := [m for m in months if m not in self.state]:
            raise ReportingError(f"no partitions {gone}")
        provenance = self._provenance(months)
        rows = self.frame(q, spark).orderBy("date").collect()  # LONGEST_QUERY_DAYS rows at most
        data = [{"date": r["date"].isoformat(), **{m: int(r[m]) if m in INTEGER_METRICS else float(r[m]) for m in q.metrics}} for r in rows]
        asked = {"start_date": q.start_date.isoformat(), "end_date": q.end_date.isoformat(), "metrics": list(q.metrics)}
        response = {
            "schema_version": schema_version, "data_product_version": STATE_VERSION, "dataset": "retail", "query": asked,
            "availability": {"start_date": self.available[0].isoformat(), "end_date": self.available[1].isoformat(), "no_ingestion_time_claim": True},
            "partition_provenance": provenance, "row_count": len(data), "response_sha256": ascii_sha256({"query": asked, "data": data}), "data": data,
        }
        if schema_version == LATEST_SCHEMA:
            response["contract"] = {"schema_family": SCHEMA_FAMILY, "requested_schema_version": schema_version, "backward_compatible_via_negotiation": [DEFAULT_SCHEMA], "metric_catalog_sha256": ascii_sha256(metric_catalog())}
        check_response(response, schema_version, q.metrics)
        return response, QueryWork(len(months), months, len(months), len(data))


@dataclass(frozen=True)
class Request:
    request_id: str
    consumer_id: str
    query: MetricQuery
    schema_version: str = DEFAULT_SCHEMA
    expected_success: bool = True


def reference_workload(low: date, high: date) -> list[Request]:
    """Twelve requests over a store's dates: five consumers' windows and one week that six more ask for."""
    span = (high - low).days

    def window(first: float, days: int) -> tuple[date, date]:
        start = low + timedelta(days=int(span * first))
        return start, min(high, start + timedelta(days=days - 1))

    month, quarter, winter, year = window(0.5, 31), window(0.6, 90), window(0.48, 62), window(0.05, 365)
    early, hot = window(0.0, 31), MetricQuery(*window(0.5, 7), retail.METRICS)
    asked = [
        Request("finance-month-v1-0", "finance", MetricQuery(*month, ("revenue_gbp", "orders")), "1.0"), Request("finance-month-v1-1", "finance-next", MetricQuery(*month, ("revenue_gbp", "orders")), "1.1"),
        Request("growth-quarter", "growth", MetricQuery(*quarter, ("orders", "active_customers"))), Request("operations-winter", "operations", MetricQuery(*winter, ("units", "purchase_lines"))),
        Request("planning-year", "planning", MetricQuery(*year, retail.METRICS), "1.1"), Request("early-history", "analyst", MetricQuery(*early, ("revenue_gbp", "orders"))),
    ]
    return asked + [Request(f"hot-week-{i}", f"hot-consumer-{i}", hot, "1.1") for i in range(1, 7)]


def failure_workload(low: date) -> list[Request]:
    """Three requests that a contract refuses: an unknown metric, an unknown schema, a repeated metric."""
    two = (low, low + timedelta(days=1))
    return [Request("bad-metric", "faulty-metric", MetricQuery(*two, ("profit",)), expected_success=False), Request("bad-schema", "faulty-schema", MetricQuery(*two, ("orders",)), "2.0", False), Request("bad-repeat", "faulty-repeat", MetricQuery(*two, ("orders", "orders")), expected_success=False)]


def request_dict(request: Request) -> dict:
    return {**asdict(request), "query": {"start_date": request.query.start_date.isoformat(), "end_date": request.query.end_date.isoformat(), "metrics": list(request.query.metrics)}}


def execute(store: MetricStore, request: Request) -> dict:
    """One request in a session of its own; only contract errors are caught."""
    base = {"request_id": request.request_id, "consumer_id": request.consumer_id, "schema_version": request.schema_version}
    try:
        response, work = store.query(request.query, request.schema_version, store.spark.newSession())
    except ReportingError as e:
        return {**base, "status": "ERROR", "error_type": type(e).__name__}
    return {**base, "status": "SUCCESS", "response_sha256": response["response_sha256"], "response_payload_sha256": ascii_sha256(response), **asdict(work)}


def execute_serial(store: MetricStore, requests: Iterable[Request]) -> list[dict]:
    return [execute(store, r) for r in requests]


def execute_concurrent(store: MetricStore, requests: Iterable[Request], workers: int = WORKERS) -> list[dict]:
    """The same results in the same order from ``workers`` threads."""
    if workers < 1:
        raise ContractError("at least one worker is needed")
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda r: execute(store, r), requests))


def workload_digest(results: Iterable[dict]) -> str:
    """Independent of the order of requests."""
    return ascii_sha256(sorted(results, key=lambda r: r["request_id"]))
