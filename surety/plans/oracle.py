"""DuckDB SQL for the queries; each statement is assembled from the steps it shares."""

from __future__ import annotations

from surety.operators import store

_STEPS: dict[str, str] = {
    "bronze": """SELECT 'e' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS event_id,
        CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') END AS user_id,
        CASE WHEN event_id % 131 = 0 THEN 'mystery' WHEN user_id % 3 = 0 THEN 'photo_editor' WHEN user_id % 3 = 1 THEN 'notes_app' ELSE 'file_transfer' END AS product,
        CASE WHEN event_id % 137 = 0 THEN 'mystery_event' WHEN event_type = 'signup' THEN 'first_open' WHEN event_type = 'view' THEN 'app_open' WHEN event_type = 'click' THEN 'trial_start' WHEN event_type = 'error' THEN 'paid_subscription' ELSE 'purchase' END AS event_type,
        CASE WHEN event_id % 149 = 0 THEN NULL ELSE ts END AS event_ts,
        ts + to_hours(CASE WHEN event_id % 211 = 0 THEN -5 WHEN (event_id * 7919) % 1000 < 550 THEN 0 WHEN (event_id * 7919) % 1000 < 750 THEN 1 WHEN (event_id * 7919) % 1000 < 850 THEN 2 WHEN (event_id * 7919) % 1000 < 930 THEN 6 WHEN (event_id * 7919) % 1000 < 975 THEN 24 WHEN (event_id * 7919) % 1000 < 995 THEN 36 ELSE 96 END) AS ingested_at,
        CASE WHEN event_id % 139 = 0 THEN 1.5 WHEN event_type = 'purchase' AND event_id % 89 = 0 THEN -value WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS revenue_gbp,
        event_id * 2 + copy AS ingest_seq
        FROM events, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR event_id % 40 = 0""",
    "judged": """SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingest_seq) > 1 AS c1, user_id IS NULL AS c2, event_ts IS NULL AS c3, ingested_at IS NULL AS c4, coalesce(ingested_at < event_ts, FALSE) AS c5,
        revenue_gbp < 0 AS c6, product = 'mystery' AS c7, event_type = 'mystery_event' AS c8, event_type <> 'purchase' AND revenue_gbp <> 0 AS c9 FROM bronze""",
    "silver": "SELECT event_id, user_id, product, event_type, event_ts, ingested_at, revenue_gbp FROM judged WHERE NOT (c1 OR c2 OR c3 OR c4 OR c5 OR c6 OR c7 OR c8 OR c9)",
    "daily": """SELECT product, CAST(event_ts AS DATE) AS date, count(DISTINCT CASE WHEN event_type = 'app_open' THEN user_id END) AS dau, count(DISTINCT user_id) AS legacy,
        count(DISTINCT CASE WHEN event_type = 'first_open' THEN user_id END) AS first_open, count(DISTINCT CASE WHEN event_type = 'trial_start' THEN user_id END) AS trial_start, count(DISTINCT CASE WHEN event_type = 'paid_subscription' THEN user_id END) AS paid_subscription,
        sum(CASE WHEN event_type = 'purchase' THEN revenue_gbp ELSE 0 END) AS revenue_gbp FROM silver GROUP BY ALL""",
    "gold": """SELECT product, date, dau, legacy AS dau_legacy_any_event, legacy - dau AS dau_definition_delta, round((legacy - dau) / nullif(CAST(dau AS DOUBLE), 0), 6) AS dau_definition_delta_pct, first_open, trial_start, paid_subscription, round(revenue_gbp, 6) AS revenue_gbp,
        round(paid_subscription / nullif(CAST(first_open AS DOUBLE), 0), 6) AS conversion_first_open, round(paid_subscription / nullif(CAST(trial_start AS DOUBLE), 0), 6) AS conversion_trial_start FROM daily""",
    "ledger": """SELECT a.product, cohort_date, h AS horizon_days, cohort_date + h AS target_date, as_of AS analysis_as_of, cohort_date + h <= as_of AS mature, count(*) AS cohort_users, count(r.user_id) AS seen
        FROM (SELECT product, user_id, min(CAST(event_ts AS DATE)) AS cohort_date FROM silver WHERE event_type = 'first_open' GROUP BY ALL) a CROSS JOIN (VALUES (7), (30)) t(h)
        JOIN (SELECT product, max(CAST(event_ts AS DATE)) AS as_of FROM silver WHERE event_type = 'first_open' GROUP BY ALL) b USING (product)
        LEFT JOIN (SELECT DISTINCT product, user_id, CAST(event_ts AS DATE) AS day FROM silver WHERE event_type = 'app_open') r ON r.product = a.product AND r.user_id = a.user_id AND r.day = cohort_date + h GROUP BY ALL""",
    "late": "SELECT *, (epoch_us(ingested_at) - epoch_us(event_ts)) / 3600000000.0 AS delay FROM silver",
    "windows": "SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-16 23:59:59.999999'), (2, TIMESTAMP '2024-01-23 23:59:59.999999'), (3, TIMESTAMP '2024-01-30 23:59:59.999999')) w(window_index, as_of)",
    "tries": "SELECT window_index, as_of, CAST(h AS DOUBLE) AS h, CAST(as_of - to_hours(h) AS DATE) AS final FROM windows, (VALUES (24), (48), (72), (96)) c(h)",
    "settled": "SELECT product, date, unnest(['dau', 'paid_subscription', 'revenue_gbp']) AS metric, unnest([CAST(dau AS DOUBLE), CAST(paid_subscription AS DOUBLE), revenue_gbp]) AS v FROM daily",
    "seen_daily": """SELECT window_index, product, CAST(event_ts AS DATE) AS date, count(DISTINCT CASE WHEN event_type = 'app_open' THEN user_id END) AS dau, count(DISTINCT CASE WHEN event_type = 'paid_subscription' THEN user_id END) AS paid_subscription, sum(CASE WHEN event_type = 'purchase' THEN revenue_gbp ELSE 0 END) AS revenue_gbp
        FROM silver JOIN windows ON ingested_at <= as_of GROUP BY ALL""",
    "seen": "SELECT window_index, product, date, unnest(['dau', 'paid_subscription', 'revenue_gbp']) AS metric, unnest([CAST(dau AS DOUBLE), CAST(paid_subscription AS DOUBLE), revenue_gbp]) AS v FROM seen_daily",
    "cells": "SELECT w.window_index, w.as_of, s.product, s.date, s.metric, coalesce(n.v, 0) AS snapshot_value, s.v AS settled_value, s.v - coalesce(n.v, 0) AS revision FROM settled s CROSS JOIN windows w LEFT JOIN seen n ON n.window_index = w.window_index AND n.product = s.product AND n.date = s.date AND n.metric = s.metric",
    "counted": """SELECT window_index, h, count(*) FILTER (WHERE CAST(event_ts AS DATE) <= final) AS finalizable_events, count(*) FILTER (WHERE CAST(event_ts AS DATE) <= final AND delay > h) AS late_beyond_watermark_events, count(*) FILTER (WHERE delay > h) AS whole_stream_late_beyond_watermark_events,
        count(*) FILTER (WHERE CAST(event_ts AS DATE) <= final AND ingested_at > as_of) AS late_missing_from_finalized_snapshot FROM late CROSS JOIN tries GROUP BY ALL""",
    "risks": """SELECT t.window_index, t.h, count(DISTINCT date) AS finalized_calendar_dates, count(*) AS finalized_metric_cells, count(*) FILTER (WHERE abs(revision) > 1e-12) AS revised_metric_cells, max(abs(revision)) FILTER (WHERE metric = 'dau') AS max_abs_dau_revision,
        max(abs(revision)) FILTER (WHERE metric = 'paid_subscription') AS max_abs_paid_subscription_revision, max(abs(revision)) FILTER (WHERE metric = 'revenue_gbp') AS max_abs_revenue_revision_gbp FROM cells c JOIN tries t ON t.window_index = c.window_index AND c.date <= t.final GROUP BY ALL""",
    "grid0": """SELECT *, late_beyond_watermark_events / CAST(finalizable_events AS DOUBLE) AS late_event_fraction, revised_metric_cells / CAST(finalized_metric_cells AS DOUBLE) AS revised_metric_cell_fraction FROM counted JOIN risks USING (window_index, h)""",
    "grid": """SELECT *, late_event_fraction <= 0.005 AND revised_metric_cell_fraction <= 0.01 AND max_abs_revenue_revision_gbp <= 10 AND max_abs_paid_subscription_revision <= 1 AS feasible,
        coalesce(h = min(CASE WHEN late_event_fraction <= 0.005 AND revised_metric_cell_fraction <= 0.01 AND max_abs_revenue_revision_gbp <= 10 AND max_abs_paid_subscription_revision <= 1 THEN h END) OVER (PARTITION BY window_index), FALSE) AS selected_in_window FROM grid0""",
    "stability": """SELECT h AS allowed_lateness_hours, count(DISTINCT window_index) AS windows, count_if(feasible) AS feasible_windows, count_if(selected_in_window) AS selected_windows, avg(late_event_fraction) AS a1, max(late_event_fraction) AS a2, avg(revised_metric_cell_fraction) AS a3, max(revised_metric_cell_fraction) AS a4, max(max_abs_revenue_revision_gbp) AS a5, max(max_abs_paid_subscription_revision) AS a6 FROM grid GROUP BY ALL""",
    "lines": """SELECT l_orderkey * 10 + l_linenumber AS source_row_id, CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice_no, CAST(l_partkey AS VARCHAR) AS stock_code, l_quantity AS quantity, o_orderdate AS invoice_ts, l_extendedprice / l_quantity AS unit_price_gbp, l_extendedprice AS line_value_gbp,
        CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS customer_id, CAST(o_custkey % 25 AS VARCHAR) AS country, l_linestatus AS source_sheet, l_returnflag = 'R' AS is_cancellation, l_returnflag <> 'R' AND l_quantity > 0 AND l_extendedprice / l_quantity > 0 AS is_purchase_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "dated": """SELECT CAST(invoice_ts AS DATE) AS date, sum(CASE WHEN is_purchase_line THEN line_value_gbp ELSE 0 END) AS revenue_gbp, count(DISTINCT CASE WHEN is_purchase_line THEN invoice_no END) AS orders, sum(CASE WHEN is_purchase_line THEN quantity ELSE 0 END) AS units, CAST(count_if(is_purchase_line) AS BIGINT) AS purchase_lines,
        count(DISTINCT CASE WHEN is_purchase_line THEN customer_id END) AS active_customers FROM lines GROUP BY ALL""",
    "calendar": """SELECT CAST(d AS DATE) AS date, coalesce(revenue_gbp, 0) AS revenue_gbp, coalesce(orders, 0) AS orders, coalesce(units, 0) AS units, coalesce(purchase_lines, 0) AS purchase_lines, coalesce(active_customers, 0) AS active_customers
        FROM (SELECT unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM dated WHERE purchase_lines > 0) LEFT JOIN dated ON date = CAST(d AS DATE)""",
    "series": "SELECT unnest(['revenue_gbp', 'orders', 'units', 'active_customers']) AS series, date, unnest([CAST(revenue_gbp AS DOUBLE), CAST(orders AS DOUBLE), CAST(units AS DOUBLE), CAST(active_customers AS DOUBLE)]) AS value FROM calendar",
    "points": "SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY series) AS n, lag(value, 7) OVER w AS back, lag(date, 7) OVER w AS back_date FROM series WINDOW w AS (PARTITION BY series ORDER BY date)",
    "radii": """SELECT series, o AS origin_index, r AS interval_radius, m AS calibration_points FROM (SELECT series, o, abs(value - back) AS r, row_number() OVER (PARTITION BY series, o ORDER BY abs(value - back)) AS k, count(*) OVER (PARTITION BY series, o) AS m
        FROM points, range(1, 1 + ORIGINS) t(o) WHERE back IS NOT NULL AND i <= n - (ORIGINS + 1 - o) * 7) WHERE k = least(m, CAST(ceil((m + 1) * 0.9::DOUBLE) AS BIGINT))""",
    "ends": "SELECT series, o AS origin_index, date AS origin_date, value AS benchmark_forecast FROM points, range(1, 1 + ORIGINS) t(o) WHERE i = n - (ORIGINS + 1 - o) * 7",
    "backtest": """SELECT p.series, CAST(r.origin_index AS INT) AS origin_index, origin_date, date AS target_date, back_date AS seasonal_source_date, CAST((i - (n - ORIGINS * 7) - 1) % 7 + 1 AS INT) AS horizon_day, value AS actual, back AS forecast, benchmark_forecast,
        greatest(0.0, back - interval_radius) AS interval_low, back + interval_radius AS interval_high, interval_radius, calibration_points FROM points p JOIN radii r ON r.series = p.series AND r.origin_index = (i - (n - ORIGINS * 7) - 1) // 7 + 1 JOIN ends e ON e.series = p.series AND e.origin_index = r.origin_index WHERE i > n - ORIGINS * 7""",
    "evaluated": """SELECT series, count(DISTINCT origin_index) AS origins, max(horizon_day) AS horizon_days, count(*) AS backtest_points, avg(abs(actual - forecast) / nullif(abs(actual), 0)) AS mape, sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) AS wape, avg(abs(actual - benchmark_forecast) / nullif(abs(actual), 0)) AS benchmark_mape,
        sum(abs(actual - benchmark_forecast)) / nullif(sum(abs(actual)), 0) AS benchmark_wape, avg(CASE WHEN actual BETWEEN interval_low AND interval_high THEN 1.0 ELSE 0.0 END) AS interval_coverage FROM backtest GROUP BY ALL""",
    "users": """SELECT CAST(c_custkey % 2 AS INT) AS treatment, coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate < DATE '1998-01-01'), 0) AS pre, coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate >= DATE '1998-01-01'), 0) AS post, CAST(count_if(o_orderdate >= DATE '2001-01-01') > 0 AS INT) AS paid
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "designs": """SELECT 0.1::DOUBLE + 0.1::DOUBLE * (s_suppkey % 8) AS treatment_share, CAST(1000 + 37 * s_suppkey AS INT) AS balanced_equivalent_information, CAST(30 + s_suppkey % 400 AS DOUBLE) AS readout_days, 1000.0::DOUBLE + s_suppkey % 1200 AS es95_gbp_per_1000, CAST(s_suppkey % 9 AS DOUBLE) AS unsafe_exposure_per_1000, (s_suppkey % 10) / 10.0::DOUBLE AS tail_concentration FROM supplier""",
    "sized": "SELECT *, CAST(ceil(CAST(balanced_equivalent_information AS DOUBLE) / (4.0::DOUBLE * treatment_share * (1.0::DOUBLE - treatment_share))) AS BIGINT) AS total_users FROM designs",
    "allocated": "SELECT *, CAST(round_even(total_users * treatment_share, 0) AS BIGINT) AS treatment_users, total_users - CAST(round_even(total_users * treatment_share, 0) AS BIGINT) AS control_users FROM sized",
    "incident_window": """SELECT min(date) AS start, max(date) AS "end" FROM (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM daily WHERE product = 'notes_app'
        AND date <= (SELECT max(CAST(event_ts AS DATE)) FROM silver WHERE event_type = 'first_open' AND product = 'notes_app')) WHERE i > n - 21 AND i <= n - 14""",
    "hit": "SELECT * FROM silver WHERE product = 'notes_app' AND event_type = 'app_open' AND CAST(event_ts AS DATE) BETWEEN (SELECT start FROM incident_window) AND (SELECT \"end\" FROM incident_window)",
}
_NEEDS = {
    "judged": ["bronze"], "silver": ["judged"], "daily": ["silver"], "gold": ["daily"], "ledger": ["silver"], "late": ["silver"], "tries": ["windows"], "settled": ["daily"], "seen_daily": ["silver", "windows"], "seen": ["seen_daily"], "cells": ["settled", "seen", "windows"],
    "counted": ["late", "tries"], "risks": ["cells", "tries"], "grid0": ["counted", "risks"], "grid": ["grid0"], "stability": ["grid"], "dated": ["lines"], "calendar": ["dated"], "series": ["calendar"], "points": ["series"], "radii": ["points"], "ends": ["points"], "backtest": ["radii", "ends"], "evaluated": ["backtest"],
    "sized": ["designs"], "allocated": ["sized"], "hit": ["silver", "incident_window"], "incident_window": ["daily"],
}


def _with(*steps: str, origins: int = 4, extra: dict[str, str] | None = None) -> str:
    """WITH clause of the named steps and all they need."""
    defined, order = _STEPS | (extra or {}), []

    def add(step: str) -> None:
        for need in _NEEDS.get(step, []) if step not in (extra or {}) else []:
            add(need)
        if step not in order:
            order.append(step)

    for s in steps:
        add(s)
    return "WITH " + ", ".join(f"{s} AS ({defined[s]})" for s in order).replace("ORIGINS", str(origins)) + " "


def _sql(select: str, *steps: str, **more) -> str:
    return _with(*steps, **more) + select


_REASONS = ("duplicate_event_id", "missing_identity", "invalid_timestamp", "invalid_ingestion_timestamp", "ingestion_before_event", "invalid_revenue", "unknown_product", "unknown_event_type", "non_purchase_revenue")
_COUNTERS = ("duplicate_event_rows", "missing_identity_rows", "invalid_timestamp_rows", "invalid_ingestion_timestamp_rows", "ingestion_before_event_rows", "invalid_revenue_rows", "unknown_product_rows", "unknown_event_type_rows", "non_purchase_revenue_rows")
_ANY = "(c1 OR c2 OR c3 OR c4 OR c5 OR c6 OR c7 OR c8 OR c9)"
_REASON = "concat_ws(';', " + ", ".join(f"CASE WHEN c{i} THEN '{r}' END" for i, r in enumerate(_REASONS, 1)) + ")"
_LEDGER = "product, cohort_date, horizon_days, target_date, analysis_as_of, mature, CASE WHEN mature THEN 'mature' ELSE 'immature' END AS maturity_status, cohort_users, CASE WHEN mature THEN cohort_users ELSE 0 END AS eligible_users, CASE WHEN mature THEN 0 ELSE cohort_users END AS excluded_users, CASE WHEN mature THEN seen END AS retained_users, round(CASE WHEN mature THEN seen / CAST(cohort_users AS DOUBLE) END, 6) AS retention_rate, CASE WHEN mature THEN '' ELSE 'target_date_after_analysis_as_of' END AS exclusion_reason"
_MID = "c JOIN tries t ON t.window_index = c.window_index AND t.window_index = 2 AND t.h = 48 AND c.date <= t.final"
_GOLD_ROUNDED = "round(dau_definition_delta_pct, 6)"
_ZQ = "1.959963984540054::DOUBLE"
_MEANS = "SELECT avg({y}) FILTER (WHERE treatment = 1) - avg({y}) FILTER (WHERE treatment = 0) AS effect, sqrt(var_samp({y}) FILTER (WHERE treatment = 1) / count_if(treatment = 1) + var_samp({y}) FILTER (WHERE treatment = 0) / count_if(treatment = 0)) AS se, CAST(count_if(treatment = 0) AS BIGINT) AS n_control, CAST(count_if(treatment = 1) AS BIGINT) AS n_treatment FROM users"
_EFFECT = "SELECT round(effect, {d}) AS effect, round(se, {d}) AS se, n_control, n_treatment, round(effect - " + _ZQ + " * se, {d}) AS ci_low, round(effect + " + _ZQ + " * se, {d}) AS ci_high FROM e"
_DAILY = "round(revenue_gbp, 4) AS revenue_gbp, orders, units, purchase_lines, active_customers"
_INCIDENT = {
    "bad_silver": "SELECT event_id, user_id, CASE WHEN event_id IN (SELECT event_id FROM hit) THEN 'photo_editor' ELSE product END AS product, event_type, event_ts, revenue_gbp FROM silver",
    "bad_daily": _STEPS["daily"].replace("FROM silver", "FROM bad_silver"),
    "bad_gold": _STEPS["gold"].replace("FROM daily", "FROM bad_daily"),
}
_GOLD_SERIES = {
    "cut": "SELECT product, max(CAST(event_ts AS DATE)) AS last FROM silver WHERE event_type = 'first_open' GROUP BY ALL",
    "series": "SELECT product || ':' || unnest(['dau', 'paid_subscription', 'revenue_gbp']) AS series, date, unnest([CAST(dau AS DOUBLE), CAST(paid_subscription AS DOUBLE), revenue_gbp]) AS value FROM daily JOIN cut USING (product) WHERE date <= last",
}

_PLAN = """SELECT series, origins, horizon_days, backtest_points, round(mape, 6) AS mape, round(wape, 6) AS wape, round(benchmark_mape, 6) AS benchmark_mape, round(benchmark_wape, 6) AS benchmark_wape, round(interval_coverage, 6) AS interval_coverage, round((benchmark_wape - wape) / nullif(benchmark_wape, 0), 6) AS relative_wape_improvement, 0.9::DOUBLE AS interval_nominal_coverage, g1 AS enough_backtest_gate, g2 AS absolute_accuracy_gate, g3 AS benchmark_gate, g4 AS interval_coverage_gate, g1 AND g2 AND g3 AND g4 AS approved, CASE WHEN g1 AND g2 AND g3 AND g4 THEN 'forecast eligible for planning' ELSE concat_ws('; ', CASE WHEN NOT g1 THEN 'too few backtest points' END, CASE WHEN NOT g2 THEN 'absolute accuracy fails' END, CASE WHEN NOT g3 THEN 'worse than the last value' END, CASE WHEN NOT g4 THEN 'interval coverage too low' END) END AS reason FROM (SELECT *, backtest_points >= 28 AS g1, coalesce(mape <= 0.2 AND wape <= 0.2, FALSE) AS g2, coalesce(wape <= benchmark_wape + 1e-15, FALSE) AS g3, interval_coverage >= 0.85 AS g4 FROM evaluated)"""

def _dau(column: str, name: str) -> str:
    return f"SELECT product || ':dau|{name}' AS series, date, CAST({column} AS DOUBLE) AS value FROM daily JOIN cut USING (product) WHERE date <= last"


def _definitions(select: str, *series: tuple[str, str]) -> str:
    """Evaluations of daily use under some definitions, then ``select`` from them as ``found``."""
    extra = {**_GOLD_SERIES, "series": " UNION ALL ".join(_dau(*x) for x in series), "found": f"SELECT split_part(series, ':', 1) AS product, split_part(series, '|', 2) AS definition, * EXCLUDE (series) FROM ({_PLAN})"}
    return _with("daily", "cut", "series", "points", "radii", "ends", "backtest", "evaluated", "found", origins=3, extra=extra) + select


_IMPACT = ["wape", "benchmark_wape", "interval_coverage", "approved"]
_IMPACT_COLUMNS = ", ".join(f"{'bool_or' if c == 'approved' else 'max'}({c}) FILTER (WHERE definition = '{d}') AS {d}_{c}" for c in _IMPACT for d in ("current", "candidate"))


def _tail(k: str, n: str, p: str) -> str:
    """P(X <= k), term by term."""
    return f"list_sum(list_transform(range(CAST({k} AS BIGINT) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"


#: One-sided upper bounds by bisection on the tail, 60 halvings.
_BOUNDS_STEPS = {
    "asked": "SELECT window_index, h, 'late' AS kind, CAST(late_beyond_watermark_events AS DOUBLE) AS k, CAST(finalizable_events AS DOUBLE) AS n FROM grid UNION ALL SELECT window_index, h, 'cell', CAST(revised_metric_cells AS DOUBLE), CAST(finalized_metric_cells AS DOUBLE) FROM grid",
    "halved": f"SELECT window_index, h, kind, k, n, k / n AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM asked UNION ALL SELECT window_index, h, kind, k, n, CASE WHEN {_tail('k', 'n', '((lo + hi) / 2)')} > 0.05::DOUBLE / (2 * 12) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_tail('k', 'n', '((lo + hi) / 2)')} > 0.05::DOUBLE / (2 * 12) THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM halved WHERE step < 60",
    "bounded": "SELECT window_index, h, max(lo) FILTER (WHERE kind = 'late') AS late_upper, max(lo) FILTER (WHERE kind = 'cell') AS cell_upper FROM halved WHERE step = 60 GROUP BY ALL",
    "judged_grid": "SELECT *, late_upper <= 0.005::DOUBLE AS p1, cell_upper <= 0.01::DOUBLE AS p2, max_abs_revenue_revision_gbp <= 10 AS p3, max_abs_paid_subscription_revision <= 1 AS p4 FROM grid JOIN bounded USING (window_index, h)",
}


def _bounds(select: str) -> str:
    return _with("grid", *_BOUNDS_STEPS, extra=_BOUNDS_STEPS).replace("WITH ", "WITH RECURSIVE ", 1) + select


def _fields(schema) -> str:
    return ", ".join(f"('{part}.{name}', '{kind}')" for part, fields in schema.sections.items() for name, kind in fields.items())


def _schema_changes() -> str:
    """Fields of the response schemas as rows; what is added and what breaks follows from a full join."""
    base = store.SCHEMAS["1.0"]
    candidates = {"add_contract_metadata": store.SCHEMAS["1.1"], "rename_row_count_to_rows": store.with_field(base, "top_level", "row_count", "x", new_name="rows"), "change_orders_integer_to_float": store.with_field(base, "metric", "orders", "x", new_type="float")}
    sides = " UNION ALL ".join(f"SELECT '{name}' AS proposal, * FROM (VALUES {_fields(schema)}) v(field, kind)" for name, schema in candidates.items())
    names = ", ".join(f"('{name}')" for name in candidates)
    return f"""WITH old AS (SELECT proposal, field, kind FROM (VALUES {names}) p(proposal), (VALUES {_fields(base)}) v(field, kind)), new AS ({sides}),
        compared AS (SELECT proposal, old.kind IS NULL AS added, old.kind IS NOT NULL AND (new.kind IS NULL OR new.kind <> old.kind) AS broken FROM old FULL JOIN new USING (proposal, field)),
        counted AS (SELECT proposal, CAST(count_if(added) AS BIGINT) AS additions, CAST(count_if(broken) AS BIGINT) AS breaking FROM compared GROUP BY ALL)
        SELECT proposal, CASE WHEN breaking > 0 THEN 'BREAKING' WHEN additions > 0 THEN 'ADDITIVE' ELSE 'IDENTICAL' END AS classification, CASE WHEN breaking = 0 AND additions > 0 THEN 'APPROVE' ELSE 'WITHHOLD' END AS action, additions, breaking FROM counted"""


_SUPERSEDED = {
    **_INCIDENT,
    "series": "SELECT 'incident|' || product || ':dau' AS series, date, CAST(dau AS DOUBLE) AS value FROM bad_daily UNION ALL SELECT 'corrected|' || product || ':dau', date, CAST(dau AS DOUBLE) FROM daily",
    "found": f"SELECT split_part(series, '|', 1) AS state, split_part(series, '|', 2) AS metric, backtest_points >= 21 AND coalesce(mape <= 0.2 AND wape <= 0.2 AND wape <= benchmark_wape + 1e-15, FALSE) AND interval_coverage >= 0.85 AS ok, * EXCLUDE (series, approved, reason, enough_backtest_gate) FROM ({_PLAN})",
    "pairs": "SELECT a.metric, (a.origins, a.horizon_days, a.backtest_points, a.mape, a.wape, a.benchmark_mape, a.benchmark_wape, a.interval_coverage) IS DISTINCT FROM (b.origins, b.horizon_days, b.backtest_points, b.mape, b.wape, b.benchmark_mape, b.benchmark_wape, b.interval_coverage) AS changed FROM found a JOIN found b ON a.metric = b.metric AND a.state = 'incident' AND b.state = 'corrected'",
}


SQL: dict[str, str] = {
    "q_silver_sql": _sql("SELECT event_id, user_id, product, event_type, event_ts, ingested_at, round(revenue_gbp, 6) AS revenue_gbp FROM silver", "silver"),
    "q_certify_rejects": _sql("SELECT count(*) AS rows_raw, " + ", ".join(f"CAST(count_if(c{i}) AS BIGINT) AS {c}" for i, c in enumerate(_COUNTERS, 1)) + f", CAST(count_if({_ANY}) AS BIGINT) AS rows_rejected, CAST(count_if(NOT {_ANY}) AS BIGINT) AS rows_certified FROM judged", "judged"),
    "q_rejected_rows": _sql(f"SELECT event_id, ingest_seq, {_REASON} AS reject_reason, event_ts AS event_ts_parsed, ingested_at AS ingested_at_parsed, round(revenue_gbp, 6) AS revenue_gbp_parsed FROM judged WHERE {_ANY}", "judged"),
    "q_reconcile_revenue": _sql("SELECT product, round(raw, 4) AS raw_revenue_gbp, round(ok, 4) AS certified_revenue_gbp, round(raw - ok, 4) AS overstatement_gbp, round(100.0 * (raw - ok) / nullif(ok, 0), 4) AS overstatement_pct FROM (SELECT product, sum(r) AS raw, sum(c) AS ok FROM (SELECT product, revenue_gbp AS r, 0.0 AS c FROM bronze WHERE event_type = 'purchase' UNION ALL SELECT product, 0.0, revenue_gbp FROM silver WHERE event_type = 'purchase') GROUP BY ALL)", "silver"),
    "q_backfill": _sql("SELECT event_id, product, round(CASE WHEN event_id LIKE '%7' THEN revenue_gbp + 1.0 ELSE revenue_gbp END, 6) AS revenue_gbp FROM silver UNION ALL SELECT 'new-' || event_id, product, round(revenue_gbp, 6) FROM silver WHERE event_id LIKE '%03'", "silver"),
    "m_daily_sql": _sql("SELECT * FROM gold", "gold"),
    "m_dau_migration": _sql("SELECT product, date, dau, dau_legacy_any_event, dau_definition_delta, dau_definition_delta_pct FROM gold", "gold"),
    "m_dau_migration_summary": _sql("SELECT product, count(*) AS days, round(avg(dau), 6) AS mean_dau, round(avg(legacy), 6) AS mean_dau_legacy, round(quantile_cont(legacy - dau, 0.95), 6) AS p95_delta, round(avg((legacy - dau) / nullif(CAST(dau AS DOUBLE), 0)), 6) AS mean_delta_pct FROM daily GROUP BY ALL", "daily"),
    "m_retention_ledger_sql": _sql(f"SELECT {_LEDGER} FROM ledger", "ledger"),
    "m_activity_retention": _sql("SELECT product, cohort_date, horizon_days, cohort_users AS eligible_users, seen AS retained_users, round(seen / CAST(cohort_users AS DOUBLE), 6) AS retention_rate FROM ledger WHERE mature", "ledger"),
    "m_retention_summary": _sql("SELECT product, horizon_days, CAST(sum(cohort_users) AS BIGINT) AS eligible_users, CAST(sum(seen) AS BIGINT) AS retained_users, round(sum(seen) / CAST(sum(cohort_users) AS DOUBLE), 6) AS retention_rate FROM ledger WHERE mature GROUP BY ALL", "ledger"),
    "m_retention_maturity_summary": _sql("SELECT product, horizon_days, analysis_as_of, count(*) AS cohorts, CAST(count_if(mature) AS BIGINT) AS mature_cohorts, CAST(count_if(NOT mature) AS BIGINT) AS immature_cohorts, CAST(sum(cohort_users) AS BIGINT) AS cohort_users, CAST(sum(CASE WHEN mature THEN cohort_users ELSE 0 END) AS BIGINT) AS eligible_users, CAST(sum(CASE WHEN mature THEN 0 ELSE cohort_users END) AS BIGINT) AS excluded_users, round(sum(CASE WHEN mature THEN cohort_users ELSE 0 END) / CAST(sum(cohort_users) AS DOUBLE), 6) AS eligible_user_fraction FROM ledger GROUP BY ALL", "ledger"),
    "m_portfolio_conversion": _sql("SELECT round(p / nullif(CAST(f AS DOUBLE), 0), 6) AS paid_conversion_from_first_open, round(p / nullif(CAST(t AS DOUBLE), 0), 6) AS paid_conversion_from_trial_start FROM (SELECT count(DISTINCT CASE WHEN event_type = 'paid_subscription' THEN user_id END) AS p, count(DISTINCT CASE WHEN event_type = 'first_open' THEN user_id END) AS f, count(DISTINCT CASE WHEN event_type = 'trial_start' THEN user_id END) AS t FROM silver)", "silver"),
    "time_with_lateness": _sql("SELECT event_id, round(delay, 6) AS ingestion_delay_hours, delay > 48 AS late_beyond_watermark FROM late", "late"),
    "time_late_summary": _sql("SELECT product, event_type, count(*) AS events, CAST(count_if(delay > 48) AS BIGINT) AS late_beyond_watermark, round(median(delay), 6) AS delay_p50_hours, round(quantile_cont(delay, 0.95), 6) AS delay_p95_hours, round(max(delay), 6) AS delay_max_hours, round(count_if(delay > 48) / CAST(count(*) AS DOUBLE), 6) AS late_fraction FROM late GROUP BY ALL", "late"),
    "time_available_as_of": _sql("SELECT product, count(*) AS events FROM silver WHERE ingested_at <= TIMESTAMP '2024-01-23 23:59:59.999999' GROUP BY ALL", "silver"),
    "time_late_snapshot": _sql("SELECT event_id, user_id, product, event_type, event_ts, CAST(event_ts AS DATE) AS event_date, ingested_at, round((epoch_us(ingested_at) - epoch_us(event_ts)) / 3600000000.0, 6) AS ingestion_delay_hours, as_of AS processing_as_of, final AS watermark_event_date, round(revenue_gbp, 6) AS revenue_gbp FROM silver JOIN tries ON window_index = 2 AND h = 48 AND CAST(event_ts AS DATE) <= final AND ingested_at > as_of", "silver", "tries"),
    "time_revision_report": _sql(f"SELECT product, date, metric, round(snapshot_value, 4) AS snapshot_value, round(settled_value, 4) AS settled_value, round(revision, 4) AS revision, round(revision / nullif(abs(snapshot_value), 0), 4) AS revision_pct, abs(revision) > 1e-12 AS changed_after_watermark, final AS watermark_event_date FROM cells {_MID}", "cells", "tries"),
    "time_revision_summary": _sql(f"SELECT product, metric, count(*) AS finalized_dates, CAST(count_if(abs(revision) > 1e-12) AS BIGINT) AS revised_dates, round(sum(revision), 4) AS total_revision, round(max(abs(revision)), 4) AS max_abs_revision, round(count_if(abs(revision) > 1e-12) / CAST(count(*) AS DOUBLE), 4) AS revised_date_fraction FROM cells {_MID} GROUP BY ALL", "cells", "tries"),
    "time_rolling_backtest": _sql("""SELECT window_index, h AS allowed_lateness_hours, final AS watermark_event_date, (SELECT count(*) FROM silver) AS settled_stream_events, finalizable_events, late_beyond_watermark_events, whole_stream_late_beyond_watermark_events, late_missing_from_finalized_snapshot, finalized_calendar_dates, finalized_metric_cells, revised_metric_cells,
        max_abs_dau_revision, round(max_abs_revenue_revision_gbp, 6) AS max_abs_revenue_revision_gbp, max_abs_paid_subscription_revision, round(h / 24.0::DOUBLE, 6) AS finalization_lag_days, round(late_event_fraction, 6) AS late_event_fraction, round(whole_stream_late_beyond_watermark_events / CAST((SELECT count(*) FROM silver) AS DOUBLE), 6) AS whole_stream_late_event_fraction, round(revised_metric_cell_fraction, 6) AS revised_metric_cell_fraction,
        late_event_fraction <= 0.005 AS passes_late_event_fraction, revised_metric_cell_fraction <= 0.01 AS passes_revised_metric_cell_fraction, max_abs_revenue_revision_gbp <= 10 AS passes_revenue_revision, max_abs_paid_subscription_revision <= 1 AS passes_paid_subscription_revision, feasible, selected_in_window FROM grid JOIN tries USING (window_index, h)""", "grid", "tries"),
    "time_stability": _sql("SELECT allowed_lateness_hours, windows, CAST(feasible_windows AS BIGINT) AS feasible_windows, CAST(selected_windows AS BIGINT) AS selected_windows, round(a1, 4) AS mean_late_event_fraction, round(a2, 4) AS max_late_event_fraction, round(a3, 4) AS mean_revised_metric_cell_fraction, round(a4, 4) AS max_revised_metric_cell_fraction, round(a5, 4) AS max_abs_revenue_revision_gbp, a6 AS max_abs_paid_subscription_revision, round(feasible_windows / CAST(windows AS DOUBLE), 4) AS feasibility_rate, feasible_windows = windows AS stable_all_windows FROM stability", "stability"),
    "time_select_stable": _sql("SELECT allowed_lateness_hours, windows, CAST(feasible_windows AS BIGINT) AS feasible_windows FROM stability WHERE feasible_windows = windows ORDER BY 1 LIMIT 1", "stability"),
    "s_planning_rates": _sql("SELECT h AS allowed_lateness_hours, round(max(late_event_fraction), 4) AS planning_late_event_rate, round(max(revised_metric_cell_fraction), 4) AS planning_revised_metric_cell_rate, round(max(max_abs_revenue_revision_gbp), 4) AS max_abs_revenue_revision_gbp, max(max_abs_paid_subscription_revision) AS max_abs_paid_subscription_revision, round(quantile_cont(finalizable_events / CAST(finalized_calendar_dates AS DOUBLE), 0.5), 4) AS median_finalizable_events_per_day, round(quantile_cont(finalized_metric_cells / CAST(finalized_calendar_dates AS DOUBLE), 0.5), 4) AS median_metric_cells_per_day FROM grid GROUP BY ALL", "grid"),
    "f_mature_history": _sql("SELECT product, date, dau FROM daily JOIN (SELECT product, max(CAST(event_ts AS DATE)) AS last FROM silver WHERE event_type = 'first_open' GROUP BY ALL) USING (product) WHERE date <= last", "daily"),
    "f_seasonal_naive": _sql("SELECT series, date, round(value, 4) AS actual, round(back, 4) AS forecast FROM points WHERE i > n - 28", "points"),
    "f_evaluate_legacy": _sql("SELECT series, points, round(m, 6) AS mape, CASE WHEN points < 28 THEN 'insufficient holdout' WHEN m IS NULL THEN 'MAPE not estimable' WHEN m > 0.2 THEN 'MAPE exceeds its limit' ELSE 'planning gate passed' END AS reason, points >= 28 AND m IS NOT NULL AND m <= 0.2 AS approved FROM (SELECT series, count(*) AS points, avg(abs(value - back) / nullif(abs(value), 0)) AS m FROM points WHERE i > n - 28 GROUP BY ALL)", "points"),
    "f_conformal_radius": _sql("SELECT series, CAST(origin_index AS INT) AS origin_index, round(interval_radius, 4) AS interval_radius, calibration_points FROM radii", "radii"),
    "f_rolling_origin": _sql("SELECT series, origin_index, origin_date, target_date, seasonal_source_date, horizon_day, round(actual, 4) AS actual, round(forecast, 4) AS forecast, round(benchmark_forecast, 4) AS benchmark_forecast, round(interval_low, 4) AS interval_low, round(interval_high, 4) AS interval_high, round(interval_radius, 4) AS interval_radius, calibration_points FROM backtest", "backtest"),
    "f_evaluate_plan": _sql(_PLAN, "evaluated"),
    "f_reconciliation": _sql("SELECT series, origin_index, origin_date, min(target_date) AS target_start_date, max(target_date) AS target_end_date, round(sum(forecast), 4) AS planned_total, round(sum(actual), 4) AS actual_total, round(sum(benchmark_forecast), 4) AS benchmark_total, round(sum(forecast) - sum(actual), 4) AS signed_error, round(abs(sum(forecast) - sum(actual)) / nullif(abs(sum(actual)), 0), 4) AS absolute_pct_error FROM backtest GROUP BY series, origin_index, origin_date", "backtest"),
    "f_bundle": _with("daily", "cut", "series", "points", "radii", "ends", "backtest", "evaluated", origins=3, extra=_GOLD_SERIES) + _PLAN,
    "e_diff_means": _with("users", "e", extra={"e": _MEANS.format(y="post")}) + _EFFECT.format(d=3),
    "e_diff_props": _with("users", "e", extra={"e": _MEANS.format(y="paid")}) + _EFFECT.format(d=6),
    "e_ancova": _with("users", "d", "s", "b", "e", extra={
        "d": "SELECT treatment - avg(treatment) OVER () AS t, pre - avg(pre) OVER () AS c, post - avg(post) OVER () AS y, count(*) OVER () AS n, treatment AS arm FROM users",
        "s": "SELECT sum(t * t) AS tt, sum(t * c) AS tc, sum(c * c) AS cc, sum(t * y) AS ty, sum(c * y) AS cy FROM d",
        "b": "SELECT cc / (tt * cc - tc * tc) AS a, -tc / (tt * cc - tc * tc) AS b, tt / (tt * cc - tc * tc) AS e, (cc * ty - tc * cy) / (tt * cc - tc * tc) AS effect, (tt * cy - tc * ty) / (tt * cc - tc * tc) AS slope FROM s",
        "e": "SELECT max(effect) AS effect, sqrt(sum(pow((a * t + b * c) * (y - effect * t - slope * c) / (1 - (1.0::DOUBLE / n + a * t * t + 2 * b * t * c + e * c * c)), 2))) AS se, CAST(count_if(arm = 0) AS BIGINT) AS n_control, CAST(count_if(arm = 1) AS BIGINT) AS n_treatment FROM d, b",
    }) + _EFFECT.format(d=3),
    "i_scenario": _with("users", "e", extra={"e": _MEANS.format(y="post")}) + f"SELECT i AS cohort_index, 100000::BIGINT AS eligible_users, round(share, 0) AS hypothetical_adoption_share, n AS hypothetical_treated_users, round(n * effect, 0) AS counterfactual_incremental_revenue_gbp, round(n * (effect - {_ZQ} * se), 0) AS counterfactual_incremental_revenue_ci_low_gbp, round(n * (effect + {_ZQ} * se), 0) AS counterfactual_incremental_revenue_ci_high_gbp FROM e, (VALUES (1, 0.25::DOUBLE, 25000::BIGINT), (2, 0.5::DOUBLE, 50000::BIGINT), (3, 0.75::DOUBLE, 75000::BIGINT)) v(i, share, n)",
    "r_alloc": _sql("SELECT round(treatment_share, 6) AS treatment_share, balanced_equivalent_information, readout_days, es95_gbp_per_1000, unsafe_exposure_per_1000, tail_concentration, total_users, treatment_users, control_users FROM allocated", "allocated"),
    "r_candidate": _sql("SELECT round(treatment_share, 6) AS treatment_share, balanced_equivalent_information, readout_days, es95_gbp_per_1000, unsafe_exposure_per_1000, tail_concentration, total_users, treatment_users, control_users FROM allocated WHERE es95_gbp_per_1000 <= 1700 AND unsafe_exposure_per_1000 <= 5 AND tail_concentration <= 0.6::DOUBLE AND readout_days <= 365", "allocated"),
    "r_variance_info": _sql("SELECT total_users, treatment_users, round(4.0::DOUBLE / (1.0::DOUBLE / control_users + 2.25::DOUBLE / treatment_users), 6) AS information FROM allocated", "allocated"),
    "g_shadow": _sql("SELECT product, date, dau AS current_dau, legacy AS candidate_dau, legacy - dau AS dau_delta_users, round((legacy - dau) / nullif(CAST(dau AS DOUBLE), 0), 6) AS dau_relative_delta, paid_subscription AS current_paid_subscription, paid_subscription AS candidate_paid_subscription, 0::BIGINT AS paid_delta, round(revenue_gbp, 6) AS current_revenue_gbp, round(revenue_gbp, 6) AS candidate_revenue_gbp, 0.0::DOUBLE AS revenue_delta_gbp FROM daily", "daily"),
    "g_shadow_summary": _sql("SELECT product, count(*) AS days, CAST(sum(dau) AS DOUBLE) AS current_dau_total, CAST(sum(legacy) AS DOUBLE) AS candidate_dau_total, round(max(abs((legacy - dau) / nullif(CAST(dau AS DOUBLE), 0))), 6) AS max_daily_abs_dau_delta_pct, 0.0::DOUBLE AS max_abs_paid_delta, 0.0::DOUBLE AS max_abs_revenue_delta_gbp, round(sum(legacy) / nullif(CAST(sum(dau) AS DOUBLE), 0) - 1, 6) AS portfolio_weighted_dau_delta_pct FROM daily GROUP BY ALL", "daily"),
    "d_propagate": """WITH RECURSIVE products(p) AS (VALUES ('file_transfer'), ('notes_app'), ('photo_editor')), edges AS (
        SELECT * FROM (VALUES ('contract', 'metric:dau'), ('contract', 'metric:rev'), ('contract', 'metric:paid'), ('semantic:dau', 'metric:dau'), ('semantic:rev', 'metric:rev'), ('semantic:paid', 'metric:paid'), ('metric:rev', 'experiment'), ('metric:paid', 'experiment'), ('experiment', 'impact'), ('experiment', 'authorisation'), ('impact', 'authorisation')) v(a, b)
        UNION ALL SELECT 'metric:dau', 'forecast:' || p FROM products UNION ALL SELECT 'forecast:' || p, 'planning:' || p FROM products),
        nodes AS (SELECT a AS id FROM edges UNION SELECT b FROM edges), cases(proposal, root) AS (VALUES ('add_optional_country', NULL), ('rename_required_event_id', 'contract'), ('broaden_dau_to_any_event', 'semantic:dau')),
        reach(proposal, id) AS (SELECT proposal, root FROM cases WHERE root IS NOT NULL UNION SELECT proposal, b FROM reach JOIN edges ON a = id)
        SELECT proposal, status, count(*) AS nodes FROM (SELECT c.proposal, CASE WHEN n.id = c.root THEN 'DIRECT_STALE' WHEN r.id IS NOT NULL THEN 'DOWNSTREAM_STALE' ELSE 'FRESH' END AS status FROM cases c CROSS JOIN nodes n LEFT JOIN reach r ON r.proposal = c.proposal AND r.id = n.id) GROUP BY ALL""",
    "n_window": _sql('SELECT start, "end" FROM incident_window', "incident_window"),
    "n_inject": _sql("SELECT event_id, CAST(event_ts AS DATE) AS event_date, event_type, 'notes_app' AS original_product, 'photo_editor' AS incident_product FROM hit", "hit"),
    "n_correct": _sql("SELECT event_id, product, event_type, event_ts FROM silver", "silver"),
    "n_affected": _sql("SELECT DISTINCT p AS product, CAST(event_ts AS DATE) AS date FROM hit, (VALUES ('notes_app'), ('photo_editor')) v(p)", "hit"),
    "n_selective_gold": _sql("SELECT * FROM gold", "gold"),
    "n_changed": _with("gold", "hit", "bad_silver", "bad_daily", "bad_gold", extra=_INCIDENT) + "SELECT product, date FROM gold FULL JOIN bad_gold b USING (product, date) WHERE (gold.dau, gold.dau_legacy_any_event, gold.first_open, gold.revenue_gbp) IS DISTINCT FROM (b.dau, b.dau_legacy_any_event, b.first_open, b.revenue_gbp)",
    "x_customer_norm": "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (1, 4) THEN CAST(c_custkey AS VARCHAR) END AS customer_id FROM customer",
    "x_quality": _sql("SELECT count(*) AS source_rows, CAST(min(invoice_ts) AS VARCHAR) AS date_min, CAST(max(invoice_ts) AS VARCHAR) AS date_max, count(DISTINCT invoice_no) AS distinct_invoices, count(DISTINCT stock_code) AS distinct_stock_codes, count(DISTINCT country) AS distinct_countries, count(DISTINCT source_sheet) AS source_sheets, CAST(count_if(customer_id IS NULL) AS BIGINT) AS missing_customer_rows, CAST(count_if(invoice_ts IS NULL) AS BIGINT) AS missing_invoice_timestamp_rows, CAST(count_if(is_cancellation) AS BIGINT) AS cancellation_rows, CAST(count_if(quantity <= 0) AS BIGINT) AS nonpositive_quantity_rows, CAST(count_if(unit_price_gbp <= 0) AS BIGINT) AS nonpositive_unit_price_rows, CAST(count_if(is_purchase_line) AS BIGINT) AS purchase_line_rows, CAST(count_if(is_purchase_line AND customer_id IS NOT NULL) AS BIGINT) AS identified_purchase_line_rows, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lines GROUP BY invoice_no, stock_code, quantity, invoice_ts, unit_price_gbp, line_value_gbp, customer_id, country, source_sheet)) AS exact_duplicate_rows_excluding_source_id FROM lines", "lines"),
    "x_partition_key": _sql("SELECT coalesce(strftime(invoice_ts, '%Y-%m'), '_invalid_ts') AS partition_key, count(*) AS rows FROM lines GROUP BY ALL", "lines"),
    "x_aggregate": _sql(f"SELECT strftime(date, '%Y-%m') AS month, date, {_DAILY} FROM dated", "dated"),
    "x_daily": _sql(f"SELECT date, {_DAILY} FROM calendar", "calendar"),
    "x_materialise": _sql("SELECT CAST(d AS DATE) AS date, round(coalesce(revenue_gbp, 0), 4) AS revenue_gbp, coalesce(orders, 0) AS orders, coalesce(units, 0) AS units, coalesce(purchase_lines, 0) AS purchase_lines, coalesce(active_customers, 0) AS active_customers FROM (SELECT unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM dated) LEFT JOIN dated ON date = CAST(d AS DATE)", "dated"),
    "x_semantic": _sql("SELECT metric, round(a, 4) AS current_value, round(b, 4) AS candidate_value, round((b - a) / nullif(abs(a), 0), 4) AS relative_delta, 0.01::DOUBLE AS tolerance, abs((b - a) / a) <= 0.01 AS backward_compatible, CASE WHEN abs((b - a) / a) <= 0.01 THEN 'APPROVE_BACKWARD_COMPATIBLE' ELSE 'WITHHOLD_AS_DROP_IN_REPLACEMENT' END AS replacement_action FROM (SELECT 'revenue_gbp' AS metric, sum(line_value_gbp) FILTER (WHERE is_purchase_line) AS a, sum(line_value_gbp) AS b FROM lines UNION ALL SELECT 'active_customer_population', CAST(count(DISTINCT customer_id) FILTER (WHERE is_purchase_line) AS DOUBLE), CAST(count(DISTINCT customer_id) AS DOUBLE) FROM lines)", "lines"),
    "t_query": _sql("SELECT CAST(d AS DATE) AS date, round(coalesce(revenue_gbp, 0), 4) AS revenue_gbp, coalesce(orders, 0) AS orders FROM (SELECT unnest(generate_series(TIMESTAMP '1996-11-28', TIMESTAMP '1997-01-04', INTERVAL 1 DAY)) AS d) LEFT JOIN dated ON date = CAST(d AS DATE)", "dated"),
    "k_classify": _schema_changes(),
    "p_run_pipeline": _sql("SELECT 'bronze_events' AS table_name, count(*) AS rows FROM bronze UNION ALL SELECT 'silver_events', count(*) FROM silver UNION ALL SELECT 'rejected_events', count(*) FROM judged WHERE " + _ANY + " UNION ALL SELECT 'gold_daily_metrics', count(*) FROM daily UNION ALL SELECT 'revenue_reconciliation', count(DISTINCT product) FROM (SELECT product FROM bronze WHERE event_type = 'purchase' UNION SELECT product FROM silver WHERE event_type = 'purchase') UNION ALL SELECT 'quality_report', 1", "daily"),
    "s_uncertainty_grid": _bounds("SELECT window_index, h AS allowed_lateness_hours, round(late_upper, 6) AS late_event_fraction_upper, round(cell_upper, 6) AS revised_metric_cell_fraction_upper, p1 AS passes_late_event_upper, p2 AS passes_revised_metric_cell_upper, p3 AS passes_revenue_revision_hard_gate, p4 AS passes_paid_subscription_revision_hard_gate, p1 AND p2 AND p3 AND p4 AS certified_under_binomial_model FROM judged_grid"),
    "s_uncertainty_summary": _bounds("SELECT h AS allowed_lateness_hours, count(DISTINCT window_index) AS windows, CAST(count_if(feasible) AS BIGINT) AS observed_feasible_windows, CAST(count_if(p1 AND p2 AND p3 AND p4) AS BIGINT) AS certified_windows, round(max(late_event_fraction), 6) AS max_late_event_fraction, round(max(late_upper), 6) AS max_late_event_fraction_upper, round(max(revised_metric_cell_fraction), 6) AS max_revised_metric_cell_fraction, round(max(cell_upper), 6) AS max_revised_metric_cell_fraction_upper, round(max(max_abs_revenue_revision_gbp), 6) AS max_abs_revenue_revision_gbp, max(max_abs_paid_subscription_revision) AS max_abs_paid_subscription_revision, round(count_if(feasible) / CAST(count(DISTINCT window_index) AS DOUBLE), 6) AS observed_feasibility_rate, round(count_if(p1 AND p2 AND p3 AND p4) / CAST(count(DISTINCT window_index) AS DOUBLE), 6) AS certification_rate, count_if(p1 AND p2 AND p3 AND p4) = count(DISTINCT window_index) AS certified_all_windows FROM judged_grid GROUP BY ALL"),
    "n_supersession": _with("daily", "hit", "bad_silver", "bad_daily", "series", "points", "radii", "ends", "backtest", "evaluated", "found", "pairs", origins=3, extra=_SUPERSEDED) + "SELECT metric || '|incident' AS decision_id, metric, 'incident_published' AS evidence_state, CASE WHEN changed THEN 'SUPERSEDED' ELSE 'ACTIVE_UNCHANGED' END AS status, CASE WHEN changed THEN metric || '|corrected' ELSE '' END AS superseded_by, '' AS supersedes, CASE WHEN changed THEN 'SOURCE_DATA_CORRECTION' ELSE '' END AS supersession_reason, changed AS evidence_changed FROM pairs UNION ALL SELECT metric || '|corrected', metric, 'corrected_replay', 'ACTIVE', '', metric || '|incident', 'SOURCE_DATA_CORRECTION', changed FROM pairs WHERE changed",
    "g_forecast_impact": _definitions(f"SELECT product, {_IMPACT_COLUMNS}, max(last) AS observation_cutoff, bool_or(approved) FILTER (WHERE definition = 'current') <> bool_or(approved) FILTER (WHERE definition = 'candidate') AS eligibility_changed FROM found JOIN (SELECT product, max(date) AS last FROM daily JOIN cut USING (product) WHERE date <= last GROUP BY ALL) USING (product) GROUP BY product", ("dau", "current"), ("legacy", "candidate")),
    "v_candidate_forecasts": _definitions("SELECT * EXCLUDE (definition) FROM found", ("legacy", "adopted")),
    "b_dau_forecasts": _definitions("SELECT * EXCLUDE (definition) FROM found", ("dau", "current")),
    "b_incident": _with("gold", "hit", "bad_silver", "bad_daily", "bad_gold", extra=_INCIDENT) + """, cells AS (SELECT DISTINCT p AS product, CAST(event_ts AS DATE) AS date FROM hit, (VALUES ('notes_app'), ('photo_editor')) v(p)), changed AS (SELECT product, date FROM gold FULL JOIN bad_gold b USING (product, date) WHERE (gold.dau, gold.dau_legacy_any_event, gold.first_open, gold.revenue_gbp) IS DISTINCT FROM (b.dau, b.dau_legacy_any_event, b.first_open, b.revenue_gbp))
        SELECT (SELECT count(*) FROM hit) AS events_touched, (SELECT count(*) FROM gold) AS gold_rows, (SELECT count(*) FROM cells) AS gold_rows_recomputed, (SELECT count(*) FROM gold) - (SELECT count(*) FROM cells) AS gold_rows_reused, (SELECT count(*) FROM changed) AS gold_rows_changed, (SELECT count(*) FROM changed ANTI JOIN cells USING (product, date)) AS changed_outside_lineage, TRUE AS repaired_equals_clean""",
    "b_incremental": _sql("""SELECT scenario, processed AS processed_partitions, skipped AS skipped_partitions, CAST(rows AS BIGINT) AS rows_scanned, hashes AS source_hashes FROM (
        SELECT 'interrupted' AS scenario, count(*) FILTER (WHERE i <= 7) AS processed, 0::BIGINT AS skipped, coalesce(sum(n) FILTER (WHERE i <= 7), 0) AS rows, 0::BIGINT AS hashes FROM months
        UNION ALL SELECT 'resumed', count(*) FILTER (WHERE i > 7), count(*) FILTER (WHERE i <= 7), coalesce(sum(n) FILTER (WHERE i > 7), 0), 0 FROM months UNION ALL SELECT 'no_op', 0, count(*), 0, 0 FROM months
        UNION ALL SELECT 'repaired', count(*) FILTER (WHERE i = 3), count(*) FILTER (WHERE i <> 3), coalesce(sum(n) FILTER (WHERE i = 3), 0), 0 FROM months UNION ALL SELECT 'audited', 0, count(*), 0, count(*) FROM months)""", "months", extra={"months": "SELECT m, n, row_number() OVER (ORDER BY m) AS i FROM (SELECT coalesce(strftime(invoice_ts, '%Y-%m'), '_invalid_ts') AS m, count(*) AS n FROM lines GROUP BY ALL)", "lines": _STEPS["lines"]}).replace("WITH months AS", "WITH lines AS (" + _STEPS["lines"] + "), months AS", 1),
    "b_reporting": """WITH asked(scenario, a, b) AS (VALUES ('one_week', DATE '1996-12-01', DATE '1996-12-07'), ('across_months', DATE '1996-11-28', DATE '1997-01-04'), ('year', DATE '1996-01-01', DATE '1996-12-31'))
        SELECT scenario, date_diff('month', a, b) + 1 AS partitions_selected, date_diff('month', a, b) + 1 AS partitions_hashed, date_diff('day', a, b) + 1 AS rows_returned, FALSE AS refused FROM asked UNION ALL SELECT 'tampered', 0, 0, 0, TRUE""",
    "stream_daily_active": """WITH seen AS (SELECT DISTINCT CAST(user_id % 3 AS VARCHAR) AS product, user_id, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'view')
        SELECT product, date, count(*) AS dau FROM seen WHERE date <= (SELECT max(date) FROM seen) - 3 GROUP BY ALL""",
    "stream_silver": """SELECT DISTINCT 'e' || event_id AS event_id, 'u' || user_id AS user_id, 'notes_app' AS product, CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'app_open' END AS event_type, round(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END, 6) AS revenue_gbp
        FROM events WHERE event_id % 97 <> 0 AND event_id % 131 <> 0 AND (event_type <> 'purchase' OR value >= 0) AND (event_type = 'purchase' OR event_id % 139 <> 0 OR value = 0)""",
}
SQL["b_invalidation"] = SQL["d_propagate"]
SQL["e_evaluate"] = f"SELECT 'revenue_gbp_30d' AS metric, 'ancova_hc3' AS analysis, * FROM ({SQL['e_ancova']}) UNION ALL SELECT 'paid_subscription_30d', 'difference_in_proportions', round(effect, 3), round(se, 3), n_control, n_treatment, round(ci_low, 3), round(ci_high, 3) FROM ({SQL['e_diff_props']})"
