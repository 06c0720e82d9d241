"""Queries over worker telemetry (group H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.operators import telemetry
from newsflow.plans.inputs import load
from newsflow.plans.registry import big, query, us

_NOW = "2024-01-30 00:00:00"


def now() -> Column:
    return F.lit(_NOW).cast("timestamp")


# The fold written with window functions, one row per update.
HISTORY_SQL = """
    SELECT worker, event_id, ts, op,
           coalesce(last_value(CASE op WHEN 'idle' THEN 'idle' WHEN 'completed' THEN 'idle' WHEN 'processing' THEN 'processing'
                                       WHEN 'error' THEN 'error' END IGNORE NULLS) OVER w, 'starting') AS phase,
           coalesce(last_value(CASE WHEN op IN ('connected', 'disconnected') THEN op END IGNORE NULLS) OVER w, 'unknown') AS server_connection,
           nullif(last_value(CASE WHEN op = 'processing' THEN task_id WHEN op IN ('idle', 'completed') THEN -1 END IGNORE NULLS) OVER w, -1)
             AS current_task_id,
           nullif(last_value(CASE WHEN op IN ('error', 'disconnected') THEN error WHEN op IN ('idle', 'processing', 'completed') THEN '' END
                             IGNORE NULLS) OVER w, '') AS last_error,
           CAST(sum(CASE WHEN op = 'completed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS completed_task_count,
           CAST(sum(bytes_received) OVER w AS BIGINT) AS bytes_received,
           max(CASE WHEN op = 'connected' THEN ts END) OVER w AS last_server_contact_at,
           row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) AS back
    FROM {v_status} s WINDOW w AS (PARTITION BY worker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
_FIELDS = "phase, server_connection, current_task_id, last_error, completed_task_count, bytes_received"


@query(
    "h1_status_fold",
    f"""SELECT worker, {_FIELDS}, epoch_us(last_server_contact_at) AS contact_us, epoch_us(ts) AS updated_us
        FROM ({HISTORY_SQL}) WHERE back = 1""",
)
def status_fold(spark: SparkSession, sf: str) -> DataFrame:
    [updates] = load(spark, sf, "v_status")
    return telemetry.fold_status(updates).select(
        "worker", "phase", "server_connection", "current_task_id", "last_error", "completed_task_count", "bytes_received",
        us("last_server_contact_at").alias("contact_us"), us("last_updated_at").alias("updated_us"),
    )


@query("h1_status_history", f"SELECT event_id, {_FIELDS} FROM ({HISTORY_SQL})")
def status_history(spark: SparkSession, sf: str) -> DataFrame:
    [updates] = load(spark, sf, "v_status")
    return telemetry.status_history(updates).select("event_id", *_FIELDS.split(", "))


@query(
    "h2_transfer_totals",
    "SELECT worker, CAST(0 AS BIGINT) AS bytes_sent, CAST(sum(bytes_received) AS BIGINT) AS bytes_received FROM {v_status} s GROUP BY worker",
)
def transfer_totals(spark: SparkSession, sf: str) -> DataFrame:
    [updates] = load(spark, sf, "v_status")
    return telemetry.transfer_totals(updates)


@query(
    "h2_running_transfer",
    """SELECT event_id, CAST(sum(bytes_received) OVER (PARTITION BY worker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
              AS total_received FROM {v_status} s""",
)
def running_transfer(spark: SparkSession, sf: str) -> DataFrame:
    [updates] = load(spark, sf, "v_status")
    return telemetry.running_transfer(updates).select("event_id", "total_received")


SPACING_MS = 3 * 3_600_000


@query(
    "h3_throttle",
    f"""WITH RECURSIVE r AS (
            SELECT worker, event_id, epoch_us(ts) AS a, op IN ('idle', 'processing', 'completed', 'disconnected', 'error', 'stopped') AS forced,
                   row_number() OVER (PARTITION BY worker ORDER BY ts, event_id) AS i FROM {{v_status}} s),
        g AS (SELECT worker, event_id, i, a AS last, true AS emitted FROM r WHERE i = 1
              UNION ALL
              SELECT r.worker, r.event_id, r.i,
                     CASE WHEN r.forced OR r.a - g.last >= {SPACING_MS * 1000} THEN r.a ELSE g.last END,
                     r.forced OR r.a - g.last >= {SPACING_MS * 1000}
              FROM g JOIN r ON r.worker = g.worker AND r.i = g.i + 1)
        SELECT worker, event_id FROM g WHERE emitted""",
)
def throttle(spark: SparkSession, sf: str) -> DataFrame:
    [updates] = load(spark, sf, "v_status")
    return telemetry.throttle(updates, interval_ms=SPACING_MS, segment_us=24 * 3_600_000_000).select("worker", "event_id")


@query(
    "h4_staleness",
    f"""SELECT worker, max(ts) < TIMESTAMP '{_NOW}' - INTERVAL '120' SECOND AS stale FROM {{v_status}} s
        WHERE ts < TIMESTAMP '{_NOW}' GROUP BY worker""",
)
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    [updates] = load(spark, sf, "v_status")
    latest = telemetry.fold_status(updates.where(F.col("ts") < now()))
    return telemetry.with_stale(latest, now()).select("worker", "stale")


# Loads folded with window functions: "held" is the newest loaded-or-missing row, up to and before the row.
LOADS_SQL = """
    SELECT l.*, last_value(CASE WHEN load <> 'error' THEN load || ':' || completed_task_count || ':' || phase END IGNORE NULLS)
                  OVER (PARTITION BY worker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS held,
           last_value(CASE WHEN load <> 'error' THEN load || ':' || completed_task_count END IGNORE NULLS)
                  OVER (PARTITION BY worker ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
    FROM {v_loads} l"""
_MORE = """(load = 'loaded' AND prior LIKE 'loaded:%' AND completed_task_count > CAST(split_part(prior, ':', 2) AS BIGINT))"""


@query("h5_completed_work", f"SELECT event_id FROM ({LOADS_SQL}) WHERE {_MORE}")
def completed_work(spark: SparkSession, sf: str) -> DataFrame:
    [loads] = load(spark, sf, "v_loads")
    return telemetry.completed_work(loads).select("event_id")


@query(
    "h6_processing_hint",
    f"""SELECT event_id, nullif(last_value(CASE WHEN load = 'loaded' AND phase IN ('error', 'stopped') THEN -1
                                     WHEN load = 'loaded' AND (phase = 'processing' OR has_task OR more) THEN epoch_us(ts) + 2000000 END
                                IGNORE NULLS) OVER (PARTITION BY worker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS hint_us
        FROM (SELECT *, coalesce({_MORE}, false) AS more FROM ({LOADS_SQL}))""",
)
def processing_hint(spark: SparkSession, sf: str) -> DataFrame:
    [loads] = load(spark, sf, "v_loads")
    return telemetry.processing_hint(loads).select("event_id", us("hint_until").alias("hint_us"))


@query(
    "h7_carry_valid",
    f"""SELECT event_id, CASE WHEN held LIKE 'loaded:%' THEN CAST(split_part(held, ':', 2) AS BIGINT) END AS completed_task_count,
               CASE WHEN held LIKE 'loaded:%' THEN split_part(held, ':', 3) END AS phase,
               CASE WHEN load = 'error' THEN 'Worker status file is invalid. invalid json' END AS warning
        FROM ({LOADS_SQL})""",
)
def carry_valid(spark: SparkSession, sf: str) -> DataFrame:
    [loads] = load(spark, sf, "v_loads")
    rows = telemetry.carry_valid(loads)
    return rows.select(
        "event_id", F.col("snapshot.completed_task_count").alias("completed_task_count"), F.col("snapshot.phase").alias("phase"), "warning"
    )


_STATUS_SQL = f"""CASE WHEN worker % 9 = 0 OR ts < TIMESTAMP '{_NOW}' - INTERVAL '120' SECOND THEN 'Inactive'
    WHEN phase = 'error' OR server_connection = 'disconnected' THEN 'Error'
    WHEN phase = 'processing' OR current_task_id IS NOT NULL THEN 'Processing'
    WHEN phase = 'starting' THEN 'Starting' ELSE 'Active' END"""


def _recent_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Every snapshot of the history, moved to the day of ``now`` for half of them so that both ages occur."""
    [updates] = load(spark, sf, "v_status")
    rows = telemetry.status_history(updates)
    moved = F.when(F.col("event_id") % 2 == 0, now() - F.expr("INTERVAL 30 SECONDS")).otherwise(F.col("last_updated_at"))
    return rows.withColumns({"last_updated_at": moved, "is_running": F.col("worker") % 9 != 0})


_RECENT_SQL = f"""SELECT * EXCLUDE ts, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '{_NOW}' - INTERVAL '30' SECOND ELSE ts END AS ts
                  FROM ({HISTORY_SQL})"""


@query("h8_visual_status", f"SELECT event_id, {_STATUS_SQL} AS status FROM ({_RECENT_SQL})")
def visual_status(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.classify_status(_recent_snapshots(spark, sf), now()).select("event_id", "status")


_LABEL = """CASE WHEN status_code IN (401, 403) THEN 'Invalid API key' WHEN status_code = 404 THEN 'Invalid API URL'
    WHEN status_code IN (408, 504) THEN 'Request timeout' WHEN status_code BETWEEN 500 AND 599 THEN 'Backend unavailable'
    WHEN attempt_ord % 4 = 0 THEN 'Request timeout' WHEN attempt_ord % 4 = 1 THEN 'Backend offline'
    WHEN attempt_ord % 4 = 2 THEN 'Invalid response' ELSE 'Request failed' END"""


def _error_log(spark: SparkSession, sf: str) -> DataFrame:
    [log] = load(spark, sf, "v_fetch_log")
    n = F.col("attempt_ord") % 4
    text = (
        F.when(n == 0, "http error: Operation TIMED OUT\nsecond line 404 not found").when(n == 1, "dns error: failed to lookup")
        .when(n == 2, "response decode error: x").otherwise("boom")
    )
    return log.withColumn("error", text)


@query("h9_error_labels", f"SELECT attempt_ord, {_LABEL} AS label FROM {{v_fetch_log}} l")
def error_labels(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.label_errors(_error_log(spark, sf)).select("attempt_ord", "label")


@query("h9_label_frequency", f"SELECT {_LABEL} AS label, count(*) AS n FROM {{v_fetch_log}} l GROUP BY 1")
def label_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.label_frequency(_error_log(spark, sf))


@query(
    "h10_top_notice",
    f"""SELECT worker, tone, text, pos FROM (
            SELECT *, row_number() OVER (PARTITION BY worker ORDER BY CASE tone WHEN 'danger' THEN 4 WHEN 'warning' THEN 3
                      WHEN 'neutral' THEN 2 ELSE 1 END DESC, pos) AS rn
            FROM (SELECT user_id AS worker, event_id AS pos, concat('n', event_id) AS text, ts,
                         CASE event_type WHEN 'error' THEN 'danger' WHEN 'purchase' THEN 'warning' WHEN 'view' THEN 'neutral' ELSE 'success' END AS tone
                  FROM {{events}})
            WHERE pos % 3 = 0 OR ts + INTERVAL '5' SECOND > TIMESTAMP '2024-01-15 00:00:00') WHERE rn = 1""",
)
def top_notice(spark: SparkSession, sf: str) -> DataFrame:
    [events] = load(spark, sf, "events")
    kind = F.col("event_type")
    tone = F.when(kind == "error", "danger").when(kind == "purchase", "warning").when(kind == "view", "neutral").otherwise("success")
    expires = F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr(f"INTERVAL {telemetry.NOTICE_TTL_SECONDS} SECONDS"))
    notices = events.select(
        F.col("user_id").alias("worker"), F.col("event_id").alias("pos"), F.concat(F.lit("n"), "event_id").alias("text"),
        tone.alias("tone"), expires.alias("expires_at"),
    )
    return telemetry.top_notice(notices, F.lit("2024-01-15 00:00:00").cast("timestamp"))


_SHORT = """CASE last_error WHEN 'api error (403): forbidden' THEN 'Invalid API key' WHEN 'http error: builder error' THEN 'Invalid API URL'
    WHEN 'operation timed out' THEN 'Request timeout' WHEN 'http error: error sending request for url' THEN 'Backend offline' END"""


@query(
    "h11_alert_rows",
    f"""SELECT event_id, CASE WHEN phase = 'error' THEN coalesce({_SHORT}, 'Worker error') ELSE coalesce({_SHORT}, 'Backend offline') END AS notice
        FROM ({_RECENT_SQL}) WHERE ts >= TIMESTAMP '{_NOW}' - INTERVAL '120' SECOND AND (phase = 'error' OR server_connection = 'disconnected')""",
)
def alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.alert_rows(_recent_snapshots(spark, sf), now()).select("event_id", "notice")


@query(
    "h12_version_reconcile",
    """SELECT c_custkey AS worker, CASE WHEN c_custkey % 3 = 0 OR o.v IS NULL OR o.v = '' THEN '0.1.0' ELSE o.v END AS installed_version
       FROM {customer} LEFT JOIN (SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE concat('1.', max(o_orderkey) % 7, '.0') END AS v
                                  FROM {orders} GROUP BY o_custkey) o ON c_custkey = o.o_custkey""",
)
def version_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    customers, orders = load(spark, sf, "customer", "orders")
    n = F.col("c_custkey")
    installs = customers.select(n.alias("worker"), (n % 3 != 0).alias("installed"), F.lit("0.1.0").alias("installed_version"))
    # A snapshot for each order, so most workers have several; the newest counts.
    version = F.concat(F.lit(" 1."), (F.col("o_orderkey") % 7).cast("string"), F.lit(".0 "))
    seen = orders.select(
        F.col("o_custkey").alias("worker"), F.when(F.col("o_custkey") % 5 == 0, F.lit("  ")).otherwise(version).alias("app_version"),
        F.timestamp_seconds("o_orderkey").alias("last_updated_at"),
    )
    return telemetry.reconcile_versions(installs, seen).select("worker", "installed_version")


@query(
    "h13_bounded_labels",
    r"""SELECT doc_id, left(text, 255) AS label, left(text, 1000) AS url, CASE WHEN length(d) > 140 THEN concat(left(d, 137), '...') ELSE d END AS detail
        FROM (SELECT doc_id, text, nullif(trim(regexp_replace(string_split(text, chr(10))[1], '[\s\p{Z}]+', ' ', 'g')), '') AS d FROM {documents})""",
)
def bounded_labels(spark: SparkSession, sf: str) -> DataFrame:
    [documents] = load(spark, sf, "documents")
    text = F.col("text")
    rows = documents.select("doc_id", text.alias("label"), text.alias("url"), text.alias("detail"))
    return telemetry.bounded_labels(rows, "label", "url", "detail")


@query(
    "h9_kind_labels",
    """SELECT attempt_ord, CASE WHEN error_kind = 'timeout' THEN 'Request timeout' WHEN error_kind = 'parse' THEN 'Request failed'
              WHEN status_code IN (401, 403) THEN 'Invalid API key' WHEN status_code = 404 THEN 'Invalid API URL'
              WHEN status_code BETWEEN 500 AND 599 AND status_code <> 504 THEN 'Backend unavailable' ELSE 'Request failed' END AS label
       FROM {v_fetch_log} l""",
)
def kind_labels(spark: SparkSession, sf: str) -> DataFrame:
    [log] = load(spark, sf, "v_fetch_log")
    return log.select(big("attempt_ord"), telemetry.kind_label(F.col("error_kind"), F.col("status_code")).alias("label"))
