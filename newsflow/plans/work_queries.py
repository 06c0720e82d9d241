"""Queries over fetch planning, fetch outcomes, tasks and leases (groups D, E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.operators import fetch, tasks
from newsflow.plans.inputs import load
from newsflow.plans.registry import big, joined, query, us

SIX_HOURS_US = 6 * 3_600_000_000
_PLAN = """SELECT f.*, CAST(s.pos AS BIGINT) AS strategy_pos, CAST(s.strategy AS BIGINT) AS strategy, CAST(a.n AS BIGINT) AS attempt_no FROM {v_feeds} f
    JOIN (VALUES (0, true, 0, 0), (0, false, 0, 0), (1, true, 0, 1), (1, true, 1, 2), (2, true, 0, 2), (2, true, 1, 1),
                 (3, true, 0, 3), (1, false, 0, 1), (1, false, 1, 2), (2, false, 0, 1), (2, false, 1, 2), (3, false, 0, 1),
                 (3, false, 1, 2)) s(p, g, pos, strategy) ON f.fetchprotection = s.p AND f.ingest = s.g
    JOIN (VALUES (0), (1)) a(n) ON s.strategy <> 0 OR a.n = 0"""


@query(
    "d1_strategy_plan",
    f"SELECT feed_id, strategy_pos, strategy, attempt_no, attempt_no * 250 AS backoff_ms FROM ({_PLAN})",
)
def strategy_plan(spark: SparkSession, sf: str) -> DataFrame:
    [feeds] = load(spark, sf, "v_feeds")
    rows = fetch.plan_attempts(feeds)
    return rows.select("feed_id", big("strategy_pos"), big("strategy"), big("attempt_no"), big("backoff_ms"))


@query(
    "d2_request_plan",
    f"""SELECT feed_id, strategy, attempt_no, CASE WHEN strategy = 2 THEN host_header END AS host,
               CASE WHEN strategy = 2 AND host_header IS NOT NULL THEN concat('https://', host_header) END AS origin,
               CASE WHEN strategy = 2 AND host_header IS NOT NULL THEN concat('https://', host_header, '/') END AS referer,
               etag AS if_none_match, strftime(last_update, '%a, %d %b %Y %H:%M:%S GMT') AS if_modified_since,
               CAST(4 AS BIGINT) + CASE WHEN strategy = 2 AND host_header IS NOT NULL THEN 3 ELSE 0 END
                 + CASE WHEN etag IS NULL THEN 0 ELSE 1 END + CASE WHEN last_update IS NULL THEN 0 ELSE 1 END AS n_headers
        FROM ({_PLAN}) WHERE strategy <> 0""",
)
def request_plan(spark: SparkSession, sf: str) -> DataFrame:
    [feeds] = load(spark, sf, "v_feeds")
    rows = fetch.plan_requests(feeds)

    def header(name: str, alias: str) -> Column:
        return F.try_element_at("headers", F.lit(name)).alias(alias)

    return rows.select(
        "feed_id", big("strategy"), big("attempt_no"), header("Host", "host"), header("Origin", "origin"),
        header("Referer", "referer"), header("If-None-Match", "if_none_match"),
        header("If-Modified-Since", "if_modified_since"), F.size("headers").cast("bigint").alias("n_headers"),
    )


_OUTCOME = """CASE WHEN status_code = 304 THEN 'not_modified'
                   WHEN status_code IN (408, 429, 500, 502, 503, 504) THEN 'transient'
                   WHEN status_code BETWEEN 200 AND 299 AND error_kind IS NULL THEN 'success'
                   WHEN status_code IS NULL AND error_kind = 'timeout' THEN 'transient' ELSE 'permanent' END"""


@query("d3_classify_attempts", f"SELECT attempt_ord, {_OUTCOME} AS outcome FROM {{v_fetch_log}} l")
def classify_attempts(spark: SparkSession, sf: str) -> DataFrame:
    [log] = load(spark, sf, "v_fetch_log")
    return fetch.classify_attempts(log).select("attempt_ord", "outcome")


_RESOLVED = f"""SELECT f.*, coalesce(g.o, b.o) AS chosen FROM {{v_feeds}} f
    LEFT JOIN (SELECT feed_id, min(attempt_ord) AS o FROM (SELECT *, {_OUTCOME} AS outcome FROM {{v_fetch_log}} l)
               WHERE outcome IN ('success', 'not_modified') GROUP BY feed_id) g ON f.feed_id = g.feed_id
    LEFT JOIN (SELECT feed_id, max(attempt_ord) AS o FROM (SELECT *, {_OUTCOME} AS outcome FROM {{v_fetch_log}} l)
               WHERE outcome NOT IN ('success', 'not_modified') GROUP BY feed_id) b ON f.feed_id = b.feed_id"""


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    feeds, log = load(spark, sf, "v_feeds", "v_fetch_log")
    log = log.withColumns({"etag": F.when(F.col("attempt_ord") % 2 == 0, F.col("etag"))})
    return fetch.resolve_outcomes(feeds, fetch.classify_attempts(log), ["feed_id"], ["attempt_ord"])


@query("d4_resolve_outcome", f"SELECT feed_id, chosen AS attempt_ord FROM ({_RESOLVED})")
def resolve_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("feed_id", F.col("attempt.attempt_ord").alias("attempt_ord"))


_RESULTS = f"""
    SELECT r.feed_id, status, CAST(CASE WHEN fetchprotection <> 0 THEN status_code END AS BIGINT) AS status_code,
           CASE WHEN fetchprotection = 0 THEN 'Blocked by fetch protection'
                WHEN chosen IS NULL THEN 'No fetch strategy available' WHEN status = 'error' THEN error END AS error_message,
           CASE WHEN status = 'error' THEN etag ELSE log_etag END AS new_etag,
           CASE WHEN status = 'error' THEN epoch_us(last_update) WHEN lm IS NOT NULL THEN 1704276000000000
                WHEN status = 'success' THEN 1704153600000000 END AS new_last_update_us,
           CASE WHEN fetchprotection = 0 THEN 0 WHEN chosen IS NULL THEN fetchprotection ELSE strategy END AS resolved_fetchprotection
    FROM (SELECT f.*, l.status_code, l.error, l.log_etag, l.lm, l.strategy,
                 CASE WHEN fetchprotection = 0 OR outcome IS NULL OR outcome NOT IN ('success', 'not_modified') THEN 'error'
                      ELSE outcome END AS status
          FROM ({_RESOLVED}) f
          LEFT JOIN (SELECT attempt_ord, status_code, error, last_modified AS lm, strategy, {_OUTCOME} AS outcome,
                            CASE WHEN attempt_ord % 2 = 0 THEN etag END AS log_etag FROM {{v_fetch_log}} l) l
                 ON f.chosen = l.attempt_ord) r"""


@query("d5_shape_results", _RESULTS)
def shape_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = fetch.shape_results(_resolved(spark, sf))
    return rows.select(
        "feed_id", "status", big("status_code"), "error_message", "new_etag",
        us("new_last_update").alias("new_last_update_us"), big("resolved_fetchprotection"),
    )


@query(
    "d6_refresh_feed_state",
    """SELECT f.feed_id, CASE WHEN l.feed_id IS NULL THEN f.etag ELSE l.etag END AS etag,
              epoch_us(CASE WHEN l.feed_id IS NULL THEN f.last_update ELSE l.ts END) AS last_update_us
       FROM {v_feeds} f LEFT JOIN (
           SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY ts DESC, attempt_ord DESC) AS rn FROM {v_fetch_log} l
       ) l ON f.feed_id = l.feed_id AND l.rn = 1""",
)
def refresh_feed_state(spark: SparkSession, sf: str) -> DataFrame:
    feeds, log = load(spark, sf, "v_feeds", "v_fetch_log")
    results = log.select("feed_id", "ts", "attempt_ord", F.col("etag").alias("new_etag"), F.col("ts").alias("new_last_update"))
    rows = fetch.refresh_feed_state(feeds, results, ["ts", "attempt_ord"])
    return rows.select("feed_id", "etag", us("last_update").alias("last_update_us"))


_HOST = r"""coalesce(nullif(lower(regexp_extract(trim(host_header), '^(?:[a-zA-Z]+://)?([^/:?#]+)', 1)), ''),
                     nullif(lower(regexp_extract(feed_url, '^[a-zA-Z]+://([^/:?#]+)', 1)), ''), concat('feed:', feed_id))"""


@query("d7_host_key", f"SELECT feed_id, {_HOST} AS host_key FROM {{v_feeds}} f")
def host_key(spark: SparkSession, sf: str) -> DataFrame:
    [feeds] = load(spark, sf, "v_feeds")
    return fetch.with_host_key(feeds).select("feed_id", "host_key")


RATE_SQL = f"""
    SELECT event_id, i * {SIX_HOURS_US} + max(a - i * {SIX_HOURS_US})
             OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS slot_us
    FROM (SELECT event_id, user_id, epoch_us(ts) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
          FROM {{events}})"""


@query("d8_rate_slots", RATE_SQL)
def rate_slots(spark: SparkSession, sf: str) -> DataFrame:
    [events] = load(spark, sf, "events")
    rows = fetch.assign_rate_slots(events, "user_id", "ts", "event_id", SIX_HOURS_US, segment_us=24 * 3_600_000_000)
    return rows.select("event_id", "slot_us")


@query(
    "d9_next_admissions",
    """WITH p AS (SELECT host_key, task_id, feed_index, row_number() OVER (PARTITION BY host_key ORDER BY task_id, feed_index) AS rn
                  FROM {v_task_feeds} f WHERE state = 'pending'),
            a AS (SELECT host_key, 1 AS n FROM {v_task_feeds} f WHERE state = 'active' GROUP BY host_key)
       SELECT p.host_key, task_id, CAST(feed_index AS BIGINT) AS feed_index FROM p LEFT JOIN a ON p.host_key = a.host_key
       WHERE rn <= 3 - coalesce(n, 0) ORDER BY p.host_key, task_id, feed_index LIMIT 40""",
)
def next_admissions(spark: SparkSession, sf: str) -> DataFrame:
    """What to start next, with one feed running on every host that has an active slot."""
    [slots] = load(spark, sf, "v_task_feeds")
    pending = slots.where(F.col("state") == "pending")
    active = slots.where(F.col("state") == "active").select("host_key").distinct()
    rows = fetch.next_admissions(pending, active, ["task_id", "feed_index"], per_host=3, free_slots=40)
    return rows.select("host_key", "task_id", big("feed_index"))


# ---- tasks --------------------------------------------------------------------------------------
_KEYED = """SELECT *, lower(trim(url)) AS dedup_key,
                   row_number() OVER (PARTITION BY task_id, execution_id, lower(trim(url)) ORDER BY feed_index, source_pos) AS rn
            FROM {v_sources} s"""


@query(
    "e1_task_dedup",
    f"SELECT task_id, execution_id, feed_index, source_pos, url FROM ({_KEYED}) WHERE rn = 1",
)
def task_dedup(spark: SparkSession, sf: str) -> DataFrame:
    [sources] = load(spark, sf, "v_sources")
    return tasks.dedup_sources(sources).select("task_id", "execution_id", "feed_index", "source_pos", "url")


@query(
    "e2_dedup_groups",
    f"""SELECT task_id, execution_id, dedup_key, 'same_url' AS reason, kept_url, feed_index, source_pos, url AS dropped_url
        FROM (SELECT *, first_value(url) OVER (PARTITION BY task_id, execution_id, dedup_key ORDER BY rn) AS kept_url FROM ({_KEYED}))
        WHERE rn > 1""",
)
def dedup_groups(spark: SparkSession, sf: str) -> DataFrame:
    [sources] = load(spark, sf, "v_sources")
    return tasks.dedup_groups(sources)


@query(
    "e3_dedup_counts",
    """SELECT task_id, execution_id, count(*) AS input_candidates, count(DISTINCT lower(trim(url))) AS output_candidates,
              count(*) - count(DISTINCT lower(trim(url))) AS duplicates_dropped FROM {v_sources} s GROUP BY task_id, execution_id""",
)
def dedup_counts(spark: SparkSession, sf: str) -> DataFrame:
    [sources] = load(spark, sf, "v_sources")
    return tasks.dedup_counts(sources)


_PROGRESS = """SELECT task_id, execution_id, min(job_id) AS job_id, count(*) AS total_feeds,
                      CAST(sum(CASE WHEN done THEN 1 ELSE 0 END) AS BIGINT) AS completed_feeds
               FROM {v_task_feeds} f GROUP BY task_id, execution_id"""


@query(
    "e4_task_progress",
    f"""SELECT *, total_feeds - completed_feeds AS remaining_feeds,
               concat('job ', job_id, ' [', completed_feeds, ' / ', total_feeds, ' feeds]') AS label FROM ({_PROGRESS})""",
)
def task_progress(spark: SparkSession, sf: str) -> DataFrame:
    [slots] = load(spark, sf, "v_task_feeds")
    return tasks.task_progress(slots)


@query(
    "e5_assemble_results",
    """SELECT task_id, execution_id, CAST(feed_index AS BIGINT) AS feed_index, feed_id
       FROM (SELECT *, bool_and(done) OVER (PARTITION BY task_id, execution_id) AS complete FROM {v_task_feeds} f) WHERE complete""",
)
def assemble_results(spark: SparkSession, sf: str) -> DataFrame:
    [slots] = load(spark, sf, "v_task_feeds")
    return tasks.assemble_results(slots).select("task_id", "execution_id", big("feed_index"), "feed_id")


@query(
    "e6_completeness_audit",
    """WITH slots AS (SELECT DISTINCT task_id, execution_id, feed_index FROM {v_task_feeds} f),
            done AS (SELECT task_id, execution_id, feed_index FROM {v_task_feeds} f WHERE done),
            r AS (SELECT * FROM done UNION ALL SELECT * FROM done WHERE feed_index = 0 AND task_id % 4 = 0
                  UNION ALL SELECT task_id, execution_id, feed_index + 50 FROM slots WHERE feed_index = 1 AND task_id % 5 = 0
                  UNION ALL SELECT -task_id, execution_id, feed_index FROM slots WHERE feed_index = 0 AND task_id % 6 = 0),
            d AS (SELECT task_id, execution_id, feed_index, count(*) AS n FROM r GROUP BY ALL)
       SELECT task_id, execution_id, CAST(feed_index AS BIGINT) AS feed_index, 'completed_twice' AS issue FROM d WHERE n > 1
       UNION ALL SELECT task_id, execution_id, feed_index, CASE WHEN feed_index >= 50 THEN 'missing_slot' ELSE 'unknown_task' END
       FROM d WHERE feed_index >= 50 OR task_id < 0
       UNION ALL (SELECT task_id, execution_id, feed_index, 'missing_result' FROM slots
                  EXCEPT SELECT task_id, execution_id, feed_index, 'missing_result' FROM r)""",
)
def completeness_audit(spark: SparkSession, sf: str) -> DataFrame:
    [rows] = load(spark, sf, "v_task_feeds")
    slot = ["task_id", "execution_id", "feed_index"]
    slots, done = rows.select(slot).distinct(), rows.where("done").select(slot)
    twice = done.where("feed_index = 0 AND task_id % 4 = 0")
    stray = slots.where("feed_index = 1 AND task_id % 5 = 0").withColumn("feed_index", F.col("feed_index") + 50)
    unknown = slots.where("feed_index = 0 AND task_id % 6 = 0").withColumn("task_id", -F.col("task_id"))
    found = tasks.audit_completeness(slots, done.union(twice).union(stray).union(unknown))
    return found.select("task_id", "execution_id", big("feed_index"), "issue")


@query(
    "e7_queue_totals",
    f"""WITH t AS (SELECT * FROM ({_PROGRESS}) WHERE completed_feeds < total_feeds),
             s AS (SELECT f.* FROM {{v_task_feeds}} f JOIN t ON f.task_id = t.task_id AND f.execution_id = t.execution_id),
             g AS (SELECT count(*) AS n, CAST(sum(total_feeds) AS BIGINT) AS feeds_claimed FROM t),
             q AS (SELECT count(*) AS feeds_queued FROM s WHERE state = 'pending'),
             h AS (SELECT * FROM t ORDER BY task_id, execution_id LIMIT 1),
             c AS (SELECT feed_id, feed_url FROM s WHERE state IN ('active', 'pending')
                   ORDER BY state, host_key, task_id, execution_id, feed_index LIMIT 1)
        SELECT true AS active, 'processing' AS connection_state, n + 2 AS pending_tasks, h.task_id AS current_task_id,
               h.execution_id AS current_execution_id,
               concat('job ', job_id, ' [', completed_feeds, ' / ', total_feeds, ' feeds] | ', n, ' rss task(s), ', feeds_claimed,
                      ' feeds, ', feeds_queued, ' queued') AS current_task_label,
               c.feed_id AS current_feed_id, c.feed_url AS current_feed_url, feeds_claimed, feeds_queued, 'running' AS desired_state
        FROM g, q, h, c""",
)
def queue_totals(spark: SparkSession, sf: str) -> DataFrame:
    [slots] = load(spark, sf, "v_task_feeds")
    return tasks.queue_totals(slots, pending_completions=2)


@query(
    "e8_lease_lookup",
    """SELECT f.task_id, f.execution_id, CAST(f.feed_index AS BIGINT) AS feed_index, l.lease_id,
              CASE WHEN l.task_id IS NULL THEN concat('missing lease metadata for task ', f.task_id, ':', f.execution_id) END AS lease_error
       FROM {v_task_feeds} f LEFT JOIN {v_leases} l ON f.task_id = l.task_id AND f.execution_id = l.execution_id""",
)
def lease_lookup(spark: SparkSession, sf: str) -> DataFrame:
    slots, leases = load(spark, sf, "v_task_feeds", "v_leases")
    rows = tasks.attach_leases(slots, leases)
    return rows.select("task_id", "execution_id", big("feed_index"), "lease_id", "lease_error")


@query(
    "e8_release_leases",
    """SELECT l.task_id, l.execution_id, l.lease_id FROM {v_leases} l WHERE NOT EXISTS (
           SELECT 1 FROM {v_task_feeds} f WHERE f.task_id = l.task_id AND f.execution_id = l.execution_id)""",
)
def release_leases(spark: SparkSession, sf: str) -> DataFrame:
    slots, leases = load(spark, sf, "v_task_feeds", "v_leases")
    return tasks.release_leases(leases, slots).select("task_id", "execution_id", "lease_id")


@query(
    "e9_usable_sessions",
    """SELECT task_id, session_id, epoch_us(expires_at) AS expires_us FROM {v_leases} l
       WHERE expires_at > TIMESTAMP '1996-01-01 00:00:00' + INTERVAL '60' SECOND""",
)
def usable_sessions(spark: SparkSession, sf: str) -> DataFrame:
    [leases] = load(spark, sf, "v_leases")
    rows = tasks.usable_sessions(leases, F.lit("1996-01-01 00:00:00").cast("timestamp"))
    return rows.select("task_id", "session_id", us("expires_at").alias("expires_us"))


@query(
    "e10_changed_states",
    """SELECT event_id FROM (
           SELECT event_id, op, task_id % 2 AS k, row_number() OVER w AS rn, lag(op) OVER w AS p, lag(task_id % 2) OVER w AS pk
           FROM {v_status} s WINDOW w AS (PARTITION BY worker ORDER BY ts, event_id))
       WHERE rn = 1 OR op <> p OR k <> pk""",
)
def changed_states(spark: SparkSession, sf: str) -> DataFrame:
    [status] = load(spark, sf, "v_status")
    none = F.lit(None).cast("string")
    states = status.select(
        "worker", "ts", "event_id", F.lit(True).alias("active"), F.col("op").alias("connection_state"),
        F.lit(1).alias("pending_tasks"), (F.col("task_id") % 2).alias("current_task_id"), F.lit(1).alias("current_execution_id"),
        none.alias("last_error"), F.lit("running").alias("desired_state"), F.concat(F.lit("job "), "event_id").alias("current_task_label"),
    )
    return tasks.changed_states(states).select("event_id")


@query(
    "e11_claim_size",
    f"SELECT greatest(20000 - (count(*) + 2), 0) AS free_slots FROM ({_PROGRESS}) WHERE completed_feeds < total_feeds",
)
def claim_size(spark: SparkSession, sf: str) -> DataFrame:
    [slots] = load(spark, sf, "v_task_feeds")
    return tasks.claim_size(slots, max_tasks=20000, pending_completions=2).select(big("free_slots"))


@query(
    "h14_error_flags",
    """SELECT attempt_ord, coalesce(error_kind IN ('timeout', 'connect', 'body', 'request'), false) AS network_error,
              coalesce(status_code IN (401, 403), false) AS auth_error FROM {v_fetch_log} l""",
)
def error_flags(spark: SparkSession, sf: str) -> DataFrame:
    [log] = load(spark, sf, "v_fetch_log")
    return fetch.flag_errors(log).select("attempt_ord", "network_error", "auth_error")
