"""Derived inputs: the given tables in the shapes the operators read.

Each statement is plain SQL that Spark and DuckDB both run; table names stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS = {
    "v_entries": """
        SELECT page_id % 20 AS feed_id, page_id * 10 AS entry_pos, concat('  ', url, ' ') AS link,
               CASE WHEN page_id % 11 = 0 THEN '   ' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
               html AS summary,
               CASE WHEN page_id % 7 = 0 THEN NULL
                    ELSE TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' HOUR END AS published
        FROM {pages}
        UNION ALL
        SELECT page_id % 20, page_id * 10 + 1, url, 'copy', html, TIMESTAMP '2024-02-01 00:00:00'
        FROM {pages} WHERE page_id % 4 = 0""",
    "v_marks": """
        SELECT page_id % 20 AS feed_id,
               min(CASE WHEN page_id % 20 % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-02 00:00:00' + page_id * INTERVAL '1' HOUR END)
               AS last_db_article_published_at
        FROM {pages} GROUP BY page_id % 20""",
    "v_sources": """
        SELECT page_id % 10 AS task_id, page_id % 3 AS execution_id, page_id % 30 AS feed_index, page_id AS source_pos, url
        FROM {pages}
        UNION ALL
        SELECT page_id % 10, page_id % 3, page_id % 30 + 1, page_id + 100000, upper(url) FROM {pages} WHERE page_id % 3 = 0""",
    "v_feeds": """
        SELECT page_id AS feed_id, url AS feed_url, CAST(page_id % 4 AS INT) AS fetchprotection, page_id % 9 <> 0 AS ingest,
               CASE page_id % 5 WHEN 0 THEN 'News.Example.COM' WHEN 1 THEN '' ELSE NULL END AS host_header,
               CASE WHEN page_id % 2 = 0 THEN concat('"e', page_id, '"') END AS etag,
               CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-01-01 08:05:09' + page_id * INTERVAL '1' HOUR END AS last_update
        FROM {pages}""",
    "v_fetch_log": """
        SELECT user_id AS feed_id, event_id AS attempt_ord, ts, 1 + event_id % 2 AS strategy,
               CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 304 WHEN 'error' THEN 503 WHEN 'purchase' THEN 429
                    ELSE CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 403 ELSE 404 END END AS status_code,
               CASE WHEN event_type = 'signup' AND event_id % 3 = 0
                    THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'parse' END END AS error_kind,
               concat('attempt ', event_id, ' failed') AS error,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('"v', event_id, '"') END AS etag,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Wed, 03 Jan 2024 10:00:00 GMT' END AS last_modified,
               TIMESTAMP '2024-01-02 00:00:00' AS feed_updated
        FROM {events}""",
    "v_task_feeds": """
        SELECT l_orderkey AS task_id, l_orderkey % 3 AS execution_id, l_orderkey % 100 AS job_id,
               l_linenumber - 1 AS feed_index, l_suppkey AS feed_id, concat('https://s', l_suppkey, '.example/rss') AS feed_url,
               concat('s', l_suppkey % 50, '.example') AS host_key, l_returnflag <> 'R' AS done,
               CASE WHEN l_returnflag <> 'R' THEN 'done' WHEN l_linenumber % 5 = 0 THEN 'active' ELSE 'pending' END AS state
        FROM {lineitem}""",
    "v_leases": """
        SELECT o_orderkey AS task_id, o_custkey % 3 AS execution_id, o_custkey AS session_id,
               concat('lease-', o_orderkey) AS lease_id, o_orderdate + INTERVAL '1' HOUR AS expires_at
        FROM {orders}""",
    "v_status": """
        SELECT user_id AS worker, event_id, ts,
               CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'transfer' WHEN 'error' THEN 'error'
                    WHEN 'purchase' THEN 'completed'
                    ELSE CASE WHEN event_id % 3 = 0 THEN 'disconnected' WHEN event_id % 3 = 1 THEN 'connected' ELSE 'idle' END
                    END AS op,
               CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS bytes_received,
               CASE event_id % 5 WHEN 0 THEN 'api error (403): forbidden' WHEN 1 THEN 'http error: builder error'
                    WHEN 2 THEN 'operation timed out' WHEN 3 THEN 'http error: error sending request for url' ELSE 'boom' END
               AS error,
               event_id AS task_id
        FROM {events}""",
    "v_loads": """
        SELECT user_id AS worker, event_id, ts,
               CASE WHEN event_id % 7 = 3 THEN 'error' WHEN event_id % 11 = 5 THEN 'missing' ELSE 'loaded' END AS load,
               CASE event_type WHEN 'view' THEN 'processing' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'stopped'
                    ELSE 'idle' END AS phase,
               event_type = 'view' AS has_task, CAST(floor(value) AS BIGINT) % 20 AS completed_task_count,
               'Worker status file is invalid.' AS prefix, '  invalid   json' AS detail
        FROM {events}""",
    "v_releases": """
        SELECT 'family' AS family, concat('p', p_size) AS product,
               CASE WHEN p_partkey % 2 = 0 THEN 'linux' ELSE 'macos' END AS platform, 'x86_64' AS arch,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'cuda12' END AS runtime_bundle,
               CASE WHEN p_partkey % 13 = 0 THEN ''
                    ELSE concat('bundle-', p_partkey % 3, '.', p_partkey % 12, '.', p_partkey % 10, '.tar.gz') END AS artifact_name,
               concat('store/', p_partkey) AS storage_relative_path,
               concat(p_partkey % 3, '.', p_partkey % 12, '.', p_partkey % 10) AS latest_version, p_partkey
        FROM {part}""",
}


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Tables or derived views as DataFrames."""
    return [_one(spark, sf_dir, name) for name in names]


def _one(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in VIEWS:
        used = {t: _one(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
        return spark.sql(VIEWS[name], **used)
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in table.schema if f.dataType.simpleString() == "timestamp_ntz"]
    table = table.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else table
    return table


def view_sql(name: str) -> str:
    """The view for DuckDB, as a subquery."""
    return "(" + VIEWS[name].format(**{t: t for t in TABLES}) + ")"
