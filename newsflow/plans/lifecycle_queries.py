"""The whole way of a task, from lease to signed request body."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.operators import fetch
from newsflow.plans import lifecycle
from newsflow.plans.embed_queries import API_KEY, PASSAGE_SQL, letter_share_model
from newsflow.plans.feed_queries import clean_sql
from newsflow.plans.inputs import load
from newsflow.plans.registry import joined, query

SIGNED_AT = "2024-01-01T00:00:00Z"
FAILS_EVERY = 97  # the stand-in model fails on passages of such lengths
MODEL_FAILURE = "model failed on a passage"
TASK_SIZE = 20


def failing_model() -> Callable[[np.ndarray], np.ndarray]:
    """The stand-in model, which fails on some lengths."""
    share = letter_share_model()

    def predict(texts: np.ndarray) -> np.ndarray:
        if any(len(t) % FAILS_EVERY == 0 for t in texts):
            raise RuntimeError(MODEL_FAILURE)
        return share(texts)

    return predict


def embedding_leases(documents: DataFrame) -> DataFrame:
    """Twenty neighbouring documents make a task; every eleventh payload is cut off."""
    n = F.col("doc_id")
    summary = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.lit(" \t ")).otherwise(F.col("text"))
    title = F.concat(F.lit("  "), F.col("source"), F.lit("\n  "), F.col("lang")).alias("title")
    source = F.struct(n.alias("id"), title, summary.alias("summary"), F.lit("u").alias("url"))
    held = documents.groupBy(F.floor(n / TASK_SIZE).alias("task_id")).agg(F.array_sort(F.collect_list(source)).alias("sources"))
    payload = F.to_json(F.struct(F.lit("j").alias("job_id"), F.lit("v1").alias("worker_version"), "sources"))
    task = F.col("task_id")
    text = task.cast("string")
    return held.select(
        "task_id", (task % 3).alias("execution_id"), F.concat(F.lit("lease-"), text).alias("lease_id"), F.lit("s1").alias("session_id"),
        text.alias("trace_id"), F.lit("embed.source").alias("task_type"), F.lit("v1").alias("worker_version"),
        F.when(task % 11 == 3, F.left(payload, F.lit(30))).otherwise(payload).alias("payload"),
    )


def _failure_sql(task_type: str = "embed.source") -> str:
    """The body of a signed failure; the pads of the constant key are literals."""
    key = hashlib.sha256(API_KEY.encode()).hexdigest().encode()
    inner, outer = (bytes(k ^ pad for k in key).hex() for pad in (0x36, 0x5C))
    head = """concat('{"error_message":"', error_message, '","lease_id":"lease-', task_id, '","nonce":"', md5(CAST(task_id AS VARCHAR)), '","session_id":"s1"')"""
    tail = f"""concat(',"signed_at":"{SIGNED_AT}","task_type":"{task_type}","trace_id":"', task_id, '","worker_version":"v1"}}')"""
    signature = f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(concat({head}, {tail})))))"
    return f"""concat({head}, ',"signature":"', {signature}, '"', {tail})"""


@query(
    "lifecycle_embedding_tasks",
    f"""WITH p AS (SELECT CAST(floor(id / {TASK_SIZE}) AS BIGINT) AS task_id, id, passage FROM ({PASSAGE_SQL})),
             t AS (SELECT task_id, task_id % 7 = 2 AS lost, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n,
                          round(sum(CAST(CAST(CAST(length(passage) - length(replace(passage, 'e', '')) AS DOUBLE) / length(passage) AS FLOAT) AS DOUBLE)), 5) AS share,
                          CASE WHEN task_id % 11 = 3 THEN '{lifecycle.UNREADABLE_TASK}'
                               WHEN bool_or(length(passage) % {FAILS_EVERY} = 0) THEN '{MODEL_FAILURE}' END AS error_message
                   FROM p GROUP BY task_id)
        SELECT task_id, task_id % 3 AS execution_id, CASE WHEN lost THEN concat('missing lease metadata for task ', task_id, ':', task_id % 3) END AS lease_error,
               error_message, CASE WHEN error_message IS NOT NULL AND NOT lost THEN {_failure_sql()} END AS failure_body,
               CASE WHEN error_message IS NULL AND NOT lost THEN n END AS n_sources,
               CASE WHEN error_message IS NULL AND NOT lost THEN ids END AS ids,
               CASE WHEN error_message IS NULL AND NOT lost THEN share END AS e_share
        FROM t""",
)
def embedding_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Lease payloads to signed completions and failures; some leases are lost before the result goes out."""
    [documents] = load(spark, sf, "documents")
    leases = embedding_leases(documents)
    _, results = lifecycle.embedding_tasks(leases, failing_model, 8)
    nonce = F.md5(F.col("task_id").cast("string"))
    held = leases.where("task_id % 7 <> 2")
    signed = lifecycle.sign_documents(results, held, F.lit(API_KEY), F.lit(SIGNED_AT), nonce, embedding=True)
    shape = "result_payload struct<sources: array<struct<id: bigint, embedding: array<double>>>>"
    sources = F.from_json("request_body", shape)["result_payload"]["sources"]
    rows = signed.select(
        "task_id", "execution_id", "lease_error", "error_message",
        F.when(F.col("error_message").isNotNull(), F.col("request_body")).alias("failure_body"), sources.alias("s"),
    )
    ids = F.transform("s", lambda s: s.id.cast("string"))
    share = F.aggregate("s", F.lit(0.0), lambda a, s: a + F.get(s.embedding, F.lit(1)))
    size = F.when(F.col("s").isNotNull(), F.size("s").cast("bigint"))
    return rows.select(
        "task_id", "execution_id", "lease_error", "error_message", "failure_body", size.alias("n_sources"),
        joined(ids, ",").alias("ids"), F.round(share, 5).alias("e_share"),
    )


# ---- feeds --------------------------------------------------------------------------------------
DATED = "<pubDate>Wed, 03 Jan 2024 10:00:00 GMT</pubDate>"


def feed_slots(pages: DataFrame) -> DataFrame:
    """Twenty neighbouring pages make a task, each page a feed."""
    task = F.floor(F.col("page_id") / TASK_SIZE)
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("page_id")) - 1
    slots = pages.select(task.alias("task_id"), (task % 3).alias("execution_id"), "page_id", "url", "html")
    return slots.withColumn("feed_index", place)


def feed_leases(slots: DataFrame) -> DataFrame:
    """The leases of the slots; every eleventh payload is cut off."""
    n, task = F.col("page_id"), F.col("task_id")
    feed = F.struct(
        n.alias("feed_id"), F.col("url").alias("feed_url"), F.when(n % 5 == 4, 0).otherwise(1).alias("fetchprotection"), F.lit("old").alias("etag")
    )
    feeds = F.transform(F.array_sort(F.collect_list(F.struct("feed_index", feed.alias("f")))), lambda x: x.f)
    held = slots.groupBy("task_id", "execution_id").agg(feeds.alias("feeds"))
    head = [F.lit("j").alias("job_id"), F.lit("2024-01-01T00:00:00Z").alias("requested_at"), F.lit(True).alias("ingest")]
    payload, text = F.to_json(F.struct(*head, "feeds")), task.cast("string")
    return held.select(
        "task_id", "execution_id", F.concat(F.lit("lease-"), text).alias("lease_id"), F.lit("s1").alias("session_id"),
        text.alias("trace_id"), F.lit("rss.fetch").alias("task_type"), F.lit("v1").alias("worker_version"),
        F.when(task % 11 == 3, F.left(payload, F.lit(30))).otherwise(payload).alias("payload"),
    )


def feed_body(url: Column, html: Column) -> Column:
    """The page as an entry, its copy under the URL in capitals, an entry without a title and one without a date."""

    def item(title: str, link: Column, text: Column, date: str = DATED) -> Column:
        inner = F.concat(F.lit("]]></link><description><![CDATA["), text, F.lit(f"]]></description>{date}</item>"))
        return F.concat(F.lit(f"<item><title>{title}</title><link><![CDATA[ "), link, inner)

    none = F.lit("")
    return F.concat(
        F.lit('<rss version="2.0"><channel><title>c</title>'), item("One", url, html), item("Copy", F.upper(url), none),
        item(" ", F.concat(url, F.lit("?3")), none), item("Four", F.concat(url, F.lit("?4")), none, ""), F.lit("</channel></rss>"),
    )


def feed_log(slots: DataFrame) -> DataFrame:
    """Landed attempts: served at the second try, not modified, refused and then served, no feed at all, none."""
    body, kind = feed_body(F.col("url"), F.col("html")), F.col("page_id") % 5
    none, date = F.lit(None).cast("string"), F.lit("Wed, 03 Jan 2024 10:00:00 GMT")

    def attempt(pos: int, strategy: int, no: int, code: int, error: Column = none, etag: Column = none, text: Column = none) -> Column:
        names = ("strategy_pos", "strategy", "attempt_no", "status_code", "error", "etag", "last_modified", "body")
        values = (*map(F.lit, (pos, strategy, no, code)), error, etag, date, text)
        return F.struct(*(v.alias(n) for v, n in zip(values, names)))

    fresh = F.concat(F.lit("e"), F.col("page_id").cast("string"))
    tries = (
        F.when(kind == 0, F.array(attempt(0, 1, 0, 503, F.lit("busy")), attempt(0, 1, 1, 200, none, fresh, body)))
        .when(kind == 1, F.array(attempt(0, 1, 0, 304, none, F.lit("same"))))
        .when(kind == 2, F.array(attempt(0, 1, 0, 404, F.lit("gone")), attempt(1, 2, 0, 200, none, none, body)))
        .when(kind == 3, F.array(attempt(0, 1, 0, 200, none, fresh, F.col("html"))))
    )
    rows = slots.select("task_id", "execution_id", "feed_index", F.inline(tries))
    return rows.withColumn("error_kind", none)


_FEED_OUTCOME = f"""CASE page_id % 5 WHEN 0 THEN concat('success:200::e', page_id, ':1') WHEN 1 THEN 'not_modified:304::same:1'
    WHEN 2 THEN 'success:200:::2' WHEN 3 THEN 'error:200:{lifecycle.UNREADABLE}:old:1' ELSE 'error::{fetch.BLOCKED_MESSAGE}:old:0' END"""


@query(
    "lifecycle_feed_tasks",
    f"""WITH p AS (SELECT CAST(floor(page_id / {TASK_SIZE}) AS BIGINT) AS task_id, page_id, url, page_id % 5 IN (0, 2) AS served,
                         {_FEED_OUTCOME} AS outcome, {clean_sql("html")} AS summary FROM {{pages}}),
             k AS (SELECT *, row_number() OVER (PARTITION BY task_id, lower(url) ORDER BY page_id) AS rn FROM p WHERE served),
             s AS (SELECT task_id, count(*) + sum(CASE WHEN upper(url) <> url THEN 1 ELSE 0 END) AS found, sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS kept,
                          string_agg(CASE WHEN rn = 1 THEN url END, ' ' ORDER BY page_id) AS urls,
                          md5(string_agg(CASE WHEN rn = 1 THEN coalesce(summary, '-') END, chr(10) ORDER BY page_id)) AS summaries
                   FROM k GROUP BY task_id),
             t AS (SELECT task_id, task_id % 7 = 2 AS lost, count(*) AS n, string_agg(concat(page_id, ':', outcome), '|' ORDER BY page_id) AS outcomes,
                          CASE WHEN task_id % 11 = 3 THEN '{lifecycle.UNREADABLE_TASK}' END AS error_message FROM p GROUP BY task_id)
        SELECT t.task_id, t.task_id % 3 AS execution_id, CASE WHEN lost THEN concat('missing lease metadata for task ', t.task_id, ':', t.task_id % 3) END AS lease_error,
               error_message, CASE WHEN error_message IS NOT NULL AND NOT lost THEN failure END AS failure_body,
               CASE WHEN fine THEN n END AS n_events, CASE WHEN fine THEN outcomes END AS outcomes,
               CASE WHEN fine THEN coalesce(urls, '') END AS urls, CASE WHEN fine THEN coalesce(summaries, md5('')) END AS summaries,
               CASE WHEN fine THEN CAST(coalesce(found, 0) AS BIGINT) END AS found, CASE WHEN fine THEN CAST(coalesce(kept, 0) AS BIGINT) END AS kept
        FROM (SELECT *, error_message IS NULL AND NOT lost AS fine, {_failure_sql("rss.fetch")} AS failure FROM t) t LEFT JOIN s ON s.task_id = t.task_id""",
)
def feed_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Lease payloads and landed fetches to signed completions and failures; some leases are lost on the way."""
    [pages] = load(spark, sf, "pages")
    slots = feed_slots(pages)
    leases = feed_leases(slots)
    done = lifecycle.feed_tasks(leases, feed_log(slots))
    nonce = F.md5(F.col("task_id").cast("string"))
    signed = lifecycle.sign_documents(done.documents, leases.where("task_id % 7 <> 2"), F.lit(API_KEY), F.lit(SIGNED_AT), nonce)
    source = "sources: array<struct<url: string, summary: string>>"
    event = f"feed_id: bigint, status: string, status_code: int, error_message: string, new_etag: string, resolved_fetchprotection: int, {source}"
    counts = "local_dedup: struct<input_candidates: bigint, output_candidates: bigint>"
    parsed = F.from_json("request_body", f"result_payload struct<result_events: array<struct<{event}>>, {counts}>")["result_payload"]
    failed = F.col("error_message").isNotNull()
    rows = signed.select(
        "task_id", "execution_id", "lease_error", "error_message", F.when(failed, F.col("request_body")).alias("failure_body"), parsed.alias("p")
    )
    events = F.col("p.result_events")
    shown = ("feed_id", "status", "status_code", "error_message", "new_etag", "resolved_fetchprotection")
    outcomes = F.transform(events, lambda e: F.concat_ws(":", *(F.coalesce(e[c].cast("string"), F.lit("")) for c in shown)))
    sources = F.flatten(F.transform(events, lambda e: e.sources))
    summaries = F.transform(sources, lambda s: F.coalesce(s.summary, F.lit("-")))
    return rows.select(
        "task_id", "execution_id", "lease_error", "error_message", "failure_body",
        F.when(events.isNotNull(), F.size(events)).cast("bigint").alias("n_events"), joined(outcomes).alias("outcomes"),
        joined(F.transform(sources, lambda s: s.url), " ").alias("urls"), F.md5(joined(summaries, "\n")).alias("summaries"),
        F.col("p.local_dedup.input_candidates").alias("found"), F.col("p.local_dedup.output_candidates").alias("kept"),
    )
