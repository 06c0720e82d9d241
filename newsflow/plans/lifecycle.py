"""The whole way of a task, from its lease to its signed result documents."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.canonical import EXPONENT_SIGN, PRESERVE
from newsflow.operators import embed, entries, fetch, integrity, tasks
from newsflow.sources import readers, sinks

SLOT = [*tasks.TASK, "feed_index"]
ATTEMPT = [*SLOT, "strategy_pos", "attempt_no"]
UNREADABLE = "feed document cannot be read"
UNREADABLE_TASK = "task payload cannot be read"


class FeedTasks(NamedTuple):
    """What finished feed tasks give: per-feed results, their sources, the tasks' result documents.

    A document row holds the task, and ``payload`` or ``error_message``.
    """

    results: DataFrame
    sources: DataFrame
    documents: DataFrame


def feed_tasks(leases: DataFrame, fetch_log: DataFrame) -> FeedTasks:
    """Leases and their landed fetch attempts -> results, sources and result documents.

    ``fetch_log``: task_id, execution_id, feed_index, strategy_pos, strategy, attempt_no, status_code,
    error_kind, error, etag, last_modified, body. A landed body that is no feed makes its attempt a permanent failure,
    so that the next strategy can win and the feed keeps its etag. Bodies are left out while outcomes are resolved;
    the parsed feeds are joined back for the successful attempts alone.
    """
    decoded = readers.decode_feed_tasks(leases.select(*tasks.TASK, "payload"))
    feeds = decoded.where(~F.col("decode_error"))
    landed_ok = F.col("body").isNotNull() & F.col("status_code").between(200, 299)
    parsed = readers.with_feed(fetch_log.withColumn("landed", landed_ok))
    unreadable = F.col("landed") & ~F.coalesce(F.col("feed.readable"), F.lit(False))
    light = parsed.withColumns(
        {
            "error_kind": F.when(unreadable, "parse").otherwise(F.col("error_kind")),
            "error": F.when(unreadable, UNREADABLE).otherwise(F.col("error")),
            "feed_updated": F.col("feed.updated"),
        }
    )
    light = fetch.classify_attempts(light.drop("feed", "landed"))
    dated = fetch.resolve_outcomes(feeds, light, SLOT, ["strategy_pos", "attempt_no"])

    won = (F.col("attempt.outcome") == "success") & (F.col("fetchprotection") != fetch.BLOCKED)
    winners = dated.where(won).select(
        *SLOT, "feed_id", "last_db_article_published_at", "attempt.strategy_pos", "attempt.attempt_no"
    )
    landed = winners.join(parsed.select(*ATTEMPT, "feed"), ATTEMPT).drop("strategy_pos", "attempt_no")
    sources = entries.assemble_sources(readers.feed_entries(landed), None, SLOT)
    results = fetch.shape_results(dated)
    shown = results.select(
        *SLOT, "job_id", "ingest", "feed_id", "feed_url", "status", "status_code", "error_message", "new_etag",
        "new_last_update", "fetchprotection", "resolved_fetchprotection",
    )
    documents = sinks.task_result_payloads(shown, sources).withColumn("error_message", F.lit(None).cast("string"))
    return FeedTasks(shown, sources, documents.unionByName(_unreadable(decoded)))


def _unreadable(decoded: DataFrame) -> DataFrame:
    """The tasks whose payload cannot be read, as failures."""
    none, message = F.lit(None).cast("string").alias("payload"), F.lit(UNREADABLE_TASK).alias("error_message")
    return decoded.where("decode_error").select(*tasks.TASK, none, message)


def embedding_tasks(
    leases: DataFrame, make_model: Callable, batch_size: int = 32
) -> tuple[DataFrame, DataFrame]:
    """Leases -> (vectors per source, result documents per task).

    A task whose payload cannot be read, or on one of whose batches the model fails, gives no vectors but a document row
    with ``error_message``; batches hold sources of one task only, so the other tasks go on. Vectors and documents are
    both cut from the same inference: read the vectors off the documents where it must not run twice.
    """
    decoded = readers.decode_embedding_tasks(leases.select(*tasks.TASK, "payload"))
    sources = decoded.where(~F.col("decode_error"))
    made = embed.embed(embed.with_passage(sources), make_model, batch_size, error="error", within=tasks.TASK)
    wide = made.select(*tasks.TASK, "source_pos", "id", F.col("embedding").cast("array<double>").alias("embedding"), "error")
    documents = sinks.embedding_payloads(wide, "error")
    failed = documents.where("error_message IS NOT NULL").select(*tasks.TASK)
    vectors = wide.drop("error").join(failed, tasks.TASK, "left_anti")
    return vectors, documents.unionByName(_unreadable(decoded))


def sign_documents(
    documents: DataFrame, leases: DataFrame, api_key: Column, signed_at: Column, nonce: Column, embedding: bool = False
) -> DataFrame:
    """Result documents as signed request bodies: completions, and failures where ``error_message`` holds one.

    Documents without a lease carry ``lease_error`` and no body.
    """
    held = leases.select(*tasks.TASK, *integrity.LEASE_FIELDS)
    rows = tasks.attach_leases(documents.withColumnRenamed("payload", "result_payload"), held)
    stamped = rows.withColumns({"signed_at": signed_at, "nonce": nonce})
    error = "error_message" if "error_message" in documents.columns else None
    signed = integrity.sign_payloads(stamped, api_key, mode=EXPONENT_SIGN if embedding else PRESERVE, error=error)
    body = F.when(F.col("lease_error").isNull(), F.col("request_body"))
    return signed.withColumn("request_body", body)
