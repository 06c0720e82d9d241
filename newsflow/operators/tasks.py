"""Task roll-ups, cross-feed dedup report, audits, queue totals and lease joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.text import ascii_lower, trim_ws, truncate_chars
from newsflow.plans.scan import HOUR_US, running, time_segment

# ---- fixed values -------------------------------------------------------------------------------
DEDUP_REASON = "same_url"
SESSION_MARGIN_SECONDS = 60
MAX_LABEL_CHARS = 255
MAX_URL_CHARS = 1000
REPORTED_STATE = [
    "active",
    "connection_state",
    "pending_tasks",
    "current_task_id",
    "current_execution_id",
    "last_error",
    "desired_state",
]
# -------------------------------------------------------------------------------------------------

TASK = ["task_id", "execution_id"]


def dedup_key(url: Column) -> Column:
    return ascii_lower(trim_ws(url))


def dedup_sources(sources: DataFrame, task: list[str] = TASK, keep_dropped: bool = False) -> DataFrame:
    """First source of every URL of a task over all its feeds, by (feed_index, source_pos).

    ``keep_dropped`` keeps the copies too, told apart by ``kept``. The default form is a rank filter, cut to
    one row per key before the shuffle.
    """
    keyed = sources.withColumn("dedup_key", dedup_key(F.col("url")))
    if keep_dropped:
        first = keyed.groupBy(*task, "dedup_key").agg(F.min(F.struct("feed_index", "source_pos")).alias("__first"))
        position = F.struct("feed_index", "source_pos")
        return keyed.join(first, [*task, "dedup_key"]).withColumn("kept", position == F.col("__first")).drop("__first")
    window = Window.partitionBy(*task, "dedup_key").orderBy("feed_index", "source_pos")
    return keyed.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") == 1).drop("__rank")


def dedup_groups(sources: DataFrame, task: list[str] = TASK) -> DataFrame:
    """Dropped copies with what was kept: one row per dropped source, so nothing grows with a group of copies.

    Columns: task, dedup_key, reason, kept_url, feed_index, source_pos, dropped_url; a group's rows are in order of
    (feed_index, source_pos).
    """
    keys = [*task, "dedup_key"]
    keyed = sources.select(*task, dedup_key(F.col("url")).alias("dedup_key"), "feed_index", "source_pos", "url")
    position = F.struct("feed_index", "source_pos")
    first = keyed.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(F.struct("feed_index", "source_pos", "url")).alias("__first"))
    kept = first.where(F.col("__n") > 1)
    return (
        keyed.join(kept, keys)
        .where(position != F.struct("__first.feed_index", "__first.source_pos"))
        .select(
            *keys, F.lit(DEDUP_REASON).alias("reason"), F.col("__first.url").alias("kept_url"), "feed_index", "source_pos",
            F.col("url").alias("dropped_url"),
        )
    )


def dedup_counts(sources: DataFrame, task: list[str] = TASK) -> DataFrame:
    """Per task: candidates in, out and dropped. Two partially aggregated steps, no distinct set per task."""
    per_key = sources.groupBy(*task, dedup_key(F.col("url")).alias("__key")).agg(F.count("*").alias("__n"))
    return (
        per_key.groupBy(*task)
        .agg(F.sum("__n").alias("input_candidates"), F.count("*").alias("output_candidates"))
        .withColumn("duplicates_dropped", F.col("input_candidates") - F.col("output_candidates"))
    )


def task_progress(slots: DataFrame, task: list[str] = TASK, job: str = "job_id", done: str = "done") -> DataFrame:
    """Per task: total, completed and remaining feeds and the progress label."""
    counted = slots.groupBy(*task).agg(
        F.min(job).alias("job_id"), F.count("*").alias("total_feeds"), F.count_if(F.col(done)).alias("completed_feeds")
    )
    label = F.format_string("job %s [%d / %d feeds]", F.col("job_id").cast("string"), "completed_feeds", "total_feeds")
    return counted.withColumns(
        {"remaining_feeds": F.col("total_feeds") - F.col("completed_feeds"), "label": label}
    )


def complete_tasks(slots: DataFrame, task: list[str] = TASK, done: str = "done") -> DataFrame:
    """Keys of tasks without an open slot."""
    return slots.groupBy(*task).agg(F.count_if(~F.col(done)).alias("__open")).where(F.col("__open") == 0).select(*task)


def assemble_results(slots: DataFrame, task: list[str] = TASK, done: str = "done") -> DataFrame:
    """Slots of complete tasks, one row each; their order is feed_index."""
    return slots.join(complete_tasks(slots, task, done), task, "left_semi")


def audit_completeness(slots: DataFrame, results: DataFrame, task: list[str] = TASK) -> DataFrame:
    """Every disagreement between expected slots and delivered results: (task, feed_index, issue).

    missing_result, unknown_task, missing_slot (known task, unknown index), completed_twice. Both inputs are counted
    per slot in one aggregate; whether a task is known is a second, small one.
    """
    slot = [*task, "feed_index"]
    both = slots.select(*slot, F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(
        results.select(*slot, F.lit(0).alias("s"), F.lit(1).alias("r"))
    )
    counted = both.groupBy(*slot).agg(F.max("s").alias("s"), F.sum("r").alias("r"))
    known = slots.groupBy(*task).agg(F.lit(True).alias("__known"))
    rows = counted.where((F.col("s") == 0) | (F.col("r") != 1)).join(known, task, "left")
    stray = F.when(F.col("__known"), "missing_slot").otherwise("unknown_task")
    issues = F.array_compact(
        F.array(
            F.when((F.col("s") == 1) & (F.col("r") == 0), "missing_result"),
            F.when(F.col("s") == 0, stray),
            F.when(F.col("r") > 1, "completed_twice"),
        )
    )
    return rows.select(*slot, F.explode(issues).alias("issue"))


def queue_totals(slots: DataFrame, pending_completions: int = 0, task: list[str] = TASK) -> DataFrame:
    """One row: the queue as reported upstream.

    ``slots``: task key, job_id, feed_index, feed_id, feed_url, host_key, state (pending|active|done).
    Complete tasks no longer count. The current feed is the first active one by host, else the first pending.
    """
    place = F.struct("host_key", *task, "feed_index")
    feed = F.struct("feed_id", "feed_url")
    active, waiting = F.col("state") == "active", F.col("state") == "pending"
    per_task = (
        slots.groupBy(*task)
        .agg(
            F.min("job_id").alias("job_id"),
            F.count("*").alias("total"),
            F.count_if(F.col("state") == "done").alias("completed"),
            F.count_if(waiting).alias("queued"),
            F.count_if(active).alias("running"),
            F.min(F.when(active, F.struct(place.alias("p"), feed.alias("f")))).alias("a"),
            F.min(F.when(waiting, F.struct(place.alias("p"), feed.alias("f")))).alias("w"),
        )
        .where(F.col("completed") < F.col("total"))
    )
    label = F.format_string("job %s [%d / %d feeds]", F.col("job_id").cast("string"), "completed", "total")
    totals = per_task.agg(
        F.count("*").alias("tasks"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("feeds_claimed"),
        F.coalesce(F.sum("queued"), F.lit(0)).alias("feeds_queued"),
        F.coalesce(F.sum("running"), F.lit(0)).alias("feeds_active"),
        F.min(F.struct(*task, label.alias("label"))).alias("first"),
        F.coalesce(F.min("a"), F.min("w")).alias("current"),
    )
    committing = F.lit(f"committing {pending_completions} completed rss task(s)")
    first_label = F.coalesce("first.label", F.when(F.lit(pending_completions > 0), committing))
    busy = (F.col("tasks") > 0) | F.lit(pending_completions > 0)
    state = (
        F.when(~busy, "idle")
        .when(F.lit(pending_completions > 0) & (F.col("feeds_active") == 0), "committing")
        .otherwise("processing")
    )
    return totals.select(
        busy.alias("active"),
        state.alias("connection_state"),
        (F.col("tasks") + pending_completions).alias("pending_tasks"),
        *[F.col(f"first.{c}").alias(f"current_{c}") for c in task],
        F.when(
            busy,
            truncate_chars(
                F.format_string("%s | %d rss task(s), %d feeds, %d queued", first_label, "tasks", "feeds_claimed", "feeds_queued"),
                MAX_LABEL_CHARS,
            ),
        ).alias("current_task_label"),
        F.col("current.f.feed_id").alias("current_feed_id"),
        truncate_chars(F.col("current.f.feed_url"), MAX_URL_CHARS).alias("current_feed_url"),
        "feeds_claimed",
        "feeds_queued",
        F.lit("running").alias("desired_state"),
    )


def claim_size(slots: DataFrame, max_tasks: int = 5, pending_completions: int = 0, task: list[str] = TASK) -> DataFrame:
    """One row: how many more tasks may be claimed."""
    totals = queue_totals(slots, pending_completions, task)
    return totals.select(F.greatest(F.lit(max_tasks) - F.col("pending_tasks"), F.lit(0)).alias("free_slots"))


def attach_leases(results: DataFrame, leases: DataFrame) -> DataFrame:
    """Results with their lease columns, joined on (task_id, execution_id); without one, an error message."""
    held = leases.withColumn("__held", F.lit(True))
    missing = F.format_string("missing lease metadata for task %d:%d", *TASK)
    return (
        results.join(held, TASK, "left")
        .withColumn("lease_error", F.when(F.col("__held").isNull(), missing))
        .drop("__held")
    )


def release_leases(leases: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Leases that are still held after the acknowledged results."""
    return leases.join(acknowledged.select(*TASK).distinct(), TASK, "left_anti")


def usable_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that outlive ``now`` by more than the margin; for all others a new one is due."""
    return sessions.where(F.col("expires_at") > now + F.expr(f"INTERVAL {SESSION_MARGIN_SECONDS} SECONDS"))


def changed_states(
    states: DataFrame, worker: str = "worker", order: tuple[str, ...] = ("ts", "event_id"), segment_us: int = HOUR_US
) -> DataFrame:
    """States that differ from the one before on the reported columns; the first state always counts."""
    reported = F.struct(*REPORTED_STATE)
    rows = running(
        states, [worker], order, time_segment(F.col(order[0]), segment_us), previous={"__previous": reported}
    )
    return rows.where(F.col("__previous").isNull() | (F.col("__previous") != reported)).drop("__previous")
