"""Worker telemetry: status fold, transfer totals, throttling, staleness, classification, notices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.text import ascii_lower, let, one_line_detail, trim_ws, truncate_chars
from newsflow.plans.scan import HOUR_US, SEGMENT, running, time_segment

# ---- fixed values -------------------------------------------------------------------------------
PERSIST_INTERVAL_MS = 1_000
STALE_AFTER_SECONDS = 120
HINT_SECONDS = 2
NOTICE_TTL_SECONDS = 5
FORCED_OPS = ["idle", "processing", "completed", "disconnected", "error", "stopped"]
CLEARING_OPS = ["idle", "completed", "stopped"]
TONE_PRIORITY = {"danger": 4, "warning": 3, "neutral": 2, "success": 1}
ERROR_LABELS = [
    (
        "Invalid API key",
        ("invalid_worker_api_key", "invalid api key", "api error (401)", "api error (403)", "not authorized", "forbidden"),
    ),
    ("Invalid API URL", ("builder error", "api error (404)", "not found", "relative url", "invalid url")),
    ("Request timeout", ("timed out", "timeout")),
    (
        "Backend offline",
        (
            "error sending request",
            "connection refused",
            "dns error",
            "failed to lookup",
            "tcp connect",
            "backend unreachable",
        ),
    ),
    ("Backend unavailable", ("api error (5", "bad gateway", "service unavailable", "internal server error")),
    ("Invalid response", ("response decode", "invalid json", "invalid response")),
]
KIND_LABELS = {
    "json": "Invalid response",
    "response_decode": "Invalid response",
    "auth": "Invalid API key",
    "config": "Invalid API URL",
    "builder": "Invalid API URL",
    "timeout": "Request timeout",
    "connect": "Backend offline",
    "request": "Backend offline",
    "decode": "Invalid response",
    "invalid_payload": "Invalid task data",
    "invalid_header": "Invalid API request",
    "runtime": "Worker runtime error",
}
REQUEST_FAILED = "Request failed"
MAX_LONG = 2**63 - 1
# -------------------------------------------------------------------------------------------------

ORDER = ("ts", "event_id")


def _column(df: DataFrame, name: str, type_name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(type_name)


def field_updates(updates: DataFrame) -> dict[str, Column]:
    """What one update writes to each snapshot field.

    NULL leaves the field alone; a struct replaces it, and a struct holding NULL clears it. That is what lets
    "newest value" aggregates carry clears as well as sets.
    """
    op = F.col("op")

    def put(value: Column) -> Column:
        return F.struct(value.alias("v"))

    def clear(type_name: str) -> Column:
        return put(F.lit(None).cast(type_name))

    task = _column(updates, "task_id", "bigint")
    execution = _column(updates, "execution_id", "bigint")
    feed, url = _column(updates, "feed_id", "bigint"), _column(updates, "feed_url", "string")
    error = F.coalesce(_column(updates, "error", "string"), op)
    phase = (
        F.when(op.isin("idle", "completed"), "idle")
        .when(op == "processing", "processing")
        .when(op == "error", "error")
        .when(op == "stopped", "stopped")
    )
    return {
        "phase": F.when(phase.isNotNull(), put(phase)),
        "server_connection": F.when(op.isin("connected", "disconnected"), put(op)),
        "last_server_contact_at": F.when(op == "connected", put(F.col("ts"))),
        "current_task_id": F.when(op == "processing", put(task)).when(op.isin(CLEARING_OPS), clear("bigint")),
        "current_execution_id": F.when(op == "processing", put(execution)).when(
            op.isin(CLEARING_OPS), clear("bigint")
        ),
        "has_task": F.when(op == "processing", put(F.lit(True))).when(op.isin(CLEARING_OPS), put(F.lit(False))),
        "current_feed_id": F.when(op == "set_feed", put(feed)).when(op.isin(CLEARING_OPS), clear("bigint")),
        "current_feed_url": F.when(op == "set_feed", put(url)).when(op.isin(CLEARING_OPS), clear("string")),
        "last_error": F.when(op.isin("error", "disconnected"), put(error)).when(
            op.isin("idle", "processing", "completed", "task_recorded"), clear("string")
        ),
    }


DEFAULTS = {"phase": "starting", "server_connection": "unknown", "has_task": False}


def _field(name: str, held: Column) -> Column:
    if name in DEFAULTS:
        return F.coalesce(held.v, F.lit(DEFAULTS[name]))
    return held.v


def _completed(op: Column) -> Column:
    return F.when(op.isin("completed", "task_recorded"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def saturating_sum(c: Column) -> Column:
    """Sum of non-negative longs that stops at the largest long instead of failing."""
    return F.least(F.sum(c.cast("decimal(20,0)")), F.lit(MAX_LONG).cast("decimal(30,0)")).cast("bigint")


def transfer_totals(updates: DataFrame, worker: str = "worker") -> DataFrame:
    sent, received = _column(updates, "bytes_sent", "bigint"), _column(updates, "bytes_received", "bigint")
    return updates.groupBy(worker).agg(
        saturating_sum(F.coalesce(sent, F.lit(0))).alias("bytes_sent"),
        saturating_sum(F.coalesce(received, F.lit(0))).alias("bytes_received"),
    )


def fold_status(updates: DataFrame, worker: str = "worker") -> DataFrame:
    """Latest snapshot per worker.

    The newest write of each field is a max_by, so the fold is one partially aggregated groupBy: a worker
    with a third of all updates is reduced before the shuffle.
    """
    order = F.struct(*ORDER)
    writes = field_updates(updates)
    sent, received = _column(updates, "bytes_sent", "bigint"), _column(updates, "bytes_received", "bigint")
    folded = updates.groupBy(worker).agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_updated_at"),
        *[F.max_by(w, F.when(w.isNotNull(), order)).alias(name) for name, w in writes.items()],
        F.sum(_completed(F.col("op"))).alias("completed_task_count"),
        saturating_sum(F.coalesce(sent, F.lit(0))).alias("bytes_sent"),
        saturating_sum(F.coalesce(received, F.lit(0))).alias("bytes_received"),
    )
    return folded.withColumns({name: _field(name, F.col(name)) for name in writes})


def status_history(updates: DataFrame, worker: str = "worker", segment_us: int = HOUR_US) -> DataFrame:
    """The snapshot after every update: key, ts, event_id, op and all snapshot fields."""
    writes = field_updates(updates)
    received = F.coalesce(_column(updates, "bytes_received", "bigint"), F.lit(0).cast("bigint"))
    sent = F.coalesce(_column(updates, "bytes_sent", "bigint"), F.lit(0).cast("bigint"))
    rows = updates.select(
        worker,
        *ORDER,
        "op",
        *[w.alias(f"__w_{name}") for name, w in writes.items()],
        sent.alias("__sent"),
        received.alias("__received"),
    )
    folded = running(
        rows,
        [worker],
        ORDER,
        time_segment(F.col("ts"), segment_us),
        last={name: F.col(f"__w_{name}") for name in writes},
        total={
            "completed_task_count": _completed(F.col("op")),
            "bytes_sent": F.col("__sent"),
            "bytes_received": F.col("__received"),
        },
    )
    return folded.select(
        worker,
        *ORDER,
        "op",
        *[_field(name, F.col(name)).alias(name) for name in writes],
        "completed_task_count",
        "bytes_sent",
        "bytes_received",
        F.col("ts").alias("last_updated_at"),
    )


def running_transfer(updates: DataFrame, worker: str = "worker", segment_us: int = HOUR_US) -> DataFrame:
    """Every update with the bytes moved so far."""
    received = F.coalesce(_column(updates, "bytes_received", "bigint"), F.lit(0).cast("bigint"))
    return running(
        updates, [worker], ORDER, time_segment(F.col("ts"), segment_us), total={"total_received": received}
    )


def throttle(
    updates: DataFrame, worker: str = "worker", interval_ms: int = PERSIST_INTERVAL_MS, segment_us: int = HOUR_US
) -> DataFrame:
    """The updates that are emitted: forced ones, and others at least ``interval_ms`` after the last emission.

    Whether an update is emitted depends on the emission before it. A forced update, a worker's first one, and
    one after a long enough gap are emitted whatever came before ("certain"). For the others a worker is cut
    into time segments, also inside one endless run of updates:

    1. every segment reports, for each update that can be its first emission, the last emission that follows
       from it; only updates within one interval of the segment's start (or up to its first certain one) can be;
    2. these short reports are chained per worker, which gives the last emission before every segment;
    3. every segment is walked once from that time.

    Steps 1 and 3 run per (worker, segment); step 2 sees a few rows per segment.
    """
    step = interval_ms * 1000
    rows = running(
        updates.withColumn("__us", F.unix_micros(F.col("ts"))),
        [worker],
        ORDER,
        time_segment(F.col("ts"), segment_us),
        previous={"__before": F.col("__us")},
    )
    certain = F.col("op").isin(FORCED_OPS) | F.col("__before").isNull() | (F.col("__us") - F.col("__before") >= step)
    rows = rows.withColumns({"__certain": certain, SEGMENT: time_segment(F.col("ts"), segment_us)})
    key = f"{worker} {updates.schema[worker].dataType.simpleString()}, {SEGMENT} bigint"
    place = [worker, SEGMENT, "__us", "event_id"]

    narrow = rows.select(*place, "__certain").repartition(worker, SEGMENT).sortWithinPartitions(*place)
    reports = narrow.mapInPandas(
        _first_emissions(worker, step, segment_us), f"{key}, entry_us bigint, certain boolean, last_us bigint"
    )
    ordered = reports.repartition(worker).sortWithinPartitions(worker, SEGMENT, "entry_us", "certain")
    chained = ordered.mapInPandas(_chain_segments(worker, step), f"{key}, __last bigint")

    joined = rows.join(chained, [worker, SEGMENT]).repartition(worker, SEGMENT).sortWithinPartitions(*place)
    return joined.mapInPandas(_walk_segments(worker, step, list(updates.columns)), updates.schema)


_NEVER = -(2**62)
_Batches = Iterator[pd.DataFrame]


def _first_emissions(worker: str, step: int, width: int) -> Callable[[_Batches], _Batches]:
    def report(segment: int, times: list[int], certain: list[bool]) -> Iterator[tuple[int, bool, int]]:
        n = far = sure = len(times)
        last = [0] * n
        for i in range(n - 1, -1, -1):
            while far - 1 > i and times[far - 1] >= times[i] + step:
                far -= 1
            following = min(far, sure)
            last[i] = times[i] if following == n else last[following]
            if certain[i]:
                sure = i
        for i in range(n):
            if certain[i] or i == 0 or times[i] != times[i - 1]:
                yield times[i], certain[i], last[i]
            if certain[i] or times[i] >= segment * width + step:
                return

    def run(batches: _Batches) -> _Batches:
        current, times, certain = None, [], []

        def finish() -> list[tuple]:
            return [(*current, *r) for r in report(current[1], times, certain)] if current else []

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=[worker, SEGMENT, "entry_us", "certain", "last_us"])

        for batch in batches:
            out = []
            columns = (batch[c].tolist() for c in (worker, SEGMENT, "__us", "__certain"))
            for who, segment, at, sure in zip(*columns, strict=True):
                if current != (who, segment):
                    out += finish()
                    current, times, certain = (who, segment), [], []
                times.append(at)
                certain.append(sure)
            if out:
                yield frame(out)
        if current:
            yield frame(finish())

    return run


def _chain_segments(worker: str, step: int) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        current, last, decided = (None, None), _NEVER, False
        for batch in batches:
            out = []
            columns = (batch[c].tolist() for c in (worker, SEGMENT, "entry_us", "certain", "last_us"))
            for who, segment, entry, sure, after in zip(*columns, strict=True):
                if current != (who, segment):
                    last = last if current[0] == who else _NEVER
                    current, decided = (who, segment), False
                    out.append((who, segment, last))
                if not decided and (sure or entry - last >= step):
                    last, decided = after, True
            yield pd.DataFrame(out, columns=[worker, SEGMENT, "__last"])

    return run


def _walk_segments(worker: str, step: int, names: list[str]) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        current, last = None, _NEVER
        for batch in batches:
            keep = []
            columns = (batch[c].tolist() for c in (worker, SEGMENT, "__us", "__certain", "__last"))
            for who, segment, at, sure, before in zip(*columns, strict=True):
                if current != (who, segment):
                    current, last = (who, segment), before
                emit = sure or at - last >= step
                if emit:
                    last = at
                keep.append(emit)
            yield batch.loc[keep, names]

    return run


def is_stale(last_updated_at: Column, now: Column) -> Column:
    return last_updated_at < now - F.expr(f"INTERVAL {STALE_AFTER_SECONDS} SECONDS")


def with_stale(snapshots: DataFrame, now: Column) -> DataFrame:
    return snapshots.withColumn("stale", is_stale(F.col("last_updated_at"), now))


def carry_valid(loads: DataFrame, worker: str = "worker", segment_us: int = HOUR_US) -> DataFrame:
    """Snapshot in force after every load attempt.

    ``loads``: worker, ts, event_id, load (loaded|missing|error), phase, has_task, completed_task_count and,
    for errors, prefix and detail. An error keeps the snapshot and adds a warning; missing clears it. Also
    gives ``completed_work`` (count above the snapshot before) and the time of the running processing hint.
    """
    names = [c for c in ("phase", "has_task", "completed_task_count", "app_version") if c in loads.columns]
    snapshot = F.struct(*names)
    empty = F.lit(None).cast(loads.select(snapshot.alias("s")).schema["s"].dataType)
    held = F.when(F.col("load") == "loaded", F.struct(snapshot.alias("v"))).when(
        F.col("load") == "missing", F.struct(empty.alias("v"))
    )
    segment = time_segment(F.col("ts"), segment_us)
    rows = running(
        loads, [worker], ORDER, segment, last={"__held": held}, previous={"__prior": held}
    )
    loaded = F.col("load") == "loaded"
    more = F.coalesce(
        loaded & (F.col("completed_task_count") > F.col("__prior.v.completed_task_count")), F.lit(False)
    )
    return rows.select(
        *loads.columns,
        F.col("__held.v").alias("snapshot"),
        more.alias("completed_work"),
        _load_warning(loads).alias("warning"),
    )


def _load_warning(loads: DataFrame) -> Column:
    detail = F.coalesce(one_line_detail(_column(loads, "detail", "string")), F.lit("Please try again."))
    prefix = F.coalesce(_column(loads, "prefix", "string"), F.lit("Worker status file is invalid."))
    return F.when(F.col("load") == "error", F.concat(prefix, F.lit(" "), detail))


def completed_work(loads: DataFrame, worker: str = "worker") -> DataFrame:
    """Loads whose completed count rose above the snapshot before."""
    return carry_valid(loads, worker).where(F.col("completed_work"))


def processing_hint(loads: DataFrame, worker: str = "worker", segment_us: int = HOUR_US) -> DataFrame:
    """``carry_valid`` with ``hint_until`` after every load: set by observed processing or completed work, cleared by
    error/stopped.

    Whether a load shows completed work hangs on the snapshot before it, and the hint on that. Within a segment only the
    first load that sets or clears a snapshot looks beyond it, so a segment is summed up by its last snapshot, its last
    certain hint and what that first load writes if the count has risen; one scan over the summaries settles both. Rows
    are shuffled once, by (worker, segment).
    """
    names = [c for c in ("phase", "has_task", "completed_task_count", "app_version") if c in loads.columns]
    snapshot = F.struct(*names)
    none = F.lit(None).cast(loads.select(snapshot.alias("s")).schema["s"].dataType)
    is_loaded = F.col("load") == "loaded"
    held = F.when(is_loaded, F.struct(snapshot.alias("v"))).when(F.col("load") == "missing", F.struct(none.alias("v")))
    count = F.col("completed_task_count")
    until = F.struct((F.col("ts") + F.expr(f"INTERVAL {HINT_SECONDS} SECONDS")).alias("v"))
    cleared = F.struct(F.lit(None).cast("timestamp").alias("v"))

    def written(more: Column) -> Column:
        observed = (F.col("phase") == "processing") | F.col("has_task") | more
        return F.when(is_loaded & F.col("phase").isin("error", "stopped"), cleared).when(is_loaded & observed, until)

    def rose(prior: Column) -> Column:
        return F.coalesce(is_loaded & (count > prior.getField("v").getField("completed_task_count")), F.lit(False))

    key = [F.struct(F.col(worker).alias("k")).alias("__key"), time_segment(F.col("ts"), segment_us).alias(SEGMENT)]
    cut = ["__key", SEGMENT]  # a struct, so that rows without a worker meet in the join too
    local = Window.partitionBy(*cut).orderBy(*ORDER)
    upto, until_here = (local.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    rows = (
        loads.select("*", *key)
        .withColumn("__own", held)
        .withColumns({"__held": F.last("__own", True).over(upto), "__prior": F.last("__own", True).over(until_here)})
        .withColumn("__write", written(rose(F.col("__prior"))))
        .withColumn("__hint", F.last("__write", True).over(upto))
    )
    opens = F.col("__own").isNotNull() & F.col("__prior").isNull()
    first = F.struct(F.when(is_loaded, count).alias("count"), written(F.lit(True)).alias("write"))
    position = F.struct(*ORDER)
    summary = rows.groupBy(*cut).agg(
        F.max_by("__held", position).alias("held"),
        F.max_by("__hint", position).alias("hint"),
        F.max(F.when(opens, first)).alias("__first"),
    )
    before = Window.partitionBy("__key").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    risen = F.col("__first.count") > F.col("__before.v.completed_task_count")
    summary = summary.withColumn("__before", F.last("held", True).over(before))
    summary = summary.withColumn("__opening", F.when(risen, F.col("__first.write")))
    settled = F.coalesce("hint", "__opening")
    summary = summary.select(*cut, "__before", "__opening", F.last(settled, True).over(before).alias("__carried"))

    opening = F.when(F.col("__held").isNotNull(), F.col("__opening"))
    return rows.join(summary, cut, "left").select(
        *loads.columns,
        F.coalesce("__held", "__before").getField("v").alias("snapshot"),
        rose(F.coalesce("__prior", "__before")).alias("completed_work"),
        _load_warning(loads).alias("warning"),
        F.coalesce(F.col("__hint"), opening, F.col("__carried")).getField("v").alias("hint_until"),
    )


def recent_processing(hint_until: Column, now: Column) -> Column:
    return F.coalesce(now < hint_until, F.lit(False))


def visual_status(running_: Column, present: Column, stale: Column, recent: Column) -> Column:
    """Inactive | Error | Processing | Starting | Active, from the snapshot columns of the row."""
    phase = F.col("phase")
    return (
        F.when(~running_ | ~present | F.coalesce(stale, F.lit(False)) | (phase == "stopped"), "Inactive")
        .when((phase == "error") | (F.col("server_connection") == "disconnected"), "Error")
        .when((phase == "processing") | F.col("has_task") | recent, "Processing")
        .when(phase == "starting", "Starting")
        .otherwise("Active")
    )


def classify_status(snapshots: DataFrame, now: Column) -> DataFrame:
    """Adds ``status``. Optional columns: is_running (default true), hint_until."""
    alive = F.col("is_running") if "is_running" in snapshots.columns else F.lit(True)
    recent = recent_processing(_column(snapshots, "hint_until", "timestamp"), now)
    present = F.col("phase").isNotNull()
    return snapshots.withColumn("status", visual_status(alive, present, is_stale(F.col("last_updated_at"), now), recent))


def error_label(detail: Column, fallback: str) -> Column:
    """Short label of a raw error text."""

    def label(text: Column) -> Column:
        out = F.lit(fallback)
        for name, cues in reversed(ERROR_LABELS):
            found = reduce(lambda a, b: a | b, [F.contains(text, F.lit(cue)) for cue in cues])
            out = F.when(found, name).otherwise(out)
        return out

    return let(F.coalesce(ascii_lower(one_line_detail(detail)), F.lit("")), label)


def status_label(status_code: Column, detail: Column | None = None) -> Column:
    """Short label of an HTTP status; anything else falls back to the error text."""
    other = F.lit(REQUEST_FAILED) if detail is None else error_label(detail, REQUEST_FAILED)
    return (
        F.when(status_code.isin(401, 403), "Invalid API key")
        .when(status_code == 404, "Invalid API URL")
        .when(status_code.isin(408, 504), "Request timeout")
        .when(status_code.between(500, 599), "Backend unavailable")
        .otherwise(other)
    )


def kind_label(kind: Column, status_code: Column) -> Column:
    """Short label of an error kind; API errors go by their status."""
    label = F.lit(REQUEST_FAILED)
    for name, text in KIND_LABELS.items():
        label = F.when(kind == name, text).otherwise(label)
    return F.when(kind.isNull() | (kind == "api"), status_label(status_code)).otherwise(label)


def label_errors(log: DataFrame) -> DataFrame:
    return log.withColumn("label", status_label(F.col("status_code"), _column(log, "error", "string")))


def label_frequency(log: DataFrame) -> DataFrame:
    return label_errors(log).groupBy("label").agg(F.count("*").alias("n"))


def tone_priority(tone: Column) -> Column:
    rank = F.lit(0)
    for name, value in TONE_PRIORITY.items():
        rank = F.when(tone == name, value).otherwise(rank)
    return rank


def top_notice(notices: DataFrame, now: Column, worker: str = "worker") -> DataFrame:
    """Per worker the live notice of highest tone; among equals the earliest source position."""
    live = notices.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    best = live.groupBy(worker).agg(
        F.max_by(F.struct("tone", "text", "pos"), F.struct(tone_priority(F.col("tone")), -F.col("pos"))).alias("n")
    )
    return best.select(worker, "n.tone", "n.text", "n.pos")


def alert_rows(snapshots: DataFrame, now: Column) -> DataFrame:
    """Notices of sessions in error phase or with a lost server; stale ones raise none."""
    fresh = ~is_stale(F.col("last_updated_at"), now)
    text = F.when(F.col("phase") == "error", error_label(F.col("last_error"), "Worker error")).when(
        F.col("server_connection") == "disconnected", error_label(F.col("last_error"), "Backend offline")
    )
    return snapshots.where(fresh).withColumns({"tone": F.lit("danger"), "notice": text}).where(F.col("notice").isNotNull())


def reconcile_versions(installs: DataFrame, snapshots: DataFrame, worker: str = "worker") -> DataFrame:
    """Stored version replaced by the snapshot's when the worker is installed and the snapshot names one.

    Of several snapshots of a worker the newest by ``last_updated_at`` counts, without such times the one of the highest
    text, so an install stays one row.
    """
    order = F.struct(_column(snapshots, "last_updated_at", "timestamp"), F.col("app_version"))
    newest = snapshots.groupBy(worker).agg(F.max_by("app_version", order).alias("__seen"))
    seen = newest.select(worker, F.nullif(trim_ws(F.col("__seen")), F.lit("")).alias("__seen"))
    changed = F.col("installed") & F.col("__seen").isNotNull()
    return (
        installs.join(seen, worker, "left")
        .withColumn("installed_version", F.when(changed, F.col("__seen")).otherwise(F.col("installed_version")))
        .drop("__seen")
    )


def bounded_labels(df: DataFrame, label: str, url: str, detail: str) -> DataFrame:
    """Label cut to 255, URL to 1000 characters; the detail to one line of at most 140."""
    return df.withColumns(
        {
            label: truncate_chars(F.col(label), 255),
            url: truncate_chars(F.col(url), 1000),
            detail: one_line_detail(F.col(detail)),
        }
    )
