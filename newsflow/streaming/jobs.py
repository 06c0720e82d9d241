"""Continuous forms: entry ingest, rate slots, status fold, embedding, task completion.

All but embedding carry small tables from micro-batch to micro-batch (see ``carried``) and run the batch operators on each.
Rows that come late are never dropped: they count where they still can, and are told apart where they cannot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from newsflow.operators import telemetry
from newsflow.operators.embed import embed, with_passage
from newsflow.operators.entries import finish_sources, published_since, with_first_link, with_required_title
from newsflow.operators.fetch import assign_rate_slots
from newsflow.operators.telemetry import HOUR_US, ORDER, PERSIST_INTERVAL_MS, saturating_sum
from newsflow.plans.scan import running, time_segment
from newsflow.streaming.carried import MicroBatches, Once, Tables

FEED_POLL_SECONDS, EMBEDDING_POLL_SECONDS = 5, 30  # fixed values
CLOCK = "us bigint"


def _clock(rows: DataFrame, time: str, held: Tables) -> tuple[int | None, DataFrame]:
    """The newest event time so far, as a number and as a table of one row."""
    newest = rows.select(F.unix_micros(time).alias("us")).unionByName(held["clock"]).agg(F.max("us").alias("us"))
    return newest.first().us, newest


# ---- entries ------------------------------------------------------------------------------------
class Ingest:
    """Entry stream -> source stream; of the entries of a feed with one URL the one at the lowest position comes through.

    ``entries`` needs ``arrived_at`` (event time of landing). An entry waits until the newest arrival is ``hold`` past the
    first one of its URL, so that of copies from several files the first position wins whatever order the files came in. Then
    it goes out once; for ``keep`` from then on further copies are dropped. An entry that comes later than that is new, and
    one whose time to wait is over goes out at once. Dedup stands before the date and title tests, as in the batch form.
    """

    def __init__(self, entries: DataFrame, folder: str, feeds: DataFrame | None = None, hold: str = "1 hour", keep: str = "1 day"):
        self.feeds, self.hold, self.keep = feeds, F.expr(f"INTERVAL {hold}"), F.expr(f"INTERVAL {keep}")
        self.names = with_first_link(entries).columns
        waiting = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_first_link(entries).schema)
        self.key = f"feed_id {entries.schema['feed_id'].dataType.simpleString()}, url string"
        self.batches = MicroBatches(
            entries, self._step, folder,
            replaced={"waiting": f"{waiting}, __first timestamp", "clock": CLOCK},
            grown={"gone": f"{self.key}, until timestamp"}, keep=self._still,
        )

    def _step(self, rows: DataFrame, held: Tables, once: Once) -> tuple[DataFrame, Tables]:
        now, clock = _clock(rows, "arrived_at", held)
        at = F.timestamp_micros(F.lit(now).cast("bigint"))
        first = self._first(with_first_link(rows).withColumn("__first", F.col("arrived_at")).unionByName(held["waiting"]))
        same = [F.col(f"f.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("feed_id", "url")]
        gone = held["gone"].where(F.col("until") >= at)
        open_ = once(first.alias("f").join(gone.alias("g"), same, "left_anti"))
        due = F.coalesce(F.col("__first") + self.hold <= at, F.lit(False))
        left = open_.where(due).select("feed_id", "url", (at + self.keep).alias("until"))
        return self._finished(open_.where(due)), {"waiting": open_.where(~due), "gone": left, "clock": clock}

    def _first(self, rows: DataFrame) -> DataFrame:
        """The lowest position of each URL, as a partial aggregate: copies are reduced before the shuffle."""
        best = F.min_by(F.struct(*self.names), F.struct("entry_pos", "arrived_at"))
        grouped = rows.groupBy("feed_id", "url").agg(best.alias("e"), F.min("__first").alias("__first"))
        return grouped.select("e.*", "__first")

    def _finished(self, rows: DataFrame) -> DataFrame:
        return finish_sources(published_since(rows.select(self.names), self.feeds).transform(with_required_title))

    def _still(self, name: str, rows: DataFrame, left: Tables) -> DataFrame:
        now = F.timestamp_micros(F.lit(left["clock"].first().us).cast("bigint"))
        return rows.where(F.col("until") >= now)

    def drain(self) -> DataFrame:
        """Run until the input is used up; entries that still wait go out as well, since nothing can come before them."""
        return self.batches.drain().unionByName(self.waiting())

    def waiting(self) -> DataFrame:
        """The sources that would go out if the stream ended now."""
        return self._finished(self.batches.latest()["waiting"])


# ---- rate slots ---------------------------------------------------------------------------------
def rate_slots(
    requests: DataFrame, folder: str, host: str = "host_key", step_us: int = 100_000, segment_us: int = HOUR_US
) -> MicroBatches:
    """Slot of every request: host_key, event_id, arrival_us, slot_us. Input: host, event_id, ts.

    A host carries its next free slot. In a micro-batch its requests, in arrival order, get their slots from the segmented
    max-plus scan of the batch form, which starts from that slot, so a host with a third of all requests is many tasks.
    """
    rows = requests.select(F.col(host).cast("string").alias("host_key"), "event_id", "ts")

    def step(rows: DataFrame, held: Tables, once: Once) -> tuple[DataFrame, Tables]:
        slots = assign_rate_slots(rows, step_us=step_us, segment_us=segment_us, carried=held["hosts"])
        out = once(slots.select("host_key", "event_id", F.unix_micros("ts").alias("arrival_us"), "slot_us"))
        nexts = out.select("host_key", (F.col("slot_us") + step_us).alias("next_slot_us")).unionByName(held["hosts"])
        return out, {"hosts": nexts.groupBy("host_key").agg(F.max("next_slot_us").alias("next_slot_us"))}

    return MicroBatches(rows, step, folder, replaced={"hosts": "host_key string, next_slot_us bigint"})


# ---- status -------------------------------------------------------------------------------------
FIELDS = {
    "phase": "string", "server_connection": "string", "last_server_contact_at": "timestamp", "current_task_id": "bigint",
    "current_execution_id": "bigint", "has_task": "boolean", "current_feed_id": "bigint", "current_feed_url": "string",
    "last_error": "string",
}
TOTALS = ("completed_task_count", "bytes_sent", "bytes_received")
_ORDER = "struct<ts: timestamp, event_id: bigint>"
SUMMARY = (
    f"worker string, started_at timestamp, __at {_ORDER}, "
    + ", ".join(f"`{f}` struct<v: {t}>, `__at_{f}` {_ORDER}" for f, t in FIELDS.items())
    + ", "
    + ", ".join(f"{t} bigint" for t in TOTALS)
)
WORKERS = f"{SUMMARY}, __emitted {_ORDER}"
INPUTS = {
    "worker": "string", "event_id": "bigint", "ts": "timestamp", "op": "string", "error": "string", "feed_id": "bigint", "feed_url": "string",
    "task_id": "bigint", "execution_id": "bigint", "bytes_sent": "bigint", "bytes_received": "bigint",
}


def _summary_rows(updates: DataFrame) -> DataFrame:
    """Every update in the form of a summary of one: what it writes, and when."""
    at = F.struct(*ORDER)
    writes = telemetry.field_updates(updates)
    held = [x for f, w in writes.items() for x in (w.alias(f), F.when(w.isNotNull(), at).alias(f"__at_{f}"))]
    totals = [F.when(F.col("op").isin("completed", "task_recorded"), 1).otherwise(0).cast("bigint").alias(TOTALS[0])]
    totals += [F.coalesce(F.col(t), F.lit(0)).cast("bigint").alias(t) for t in TOTALS[1:]]
    return updates.select("worker", F.col("ts").alias("started_at"), at.alias("__at"), *held, *totals)


def merged(summaries: DataFrame) -> DataFrame:
    """One summary for each worker: of every field the newest write, of totals the sum. Order and grouping do not matter."""
    held = [
        x for f in FIELDS
        for x in (F.max_by(f, f"__at_{f}").alias(f), F.max(f"__at_{f}").alias(f"__at_{f}"))
    ]
    totals = [saturating_sum(F.col(t)).alias(t) for t in TOTALS]
    return summaries.groupBy("worker").agg(F.min("started_at").alias("started_at"), F.max("__at").alias("__at"), *held, *totals)


def _snapshot(source: str = "") -> list[Column]:
    fields = [F.coalesce(F.col(f"{source}{f}.v"), F.lit(telemetry.DEFAULTS.get(f)).cast(t)).alias(f) for f, t in FIELDS.items()]
    return fields + [F.col(f"{source}{t}").alias(t) for t in TOTALS]


def status(
    updates: DataFrame, folder: str, worker: str = "worker", interval_ms: int = PERSIST_INTERVAL_MS, segment_us: int = HOUR_US
) -> MicroBatches:
    """Status updates -> snapshots: worker, event_id, kind, the snapshot's fields, last_updated_at.

    ``kind`` is ``emitted`` for updates that are forced or due, ``flush`` for what was held back when the newest update of
    any worker is one interval past the last emission, ``correction`` when updates came that are older than what had been
    folded: they change totals and whatever nothing newer has set, and the corrected snapshot is given once for the batch.
    A worker carries one summary; summaries merge in any order, so after any sequence of batches it equals the fold of all
    its updates. Emissions are those of the throttle, started from the last one.
    """
    named = {n: F.col(n) if n in updates.columns else F.lit(None) for n in INPUTS} | {"worker": F.col(worker)}
    rows = updates.select(*[c.cast(INPUTS[n]).alias(n) for n, c in named.items()])
    step_us = interval_ms * 1000
    at = F.struct(*ORDER)

    def step(rows: DataFrame, held: Tables, once: Once) -> tuple[DataFrame, Tables]:
        now, clock = _clock(rows, "ts", held)
        workers = held["workers"]
        known = workers.select(F.col("worker").alias("__w"), F.col("__at").alias("__known"))
        placed = rows.join(known, F.col("worker").eqNullSafe(F.col("__w")), "left")
        is_late = F.col("__known").isNotNull() & (at <= F.col("__known"))
        late, fresh = (placed.where(c).select(rows.columns) for c in (is_late, ~is_late))

        base = once(merged(_summary_rows(late).unionByName(workers.drop("__emitted"))))
        after = once(merged(_summary_rows(fresh).unionByName(base)))
        # Emissions: the throttle, with the last emission of each worker as a forced update before its new ones.
        last = workers.where("__emitted IS NOT NULL").select("worker", "__emitted.ts", "__emitted.event_id", F.lit("idle").alias("op"), F.lit(True).alias("old"))
        light = fresh.select("worker", "ts", "event_id", "op", F.lit(False).alias("old")).unionByName(last)
        emitted = once(telemetry.throttle(light, "worker", interval_ms, segment_us).where(~F.col("old")).select("worker", *ORDER))
        history = _history(fresh, base, segment_us)
        same = [F.col(f"h.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("worker", *ORDER)]
        shown = history.alias("h").join(emitted.alias("e"), same, "left_semi").withColumn("kind", F.lit("emitted"))

        newest = emitted.groupBy("worker").agg(F.max(at).alias("__new")).select(F.col("worker").alias("__n"), "__new")
        old = workers.select(F.col("worker").alias("__o"), F.col("__emitted").alias("__old"))
        joined = after.join(newest, F.col("worker").eqNullSafe(F.col("__n")), "left").join(old, F.col("worker").eqNullSafe(F.col("__o")), "left")
        kept = joined.withColumn("__emitted", F.coalesce("__new", "__old")).drop("__new", "__old", "__n", "__o")
        waits = (F.col("__at") > F.col("__emitted")) & (F.unix_micros("__emitted.ts") + step_us <= F.lit(now))
        one = [F.col("__at.event_id").alias("event_id"), *_snapshot(), F.col("__at.ts").alias("last_updated_at")]
        flushed = kept.where(waits).select("worker", *one, F.lit("flush").alias("kind"))
        touched = late.select(F.col("worker").alias("__l")).distinct()
        corrected = after.join(touched, F.col("worker").eqNullSafe(F.col("__l")), "left_semi").select("worker", *one, F.lit("correction").alias("kind"))
        out = shown.select(corrected.columns).unionByName(flushed).unionByName(corrected)
        done = kept.withColumn("__emitted", F.when(waits, F.col("__at")).otherwise(F.col("__emitted")))
        return out.withColumn("event_id", F.when(F.col("kind") == "emitted", F.col("event_id"))), {"workers": done, "clock": clock}

    return MicroBatches(rows, step, folder, replaced={"workers": WORKERS, "clock": CLOCK})


def _history(fresh: DataFrame, base: DataFrame, segment_us: int) -> DataFrame:
    """The snapshot after every new update, the carried summaries standing in for all that came before."""
    new = _summary_rows(fresh).withColumn("old", F.lit(False))
    both = new.unionByName(base.withColumn("old", F.lit(True)))
    rows = both.select("worker", "__at.ts", "__at.event_id", "old", *[F.col(f).alias(f"__w_{f}") for f in FIELDS], *[F.col(t).alias(f"__t_{t}") for t in TOTALS])
    folded = running(
        rows, ["worker"], ORDER, time_segment(F.col("ts"), segment_us),
        last={f: F.col(f"__w_{f}") for f in FIELDS}, total={t: F.col(f"__t_{t}") for t in TOTALS},
    )
    return folded.where(~F.col("old")).select("worker", *ORDER, *_snapshot(), F.col("ts").alias("last_updated_at"))


def snapshots(batches: MicroBatches) -> DataFrame:
    """Every worker's snapshot after the last batch: what ``fold_status`` gives for all updates so far."""
    return batches.latest()["workers"].select("worker", "started_at", F.col("__at.ts").alias("last_updated_at"), *_snapshot())


# ---- embeddings ---------------------------------------------------------------------------------
def stream_embeddings(
    sources: DataFrame,
    make_model: Callable[[], Callable],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    batch_size: int = 32,
    poll_seconds: int | None = EMBEDDING_POLL_SECONDS,
    error: str | None = "error",
) -> DataStreamWriter:
    """Sources -> vectors, handed to ``write`` per micro-batch. ``poll_seconds`` None drains what is there.

    Sources of a batch that the model fails on come with the message in the column ``error`` and no vector; with ``error``
    None such a batch ends the stream.
    """
    vectors = embed(with_passage(sources), make_model, batch_size, error=error)
    trigger = {"availableNow": True} if poll_seconds is None else {"processingTime": f"{poll_seconds} seconds"}
    return vectors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger)


# ---- task completion ----------------------------------------------------------------------------
BITS = 32_768  # slots in one bitmap, Spark's own size
SLOTS = "task_id bigint, execution_id bigint, total_feeds bigint, bucket bigint, bits binary"
ENDED = "task_id bigint, execution_id bigint, total_feeds bigint, until timestamp"
TASK = ["task_id", "execution_id"]


def has_bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap holds a position."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte.cast("bigint"), (position % 8).cast("int")) == 1, F.lit(False))


def task_completion(results: DataFrame, folder: str, time: str | None = None, keep: str = "1 day") -> MicroBatches:
    """Feed results -> task_id, execution_id, kind, feed_index, copies, delivered, total_feeds.

    ``kind``: ``task_complete`` once, in the batch that fills the last open slot; ``completed_twice`` for a slot that was
    delivered before, ``missing_slot`` for one that the task does not have, each with the number of results. Input: task_id,
    execution_id, feed_index, total_feeds. A task carries a bitmap of its delivered slots; when it is complete, that goes
    and a short row stays until the newest ``time`` (processing time without one) is ``keep`` later.
    """
    when = F.col(time) if time else F.current_timestamp()
    rows = results.select(*[F.col(c).cast("bigint").alias(c) for c in (*TASK, "feed_index", "total_feeds")], when.cast("timestamp").alias("ts"))

    def step(rows: DataFrame, held: Tables, once: Once) -> tuple[DataFrame, Tables]:
        now, clock = _clock(rows, "ts", held)
        at = F.timestamp_micros(F.lit(now).cast("bigint"))
        ended = held["ended"].where(F.col("until") >= at)
        sizes = rows.groupBy(*TASK).agg(F.min("total_feeds").alias("__rows"))
        sizes = sizes.join(held["slots"].groupBy(*TASK).agg(F.min("total_feeds").alias("__held")), TASK, "full_outer")
        sizes = sizes.join(ended.select(*TASK, F.col("total_feeds").alias("__ended")), TASK, "left")
        sizes = sizes.select(*TASK, F.coalesce("__ended", "__held", "__rows").alias("total_feeds"), F.col("__ended").isNotNull().alias("over"))

        each = once(rows.groupBy(*TASK, "feed_index").agg(F.count("*").alias("copies")).join(sizes, TASK))
        bucket = F.floor(F.col("feed_index") / BITS).cast("bigint")
        each = each.withColumns({"bucket": bucket, "position": F.col("feed_index") % BITS})
        real = F.col("feed_index").isNotNull() & F.col("feed_index").between(0, F.col("total_feeds") - 1)
        before = held["slots"].select(*TASK, "bucket", F.col("bits").alias("__bits"))
        asked = each.join(before, [*TASK, "bucket"], "left")
        twice = F.col("over") | has_bit(F.col("__bits"), F.col("position"))
        surplus = F.when(~real, F.col("copies")).when(twice, F.col("copies")).otherwise(F.col("copies") - 1)
        wrong = asked.withColumns({"kind": F.when(real, "completed_twice").otherwise("missing_slot"), "copies": surplus}).where("copies > 0")

        new = each.where(real & ~F.col("over")).groupBy(*TASK, "total_feeds", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
        after = once(new.unionByName(held["slots"]).groupBy(*TASK, "bucket").agg(F.min("total_feeds").alias("total_feeds"), F.bitmap_or_agg("bits").alias("bits")))
        counts = after.groupBy(*TASK).agg(F.sum(F.bitmap_count("bits")).alias("delivered"), F.min("total_feeds").alias("total_feeds"))
        full = F.col("delivered") == F.col("total_feeds")
        complete = counts.where(full)
        filled = complete.select(*TASK, F.lit("task_complete").alias("kind"), F.lit(None).cast("bigint").alias("feed_index"), F.lit(None).cast("bigint").alias("copies"), "delivered", "total_feeds")
        errors = wrong.join(counts.select(*TASK, "delivered"), TASK, "left").withColumn("delivered", F.when(F.col("over"), F.col("total_feeds")).otherwise(F.coalesce("delivered", F.lit(0))))
        out = errors.select(filled.columns).unionByName(filled)
        open_ = after.join(complete.select(*TASK), TASK, "left_anti").select("task_id", "execution_id", "total_feeds", "bucket", "bits")
        keeps = ended.unionByName(complete.select(*TASK, "total_feeds", (at + F.expr(f"INTERVAL {keep}")).alias("until")))
        return out, {"slots": open_, "ended": keeps, "clock": clock}

    return MicroBatches(rows, step, folder, replaced={"slots": SLOTS, "ended": ENDED, "clock": CLOCK})


def open_slots(batches: MicroBatches) -> DataFrame:
    """(task_id, execution_id, feed_index) of the slots that tasks with some result still wait for."""
    held = batches.latest()["slots"]
    tasks = held.groupBy(*TASK).agg(F.min("total_feeds").alias("total_feeds"))
    wanted = tasks.select(*TASK, F.explode(F.expr("sequence(0L, total_feeds - 1)")).alias("feed_index"))
    wanted = wanted.withColumn("bucket", F.floor(F.col("feed_index") / BITS).cast("bigint"))
    asked = wanted.join(held.select(*TASK, "bucket", "bits"), [*TASK, "bucket"], "left")
    return asked.where(~has_bit(F.col("bits"), F.col("feed_index") % BITS)).select(*TASK, "feed_index")
