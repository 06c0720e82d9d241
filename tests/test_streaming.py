"""Streams over several micro-batches give what the batch forms give."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from newsflow.operators import embed, entries, fetch
from newsflow.plans.embed_queries import letter_share_model
from newsflow.streaming import jobs

SECOND = 1_000_000
BASE = 1_704_067_200 * SECOND


def file_stream(spark, df, folder, files=1):
    """A stream that reads the given rows in files of event order, one file per micro-batch."""
    df = df.orderBy("ts", "event_id").withColumn("n", F.monotonically_increasing_id())
    rows = df.drop("n").collect()
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], df.drop("n").schema)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def events(spark, rng, n, keys=4, span=120):
    ops = ["transfer"] * 6 + ["processing", "completed", "error", "connected", "disconnected", "idle"]
    rows = [(0 if rng.random() < 0.34 else rng.randrange(1, keys), i, BASE + rng.randrange(span * SECOND), rng.choice(ops), i % 7) for i in range(n)]
    df = spark.createDataFrame(rows, "worker bigint, event_id bigint, us bigint, op string, bytes_received bigint")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def test_rate_slots(spark, tmp_path):
    """One host holds a third of the rows over many micro-batches, and segments cut its batches again."""
    df = events(spark, random.Random(1), 300)
    batch = fetch.assign_rate_slots(df, "worker", "ts", "event_id", SECOND // 2)
    stream = jobs.rate_slots(file_stream(spark, df, tmp_path, 5), str(tmp_path), "worker", SECOND // 2, segment_us=3 * SECOND)
    got = stream.drain().collect()
    assert len(got) == 300
    assert {(r.event_id, r.slot_us) for r in got} == {(r.event_id, r.slot_us) for r in batch.collect()}
    left = {r.host_key: r.next_slot_us for r in stream.latest()["hosts"].collect()}
    assert left == {h: max(r.slot_us for r in got if r.host_key == h) + SECOND // 2 for h in left} and len(left) == 4


def test_a_batch_that_runs_again_takes_effect_once(spark, tmp_path):
    df = events(spark, random.Random(1), 90)
    stream = jobs.rate_slots(file_stream(spark, df, tmp_path, 3), str(tmp_path), "worker", SECOND // 2)
    want = sorted(map(tuple, stream.drain().collect()))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    last = spark.read.schema(df.schema).parquet(str(files[-1]))
    again = last.select(F.col("worker").cast("string").alias("host_key"), "event_id", "ts")
    stream.run(again, 2)
    assert sorted(map(tuple, stream.read().collect())) == want
    assert [p.name for p in sorted((tmp_path / "state" / "hosts").iterdir())] == ["v=000000001", "v=000000002"]


def test_status_fold_and_flush(spark, tmp_path):
    rows = [
        ("w", 1, 0.0, "processing", 5), ("w", 2, 0.4, "transfer", 7), ("w", 3, 0.8, "transfer", 1),
        ("x", 4, 0.0, "connected", 0), ("x", 5, 2.0, "transfer", 2), ("x", 6, 500.0, "idle", 0),
    ]
    df = spark.createDataFrame(rows, "worker string, event_id bigint, s double, op string, bytes_received bigint")
    df = df.withColumn("ts", F.timestamp_micros((F.col("s") * SECOND).cast("bigint") + BASE)).drop("s")
    got = jobs.status(file_stream(spark, df, tmp_path, 3), str(tmp_path)).drain().collect()
    emitted = sorted((r.worker, r.event_id, r.phase, r.bytes_received) for r in got if r.kind == "emitted")
    assert emitted == [("w", 1, "processing", 5), ("x", 4, "starting", 0), ("x", 5, "starting", 2), ("x", 6, "idle", 2)]
    # the two updates of "w" that were held back leave together, as one row with both transfers
    assert [(r.worker, r.bytes_received, r.phase) for r in got if r.kind != "emitted"] == [("w", 13, "processing")]


FOLDED = ["phase", "has_task", "last_error", "server_connection", "completed_task_count", "bytes_received", "last_updated_at"]


def test_status_stream_end_equals_the_fold(spark, tmp_path):
    from newsflow.operators import telemetry

    df = events(spark, random.Random(2), 240)
    stream = jobs.status(file_stream(spark, df, tmp_path, 3), str(tmp_path), interval_ms=0)
    got = stream.drain()
    assert got.where("kind = 'emitted'").count() == df.count() == got.count()
    last = got.groupBy("worker").agg(F.max_by(F.struct(*FOLDED), F.struct("last_updated_at", "event_id")).alias("s")).select("worker", "s.*")
    expected = telemetry.fold_status(df).select(F.col("worker").cast("string").alias("worker"), *FOLDED)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, expected.collect()))


def test_late_status_updates_count(spark, tmp_path):
    """Files in any order: nothing is lost, and what the workers carry is the fold of all updates."""
    from newsflow.operators import telemetry

    df = events(spark, random.Random(5), 200)
    rows = df.collect()
    random.Random(9).shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[50 * i : 50 * i + 50], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = jobs.status(source, str(tmp_path))
    got = stream.drain()
    expected = telemetry.fold_status(df).select(F.col("worker").cast("string").alias("worker"), *FOLDED)
    assert sorted(map(tuple, jobs.snapshots(stream).select("worker", *FOLDED).collect())) == sorted(map(tuple, expected.collect()))
    corrected = got.where("kind = 'correction'")
    assert corrected.count() > 0 and corrected.where("event_id IS NOT NULL").count() == 0
    total = {r.worker: r.n for r in df.groupBy("worker").agg(F.sum("bytes_received").alias("n")).collect()}
    newest = {r.worker: r.n for r in got.groupBy("worker").agg(F.max("bytes_received").alias("n")).collect()}
    assert newest[str(0)] == total[0]


def completions(spark, rows):
    df = spark.createDataFrame(rows, "task_id bigint, execution_id bigint, feed_index bigint, total_feeds bigint, event_id bigint")
    return df.withColumn("ts", F.timestamp_seconds("event_id"))


def test_task_completion_over_batches(spark, tmp_path):
    rows = [(t, 1, i, 3, t * 10 + i) for t in range(5) for i in range(3) if (t, i) != (4, 2)]
    rows += [(0, 1, 1, 3, 100), (0, 1, 1, 3, 101), (1, 1, 7, 3, 102), (1, 1, None, 3, 103), (4, 1, 0, 3, 104)]
    stream = jobs.task_completion(file_stream(spark, completions(spark, rows), tmp_path, 3), str(tmp_path), "ts")
    got = [(r.task_id, r.kind, r.copies) for r in stream.drain().collect()]
    wrong = [(0, "completed_twice", 2), (1, "missing_slot", 1), (1, "missing_slot", 1), (4, "completed_twice", 1)]
    assert sorted(got, key=str) == sorted([(t, "task_complete", None) for t in range(4)] + wrong, key=str)
    assert [tuple(r) for r in jobs.open_slots(stream).collect()] == [(4, 1, 2)]


def test_completed_tasks_leave_state(spark, tmp_path):
    """Bitmaps go when a task is complete, its short row when it has been complete for long enough."""
    day = 86_400
    rows = [(1, 1, i, 40_000, i) for i in range(0, 40_000, 7_000)]  # more slots than one bitmap holds
    rows += [(2, 1, i, 2, 10 + i) for i in range(2)] + [(2, 1, 0, 2, day)] + [(3, 1, 0, 1, 5 * day)]
    df = completions(spark, rows)
    first, second, third = (df.where(c) for c in (f"event_id < {day}", f"event_id = {day}", f"event_id > {day}"))
    for part in (first, second, third):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = jobs.task_completion(source, str(tmp_path), "ts", keep="2 days")
    got = sorted((r.task_id, r.kind, r.feed_index) for r in stream.drain().collect())
    assert got == [(2, "completed_twice", 0), (2, "task_complete", None), (3, "task_complete", None)]
    left = stream.latest()
    assert [r.task_id for r in left["ended"].collect()] == [3]
    assert sorted((r.task_id, r.bucket) for r in left["slots"].collect()) == [(1, 0), (1, 1)]
    assert jobs.open_slots(stream).count() == 40_000 - 6


def entry_rows(spark, rows):
    return spark.createDataFrame(rows, "feed_id int, entry_pos int, u string, us bigint").select(
        "feed_id", "entry_pos", F.array("u").alias("links"), F.concat(F.lit("t"), "entry_pos").alias("title"), F.lit("<b>s</b>").alias("summary"),
        F.lit(None).cast("string").alias("content_body"), F.lit(None).cast("string").alias("content_src"),
        F.array(F.lit("By Ann Lee")).alias("authors"), F.timestamp_micros("us").alias("published"), F.lit(None).cast("timestamp").alias("updated"),
        F.array().cast("array<struct<thumbnails:array<string>,content:array<struct<url:string,content_type:string>>>>").alias("media"),
        F.timestamp_micros("us").alias("arrived_at"),
    )


def test_ingest_first_position_wins_over_arrivals(spark, tmp_path):
    """Files in the reverse order of positions give what the batch form gives."""
    rows = [(i % 3, i, f"https://x/{i % 20}", BASE + i * SECOND) for i in range(90)]
    df = entry_rows(spark, rows)
    for at in (60, 30, 0):
        df.where(F.col("entry_pos").between(at, at + 29)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.Ingest(source, str(tmp_path)).drain()
    assert sorted(map(str, got.collect())) == sorted(map(str, entries.assemble_sources(df).collect()))


def test_ingest_emits_once_and_forgets(spark, tmp_path):
    """An entry goes out when its time is over, copies are dropped for a while, then it is new; late entries are kept."""
    hour = 3600 * SECOND
    batches = [[(1, 5, "a", BASE)], [(1, 2, "a", BASE + hour // 2)], [(1, 9, "z", BASE + 2 * hour)], [(1, 0, "a", BASE + 3 * hour), (2, 7, "late", BASE)], [(1, 1, "a", BASE + 40 * hour)]]
    for rows in batches:
        entry_rows(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(entry_rows(spark, batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    job = jobs.Ingest(source, str(tmp_path), hold="1 hour", keep="10 hours")
    job.batches.compact = 2
    sent = job.batches.drain()
    assert sorted((r.feed_id, r.source_pos) for r in sent.collect()) == [(1, 2), (1, 9), (2, 7)]
    assert [(r.url, r.source_pos) for r in job.waiting().collect()] == [("a", 1)]
    assert sorted(r.url for r in job.batches.latest()["gone"].collect())  # what is kept of it
    assert sorted(p.name for p in (tmp_path / "state" / "gone").iterdir()) == ["v=000000003", "v=000000004"]


def test_embedding_stream(spark, tmp_path):
    df = events(spark, random.Random(3), 40).selectExpr("event_id", "ts", "concat('title ', event_id) AS title", "op AS summary")
    seen = f"{tmp_path}/out"

    def write(batch, batch_id):
        batch.select("event_id", "embedding").write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")

    stream = file_stream(spark, df, tmp_path, 2)
    jobs.stream_embeddings(stream, letter_share_model, write, f"{tmp_path}/cp", 8, None).start().awaitTermination()
    got = {r.event_id: r.embedding for r in spark.read.parquet(seen).collect()}
    expected = embed.embed(embed.with_passage(df), letter_share_model, 8).collect()
    assert got == {r.event_id: r.embedding for r in expected}
