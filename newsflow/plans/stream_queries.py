"""Queries over the continuous forms (group S): each drains its input as a stream and reads back what was written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.plans.embed_queries import letter_share_model, share_sql, vector_rows
from newsflow.plans.feed_queries import ASSEMBLED_SQL
from newsflow.plans.inputs import VIEWS, load
from newsflow.plans.registry import ORACLES, joined, query, us
from newsflow.plans.telemetry_queries import SPACING_MS
from newsflow.plans.work_queries import RATE_SQL, SIX_HOURS_US
from newsflow.sources import readers
from newsflow.streaming import jobs
from newsflow.streaming.carried import MicroBatches


def run_folder(spark: SparkSession) -> str:
    """A new folder for one run: below the cluster's shared checkpoint folder, or temporary where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="newsflow-")
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a file stream, with zone-less times as timestamps."""
    path = f"{sf}/{name}.parquet"
    # the pattern lets the table be one file as well as a folder
    table = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    zoneless = [f.name for f in table.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return table.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


@query("s1_stream_ingest", ASSEMBLED_SQL)
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Two entries of a page arrive together, so the first keeps its place."""
    [marks] = load(spark, sf, "v_marks")
    pages = stream_table(spark, sf, "pages")
    n, none = F.col("page_id"), F.lit(None).cast("string")
    hour = F.timestamp_seconds(F.lit(1704067200) + n * 3600)
    title = F.when(n % 11 == 0, F.lit("   ")).otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    first = F.struct((n * 10).alias("entry_pos"), title.alias("title"), F.when(n % 7 != 0, hour).alias("published"))
    copy = F.struct(
        (n * 10 + 1).alias("entry_pos"), F.lit("copy").alias("title"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("published")
    )
    both = pages.select(
        "page_id", "url", "html", F.explode(F.when(n % 4 == 0, F.array(first, copy)).otherwise(F.array(first))).alias("e")
    )
    entries = both.select(
        (n % 20).alias("feed_id"), "e.entry_pos", F.array(F.lit(" "), F.concat(F.lit("  "), "url")).alias("links"), "e.title",
        F.col("html").alias("summary"), none.alias("content_body"), none.alias("content_src"),
        F.array(F.lit("By Alice Martin, ALICE  MARTIN"), F.lit("AFP")).alias("authors"), "e.published",
        F.lit(None).cast("timestamp").alias("updated"), F.array().cast(readers.MEDIA).alias("media"), hour.alias("arrived_at"),
    )
    rows = jobs.Ingest(entries, run_folder(spark), marks, keep="30 days").drain()
    return rows.select(
        "feed_id", "source_pos", "title", "url", "summary", joined("authors").alias("authors"),
        us("published_at").alias("published_us"), "image_url",
    )


@query("s2_stream_rate_slots", RATE_SQL)
def stream_rate_slots(spark: SparkSession, sf: str) -> DataFrame:
    events = stream_table(spark, sf, "events")
    batches = jobs.rate_slots(events, run_folder(spark), "user_id", SIX_HOURS_US, segment_us=24 * 3_600_000_000)
    return batches.drain().select("event_id", "slot_us")


@query("s3_stream_status", ORACLES["h3_throttle"])
def stream_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = _status(spark, sf).drain().where(F.col("kind") == "emitted")
    return rows.select(F.col("worker").cast("bigint").alias("worker"), "event_id")


@query("s3_stream_status_fold", ORACLES["h1_status_fold"])
def stream_status_fold(spark: SparkSession, sf: str) -> DataFrame:
    """What the workers carry when all updates are in."""
    batches = _status(spark, sf)
    batches.drain()
    return jobs.snapshots(batches).select(
        F.col("worker").cast("bigint").alias("worker"), "phase", "server_connection", "current_task_id", "last_error",
        "completed_task_count", "bytes_received", us("last_server_contact_at").alias("contact_us"), us("last_updated_at").alias("updated_us"),
    )


def _status(spark: SparkSession, sf: str) -> MicroBatches:
    updates = spark.sql(VIEWS["v_status"], events=stream_table(spark, sf, "events"))
    return jobs.status(updates, run_folder(spark), interval_ms=SPACING_MS, segment_us=24 * 3_600_000_000)


@query(
    "s4_stream_embeddings",
    share_sql(
        r"""SELECT doc_id AS id, concat('passage: title: ', source, ' | summary: ', trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS t
            FROM {documents}"""
    ),
)
def stream_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_folder(spark)
    documents = stream_table(spark, sf, "documents")
    sources = documents.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("summary"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.where("error IS NULL").select("id", "embedding").write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    jobs.stream_embeddings(sources, letter_share_model, write, f"{folder}/checkpoint", 64, None).start().awaitTermination()
    return vector_rows(spark.read.parquet(f"{folder}/out"))


# Results of five slots for each task: one in 22 comes twice, one in 35 for a slot that its task does not have, and some
# of the others come once more when the task may be complete.
RESULTS_SQL = """
    SELECT doc_id // 5 AS task_id, doc_id % 5 + CASE WHEN doc_id % 35 = 0 THEN 9 ELSE 0 END AS feed_index,
           1 + (CASE WHEN doc_id % 22 = 1 THEN 1 ELSE 0 END) AS n
    FROM {documents}"""


@query(
    "s5_stream_task_completion",
    f"""WITH r AS ({RESULTS_SQL}), good AS (SELECT * FROM r WHERE feed_index < 5),
             done AS (SELECT task_id, count(*) AS delivered FROM good GROUP BY task_id)
       SELECT task_id, 'task_complete' AS kind, CAST(NULL AS BIGINT) AS feed_index, CAST(NULL AS BIGINT) AS copies FROM done WHERE delivered = 5
       UNION ALL SELECT task_id, 'completed_twice', feed_index, CAST(n - 1 AS BIGINT) FROM good WHERE n > 1
       UNION ALL SELECT task_id, 'missing_slot', feed_index, CAST(n AS BIGINT) FROM r WHERE feed_index >= 5
       UNION ALL SELECT d.task_id, 'open_slot', s.i, CAST(NULL AS BIGINT)
                 FROM (SELECT task_id FROM done WHERE delivered < 5) d, (SELECT unnest(range(5)) AS i) s
                 WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.task_id = d.task_id AND g.feed_index = s.i)""",
)
def stream_task_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Every document delivers a slot of its task; what is still open at the end is listed as well."""
    n = F.col("doc_id")
    documents = stream_table(spark, sf, "documents")
    slot = (n % 5 + F.when(n % 35 == 0, 9).otherwise(0)).cast("bigint")
    results = documents.select(
        F.floor(n / 5).alias("task_id"), F.lit(1).cast("bigint").alias("execution_id"),
        F.explode(F.when(n % 22 == 1, F.array(slot, slot)).otherwise(F.array(slot))).alias("feed_index"),
        F.lit(5).cast("bigint").alias("total_feeds"),
    )
    batches = jobs.task_completion(results, run_folder(spark))
    rows = batches.drain().select("task_id", "kind", "feed_index", "copies")
    none = F.lit(None).cast("bigint")
    return rows.unionByName(jobs.open_slots(batches).select("task_id", F.lit("open_slot").alias("kind"), "feed_index", none.alias("copies")))
