"""Sinks: task results, embeddings, catalogue. Builders give documents as rows; writers put them on storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.text import rfc3339
from newsflow.operators.releases import order_catalog
from newsflow.operators.tasks import TASK, dedup_counts, dedup_groups, dedup_sources

CONTRACT_VERSION = "rss-worker-result"  # fixed value


def with_text_times(df: DataFrame) -> DataFrame:
    """Timestamps as the text that stands in documents."""
    times = [f.name for f in df.schema if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: rfc3339(F.col(c)) for c in times}) if times else df


def task_result_events(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Feed results with their deduplicated sources nested in order, one row per (task, feed_index)."""
    slot = [*TASK, "feed_index"]
    document = F.struct(
        "source_pos", "title", "url", "summary", "authors", rfc3339(F.col("published_at")).alias("published_at"), "image_url"
    )
    nested = dedup_sources(sources).groupBy(*slot).agg(F.array_sort(F.collect_list(document)).alias("__s"))
    none = F.array().cast(nested.schema["__s"].dataType)
    rows = with_text_times(results).join(nested, slot, "left")
    return rows.withColumn("sources", F.transform(F.coalesce("__s", none), lambda s: s.dropFields("source_pos"))).drop("__s")


def task_result_payloads(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Result document of every task as JSON: one lease in, one document out, whatever its size.

    ``results``: task key, feed_index and result columns. ``sources``: task key, feed_index and source columns. A document
    holds what the lease asked for, and the lease stood in one row as well; everything before this last step is in long
    form.
    """
    events = task_result_events(results, sources)
    value = [c for c in events.columns if c not in (*TASK, "feed_index")]
    event = F.struct("feed_index", F.struct(*value).alias("event"))
    by_task = events.groupBy(*TASK).agg(
        F.array_sort(F.collect_list(event), lambda a, b: (a.feed_index - b.feed_index).cast("int")).alias("__e")
    )
    dropped = F.transform(F.array_sort(F.collect_list(F.struct("feed_index", "source_pos", "dropped_url"))), lambda d: d.dropped_url)
    groups = (
        dedup_groups(sources)
        .groupBy(*TASK, "dedup_key")
        .agg(F.first("reason").alias("reason"), F.first("kept_url").alias("kept_url"), dropped.alias("dropped_urls"))
        .groupBy(*TASK)
        .agg(F.array_sort(F.collect_list(F.struct("dedup_key", "reason", "kept_url", "dropped_urls"))).alias("groups"))
    )
    none = F.array().cast(groups.schema["groups"].dataType)
    rows = by_task.join(groups, TASK, "full_outer").join(dedup_counts(sources, TASK), TASK, "left")
    counts = [
        F.coalesce(F.col(n), F.lit(0)).alias(n) for n in ("input_candidates", "output_candidates", "duplicates_dropped")
    ]
    dedup = F.struct(F.lit("task").alias("scope"), *counts, F.coalesce("groups", none).alias("groups"))
    result_events = F.transform(F.coalesce("__e", F.array().cast(by_task.schema["__e"].dataType)), lambda e: e.event)
    payload = F.struct(
        F.lit(CONTRACT_VERSION).alias("contract_version"),
        result_events.alias("result_events"),
        dedup.alias("local_dedup"),
    )
    return rows.select(*TASK, F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def embedding_payloads(vectors: DataFrame, error: str | None = None) -> DataFrame:
    """Embedding document of every task, ``{"sources": [{id, embedding}]}``, in order of position.

    ``vectors``: task key, source_pos, id, embedding; one lease in, one document out. With ``error``, a column of messages,
    a task in which any source has one gives no document but, as ``error_message``, the one of its first position.
    """
    item = F.struct("source_pos", F.struct("id", F.col("embedding").cast("array<double>").alias("embedding")).alias("s"))
    made = [F.array_sort(F.collect_list(item)).alias("__i")]
    if error:
        made.append(F.min_by(error, F.when(F.col(error).isNotNull(), F.col("source_pos"))).alias("error_message"))
    rows = vectors.groupBy(*TASK).agg(*made)
    payload = F.to_json(F.struct(F.transform("__i", lambda i: i.s).alias("sources")))
    if not error:
        return rows.select(*TASK, payload.alias("payload"))
    return rows.select(*TASK, F.when(F.col("error_message").isNull(), payload).alias("payload"), "error_message")


def write_payloads(payloads: DataFrame, path: str, mode: str = "append") -> None:
    """Payload documents as Parquet; the payload text stays byte for byte what was signed."""
    payloads.write.mode(mode).parquet(path)


def write_embeddings(vectors: DataFrame, path: str, mode: str = "append") -> None:
    vectors.withColumn("embedding", F.col("embedding").cast("array<double>")).write.mode(mode).parquet(path)


def write_run(rows: DataFrame, path: str, run: str) -> bool:
    """Rows as Parquet under the key of a run, which counts once however often it is written.

    An attempt writes into a folder of its own below ``path/attempts``; then a manifest ``path/runs/<run>`` that names it is
    put in place by a rename that never replaces. Only what a manifest names is read (``read_runs``), so a job that died, a
    retry, or two that run at once leave one copy. False says that the run stood already and nothing was added.
    """
    spark = rows.sparkSession
    files = _files(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    manifest = hadoop.Path(f"{path}/runs/{quote(run, safe='')}")
    if files.exists(manifest):
        return False
    attempt = uuid.uuid4().hex
    rows.write.parquet(f"{path}/attempts/{attempt}")
    draft = hadoop.Path(f"{path}/drafts/{attempt}")
    out = files.create(draft, False)
    out.write(bytearray(attempt.encode()))
    out.close()
    files.mkdirs(manifest.getParent())
    never_replace = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(manifest), never_replace)
    except Py4JJavaError as lost:
        if "FileAlreadyExistsException" not in lost.java_exception.getClass().getName():
            raise
        files.delete(draft, False)
        files.delete(hadoop.Path(f"{path}/attempts/{attempt}"), True)
        return False
    return True


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed runs; the driver holds one name for each run."""
    files = _files(spark, path)
    runs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/runs")
    found = files.listStatus(runs) if files.exists(runs) else []
    attempts = [r.getPath() for r in found if not r.getPath().getName().startswith(".")]
    names = [_content(spark, files, p) for p in attempts]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/attempts/{n}" for n in names])


def run_writer(path: str, job: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is a run of its own, so one that is replayed adds nothing."""

    def write(rows: DataFrame, number: int) -> None:
        write_run(rows, path, f"{job}/{number}")

    return write


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _content(spark: SparkSession, files, path) -> str:  # noqa: ANN001
    stream = files.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def catalog_documents(items: DataFrame) -> DataFrame:
    """Catalogue items in total order as documents ``{"items": [...]}``, one for each partition of the order.

    Read one after another, in order of the files, the documents are the whole catalogue; a small one is one document.
    """
    rows = order_catalog(items).withColumn("__at", F.monotonically_increasing_id())
    item = F.struct("__at", F.struct(*items.columns).alias("item"))
    part = F.shiftright("__at", 33).alias("part")
    gathered = rows.groupBy(part).agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["item"]).alias("items"))
    document = F.to_json(F.struct("items"), {"ignoreNullFields": "true"})
    return gathered.select("part", document.alias("value"))


def write_catalog(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The catalogue in the form that ``read_catalog`` reads."""
    catalog_documents(items).orderBy("part").select("value").write.mode(mode).text(path)
