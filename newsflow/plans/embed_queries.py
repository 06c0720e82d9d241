"""Queries over embeddings and payload integrity (groups A8, A9, F, G)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.canonical import EXPONENT_SIGN
from newsflow.operators import embed, integrity
from newsflow.plans.feed_queries import assembled
from newsflow.plans.inputs import load
from newsflow.plans.registry import big, joined, query
from newsflow.plans.scan import explode_once
from newsflow.sources import readers, sinks

DIMENSIONS = 64


LETTERS = " etaoinsrhldcumf"


def letter_share_model() -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in model: share of each of 16 characters in the text. Real models plug in the same way."""

    def predict(texts: np.ndarray) -> np.ndarray:
        return np.asarray([[t.count(c) / max(len(t), 1) for c in LETTERS] for t in texts])

    return predict


def vector_rows(vectors: DataFrame) -> DataFrame:
    """id, dim, value: one row per vector element."""
    rows = explode_once(vectors.select("id", "embedding"), "embedding", "value", position="dim")
    return rows.select("id", big("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


def share_sql(text: str) -> str:
    """The stand-in model as SQL over a subquery (id, t)."""
    letters = ", ".join(f"({i}, '{c}')" for i, c in enumerate(LETTERS))
    share = "CAST(length(t) - length(replace(t, c, '')) AS DOUBLE) / greatest(length(t), 1)"
    return f"""SELECT id, CAST(dim AS BIGINT) AS dim, round(CAST(CAST({share} AS FLOAT) AS DOUBLE), 6) AS value
               FROM ({text}), (VALUES {letters}) l(dim, c)"""


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as embedding sources: first line words as title, text as summary for most."""
    [documents] = load(spark, sf, "documents")
    n = F.col("doc_id")
    summary = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.lit(" \t ")).otherwise(F.col("text"))
    return documents.select(
        (n % 50).alias("task_id"), (n % 50 % 3).alias("execution_id"), n.alias("source_pos"), n.alias("id"),
        F.concat(F.lit("  "), F.col("source"), F.lit("\n  "), F.col("lang")).alias("title"), summary.alias("summary"),
    )


PASSAGE_SQL = r"""
    SELECT doc_id AS id, concat('passage: title: ', source, ' ', lang,
           CASE WHEN doc_id % 5 > 1 THEN concat(' | summary: ', trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) ELSE '' END) AS passage
    FROM {documents}"""


@query("f1_passage_text", PASSAGE_SQL)
def passage_text(spark: SparkSession, sf: str) -> DataFrame:
    return embed.with_passage(passages(spark, sf)).select("id", "passage")


@query(
    "f2_chunks",
    """SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS BIGINT) AS chunk
       FROM {conversations}""",
)
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    [turns] = load(spark, sf, "conversations")
    return embed.with_chunks(turns, 3, ["conv_id"], "turn").select("conv_id", "turn", "chunk")


@query("f3_embed", share_sql(f"SELECT id, passage AS t FROM ({PASSAGE_SQL})"))
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return vector_rows(embed.embed(embed.with_passage(passages(spark, sf)), letter_share_model, 64))


_WORDS = "list_transform(string_split(text, ' '), lambda w: length(w))"


@query(
    "f4_pad_batches",
    f"""WITH t AS (SELECT doc_id, doc_id // 16 AS batch, {_WORDS} AS ids FROM {{documents}}),
             b AS (SELECT batch, greatest(max(least(len(ids), 128)), 1) AS n FROM t GROUP BY batch)
        SELECT doc_id, CAST(n AS BIGINT) AS sequence_length, CAST(least(len(ids), n) AS BIGINT) AS live,
               array_to_string(list_concat(ids[1:least(len(ids), n)], list_transform(range(n - least(len(ids), n)), lambda x: 0)), ',') AS input_ids
        FROM t JOIN b USING (batch)""",
)
def pad_batches(spark: SparkSession, sf: str) -> DataFrame:
    [documents] = load(spark, sf, "documents")
    ids = F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint"))
    encoded = documents.select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), ids.alias("input_ids"))
    rows = embed.pad_batches(encoded, ["batch"], 128)
    live = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    text = F.transform("input_ids", lambda x: x.cast("string"))
    return rows.select("doc_id", big("sequence_length"), live.alias("live"), joined(text, ",").alias("input_ids"))


@query(
    "f5_mean_pool",
    """SELECT CAST(label AS BIGINT) AS doc, dim, round(avg(CASE WHEN vec_id % 5 <> 0 THEN v END), 6) AS value
       FROM (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM {embeddings})
       GROUP BY label, dim""",
)
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    pooled = _pooled(spark, sf)
    rows = pooled.select(F.col("label").cast("bigint").alias("doc"), F.posexplode("pooled").alias("dim", "value"))
    return rows.select("doc", big("dim"), F.round("value", 6).alias("value"))


def _pooled(spark: SparkSession, sf: str) -> DataFrame:
    [vectors] = load(spark, sf, "embeddings")
    states = vectors.withColumn("mask", F.when(F.col("vec_id") % 5 != 0, 1).otherwise(0))
    return embed.mean_pool(states, DIMENSIONS, ["label"], "mask", "embedding")


@query(
    "f6_l2_normalize",
    """WITH s AS (SELECT vec_id, CAST(CAST(unnest(embedding) AS DOUBLE) * (vec_id % 7) AS FLOAT) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM {embeddings}),
            n AS (SELECT vec_id, sqrt(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS norm FROM s GROUP BY vec_id)
       SELECT vec_id, dim, round(CAST(CAST(CASE WHEN norm > 0 THEN v / norm ELSE v END AS FLOAT) AS DOUBLE), 4) AS value FROM s JOIN n USING (vec_id)""",
)
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    [vectors] = load(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: (x * (F.col("vec_id") % 7)).cast("float"))
    rows = embed.with_unit_vector(vectors.withColumn("pooled", scaled), "pooled", "unit")
    exploded = rows.select("vec_id", F.posexplode("unit").alias("dim", "value"))
    return exploded.select("vec_id", big("dim"), F.round(F.col("value").cast("double"), 4).alias("value"))


@query(
    "f7_shape_audit",
    """WITH b AS (SELECT label, count(*) AS n, count(CASE WHEN vec_id % 50 <> 0 THEN 1 END) AS m FROM {embeddings} GROUP BY label)
       SELECT CAST(label AS BIGINT) AS label, CASE WHEN label = 0 THEN 'unexpected embedding tensor rank: expected 3, got 2'
                          WHEN label % 3 = 1 THEN concat('unexpected embedding tensor size: expected ', (n + 1) * 64, ', got ', n * 64)
                          ELSE concat('unexpected attention mask size: expected ', n, ', got ', m) END AS reason
       FROM b WHERE label = 0 OR label % 3 = 1 OR n <> m""",
)
def shape_audit(spark: SparkSession, sf: str) -> DataFrame:
    [vectors] = load(spark, sf, "embeddings")
    n = F.count("*").cast("int")
    shape = F.when(F.col("label") == 0, F.array("n", F.lit(64))).otherwise(
        F.array(F.lit(1), F.col("n") + F.when(F.col("label") % 3 == 1, 1).otherwise(0), F.lit(64))
    )
    batches = vectors.groupBy("label").agg(n.alias("n")).select("label", shape.alias("shape"))
    mask = F.when(F.col("vec_id") % 50 != 0, 1)
    rows = embed.audit_shapes(batches, vectors.select("label", F.col("embedding").alias("vector"), mask.alias("mask")), ["label"])
    return rows.select(big("label"), "reason")


@query(
    "f8_count_audit",
    """SELECT conv_id AS task_id, count(*) AS expected, count(CASE WHEN turn % 4 <> 3 THEN 1 END) AS produced,
              concat('embedding count mismatch for task ', conv_id, ': expected ', count(*), ', got ',
                     count(CASE WHEN turn % 4 <> 3 THEN 1 END)) AS error_message
       FROM {conversations} GROUP BY conv_id HAVING count(*) <> count(CASE WHEN turn % 4 <> 3 THEN 1 END)""",
)
def count_audit(spark: SparkSession, sf: str) -> DataFrame:
    [turns] = load(spark, sf, "conversations")
    sources = turns.withColumnRenamed("conv_id", "task_id")
    return embed.audit_counts(sources, sources.where(F.col("turn") % 4 != 3))


@query(
    "f9_pair_vectors",
    """SELECT l.doc_id AS id, e.vec_id % 10 AS task_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS norm,
              embedding[1]::DOUBLE AS first_value
       FROM {embeddings} e JOIN {documents} l ON l.doc_id = e.vec_id""",
)
def pair_vectors(spark: SparkSession, sf: str) -> DataFrame:
    documents, vectors = load(spark, sf, "documents", "embeddings")
    keys = ["task_id", "source_pos"]
    sources = documents.select((F.col("doc_id") % 10).alias("task_id"), F.col("doc_id").alias("source_pos"), F.col("doc_id").alias("id"))
    produced = vectors.select((F.col("vec_id") % 10).alias("task_id"), F.col("vec_id").alias("source_pos"), "embedding")
    rows = embed.pair_vectors(sources, produced, keys)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("id", "task_id", F.round(norm, 5).alias("norm"), F.get("embedding", F.lit(0)).alias("first_value"))


# ---- integrity ----------------------------------------------------------------------------------
def json_string_sql(text: str) -> str:
    """A JSON string of ASCII characters only."""
    code = "unicode(c)"
    pair = f"format('\\u{{:04x}}\\u{{:04x}}', 55296 + (({code} - 65536) >> 10), 56320 + (({code} - 65536) & 1023))"
    escaped = (
        f"CASE c WHEN '\"' THEN '\\\"' WHEN '\\' THEN '\\\\' WHEN chr(10) THEN '\\n' WHEN chr(13) THEN '\\r' WHEN chr(9) THEN '\\t' "
        f"WHEN chr(8) THEN '\\b' WHEN chr(12) THEN '\\f' ELSE CASE WHEN {code} BETWEEN 32 AND 127 THEN c "
        f"WHEN {code} < 65536 THEN format('\\u{{:04x}}', {code}) ELSE {pair} END END"
    )
    return f"concat('\"', array_to_string(list_transform(string_split({text}, ''), lambda c: {escaped}), ''), '\"')"


@query(
    "g1_canonical_payload",
    f"""SELECT doc_id, concat('{{"doc_id":', doc_id, ',"from":{{"lang":', {json_string_sql("lang")}, ',"source":', {json_string_sql("source")},
                              '}},"share":', CASE WHEN doc_id % 2 = 0 THEN '1e-07' ELSE '0.25' END, ',"text":', {json_string_sql("text")}, '}}') AS canonical
        FROM {{documents}}""",
)
def canonical_payload(spark: SparkSession, sf: str) -> DataFrame:
    [documents] = load(spark, sf, "documents")
    share = F.when(F.col("doc_id") % 2 == 0, F.lit(1e-7)).otherwise(F.lit(0.25))
    body = F.to_json(F.struct("text", "doc_id", share.alias("share"), F.struct("source", "lang").alias("from")))
    rows = integrity.with_canonical(documents.select("doc_id", body.alias("payload")), mode=EXPONENT_SIGN)
    return rows.select("doc_id", "canonical")


API_KEY = "secret-api-key"


def _signed_sql() -> str:
    """The signature with HMAC written out: the pads of the constant key are literals."""
    key = hashlib.sha256(API_KEY.encode()).hexdigest().encode()
    inner, outer = (bytes(k ^ pad for k in key).hex() for pad in (0x36, 0x5C))
    head = """concat('{"lease_id":"lease-', doc_id, '","nonce":"', md5(CAST(doc_id AS VARCHAR)), '","result_payload":{"n_chars":', n_chars, ',"text":', """
    head += json_string_sql("text") + """, '},"session_id":"s1"')"""
    tail = """concat(',"signed_at":"2024-01-01T00:00:00Z","task_type":"embed.source","trace_id":"', doc_id, '","worker_version":null}')"""
    return f"""SELECT doc_id, signature, concat(head, ',"signature":"', signature, '"', tail) AS request_body FROM (
        SELECT *, sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(concat(head, tail))))) AS signature
        FROM (SELECT doc_id, {head} AS head, {tail} AS tail FROM {{documents}}))"""


@query("g2_signatures", _signed_sql())
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    [documents] = load(spark, sf, "documents")
    n = F.col("doc_id").cast("string")
    rows = documents.select(
        "doc_id", F.concat(F.lit("lease-"), n).alias("lease_id"), F.lit("s1").alias("session_id"), n.alias("trace_id"),
        F.lit("embed.source").alias("task_type"), F.lit(None).cast("string").alias("worker_version"),
        F.lit("2024-01-01T00:00:00Z").alias("signed_at"), F.md5(n).alias("nonce"),
        F.to_json(F.struct("text", "n_chars")).alias("result_payload"),
    )
    signed = integrity.sign_payloads(rows, F.lit(API_KEY), mode=EXPONENT_SIGN)
    return signed.select("doc_id", "signature", "request_body")


@query(
    "g3_digest_verification",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'invalid_manifest' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'missing_artifact'
                            ELSE 'verified' END AS digest_status, sha256(html) AS actual
       FROM {pages}""",
)
def digest_verification(spark: SparkSession, sf: str) -> DataFrame:
    [pages] = load(spark, sf, "pages")
    n = F.col("page_id")
    digests = readers.digest_contents(pages.select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content")))
    scanned = digests.select(F.col("path").alias("artifact_name"), "sha256")
    digest = F.sha2("html", 256)
    given = (
        F.when(n % 4 == 0, F.left(digest, F.lit(63))).when(n % 4 == 1, F.sha2("url", 256))
        .otherwise(F.concat(F.lit("  "), F.upper(digest), F.lit("\n")))
    )
    name = F.when(n % 4 == 2, F.concat("url", F.lit("?"))).otherwise(F.col("url"))
    manifests = pages.select("page_id", name.alias("artifact_name"), given.alias("sha256"), digest.alias("actual"))
    return integrity.verify_digests(manifests, scanned).select("page_id", "digest_status", "actual")


@query(
    "g4_masked_secrets",
    """SELECT c_custkey, CASE WHEN length(secret) <= 8 THEN '********'
              ELSE concat(left(secret, 4), '***', right(secret, 4)) END AS secret
       FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS secret FROM {customer})""",
)
def masked_secrets(spark: SparkSession, sf: str) -> DataFrame:
    [customers] = load(spark, sf, "customer")
    secret = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    return integrity.mask_secrets(customers.select("c_custkey", secret.alias("secret")), "secret")


@query(
    "a7_artifact_digests",
    "SELECT doc_id, sha256(text) AS sha256 FROM {documents}",
)
def artifact_digests(spark: SparkSession, sf: str) -> DataFrame:
    [documents] = load(spark, sf, "documents")
    files = documents.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return readers.digest_contents(files).select(F.col("path").cast("bigint").alias("doc_id"), "sha256")


# ---- sinks --------------------------------------------------------------------------------------
@query(
    "a8_task_result_documents",
    """WITH s AS (SELECT feed_id, trim(link) AS url, entry_pos, title, published,
                         row_number() OVER (PARTITION BY feed_id, trim(link) ORDER BY entry_pos) AS rn FROM {v_entries} e),
            f AS (SELECT s.* FROM s LEFT JOIN {v_marks} m ON s.feed_id = m.feed_id
                  WHERE rn = 1 AND published IS NOT NULL AND trim(title) <> ''
                    AND (m.last_db_article_published_at IS NULL OR published >= m.last_db_article_published_at)),
            k AS (SELECT *, CAST(floor(entry_pos / 200) AS BIGINT) AS task_id,
                         row_number() OVER (PARTITION BY floor(entry_pos / 200), lower(url) ORDER BY feed_id, entry_pos) AS r2 FROM f)
       SELECT t.task_id, 'rss-worker-result' AS contract_version, 'task' AS scope, t.n_events, coalesce(c.input_candidates, 0) AS input_candidates,
              coalesce(c.output_candidates, 0) AS output_candidates, coalesce(c.output_candidates, 0) AS n_sources, coalesce(c.urls, '') AS urls
       FROM (SELECT CAST(floor(page_id / 20) AS BIGINT) AS task_id, count(*) AS n_events FROM {pages} GROUP BY 1) t
       LEFT JOIN (SELECT task_id, count(*) AS input_candidates, count(CASE WHEN r2 = 1 THEN 1 END) AS output_candidates,
                         string_agg(CASE WHEN r2 = 1 THEN url END, ' ' ORDER BY feed_id, entry_pos) AS urls FROM k GROUP BY task_id) c
              ON t.task_id = c.task_id""",
)
def task_result_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty neighbouring pages make a task, so documents do not grow with the table."""
    [pages] = load(spark, sf, "pages")
    execution, feed = F.lit(1).cast("bigint").alias("execution_id"), (F.col("page_id") % 20)
    results = pages.select(
        F.floor(F.col("page_id") / 20).alias("task_id"), execution, feed.alias("feed_index"), F.lit("j").alias("job_id"),
        F.lit("success").alias("status"), feed.alias("feed_id"),
    )
    task = F.floor(F.col("source_pos") / 200).alias("task_id")
    sources = assembled(spark, sf).select(task, execution, F.col("feed_id").alias("feed_index"), "*")
    documents = sinks.task_result_payloads(results, sources.drop("feed_id"))
    shape = (
        "contract_version string, result_events array<struct<feed_id: bigint, sources: array<struct<url: string>>>>, "
        "local_dedup struct<scope: string, input_candidates: bigint, output_candidates: bigint>"
    )
    parsed = documents.select("task_id", F.from_json("payload", shape).alias("p"))
    urls = F.flatten(F.transform("p.result_events", lambda e: F.transform(e.sources, lambda s: s.url)))
    return parsed.select(
        "task_id", "p.contract_version", "p.local_dedup.scope", F.size("p.result_events").cast("bigint").alias("n_events"),
        "p.local_dedup.input_candidates", "p.local_dedup.output_candidates", F.size(urls).cast("bigint").alias("n_sources"),
        joined(urls, " ").alias("urls"),
    )


@query(
    "a9_embedding_documents",
    """SELECT CAST(floor(vec_id / 20) AS BIGINT) AS task_id, count(*) AS n_sources, string_agg(vec_id, ',' ORDER BY vec_id) AS ids,
              round(sum(embedding[1]::DOUBLE), 5) AS first_sum
       FROM {embeddings} GROUP BY 1""",
)
def embedding_documents(spark: SparkSession, sf: str) -> DataFrame:
    [vectors] = load(spark, sf, "embeddings")
    n = F.col("vec_id")
    rows = vectors.select(F.floor(n / 20).alias("task_id"), F.lit(1).alias("execution_id"), n.alias("source_pos"), n.alias("id"), "embedding")
    documents = sinks.embedding_payloads(rows)
    parsed = documents.select(
        "task_id", F.from_json("payload", "sources array<struct<id: bigint, embedding: array<double>>>").alias("p")
    )
    first = F.aggregate("p.sources", F.lit(0.0), lambda a, s: a + F.get(s.embedding, F.lit(0)))
    ids = F.transform("p.sources", lambda s: s.id.cast("string"))
    return parsed.select(
        "task_id", F.size("p.sources").cast("bigint").alias("n_sources"), joined(ids, ",").alias("ids"), F.round(first, 5).alias("first_sum")
    )
