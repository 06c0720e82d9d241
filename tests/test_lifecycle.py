"""Tasks from lease to signed documents."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from newsflow.operators import integrity
from newsflow.plans import lifecycle
from newsflow.plans.embed_queries import letter_share_model
from test_io import ATOM, RSS

LOG = (
    "task_id bigint, execution_id bigint, feed_index int, strategy_pos int, strategy int, attempt_no int, status_code int, "
    "error_kind string, error string, etag string, last_modified string, body string"
)
LEASE = "task_id bigint, execution_id bigint, lease_id string, session_id string, trace_id string, task_type string, worker_version string, payload string"


def test_feed_task(spark):
    feed = {"feed_url": "https://x/rss", "fetchprotection": 1, "etag": "old"}
    feeds = [{**feed, "feed_id": i} for i in range(4)] + [{**feed, "feed_id": 4, "fetchprotection": 0}]
    payload = {"job_id": "j", "requested_at": "2024-01-01T00:00:00Z", "ingest": True, "feeds": feeds}
    leases = spark.createDataFrame([(1, 2, "l", "s", "t", "rss.fetch", None, json.dumps(payload))], LEASE)
    copy = RSS.replace("https://x/1", "HTTPS://X/1")
    log = [
        (1, 2, 0, 0, 1, 0, 503, None, "busy", None, None, None),
        (1, 2, 0, 0, 1, 1, 200, None, None, "new", "Wed, 03 Jan 2024 10:00:00 GMT", RSS),
        (1, 2, 1, 0, 1, 0, 404, None, "gone", None, None, None),
        (1, 2, 1, 1, 2, 0, 200, None, None, None, None, copy),
        (1, 2, 2, 0, 1, 0, 304, None, None, "same", None, None),
        (1, 2, 3, 0, 1, 0, 500, None, "first", None, None, None),
        (1, 2, 3, 1, 2, 0, None, "timeout", "last", None, None, None),
    ]
    done = lifecycle.feed_tasks(leases, spark.createDataFrame(log, LOG))
    status = {r.feed_id: (r.status, r.status_code, r.error_message, r.new_etag, r.resolved_fetchprotection) for r in done.results.collect()}
    assert status == {
        0: ("success", 200, None, "new", 1),
        1: ("success", 200, None, None, 2),
        2: ("not_modified", 304, None, "same", 1),
        3: ("error", None, "last", "old", 2),
        4: ("error", None, "Blocked by fetch protection", "old", 0),
    }
    [source] = done.sources.where("feed_index = 0").collect()
    assert (source.title, source.summary, source.authors, source.image_url) == ("One", "Hi", ["Ann Lee", "Bob Ray"], "https://x/t.png")
    signed = lifecycle.sign_documents(done.documents, leases, F.lit("key"), F.lit("2024-01-01T00:00:00Z"), F.lit("n"))
    [row] = signed.collect()
    body = json.loads(row.request_body)["result_payload"]
    assert [e["feed_id"] for e in body["result_events"]] == [0, 1, 2, 3, 4]
    assert [len(e["sources"]) for e in body["result_events"]] == [1, 0, 0, 0, 0]
    dedup = body["local_dedup"]
    assert (dedup["input_candidates"], dedup["output_candidates"], dedup["duplicates_dropped"]) == (2, 1, 1)
    assert dedup["groups"] == [{"dedup_key": "https://x/1", "dropped_urls": ["HTTPS://X/1"], "kept_url": "https://x/1", "reason": "same_url"}]
    lost = lifecycle.sign_documents(done.documents, leases.where("task_id = 9"), F.lit("key"), F.lit("t"), F.lit("n")).first()
    assert (lost.request_body, lost.lease_error) == (None, "missing lease metadata for task 1:2")


def test_feed_time_fills_a_missing_header(spark):
    body = ATOM.replace('Atom">', 'Atom"><updated>2024-02-02T00:00:00Z</updated>')
    payload = {"job_id": "j", "requested_at": "2024-01-01T00:00:00Z", "ingest": True, "feeds": [{"feed_id": 1, "feed_url": "u", "fetchprotection": 2, "last_db_article_published_at": "2024-01-03T10:00:00Z"}]}
    leases = spark.createDataFrame([(1, 2, "l", "s", "t", "rss.fetch", None, json.dumps(payload))], LEASE)
    log = spark.createDataFrame([(1, 2, 0, 0, 2, 0, 200, None, None, None, None, body)], LOG)
    done = lifecycle.feed_tasks(leases, log)
    assert done.results.first().new_last_update.isoformat() == "2024-02-02T00:00:00"
    source = done.sources.first()
    assert (source.url, source.image_url, source.authors) == ("https://y/1", "https://y/c.png", ["Ann Lee", "Bob Ray"])


def test_embedding_task(spark):
    sources = [{"id": 7, "title": " A\n b ", "summary": None, "url": "u"}, {"id": 5, "title": "c", "summary": " d ", "url": "v"}]
    payload = {"job_id": "j", "worker_version": "1", "sources": sources}
    leases = spark.createDataFrame([(1, 2, "l", "s", "t", "embed.source", "1", json.dumps(payload))], LEASE)
    vectors, documents = lifecycle.embedding_tasks(leases, letter_share_model, 1)
    assert sorted((r.source_pos, r.id, len(r.embedding)) for r in vectors.collect()) == [(0, 7, 16), (1, 5, 16)]
    signed = lifecycle.sign_documents(documents, leases, F.lit("key"), F.lit("t"), F.lit("n"), embedding=True).first()
    assert [s["id"] for s in json.loads(signed.request_body)["result_payload"]["sources"]] == [7, 5]


def test_failures_are_signed_and_stay_with_their_task(spark):
    def model():
        def predict(texts):
            if any("poison" in t for t in texts):
                raise RuntimeError('bad "text"')
            return letter_share_model()(texts)

        return predict

    def lease(task, *titles):
        sources = [{"id": task * 10 + i, "title": t, "summary": None, "url": "u"} for i, t in enumerate(titles)]
        payload = json.dumps({"job_id": "j", "worker_version": "1", "sources": sources})
        return (task, 0, f"l{task}", "s", "t", "embed.source", "1", payload)

    rows = [lease(1, "a", "b", "poison"), lease(2, "c"), lease(3, "poison"), (4, 0, "l4", "s", "t", "embed.source", "1", "{")]
    leases = spark.createDataFrame(rows, LEASE).coalesce(1)
    vectors, documents = lifecycle.embedding_tasks(leases, model, 32)
    assert {r.id for r in vectors.collect()} == {20}
    signed = lifecycle.sign_documents(documents, leases, F.lit("key"), F.lit("t"), F.lit("n"), embedding=True).collect()
    bodies = {r.task_id: json.loads(r.request_body) for r in signed}
    assert [s["id"] for s in bodies[2]["result_payload"]["sources"]] == [20] and "error_message" not in bodies[2]
    assert {t: b["error_message"] for t, b in bodies.items() if t != 2} == {1: 'bad "text"', 3: 'bad "text"', 4: lifecycle.UNREADABLE_TASK}
    for row in signed:
        body = json.loads(row.request_body)
        assert "result_payload" in body or row.task_id != 2
        signature = body.pop("signature")
        text = json.dumps(body, sort_keys=True, separators=(",", ":"))
        secret = hashlib.sha256(b"key").hexdigest().encode()
        if row.task_id != 2:  # numbers of vectors have their own text form
            assert signature == hmac.new(secret, text.encode(), hashlib.sha256).hexdigest()
    feeds = spark.createDataFrame([(5, 0, "l5", "s", "t", "rss.fetch", "1", '{"feeds": 1}')], LEASE)
    done = lifecycle.feed_tasks(feeds, spark.createDataFrame([], LOG))
    [row] = lifecycle.sign_documents(done.documents, feeds, F.lit("key"), F.lit("t"), F.lit("n")).collect()
    assert json.loads(row.request_body)["error_message"] == lifecycle.UNREADABLE_TASK


def test_signature_stands_where_keys_say(spark):
    body = json.dumps({"a": ',"signed_at":"x"', "signed_at": {"z": ',"signed_at":'}, "zz": 'q","signed_at":"'})
    row = (1, 2, "l", 's,"signed_at":', 't,"signed_at":', "w", 'v","signed_at":"1', body, "when", "n")
    columns = "task_id int, execution_id int, lease_id string, session_id string, trace_id string, task_type string, worker_version string, result_payload string, signed_at string, nonce string"
    got = integrity.sign_payloads(spark.createDataFrame([row], columns), F.lit("key")).first()
    parsed = json.loads(got.request_body)
    assert parsed["result_payload"] == json.loads(body) and list(parsed) == sorted(parsed) and parsed["signature"] == got.signature
