"""Known inputs and outputs of single operators."""

from __future__ import annotations

import hashlib
import hmac
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.functions import html
from newsflow.functions import text as t
from newsflow.functions.bylines import with_authors
from newsflow.functions.canonical import (
    EXPONENT_SIGN,
    HELD_BYTES,
    HELD_ROWS,
    PRESERVE,
    canonical_json,
    canonical_text,
    held_slices,
    hmac_sha256,
    number_text,
    signing_secret,
)
from newsflow.functions.identity import fold_character, identity_key
from newsflow.operators import integrity, releases, tasks, telemetry
from newsflow.plans.feed_queries import BYLINES


def one(spark, value, column, kind="string"):
    rows = spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).collect()
    return rows[0].x


def test_bylines(spark):
    df = spark.createDataFrame([(b, a) for b, a in BYLINES.items()], "b string, a string").withColumn("l", F.array("b"))
    rows = with_authors(df, "l", "o").collect()
    assert {r.b: "|".join(r.o) for r in rows} == BYLINES


def test_authors_keep_first_spelling_over_bylines(spark):
    df = spark.createDataFrame([(["Chloé Durand, AFP", None, " ", "CHLOE DURAND; Bob Ray"],), (None,)], "l array<string>")
    assert [r.o for r in with_authors(df, "l", "o").collect()] == [["Chloé Durand", "AFP", "Bob Ray"], []]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("  Chloé   Dùrand  ", "chloe durand"),
        ("ﬁn ½ K", "fin 1 2 k"),
        ("Łódź", "odz"),
        ("İSTANBUL", "istanbul"),
        ("!!", None),
        ("", None),
    ],
)
def test_identity(spark, value, expected):
    assert one(spark, value, identity_key(F.col("v"))) == expected


def test_identity_folds_every_character(spark):
    codes = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(i, "a" + chr(i) + "b") for i in codes if i % 7 == 3 or i < 0x2500], "i int, v string")
    rows = df.repartition(4).select("i", identity_key(F.col("v")).alias("k")).collect()
    wrong = [r.i for r in rows if r.k != " ".join(("a" + fold_character(chr(r.i)) + "b").split())]
    # characters newer than the JVM's Unicode tables may keep their marks
    assert len(wrong) < 100, [hex(i) for i in wrong[:20]]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("<p>&quot;Bonjour&nbsp;<strong>tout le monde</strong>&quot;</p>", "Bonjour tout le monde"),
        ("a&amp;lt;b&gt;c", "ac"),
        ("a &amp;amp; b &bogus; &#233; &#xD800; &#x1F600;", "a & b &bogus; é &#xD800; 😀"),
        ("x < y <b", "x < y"),
        ("<b <p> x", "x"),
        ("one<br>two<i>three</i>", "one twothree"),
        ("keep <script>text</script>", "keep text"),
        ("<p> </p>", None),
        (None, None),
    ],
)
def test_html_to_text(spark, value, expected):
    assert one(spark, value, html.html_to_text("v")) == expected


def test_required_text_and_quotes(spark):
    assert one(spark, "  hello  ", t.required_text(F.col("v"))) == "hello"
    assert one(spark, "   ", t.required_text(F.col("v"))) is None
    assert one(spark, ' "“Bonjour”" ', t.trim_quotes(F.col("v"))) == "Bonjour"


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ('<div><img src="https://cdn.example.com/photo&amp;size=large.jpg" /></div>', "https://cdn.example.com/photo&size=large.jpg"),
        ("<IMG alt=1><p SRC='//a/b'>", "//a/b"),
        ("<img src=x.png src='y.png'>", None),
        ("<img src='note.txt'><img src='y.png'>", None),
        ("src='a.png' <img >", None),
        ("<img src='open.png", None),
        ("<img src='  '>", None),
    ],
)
def test_inline_image(spark, value, expected):
    assert one(spark, value, html.inline_image("v")) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("News.Example.COM", "news.example.com"),
        ("https://u:p@a_b.com:8080/x?y", "a_b.com"),
        ("   ", None),
        ("http://[::1]:80/", "[::1]"),
    ],
)
def test_host(spark, value, expected):
    assert one(spark, value, t.host_of(F.col("v"))) == expected


def test_http_dates(spark):
    for text, stamp in [
        ("Wed, 03 Jan 2024 10:00:00 GMT", "2024-01-03T10:00:00Z"),
        ("3 Jan 2024 10:00:00 +0200", "2024-01-03T08:00:00Z"),
        ("junk", None),
    ]:
        assert one(spark, text, t.rfc3339(t.parse_http_date(F.col("v")))) == stamp
    assert one(spark, "2024-01-03 10:00:00", t.http_date(F.col("v").cast("timestamp"))) == "Wed, 03 Jan 2024 10:00:00 GMT"
    assert one(spark, "2024-01-03 10:00:00.25", t.rfc3339(F.col("v").cast("timestamp"))) == "2024-01-03T10:00:00.250Z"


def test_details_and_secrets(spark):
    assert one(spark, "  a   b \nsecond", t.one_line_detail(F.col("v"))) == "a b"
    assert one(spark, "x" * 200, t.one_line_detail(F.col("v"))) == "x" * 137 + "..."
    assert one(spark, "12345678", t.redact_secret(F.col("v"))) == "********"
    assert one(spark, "123456789", t.redact_secret(F.col("v"))) == "1234***6789"


def test_canonical_json():
    payload = json.dumps({"b": "économie", "a": {"title": "L&G conclut un partenariat avec la gestion d’actifs"}})
    expected = '{"a":{"title":"L&G conclut un partenariat avec la gestion d\\u2019actifs"},"b":"\\u00e9conomie"}'
    assert canonical_text(payload) == expected
    assert canonical_text('{"vector":[1e-7,1e20,3.5]}', EXPONENT_SIGN) == '{"vector":[1e-07,1e+20,3.5]}'
    assert canonical_text('{"vector":[1e-7,1e20,3.5]}', PRESERVE) == '{"vector":[1e-7,1e20,3.5]}'
    assert canonical_text('["\\u007f\\u0001\\ud83d\\ude00\\n", null, true, -0, 7]') == (
        '["\x7f\\u0001\\ud83d\\ude00\\n",null,true,-0.0,7]'
    )


def test_canonical_json_holds_few_texts_at_a_time(spark):
    long_, over = "x" * (HELD_BYTES // 4), "y" * (HELD_BYTES + 1)
    texts = [long_, None, long_, long_, over, "", *["z"] * (HELD_ROWS + 1), long_, long_, long_, long_, long_]
    slices = [s.to_pylist() for s in held_slices(pa.array(texts))]
    assert [t for s in slices for t in s] == texts
    assert [over] in slices
    for s in slices:
        assert len(s) <= HELD_ROWS and (len(s) == 1 or sum(len(t or "") for t in s) <= HELD_BYTES)
    assert [len(s) for s in held_slices(pa.array([], pa.string()))] == [0]
    rows = [(i, None if t is None else json.dumps({"b": t, "a": 1e-7})) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, v string").repartition(1)
    modes = df.select("i", "v", canonical_json(F.col("v")).alias("p"), canonical_json(F.col("v"), EXPONENT_SIGN).alias("e"))
    for r in modes.collect():
        assert r.p == (None if r.v is None else canonical_text(r.v))
        assert r.e == (None if r.v is None else canonical_text(r.v, EXPONENT_SIGN))


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (0.0, "0.0"), (1.0, "1.0"), (0.1, "0.1"), (1.5e-5, "0.000015"), (1e-5, "0.00001"), (9.5e-6, "9.5e-6"),
        (123456789.25, "123456789.25"), (1e15, "1000000000000000.0"), (1e16, "1e16"), (-2.5e-300, "-2.5e-300"),
        (0.10000000149011612, "0.10000000149011612"), (1234567890123456.0, "1234567890123456.0"),
    ],
)
def test_number_text(value, expected):
    assert number_text(value) == expected
    assert float(expected) == value


def test_hmac_equals_the_library(spark):
    secret = hashlib.sha256(b"key").hexdigest()
    for message in ["", "abc", "é" * 500]:
        expected = hmac.new(secret.encode(), message.encode(), "sha256").hexdigest()
        assert one(spark, message, hmac_sha256(signing_secret(F.lit("key")), F.col("v"))) == expected


def test_signed_bodies(spark):
    columns = "task_id bigint, lease_id string, session_id string, trace_id string, task_type string, worker_version string, signed_at string, nonce string"
    base = (1, "l", "s", "t", "embed.source", None, "2024-01-01T00:00:00Z", "n")
    df = spark.createDataFrame([(*base, '{"vector":[1e-7]}')], columns + ", result_payload string")
    signatures = {}
    for mode in (PRESERVE, EXPONENT_SIGN):
        row = integrity.sign_payloads(df, F.lit("key"), mode=mode).collect()[0]
        body = json.loads(row.request_body)
        signature = body.pop("signature")
        raw = row.request_body.replace(f'"signature":"{signature}",', "")
        secret = hashlib.sha256(b"key").hexdigest()
        assert signature == row.signature == hmac.new(secret.encode(), raw.encode(), "sha256").hexdigest()
        signatures[mode] = signature
    assert signatures[PRESERVE] != signatures[EXPONENT_SIGN]
    failed = spark.createDataFrame([(*base, 'bad "é" \\ end}')], columns + ", error_message string")
    row = integrity.sign_payloads(failed, F.lit("key"), "error_message").collect()[0]
    assert json.loads(row.request_body)["error_message"] == 'bad "é" \\ end}'
    assert row.request_body.isascii()


def test_digests(spark):
    good = "0123456789abcdef" * 4
    for value, expected in [("", None), ("abc", None), (good, good), (f" {good.upper()} ", good)]:
        assert one(spark, value, integrity.normalized_digest(F.col("v"))) == expected


STATE = (
    "worker string, ts timestamp, event_id bigint, active boolean, connection_state string, pending_tasks int, current_task_id bigint, "
    "current_execution_id bigint, current_task_label string, last_error string, desired_state string"
)


def test_changed_states_ignore_progress_fields(spark):
    df = spark.sql(
        f"""SELECT * FROM VALUES
        ('w', timestamp'2024-01-01 00:00:00', 1L, true, 'processing', 2, 21L, 21L, 'job a [1 / 10 feeds]', string(null), 'running'),
        ('w', timestamp'2024-01-01 03:00:00', 2L, true, 'processing', 2, 21L, 21L, 'job a [9 / 10 feeds]', string(null), 'running'),
        ('w', timestamp'2024-01-02 00:00:00', 3L, true, 'processing', 2, 21L, 21L, 'x', 'boom', 'running')
        AS t({", ".join(c.split()[0] for c in STATE.split(", "))})"""
    )
    assert sorted(r.event_id for r in tasks.changed_states(df).collect()) == [1, 3]


def updates(spark, *ops):
    rows = [("w", 1_704_067_200 + at, i, op, 0, err) for i, (at, op, err) in enumerate(ops)]
    df = spark.createDataFrame(rows, "worker string, s double, event_id bigint, op string, bytes_received bigint, error string")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint"))).drop("s")


def test_fold_keeps_phase_of_recorded_tasks(spark):
    df = updates(spark, (0.0, "processing", None), (1.0, "task_recorded", None))
    row = telemetry.fold_status(df).collect()[0]
    assert (row.phase, row.completed_task_count) == ("processing", 1)


def test_stopped_keeps_the_error_and_idle_clears_it(spark):
    df = updates(spark, (0.0, "processing", None), (1.0, "error", "boom"), (2.0, "stopped", None))
    row = telemetry.fold_status(df).collect()[0]
    assert (row.phase, row.last_error, row.has_task) == ("stopped", "boom", False)
    df = updates(spark, (0.0, "error", "boom"), (1.0, "idle", None))
    assert telemetry.fold_status(df).collect()[0].last_error is None


def test_fold_equals_the_end_of_the_history(spark):
    ops = [(float(i * 1900), op, "e") for i, op in enumerate(["connected", "processing", "transfer", "error", "completed", "disconnected"] * 5)]
    df = updates(spark, *ops)
    last = telemetry.status_history(df).orderBy(F.desc("ts")).first().asDict()
    fold = telemetry.fold_status(df).first().asDict()
    assert {k: fold[k] for k in fold if k in last} == {k: last[k] for k in fold if k in last}


def test_transfer_totals_saturate(spark):
    df = spark.createDataFrame([("w", 2**63 - 5), ("w", 10)], "worker string, bytes_received bigint")
    assert telemetry.transfer_totals(df).first().bytes_received == 2**63 - 1


def snapshot(spark, age, phase="idle", connection="connected", has_task=False, error=None):
    df = spark.createDataFrame([(phase, connection, has_task, error)], "phase string, server_connection string, has_task boolean, last_error string")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return df.withColumn("last_updated_at", now - F.expr(f"INTERVAL {age} SECONDS")), now


@pytest.mark.parametrize(
    ("age", "fields", "recent", "expected"),
    [
        (180, {"phase": "processing"}, False, "Inactive"),
        (1, {"phase": "processing"}, False, "Processing"),
        (1, {"connection": "disconnected"}, False, "Error"),
        (1, {}, True, "Processing"),
        (1, {}, False, "Active"),
        (1, {"phase": "starting"}, False, "Starting"),
        (1, {"phase": "stopped"}, True, "Inactive"),
    ],
)
def test_visual_status(spark, age, fields, recent, expected):
    df, now = snapshot(spark, age, **fields)
    df = df.withColumn("hint_until", now + F.expr("INTERVAL 1 SECONDS") if recent else F.lit(None).cast("timestamp"))
    assert telemetry.classify_status(df, now).first().status == expected


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("api error (403): forbidden", "Invalid API key"),
        ("http error: builder error", "Invalid API URL"),
        ("http error: error sending request for url http://example.com", "Backend offline"),
        ("API ERROR (502): x", "Backend unavailable"),
        ("operation timed out", "Request timeout"),
        ("invalid json", "Invalid response"),
        ("boom", "Worker error"),
    ],
)
def test_alert_labels(spark, text, label):
    df, now = snapshot(spark, 1, phase="error", error=text)
    assert telemetry.alert_rows(df, now).first().notice == label
    df, now = snapshot(spark, 180, phase="error", error=text)
    assert telemetry.alert_rows(df, now).count() == 0


def test_status_labels(spark):
    for code, label in [(403, "Invalid API key"), (404, "Invalid API URL"), (504, "Request timeout"), (599, "Backend unavailable"), (418, "Request failed")]:
        assert one(spark, code, telemetry.status_label(F.col("v")), "int") == label
    assert one(spark, "config", telemetry.kind_label(F.col("v"), F.lit(None).cast("int"))) == "Invalid API URL"


def test_versions(spark):
    ordered = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)], "i int, v string").orderBy(F.rand(1))
    assert [r.v for r in df.orderBy(releases.semver(F.col("v"))).collect()] == ordered
    for bad in ["1.0", "01.0.0", "1.0.0-01", "dev", ""]:
        assert one(spark, bad, releases.semver(F.col("v"))) is None


def test_running_worker_with_update_is_shown_but_not_installable(spark):
    df = spark.createDataFrame(
        [("1.0.0", "1.0.0", "1.1.0", True, True)],
        "current_version string, minimum_supported_version string, latest_version string, installed boolean, is_running boolean",
    )
    row = releases.fleet_view(releases.classify_releases(df)).first()
    assert (row.status, row.show_install_action, row.can_install_or_update, row.can_toggle_run) == ("update_available", True, False, True)
    notice = releases.release_notice(releases.classify_releases(df), F.lit("Worker")).first()
    assert notice.tone == "warning"
    assert notice.notice.startswith("Worker has an update available. Stop it")
