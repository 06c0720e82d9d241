"""Operators against brute force on random input, with hot keys and small segments."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsflow.functions import html
from newsflow.operators import embed, entries, fetch, tasks, telemetry
from newsflow.plans.scan import running, time_segment
from newsflow.sources import sinks

SECOND = 1_000_000
BASE = 1_704_067_200 * SECOND


def at(df, us="us"):
    return df.withColumn("ts", F.timestamp_micros(us))


def hot_key(rng, keys=5):
    """A third of all rows on one key."""
    return 0 if rng.random() < 0.34 else rng.randrange(1, keys)


# ---- text ---------------------------------------------------------------------------------------
def sequential_strip(text):
    out, tag, inside = [], "", False
    for i, ch in enumerate(text):
        if inside:
            if ch == ">":
                inside = False
                name = tag.lstrip("/").lstrip("!").lstrip("?")
                length = next((k for k, c in enumerate(name) if not (c.isascii() and (c.isalnum() or c == "-"))), len(name))
                if name[:length].lower() in html.BREAK_TAGS:
                    out.append(" ")
            else:
                tag += ch
        elif ch == "<" and i + 1 < len(text) and (text[i + 1].isascii() and text[i + 1].isalpha() or text[i + 1] in "/!?"):
            inside, tag = True, ""
        else:
            out.append(ch)
    return " ".join("".join(out).split())


def test_strip_tags_equals_a_character_walk(spark):
    rng = random.Random(5)
    pieces = ["<", ">", "p", "b", "br", "/", "!", "?", " ", "x", "<p>", "</div>", "<b ", "h1", "-", "<!--", "<a<p>", "\n", "é", "<H2 c='>'>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    rows = df.select("i", html.strip_tags("v").alias("x")).collect()
    wrong = [(texts[r.i], r.x) for r in rows if " ".join(r.x.split()) != sequential_strip(texts[r.i])]
    assert not wrong, wrong[:5]


def test_unclosed_tags_stay_linear(spark):
    df = spark.range(1).select(F.expr("repeat('<a ', 400000)").alias("v"))
    assert df.select(F.length(html.strip_tags("v")).alias("n")).first().n == 0


# ---- running scans ------------------------------------------------------------------------------
def test_running_equals_plain_windows(spark):
    rng = random.Random(1)
    rows = [
        (hot_key(rng), i, BASE + rng.randrange(0, 400) * SECOND, rng.choice([None, rng.randrange(100)])) for i in range(4000)
    ]
    df = at(spark.createDataFrame(rows, "k int, id int, us bigint, v int"))
    value = F.col("v")
    got = running(
        df, ["k"], ["ts", "id"], time_segment(F.col("ts"), 7 * SECOND),
        last={"last": value}, previous={"prev": value}, total={"total": F.coalesce(value, F.lit(0))}, peak={"peak": value},
    )
    w = Window.partitionBy("k").orderBy("ts", "id")
    upto, until = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    expected = df.select(
        *df.columns, F.last("v", True).over(upto).alias("last"), F.last("v", True).over(until).alias("prev"),
        F.sum(F.coalesce(value, F.lit(0))).over(upto).alias("total"), F.max("v").over(upto).alias("peak"),
    )
    assert got.exceptAll(expected).count() == 0
    assert expected.exceptAll(got).count() == 0


def test_rate_slots_equal_the_recurrence(spark):
    rng = random.Random(2)
    rows = [(f"h{hot_key(rng)}", i, BASE + rng.randrange(0, 300) * SECOND // 4) for i in range(3000)]
    step = SECOND // 2
    free, expected = {}, {}
    for host, i, us in sorted(rows, key=lambda r: (r[2], r[1])):
        expected[i] = max(us, free.get(host, us))
        free[host] = expected[i] + step
    df = at(spark.createDataFrame(rows, "host string, event_id int, us bigint"))
    got = fetch.assign_rate_slots(df, "host", "ts", "event_id", step, segment_us=5 * SECOND)
    assert {r.event_id: r.slot_us for r in got.collect()} == expected


@pytest.mark.parametrize(("interval", "span", "segment"), [(300, 600, 10), (1000, 600, 10), (1000, 60, 2), (3000, 60, 1), (1, 5, 1)])
def test_throttle_equals_the_walk(spark, interval, span, segment):
    """From sparse updates to one endless run, with intervals below and above the segment width."""
    rng = random.Random(interval + span)
    ops = ["transfer"] * 60 + ["error", "connected"]
    rows = [(f"w{hot_key(rng, 4)}", i, BASE + rng.randrange(0, span * 1000) * 1000, rng.choice(ops)) for i in range(3000)]
    last, expected = {}, set()
    for worker, i, us, op in sorted(rows, key=lambda r: (r[2], r[1])):
        if worker not in last or op == "error" or us - last[worker] >= interval * 1000:
            last[worker] = us
            expected.add(i)
    df = at(spark.createDataFrame(rows, "worker string, event_id int, us bigint, op string"))
    got = telemetry.throttle(df, interval_ms=interval, segment_us=segment * SECOND)
    assert {r.event_id for r in got.collect()} == expected


def test_chunks_cross_position_ranges(spark):
    positions = {t: sorted(random.Random(t).sample(range(1000), 300 if t == 0 else 40)) for t in range(4)}
    expected = {(t, p): i // 7 for t, ps in positions.items() for i, p in enumerate(ps)}
    df = spark.createDataFrame(list(expected), "task_id int, source_pos int")
    got = embed.with_chunks(df, 7, ["task_id"], width=64)
    assert {(r.task_id, r.source_pos): r.chunk for r in got.collect()} == expected


# ---- entries ------------------------------------------------------------------------------------
def test_assembly_hides_copies_of_entries_that_fail_later(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        links = [rng.choice(["", "  ", None]), rng.choice([" https://x/1 ", "https://x/2", "https://X/2", " ", f"https://x/{i}"])]
        title = rng.choice([" t ", " ", None, "u"])
        published, updated = (rng.choice([None, BASE + rng.randrange(10) * SECOND]) for _ in range(2))
        rows.append((hot_key(rng, 4), i, links, title, published, updated))
    marks = {0: None, 1: BASE + 5 * SECOND, 2: BASE + 9 * SECOND}
    seen, expected = set(), []
    for feed, i, links, title, published, updated in rows:
        link = next((x.strip() for x in links if x and x.strip()), None)
        if link is None or (feed, link) in seen:
            continue
        seen.add((feed, link))
        stamp = published if published is not None else updated
        mark = marks.get(feed)
        if stamp is None or (mark is not None and stamp < mark) or not (title or "").strip():
            continue
        expected.append((feed, i, link, title.strip(), stamp))
    df = spark.createDataFrame(rows, "feed_id int, entry_pos int, links array<string>, title string, p bigint, u bigint")
    df = df.select(
        "feed_id", "entry_pos", "links", "title", F.timestamp_micros("p").alias("published"), F.timestamp_micros("u").alias("updated"),
        F.lit("<p>s</p>").alias("summary"), F.lit(None).cast("string").alias("content_body"), F.lit(None).cast("string").alias("content_src"),
        F.array(F.lit("By Ann Lee")).alias("authors"),
        F.array().cast("array<struct<thumbnails:array<string>,content:array<struct<url:string,content_type:string>>>>").alias("media"),
    )
    feeds = spark.createDataFrame([(k, v) for k, v in marks.items()], "feed_id int, m bigint").select(
        "feed_id", F.timestamp_micros("m").alias("last_db_article_published_at")
    )
    got = entries.assemble_sources(df, feeds).withColumn("us", F.unix_micros("published_at")).collect()
    assert sorted((r.feed_id, r.source_pos, r.url, r.title, r.us) for r in got) == sorted(expected)
    assert all(r.summary == "s" and r.authors == ["Ann Lee"] for r in got)


# ---- tasks --------------------------------------------------------------------------------------
def random_sources(rng, n=900):
    urls = ["https://a/1", " https://A/1", "HTTPS://a/1 ", "https://b/É", "https://b/é"] + [f"https://c/{i}" for i in range(40)]
    return [(0 if rng.random() < 0.34 else rng.randrange(1, 6), 1, rng.randrange(12), i, rng.choice(urls)) for i in range(n)]


def model_dedup(rows):
    groups, kept = {}, set()
    for task, _, feed, pos, url in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        key = "".join(c.lower() if c.isascii() else c for c in url.strip())
        if (task, key) in groups:
            groups[task, key][1].append(url)
        else:
            groups[task, key] = (url, [])
            kept.add((task, feed, pos))
    return groups, kept


def test_dedup_report_equals_the_walk(spark):
    rows = random_sources(random.Random(6))
    groups, kept = model_dedup(rows)
    df = spark.createDataFrame(rows, "task_id int, execution_id int, feed_index int, source_pos int, url string")
    assert {(r.task_id, r.feed_index, r.source_pos) for r in tasks.dedup_sources(df).collect()} == kept
    flagged = tasks.dedup_sources(df, keep_dropped=True)
    assert flagged.count() == len(rows)
    assert flagged.where("kept").count() == len(kept)
    got = defaultdict(list)
    for r in tasks.dedup_groups(df).orderBy("feed_index", "source_pos").collect():
        assert r.kept_url == groups[r.task_id, r.dedup_key][0]
        got[r.task_id, r.dedup_key].append(r.dropped_url)
    assert got == {k: v[1] for k, v in groups.items() if v[1]}
    counts = {r.task_id: (r.input_candidates, r.output_candidates, r.duplicates_dropped) for r in tasks.dedup_counts(df).collect()}
    for task, (n_in, n_out, n_drop) in counts.items():
        assert n_in == sum(r[0] == task for r in rows)
        assert n_out == sum(k[0] == task for k in kept)
        assert n_drop == n_in - n_out


def test_result_documents_hold_every_row(spark):
    import json

    rows = random_sources(random.Random(7), 300)
    groups, kept = model_dedup(rows)
    df = spark.createDataFrame(rows, "task_id int, execution_id int, feed_index int, source_pos int, url string")
    df = df.selectExpr(
        "*", "'t' AS title", "string(null) AS summary", "array('A') AS authors", "timestamp'2024-01-01 00:00:00' AS published_at",
        "string(null) AS image_url",
    )
    slots = {(r[0], 1, r[2]) for r in rows} | {(9, 1, 0)}
    results = spark.createDataFrame(sorted(slots), "task_id int, execution_id int, feed_index int").withColumn("status", F.lit("success"))
    results = results.withColumn("new_last_update", F.lit("2024-01-01 10:00:00.1234").cast("timestamp"))
    documents = sinks.task_result_payloads(results, df).collect()
    urls, dropped, events = set(), defaultdict(list), set()
    for d in documents:
        body = json.loads(d.payload)
        assert list(body) == ["contract_version", "result_events", "local_dedup"]
        assert body["local_dedup"]["input_candidates"] == sum(r[0] == d.task_id for r in rows)
        for e in body["result_events"]:
            events.add(d.task_id)
            urls |= {(d.task_id, s["url"]) for s in e["sources"]}
            assert all(s["published_at"] == "2024-01-01T00:00:00Z" for s in e["sources"])
            assert e["new_last_update"] == "2024-01-01T10:00:00.123400Z"
        for g in body["local_dedup"]["groups"]:
            dropped[d.task_id, g["dedup_key"]] += g["dropped_urls"]
    assert events == {s[0] for s in slots} and len(documents) == len(events)
    assert urls == {(k[0], groups[k][0]) for k in groups}
    assert dict(dropped) == {k: v[1] for k, v in groups.items() if v[1]}


def test_admissions_equal_the_queue_walk(spark):
    rng = random.Random(8)
    pending = [(f"h{hot_key(rng, 7)}", i) for i in range(200)]
    active = [f"h{rng.randrange(9)}" for _ in range(9)]
    for cap, free in ((3, 6), (1, 50), (0, 4)):
        load = defaultdict(int)
        for h in active:
            load[h] += 1
        queue = defaultdict(list)
        for h, i in pending:
            queue[h].append(i)
        expected = []
        while len(expected) < free:
            host = next((h for h in sorted(queue) if queue[h] and load[h] < max(cap, 1)), None)
            if host is None:
                break
            expected.append((host, queue[host].pop(0)))
            load[host] += 1
        p = spark.createDataFrame(pending, "host_key string, pos int")
        a = spark.createDataFrame([(h,) for h in active], "host_key string")
        got = fetch.next_admissions(p, a, ["pos"], cap, free).collect()
        assert [(r.host_key, r.pos) for r in got] == expected


def test_outcome_is_first_good_else_last_bad(spark):
    rng = random.Random(9)
    codes = [200, 304, 404, 503, None]
    log = [(hot_key(rng, 30), s, n, rng.choice(codes), "timeout") for _ in range(40) for s in (1, 2) for n in (0, 1)]
    log = [(f, i, s, n, c, None if c else e) for i, (f, s, n, c, e) in enumerate(log) if rng.random() < 0.3]
    expected = {}
    for f in range(32):
        mine = sorted(r for r in log if r[0] == f)
        good = [r for r in mine if r[4] in (200, 304)]
        expected[f] = (good[0] if good else mine[-1])[1] if mine else None
    attempts = spark.createDataFrame(log, "feed_id int, ord int, strategy int, attempt_no int, status_code int, error_kind string")
    feeds = spark.createDataFrame([(f,) for f in range(32)], "feed_id int")
    got = fetch.resolve_outcomes(feeds, fetch.classify_attempts(attempts), ["feed_id"], ["ord"])
    assert {r.feed_id: r.attempt.ord if r.attempt else None for r in got.collect()} == expected


def test_queue_states(spark):
    columns = "task_id int, execution_id int, job_id string, feed_index int, feed_id int, feed_url string, host_key string, state string"
    rows = [
        (1, 1, "a", 0, 10, "u0", "h2", "done"), (1, 1, "a", 1, 11, "u1", "h1", "done"),
        (2, 1, "b", 0, 20, "u2", "h3", "done"), (2, 1, "b", 1, 21, "u3", "h2", "pending"), (2, 1, "b", 2, 22, "u4", "h9", "active"),
        (3, 1, "c", 0, 30, "u5", "h1", "pending"),
    ]
    row = tasks.queue_totals(spark.createDataFrame(rows, columns)).first()
    assert row.current_task_label == "job b [1 / 3 feeds] | 2 rss task(s), 4 feeds, 2 queued"
    assert (row.pending_tasks, row.current_feed_id, row.connection_state, row.current_task_id) == (2, 22, "processing", 2)
    empty = spark.createDataFrame([], columns)
    assert tasks.queue_totals(empty).first().connection_state == "idle"
    waiting = tasks.queue_totals(empty, 2).first()
    assert waiting.connection_state == "committing"
    assert waiting.current_task_label == "committing 2 completed rss task(s) | 0 rss task(s), 0 feeds, 0 queued"
    assert tasks.claim_size(spark.createDataFrame(rows, columns), 5, 1).first().free_slots == 2
    assert tasks.claim_size(spark.createDataFrame(rows, columns), 2, 1).first().free_slots == 0


# ---- vectors ------------------------------------------------------------------------------------
def test_pooling_and_padding(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(4)), int(i), int(rng.integers(-1, 2)), rng.normal(size=5).tolist()) for i in range(200)]
    rows += [(9, 0, 0, [1.0] * 5)]
    df = spark.createDataFrame(rows, "doc int, i int, mask int, vector array<float>")
    got = embed.with_unit_vector(embed.mean_pool(df, 5, ["doc"])).collect()
    for r in got:
        live = np.array([v for d, _, m, v in rows if d == r.doc and m > 0], dtype=np.float32)
        mean = live.mean(axis=0) if len(live) else np.zeros(5)
        norm = np.linalg.norm(mean)
        assert np.allclose(r.embedding, mean / norm if norm > 0 else mean, atol=1e-6)
    encoded = spark.createDataFrame([(1, [5, 6, 7], [1, 0]), (1, [], None), (2, [], []), (3, list(range(9)), None)], "b int, input_ids array<bigint>, attention_mask array<bigint>")
    got = [(r.b, r.input_ids, r.attention_mask, r.token_type_ids) for r in embed.pad_batches(encoded, ["b"], 4).collect()]
    assert sorted(got) == [
        (1, [0, 0, 0], [0, 0, 0], [0, 0, 0]),
        (1, [5, 6, 7], [1, 0, 1], [0, 0, 0]),
        (2, [0], [0], [0]),
        (3, [0, 1, 2, 3], [1, 1, 1, 1], [0, 0, 0, 0]),
    ]


def test_running_totals_with_null_keys_and_without_overflow(spark):
    from newsflow.plans.scan import position_segment, running

    rows = [(k, i, 2**62) for k in (None, "a") for i in range(6)]
    df = spark.createDataFrame(rows, "k string, i int, v bigint")
    got = running(df, ["k"], ["i"], position_segment(F.col("i"), 2), total={"n": F.lit(1), "t": F.col("v")}).collect()
    assert sorted((r.k or "", r.i, r.n) for r in got) == sorted((k or "", i, i + 1) for k, i, _ in rows)
    assert all(r.t == min((r.i + 1) * 2**62, 2**63 - 1) for r in got)


def test_a_failing_batch_stays_alone(spark):
    from newsflow.operators import embed

    def make():
        def model(texts):
            if "bad" in texts:
                raise RuntimeError("model broke")
            return [[float(len(t))] for t in texts]

        return model

    df = spark.createDataFrame([(i, "bad" if i == 5 else "x" * i) for i in range(12)], "i int, passage string").coalesce(1)
    got = {r.i: (r.embedding, r.failure) for r in embed.embed(df, make, 3, error="failure").collect()}
    assert [i for i, (v, _) in got.items() if v is None] == [3, 4, 5]
    assert {e for _, e in got.values()} == {None, "model broke"} and got[7][0] == [7.0]
    plan = embed.embed(df, make, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    with pytest.raises(Exception, match="size 3, expected 2"):
        states = spark.createDataFrame([(1, True, [1.0, 2.0, 3.0])], "doc int, mask boolean, vector array<double>")
        embed.mean_pool(states.withColumn("mask", F.lit(1)), 2, ["doc"]).collect()


def test_hosts_versions_and_idle_queue(spark):
    from newsflow.functions.text import host_of
    from newsflow.operators import releases

    texts = ["not a host", "EXA%4dple.com", "https://u:p@Bücher.example:8080/x", "[::1]:80", "a.b/c d", "https://", "bad%2Fhost", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.h for r in df.select(host_of(F.col("t")).alias("h")).collect()] == [
        None, "example.com", "xn--bcher-kva.example", "[::1]", "a.b", None, None, None,
    ]
    order = ["1.0.0-rc.1", "1.0.0", "1.0.0+2", "1.0.0+10", "1.0.0+a", "1.0.1"]
    rows = spark.createDataFrame([(v,) for v in reversed(order)], "v string").orderBy(releases.semver(F.col("v")))
    assert [r.v for r in rows.collect()] == order
    slots = spark.createDataFrame([], "task_id int, execution_id int, job_id string, feed_index int, feed_id int, feed_url string, host_key string, state string")
    assert tasks.queue_totals(slots).first().current_task_label is None


def test_repeated_snapshots_and_manifests_keep_one_row_per_install(spark):
    from newsflow.operators import releases, telemetry

    installs = spark.createDataFrame([("a", True, "0.1.0"), ("b", True, "0.1.0"), ("c", False, "0.1.0")], "worker string, installed boolean, installed_version string")
    seen = [("a", "1.0.0", 5), ("a", " 1.2.0 ", 9), ("a", "9.0.0", 1), ("b", "2.0.0", 1), ("b", "  ", 2), ("c", "3.0.0", 1)]
    seen = spark.createDataFrame(seen, "worker string, app_version string, at bigint").selectExpr("worker", "app_version", "timestamp_seconds(at) AS last_updated_at")
    got = telemetry.reconcile_versions(installs, seen).collect()
    assert sorted((r.worker, r.installed_version) for r in got) == [("a", "1.2.0"), ("b", "0.1.0"), ("c", "0.1.0")]

    key = "product string, platform string, arch string, runtime_bundle string"
    held = spark.createDataFrame([("p", "l", "x", None, "1.9.0")], f"{key}, current_version string")
    rows = [("p", "l", "x", None, "1.10.0", "1.0.0"), ("p", "l", "x", None, "1.9.0", "1.0.0"), ("p", "l", "x", "", "1.2.0", "0.1.0")]
    manifests = spark.createDataFrame(rows, f"{key}, latest_version string, minimum_supported_version string")
    for got in (releases.check_releases(held, manifests), releases.check_releases_cached(held, manifests, manifests)):
        assert [(r.status, r.latest_version) for r in got.collect()] == [("update_available", "1.10.0")]


# ---- processing hint ----------------------------------------------------------------------------
def sequential_hint(loads):
    """(event_id -> snapshot count, completed work, hint end) by walking one worker after the other."""
    out, held, until = {}, {}, {}
    for worker, us, event, load, phase, has_task, count in sorted(loads, key=lambda r: (r[0] is None, r[0], r[1], r[2])):
        before = held.get(worker)
        more = load == "loaded" and before is not None and None not in (before[0], count) and count > before[0]
        if load != "error":
            held[worker] = (count,) if load == "loaded" else None
        if load == "loaded" and phase in ("error", "stopped"):
            until[worker] = None
        elif load == "loaded" and (phase == "processing" or has_task or more):
            until[worker] = us + telemetry.HINT_SECONDS * SECOND
        out[event] = (held.get(worker) and held[worker][0], more, until.get(worker))
    return out


def test_processing_hint(spark):
    rng = random.Random(17)
    rows = []
    for event in range(1500):
        worker = None if rng.random() < 0.1 else hot_key(rng)
        phase = rng.choice(["idle"] * 6 + ["processing", "error", "stopped", None])
        load = rng.choice(["loaded"] * 3 + ["error", "missing"])
        count = None if rng.random() < 0.1 else rng.randrange(6)
        rows.append((worker, BASE + rng.randrange(400) * SECOND, event, load, phase, rng.choice([None, False, False, True]), count))
    schema = "worker int, us bigint, event_id int, load string, phase string, has_task boolean, completed_task_count bigint"
    loads = at(spark.createDataFrame(rows, schema))
    want = sequential_hint(rows)
    for width in (7 * SECOND, 3600 * SECOND):
        got = telemetry.processing_hint(loads, segment_us=width).withColumn("until_us", F.unix_micros("hint_until"))
        assert {r.event_id: (r.snapshot and r.snapshot.completed_task_count, r.completed_work, r.until_us) for r in got.collect()} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = telemetry.processing_hint(loads)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 4, plan
