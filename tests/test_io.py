"""File sources and sinks."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from newsflow.operators import releases
from newsflow.sources import readers, sinks

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/"
     xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>c</title>
<item><title>One</title><link> https://x/1 </link><description>&lt;p&gt;Hi&lt;/p&gt;</description>
<content:encoded><![CDATA[<img src="https://x/i.jpg">]]></content:encoded>
<pubDate>Wed, 03 Jan 2024 10:00:00 +0200</pubDate><author>Ann Lee</author><dc:creator>Bob Ray</dc:creator>
<media:thumbnail url="https://x/t.png"/><media:content url="https://x/v.mp4" type="video/mp4"/>
<enclosure url="https://x/e.png" type="image/png"/></item>
<item><title>Two</title><link>https://x/2</link></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title>
<link rel="alternate" href="https://y/1"/><link href="https://y/2"/><summary>s</summary>
<content type="image/png" src="https://y/c.png"/><updated>2024-01-03T10:00:00Z</updated>
<author><name>Ann Lee</name></author><author><name>Bob Ray</name></author></entry></feed>"""


def test_feed_files(spark, tmp_path):
    (tmp_path / "rss.xml").write_text(RSS)
    (tmp_path / "atom.xml").write_text(ATOM)
    (tmp_path / "junk.xml").write_text("not a feed")
    late = f"<!-- {'x' * 3000} -->" + ATOM.split("?>")[1]
    group = '<media:group><media:content url="https://y/v"/><media:thumbnail url="https://y/g.png"/></media:group></entry>'
    (tmp_path / "late.xml").write_text(late.replace("</entry>", group).replace('Atom"', 'Atom" xmlns:media="m"'))
    (tmp_path / "odd.xml").write_text(RSS.replace("<title>c<", "<title><![CDATA[a <feed > b]]><"))
    bodies = readers.read_feed_files(spark, str(tmp_path)).withColumn("feed", F.substring_index("path", "/", -1)).drop("path")
    rows = {(r.feed, r.entry_pos): r for r in readers.parse_feeds(bodies).collect()}
    names = {("rss.xml", 0), ("rss.xml", 1), ("atom.xml", 0), ("late.xml", 0), ("odd.xml", 0), ("odd.xml", 1)}
    assert set(rows) == names
    assert [m.thumbnails for m in rows["late.xml", 0].media] == [[], ["https://y/g.png"]]
    one = rows["rss.xml", 0]
    assert (one.title, one.links[0].strip(), one.summary) == ("One", "https://x/1", "<p>Hi</p>")
    assert one.content_body == '<img src="https://x/i.jpg">'
    assert one.authors == ["Ann Lee", "Bob Ray"]
    assert one.published.isoformat() == "2024-01-03T08:00:00"
    assert one.media[0].thumbnails == ["https://x/t.png"]
    assert [(c.url, c.content_type) for c in one.media[0].content] == [("https://x/v.mp4", "video/mp4"), ("https://x/e.png", "image/png")]
    two = rows["rss.xml", 1]
    assert (two.published, two.authors) == (None, [])
    atom = rows["atom.xml", 0]
    assert atom.links == ["https://y/1", "https://y/2"]
    assert atom.updated.isoformat() == "2024-01-03T10:00:00"
    assert (atom.content_src, atom.authors) == ("https://y/c.png", ["Ann Lee", "Bob Ray"])


RDF = """<?xml version="1.0" encoding="ISO-8859-1"?><!DOCTYPE r:RDF><r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
 xmlns="http://purl.org/rss/1.0/" xmlns:d="http://purl.org/dc/elements/1.1/" xmlns:dc="http://purl.org/rss/1.0/modules/content/">
<channel r:about="u"><title>c</title><d:date>2024-01-03T09:00:00Z</d:date><items><r:Seq><r:li resource="u"/></r:Seq></items></channel>
<item r:about="a"><title>Caf\xe9 \x80</title><link>https://z/1</link><description>x</description><d:creator>Ann Lee</d:creator>
<d:date>2024-01-03T10:00:00Z</d:date><dc:encoded><![CDATA[<p><d:b>kept</d:b></p>]]></dc:encoded></item>
<item><title>Two</title><link>https://z/2</link></item></r:RDF>"""
PREFIXED = """<a:feed xmlns:a="http://www.w3.org/2005/Atom" xmlns:m='http://search.yahoo.com/mrss/' xmlns:h="http://www.w3.org/1999/xhtml">
<a:entry><a:title type="xhtml"><h:div>T <h:b>x</h:b></h:div></a:title><a:link href="https://y/1"/><m:thumbnail url="https://y/t.png"/>
<a:content type="xhtml"><h:div class="c"><h:p>One &amp; <h:br/>two</h:p></h:div></a:content><a:published>2024-01-03T10:00:00Z</a:published>
<a:author><a:name>Ann Lee</a:name></a:author></a:entry></a:feed>"""
JSON = {
    "version": "https://jsonfeed.org/version/1.1", "title": "c", "items": [
        {"id": "1", "url": "https://j/1", "title": "One", "content_html": "<p>b</p>", "date_published": "2024-01-03T10:00:00+02:00",
         "authors": [{"name": "Ann Lee"}, {"url": "x"}], "image": "https://j/i.png", "attachments": [{"url": "https://j/a.jpg", "mime_type": "image/jpeg"}]},
        {"id": "2", "content_text": "plain", "author": {"name": "Bob Ray"}},
    ],
}


def test_feed_dialects(spark, tmp_path):
    """RSS 1.0 with odd prefixes in a Western encoding, prefixed Atom with XHTML, JSON Feed, a lone entry, other charsets."""
    bare = RSS.split("?>", 1)[1].strip()
    (tmp_path / "rdf").write_bytes(RDF.encode("latin-1"))
    (tmp_path / "prefixed").write_text(PREFIXED)
    (tmp_path / "json").write_text("\ufeff " + json.dumps(JSON))
    (tmp_path / "entry").write_text(ATOM.replace('<feed xmlns="http://www.w3.org/2005/Atom"><entry>', '<entry xmlns="http://www.w3.org/2005/Atom">').replace("</feed>", ""))
    (tmp_path / "utf16").write_bytes(RSS.replace("One", "\u00c9\u6f22").encode("utf-16"))
    (tmp_path / "utf16le").write_bytes(("<?xml version='1.0'?>" + bare).encode("utf-16-le"))
    (tmp_path / "latin9").write_bytes(('<?xml version="1.0" encoding="iso-8859-15"?>' + bare.replace("One", "5 \u20ac")).encode("iso-8859-15"))
    (tmp_path / "bad8").write_bytes(RSS.replace("One", "O\xffe").encode("latin-1"))
    broken = {"cut": RSS[: len(RSS) // 2], "html": "<html><channel/></html>", "otherjson": '{"version": "2", "items": []}', "nojson": "{x", "blank": " "}
    for name, text in broken.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "atomlink").write_text(RSS.replace("<item>", '<a:link rel="self" href="s"/><item><a:link href="t"/>').replace("<rss ", '<rss xmlns:a="http://www.w3.org/2005/Atom" '))
    bodies = readers.read_feed_files(spark, str(tmp_path)).withColumn("feed", F.substring_index("path", "/", -1)).drop("path")
    readable = {r.feed: r.readable for r in readers.with_feed(bodies, out="parsed").select("feed", "parsed.readable").collect()}
    assert readable == {p.name: p.name not in broken for p in tmp_path.iterdir()}
    rows = {(r.feed, r.entry_pos): r for r in readers.parse_feeds(bodies).collect()}
    rdf = rows["rdf", 0]
    assert (rdf.title, rdf.links, rdf.authors, rdf.content_body) == ("Caf\u00e9 \u20ac", ["https://z/1"], ["Ann Lee"], "<p><d:b>kept</d:b></p>")
    assert rdf.published.isoformat() == "2024-01-03T10:00:00" and rows["rdf", 1].title == "Two"
    atom = rows["prefixed", 0]
    assert (atom.title, atom.links, atom.authors) == ("<div>T <b>x</b></div>", ["https://y/1"], ["Ann Lee"])
    assert atom.content_body == '<div class="c"><p>One &amp; <br/>two</p></div>'
    assert atom.media[0].thumbnails == ["https://y/t.png"]
    one, two = rows["json", 0], rows["json", 1]
    assert (one.links, one.title, one.content_body, one.authors) == (["https://j/1"], "One", "<p>b</p>", ["Ann Lee"])
    assert one.published.isoformat() == "2024-01-03T08:00:00" and one.media[0].thumbnails == ["https://j/i.png"]
    assert [tuple(c) for c in one.media[0].content] == [("https://j/a.jpg", "image/jpeg")]
    assert (two.links, two.content_body, two.authors) == ([], "plain", ["Bob Ray"])
    assert rows["entry", 0].links == ["https://y/1", "https://y/2"]
    titles = {"utf16": "\u00c9\u6f22", "utf16le": "One", "latin9": "5 \u20ac", "bad8": "O\ufffde", "atomlink": "One"}
    assert {k: rows[k, 0].title for k in titles} == titles
    assert rows["atomlink", 0].links[0].strip() == "https://x/1"


def test_task_payloads(spark, tmp_path):
    payload = {"job_id": "j", "requested_at": "2024-01-01T00:00:00Z", "ingest": True, "feeds": [{"feed_id": 1, "feed_url": "u", "fetchprotection": 1}, {"feed_id": 2, "feed_url": "v", "fetchprotection": 1, "etag": "e"}]}
    lines = [
        {"task_id": 1, "execution_id": 7, "lease_id": "l", "payload": json.dumps(payload)},
        {"task_id": 2, "execution_id": 7, "lease_id": "m", "payload": "{broken"},
        {"task_id": 3, "execution_id": 7, "lease_id": "n", "payload": json.dumps({**payload, "feeds": []})},
        {"task_id": 4, "execution_id": 7, "lease_id": "o", "payload": json.dumps({**payload, "feeds": [{"feed_id": 1, "feed_url": "u"}]})},
    ]
    (tmp_path / "leases.json").write_text("\n".join(map(json.dumps, lines)))
    rows = readers.decode_feed_tasks(readers.read_leases(spark, str(tmp_path))).collect()
    good = sorted((r.task_id, r.feed_index, r.feed_id, r.etag) for r in rows if not r.decode_error)
    assert good == [(1, 0, 1, None), (1, 1, 2, "e")]
    assert [r.task_id for r in rows if r.decode_error] == [2, 4]


def test_status_files(spark, tmp_path):
    good = {"app_version": "1", "worker_type": "w", "phase": "idle", "pid": 1, "current_task": {"task_id": 5, "execution_id": 6}}
    (tmp_path / "s.json").write_text(json.dumps(good) + "\ninvalid json\n")
    rows = readers.read_status(spark, str(tmp_path)).collect()
    assert sorted(r.load for r in rows) == ["error", "loaded"]
    assert [r.current_task.task_id for r in rows if r.load == "loaded"] == [5]


def test_release_round_trip(spark, tmp_path):
    files = tmp_path / "dist"
    files.mkdir()
    (files / "new-2.0.0.tar").write_bytes(b"new")
    line = [str(files / "new-2.0.0.tar"), "fam", "prod", "linux", "x86_64", "2.0.0", " ", "cuda", "tar", "bearer", "p/new"]
    (tmp_path / "meta.tsv").write_text("\t".join(line) + "\n\n \t \n")
    batch = readers.release_batch(
        readers.read_release_lines(spark, str(tmp_path / "meta.tsv")), readers.scan_artifacts(spark, str(files)), "https://d/", "https://n/", "2024"
    )
    row = batch.first()
    assert row.sha256 == hashlib.sha256(b"new").hexdigest()
    assert (row.download_url, row.worker_version, row.runtime_bundle) == ("https://d/new-2.0.0.tar", None, "cuda")
    base = {"family": "fam", "product": "prod", "platform": "linux", "arch": "x86_64"}
    old = [
        {**base, "runtime_bundle": "cuda", "artifact_name": "new-2.0.0.tar", "latest_version": "0"},
        {**base, "artifact_name": "old-1.4.2.tar", "latest_version": "x", "minimum_supported_version": "y"},
        {**base, "artifact_name": "plain.tar", "latest_version": "1.0.0", "minimum_supported_version": "0.9.0"},
    ]
    (tmp_path / "catalog.json").write_text(json.dumps({"items": old}, indent=2))
    catalog = readers.read_catalog(spark, str(tmp_path / "catalog.json"))
    merged = releases.upsert_catalog(catalog, batch)
    sinks.write_catalog(merged, str(tmp_path / "out"))
    texts = [p.read_text() for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size]
    written = [item for text in texts for item in json.loads(text)["items"]]
    assert [(w["artifact_name"], w["latest_version"], w["minimum_supported_version"]) for w in written] == [
        ("plain.tar", "1.0.0", "0.9.0"), ("old-1.4.2.tar", "1.4.2", "1.4.2"), ("new-2.0.0.tar", "2.0.0", "2.0.0"),
    ]
    assert releases.upsert_catalog(readers.empty_catalog(spark), batch).count() == 1
    # What was written is the catalogue of the next release.
    again = readers.read_catalog(spark, str(tmp_path / "out"))
    assert again.count() == 3
    newer = batch.withColumns({"artifact_name": F.lit("new-3.0.0.tar"), "latest_version": F.lit("3.0.0")})
    sinks.write_catalog(releases.upsert_catalog(again, newer), str(tmp_path / "out2"))
    names = {r.artifact_name for r in readers.read_catalog(spark, str(tmp_path / "out2")).collect()}
    assert names == {"plain.tar", "old-1.4.2.tar", "new-2.0.0.tar", "new-3.0.0.tar"}
    with pytest.raises(Exception, match="not a catalogue"):
        readers.decode_catalog(spark.createDataFrame([("{broken",)], "value string")).collect()
    quoted = readers.decode_release_lines(spark.createDataFrame([('"a\tb\tc"\td\te\tf\tg\th\ti\tj\tk',)], "line string"))
    assert quoted.select("source_path", "family", "product").first() == ('"a', "b", 'c"')


def test_embedding_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0, 10, [0.5, 1.0]), (1, 1, 1, 11, [1e-7, 2.0])], "task_id int, execution_id int, source_pos int, id bigint, embedding array<float>")
    sinks.write_embeddings(df, str(tmp_path / "v"))
    assert dict(spark.read.parquet(str(tmp_path / "v")).dtypes)["embedding"] == "array<double>"
    documents = sinks.embedding_payloads(df)
    sinks.write_payloads(documents, str(tmp_path / "p"))
    body = json.loads(spark.read.parquet(str(tmp_path / "p")).first().payload)
    assert [s["id"] for s in body["sources"]] == [10, 11]
    assert body["sources"][0]["embedding"] == [0.5, 1.0]


def test_large_artifacts_are_read_in_buffers(spark, tmp_path):
    big = tmp_path / "a folder" / "big-1.0.0.gz"  # no archive in truth: what is hashed is the file as it lies there
    big.parent.mkdir()
    with open(big, "wb") as out:
        out.write(b"head")
        out.truncate((1 << 31) + 5)  # sparse, and longer than a row may be
    (tmp_path / "small.bin").write_bytes(b"x")
    want = hashlib.sha256(b"head")
    zeros = bytes(1 << 20)
    for _ in range(2047):
        want.update(zeros)
    want.update(bytes((1 << 20) + 1))
    scanned = readers.scan_artifacts(spark, str(tmp_path), buffer_bytes=1 << 20)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in scanned.collect()}
    assert got == {"big-1.0.0.gz": ((1 << 31) + 5, want.hexdigest()), "small.bin": (1, hashlib.sha256(b"x").hexdigest())}
    assert "content" not in scanned._jdf.queryExecution().executedPlan().toString()


def test_runs_count_once(spark, tmp_path):
    place, schema = str(tmp_path / "runs of a job"), "task_id bigint, payload string"
    assert sinks.read_runs(spark, place, schema).count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    assert sinks.write_run(rows, place, "job/1")
    assert not sinks.write_run(rows, place, "job/1")
    rows.write.parquet(f"{place}/attempts/died")  # a job that ended before its manifest
    assert sinks.write_run(rows.where("task_id = 1").withColumn("payload", F.lit("c")), place, "job/2")
    got = sorted(tuple(r) for r in sinks.read_runs(spark, place, schema).collect())
    assert got == [(1, "a"), (1, "c"), (2, "b")]


def test_runs_that_race_leave_one(spark, tmp_path, monkeypatch):
    place, schema = str(tmp_path / "r"), "task_id bigint, payload string"
    rows = spark.createDataFrame([(1, "a")], schema)

    class Blind:
        """The other writer's manifest is not there yet when this one looks."""

        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def exists(self, path):
            return False

    assert sinks.write_run(rows, place, "k")
    real = sinks._files
    with monkeypatch.context() as patch:
        patch.setattr(sinks, "_files", lambda *a: Blind(real(*a)))
        assert not sinks.write_run(rows, place, "k")
    assert sinks.read_runs(spark, place, schema).count() == 1
    assert len(list((tmp_path / "r" / "attempts").iterdir())) == 1 and not list((tmp_path / "r" / "drafts").glob("[!.]*"))


def test_replayed_micro_batches_count_once(spark, tmp_path):
    source, place, schema = tmp_path / "in", str(tmp_path / "out"), "task_id bigint, payload string"
    spark.createDataFrame([(i, f"p{i}") for i in range(6)], schema).repartition(3).write.parquet(str(source))
    for checkpoint in ("first", "lost"):  # with its checkpoint lost, the stream reads all batches again
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        writer = stream.writeStream.option("checkpointLocation", str(tmp_path / checkpoint))
        writer.foreachBatch(sinks.run_writer(place, "results")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in sinks.read_runs(spark, place, schema).collect())
    assert got == [(i, f"p{i}") for i in range(6)]
