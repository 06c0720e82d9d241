"""Sources: task payloads, feed documents, status snapshots, release metadata, catalogues, artifacts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.text import parse_http_date
from newsflow.plans.scan import explode_once
from newsflow.sources import dialects, schemas

MEDIA = "array<struct<thumbnails: array<string>, content: array<struct<url: string, content_type: string>>>>"
CORRUPT = "_corrupt_record"
JSON_FEED_VERSION = "https://jsonfeed.org/version/1"  # fixed value: 1 and 1.1


def read_leases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LEASE).json(path)


def decode_feed_tasks(leases: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per feed of every task, with its index. A bad payload gives one row with ``decode_error``.

    A payload is bad when it is no JSON of this shape or lacks a required field, in itself or in one of its feeds.
    """
    need, each = ["job_id", "requested_at", "ingest"], ["feed_id", "feed_url", "fetchprotection"]
    return _decode(leases, payload, schemas.TASK_PAYLOAD, "feeds", "feed_index", need, need, each)


def decode_embedding_tasks(leases: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per source of every embedding task, with its position."""
    header = ["job_id", "worker_version"]
    return _decode(leases, payload, schemas.EMBEDDING_PAYLOAD, "sources", "source_pos", header, ["job_id"], ["id"])


def _decode(
    leases: DataFrame, payload: str, schema: str, items: str, position: str, header: list[str], need: list[str], each: list[str]
) -> DataFrame:
    with_corrupt = f"{schema}, {CORRUPT} string"
    parsed = F.from_json(F.col(payload), with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    keys = [c for c in leases.columns if c != payload and c not in header]
    rows = leases.select(*keys, parsed.alias("__p"))
    bad = F.col("__p").isNull() | F.col(f"__p.{CORRUPT}").isNotNull() | F.col(f"__p.{items}").isNull()
    for name in need:
        bad = bad | F.col(f"__p.{name}").isNull()
    for name in each:
        bad = bad | F.exists(f"__p.{items}", _lacks(name))
    rows = rows.withColumn("decode_error", bad)
    exploded = rows.select(
        *keys,
        "decode_error",
        *[F.col(f"__p.{h}").alias(h) for h in header],
        F.posexplode_outer(F.when(~F.col("decode_error"), F.col(f"__p.{items}"))).alias(position, "__item"),
    ).where(F.col(position).isNotNull() | F.col("decode_error"))
    return exploded.select(*[c for c in exploded.columns if c != "__item"], "__item.*")


def with_feed(bodies: DataFrame, body: str = "body", out: str = "feed") -> DataFrame:
    """``bodies`` with their parsed form in place of the text: entries, updated, and readable.

    RSS 2.0 and its elders, RSS 1.0 (RDF), Atom and JSON Feed, told apart by the root. Elements are known by their
    namespaces, not by the prefixes that a document chose for them. A body that is none of these, or no well-formed
    document, is not readable and has no entries. The text is parsed once.
    """
    xml_schema = f"{schemas.FEED_BODY}, {CORRUPT} string"
    options = {"mode": "PERMISSIVE", "ignoreNamespace": "false", "columnNameOfCorruptRecord": CORRUPT}
    keys = [c for c in bodies.columns if c != body]
    rooted = bodies.select(*keys, F.col(body).alias("__body"), dialects.root_name(F.col(body)).alias("__root"))
    text, root, f, j = (F.col(c) for c in ("__body", "__root", "__f", "__j"))
    markup = F.when(root.isin("rss", "RDF", "feed", "entry"), dialects.feed_markup(text))
    rows = rooted.select(
        *keys, root, F.from_xml(markup, xml_schema, options).alias("__f"),
        F.from_json(F.when(root == "{", text), schemas.JSON_FEED).alias("__j"),
    )
    formed = f.isNotNull() & f.getField(CORRUPT).isNull()
    rss = formed & (root == "rss") & f.channel.isNotNull()
    rdf = formed & (root == "RDF") & (f.channel.isNotNull() | f.getField("item").isNotNull())
    atom = formed & root.isin("feed", "entry")
    json = (root == "{") & F.startswith(j.version, F.lit(JSON_FEED_VERSION))
    entries = (
        F.when(rss, _rss_entries(f.channel.item)).when(rdf, _rss_entries(f.getField("item")))
        .when(atom, _atom_entries(f)).when(json, _json_entries(j))
    )
    updated = _timestamp(
        F.when(rss, f.channel.lastBuildDate).when(rdf, f.channel.getField("dc:date")).when(atom, f.updated)
    )
    readable = F.coalesce(rss | rdf | atom | json, F.lit(False))
    return rows.select(*keys, F.struct(entries.alias("entries"), updated.alias("updated"), readable.alias("readable")).alias(out))


def feed_entries(feeds: DataFrame, feed: str = "feed") -> DataFrame:
    """One row per entry of parsed feeds, with entry_pos, links, title, summary, content_body, content_src, authors,
    published, updated, media and the other columns of ``feeds``."""
    keys = [c for c in feeds.columns if c != feed]
    return explode_once(feeds.select(*keys, F.col(f"{feed}.entries").alias("__e")), "__e", "e", "e.*", position="entry_pos")


def _lacks(name: str) -> Callable[[Column], Column]:
    return lambda item: item[name].isNull()


def parse_feeds(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Landed feed bodies -> entries; a body that is no feed gives no rows."""
    return feed_entries(with_feed(bodies, body, "__feed"), "__feed")


def _timestamp(text: Column) -> Column:
    return F.coalesce(parse_http_date(text), F.try_to_timestamp(text))


def _strings(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def _entry(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


LINKED = "array<struct<_url: string, _type: string>>"


def _media_of(holder: Column, enclosures: Column) -> Column:
    """Thumbnails and contents of an element that holds media elements."""
    given = holder.getField("media:content")
    plain = F.transform(given, lambda c: F.struct(c.getField("_url").alias("_url"), c.getField("_type").alias("_type")))
    contents = F.concat(F.coalesce(plain, F.array().cast(LINKED)), enclosures)
    inner = F.flatten(F.transform(given, lambda c: _urls(c.getField("media:thumbnail"))))
    return F.struct(
        F.concat(_urls(holder.getField("media:thumbnail")), _strings(inner)).alias("thumbnails"),
        F.transform(
            contents, lambda c: F.struct(c.getField("_url").alias("url"), c.getField("_type").alias("content_type"))
        ).alias("content"),
    )


def _media(item: Column, enclosures: Column | None = None) -> Column:
    """Media of an item or entry: its own with the enclosures, then those of its groups."""
    none = F.array().cast(LINKED)
    own = _media_of(item, none if enclosures is None else F.coalesce(enclosures, none))
    groups = F.transform(item.getField("media:group"), lambda g: _media_of(g, F.array().cast(LINKED)))
    return F.concat(F.array(own).cast(MEDIA), F.coalesce(groups.cast(MEDIA), F.array().cast(MEDIA)))


def _urls(elements: Column) -> Column:
    return _strings(F.transform(elements, lambda t: t.getField("_url")))


def _rss_entries(items: Column) -> Column:
    none = F.lit(None).cast("string")

    def entry(i: Column) -> Column:
        creators = _strings(i.getField("dc:creator"))
        bylines = F.filter(F.concat(F.array(i.author), creators), lambda a: a.isNotNull())
        return _entry(
            links=F.filter(F.array(i.link), lambda x: x.isNotNull()),
            title=i.title,
            summary=i.description,
            content_body=i.getField("content:encoded"),
            content_src=none,
            authors=bylines,
            published=F.coalesce(_timestamp(i.pubDate), _timestamp(i.getField("dc:date"))),
            updated=F.lit(None).cast("timestamp"),
            media=_media(i, i.enclosure),
        )

    return F.transform(items, entry)


def _atom_entries(feed: Column) -> Column:
    def entry(e: Column) -> Column:
        return _entry(
            links=_strings(F.transform(e.link, lambda x: x.getField("_href"))),
            title=e.title,
            summary=e.summary,
            content_body=e.content.getField("_VALUE"),
            content_src=e.content.getField("_src"),
            authors=_strings(F.transform(e.author, lambda a: a.getField("name"))),
            published=_timestamp(e.published),
            updated=_timestamp(e.updated),
            media=_media(e),
        )

    return F.transform(feed.entry, entry)


def _json_entries(feed: Column) -> Column:
    def entry(i: Column) -> Column:
        names = F.coalesce(F.transform(i.authors, lambda a: a.getField("name")), F.array(i.author.getField("name")))
        files = F.transform(i.attachments, lambda a: F.struct(a.url.alias("url"), a.mime_type.alias("content_type")))
        media = F.struct(F.filter(F.array(i.image), lambda x: x.isNotNull()).alias("thumbnails"), files.alias("content"))
        return _entry(
            links=F.filter(F.array(i.url), lambda x: x.isNotNull()),
            title=i.title,
            summary=i.summary,
            content_body=F.coalesce(i.content_html, i.content_text),
            content_src=F.lit(None).cast("string"),
            authors=F.filter(names, lambda a: a.isNotNull()),
            published=_timestamp(i.date_published),
            updated=_timestamp(i.date_modified),
            media=F.array(media).cast(MEDIA),
        )

    return F.transform(feed.getField("items"), entry)


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files, one row per file: path, body. Bytes become text by the document's own encoding."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", dialects.decode_bytes(F.col("content")).alias("body"))


def read_status(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Status snapshots, one JSON document per line, with ``load`` = loaded | error; batch or stream."""
    schema = f"{schemas.STATUS_SNAPSHOT}, {CORRUPT} string"
    reader = (spark.readStream if stream else spark.read).schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return label_loads(reader.json(path))


def decode_status(lines: DataFrame, text: str = "value") -> DataFrame:
    """Status snapshots from a text column: NULL text is missing, unreadable text is an error."""
    schema = f"{schemas.STATUS_SNAPSHOT}, {CORRUPT} string"
    parsed = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    keys = [c for c in lines.columns if c != text]
    rows = lines.select(*keys, F.col(text).isNull().alias("__missing"), parsed.alias("s"))
    loaded = label_loads(rows.select(*keys, "__missing", "s.*"))
    return loaded.withColumn("load", F.when(F.col("__missing"), "missing").otherwise(F.col("load"))).drop("__missing")


def label_loads(snapshots: DataFrame) -> DataFrame:
    bad = F.col(CORRUPT).isNotNull() | F.col("phase").isNull() | F.col("worker_type").isNull()
    return snapshots.withColumn("load", F.when(bad, "error").otherwise("loaded")).drop(CORRUPT)


def read_release_lines(spark: SparkSession, path: str) -> DataFrame:
    """Release metadata: 11 tab-separated fields, blank lines skipped."""
    return tidy_release_lines(spark.read.csv(path, sep="\t", schema=schemas.RELEASE_LINE, quote="", escape=""))


def decode_release_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The same from a text column."""
    kept = lines.where(F.trim(F.regexp_replace(line, r"\s+", " ")) != "")
    fields = F.from_csv(F.col(line), schemas.RELEASE_LINE, {"sep": "\t", "quote": "", "escape": ""})
    others = [c for c in lines.columns if c != line]
    return tidy_release_lines(kept.select(*others, fields.alias("f")).select(*others, "f.*"))


def tidy_release_lines(rows: DataFrame) -> DataFrame:
    """Blank optional fields are absent; the artifact name is the last part of its path."""
    blank = {
        c: F.when(F.trim(F.col(c)) != "", F.col(c)) for c in ("worker_version", "runtime_bundle")
    }
    return rows.withColumns(blank).withColumn("artifact_name", F.substring_index("source_path", "/", -1))


def release_batch(
    lines: DataFrame, digests: DataFrame, download_base_url: str, release_notes_url: str, published_at: str
) -> DataFrame:
    """Catalogue rows of new artifacts: metadata lines with the digests of their files (path, sha256)."""
    scanned = digests.select(F.regexp_replace("path", "^file:/*", "/").alias("source_path"), "sha256")
    return lines.join(scanned, "source_path", "left").select(
        "artifact_name", "family", "product", "platform", "arch",
        F.col("version").alias("latest_version"), F.col("version").alias("minimum_supported_version"),
        "worker_version", "artifact_kind", "sha256", "runtime_bundle", "download_auth",
        F.concat(F.lit(download_base_url.rstrip("/") + "/"), F.col("artifact_name")).alias("download_url"),
        F.lit(release_notes_url.rstrip("/")).alias("release_notes_url"),
        F.lit(published_at).alias("published_at"), "storage_relative_path",
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Items of catalogue documents ``{"items": [...]}``; a document that cannot be read is an error."""
    documents = spark.read.text(path, wholetext=True)
    return decode_catalog(documents, "value")


def decode_catalog(documents: DataFrame, text: str = "value") -> DataFrame:
    """One row per item; a text that is no catalogue ends the job instead of passing for an empty one."""
    parsed = F.from_json(F.col(text), f"items array<struct<{_fields(schemas.RELEASE)}>>")
    items = F.coalesce(parsed.getField("items"), F.raise_error(F.lit("not a catalogue document")))
    others = [c for c in documents.columns if c != text]
    return explode_once(documents.select(*others, items.alias("__i")), "__i", "i", "i.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.strip().split(" ", 1) for part in ddl.split(",")))


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.RELEASE)


def scan_artifacts(spark: SparkSession, path: str, buffer_bytes: int = 1 << 22) -> DataFrame:
    """SHA-256 of every artifact file below a folder: (path, length, sha256).

    Spark lists the files and packs them into tasks by length; contents never become rows. A task reads a file through one
    buffer of ``buffer_bytes``, so files may be of any size; empty ones, which Spark's listing leaves out, give no row. Files
    are opened by pyarrow's file systems, which the executors need for the scheme of ``path``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_file_digest(p, buffer_bytes) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["path", "length", "sha256"])

    return files.mapInArrow(digests, "path string, length bigint, sha256 string")


def _file_digest(path: str, buffer_bytes: int) -> str:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        files, place = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        host, _, place = rest.removeprefix("//").partition("/")
        files, base = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{host}/")
        place = f"{base.rstrip('/')}/{place}"
    digest = hashlib.sha256()
    with files.open_input_stream(place, compression=None) as stream:
        while chunk := stream.read(buffer_bytes):
            digest.update(chunk)
    return digest.hexdigest()


def digest_contents(files: DataFrame, content: str = "content") -> DataFrame:
    return files.select("path", F.sha2(F.col(content), 256).alias("sha256"))
