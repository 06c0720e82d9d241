"""Explicit schemas: nothing here is inferred from data."""

from __future__ import annotations

TASK_PAYLOAD = (
    "job_id string, requested_at timestamp, ingest boolean, feeds array<struct<feed_id: bigint, feed_url: string, "
    "company_id: bigint, host_header: string, fetchprotection: smallint, etag: string, last_update: timestamp, "
    "last_db_article_published_at: timestamp>>"
)
EMBEDDING_PAYLOAD = (
    "job_id string, worker_version string, sources array<struct<id: bigint, title: string, summary: string, url: string>>"
)
LEASE = (
    "lease_id string, trace_id string, task_type string, worker_version string, task_id bigint, execution_id bigint, "
    "payload_ref string, payload string, expires_at timestamp, signed_at timestamp, nonce string, signature string"
)
STATUS_SNAPSHOT = (
    "app_version string, worker_type string, acceleration_mode string, execution_backend string, pid bigint, "
    "phase string, server_connection string, started_at timestamp, last_updated_at timestamp, "
    "last_server_contact_at timestamp, current_task struct<task_id: bigint, execution_id: bigint, job_id: string, "
    "label: string, worker_version: string, item_count: bigint, started_at: timestamp>, current_feed_id bigint, "
    "current_feed_url string, completed_task_count bigint, network_totals struct<bytes_sent: bigint, "
    "bytes_received: bigint>, last_error string"
)
RELEASE_LINE = (
    "source_path string, family string, product string, platform string, arch string, version string, "
    "worker_version string, runtime_bundle string, artifact_kind string, download_auth string, "
    "storage_relative_path string"
)
RELEASE = (
    "artifact_name string, family string, product string, platform string, arch string, latest_version string, "
    "minimum_supported_version string, worker_version string, artifact_kind string, sha256 string, "
    "runtime_bundle string, download_auth string, download_url string, release_notes_url string, "
    "published_at string, storage_relative_path string"
)
# Media elements, which stand in RSS items and Atom entries alike, alone or in groups.
_MEDIA_CONTENT = "array<struct<_url: string, _type: string, `media:thumbnail`: array<struct<_url: string>>>>"
_MEDIA = (
    f"`media:thumbnail`: array<struct<_url: string>>, `media:content`: {_MEDIA_CONTENT}, "
    f"`media:group`: array<struct<`media:thumbnail`: array<struct<_url: string>>, `media:content`: {_MEDIA_CONTENT}>>"
)
_ITEM = (
    "struct<title: string, link: string, description: string, `content:encoded`: string, pubDate: string, `dc:date`: string, "
    f"author: string, `dc:creator`: array<string>, enclosure: array<struct<_url: string, _type: string>>, {_MEDIA}>"
)
# One landed feed body as the XML reader sees it: ``channel`` is there for RSS, with its items inside (RSS 2.0) or beside it
# (RSS 1.0); the rest is Atom.
FEED_BODY = (
    f"channel struct<lastBuildDate: string, pubDate: string, `dc:date`: string, item: array<{_ITEM}>>, item array<{_ITEM}>, "
    "id string, title string, updated string, entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, "
    "summary: string, content: struct<_VALUE: string, _type: string, _src: string>, published: string, "
    f"updated: string, author: array<struct<name: string>>, {_MEDIA}>>"
)
# The same for JSON Feed.
JSON_FEED = (
    "version string, items array<struct<title: string, url: string, summary: string, content_html: string, content_text: string, "
    "date_published: string, date_modified: string, author: struct<name: string>, authors: array<struct<name: string>>, "
    "image: string, attachments: array<struct<url: string, mime_type: string>>>>"
)
