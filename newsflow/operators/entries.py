"""Feed entries to sources: link, dedup, time filter, title, summary, image, authors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.bylines import with_authors
from newsflow.functions.html import html_to_text, inline_image
from newsflow.functions.text import looks_like_image, required_text


def first_link(links: Column) -> Column:
    """First link that is not blank."""
    return F.get(F.filter(F.transform(links, required_text), lambda x: x.isNotNull()), F.lit(0))


def with_first_link(entries: DataFrame, links: str = "links", out: str = "url") -> DataFrame:
    """Entries that have a usable link, with it as ``out``."""
    return entries.withColumn(out, first_link(F.col(links))).where(F.col(out).isNotNull())


def first_per_url(
    entries: DataFrame, feed: Sequence[str] = ("feed_id",), url: str = "url", position: str = "entry_pos"
) -> DataFrame:
    """First entry of every URL of a feed (``feed``: the columns that name one fetched document).

    Written as a rank filter so that the plan cuts every input partition to one row per key before the
    shuffle; a URL with very many copies never meets in one task.
    """
    rank = F.row_number().over(Window.partitionBy(*feed, url).orderBy(position))
    return entries.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def published_since(entries: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """``published_at`` = published, else updated; rows without one or before the feed's mark are dropped.

    The mark is the entries' own ``last_db_article_published_at`` column, or comes from ``feeds`` (feed_id,
    last_db_article_published_at), which Spark broadcasts only below its size threshold.
    """
    entries = entries.withColumn("published_at", F.coalesce("published", "updated")).where(
        F.col("published_at").isNotNull()
    )
    mark = "last_db_article_published_at"
    if feeds is None and mark not in entries.columns:
        return entries
    if feeds is None:
        return entries.where(F.col(mark).isNull() | (F.col("published_at") >= F.col(mark)))
    marks = feeds.select("feed_id", F.col("last_db_article_published_at").alias("__since"))
    fresh = F.col("__since").isNull() | (F.col("published_at") >= F.col("__since"))
    return entries.join(marks, "feed_id", "left").where(fresh).drop("__since")


def with_required_title(entries: DataFrame, title: str = "title") -> DataFrame:
    return entries.withColumn(title, required_text(F.col(title))).where(F.col(title).isNotNull())


def with_summary(
    entries: DataFrame, summary: str = "summary", body: str = "content_body", out: str = "summary"
) -> DataFrame:
    """Readable summary, else readable content body, else NULL."""
    return entries.withColumn(out, F.coalesce(html_to_text(summary), html_to_text(body)))


def media_image(media: Column) -> Column:
    """First thumbnail that looks like an image, else first media content that is one.

    ``media``: array<struct<thumbnails: array<string>, content: array<struct<url, content_type>>>>.
    """
    thumbnails = F.flatten(
        F.transform(media, lambda m: F.coalesce(m.thumbnails, F.array().cast("array<string>")))
    )
    contents = F.flatten(
        F.transform(
            media,
            lambda m: F.coalesce(m.content, F.array().cast("array<struct<url:string,content_type:string>>")),
        )
    )

    def is_image(x: Column) -> Column:
        declared = F.startswith(x.content_type, F.lit("image/"))
        return x.url.isNotNull() & F.coalesce(declared, looks_like_image(x.url))

    return F.coalesce(
        F.get(F.filter(thumbnails, looks_like_image), F.lit(0)),
        F.get(F.transform(F.filter(contents, is_image), lambda x: x.url), F.lit(0)),
    )


def with_image(entries: DataFrame, out: str = "image_url") -> DataFrame:
    """Image of an entry: media, inline image of summary or body, else the content source."""
    source = F.when(looks_like_image(F.col("content_src")), F.col("content_src"))
    return entries.withColumn(
        out,
        F.coalesce(
            media_image(F.col("media")), inline_image("summary"), inline_image("content_body"), source
        ),
    )


def assemble_sources(
    entries: DataFrame, feeds: DataFrame | None = None, feed: Sequence[str] = ("feed_id",)
) -> DataFrame:
    """Entries -> sources, keyed by the ``feed`` columns.

    Cheap tests come first; dedup stands before the time and title tests because a first occurrence that
    fails them still hides its copies. The costly text work runs on the survivors only.
    """
    kept = first_per_url(with_first_link(entries), feed)
    kept = published_since(kept, feeds).transform(with_required_title)
    return finish_sources(kept, feed)


def finish_sources(kept: DataFrame, feed: Sequence[str] = ("feed_id",)) -> DataFrame:
    """Image, authors and summary of surviving entries, as source rows."""
    kept = with_authors(kept.transform(with_image), "authors", "__names")
    return with_summary(kept).select(
        *feed,
        F.col("entry_pos").alias("source_pos"),
        "title",
        "url",
        "summary",
        F.col("__names").alias("authors"),
        "published_at",
        "image_url",
    )
