"""Queries over entries, authors and feed documents (groups A1-A4, B, C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.html import html_to_text, inline_image
from newsflow.operators import authors, entries, tasks
from newsflow.plans.inputs import load
from newsflow.plans.registry import big, joined, query, us
from newsflow.sources import readers
from newsflow.sources.dialects import decode_bytes

# ---- SQL pieces of the oracles ------------------------------------------------------------------
_TAGS = (
    "blockquote|figcaption|article|section|figure|footer|header|aside|div|img|br|h1|h2|h3|h4|h5|h6|hr|li|ol|tr|ul|p"
)


_L, _R = "\ue000", "\ue001"


def _strip_sql(x: str) -> str:
    closed = rf"regexp_replace({x}, '<([A-Za-z/!?][^>]*)>', '{_L}\1{_R}', 'g')"
    opened = rf"regexp_replace({closed}, '<[A-Za-z/!?][^>{_R}]*$', '')"
    spaced = rf"regexp_replace({opened}, '(?i){_L}/*!*\?*({_TAGS})([^A-Za-z0-9{_R}-][^{_R}]*)?{_R}', ' ', 'g')"
    return rf"regexp_replace({spaced}, '{_L}[^{_R}]*{_R}', '', 'g')"


def clean_sql(x: str) -> str:
    decoded = _strip_sql(x)
    for name, text in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        decoded = f"replace({decoded}, '&{name};', '{text}')"
    collapsed = rf"regexp_replace({decoded}, '[\s\p{{Z}}]+', ' ', 'g')"
    return f"""nullif(trim({collapsed}, ' "''`´«»“”„‟‘’‚‹›「」『』〝〞'), '')"""


@query(
    "b1_first_link",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE concat(url, '#a') END AS url
       FROM {pages} WHERE page_id % 13 <> 0""",
)
def first_link(spark: SparkSession, sf: str) -> DataFrame:
    [pages] = load(spark, sf, "pages")
    usual = F.array(
        F.when(F.col("page_id") % 3 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("url"), F.lit("#a\t"))),
        F.concat(F.lit("\n"), F.col("url"), F.lit(" ")),
    )
    links = F.when(F.col("page_id") % 13 == 0, F.array(F.lit("  "), F.lit(""))).otherwise(usual)
    listed = pages.select("page_id", links.alias("links"))
    return entries.with_first_link(listed).select("page_id", "url")


_FIRST = """SELECT *, trim(link) AS url, row_number() OVER (PARTITION BY feed_id, trim(link) ORDER BY entry_pos) AS rn
            FROM {v_entries} e"""


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    [rows] = load(spark, sf, "v_entries")
    return entries.with_first_link(rows.withColumn("links", F.array("link"))).withColumn(
        "updated", F.lit(None).cast("timestamp")
    )


@query("b2_first_per_url", f"SELECT feed_id, entry_pos, url FROM ({_FIRST}) WHERE rn = 1")
def first_per_url(spark: SparkSession, sf: str) -> DataFrame:
    return entries.first_per_url(_linked(spark, sf)).select("feed_id", "entry_pos", "url")


@query(
    "b3_published_since",
    """SELECT e.feed_id, e.entry_pos, epoch_us(e.published) AS published_us
       FROM {v_entries} e LEFT JOIN {v_marks} m ON e.feed_id = m.feed_id
       WHERE e.published IS NOT NULL
         AND (m.last_db_article_published_at IS NULL OR e.published >= m.last_db_article_published_at)""",
)
def published_since(spark: SparkSession, sf: str) -> DataFrame:
    [marks] = load(spark, sf, "v_marks")
    rows = entries.published_since(_linked(spark, sf), marks)
    return rows.select("feed_id", "entry_pos", us("published_at").alias("published_us"))


@query("b4_required_title", "SELECT feed_id, entry_pos, trim(title) AS title FROM {v_entries} e WHERE trim(title) <> ''")
def required_title(spark: SparkSession, sf: str) -> DataFrame:
    return entries.with_required_title(_linked(spark, sf)).select("feed_id", "entry_pos", "title")


@query(
    "b5_summary_fallback",
    f"""SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL WHEN page_id % 2 = 0 THEN {clean_sql("html")}
                             ELSE 'Fish & chips' END AS summary
        FROM {{pages}}""",
)
def summary_fallback(spark: SparkSession, sf: str) -> DataFrame:
    [pages] = load(spark, sf, "pages")
    n = F.col("page_id")
    summary = F.when(n % 2 == 0, F.col("html")).when(n % 4 == 1, F.lit("<p> &nbsp; </p>"))
    body = F.when(n % 4 != 3, F.lit("<p>Fish &amp; chips</p>"))
    rows = pages.select("page_id", summary.alias("summary"), body.alias("content_body"))
    return entries.with_summary(rows).select("page_id", "summary")


@query("b6_html_to_text", f"SELECT page_id, {clean_sql('html')} AS text FROM {{pages}}")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    [pages] = load(spark, sf, "pages")
    return pages.select("page_id", html_to_text("html").alias("text"))


def _with_image_fields(pages: DataFrame) -> DataFrame:
    n, url = F.col("page_id"), F.col("url")

    def text(value: Column) -> Column:
        return value.cast("string")

    thumbs = F.array(F.lit("about:blank"), F.when(n % 6 == 0, F.concat(url, F.lit(".png"))))
    content = F.array(
        F.struct(F.concat(url, F.lit("/clip")).alias("url"), F.lit("video/mp4").alias("content_type")),
        F.struct(
            F.when(n % 6 == 1, F.concat(url, F.lit("/c"))).alias("url"),
            text(F.when(n % 12 == 1, F.lit("image/x"))).alias("content_type"),
        ),
    )
    inline = F.concat(F.lit('<div><IMG alt=1 SRC="'), url, F.lit('.jpg?a=1&amp;b=2"/> tail '), F.col("html"))
    return pages.select(
        "page_id",
        F.array(F.struct(thumbs.alias("thumbnails"), content.alias("content"))).alias("media"),
        F.when(n % 6 == 2, inline).alias("summary"),
        F.when(n % 6 == 3, inline).alias("content_body"),
        F.when(n % 6 == 4, F.concat(F.lit("/rel/"), text(n), F.lit(".gif"))).otherwise(F.lit("/rel/x")).alias("content_src"),
    )


@query(
    "b7_image_cascade",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat(url, '.png') WHEN 1 THEN concat(url, '/c')
                            WHEN 2 THEN concat(url, '.jpg?a=1&b=2') WHEN 3 THEN concat(url, '.jpg?a=1&b=2')
                            WHEN 4 THEN concat('/rel/', page_id, '.gif') END AS image_url
       FROM {pages}""",
)
def image_cascade(spark: SparkSession, sf: str) -> DataFrame:
    [pages] = load(spark, sf, "pages")
    return entries.with_image(_with_image_fields(pages)).select("page_id", "image_url")


@query(
    "b8_inline_image",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat(url, '.jpg?x=1&y=2') WHEN 1 THEN concat(url, '.webp') END AS image_url
       FROM {pages}""",
)
def inline(spark: SparkSession, sf: str) -> DataFrame:
    [pages] = load(spark, sf, "pages")
    n, url = F.col("page_id"), F.col("url")
    shapes = (
        F.when(n % 5 == 0, F.concat(F.lit('<p><img src="'), url, F.lit('.jpg?x=1&amp;y=2">')))
        .when(n % 5 == 1, F.concat(F.lit("<IMG alt='a'> <b SRC=' "), url, F.lit(".webp '>")))
        .when(n % 5 == 2, F.concat(F.lit("<img src="), url, F.lit(".png src=\"x.png\">")))
        .when(n % 5 == 3, F.concat(F.lit('<img src="notes.txt"> <img src="'), url, F.lit('.png">')))
        .otherwise(F.concat(F.lit('src="a.png" <img alt="'), n.cast("string"), F.lit('"/>')))
    )
    rows = pages.withColumn("html", F.concat(shapes, F.regexp_replace("html", "(?i)src=", "")))
    return rows.select("page_id", inline_image("html").alias("image_url"))


ASSEMBLED_SQL = f"""
    SELECT f.feed_id, entry_pos AS source_pos, trim(title) AS title, url, {clean_sql("summary")} AS summary,
           'Alice Martin|AFP' AS authors, epoch_us(published) AS published_us, CAST(NULL AS VARCHAR) AS image_url
    FROM ({_FIRST}) f LEFT JOIN {{v_marks}} m ON f.feed_id = m.feed_id
    WHERE rn = 1 AND published IS NOT NULL AND trim(title) <> ''
      AND (m.last_db_article_published_at IS NULL OR published >= m.last_db_article_published_at)"""


def entry_fields(rows: DataFrame) -> DataFrame:
    """v_entries with the remaining entry columns."""
    none = F.lit(None).cast("string")
    return rows.select(
        "feed_id",
        "entry_pos",
        F.array(F.lit(" "), F.col("link")).alias("links"),
        "title",
        "summary",
        none.alias("content_body"),
        none.alias("content_src"),
        F.array(F.lit("By Alice Martin, ALICE  MARTIN"), F.lit("AFP")).alias("authors"),
        "published",
        F.lit(None).cast("timestamp").alias("updated"),
        F.array().cast(readers.MEDIA).alias("media"),
    )


def assembled(spark: SparkSession, sf: str) -> DataFrame:
    rows, marks = load(spark, sf, "v_entries", "v_marks")
    return entries.assemble_sources(entry_fields(rows), marks)


@query("b9_assemble_sources", ASSEMBLED_SQL)
def assemble_sources(spark: SparkSession, sf: str) -> DataFrame:
    return assembled(spark, sf).select(
        "feed_id", "source_pos", "title", "url", "summary", joined("authors").alias("authors"),
        us("published_at").alias("published_us"), "image_url",
    )


@query(
    "flagship_ingest",
    f"""WITH s AS ({ASSEMBLED_SQL}),
             k AS (SELECT feed_id, row_number() OVER (PARTITION BY feed_id % 5, lower(trim(url)) ORDER BY feed_id, source_pos)
                   AS rn, summary FROM s)
        SELECT feed_id, count(*) AS input_candidates, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS kept,
               CAST(sum(CASE WHEN rn = 1 THEN length(summary) ELSE 0 END) AS BIGINT) AS kept_chars
        FROM k GROUP BY feed_id""",
)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Entries to cleaned sources, deduplicated over the feeds of a task, counted per feed."""
    sources = assembled(spark, sf).select(
        "feed_id", "source_pos", "url", F.length("summary").alias("chars"), (F.col("feed_id") % 5).alias("task_id"),
        F.col("feed_id").alias("feed_index"),
    )
    rows = tasks.dedup_sources(sources, ["task_id"], keep_dropped=True)
    return rows.groupBy("feed_id").agg(
        F.count("*").alias("input_candidates"),
        F.count_if("kept").alias("kept"),
        F.sum(F.when(F.col("kept"), F.col("chars")).otherwise(0)).cast("bigint").alias("kept_chars"),
    )


# ---- authors ------------------------------------------------------------------------------------
BYLINES = {
    "Alice Martin, Bob Stone and Chloé Durand": "Alice Martin|Bob Stone|Chloé Durand",
    "Adélie Aubaret avec AFP, à Bastia": "Adélie Aubaret",
    "Anne Le Nir, au Liban": "Anne Le Nir",
    "Anne Le Nir au Liban": "Anne Le Nir",
    "avec Agnès Rotivel": "Agnès Rotivel",
    "Axel Chouvel avec Orthodoxie.com": "Axel Chouvel",
    "Jean Dupont, correspondant à Kiev": "Jean Dupont",
    "Jean Dupont envoyée spéciale à Gaza": "Jean Dupont",
    "Delphine Nerbollier à Berlin": "Delphine Nerbollier",
    "Delphine Nerbollier à Stuttgart": "Delphine Nerbollier",
    "Delphine Nerbollier correspondante": "Delphine Nerbollier",
    "Delphine Nerbollier (à Berlin)": "Delphine Nerbollier",
    "de notre correspondant au Liban": "correspondant au Liban",
    "propos recueillis par Jean Dupont": "Jean Dupont",
    "recueilli par J. D.": "J. D.",
    "reported by AFP": "AFP",
    "Text John Doe": "John Doe",
    "edited by sarah smaje executive producers are molly glassey": "sarah smaje|molly glassey",
    "Olivier-Marie JOSEPH aumônier d’hôpital (diocèse de Créteil)": "Olivier-Marie JOSEPH",
    "Research and Markets": "Research and Markets",
    "A Guardian reporter": "",
    "notre correspondant régional": "",
}
PARTS = {
    "Alice Martin, Bob Stone and Chloé Durand": "Alice Martin|Bob Stone|Chloé Durand",
    "Research and Markets": "Research and Markets",
    "AFP & Jean Dupont": "AFP|Jean Dupont",
    "Jean Dupont et correspondant": "Jean Dupont et correspondant",
    "Ann Lee; 'Bob Ray' ,,": "Ann Lee|Bob Ray",
    "edited by Ann Lee": "Ann Lee",
}
CANDIDATES = {
    "Jean Dupont, correspondant à Kiev": "Jean Dupont",
    "avec by AFP": "by AFP",
    "By par Jean Dupont": "Jean Dupont",
    "Bo (a (b) c) Ray": "Bo Ray",
    "Jean Dupont with example.com": "Jean Dupont",
    "www.example.com": None,
    "à Paris": None,
    "texte de notre Ann Lee": "Ann Lee",
    "Ludwig van Beethoven editor at home": "Ludwig van Beethoven",
}
DISCARD = {
    "Text": True,
    "correspondant": True,
    "correspondant à Kiev": False,
    "The news desk": True,
    "see example.org today": True,
    "au Liban": True,
    "Au Liban": False,
    "Jean Dupont": False,
}
ROLES = {
    "Jean Dupont, correspondant à Kiev": "Jean Dupont",
    "correspondant à Kiev, Jean Dupont": "correspondant à Kiev|Jean Dupont",
    "correspondant à Kiev; envoyé spécial en Iran": "correspondant à Kiev|envoyé spécial en Iran",
    "Ann Lee, correspondent in Rome, Bob Ray": "Ann Lee|Bob Ray",
}


def _quoted(value: str | bool | None) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else "'" + value.replace("'", "''") + "'"


# Names in the bylines are made from the first and the last word of each document.
NAMES = {
    "Jean Dupont": ("Jean Q", "([A-Za-z]{2,})"),
    "Ann Lee": ("Ann Z", "([A-Za-z]{2,})[^A-Za-z]*$"),
}


def _named_sql(value: str) -> str:
    for name, (start, word) in NAMES.items():
        value = f"replace({value}, '{name}', concat('{start}', lower(regexp_extract(text, '{word}', 1))))"
    return value


def _expected(golden: dict, column: str) -> str:
    rows = ", ".join(f"({i}, {_quoted(v)})" for i, v in enumerate(golden.values()))
    value = "g.v" if isinstance(next(iter(golden.values())), bool) else _named_sql("g.v")
    return f"""SELECT doc_id, {value} AS {column} FROM {{documents}} d
               JOIN (VALUES {rows}) g(i, v) ON d.doc_id % {len(golden)} = g.i"""


def _bylined(spark: SparkSession, sf: str, golden: dict, column: str) -> DataFrame:
    [documents] = load(spark, sf, "documents")
    byline = F.get(F.array(*[F.lit(t) for t in golden]), (F.col("doc_id") % len(golden)).cast("int"))
    for name, (start, word) in NAMES.items():
        own = F.concat(F.lit(start), F.lower(F.regexp_extract("text", word, 1)))
        byline = F.replace(byline, F.lit(name), own)
    return documents.select("doc_id", byline.alias(column))


_PART_ROWS = ", ".join(
    f"({i}, {p}, {_quoted(t)})" for i, v in enumerate(PARTS.values()) for p, t in enumerate(v.split("|"))
)


@query(
    "c1_split_bylines",
    f"""SELECT doc_id, string_agg({_named_sql("g.t")}, '|' ORDER BY g.p) AS parts FROM {{documents}} d
        JOIN (VALUES {_PART_ROWS}) g(i, p, t) ON d.doc_id % {len(PARTS)} = g.i GROUP BY doc_id""",
)
def split_bylines(spark: SparkSession, sf: str) -> DataFrame:
    rows = authors.split_bylines(_bylined(spark, sf, PARTS, "byline"))
    ordered = F.array_sort(F.collect_list(F.struct("line_part", "part", "part_text")))
    return rows.groupBy("doc_id").agg(joined(F.transform(ordered, lambda x: x.part_text)).alias("parts"))


@query("c2_clean_candidates", _expected(CANDIDATES, "name"))
def clean_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return authors.clean_candidates(_bylined(spark, sf, CANDIDATES, "candidate")).select("doc_id", "name")


@query("c3_discard_filter", _expected(DISCARD, "discard"))
def discard_filter(spark: SparkSession, sf: str) -> DataFrame:
    return authors.flag_discardable(_bylined(spark, sf, DISCARD, "candidate")).select("doc_id", "discard")


@query("c4_role_suppression", _expected(ROLES, "candidates"))
def role_suppression(spark: SparkSession, sf: str) -> DataFrame:
    rows = authors.byline_candidates(_bylined(spark, sf, ROLES, "byline"))
    return rows.select("doc_id", joined("candidates").alias("candidates"))


@query(
    "c5_identity_key",
    """SELECT doc_id, nullif(trim(regexp_replace(lower(strip_accents(text)), '[^0-9a-z]+', ' ', 'g')), '') AS identity
       FROM {documents}""",
)
def identity(spark: SparkSession, sf: str) -> DataFrame:
    [documents] = load(spark, sf, "documents")
    return authors.with_identity(documents, "text").select("doc_id", "identity")


@query("c6_entry_authors", _expected(BYLINES, "authors"))
def entry_authors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bylined(spark, sf, BYLINES, "byline")
    both = rows.withColumn("bylines", F.array(F.col("byline"), F.upper(F.lit(" ")), F.col("byline")))
    return authors.entry_authors(both).select("doc_id", joined("authors").alias("authors"))


# ---- sources ------------------------------------------------------------------------------------
@query(
    "a1_task_feed_source",
    """SELECT page_id AS task_id, page_id % 3 AS execution_id, concat('j', page_id) AS job_id, CAST(i AS BIGINT) AS feed_index,
              page_id * 10 + i AS feed_id, concat(url, '/', i) AS feed_url, epoch_us(TIMESTAMP '2024-01-01 10:00:00') AS requested_us
       FROM {pages}, (VALUES (0), (1)) v(i) WHERE page_id % 10 <> 0""",
)
def task_feed_source(spark: SparkSession, sf: str) -> DataFrame:
    [pages] = load(spark, sf, "pages")
    n = F.col("page_id")
    feeds = F.array(
        *[
            F.struct(
                (n * 10 + i).alias("feed_id"), F.concat(F.col("url"), F.lit(f"/{i}")).alias("feed_url"),
                F.lit(1).alias("fetchprotection"),
            )
            for i in (0, 1)
        ]
    )
    payload = F.to_json(
        F.struct(
            F.concat(F.lit("j"), n).alias("job_id"), F.lit("2024-01-01T10:00:00Z").alias("requested_at"),
            F.lit(True).alias("ingest"), feeds.alias("feeds"),
        )
    )
    leases = pages.select(
        n.alias("task_id"), (n % 3).alias("execution_id"), F.when(n % 10 == 0, F.lit("{broken")).otherwise(payload).alias("payload")
    )
    rows = readers.decode_feed_tasks(leases).where(~F.col("decode_error"))
    return rows.select(
        "task_id", "execution_id", "job_id", big("feed_index"), "feed_id", "feed_url", us("requested_at").alias("requested_us")
    )


@query(
    "a2_embedding_task_source",
    """SELECT doc_id AS task_id, 'v1' AS worker_version, CAST(i AS BIGINT) AS source_pos, doc_id * 10 + i AS id,
              CASE i WHEN 0 THEN text ELSE source END AS title, CASE i WHEN 0 THEN lang END AS summary
       FROM {documents}, (VALUES (0), (1)) v(i)""",
)
def embedding_task_source(spark: SparkSession, sf: str) -> DataFrame:
    [documents] = load(spark, sf, "documents")
    n, none = F.col("doc_id"), F.lit(None).cast("string")
    items = F.array(
        F.struct((n * 10).alias("id"), F.col("text").alias("title"), F.col("lang").alias("summary"), F.lit("u").alias("url")),
        F.struct((n * 10 + 1).alias("id"), F.col("source").alias("title"), none.alias("summary"), F.lit("u").alias("url")),
    )
    payload = F.to_json(F.struct(F.lit("j").alias("job_id"), F.lit("v1").alias("worker_version"), items.alias("sources")))
    rows = readers.decode_embedding_tasks(documents.select(n.alias("task_id"), payload.alias("payload")))
    return rows.select("task_id", "worker_version", big("source_pos"), "id", "title", "summary")


def _xml(c: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(escaped, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


DIALECTS = ("rss", "atom", "rdf", "prefixed", "json", "western")


def feed_bodies(pages: DataFrame) -> DataFrame:
    """Every page as a landed feed of two entries in each of six dialects, as bytes.

    RSS 2.0 (which may name a feed element in its title), Atom behind a long comment, RSS 1.0 with prefixes of its own,
    Atom with every element prefixed and XHTML content, JSON Feed, and RSS 2.0 in a Western one-byte encoding where the
    page's characters allow it.
    """
    n, url, html = F.col("page_id"), _xml(F.col("url")), _xml(F.col("html"))
    lit = F.lit
    at = F.timestamp_seconds(lit(1704067200) + n * 3600)
    rss_date = F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    iso_date = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def rss(declaration: str, title: Column) -> Column:
        return F.concat(
            lit(declaration + '<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>'),
            F.when(n % 4 == 0, lit("<![CDATA[the <feed > element]]>")).otherwise(lit("c")), lit("</title><item><title>"), title,
            lit("</title><link>"), url, lit("</link><description>"), html, lit("</description><pubDate>"), rss_date,
            lit('</pubDate><dc:creator>Ann Lee</dc:creator><media:thumbnail url="'), url,
            lit('.png"/></item><item><title>second</title><link>'), url, lit("/2</link></item></channel></rss>"),
        )

    atom = F.concat(
        lit('<?xml version="1.0"?><!-- '), F.repeat(lit("long "), lit(600)),
        lit('--><feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/"><entry><title>'),
        n.cast("string"), lit('</title><link href="'), url, lit('" rel="alternate"/><summary>'), html,
        lit("</summary><updated>"), iso_date, lit('</updated><author><name>Ann Lee</name></author><media:group><media:thumbnail url="'), url,
        lit('.png"/></media:group></entry><entry><title>second</title><link href="'), url, lit('/2"/></entry></feed>'),
    )
    rdf = F.concat(
        lit('<?xml version="1.0"?><!DOCTYPE r:RDF><r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" '
            'xmlns:d="http://purl.org/dc/elements/1.1/" xmlns:dc="http://search.yahoo.com/mrss/"><channel><title>c</title></channel><item r:about="1"><title>'),
        n.cast("string"), lit("</title><link>"), url, lit("</link><description>"), html, lit("</description><d:date>"), iso_date,
        lit('</d:date><d:creator>Ann Lee</d:creator><dc:thumbnail url="'), url,
        lit('.png"/></item><item><title>second</title><link>'), url, lit("/2</link></item></r:RDF>"),
    )
    prefixed = F.concat(
        lit('<a:feed xmlns:a="http://www.w3.org/2005/Atom" xmlns:m="http://search.yahoo.com/mrss/" xmlns:h="http://www.w3.org/1999/xhtml"><a:entry><a:title>'),
        n.cast("string"), lit('</a:title><a:link href="'), url, lit('"/><a:content type="xhtml"><h:div><h:p>'), html,
        lit("</h:p></h:div></a:content><a:updated>"), iso_date, lit('</a:updated><a:author><a:name>Ann Lee</a:name></a:author><m:thumbnail url="'), url,
        lit('.png"/></a:entry><a:entry><a:title>second</a:title><a:link href="'), url, lit('/2"/></a:entry></a:feed>'),
    )
    plain = F.struct(
        F.col("url").alias("url"), n.cast("string").alias("title"), F.col("html").alias("content_html"), iso_date.alias("date_modified"),
        F.array(F.struct(lit("Ann Lee").alias("name"))).alias("authors"), F.concat(F.col("url"), lit(".png")).alias("image"),
    )
    none = lit(None)
    second = F.struct(
        F.concat(F.col("url"), lit("/2")).alias("url"), lit("second").alias("title"), none.cast("string").alias("content_html"),
        none.cast("string").alias("date_modified"), none.cast("array<struct<name: string>>").alias("authors"), none.cast("string").alias("image"),
    )
    json = F.to_json(F.struct(lit("https://jsonfeed.org/version/1.1").alias("version"), F.array(plain, second).alias("items")))
    western = rss('<?xml version="1.0" encoding="ISO-8859-1"?>', F.concat(n.cast("string"), lit(" caf\u00e9")))
    one_byte = F.rlike(western, lit(r"^[\x00-\x7f\xa0-\xff]*$"))
    in_utf_8 = F.encode(F.replace(western, lit("ISO-8859-1"), lit("UTF-8")), "UTF-8")
    bodies = [F.encode(x, "UTF-8") for x in (rss('<?xml version="1.0"?>', n.cast("string")), atom, rdf, prefixed, json)]
    bodies.append(F.when(one_byte, F.encode(F.when(one_byte, western), "ISO-8859-1")).otherwise(in_utf_8))
    each = F.array(*[F.struct(lit(d).alias("dialect"), b.alias("content")) for d, b in zip(DIALECTS, bodies, strict=True)])
    return pages.select("page_id", F.explode(each).alias("d")).select("page_id", "d.dialect", "d.content")


_ESCAPED = r"""replace(replace(replace(regexp_replace(html, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"""


@query(
    "a3_feed_document_source",
    f"""SELECT page_id, dialect, CAST(i AS BIGINT) AS entry_pos, CASE i WHEN 0 THEN url ELSE concat(url, '/2') END AS link,
               CASE WHEN i = 1 THEN 'second' WHEN dialect = 'western' THEN concat(page_id, ' café') ELSE CAST(page_id AS VARCHAR) END AS title,
               CASE WHEN i = 0 AND dialect NOT IN ('prefixed', 'json') THEN length(html) END AS summary_chars,
               CASE WHEN i = 0 AND dialect = 'json' THEN md5(html)
                    WHEN i = 0 AND dialect = 'prefixed' THEN md5('<div><p>' || {_ESCAPED} || '</p></div>') END AS content_md5,
               CASE i WHEN 0 THEN 1704067200000000 + page_id * 3600000000 END AS at_us,
               CASE i WHEN 0 THEN 'Ann Lee' ELSE '' END AS authors,
               CASE WHEN i = 0 THEN concat(url, '.png') END AS thumbnail
        FROM {{pages}}, (VALUES (0), (1)) v(i), (VALUES {", ".join(f"('{d}')" for d in DIALECTS)}) d(dialect)""",
)
def feed_document_source(spark: SparkSession, sf: str) -> DataFrame:
    [pages] = load(spark, sf, "pages")
    bodies = feed_bodies(pages).select("page_id", "dialect", decode_bytes(F.col("content")).alias("body"))
    rows = readers.parse_feeds(bodies)
    return rows.select(
        "page_id", "dialect", big("entry_pos"), F.get("links", F.lit(0)).alias("link"), "title",
        F.length("summary").cast("bigint").alias("summary_chars"), F.md5("content_body").alias("content_md5"),
        us(F.coalesce("published", "updated")).alias("at_us"), joined("authors").alias("authors"),
        F.get(F.flatten(F.transform("media", lambda m: m.thumbnails)), F.lit(0)).alias("thumbnail"),
    )


@query(
    "a4_status_source",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 5 = 1 THEN 'error' ELSE 'loaded' END AS load,
              CASE WHEN event_id % 5 > 1 THEN 'idle' END AS phase, CASE WHEN event_id % 5 > 1 THEN event_id END AS completed_task_count,
              CASE WHEN event_id % 5 > 1 THEN epoch_us(date_trunc('second', ts)) END AS updated_us
       FROM {events}""",
)
def status_source(spark: SparkSession, sf: str) -> DataFrame:
    [events] = load(spark, sf, "events")
    n = F.col("event_id")
    document = F.to_json(
        F.struct(
            F.lit("1.0.0").alias("app_version"), F.lit("rss").alias("worker_type"), F.lit("idle").alias("phase"),
            n.alias("completed_task_count"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_updated_at"),
        )
    )
    text = F.when(n % 5 == 1, F.left(document, F.lit(30))).when(n % 5 > 1, document)
    rows = readers.decode_status(events.select("event_id", text.alias("value")))
    good = F.col("load") == "loaded"
    return rows.select(
        "event_id", "load", F.when(good, F.col("phase")).alias("phase"),
        F.when(good, F.col("completed_task_count")).alias("completed_task_count"),
        F.when(good, us("last_updated_at")).alias("updated_us"),
    )
