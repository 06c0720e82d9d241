"""Fetch planning and outcome resolution over the ``feeds`` and ``fetch_log`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.text import host_of, http_date, parse_http_date
from newsflow.plans.scan import SEGMENT, time_segment

# ---- fixed values -------------------------------------------------------------------------------
BLOCKED, SIMPLE, ADVANCED = 0, 1, 2
RETRY_COUNT = 1
BACKOFF_MS = 250
TRANSIENT_STATUS = [408, 429, 500, 502, 503, 504]
TRANSIENT_ERRORS = ["timeout", "connect", "body", "request"]
DEFAULT_HEADERS = {
    "User-Agent": "Mozilla/5.0 (X11; Linux x86_64; rv:140.0) Gecko/20100101 Firefox/140.0",
    "Accept-Language": "fr-FR,fr;q=0.9,en-US;q=0.7,en;q=0.6",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,application/rss+xml,application/atom+xml;"
    "q=0.8,*/*;q=0.7",
    "Accept-Encoding": "gzip, deflate, br",
}
BLOCKED_MESSAGE = "Blocked by fetch protection"
NO_STRATEGY_MESSAGE = "No fetch strategy available"
# -------------------------------------------------------------------------------------------------


def strategies(protection: Column, ingest: Column) -> Column:
    """Ordered strategies of a feed; a blocked feed keeps only the blocked marker."""
    both = F.array(F.lit(SIMPLE), F.lit(ADVANCED))
    return (
        F.when(protection == BLOCKED, F.array(F.lit(BLOCKED)))
        .when(~ingest | (protection == SIMPLE), both)
        .when(protection == ADVANCED, F.reverse(both))
        .otherwise(F.array(protection.cast("int")))
    )


def plan_attempts(feeds: DataFrame, retry_count: int = RETRY_COUNT) -> DataFrame:
    """Feeds -> one row per possible attempt: strategy order, strategy, attempt number, back-off before it."""
    ingest = F.col("ingest") if "ingest" in feeds.columns else F.lit(True)
    ordered = feeds.select("*", F.posexplode(strategies(F.col("fetchprotection"), ingest)).alias("strategy_pos", "strategy"))
    tries = F.when(F.col("strategy") == BLOCKED, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(retry_count)))
    return ordered.withColumn("attempt_no", F.explode(tries)).withColumn(
        "backoff_ms", F.col("attempt_no") * BACKOFF_MS
    )


def request_headers(strategy: Column, host: Column, etag: Column, last_update: Column) -> Column:
    """Header map of one request; absent headers are left out."""
    fixed = F.create_map(*[F.lit(x) for pair in DEFAULT_HEADERS.items() for x in pair])
    advanced = strategy == ADVANCED
    extra = F.create_map(
        F.lit("Host"), F.when(advanced, host),
        F.lit("Origin"), F.when(advanced, F.concat(F.lit("https://"), host)),
        F.lit("Referer"), F.when(advanced, F.concat(F.lit("https://"), host, F.lit("/"))),
        F.lit("If-None-Match"), etag,
        F.lit("If-Modified-Since"), http_date(last_update),
    )
    return F.map_concat(fixed, F.map_filter(extra, lambda _, v: v.isNotNull()))


def plan_requests(feeds: DataFrame, retry_count: int = RETRY_COUNT) -> DataFrame:
    """Attempts with their request headers; blocked feeds send nothing."""
    attempts = plan_attempts(feeds, retry_count).where(F.col("strategy") != BLOCKED)
    headers = request_headers(
        F.col("strategy"), F.col("host_header"), F.col("etag"), F.col("last_update").cast("timestamp")
    )
    return attempts.withColumn("headers", headers)


def is_network_error(error_kind: Column) -> Column:
    return F.coalesce(error_kind.isin(TRANSIENT_ERRORS), F.lit(False))


def is_auth_error(status_code: Column, error_kind: Column) -> Column:
    return F.coalesce(status_code.isin(401, 403), F.lit(False)) | F.coalesce(error_kind == "auth", F.lit(False))


def attempt_outcome(status_code: Column, error_kind: Column) -> Column:
    """success | not_modified | transient | permanent."""
    return (
        F.when(status_code == 304, "not_modified")
        .when(status_code.isin(TRANSIENT_STATUS), "transient")
        .when(status_code.isNotNull() & ~status_code.between(200, 299), "permanent")
        .when(is_network_error(error_kind), "transient")
        .when(error_kind.isNotNull() | status_code.isNull(), "permanent")
        .otherwise("success")
    )


def classify_attempts(fetch_log: DataFrame) -> DataFrame:
    kind = F.col("error_kind") if "error_kind" in fetch_log.columns else F.lit(None).cast("string")
    return fetch_log.withColumn("outcome", attempt_outcome(F.col("status_code"), kind))


def flag_errors(fetch_log: DataFrame) -> DataFrame:
    """Network (retry) and authentication (stop) flags of every attempt."""
    kind = F.col("error_kind") if "error_kind" in fetch_log.columns else F.lit(None).cast("string")
    return fetch_log.withColumns(
        {"network_error": is_network_error(kind), "auth_error": is_auth_error(F.col("status_code"), kind)}
    )


def resolve_outcomes(feeds: DataFrame, attempts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per feed slot the first good attempt, else the last bad one; a slot without attempts has outcome NULL.

    One partially aggregated groupBy: a feed with very many attempts is reduced before the shuffle.
    """
    position = F.struct(*order)
    carried = [c for c in attempts.columns if c not in keys]
    row = F.struct(*carried)
    good = F.col("outcome").isin("success", "not_modified")
    best = attempts.groupBy(*keys).agg(
        F.min_by(row, F.when(good, position)).alias("__good"), F.max_by(row, F.when(~good, position)).alias("__bad")
    )
    chosen = best.select(*keys, F.coalesce("__good", "__bad").alias("attempt"))
    return feeds.join(chosen, keys, "left")


def shape_results(resolved: DataFrame) -> DataFrame:
    """Resolved feeds -> result rows (status, code, message, next etag and last update).

    ``resolved``: feed columns plus ``attempt`` with outcome, status_code, strategy, error, etag,
    last_modified and feed_updated. Success and not-modified take the response's etag even when absent;
    errors keep the feed's own.
    """
    a = F.col("attempt")
    blocked = F.col("fetchprotection") == BLOCKED
    status = F.when(blocked | a.isNull(), "error").otherwise(
        F.when(a.outcome.isin("success", "not_modified"), a.outcome).otherwise("error")
    )
    failed = F.col("status") == "error"
    modified = parse_http_date(a.last_modified)
    message = (
        F.when(blocked, F.lit(BLOCKED_MESSAGE))
        .when(a.isNull(), F.lit(NO_STRATEGY_MESSAGE))
        .when(F.col("status") == "error", a.error)
    )
    return resolved.withColumn("status", status).withColumns(
        {
            "status_code": F.when(~blocked, a.status_code),
            "error_message": message,
            "new_etag": F.when(failed, F.col("etag")).otherwise(a.etag),
            "new_last_update": F.when(failed, F.col("last_update"))
            .when(F.col("status") == "not_modified", modified)
            .otherwise(F.coalesce(modified, a.feed_updated)),
            "resolved_fetchprotection": F.when(blocked, F.lit(BLOCKED))
            .when(a.isNull(), F.col("fetchprotection").cast("int"))
            .otherwise(a.strategy.cast("int")),
        }
    ).drop("attempt")


def refresh_feed_state(feeds: DataFrame, results: DataFrame, order: list[str]) -> DataFrame:
    """Feeds with etag / last_update taken from their newest result; feeds without results are unchanged."""
    newest = results.groupBy("feed_id").agg(
        F.max_by(F.struct("new_etag", "new_last_update"), F.struct(*order)).alias("__new")
    )
    new = F.col("__new")
    return (
        feeds.join(newest, "feed_id", "left")
        .withColumns(
            {
                "etag": F.when(new.isNull(), F.col("etag")).otherwise(new.new_etag),
                "last_update": F.when(new.isNull(), F.col("last_update")).otherwise(new.new_last_update),
            }
        )
        .drop("__new")
    )


def host_key(host_header: Column, feed_url: Column, feed_id: Column) -> Column:
    return F.coalesce(
        host_of(host_header),
        F.when(F.contains(feed_url, F.lit("://")), host_of(feed_url)),
        F.concat(F.lit("feed:"), feed_id.cast("string")),
    )


def with_host_key(feeds: DataFrame) -> DataFrame:
    return feeds.withColumn("host_key", host_key(F.col("host_header"), F.col("feed_url"), F.col("feed_id")))


def interval_us(requests_per_second: int) -> int:
    return 1000 // max(requests_per_second, 1) * 1000


def assign_rate_slots(
    requests: DataFrame,
    host: str = "host_key",
    arrival: str = "ts",
    order: str = "event_id",
    step_us: int = 100_000,
    segment_us: int = 3_600_000_000,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Reserve a slot per request: slot = max(arrival, previous slot of the host + step).

    Closed form: with i the request's number on its host, slot = i*step + max over j<=i of (arrival_j - j*step).
    Hosts are cut into time segments. A segment reports its count and local maximum; the scan over those
    summaries gives the number of earlier requests and the earlier maximum, so a hot host is spread over as
    many tasks as it has segments. ``carried`` (host, next_slot_us): hosts whose first free slot is already known.
    """
    base = requests.withColumns(
        {"__a": F.unix_micros(F.col(arrival)), SEGMENT: time_segment(F.col(arrival), segment_us)}
    )
    local = Window.partitionBy(host, SEGMENT).orderBy("__a", order)
    numbered = base.withColumn("__i", F.row_number().over(local).cast("bigint")).withColumn(
        "__lag", F.col("__a") - F.col("__i") * step_us
    )
    parts = numbered.groupBy(host, SEGMENT).agg(F.count("*").alias("__n"), F.max("__lag").alias("__m"))
    before = Window.partitionBy(host).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    carry = offset.select(
        host,
        SEGMENT,
        "__offset",
        F.max(F.col("__m") - F.col("__offset") * step_us).over(before).alias("__earlier"),
    )
    if carried is not None:
        # The first request's number is 1, so the slot before it stands for everything earlier.
        known = carried.select(F.col(host).alias("__host"), (F.col("next_slot_us") - step_us).alias("__known"))
        carry = carry.join(known, F.col(host).eqNullSafe(F.col("__host")), "left")
        carry = carry.select(host, SEGMENT, "__offset", F.greatest("__earlier", "__known").alias("__earlier"))
    number = F.col("__i") + F.col("__offset")
    peak = F.max("__lag").over(local.rowsBetween(Window.unboundedPreceding, 0))
    slot = number * step_us + F.greatest(peak - F.col("__offset") * step_us, F.col("__earlier"))
    return (
        numbered.join(carry, [host, SEGMENT], "left")
        .withColumn("slot_us", slot)
        .withColumn("wait_us", F.col("slot_us") - F.col("__a"))
        .select(*requests.columns, "slot_us", "wait_us")
    )


def next_admissions(
    pending: DataFrame,
    active: DataFrame,
    order: list[str],
    per_host: int = 3,
    free_slots: int = 5,
    host: str = "host_key",
) -> DataFrame:
    """The next feeds to start: hosts in key order, each first-in-first-out up to its free places.

    ``active``: one row per running feed with its host. The per-host rank is cut before the shuffle.
    """
    per_host = max(per_host, 1)
    ranked = pending.withColumn("host_rank", F.row_number().over(Window.partitionBy(host).orderBy(*order)))
    ranked = ranked.where(F.col("host_rank") <= per_host)
    counts = active.groupBy(host).agg(F.count("*").alias("__active"))
    room = F.lit(per_host) - F.coalesce("__active", F.lit(0))
    return (
        ranked.join(counts, host, "left")
        .where(F.col("host_rank") <= room)
        .drop("__active")
        .orderBy(host, *order)
        .limit(free_slots)
    )
