"""Text columns: whitespace, quotes, image URLs, hosts, truncation, dates.

All of it is built-in expressions, so whole texts never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
# Unicode White_Space, as characters (for trim) and as a Java regex class.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITE_SPACE_CLASS = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Characters removed around a summary.
BOUNDARY_QUOTES = "\"'`´«»“”„‟‘’‚‹›「」『』〝〞"
IMAGE_URL = r"(?i)^(?:https?:)?//|\.(?:jpe?g|png|webp|gif|avif)"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
# -------------------------------------------------------------------------------------------------

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    Plain reuse of a Column repeats its whole expression; over a chain of rewriting steps that grows
    exponentially. Binding it as a lambda variable keeps the tree linear.
    """
    return F.transform(F.array(value), body)[0]


def non_empty_text(c: Column) -> Column:
    """The value, NULL when it is the empty text. nullif() would evaluate a computed value twice."""
    return let(c, lambda t: F.when(t != "", t))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def required_text(c: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return non_empty_text(trim_ws(c))


def collapse_ws(c: Column) -> Column:
    """Runs of white space to one space; single spaces are left alone, so most words cost no replacement."""
    return F.btrim(F.regexp_replace(c, f"{WHITE_SPACE_CLASS}{{2,}}|[{WHITE_SPACE_CLASS}&&[^ ]]", " "))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; lower() would also fold other letters and may change the length."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def trim_quotes(c: Column) -> Column:
    """Strip nested quotes and whitespace from both ends, in any order, until none is left."""
    return F.btrim(c, F.lit(BOUNDARY_QUOTES + WHITE_SPACE))


def looks_like_image(c: Column) -> Column:
    return F.rlike(c, F.lit(IMAGE_URL))


def host_of(c: Column) -> Column:
    """Lower-case host of a URL or bare host, percent signs decoded and in ASCII form; NULL when there is none.

    The whole text must be a URL or a host with an optional port, and the host free of characters no host holds.
    """
    found = F.regexp_extract(
        trim_ws(c),
        r"^(?![A-Za-z][A-Za-z0-9+.\-]*://(?:[/?#]|$))(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#\\@\s]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#\\:@\s\[\]]+)(?::[0-9]*)?(?:[/?#\\].*)?$",
        1,
    )

    def ascii_form(host: Column) -> Column:
        plain = F.rlike(host, F.lit(r"^[\x21-\x7e]+$"))
        return F.when(plain, host).otherwise(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host))

    def checked(host: Column) -> Column:
        return F.when(~F.rlike(host, F.lit(r"[\x00-\x20#%/<>?@\\^|]")), F.lower(host))

    decoded = F.when(F.contains(found, F.lit("%")), F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B")))).otherwise(found)
    return non_empty_text(let(let(decoded, ascii_form), checked))


def truncate_chars(c: Column, limit: int) -> Column:
    return F.left(c, F.lit(limit))


def one_line_detail(c: Column) -> Column:
    """First line of an error text, collapsed, at most 140 characters; NULL when blank."""
    line = non_empty_text(collapse_ws(F.split(c, r"\r?\n", 2)[0]))
    return let(
        line, lambda t: F.when(F.length(t) > 140, F.concat(F.left(t, F.lit(137)), F.lit("..."))).otherwise(t)
    )


def redact_secret(c: Column) -> Column:
    return F.when(F.length(c) <= 8, F.lit("********")).otherwise(
        F.concat(F.left(c, F.lit(4)), F.lit("***"), F.right(c, F.lit(4)))
    )


def http_date(c: Column) -> Column:
    """Timestamp -> HTTP date header text."""
    return F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def parse_http_date(c: Column) -> Column:
    """HTTP / RSS date text -> timestamp; the weekday is optional, bad text gives NULL."""

    def parsed(t: Column) -> Column:
        return F.coalesce(
            F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")),
            F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss z")),
        )

    return let(F.regexp_replace(trim_ws(c), r"^[A-Za-z]{3,9},\s*", ""), parsed)


def rfc3339(c: Column) -> Column:
    """Timestamp -> RFC 3339 text in UTC with 0, 3 or 6 fraction digits."""
    micros = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    return (
        F.when(micros == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(micros % 1000 == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )
