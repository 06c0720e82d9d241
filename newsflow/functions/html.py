"""HTML to text, entities and inline images, over whole texts inside the JVM.

The helpers with a ``_sql`` ending return SQL text (see ``fragments``); the others take a column name and
return a Column.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.fragments import group, let, lit, matches, non_empty, over, sub, when
from newsflow.functions.text import (
    ASCII_LOWER,
    ASCII_UPPER,
    BOUNDARY_QUOTES,
    IMAGE_URL,
    WHITE_SPACE,
    WHITE_SPACE_CLASS,
)

# ---- fixed values: tags that separate words -------------------------------------------------------
BREAK_TAGS = [
    "article", "aside", "blockquote", "br", "div", "figcaption", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "img", "li", "ol", "p", "section", "tr", "ul",
]
# -------------------------------------------------------------------------------------------------

# Unicode non-characters: they cannot occur in interchanged text, so they can mark tag ends.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def strip_tags_sql(c: str) -> str:
    """Drop tags; a word-separating tag leaves a space; an unclosed tag swallows the rest.

    Up to the last '>' every tag that opens also closes, so the patterns there never scan for a missing
    end; the part behind the last '>' can hold only one unclosed tag.
    """
    names = "|".join(sorted(BREAK_TAGS, key=len, reverse=True))
    breaking = rf"(?i){_OPEN}/*!*\?*(?:{names})(?![A-Za-z0-9-])[^{_CLOSE}]*{_CLOSE}"

    def closed(text: str) -> str:
        bare = f"translate({text}, {lit(_OPEN + _CLOSE)}, '')"
        marked = sub(bare, r"<([A-Za-z/!?][^>]*)>", f"{_OPEN}$1{_CLOSE}")
        return sub(sub(marked, breaking, " "), f"{_OPEN}[^{_CLOSE}]*{_CLOSE}", "")

    def both(text: str) -> str:
        return let(
            f"substring_index({text}, '>', -1)",
            lambda tail: (
                f"concat({closed(f'left({text}, length({text}) - length({tail}))')}, "
                f"{sub(tail, '(?s)<[A-Za-z/!?].*', '')})"
            ),
        )

    return let(c, lambda text: when(f"contains({text}, '<')", both(text), text))


@lru_cache(maxsize=1)
def _entity_json() -> str:
    return json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")})


def _character_sql(name: str) -> str:
    """Text of one entity name ('amp', '#233', '#xE9'); NULL when it names nothing."""
    hexadecimal = f"substring(lower({name}), 2, 1) = 'x'"

    def code_point(digits: str) -> str:
        number = when(hexadecimal, f"CAST(conv({digits}, 16, 10) AS BIGINT)", f"CAST({digits} AS BIGINT)")
        return when(f"length({digits}) <= 7", when(f"{digits} = ''", "0L", number))

    def encode(cp: str) -> str:
        valid = f"{cp} <= {0x10FFFF} AND NOT {cp} BETWEEN {0xD800} AND {0xDFFF}"
        return when(valid, f"decode(unhex(lpad(hex({cp}), 8, '0')), 'UTF-32')")

    numeric = let(let(group(name, "^#[xX]?0*([0-9A-Fa-f]*)$", 1), code_point), encode)
    common = f"CASE {name} WHEN 'amp' THEN '&' WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'quot' THEN '\"' END"
    named = f"coalesce({common}, try_element_at(from_json({lit(_entity_json())}, 'map<string,string>'), {name}))"
    return when(f"startswith({name}, '#')", numeric, named)


def decode_entities_sql(c: str) -> str:
    """Replace every ``&name;``, ``&#n;`` and ``&#xh;``; unknown ones stay as they are."""

    def piece(p: str) -> str:
        def replaced(name: str) -> str:
            known = let(
                _character_sql(name),
                lambda v: when(f"{v} IS NULL", f"concat('&', {p})", f"concat({v}, substr({p}, length({name}) + 2))"),
            )
            return when(f"{name} = ''", f"concat('&', {p})", known)

        return let(group(p, "^(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", 1), replaced)

    def rejoined(text: str) -> str:
        return let(
            f"split({text}, '&')",
            lambda parts: (
                f"concat({parts}[0], array_join({over('transform', f'slice({parts}, 2, size({parts}))', piece)}, ''))"
            ),
        )

    return let(c, lambda text: when(f"contains({text}, '&')", rejoined(text), text))


def html_to_text_sql(c: str) -> str:
    """Readable text of an HTML fragment: tags out, entities decoded at most twice, NULL when blank."""

    def decode_round(text: str, then: Callable[[str], str]) -> str:
        again = let(
            decode_entities_sql(text), lambda d: when(f"{d} = {text}", text, let(strip_tags_sql(d), then))
        )
        return when(f"contains({text}, '&')", again, text)

    plain = let(strip_tags_sql(c), lambda t: decode_round(t, lambda u: decode_round(u, lambda v: v)))
    runs = f"{WHITE_SPACE_CLASS}{{2,}}|[{WHITE_SPACE_CLASS}&&[^ ]]"
    return non_empty(f"btrim({sub(plain, runs, ' ')}, {lit(BOUNDARY_QUOTES + WHITE_SPACE)})")


def inline_image_sql(c: str) -> str:
    """URL of the first ``src=`` behind the first ``<img`` when it is quoted and looks like an image."""

    def quoted(html: str, src: str) -> str:
        value = let(
            f"substr({html}, {src} + 4, 1)",
            lambda quote: when(
                f"""{quote} IN ('"', "'")""",
                let(
                    f"position({quote}, {html}, {src} + 5)",
                    lambda end: when(
                        f"{end} > 0",
                        non_empty(f"btrim(substr({html}, {src} + 5, {end} - {src} - 5), {lit(WHITE_SPACE)})"),
                    ),
                ),
            ),
        )
        return when(f"{src} > 0", value)

    def found(html: str) -> str:
        lowered = f"translate({html}, '{ASCII_UPPER}', '{ASCII_LOWER}')"
        return let(
            f"position('<img', {lowered})",
            lambda img: when(
                f"{img} > 0", let(f"position('src=', {lowered}, {img})", lambda src: quoted(html, src))
            ),
        )

    raw = let(c, lambda html: when(f"contains({html}, '=')", found(html)))
    return let(decode_entities_sql(raw), lambda url: when(matches(url, IMAGE_URL), url))


def strip_tags(column: str) -> Column:
    return F.expr(strip_tags_sql(column))


def decode_entities(column: str) -> Column:
    return F.expr(decode_entities_sql(column))


def html_to_text(column: str) -> Column:
    return F.expr(html_to_text_sql(column))


def inline_image(column: str) -> Column:
    return F.expr(inline_image_sql(column))
