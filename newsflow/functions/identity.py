"""Author identity key: compatibility-decomposed, accents dropped, lower case, other signs to one space.

Spark has no normalisation built-in. The folding table is derived once on the driver from the Unicode
database; the rows themselves are folded by ``translate`` in the JVM.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.fragments import lit, matches, non_empty, sub, when
from newsflow.functions.text import ASCII_LOWER, ASCII_UPPER, let, non_empty_text


NOT_ASCII = r"[^\x00-\x7F]"


def fold_character(character: str) -> str:
    """The key text of one character; signs become a space, combining marks vanish."""
    out = []
    for part in unicodedata.normalize("NFKD", character):
        if unicodedata.category(part).startswith("M"):
            continue
        for low in part.lower():
            out.append(low if low.isascii() and low.isalnum() else " ")
    return "".join(out)


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str]]:
    singles, targets, expansions = [], [], {}
    for code in range(0x80, 0x30000):
        character = chr(code)
        if not unicodedata.decomposition(character):
            continue
        folded = fold_character(character)
        if not folded.strip():
            continue
        if len(folded) == 1:
            singles.append(character)
            targets.append(folded)
        else:
            expansions[character] = folded
    return "".join(singles), "".join(targets), expansions


def _character_class(characters: str) -> str:
    """Regex class of the given characters, neighbours joined to ranges."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def _squeeze(c: Column) -> Column:
    return non_empty_text(F.btrim(F.regexp_replace(c, "[^0-9a-z]+", " ")))


def identity_key(c: Column) -> Column:
    """NULL when nothing alphanumeric is left."""
    singles, targets, expansions = _tables()
    table = F.from_json(F.lit(json.dumps(expansions)), "map<string,string>")
    expandable = _character_class("".join(expansions))

    def fold(text: Column) -> Column:
        spread = F.array_join(
            F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
        )
        expanded = F.when(F.rlike(text, F.lit(expandable)), spread).otherwise(text)
        unmarked = F.regexp_replace(expanded, r"\p{M}+", "")
        full = F.translate(unmarked, ASCII_UPPER + singles, ASCII_LOWER + targets)
        return F.when(F.rlike(text, F.lit(NOT_ASCII)), full).otherwise(F.lower(text))

    return _squeeze(let(c, fold))


@lru_cache(maxsize=8)
def _word_tables(words: tuple[str, ...]) -> tuple[str, str, str]:
    singles, targets, expansions = _tables()
    inside = {ch: text for ch, text in expansions.items() if any(text in w for w in words)}
    outside = "".join(ch for ch in expansions if ch not in inside)
    return (
        json.dumps(list(inside.items())),
        ASCII_UPPER + singles + outside,
        ASCII_LOWER + targets + "0" * len(outside),
    )


def word_key_sql(c: str, words: tuple[str, ...]) -> str:
    """identity_key for membership tests against ``words``: same NULLs, same value where it is a listed word.

    A character that spells several letters matters only if those letters occur in a listed word; all the
    others may become any one sign, so the large table is not needed for every word of every byline.
    """
    pairs, source, target = _word_tables(words)
    table = f"from_json({lit(pairs)}, 'array<array<string>>')"
    spread = f"aggregate({table}, {c}, (text, pair) -> replace(text, pair[0], pair[1]))"
    folded = f"translate({sub(spread, chr(92) + 'p{M}+', '')}, {lit(source)}, {lit(target)})"
    key = when(matches(c, NOT_ASCII), folded, f"lower({c})")
    return non_empty(f"btrim({sub(key, '[^0-9a-z]+', ' ')})")
