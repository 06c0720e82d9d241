"""SQL text helpers for expressions too large to assemble call by call.

Every Column operation is a round trip to the JVM; a byline pipeline needs thousands. As SQL text the same
expression is parsed in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

_names = count()


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(value: str, words: Iterable[str]) -> str:
    return f"({value} IN ({', '.join(map(lit, words))}))"


def matches(value: str, pattern: str) -> str:
    return f"rlike({value}, {lit(pattern)})"


def sub(value: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({value}, {lit(pattern)}, {lit(replacement)})"


def group(value: str, pattern: str, index: int) -> str:
    return f"regexp_extract({value}, {lit(pattern)}, {index})"


def over(function: str, array: str, body: Callable[..., str], indexed: bool = False) -> str:
    """transform / filter / exists / forall over an array."""
    n = next(_names)
    if indexed:
        return f"{function}({array}, (v{n}, i{n}) -> {body(f'v{n}', f'i{n}')})"
    return f"{function}({array}, v{n} -> {body(f'v{n}')})"


def let(value: str, body: Callable[[str], str]) -> str:
    return over("transform", f"array({value})", body) + "[0]"


def when(condition: str, value: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE {otherwise} END"


def non_empty(value: str) -> str:
    """The value, NULL when it is the empty text. nullif() would evaluate a computed value twice."""
    return let(value, lambda t: when(f"{t} != ''", t))
