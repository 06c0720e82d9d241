"""Canonical JSON and HMAC signatures.

The canonical text needs shortest number text, which Spark does not print: a small Arrow UDF over JSON text.
The signature is two nested SHA-256 built-ins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

PRESERVE, EXPONENT_SIGN = "preserve", "exponent_sign"
HELD_ROWS, HELD_BYTES = 1_000, 1 << 20  # rows and bytes of text that a worker holds as Python values at a time


class _Raw(str):
    """Number text that is printed as it is."""


def number_text(value: float) -> str:
    """Shortest text of a double: plain between 1e-5 and 1e16, else mantissa and bare exponent (1e-7, 1e20)."""
    sign, digits, exponent = re.fullmatch(r"(-?)([\d.]+)(?:e([+-]?\d+))?", repr(value)).groups()
    whole, _, fraction = digits.partition(".")
    fraction = fraction if fraction != "0" or exponent else ""
    figures = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + fraction) - len(figures))
    figures = figures.rstrip("0") or "0"
    if figures == "0":
        return sign + "0.0"
    if -5 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    if 0 < point <= 16:
        padded = figures.ljust(point, "0")
        return f"{sign}{padded[:point]}.{padded[point:] or '0'}"
    mantissa = figures[0] + ("." + figures[1:] if len(figures) > 1 else "")
    return f"{sign}{mantissa}e{point - 1}"


def python_exponent(text: str) -> str:
    """1e-7 -> 1e-07, 1e20 -> 1e+20; text without an exponent is unchanged."""
    mantissa, mark, exponent = text.partition("e")
    if not mark or not exponent.lstrip("+-"):
        return text
    sign = "-" if exponent.startswith("-") else "+"
    return f"{mantissa}e{sign}{exponent.lstrip('+-').zfill(2)}"


def _string(text: str) -> str:
    return '"' + "\x7f".join(json.dumps(part)[1:-1] for part in text.split("\x7f")) + '"'


def _render(value: object) -> str:
    if isinstance(value, _Raw):
        return value
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_string(k)}:{_render(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_render, value)) + "]"
    return json.dumps(value)


def canonical_text(text: str, mode: str = PRESERVE) -> str:
    """Canonical form of one JSON text: keys sorted, no spaces, ASCII only, shortest numbers."""
    layout = python_exponent if mode == EXPONENT_SIGN else str

    def real(token: str) -> _Raw:
        return _Raw(layout(number_text(float(token))))

    def whole(token: str) -> _Raw:
        fits = -(2**63) <= int(token) < 2**64 and token != "-0"
        return _Raw(token) if fits else real(token)

    return _render(json.loads(text, parse_float=real, parse_int=whole))


def held_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The array in consecutive slices of at most HELD_ROWS rows and HELD_BYTES bytes; a longer text stands alone."""
    sizes, start, held = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0, 0
    for at, size in enumerate(sizes):
        if at > start and (at - start >= HELD_ROWS or held + size > HELD_BYTES):
            yield texts.slice(start, at - start)
            start, held = at, 0
        held += size
    yield texts.slice(start)


def canonical_json(payload: Column, mode: str = PRESERVE) -> Column:
    """Canonical text of a JSON text column. The only Python here; values pass as Arrow batches.

    A batch may hold thousands of long texts, so it is worked off in slices, each sent back before the next.
    """

    @arrow_udf("string")
    def canonical(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in held_slices(batch):
                yield pa.array([None if t is None else canonical_text(t, mode) for t in texts.to_pylist()], pa.string())

    return canonical(payload)


# ---- fixed values: HMAC pads over the 64 hex digits of the key --------------------------------------
_HEX = "0123456789abcdef"
_INNER = "".join(chr(ord(c) ^ 0x36) for c in _HEX)
_OUTER = "".join(chr(ord(c) ^ 0x5C) for c in _HEX)
# -------------------------------------------------------------------------------------------------


def signing_secret(api_key: Column) -> Column:
    """The HMAC key of an API key: hex SHA-256, exactly one 64-byte hash block of plain ASCII."""
    return F.sha2(api_key, 256)


def hmac_sha256(secret: Column, message: Column) -> Column:
    """Hex HMAC-SHA256. A 64-digit hex key fills the hash block, so both pads are a ``translate``."""
    # translate drops what maps to NUL, so the one such digit is put in behind it
    padded = F.replace(F.translate(secret, _HEX, _INNER.replace("\0", "6")), F.lit("6"), F.lit("\0"))
    inner = F.sha2(F.concat(padded, message), 256)
    return F.sha2(F.concat(F.encode(F.translate(secret, _HEX, _OUTER), "UTF-8"), F.unhex(inner)), 256)
