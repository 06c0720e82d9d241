"""Running values per key that survive a hot key.

A window over one key puts the whole key into one task. Here a key is cut into segments (time buckets or
position ranges). Each segment is summarised with a partially aggregated groupBy, the small summaries are
scanned per key, and the value carried into a segment is joined back; the row-level windows then run per
(key, segment). The result equals the plain window over the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "__segment"
HOUR_US = 3_600_000_000


def time_segment(ts: Column, width_us: int = HOUR_US) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(width_us)).cast("bigint")


def position_segment(position: Column, width: int = 65_536) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    *,
    last: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    peak: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns.

    last      newest non-NULL value up to and including the row
    previous  newest non-NULL value before the row
    total     running sum including the row
    peak      running maximum including the row

    ``order`` must be unique within a key and ``segment`` must never decrease along it. NULL is a key like any other.
    Totals of whole numbers stop at the ends of their range instead of failing.
    """
    kinds = {"last": last or {}, "previous": previous or {}, "total": total or {}, "peak": peak or {}}
    inputs = {f"__in_{name}": expr for group in kinds.values() for name, expr in group.items()}
    kind_of = {name: kind for kind, group in kinds.items() for name in group}
    rows = df.withColumns({SEGMENT: segment, **inputs})

    position = F.struct(*order)
    summaries = []
    for name, kind in kind_of.items():
        value = F.col(f"__in_{name}")
        if kind in ("last", "previous"):
            # max_by skips rows whose ordering value is NULL, so rows without a value do not count
            summary = F.max_by(value, F.when(value.isNotNull(), position))
        else:
            summary = F.sum(_wide(value, rows)) if kind == "total" else F.max(value)
        summaries.append(summary.alias(name))
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, kind in kind_of.items():
        fold = {"total": F.sum, "peak": F.max}.get(kind, lambda c: F.last(c, ignorenulls=True))
        carried.append(fold(F.col(name)).over(before).alias(f"__carry_{name}"))
    carry = rows.groupBy(*keys, SEGMENT).agg(*summaries).select(*keys, SEGMENT, *carried)

    local = Window.partitionBy(*keys, SEGMENT).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    until = local.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for name, kind in kind_of.items():
        value, carry_in = F.col(f"__in_{name}"), F.col(f"__carry_{name}")
        if kind == "last":
            out[name] = F.coalesce(F.last(value, ignorenulls=True).over(upto), carry_in)
        elif kind == "previous":
            out[name] = F.coalesce(F.last(value, ignorenulls=True).over(until), carry_in)
        elif kind == "total":
            wide = F.coalesce(carry_in, F.lit(0)) + F.coalesce(F.sum(_wide(value, rows)).over(upto), F.lit(0))
            out[name] = _bounded(wide, value, rows)
        else:
            out[name] = F.greatest(F.max(value).over(upto), carry_in)
    matched = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, SEGMENT]]
    carries = [F.col(f"c.__carry_{name}") for name in kind_of]
    joined = rows.alias("r").join(carry.alias("c"), matched, "left").select("r.*", *carries).withColumns(out)
    return joined.select(*df.columns, *out)


def _whole(c: Column, rows: DataFrame) -> bool:
    return rows.select(c).schema[0].dataType.typeName() in ("byte", "short", "integer", "long")


def _wide(c: Column, rows: DataFrame) -> Column:
    """Whole numbers in a form whose sums do not overflow."""
    return c.cast("decimal(25,0)") if _whole(c, rows) else c


def _bounded(total: Column, c: Column, rows: DataFrame) -> Column:
    if not _whole(c, rows):
        return total
    low, high = (F.lit(x).cast("decimal(38,0)") for x in (-(2**63), 2**63 - 1))
    return F.greatest(F.least(total, high), low).cast("bigint")


def explode_once(df: DataFrame, array: str, item: str, *fields: str, position: str | None = None) -> DataFrame:
    """One row per element of a computed array, which is dropped; empty and NULL arrays give no row.

    A plain explode makes the optimizer test the array's size below the projection that computes it, which
    computes it again. The outer form with a later test on the position computes it once.
    """
    others = [c for c in df.columns if c != array]
    place = position or "__place"
    rows = df.select(*others, F.posexplode_outer(array).alias(place, item)).where(F.col(place).isNotNull())
    kept = [*others, *([position] if position else [])]
    return rows.select(*kept, *(fields or [item]))
