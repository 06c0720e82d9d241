"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of the ring; a key belongs to the shard of the next point clockwise. A shard takes
rows up to its capacity; what overflows goes on clockwise to the next point of a shard with room. Rows are met in ring
order. Row data never leave Spark: the walk needs the row count of each arc only, a table of ``shards * vnodes``
entries, and a row finds its shard by its rank within its arc.
"""

from __future__ import annotations

import json
import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsflow.llm import common

CELL_BITS = 12  # the ring is looked up by its top bits
RANK_ROWS = 20_000  # rows ranked together
MAX_POINTS = 1 << 17  # ring points that may be broadcast


def position(*parts: Column) -> Column:
    """Place on the ring: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 1)


def ring_points(spark, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all points, clockwise; a table bounded by the two parameters."""
    points = spark.range(shards * vnodes).select(
        position(F.lit("point"), F.col("id")).alias("place"), F.pmod("id", F.lit(shards)).alias("shard")
    )
    return sorted((r.place, r.shard) for r in points.collect())


def cells(points: list[tuple[int, int]]) -> list[dict]:
    """For each cell of the ring the points in it and the first one after it, with their index."""
    width, out, first = 1 << (63 - CELL_BITS), [], 0
    for cell in range(1 << CELL_BITS):
        near = []
        while first < len(points) and points[first][0] < (cell + 1) * width:
            near.append({"place": points[first][0], "arc": first})
            first += 1
        near.append({"place": 2**63 - 1, "arc": first % len(points)})
        out.append({"cell": cell, "near": near})
    return out


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may take. Without slack they add up to ``rows`` and differ by one at most."""
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(owners: list[int], counts: dict[int, int], room: list[int]) -> list[dict]:
    """Clockwise over the arcs: ranges of ranks of an arc with the shard and first slot they get."""
    room, used = list(room), [0] * len(room)
    placed: list[dict] = []
    moving: deque[tuple[int, int, int]] = deque()
    for turn in range(2):
        for arc, shard in enumerate(owners):
            if turn == 0 and counts.get(arc, 0):
                moving.appendleft((arc, 0, counts[arc]))
            while moving and room[shard]:
                of, low, high = moving.popleft()
                took = min(high - low, room[shard])
                placed.append({"arc": of, "low": low, "high": low + took, "shard": shard, "slot": used[shard]})
                room[shard] -= took
                used[shard] += took
                if low + took < high:
                    moving.appendleft((of, low + took, high))
    return placed


def assign(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, vnodes: int = 128, slack: float = 0.0
) -> DataFrame:
    """Shard and slot for every row: key, size, text_crc32, shard, slot.

    Without ``slack`` shard counts differ by one at most; with it each shard takes up to ``(1 + slack)`` times the mean
    and fewer rows move. Slots of a shard run from 0 without gaps. A NULL key is a key like any other; a NULL text counts
    as empty. Equal keys and repeated rows are rows of their own (a key with a third of all rows fills several shards).
    Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    if shards < 1 or vnodes < 1 or shards * vnodes > MAX_POINTS:
        raise ValueError("shards and vnodes: at least 1, and at most 131072 points")
    spark = docs.sparkSession
    points = ring_points(spark, shards, vnodes)
    near = F.broadcast(  # 4,096 cells and at most MAX_POINTS points
        common.literal_rows(spark, json.dumps(cells(points)), "cell bigint, near array<struct<place bigint, arc int>>")
    )
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + 1).cast("bigint").alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"),
        position(F.col(key)).alias("_place"),
    ).withColumn("cell", F.shiftrightunsigned("_place", 63 - CELL_BITS))
    rows = common.store(
        rows.join(near, "cell").select(
            "_key",
            "_size",
            "_crc",
            "_place",
            F.element_at(F.filter("near", lambda p: p["place"] >= F.col("_place")), 1)["arc"].alias("arc"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    counts = {r.arc: r["count"] for r in rows.groupBy("arc").count().collect()}  # one number for each ring point
    total = sum(counts.values())
    splits = math.ceil(max(counts.values(), default=0) / RANK_ROWS) or 1
    plan = walk([s for _, s in points], counts, capacities(total, shards, slack))
    by_arc: dict[int, list] = {}
    for p in plan:
        by_arc.setdefault(p["arc"], []).append(p)
    ranges = F.broadcast(  # at most one range for each ring point and shard
        common.literal_rows(
            spark,
            json.dumps([{"arc": a, "ranges": r} for a, r in by_arc.items()]),
            "arc int, ranges array<struct<low bigint, high bigint, shard int, slot bigint>>",
        )
    )
    rows = rows.withColumn("split", F.pmod(F.xxhash64("_row"), F.lit(splits)))
    before = (
        rows.groupBy("arc", "split")
        .count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("arc").orderBy("split")) - F.col("count"))
        .drop("count")
    )
    ranked = rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("arc", "split").orderBy("_place", "_row")) - 1
    )
    ranked = ranked.join(before, ["arc", "split"]).withColumn("rank", F.col("rank") + F.col("before"))
    place = F.element_at(F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"])), 1)
    return ranked.join(ranges, "arc").select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        place["shard"].alias("shard"),
        (place["slot"] + F.col("rank") - place["low"]).alias("slot"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``."""
    return assign(common.table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
