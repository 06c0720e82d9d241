"""Helpers the operators share: shared folder, lineage cuts, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CACHE = 400_000  # words that a Python worker remembers; a full cache is emptied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; one of our own only where none is set (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = f"file://{tempfile.mkdtemp(prefix='newsflow-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsflow-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(stored: DataFrame, rows: int = 200_000) -> DataFrame:
    """A stored table of narrow rows in as many partitions as its row count needs; one partition saves its shuffles."""
    return stored.coalesce(1 + stored.count() // rows)


def literal_rows(spark: SparkSession, rows: str, schema: str) -> DataFrame:
    """A small table from JSON text, made by Spark itself."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<{schema}>>")))


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``used`` under names of their place, which clash with nothing, and the way back."""
    names = [c if c in used else f"user_{i}_" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def slices(batches, rows: int = 500):
    """Arrow batches cut into smaller ones, so that a task holds few texts and results at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes:
    """64-bit hashes of words, remembered per Python worker."""

    def __init__(self, seed: int = 0):
        self.seed, self.known = seed, {}

    def __call__(self, words: list) -> np.ndarray:
        known, seed = self.known, self.seed
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w, seed)
        return np.fromiter(map(known.__getitem__, words), dtype=U64, count=len(words))


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of every ``n`` consecutive entries, by doubling; empty when there are fewer than ``n``."""
    size = len(h) - n + 1
    if size < 1:
        return np.empty(0, U64)
    out, done = np.zeros(size, U64), 0
    part, width, power = h, 1, base
    with np.errstate(over="ignore"):
        while True:
            if n & width:
                out = out * U64(power) + part[done : done + size]
                done += width
            if width * 2 > n:
                return out
            part = part[: len(part) - width] * U64(power) + part[width:]
            power = power * power % 2**64
            width *= 2


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_BASE = 0xF1357AEA2E62A9C5


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed so far."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                powers = np.full(size, U64(factor))
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=U64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums from which ``stretch`` takes the hash of any stretch."""
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


BYTES = Powers(BYTE_BASE)


def word_hashes(raw: bytes, dropped: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, cut at ASCII white space; all at once, without a Python loop.

    ``dropped`` marks byte values that are left out beforehand.
    """
    a = np.frombuffer(raw, np.uint8)
    if dropped is not None:
        a = a[~dropped[a]]
    gap = np.ones(len(a) + 2, bool)
    gap[1:-1] = SPACE[a]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return BYTES.stretch(BYTES.sums(a.astype(U64) + U64(1)), edge[::2], edge[1::2])
