"""Repeated passages by seed and extend on winnowed anchors.

A window is 20 consecutive words. Its anchor is the run of six words in it with the least hash, so equal windows have
equal anchors at equal places (winnowing): anchors that occur once seed nothing. Documents are joined on the anchors
that repeat. Around an anchor the match is extended both ways as far as windows have it for their anchor: such a
stretch of up to 15 windows is a run. Equal runs match whole; where an anchor has different runs the match ends inside
of them, and they are compared window by window. Consecutive repeated windows together are the maximal repeats.
No pairs of occurrences are made: what counts is the first occurrence of a run or window.

Each pass over the texts emits only what a bitmap of fixed size lets through (repeated anchors, concerned documents).
The bitmap may let more through, never less, and exact joins follow, so results do not depend on its size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm import common

U64 = np.uint64
WINDOW = 20  # words of the shortest repeat
GRAM = 6  # words of an anchor
BASE = 0x9E3779B97F4A7C15
FILTER_BITS = 1 << 26  # 8 MB, whatever the input
PART_BITS = 32_768  # of one row of Spark's bitmap functions
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Hasher:
    """Hashes of any stretch of a document's words."""

    def __init__(self):
        self.powers = common.Powers(BASE)

    def load(self, text: str) -> int:
        """Take a text; returns its number of words."""
        words = common.word_hashes(text.encode())
        self.sums = self.powers.sums(words)
        return len(words)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return self.powers.stretch(self.sums, start, start + length)

    def anchors(self, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all anchors-to-be and, for every window, the place of its anchor (the leftmost least hash)."""
        grams = self.of(np.arange(n_words - GRAM + 1), GRAM)
        view = sliding_window_view(grams, WINDOW - GRAM + 1)
        return grams, np.arange(len(view)) + view.argmin(axis=1)

    def runs(self, n_words: int):
        """Per run: hash of its anchor, hash of its words, first window, number of windows."""
        grams, place = self.anchors(n_words)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        n = np.diff(np.append(first, len(place)))
        return grams[place[first]], self.of(first, n + WINDOW - 1), first, n


def bit_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U64(FILTER_BITS - 1)).astype(np.int64)


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the low bits of a column of 64-bit hashes: at most FILTER_BITS / 8 bytes come to the driver."""
    bit = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = (
        hashes.select(F.floor(bit / PART_BITS).cast("int").alias("part"), F.pmod(bit, F.lit(PART_BITS)).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros((FILTER_BITS // PART_BITS, PART_BITS // 8), np.uint8)
    for r in rows.toLocalIterator():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = bit_of(hashes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, part, text): the key of a document is its id (NULL: after all others) and a digest of its text."""
    return docs.select(*(c.alias(n) for c, n in zip(_columns(docs, id_col, text_col), ("doc", "part", "text"))))


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    def run(batches):
        work = make()
        for batch in common.slices(batches):
            yield from work(batch)

    return df.mapInArrow(run, schema)


def anchor_hashes(docs: DataFrame) -> DataFrame:
    """(anchor): one row for every run of every document."""

    def make():
        hasher = Hasher()

        def work(batch):
            out = []
            for text in batch.column(0):
                n_words = hasher.load(text.as_py())
                if n_words >= WINDOW:
                    out.append(hasher.runs(n_words)[0])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["anchor"])

        return work

    return mapped(docs.select("text"), make, "anchor bigint")


def occurrences(docs: DataFrame, seeds: np.ndarray) -> DataFrame:
    """(anchor, run, doc, part, start, n) of the runs whose anchor the bitmap lets through."""
    known = docs.sparkSession.sparkContext.broadcast(seeds)
    names = ["anchor", "run", "doc", "part", "start", "n"]

    def make():
        hasher, bits = Hasher(), known.value

        def work(batch):
            parts = [[] for _ in names]
            for doc, part, text in zip(*batch.columns):
                n_words = hasher.load(text.as_py())
                if n_words < WINDOW:
                    continue
                anchor, run, start, n = hasher.runs(n_words)
                ok = has(bits, anchor)
                count = int(ok.sum())
                if count:
                    row = (anchor[ok].view(np.int64), run[ok].view(np.int64), np.full(count, doc.as_py()), np.full(count, part.as_py()))
                    for p, v in zip(parts, (*row, start[ok].astype(np.int32), n[ok].astype(np.int32))):
                        p.append(v)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names)

        return work

    return mapped(docs, make, "anchor bigint, run bigint, doc bigint, part bigint, start int, n int")


def only(docs: DataFrame, keys: DataFrame, wanted: bool) -> DataFrame:
    """Documents that a bitmap of ``keys`` lets through, or those that it does not."""
    known = docs.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.xxhash64("doc", "part").alias("h")), "h"))
    place = len(docs.columns)

    def make():
        bits = known.value

        def work(batch):
            ok = has(bits, batch.column(place).to_numpy(zero_copy_only=False).view(U64)) == wanted
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays(kept.columns[:place], kept.schema.names[:place])

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(docs.withColumn("_h", F.xxhash64("doc", "part")), make, schema)


def window_hashes(spans: DataFrame) -> DataFrame:
    """(anchor, window, doc, part, start): the windows of given runs; ``spans`` holds (doc, part, text, runs)."""
    names = ["anchor", "window", "doc", "part", "start"]

    def make():
        hasher = Hasher()

        def work(batch):
            parts = [[] for _ in names]
            for doc, part, text, runs in zip(*batch.columns):
                hasher.load(text.as_py())
                runs = runs.as_py()
                n = np.array([r["n"] for r in runs])
                start = np.repeat([r["start"] for r in runs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                anchor = np.repeat(np.array([r["anchor"] for r in runs], np.int64), n)
                row = (anchor, hasher.of(start, WINDOW).view(np.int64), np.full(len(start), doc.as_py()), np.full(len(start), part.as_py()))
                for p, v in zip(parts, (*row, start.astype(np.int32))):
                    p.append(v)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names)

        return work

    return mapped(spans, make, "anchor bigint, window bigint, doc bigint, part bigint, start int")


def order() -> Column:
    return F.struct("doc", "part", "start")


def later(rows: DataFrame, firsts: DataFrame, *content: str) -> DataFrame:
    """The rows that are not the first of their content, in order of (doc, part, start)."""
    return rows.join(firsts.where("_n > 1").select(*content, "_first"), list(content)).where(order() != F.col("_first"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, part, spans): per document the starts and lengths in words of all windows that occur earlier."""
    seeds = anchor_hashes(docs).groupBy("anchor").count().where("count > 1").select("anchor")
    found = common.store(occurrences(docs, bitmap(seeds, "anchor")))
    kinds = common.store(
        found.groupBy("anchor", "run").agg(F.count("*").alias("_n"), F.min(order()).alias("_first"), F.min("n").alias("n"))
    )
    whole = later(found, kinds, "anchor", "run").select("doc", "part", "start", (F.col("n") + WINDOW - 1).alias("length"))
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    edges = common.store(kinds.join(mixed, "anchor").select("anchor", "_first.*", "n"))
    spans = edges.groupBy("doc", "part").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("runs"))
    texts = only(docs, edges, True).join(spans, ["doc", "part"]).select("doc", "part", "text", "runs")
    windows = common.store(window_hashes(texts))
    firsts = windows.groupBy("anchor", "window").agg(F.count("*").alias("_n"), F.min(order()).alias("_first"))
    single = later(windows, firsts, "anchor", "window").select("doc", "part", "start", F.lit(WINDOW).alias("length"))
    spans = F.collect_set(F.struct("start", "length"))  # equal rows give equal spans: an array is as long as its text has
    return common.store(whole.unionAll(single).groupBy("doc", "part").agg(spans.alias("spans")))


def covered(n_words: int, spans) -> np.ndarray:
    """Which words lie in a span."""
    edge = np.zeros(n_words + 1, np.int64)
    if len(spans):
        start = np.array([s["start"] for s in spans])
        np.add.at(edge, start, 1)
        np.add.at(edge, start + np.array([s["length"] for s in spans]), -1)
    return np.cumsum(edge[:-1]) > 0


def cut(text: str, spans) -> tuple[str, int, int, str]:
    """(text without the spans, words, removed words, digest of the kept words joined by one space)."""
    raw = text.encode()
    words = raw.split()
    gone = covered(len(words), spans)
    kept = [w for w, g in zip(words, gone) if not g] if gone.any() else words
    if gone.any():
        places = [m.span() for m in WORD.finditer(raw)]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
        text = b" ".join(raw[places[a][0] : places[b - 1][1]] for a, b in zip(edges[::2], edges[1::2])).decode()
    return text, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def trimmed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with text_col cut, and dd_words, dd_removed, dd_sha256.

    Each word goes that a 20-word window covers whose words also start earlier: in a document of smaller id, or earlier
    in the same one. Rows of one id with different texts are documents in order of 64 bits of the texts' SHA-256; equal
    rows are one document and are cut alike. A NULL id comes after all others. NULL text counts as empty and comes back
    empty; texts under 20 words stay; very long ones are cut whole, one at a time. Texts without a repeat come back as
    they are, else the kept passages joined by one space. Other columns pass unchanged; an empty table gives no rows.
    """
    made = ["dd_words", "dd_removed", "dd_sha256"]
    rest = [c for c in docs.columns if c not in (text_col, *made)]
    keyed = documents(docs, id_col, text_col)
    rows = docs.select(
        F.struct(*rest).alias("_rest"),
        *(c.alias(n) for c, n in zip(_columns(docs, id_col, text_col), ("doc", "part", "text"))),
    )
    found = repeats(keyed)
    hit = only(rows, found, True).join(found, ["doc", "part"], "left")
    clean = only(rows, found, False).withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType))
    both = clean.select("_rest", "text", "spans").unionByName(hit.select("_rest", "text", "spans"))

    def make():
        def work(batch):
            got = [cut(t, s or ()) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            arrays = [batch.column(0)] + [
                pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["_rest", "text", *made])

        return work

    rest_type = both.schema["_rest"].dataType.simpleString()
    out = mapped(both, make, f"_rest {rest_type}, text string, dd_words bigint, dd_removed bigint, dd_sha256 string")
    return out.select("_rest.*", F.col("text").alias(text_col), *made)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    text = F.coalesce(docs[text_col], F.lit(""))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("bigint")
    return F.coalesce(docs[id_col].cast("bigint"), F.lit(2**63 - 1)), part, text


# Every window with its place; a word goes if a repeated window began less than a window's length before it.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
     k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS content FROM s),
     r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) > 1 AS later FROM k),
     p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
     c AS (SELECT p.doc_id, word, j, coalesce(j - max(CASE WHEN later THEN j END) OVER (PARTITION BY p.doc_id ORDER BY j) < 20, false) AS gone
           FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.j),
     g AS (SELECT doc_id, count(*) AS n_words, count(CASE WHEN gone THEN 1 END) AS n_removed,
                  string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY j) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def brute_force(docs: list[tuple[int, str]]) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) by a dictionary of all windows."""
    seen: dict[tuple, int] = {}
    out = []
    for doc, text in sorted(docs):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - WINDOW + 1):
            w = tuple(words[i : i + WINDOW])
            if w in seen:
                gone[i : i + WINDOW] = [True] * WINDOW
            seen.setdefault(w, i)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """Every document without the words that occur earlier."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return trimmed(docs).select(
        "doc_id",
        F.col("dd_words").alias("n_words"),
        F.col("dd_removed").alias("n_removed"),
        F.col("dd_sha256").alias("kept_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated passages; n_chars follows the text."""
    rows, back = common.apart(docs, "doc_id", "text", "n_chars")
    out = trimmed(rows)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("dd_removed") > 0, length).otherwise(F.col("n_chars")))
    return out.select(*back)
