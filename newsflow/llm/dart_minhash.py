"""Near-duplicate documents by DartMinHash signatures, a banded join and exact verification.

A document is the weighted set of its five-word shingles, a shingle weighing as often as it occurs. Darts are thrown
into the region (weight, rank) of every element, the same for every document that holds it; the first ``darts / total
weight`` of the ranks are looked at, so a long text costs no more darts than a short one. The dart of least rank in each
of the ``bands * rows`` coordinates is the signature; two documents agree in a coordinate with the probability of
their weighted Jaccard similarity.

Documents that agree in a whole band share a bucket. A bucket is not expanded into pairs: one member is compared with
all others, then a few more with those not yet known to be in their class, and at last the members outside the largest
class with all others. Every pair of a bucket is thus compared or joined already, and a group of thousands of copies
costs a few comparisons for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.llm import common
from newsflow.llm.components import components

U64 = np.uint64
WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
BLOCK = 128  # members of a bucket that meet as many others in one group
LOTS = 4  # members compared in the second turn
BASE = 0x9E3779B97F4A7C15
CHUNK_WORDS = 400_000  # words handled together in a task


def shingles(text: str | None) -> np.ndarray:
    """Hashes of all runs of five words; a shorter text is one shingle, an empty one has none."""
    words = common.word_hashes((text or "").encode())
    if not len(words):
        return np.empty(0, U64)
    return common.rolling(words, min(WORDS, len(words)), BASE)


def weighted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, occurrence) of all shingles of some documents: units of weight one."""
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    key = np.concatenate(parts) if parts else np.empty(0, U64)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    return doc, key, np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))


def poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Counts of a Poisson law from uniform numbers."""
    top = int(mean + 12 * math.sqrt(mean) + 12)
    n = np.arange(top + 1)
    logs = n * math.log(mean) - mean - np.cumsum(np.log(np.maximum(n, 1)))
    return np.searchsorted(np.cumsum(np.exp(logs)), u, side="right").astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in [0, 1) from 64 bits."""
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def throw(
    doc: np.ndarray, key: np.ndarray, level: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (documents x k) and which coordinates got a dart.

    A unit is the cell [level, level + 1) of the weight axis of an element; darts above the element's ``weight`` or
    beyond the document's rank ``limit`` do not count. Ranks come in layers [2**r - 1, 2**(r + 1) - 1), with a Poisson
    number of darts in each cell, so darts depend on nothing but element, cell and layer.
    """
    n_docs = len(limit)
    slots, ranks, darts = [], [], []
    cell = common.mix(key + common.mix(level.astype(U64) + U64(1)))
    top = float(limit.max(initial=0.0))
    layer, low = 0, 0.0
    while low < top:
        at = np.flatnonzero(limit[doc] > low)
        seed = common.mix(cell[at] ^ U64((layer + 1) * 0xD6E8FEB86659FD93 % 2**64))
        n = poisson(unit(seed), 2.0**layer)
        of = np.repeat(at, n)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        dart = common.mix(np.repeat(seed, n) + turn.astype(U64) * U64(0xA24BAED4963EE407) + U64(1))
        rank = low + 2.0**layer * unit(common.mix(dart ^ U64(0x5851F42D4C957F2D)))
        height = level[of] + unit(common.mix(dart ^ U64(0x14057B7EF767814F)))
        ok = (rank < limit[doc[of]]) & (height < weight[of])
        of, dart, rank = of[ok], dart[ok], rank[ok]
        slots.append(doc[of] * k + (dart % U64(k)).astype(np.int64))
        ranks.append(rank)
        darts.append(dart)
        layer, low = layer + 1, 2.0 ** (layer + 1) - 1
    slot, rank, dart = (np.concatenate(x) if x else np.empty(0) for x in (slots, ranks, darts))
    order = np.lexsort((rank, slot))
    slot, dart = slot[order].astype(np.int64), dart[order].astype(U64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    signature, hit = np.zeros(n_docs * k, U64), np.zeros(n_docs * k, bool)
    signature[slot[first]], hit[slot[first]] = dart[first], True
    return signature.reshape(n_docs, k), hit.reshape(n_docs, k)


def signatures(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Signature of every document; those without shingles get zeros.

    Where a coordinate stayed empty the document is thrown anew with twice the ranks; darts thrown before stay.
    """
    doc, key, level = weighted(parts)
    return sketch(doc, key, level, np.full(len(key), np.inf), np.array([len(p) for p in parts], float), k)


def sketch(doc, key, level, weight, total, k: int) -> np.ndarray:
    """Signatures of weighted sets given by their cells; ``total`` is each set's weight."""
    out = np.zeros((len(total), k), U64)
    todo = np.flatnonzero(total > 0)
    darts = k * math.log(k) + 2 * k
    while len(todo):
        index = np.full(len(total), -1)
        index[todo] = np.arange(len(todo))
        mine = index[doc] >= 0
        got, hit = throw(index[doc[mine]], key[mine], level[mine], weight[mine], darts / total[todo], k)
        full = hit.all(axis=1)
        out[todo[full]] = got[full]
        todo, darts = todo[~full], darts * 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for every band."""
    out = np.empty((len(signature), bands), U64)
    for b in range(bands):
        h = np.full(len(signature), U64(b + 1))
        for r in range(rows):
            h = common.mix(h * U64(BASE) + signature[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle lists: common occurrences over all."""
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = int(np.minimum(na[ia], nb[ib]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def bands_of(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """(rid, band): band keys of every text that has words."""

    def signed(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = band_keys(signatures(parts, bands * rows), bands, rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), lists], ["rid", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids, parts, held = [], [], 0
            for rid, text in zip(batch.column(0), batch.column(1)):
                own = shingles(text.as_py())
                if len(own):
                    ids.append(rid.as_py())
                    parts.append(own)
                    held += len(own)
                if held > CHUNK_WORDS:
                    yield signed(ids, parts)
                    ids, parts, held = [], [], 0
            if ids:
                yield signed(ids, parts)

    return texts.select("rid", "text").mapInArrow(run, "rid binary, bands array<bigint>").select(
        "rid", F.explode("bands").alias("band")
    )


def occurrences(texts: DataFrame) -> DataFrame:
    """(rid, units): 32-bit hashes of every shingle with the number of its occurrence, all different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            units = []
            for text in batch.column(1):
                _, key, level = weighted([shingles(text.as_py())])
                units.append(np.unique((common.mix(key + common.mix(level.astype(U64) + U64(1))) >> U64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.list_(pa.int32()))], ["rid", "units"])

    return texts.select("rid", "text").mapInArrow(run, "rid binary, units array<int>")


def verified(pairs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least so similar: common occurrences over all."""
    both = pairs.join(units.select(F.col("rid").alias("a"), F.col("units").alias("x")), "a").join(
        units.select(F.col("rid").alias("b"), F.col("units").alias("y")), "b"
    )
    common_ = F.size(F.array_intersect("x", "y"))
    return both.where(common_ >= least * (F.size("x") + F.size("y") - common_)).select("a", "b")


def bucket_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the pivots of each bucket with its members of other classes."""
    pivots = members.where("pivot").select("band", F.col("rid").alias("a"), F.col("root").alias("ra"))
    return (
        members.join(pivots, "band")
        .where(F.col("root") != F.col("ra"))
        .select(F.least("a", "rid").alias("a"), F.greatest("a", "rid").alias("b"))
        .distinct()
    )


def within(members: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the pivots of a bucket and its other members, for turns with many pivots.

    A bucket is cut into blocks of about ``BLOCK`` members; every pair of blocks is one group, to which the members bring
    their units once instead of once for each pair.
    """
    rows = members.join(units, "rid").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    kept = ("band", "rid", "root", "units")
    asked = rows.where("pivot").select(*kept, F.col("own").alias("i"), every.alias("j"), F.lit(True).alias("asks"))
    others = rows.select(*kept, every.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))

    def compare(met: pd.DataFrame) -> pd.DataFrame:
        left, right, a, b = met[met["asks"]], met[~met["asks"]], [], []
        if len(left) and len(right):
            sizes = right["units"].map(len).to_numpy()
            owner, flat = np.repeat(np.arange(len(right)), sizes), np.concatenate(right["units"].to_list())
            for rid, root, own in zip(left["rid"], left["root"], left["units"]):
                at = np.minimum(np.searchsorted(own, flat), max(len(own) - 1, 0))
                both = np.bincount(owner[own[at] == flat], minlength=len(right))
                for k in np.flatnonzero(both >= least * (len(own) + sizes - both)):
                    if right["root"].iloc[k] != root:
                        a.append(rid)
                        b.append(right["rid"].iloc[k])
        return pd.DataFrame({"a": a, "b": b})

    return asked.unionByName(others).groupBy("band", "i", "j").applyInPandas(compare, "a binary, b binary")


def next_turn(members: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """What remains of the buckets that still hold several classes, with the members to be compared next.

    Second come a few members by lot. From then on all members outside the bucket's largest class are compared with all
    others, after which no bucket holds a pair that is neither compared nor joined.
    """
    now = members.select("band", "rid").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    now = now.select(
        "band", "rid", F.coalesce("root", "rid").alias("root"), F.coalesce("size", F.lit(1)).alias("size"), F.xxhash64("rid").alias("luck")
    )
    buckets = now.groupBy("band").agg(
        F.count("*").alias("n"),
        F.min("luck").alias("least"),
        F.min(F.xxhash64("root")).alias("r0"),
        F.max(F.xxhash64("root")).alias("r1"),
        F.max(F.struct("size", "root")).alias("top"),
    )
    if turn == 1:
        pivot = (F.col("luck") == F.col("least")) | ((F.col("luck") / 2.0**64 + 0.5) * F.col("n") < LOTS)
    else:
        pivot = F.col("root") != F.col("top.root")
    return now.join(buckets.where("r0 != r1"), "band").select("band", "rid", "root", "n", pivot.alias("pivot"))


def digest(text: str) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def classes(
    docs: DataFrame,
    least: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, class_id, head) for every row: class_id is the smallest id of its class, head marks its text in the class.

    Of each class the rows of one text have ``head``: one that occurs with the id class_id.

    A class holds what is linked, directly or through others, by equal texts or by similarity ``least`` or more in a
    shared bucket (a pair of similarity 0.8 shares one with probability 0.998). NULL counts as empty text; all
    documents without words are one class each by equal text. Rows with a repeated id are rows of their own; classes of
    NULL ids only have NULL as class_id. Other columns are not read. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("rid", digest("text"))
    ids, texts = docs.select("id", "rid"), docs.select("rid", "text")
    firsts = ids.groupBy("rid").agg(F.min("id").alias("first"))
    signed = common.store(bands_of(texts, bands, rows).withColumn("luck", F.xxhash64("rid")))
    spread = signed.groupBy("band").agg(F.min("luck").alias("l0"), F.max("luck").alias("l1"))
    members = common.store(
        signed.join(spread.where("l0 != l1").select("band", "l0"), "band")
        .select("band", "rid", F.col("rid").alias("root"), (F.col("luck") == F.col("l0")).alias("pivot"))
        .distinct()
    )
    near = texts.join(members.select("rid").distinct(), "rid", "left_semi")
    units = common.store(occurrences(near.groupBy("rid").agg(F.first("text").alias("text"))))
    roots, turn = None, 0  # (node, root, size) of the classes known so far; a text that is not in it is its own
    while members.limit(1).count():
        narrow = common.sized(members)
        if turn > 1:
            links = within(members, units, least).distinct()
        else:
            pairs = bucket_pairs(narrow)
            links = verified(common.store(pairs), units, least)
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = components(links)
        sizes = found.groupBy("root").agg(F.count("*").alias("size"))
        roots = common.store(found.join(sizes, "root").select("node", "root", "size"))
        turn += 1
        members = common.store(next_turn(narrow.where(~F.col("pivot")), common.sized(roots), turn))
    if roots is None:
        known = firsts.withColumn("root", F.col("rid"))
    else:
        known = firsts.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").select(
            "rid", "first", F.coalesce("root", "rid").alias("root")
        )
    lowest = F.struct(F.col("first").isNull(), "first", "rid")
    heads = known.groupBy("root").agg(F.min(lowest).alias("low"))
    known = known.join(heads, "root").select(
        "rid", F.col("low.first").alias("class_id"), (F.col("rid") == F.col("low.rid")).alias("head")
    )
    return ids.join(known, "rid").select(F.col("id").alias(id_col), "class_id", "head", "rid")


def query(spark, sf_dir: str) -> DataFrame:
    """The class of every document, and whether it is the one that stays."""
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "class_id", (F.col("head") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of the smallest id (NULL is the largest); of repeated rows one."""
    rows, back = common.apart(docs, "doc_id", "text")
    found = classes(rows).where(F.col("head") & F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = found.select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid")).distinct()
    rows = rows.withColumn("_text", digest("text"))
    rows = rows.join(kept, (F.col("_text") == F.col("_rid")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    once = F.row_number().over(Window.partitionBy("_text", "doc_id").orderBy("_text"))
    return rows.withColumn("_once", once).where(F.col("_once") == 1).select(*back)
