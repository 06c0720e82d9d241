"""Interpolated modified Kneser-Ney language model: counted in Spark, stored as sorted hash arrays, mapped by workers.

Tokens are words between ASCII white space with A-Z in lower case, then one end token for each document; before a document
stand as many pads as a context is long. Counting goes order by order. Every task counts its own n-grams in chunks and
sends only what differs, dealt by the hash of the context to shards; a shard adds up what it gets, writes its n-grams and
contexts as arrays sorted by hash, and passes on, for each suffix, the number of different words before it: the counts of
the order below. A context whose words stand oftener than a shard's fair share is split over several shards by its next
word, so a word with a third of all rows fills no single one.

The arrays lie in a folder that driver and executors share; scoring maps them into memory and looks up a slice of
documents at a time. Nothing but a few numbers for each shard comes to the driver. Words and n-grams are told apart by
64-bit hashes.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm import common
from newsflow.llm.fill_middle import by_bytes

U64 = np.uint64
ORDER = 2
CHUNK_TOKENS = 1 << 21  # counted at once by a task
SLICE_BYTES = 1 << 20  # text hashed at once
END_WORD = b"\xff"  # in no UTF-8 text
GAP = re.compile(rb"[\x20\x09-\x0D]")
PLAIN_DISCOUNTS = (0.5, 1.0, 1.5)  # where too few n-grams are there to estimate them
BLOB = "shard int, ids binary, counts binary"
SUMMARY = "shard int, ids binary, counts binary, summary array<bigint>"
SCORES = "n_tokens bigint, n_known bigint, base_score double, score double"


def hashed(texts: list[bytes]) -> np.ndarray:
    """Hashes of the tokens of ``texts`` in a row, an end token after each."""
    raw = b"".join(t.lower() + b" " + END_WORD + b" " for t in texts)  # bytes.lower knows A-Z only
    out, at = [], 0
    while at < len(raw):
        gap = GAP.search(raw, min(len(raw), at + SLICE_BYTES))
        end = gap.end() if gap else len(raw)
        out.append(common.word_hashes(raw[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, U64)


END = common.word_hashes(END_WORD)[0]


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    """Token hashes of whole documents, about ``CHUNK_TOKENS`` at a time."""
    held, size = [], 0
    for part in by_bytes(batches, column, SLICE_BYTES):
        held.append(hashed([t.as_buffer().to_pybytes() for t in part.column(column)]))
        size += len(held[-1])
        if size >= CHUNK_TOKENS:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def gram_key(ids: np.ndarray) -> np.ndarray:
    """64-bit hash of every column of ``ids`` (a row for each word of the n-gram)."""
    key = np.full(ids.shape[1], U64(len(ids) + 1))
    with np.errstate(over="ignore"):
        for row in ids:
            key = common.mix(key * U64(0x9E3779B97F4A7C15) + row.astype(U64) + U64(1))
    return key


def padded(ids: np.ndarray, is_end: np.ndarray, order: int, pad: int) -> np.ndarray:
    """The n-gram that ends at each token: ``order`` rows of ids, the last the tokens themselves."""
    doc = np.concatenate([[0], np.cumsum(is_end)[:-1]]) if len(ids) else np.empty(0, np.int64)
    at = np.arange(len(ids)) + (order - 1) * (doc + 1)
    line = np.full(int(at[-1]) + 1 if len(at) else 0, pad, ids.dtype)
    line[at] = ids
    return np.stack([line[at - back] for back in range(order - 1, -1, -1)])


def counted(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each different column of ``grams`` (numbers below ``size``), and how often it stands there."""
    key, bound = grams[0].astype(np.int64), size
    for row in grams[1:]:
        if bound * size >= 2**63:
            values, key = np.unique(key, return_inverse=True)
            bound = len(values)
        key, bound = key * size + row, bound * size
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return first, counts


def save(folder: str, name: str, shard: int, array: np.ndarray) -> None:
    """A whole file or none: a task that is run again writes the same file."""
    path = f"{folder}/{name}-{shard:06d}.npy"
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, path)


@dataclass
class Model:
    """Where the arrays lie and the few numbers that hold for all of them."""

    folder: str
    order: int
    parts: int
    words: list[int]  # different words in the vocabulary shards before each, and in all
    n_tokens: int
    present: list[set[int]] = field(default_factory=list)  # per order from 1: shards with n-grams
    discounts: list[tuple[float, float, float]] = field(default_factory=list)
    lowest: tuple[int, int, int, int] = (0, 0, 0, 0)  # order 1: total, and words with count 1, 2, 3 or more
    files: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "files": {}}

    @property
    def size(self) -> int:
        return self.words[-1]

    def mapped(self, name: str, shard: int) -> np.ndarray:
        if (name, shard) not in self.files:
            self.files[name, shard] = np.load(f"{self.folder}/{name}-{shard:06d}.npy", mmap_mode="r")
        return self.files[name, shard]

    def vocabulary(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of sorted hashes; words not met in training have the id ``size`` + 1 and the count 0."""
        ids, counts = np.full(len(hashes), self.size + 1, np.int64), np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(vocabulary_shard(hashes, self.parts), np.arange(self.parts + 1))
        for shard in range(self.parts):
            a, b = edges[shard : shard + 2]
            if a < b and self.words[shard] < self.words[shard + 1]:
                known = self.mapped("words", shard)
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                same = known[at] == hashes[a:b]
                ids[a:b][same] = at[same] + self.words[shard]
                counts[a:b][same] = self.mapped("word-counts", shard)[at[same]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of sorted word ids; a pad stands as often as there are documents."""
        out = np.zeros(len(ids), np.int64)
        edges = np.searchsorted(ids, self.words)
        for shard in range(self.parts):
            a, b = edges[shard : shard + 2]
            if a < b:
                out[a:b] = self.mapped("word-counts", shard)[ids[a:b].astype(np.int64) - self.words[shard]]
        out[edges[-1] :] = self.vocabulary(np.array([END]))[1][0]
        return out

    def split(self, least: np.ndarray) -> np.ndarray:
        """Over how many shards a context is dealt whose rarest word stands ``least`` times."""
        return 1 + least // (self.n_tokens // self.parts + 1)

    def place(self, ids: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The shard of n-grams; ``least``: the count of the rarest word of each context."""
        key = gram_key(ids)
        if len(ids) == 1:
            return (key % U64(self.parts)).astype(np.int64)
        return self.shift(gram_key(ids[:-1]), (key % self.split(least).astype(U64)).astype(np.int64))

    def shift(self, context: np.ndarray, turn: np.ndarray) -> np.ndarray:
        return ((context % U64(self.parts)).astype(np.int64) + turn) % self.parts

    def find(self, name: str, level: int, shard: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """What is stored for each key in its shard (``width`` numbers), zeros where nothing is."""
        out = np.zeros((width, len(keys)), np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.parts + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if s not in self.present[level - 1]:
                continue
            rows = order[edges[s] : edges[s + 1]]
            known = self.mapped(f"{name}-{level}", s)
            at = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
            same = known[at] == keys[rows]
            out[:, rows[same]] = self.mapped(f"{name}-{level}-counts", s)[..., at[same]]
        return out

    def log_probabilities(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the model's probability and the training count of each token of whole documents."""
        words, inverse = np.unique(tokens, return_inverse=True)
        word_ids, word_counts = self.vocabulary(words)
        ids, counts = word_ids[inverse], word_counts[inverse]
        ends = tokens == END
        lines = int(word_counts[words == END].sum())
        grams = padded(ids, ends, self.order, self.size)
        totals = padded(counts, ends, self.order, lines)
        key = gram_key(grams[-1:])
        c = self.find("grams", 1, (key % U64(self.parts)).astype(np.int64), key, 1)[0]
        total, *held = self.lowest
        p = np.full(len(tokens), 1 / (self.size + 1))
        if total:
            p = (np.maximum(c - self.discount(1, c), 0) + np.dot(self.discounts[0], held) * p) / total
        for level in range(2, self.order + 1):
            here, least = grams[-level:], totals[-level:-1].min(axis=0)
            context, turns = gram_key(here[:-1]), self.split(least)
            stats = np.zeros((4, len(tokens)), np.int64)
            for turn in range(int(turns.max(initial=0))):
                rows = np.flatnonzero(turns > turn)
                stats[:, rows] += self.find("contexts", level, self.shift(context[rows], turn), context[rows], 4)
            met = np.flatnonzero(stats[0])
            c = self.find("grams", level, self.place(here[:, met], least[met]), gram_key(here[:, met]), 1)[0]
            total, held = stats[0, met], stats[1:, met]
            p[met] = (np.maximum(c - self.discount(level, c), 0) + np.dot(self.discounts[level - 1], held) * p[met]) / total
        return np.log10(p), counts

    def discount(self, level: int, counts: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.discounts[level - 1]])[np.minimum(counts, 3)]


def vocabulary_shard(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def dealt(place: np.ndarray, ids: np.ndarray, counts: np.ndarray, schema: str) -> pa.RecordBatch:
    """One row for each shard: the ids row by row, and the counts, as bytes."""
    order = np.argsort(place, kind="stable")
    shards, starts = np.unique(place[order], return_index=True)
    edges = [*starts.tolist(), len(order)]
    spans = [order[a:b] for a, b in zip(edges, edges[1:])]
    columns = [
        pa.array(shards, pa.int32()),
        pa.array([np.ascontiguousarray(ids[:, s]).tobytes() for s in spans], pa.binary()),
        pa.array([counts[s].astype(np.int64).tobytes() for s in spans], pa.binary()),
    ]
    if schema == SUMMARY:
        columns.append(pa.array([None] * len(spans), pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])


def by_shard(batches: Iterator[pa.RecordBatch], kind: type, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The ids and counts of each shard, from rows sorted by shard."""
    shard, ids, counts = None, [], []
    for batch in batches:
        for s, i, c in zip(*(batch.column(k) for k in range(3))):
            if s.as_py() != shard and ids:
                yield shard, np.concatenate(ids, axis=1), np.concatenate(counts)
                ids, counts = [], []
            shard = s.as_py()
            ids.append(np.frombuffer(i.as_buffer(), kind).reshape(rows, -1))
            counts.append(np.frombuffer(c.as_buffer(), np.int64))
    if ids:
        yield shard, np.concatenate(ids, axis=1), np.concatenate(counts)


def _gathered(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "shard").sortWithinPartitions("shard")


def shared_path(folder: str) -> str:
    """The folder as a path that files can be mapped from."""
    if folder.startswith("file:"):
        return re.sub("^file:/*", "/", folder)
    if folder.startswith("/"):
        return folder
    raise ValueError(f"{folder}: the model is mapped into memory; name a folder that all executors mount")


def train(docs: DataFrame, order: int = ORDER, text_col: str = "text", folder: str | None = None, parts: int | None = None) -> Model:
    """A model of all rows of ``docs``; other columns are not read.

    ``parts``: shards that it is counted and stored in, ``spark.sql.shuffle.partitions`` if not given; the model is the
    same for any number. ``folder``: where it is stored, below ``spark.checkpoint.dir`` if not given. A NULL or empty text
    is a document of the end token alone; repeated rows count as often as they stand there; from no rows comes a model by
    which all words are equally likely. Long texts are hashed in pieces cut between words; one document's token hashes
    stay in one task.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_path(folder or f"{common.shared_dir(spark)}/newsflow-llm/kneser-ney-{uuid.uuid4().hex}")
    os.makedirs(folder, exist_ok=True)
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = _vocabulary(texts, folder, order, parts)
    known = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for tokens in chunks(batches, 0):
            words, inverse = np.unique(tokens, return_inverse=True)
            ids, held = model.vocabulary(words)
            ids, held = np.append(ids, model.size), np.append(held, held[words == END])
            grams = padded(inverse, tokens == END, model.order, len(words))
            first, counts = counted(grams, len(words) + 1)
            grams = grams[:, first]
            yield dealt(model.place(ids[grams], _rarest(held[grams])), ids[grams].astype(np.uint32), counts, BLOB)

    rows = texts.mapInArrow(count, BLOB)
    for level in range(order, 0, -1):
        built = common.store(_gathered(rows, parts).mapInArrow(_build(known, level), SUMMARY))
        found = [(r.shard, *r.summary) for r in built.where("summary IS NOT NULL").select("shard", "summary").collect()]
        n1, n2, n3, n4, n3_up, total = (sum(r[k] for r in found) for k in range(1, 7))
        model.present.insert(0, {r[0] for r in found})
        model.discounts.insert(0, discounts_of(n1, n2, n3, n4))
        model.lowest = (total, n1, n2, n3_up)
        rows = built.where("summary IS NULL").select("shard", "ids", "counts")
    return model


def _rarest(held: np.ndarray) -> np.ndarray:
    """The count of the rarest word of each context, from the counts of the words of n-grams."""
    return held[:-1].min(axis=0) if len(held) > 1 else np.zeros(held.shape[1], np.int64)


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more, from the numbers of n-grams with counts 1 to 4.

    Where these give nothing above zero for one of them, fixed ones: else what was never met could get no share at all.
    """
    if not (n1 and n2 and n3):
        return PLAIN_DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return raw if min(raw) > 0 else PLAIN_DISCOUNTS


def _vocabulary(texts: DataFrame, folder: str, order: int, parts: int) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in chunks(batches, 0):
            words, counts = np.unique(tokens, return_counts=True)
            yield dealt(vocabulary_shard(words, parts), words[None, :], counts, BLOB)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, words, counts in by_shard(batches, U64, 1):
            words, inverse = np.unique(words[0], return_inverse=True)
            counts = np.bincount(inverse, counts, len(words)).astype(np.int64)
            save(folder, "words", shard, words)
            save(folder, "word-counts", shard, counts)
            columns = [pa.array([x], pa.int64()) for x in (shard, len(words), int(counts.sum()))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "words", "tokens"])

    merged = _gathered(texts.mapInArrow(count, BLOB), parts).mapInArrow(merge, "shard bigint, words bigint, tokens bigint")
    found = {r.shard: r for r in merged.collect()}  # three numbers for each shard
    sizes = [found[s].words if s in found else 0 for s in range(parts)]
    words = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
    if words[-1] >= 2**32 - 2:
        raise ValueError("more different words than 32-bit ids")
    return Model(folder, order, parts, words, sum(r.tokens for r in found.values()))


def _build(known, level: int):  # noqa: ANN001, ANN202
    """Task code for the shards of one order: add up, store, and give the counts of the order below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for shard, ids, counts in by_shard(batches, np.uint32, level):
            key = gram_key(ids)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ids, counts, key = ids[:, order[first]], np.add.reduceat(counts[order], first), key[first]
            save(model.folder, f"grams-{level}", shard, key)
            save(model.folder, f"grams-{level}-counts", shard, counts.astype(np.min_scalar_type(int(counts.max())))[None, :])
            kinds = [counts == 1, counts == 2, counts == 3, counts == 4, counts >= 3]
            if level > 1:
                contexts, inverse = np.unique(gram_key(ids[:-1]), return_inverse=True)
                stats = [np.bincount(inverse, x, len(contexts)) for x in (counts, kinds[0], kinds[1], kinds[4])]
                stats = np.array(stats).astype(np.int64)
                save(model.folder, f"contexts-{level}", shard, contexts)
                save(model.folder, f"contexts-{level}-counts", shard, stats.astype(np.min_scalar_type(int(stats.max()))))
                yield _below(model, ids[1:])
            summary = [int(k.sum()) for k in kinds] + [int(counts.sum())]
            columns = [pa.array([shard], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
            names = [c.split()[0] for c in SUMMARY.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([summary], pa.list_(pa.int64()))], names)

    return run


def _below(model: Model, suffixes: np.ndarray) -> pa.RecordBatch:
    """How many different words stand before each suffix, dealt to the shards of the order below."""
    words, inverse = np.unique(suffixes, return_inverse=True)
    local = inverse.reshape(suffixes.shape)
    first, counts = counted(local, len(words))
    local, suffixes = local[:, first], suffixes[:, first]
    held = model.counts_of(words) if len(suffixes) > 1 else np.zeros(len(words), np.int64)
    return dealt(model.place(suffixes, _rarest(held[local])), suffixes, counts, SUMMARY)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of every row of ``docs``; other columns are left out.

    ``score`` is the log10 probability of the text with its end token, ``base_score`` that by single words with one added
    to each count, ``perplexity`` 10 to the negative mean score of a token. A NULL or empty text is the end token alone.
    Equal texts have equal scores up to rounding, no rows give none. No shuffle: each worker maps the arrays.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["id", *(c.split()[0] for c in SCORES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        floor = np.log10(model.n_tokens + model.size + 1)
        for part in by_bytes(batches, 1, SLICE_BYTES):
            tokens = hashed([t.as_buffer().to_pybytes() for t in part.column(1)])
            logs, counts = model.log_probabilities(tokens)
            ends = np.flatnonzero(tokens == END)
            starts = np.concatenate([[0], ends[:-1] + 1])
            sums = [np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), np.log10(counts + 1.0) - floor, logs)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends - starts + 1), *map(pa.array, sums)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, {SCORES}").withColumnRenamed("id", id_col)
    return made.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(id_col: str = "doc_id") -> Column:
    """Every seventh document by the checksum of its id; a NULL id is a training row."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    train_tokens = F.lit(model.n_tokens).cast("bigint").alias("train_tokens")
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", train_tokens, "base_score", "score", "perplexity"
    )


# The same for ORDER = 2. The end token is a blank, the pad an empty string: no word is either of them.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8
), docs AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 2 AS held_out
  FROM documents, crc
), lists AS (
  SELECT row_number() OVER () AS r, *, list_append(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ' ') AS words FROM docs
), tokens AS (
  SELECT r, doc_id, held_out, unnest(words) AS w, unnest(list_prepend('', words[:-2])) AS v FROM lists
), train AS (SELECT v, w FROM tokens WHERE NOT held_out
), single AS (SELECT w, count(*) AS c FROM train GROUP BY w
), pairs AS (SELECT v, w, count(*) AS c FROM train GROUP BY v, w
), before AS (SELECT w, count(*) AS c FROM pairs GROUP BY w
), sizes AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS size FROM single
), levels AS (
  SELECT 1 AS level, c FROM before UNION ALL SELECT 2, c FROM pairs
), seen AS (
  SELECT level, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3,
    count(*) FILTER (c = 4) AS n4 FROM levels GROUP BY level
), raw AS (
  SELECT level, 1 - 2 * n2 / (n1 + 2 * n2) AS d1, 2 - 3 * (n1 / (n1 + 2 * n2)) * n3 / n2 AS d2,
    3 - 4 * (n1 / (n1 + 2 * n2)) * n4 / n3 AS d3, n1 * n2 * n3 > 0 AS enough FROM seen
), taken AS (
  SELECT level, CASE WHEN enough AND least(d1, d2, d3) > 0 THEN d1 ELSE 0.5 END AS d1,
    CASE WHEN enough AND least(d1, d2, d3) > 0 THEN d2 ELSE 1.0 END AS d2,
    CASE WHEN enough AND least(d1, d2, d3) > 0 THEN d3 ELSE 1.5 END AS d3 FROM raw
), cut AS (
  SELECT max(d1) FILTER (level = 1) AS a1, max(d2) FILTER (level = 1) AS a2, max(d3) FILTER (level = 1) AS a3,
    max(d1) FILTER (level = 2) AS b1, max(d2) FILTER (level = 2) AS b2, max(d3) FILTER (level = 2) AS b3 FROM taken
), lowest AS (
  SELECT sum(c) AS total, sum(CASE c WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END) AS rest FROM before, cut
), contexts AS (
  SELECT v, sum(c) AS total, sum(CASE c WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END) AS rest FROM pairs, cut GROUP BY v
), scored AS (
  SELECT t.r, t.doc_id, t.held_out, n, s.c IS NOT NULL AS known, log10((coalesce(s.c, 0) + 1) / (n + size + 1)) AS base,
    (coalesce(greatest(b.c - CASE b.c WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END, 0), 0) + l.rest / (size + 1)) / l.total AS p1,
    coalesce(greatest(p.c - CASE p.c WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END, 0), 0) AS own, x.total, x.rest
  FROM tokens t CROSS JOIN sizes CROSS JOIN cut CROSS JOIN lowest l
  LEFT JOIN single s ON s.w = t.w LEFT JOIN before b ON b.w = t.w
  LEFT JOIN contexts x ON x.v = t.v LEFT JOIN pairs p ON p.v = t.v AND p.w = t.w
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, any_value(n) AS train_tokens,
  sum(base) AS base_score, sum(log10(CASE WHEN total IS NULL THEN p1 ELSE (own + rest * p1) / total END)) AS score,
  pow(10.0, -sum(log10(CASE WHEN total IS NULL THEN p1 ELSE (own + rest * p1) / total END)) / count(*)) AS perplexity
FROM scored GROUP BY r, doc_id, held_out
"""
