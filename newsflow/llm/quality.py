"""Quality by nearest-neighbour voting in a latent-semantic space.

The terms of a text are the shapes of its words, of neighbouring words and of its lines, repeats included: whatever the
language, prose and junk differ in how they are set. A word of a long shape gives a term for each piece of it, and one for
its length. Terms are hashed into a fixed number of columns, weighted by tf-idf
and projected on the leading singular vectors of a sample of labelled rows. Labelled vectors are broadcast (at most
``max_rows``); every document is compared with all of them by blocked matrix products, and its nearest ones vote for
their label with their cosine as weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import common

MAX_ROWS = 6_000  # labelled rows the space is fitted on and that vote
TERMS = 512  # columns of hashed terms
DIMENSIONS = 48
NEIGHBOURS = 25
BLOCK = 512  # documents of one matrix product
CUT = 0.3
RUN = re.compile(r"(.)\1+")
PIECE = 12  # shape characters of a term


LONG = 64  # characters from which a word is shaped by arrays and not remembered


def kind(c: str) -> str:
    return "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c


def shape(word: str) -> str:
    """Upper-case letters as X, others as x, digits as 9, runs as one: ``Two-fold!!`` is ``Xx-x!``. The whole word counts."""
    if len(word) <= LONG:
        return RUN.sub(r"\1", "".join(map(kind, word)))
    own, at = np.unique(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    letters = np.array([ord(kind(c)) for c in map(chr, own.tolist())], np.uint32)[at]
    return letters[np.append(True, letters[1:] != letters[:-1])].tobytes().decode("utf-32-le", "surrogatepass")


def column(term: str) -> int:
    return zlib.crc32(term.encode()) % TERMS


def pieces_of(word: str) -> tuple[int, ...]:
    """Columns of the consecutive pieces of a word's shape."""
    whole = shape(word)
    return tuple(column(whole[i : i + PIECE]) for i in range(0, len(whole), PIECE))


class Shapes:
    """Shape numbers of words, remembered per Python worker; those of long words are made anew each time."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Columns of the pieces of all words in order, and of the length classes of words of several pieces."""
        known = self.known
        if len(known) > common.CACHE:
            known.clear()
        long = {w: pieces_of(w) for w in set(words).difference(known)}
        for w in [w for w in long if len(w) <= LONG]:
            known[w] = long.pop(w)
        found = [known[w] if w in known else long[w] for w in words] if long else list(map(known.__getitem__, words))
        classes = [column(f"length {len(p).bit_length()}") for p in found if len(p) > 1]
        return np.fromiter(chain.from_iterable(found), dtype=np.int64), classes


def terms(text: str | None, shapes: Shapes) -> np.ndarray:
    """Counts of the hashed terms of a text."""
    text = text or ""
    words = text.split()
    own, classes = shapes(words)
    out = np.bincount(own, minlength=TERMS).astype(np.float64)
    for c in classes:
        out[c] += 1
    if len(own) > 1:
        out += np.bincount((own[:-1] * 31 + own[1:] * 17 + 7) % TERMS, minlength=TERMS)
    if len(words) > 1:
        same = sum(map(str.__eq__, words[:-1], words[1:]))
        out[column("word again")] += 4 * same
    lines = text.split("\n")
    out[column("line again")] += 8 * (len(lines) - len(set(lines)))
    out[column("word seen before")] += len(words) - len(set(words))
    out[column("a text")] += 1
    return out


@dataclass
class Model:
    """The space (idf and projection), the labelled vectors and their labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of term counts (rows) in the latent space."""
        x = weigh(counts, self.idf) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows, weighted by cosine."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosine = self.place(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-9) ** 8
        return np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf rows of unit length; tf is the share of a term, damped."""
    tf = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0))
    x = tf * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    if not len(labels):
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    x = weigh(counts, idf)
    values, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, : min(dimensions, len(labels))]
    model = Model(idf, axes, np.zeros((0, 1)), labels.astype(float), float(labels.mean()))
    model.vectors = model.place(counts)
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from documents and ``labels`` (doc_id, quality): at most ``max_rows`` of them, by the hash of the id."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(max_rows)
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes()
        for batch in batches:
            got = [terms(t, shapes) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "quality": batch["quality"],
                    "term": [np.flatnonzero(g) for g in got],
                    "n": [g[g > 0] for g in got],
                }
            )

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers
        .dropDuplicates(["doc_id"])
        .mapInPandas(count, "doc_id bigint, quality int, term array<int>, n array<double>")
        .toPandas()  # at most max_rows rows of at most TERMS terms
        .sort_values("doc_id")
    )
    counts = np.zeros((len(rows), TERMS))
    for i, (term, n) in enumerate(zip(rows["term"], rows["n"])):
        counts[i, term] = n
    return fit(counts, rows["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score (0 to 1, higher is better) in place of ``text_col``.

    NULL and empty texts are scored like any other, by the neighbours of a text without words; without labelled rows every
    score is 0.5. Repeated rows are scored alike; other columns pass.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("quality_score")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, shapes = known.value, Shapes()
        for batch in batches:
            texts = batch.pop(text_col).to_list()
            got = [
                own.vote(np.vstack([terms(t, shapes) for t in texts[i : i + BLOCK]])) for i in range(0, len(texts), BLOCK)
            ]
            batch["quality_score"] = np.concatenate(got) if got else np.empty(0)
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != text_col)
    return kept.mapInPandas(run, f"{schema}, quality_score double")


def query(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of held-out rows (crc32 of the id divisible by 5) are not read."""
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", held)
    labels = common.table(spark, sf_dir, "labels").where(~held)
    return score(docs, train(docs, labels)).select(
        "doc_id",
        "held_out",
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= CUT).cast("int").alias("predicted"),
    )
