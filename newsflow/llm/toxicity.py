"""Toxicity by cumulative-link ordinal regression.

Grades 0 (clean), 1 and 2 (severe) are predicted from sparse text features: words and their first four and five
characters. All thresholds share one weight vector: P(grade > j) = sigmoid(w.x - theta_j) with theta_0 < theta_1. The
result is the expected grade. Features are chosen by their association with the label, counted in Spark over the
training rows, equal texts once; the weights are fitted on the same rows, of which there are at most ``max_rows``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import common

MAX_ROWS = 12_000  # labelled rows the model is fitted on
MAX_FEATURES = 4_096
HELD = 100  # rows whose counted features a worker holds at a time
MIN_ROWS = 5  # training rows that must hold a feature, copies included
MAX_SHARE = 0.2  # of the clean training rows that may hold it: function words say how long a text is, not what
REJECT = 0.35  # least probability of grade 1 or more
WORD = re.compile(r"\w+")
PREFIXES = (4, 5)


def features_of(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings, marked apart."""
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n))


def counted(text: str | None) -> Counter:
    """Features of a text with their counts."""
    out: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for f in features_of(word):
            out[f] += n
    return out


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted features of labelled rows, HELD rows at a time."""
    for part in common.slices(batches, HELD):
        got = [counted(t) for t in part.column("text").to_pylist()]
        columns = [
            part.column("doc_id").cast(pa.int64()),
            part.column("toxic").cast(pa.int32()),
            part.column("copies"),
            pa.array([list(c) for c in got], pa.list_(pa.string())),
            pa.array([list(c.values()) for c in got], pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "copies", "f", "n"])


@dataclass
class Model:
    """Shared weights by feature and the ordered thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray
    memory: dict[str, tuple] = field(default_factory=dict, repr=False)

    def exceed(self, text: str | None) -> np.ndarray:
        """P(grade > j) for each threshold."""
        memory = self.memory
        if len(memory) > common.CACHE:
            memory.clear()
        words = WORD.findall((text or "").lower())
        for w in set(words).difference(memory):
            memory[w] = tuple(f for f in features_of(w) if f in self.weights)
        seen: Counter = Counter()
        for fs in filter(None, map(memory.__getitem__, words)):
            seen.update(fs)
        score = sum(self.weights[f] * np.log1p(n) for f, n in sorted(seen.items()))
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def fit(row: np.ndarray, col: np.ndarray, count: np.ndarray, grades: np.ndarray, n_features: int, l2: float = 1e-3, steps: int = 800):
    """Weights and thresholds of the proportional-odds model, by accelerated gradient descent.

    Row ``row[i]`` holds feature ``col[i]`` ``count[i]`` times; ``grades`` of the rows are 0 to K - 1. The loss is that of the K - 1 binary questions
    "is the grade above j", which share the weights; the thresholds are kept in order by positive gaps. Rows of the
    rarer side of each question weigh as much in all as those of the other side.
    """
    levels = int(grades.max(initial=0))
    if levels == 0:
        return np.zeros(n_features), np.array([20.0])
    val, n_rows = np.log1p(count.astype(float)), len(grades)
    above = np.array([grades > j for j in range(levels)])
    share = np.clip(above.mean(axis=1, keepdims=True), 1e-6, 1 - 1e-6)
    balance = np.where(above, 0.5 / share, 0.5 / (1 - share)) / n_rows / levels
    w, raw = np.zeros(n_features), np.zeros(levels)
    w_old, raw_old = w, raw
    norm = max(1.0, np.bincount(row, val * val, n_rows).max(initial=1.0))
    rate = 3.0 / (norm + levels + 1)
    for step in range(steps):
        momentum = step / (step + 3)
        yw, yr = w + momentum * (w - w_old), raw + momentum * (raw - raw_old)
        theta = np.concatenate([yr[:1], yr[:1] + np.cumsum(np.exp(yr[1:]))])
        score = np.bincount(row, yw[col] * val, n_rows)
        p = 1 / (1 + np.exp(-np.clip(score[None, :] - theta[:, None], -500, 500)))
        gap = (p - above) * balance
        gw = np.bincount(col, gap.sum(axis=0)[row] * val, n_features) + l2 * yw
        gt = -gap.sum(axis=1)
        gr = np.concatenate([[gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * np.exp(yr[1:])])
        w_old, raw_old = w, raw
        w, raw = yw - rate * gw, yr - rate * gr
    return w, np.concatenate([raw[:1], raw[:1] + np.cumsum(np.exp(raw[1:]))])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """A model from labelled documents: ``labels`` has doc_id and toxic (0 or 1).

    Severity is derived: a toxic row is of grade 2 when it holds at least the median number of toxic cues (features that
    stand in toxic rows nine times in ten), else of grade 1. Rows of equal text count as one, toxic if any of them is;
    common words are left out by their share of the clean rows, so none for being common among toxic ones. At most ``max_rows``
    labelled ids are used, chosen by their hash; of rows with one id the smallest text counts, so no more texts than that
    are fitted or reach the driver. Without toxic rows the model never rejects.
    """
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(max_rows)
    )

    rows = common.store(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.count("*").alias("copies"))
        .groupBy("text")
        .agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.sum("copies").alias("copies"))
        .mapInArrow(feature_rows, "doc_id bigint, toxic int, copies bigint, f array<string>, n array<int>")
    )
    toxic = F.col("toxic") > 0
    totals = rows.agg(F.count("*").alias("n"), F.sum(toxic.cast("int")).alias("t")).first()
    if not totals.t:
        return Model({}, np.array([20.0]))
    table = rows.select(toxic.alias("toxic"), "copies", F.explode("f").alias("f")).groupBy("f").agg(
        F.count("*").alias("n"), F.sum(F.col("toxic").cast("int")).alias("t"), F.sum("copies").alias("held")
    )
    rate = totals.t / totals.n
    surprise = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate) or 1.0))
    best = (
        table.where((F.col("held") >= MIN_ROWS) & (F.col("n") - F.col("t") <= MAX_SHARE * (totals.n - totals.t)))
        .orderBy(F.abs(surprise).desc(), "f")
        .limit(max_features)
        .collect()  # at most max_features rows
    )
    index = {r.f: i for i, r in enumerate(best)}
    cues = {r.f for r in best if r.t >= 0.9 * r.n}
    known = spark.sparkContext.broadcast((index, cues))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cues = known.value
        for part in common.slices(batches, HELD):
            held = [[*zip(fs, ns)] for fs, ns in zip(part.column("f").to_pylist(), part.column("n").to_pylist())]
            pairs = [[(index[f], n) for f, n in p if f in index] for p in held]
            columns = [
                part.column("doc_id"),
                part.column("toxic"),
                pa.array([sum(n for f, n in p if f in cues) for p in held], pa.int32()),
                pa.array([[f for f, _ in p] for p in pairs], pa.list_(pa.int32())),
                pa.array([[n for _, n in p] for p in pairs], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "cues", "col", "val"])

    sample = rows.mapInArrow(narrow, "doc_id bigint, toxic int, cues int, col array<int>, val array<int>").toPandas()
    sample = sample.sort_values(["doc_id", "cues"], kind="stable")
    bad = sample["toxic"].to_numpy() > 0
    severe = sample["cues"].to_numpy() >= max(2, np.median(sample["cues"].to_numpy()[bad]))
    grades = bad.astype(int) + (bad & severe)
    row = np.repeat(np.arange(len(sample)), sample["col"].map(len).to_numpy())
    col, val = (np.concatenate([*sample[c], np.empty(0, np.int32)]).astype(np.int32) for c in ("col", "val"))
    weights, thresholds = fit(row, col, val, grades, len(index))
    return Model({f: float(weights[i]) for f, i in index.items()}, thresholds)


MADE = "tox_severity double, tox_probability double, tox_rejected boolean"


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with tox_severity (expected grade), tox_probability (of grade 1 or more) and tox_rejected.

    NULL and empty texts are clean, long ones are read whole. Repeated rows are scored alike. Columns of these names are
    replaced; others pass.
    """
    kept = docs.drop(*(c.split()[0] for c in MADE.split(", ")))
    return _scored(kept, model, text_col, MADE)


def not_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score`` does not reject, with just their own columns, whatever these are called."""
    return _scored(docs, model, text_col, None)


def _scored(docs: DataFrame, model: Model, text_col: str, made: str | None) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    names = [f.name for f in docs.schema]
    place = names.index(text_col)
    added = [c.split()[0] for c in made.split(", ")] if made else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*known.value)
        for part in common.slices(batches):
            p = np.array([own.exceed(t.as_py()) for t in part.column(place)]).reshape(part.num_rows, -1)
            rejected = p[:, 0] >= REJECT
            if made:
                columns = [*part.columns, pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])
            else:
                yield part.filter(pa.array(~rejected))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, {made}" if made else schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected. The model learns from the labelled rows among them."""
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return not_rejected(docs, model)
