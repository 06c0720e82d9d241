"""Embedding pipeline: passage text, chunks, padding, inference, pooling, normalisation, audits, pairing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.text import collapse_ws, non_empty_text
from newsflow.plans.scan import position_segment, running

MAX_SEQUENCE_LENGTH = 512  # fixed value: used where the model file names none


def passage_text(title: Column, summary: Column) -> Column:
    """``passage: title: T`` and, when it is not blank, `` | summary: S``."""
    short = non_empty_text(collapse_ws(summary))
    return F.concat_ws(
        " | ", F.concat(F.lit("passage: title: "), collapse_ws(title)), F.concat(F.lit("summary: "), short)
    )


def with_passage(sources: DataFrame, out: str = "passage") -> DataFrame:
    return sources.withColumn(out, passage_text(F.col("title"), F.col("summary")))


def with_chunks(
    sources: DataFrame, size: int = 1, task: list[str] | None = None, position: str = "source_pos", width: int = 65_536
) -> DataFrame:
    """Chunk number of every source: ``size`` sources each, in order, per task.

    Positions are cut into ranges, so numbering a very large task is spread over tasks of the cluster.
    """
    keys = task or ["task_id", "execution_id"]
    numbered = running(
        sources, keys, [position], position_segment(F.col(position), width), total={"__n": F.lit(1).cast("bigint")}
    )
    chunk = F.floor((F.col("__n") - 1) / max(size, 1)).cast("bigint")
    return numbered.withColumn("chunk", chunk).drop("__n")


def embed(
    sources: DataFrame,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    batch_size: int = 32,
    text: str = "passage",
    out: str = "embedding",
    error: str | None = None,
    within: list[str] | None = None,
) -> DataFrame:
    """Vectors of a text column from a pluggable model.

    ``make_model`` runs once per Python worker and returns a function from a batch of texts to a 2-D array.
    Spark decides the partitions; rows need no shuffle. With ``error`` a batch on which the model fails gets NULL vectors
    and the message in that column, and the others go on; without it the failure ends the job. Batches end where the
    values of the columns ``within`` change, so that a failure stays with the task it belongs to.
    """
    size = max(batch_size, 1)

    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch, keys in batches:
            vectors: list = []
            messages: list = []
            changes = np.flatnonzero(np.diff(keys.to_numpy())) + 1
            edges = [0, *changes.tolist(), len(batch)]
            cuts = [(at, min(at + size, end)) for begin, end in zip(edges, edges[1:]) for at in range(begin, end, size)]
            for at, end in cuts:
                texts = batch.iloc[at:end].to_numpy()
                try:
                    made = np.asarray(model(texts), dtype=np.float32)
                    if len(made) != len(texts):
                        raise ValueError(f"{len(made)} vectors for {len(texts)} texts")
                    vectors += list(made)
                    messages += [None] * len(texts)
                except Exception as failure:  # noqa: BLE001  whatever the model raises belongs to its batch
                    if error is None:
                        raise
                    vectors += [None] * len(texts)
                    messages += [str(failure)] * len(texts)
            yield pd.DataFrame({"v": vectors, "e": messages})

    # Taken for non-deterministic so that the optimizer never computes it twice.
    run = F.pandas_udf(predict, "v array<float>, e string").asNondeterministic()
    key = F.xxhash64(*within) if within else F.lit(0).cast("bigint")
    rows = sources.withColumn("__made", run(F.col(text), key))
    columns = {out: F.col("__made.v")} | ({error: F.col("__made.e")} if error else {})
    return rows.withColumns(columns).drop("__made")


def pad_batches(
    encoded: DataFrame, batch: list[str], max_length: int = MAX_SEQUENCE_LENGTH, ids: str = "input_ids"
) -> DataFrame:
    """Token arrays cut and zero-padded to the longest of their batch (at least 1, at most ``max_length``).

    A missing mask counts as 1 and a missing type id as 0.
    """
    length = F.least(F.size(ids), F.lit(max_length))
    longest = encoded.groupBy(*batch).agg(F.greatest(F.max(length), F.lit(1)).alias("sequence_length"))
    n = F.least(F.size(ids), F.col("sequence_length"))
    missing = F.col("sequence_length") - n

    def padded(values: Column) -> Column:
        return F.concat(F.slice(values, F.lit(1), n), F.array_repeat(F.lit(0).cast("bigint"), missing))

    def aligned(name: str, default: int) -> Column:
        given = F.col(name) if name in encoded.columns else F.lit(None).cast("array<bigint>")
        return F.transform(
            F.col(ids),
            lambda _, i: F.coalesce(F.get(given, i), F.lit(default).cast("bigint")),
        )

    return encoded.join(longest, batch).withColumns(
        {
            ids: padded(F.col(ids).cast("array<bigint>")),
            "attention_mask": padded(aligned("attention_mask", 1)),
            "token_type_ids": padded(aligned("token_type_ids", 0)),
        }
    )


def mean_pool(
    states: DataFrame, dimensions: int, doc: list[str], mask: str = "mask", vector: str = "vector", out: str = "pooled"
) -> DataFrame:
    """Mean of a document's token vectors where the mask is positive; no live token gives the zero vector.

    A live vector of another size than ``dimensions`` ends the job. One sum per dimension in a single groupBy: partial
    sums leave each input partition as one row per document, so neither long documents nor wide vectors multiply rows.
    """
    live = F.col(mask) > 0
    size = F.coalesce(F.size(vector), F.lit(0))
    wrong = F.raise_error(F.format_string("token vector of size %d, expected %d", size, F.lit(dimensions)))
    fitting = F.when(size == dimensions, F.col(vector)).otherwise(wrong.cast(states.schema[vector].dataType))
    states = states.withColumn(vector, F.when(live, fitting))
    sums = [F.sum(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"__d{i}") for i in range(dimensions)]
    pooled = states.groupBy(*doc).agg(F.count_if(live).alias("tokens"), *sums)
    values = [F.when(F.col("tokens") > 0, F.col(f"__d{i}") / F.col("tokens")).otherwise(F.lit(0.0)) for i in range(dimensions)]
    return pooled.select(*doc, "tokens", F.array(*values).alias(out))


def l2_normalize(vector: Column) -> Column:
    """Unit length; the zero vector stays. Computed in double, returned as float."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    scaled = F.transform(
        F.array(norm), lambda n: F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)).otherwise(vector.cast("array<double>"))
    )[0]
    return scaled.cast("array<float>")


def with_unit_vector(df: DataFrame, vector: str = "pooled", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, l2_normalize(F.col(vector)))


def audit_shapes(batches: DataFrame, states: DataFrame, batch: list[str]) -> DataFrame:
    """Batches whose token states do not fit the declared shape, with the reason.

    ``batches``: batch key, shape array<int>. ``states``: batch key, vector, mask (NULL = not delivered).
    """
    counted = states.groupBy(*batch).agg(
        F.sum(F.coalesce(F.size("vector"), F.lit(0))).alias("state_count"), F.count("mask").alias("mask_count")
    )
    rows = batches.join(counted, batch, "left").withColumns(
        {"state_count": F.coalesce("state_count", F.lit(0)), "mask_count": F.coalesce("mask_count", F.lit(0))}
    )
    size = F.aggregate("shape", F.lit(1).cast("bigint"), lambda acc, x: acc * x)
    masks = (F.get("shape", F.lit(0)) * F.get("shape", F.lit(1))).cast("bigint")
    reason = (
        F.when(
            F.size("shape") != 3,
            F.format_string("unexpected embedding tensor rank: expected 3, got %d", F.size("shape")),
        )
        .when(
            F.col("state_count") != size,
            F.format_string("unexpected embedding tensor size: expected %d, got %d", size, "state_count"),
        )
        .when(
            F.col("mask_count") != masks,
            F.format_string("unexpected attention mask size: expected %d, got %d", masks, "mask_count"),
        )
    )
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull())


def audit_counts(sources: DataFrame, vectors: DataFrame, task: list[str] | None = None) -> DataFrame:
    """Tasks whose number of vectors differs from their number of sources, with the failure message."""
    keys = task or ["task_id"]
    expected = sources.groupBy(*keys).agg(F.count("*").alias("expected"))
    produced = vectors.groupBy(*keys).agg(F.count("*").alias("produced"))
    both = expected.join(produced, keys, "full_outer").na.fill(0, ["expected", "produced"])
    message = F.format_string(
        "embedding count mismatch for task %d: expected %d, got %d", F.col(keys[0]), "expected", "produced"
    )
    return both.where(F.col("expected") != F.col("produced")).withColumn("error_message", message)


def pair_vectors(sources: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Source id with its vector, by (task, position), widened to double."""
    return sources.join(vectors, keys).select(
        *keys, "id", F.col("embedding").cast("array<double>").alias("embedding")
    )
