"""Author operators: bylines as rows in, names as rows or arrays out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.functions import bylines as b
from newsflow.functions.fragments import over
from newsflow.plans.scan import explode_once
from newsflow.functions.identity import identity_key


def split_bylines(df: DataFrame, byline: str = "byline") -> DataFrame:
    """One row per part of a byline: list parts, split further around "and"/"et"/"&" where each part stands alone.

    Adds ``line_part``, ``part`` and the uncleaned ``part_text``.
    """
    df = df.withColumn("__raw", F.expr(b.candidate_options(f"array({byline})")))
    df = df.withColumn("__clean", F.col("__raw"))
    for step in b.CLEANING:
        df = df.withColumn("__clean", F.expr(b.over_options(step, "__clean")))

    def pick(raw: str, i: str) -> str:
        around = f"slice(__clean[{i}].options, 2, size(__clean[{i}].options))"
        alone = over("forall", around, lambda p: f"coalesce({b.is_standalone(p)}, false)")
        return (
            f"CASE WHEN size({raw}.options) > 2 AND {alone} THEN slice({raw}.options, 2, size({raw}.options)) "
            f"ELSE slice({raw}.options, 1, 1) END"
        )

    df = df.withColumn("__parts", F.expr(over("transform", "__raw", pick, indexed=True))).drop("__raw", "__clean")
    numbered = over(
        "transform",
        "__parts",
        lambda ps, i: over("transform", ps, lambda p, j: f"struct({i} AS line_part, {j} AS part, {p} AS part_text)", indexed=True),
        indexed=True,
    )
    return explode_once(df.withColumn("__parts", F.expr(f"flatten({numbered})")), "__parts", "__p", "__p.*")


def clean_candidates(df: DataFrame, candidate: str = "candidate", out: str = "name") -> DataFrame:
    """One cleaning pass over single candidates; NULL where the text names nobody."""
    df = df.withColumn("__names", F.array(F.col(candidate)))
    return b.clean_names(df, "__names").withColumn(out, F.col("__names")[0]).drop("__names")


def flag_discardable(df: DataFrame, candidate: str = "candidate", out: str = "discard") -> DataFrame:
    return df.withColumn(out, F.expr(b.is_discardable(candidate)))


def byline_candidates(df: DataFrame, byline: str = "byline", out: str = "candidates") -> DataFrame:
    """Candidates of a byline after the first cleaning pass, role labels behind a name suppressed."""
    df = b.with_candidates(df.withColumn("__lines", F.array(F.col(byline))), "__lines", out)
    return df.drop("__lines")


def with_identity(df: DataFrame, name: str = "name", out: str = "identity") -> DataFrame:
    return df.withColumn(out, identity_key(F.col(name)))


def entry_authors(df: DataFrame, bylines: str = "bylines", out: str = "authors") -> DataFrame:
    """Authors of every entry from its array of bylines."""
    return b.with_authors(df, bylines, out)
