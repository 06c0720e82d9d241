"""Micro-batches as batch plans: each sees its own rows and the tables that the one before it has left.

Keyed state that a key's rows reach one by one in one call grows with the hottest key of a trigger. Here a micro-batch is a
DataFrame like any other, so the batch operators run on it (partial aggregates, segmented scans), and what a key carries
over is one narrow row of a small table. Every batch writes its tables and its output under its own number below the
stream's folder; a batch that runs again after a failure reads the same tables and overwrites what it had written, so each
takes effect once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

Tables = dict[str, DataFrame]
Once = Callable[[DataFrame], DataFrame]
Step = Callable[[DataFrame, Tables, Once], tuple[DataFrame, Tables]]


@dataclass
class MicroBatches:
    """A stream and the step that turns (rows of a batch, tables before it) into (output rows, tables after it).

    The step's third argument stores what several of its results need, so that a batch computes it once.
    ``replaced`` tables (name -> schema) are written whole by every batch: they hold a row for each live key. ``grown`` ones
    are added to; every ``compact`` batches what ``keep`` still lets through of them is written anew, so a batch adds
    what it found and never rewrites what lies there. All lie below ``folder``, which all executors share.
    """

    stream: DataFrame
    step: Step
    folder: str
    replaced: dict[str, str] = field(default_factory=dict)
    grown: dict[str, str] = field(default_factory=dict)
    keep: Callable[[str, DataFrame, Tables], DataFrame] | None = None
    compact: int = 16

    @property
    def spark(self) -> SparkSession:
        return self.stream.sparkSession

    def writer(self) -> DataStreamWriter:
        checkpoint = self.stream.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint")
        return checkpoint.foreachBatch(lambda rows, number: self.run(rows, number))

    def drain(self) -> DataFrame:
        """Run until the input is used up and read what all batches have given."""
        self.writer().trigger(availableNow=True).start().awaitTermination()
        return self.read()

    def run(self, rows: DataFrame, number: int) -> None:
        """One micro-batch."""
        scratch = f"{self.folder}/scratch/{number:09d}"
        made = []

        def once(df: DataFrame) -> DataFrame:
            """Written and read back: computed once, safe from lost executors, and a short plan for what follows."""
            made.append(f"{scratch}/{len(made)}")
            df.write.mode("overwrite").parquet(made[-1])
            return df.sparkSession.read.schema(df.schema).parquet(made[-1])

        rows = rows.persist()
        try:
            held = self.tables(number, rows.sparkSession)
            out, left = self.step(rows, held, once)
            for name in self.replaced:
                left[name].write.mode("overwrite").parquet(self._path(name, number))
            for name in self.grown:
                found = left[name]
                if number % self.compact == self.compact - 1:
                    found = self.keep(name, held[name].unionByName(found), left) if self.keep else held[name].unionByName(found)
                found.write.mode("overwrite").parquet(self._path(name, number))
            out.write.mode("overwrite").parquet(f"{self.folder}/out/batch={number}")
        finally:
            rows.unpersist()
            self._delete(scratch)
        for name in self.replaced:  # what this batch has read stays, in case it runs again
            self._delete(self._path(name, number - 2))
        if number % self.compact == 0:
            for name in self.grown:
                for old in range(number - 1 - self.compact, number - 1):
                    self._delete(self._path(name, old))

    def tables(self, number: int, spark: SparkSession | None = None) -> Tables:
        """The tables as batch ``number`` finds them."""
        found = {}
        for name, schema in self.replaced.items():
            paths = [self._path(name, number - 1)] if number > 0 else []
            found[name] = self._read(spark, schema, paths)
        for name, schema in self.grown.items():
            base = number - number % self.compact - 1  # the last batch that wrote all there was
            found[name] = self._read(spark, schema, [self._path(name, n) for n in range(max(0, base), number)])
        return found

    def latest(self) -> Tables:
        """The tables after the last batch that has run."""
        return self.tables(1 + max(self._numbers(), default=-1))

    def read(self) -> DataFrame:
        """Output rows of all batches."""
        if self._numbers():
            return self.spark.read.parquet(f"{self.folder}/out").drop("batch")
        rows = self.spark.createDataFrame([], self.stream.schema)
        return self.spark.createDataFrame([], self.step(rows, self.tables(0), lambda df: df)[0].schema)

    def _read(self, spark: SparkSession | None, schema: str, paths: list[str]) -> DataFrame:
        spark = spark or self.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _path(self, name: str, number: int) -> str:
        return f"{self.folder}/state/{name}/v={number:09d}"

    def _files(self, path: str):  # noqa: ANN202
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _delete(self, path: str) -> None:
        files, place = self._files(path)
        files.delete(place, True)  # nothing happens where there is none

    def _numbers(self) -> list[int]:
        files, place = self._files(f"{self.folder}/out")
        if not files.exists(place):
            return []
        return [int(f.getPath().getName().removeprefix("batch=")) for f in files.listStatus(place) if f.isDirectory()]
