"""Resumable scoring: a stream over files of pairs, so a stopped run goes on where it was."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def signature(settings: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


class Guard:
    """A signature beside an output; other settings are refused instead of mixed in."""

    def __init__(self, spark: SparkSession, place: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/signature.json")
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def verify_or_record(self, settings: Mapping[str, object]) -> None:
        want = signature(settings)
        if self.fs.exists(self.path):
            stream = self.fs.open(self.path)
            have = bytes(stream.readAllBytes()).decode()
            stream.close()
            if have != want:
                raise ValueError("output was written with other settings")
        else:
            out = self.fs.create(self.path, True)
            out.write(bytearray(want.encode()))
            out.close()


def score_incrementally(spark: SparkSession, source: str, place: str, score: Callable[[DataFrame], DataFrame], settings: Mapping[str, object]) -> None:
    """Scores the files of ``source`` that no earlier run did and adds them to ``place``/scores.

    The checkpoint in ``place`` makes each file count once; a batch that is run again after a
    failure overwrites its own partition.
    """
    Guard(spark, place).verify_or_record(settings)
    schema = spark.read.parquet(source).schema

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{place}/scores/batch={number}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def scores(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.parquet(f"{place}/scores")
