"""The daily sync as a stream: each file of additions or removals is applied once.

Files are named so that a day's removals and additions come in one batch: ``<day>.remove.txt`` and ``<day>.add.txt``; a file of
another name is an error. Within a batch days are applied in order and removals go first. Every day is a publication that also
says how far the stream has come, so a batch that is run again, after a failure between days too, changes nothing twice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sync as Y
from ..operators.segment import Segmenter
from ..plans.commits import Files
from ..plans.snapshot import Store

NAME = r"^(.+)\.(add|remove)\.txt$"


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """file, raw of all files in folder, as a stream."""
    return spark.readStream.format("text").schema("value string").option("lineSep", "\n").load(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))


def apply_batch(store: Store, segmenter: Segmenter, batch: DataFrame, stream: str = "", number: int = 0) -> list[str]:
    """One publication for each day in the batch that the stream has not applied yet; the days."""
    files = [r["file"] for r in batch.select("file").distinct().collect()]  # two a day
    kinds = batch.withColumn("day", F.regexp_extract("file", NAME, 1)).withColumn("kind", F.regexp_extract("file", NAME, 2)).withColumn("line_no", F.monotonically_increasing_id())
    days = [r["day"] for r in kinds.select("day").distinct().orderBy("day").collect()]
    if "" in days:
        raise ValueError(f"names must be <day>.add.txt or <day>.remove.txt: {sorted(files)}")
    done = store.state()["applied"].get(stream) if stream else None
    todo = [day for day in days if done is None or [number, day] > done]
    for day in todo:
        own = kinds.where(F.col("day") == day)
        pick = lambda kind: own.where(F.col("kind") == kind).select("line_no", "raw")
        store.sync(Y.delta(pick("add"), pick("remove"), segmenter, store.next_seq()), {stream: [number, day]} if stream else None)
    return todo


def run_available(store: Store, segmenter: Segmenter, folder: str, checkpoint: str) -> None:
    """Apply the files that no earlier run has seen, then stop."""

    def run(batch: DataFrame, number: int) -> None:
        stream = json.loads(Files(store.spark, checkpoint).read("metadata"))["id"]  # stays the same for one checkpoint
        batch = batch.persist()
        try:
            apply_batch(store, segmenter, batch, stream, number)
        finally:
            batch.unpersist()

    query = lines(store.spark, folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
