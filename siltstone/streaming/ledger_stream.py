"""The crawl queue as a stream: at-least-once messages, idempotent claims, failures.

Messages are files of a folder; each micro-batch is applied to a snapshot by keyed merges, so a batch
that runs twice leaves the same state. The stream ends when the folder is read (`availableNow`); the
same functions serve a standing query with another trigger.

The dead-letter source (survey J7) is not built: no function or query here handles dead letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import merge
from siltstone.scratch import fresh, written


def message_stream(spark: SparkSession, messages: DataFrame, files: int = 4, per_batch: int = 2) -> DataFrame:
    """A stream that replays `messages` from files of the shared folder."""
    path = fresh(spark, "queue")
    messages.repartition(files).write.parquet(path)
    return spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None]) -> None:
    """Give every micro-batch to `apply`, in order, until the input is read."""
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", fresh(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def claims(stream: DataFrame, snapshot: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first message of each key, over all batches; later ones find the key taken."""
    state = {"now": written(snapshot, "claims"), "done": -1}

    def apply(batch: DataFrame, number: int) -> None:
        if number <= state["done"]:
            return
        state["now"] = written(merge.insert_if_absent(state["now"], batch.select(snapshot.columns), keys, order), "claims")
        state["done"] = number

    run_batches(stream, apply)
    return state["now"]


def partial_failures(stream: DataFrame, fails) -> DataFrame:
    """Ids of failed messages by batch, with the time at which they are seen again (`delay` s later)."""
    spark = stream.sparkSession
    path = fresh(spark, "failed")

    def apply(batch: DataFrame, number: int) -> None:
        failed = batch.where(fails).withColumn("visible_at", F.col("sent_at") + F.col("delay"))
        failed.select("message_id", "visible_at").write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(stream, apply)
    return spark.read.schema("message_id long, visible_at long").option("recursiveFileLookup", "true").parquet(path)


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Transport duplicates within a watermark are dropped; what is left is appended to a table."""
    spark = stream.sparkSession
    path = fresh(spark, "distinct")
    out = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
