"""Incremental jobs: resumable batches over arriving files, milestones and a confirmation gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phases of a corpus job, in order (fixed values).
PHASES = ("native-conversion", "publishing-native", "gpu-ocr", "final-publication", "audit", "complete")


def arriving(spark: SparkSession, path: str, schema, files_a_batch: int = 96) -> DataFrame:
    """A stream of Parquet files, so many in a batch; the checkpoint remembers which are done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_available(stream: DataFrame, each_batch, checkpoint: str, mode: str = "append") -> None:
    """Everything that has arrived, in batches; after a failure a rerun goes on with the batch that failed."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def progress_sink(folder: str, every: int):
    """A foreachBatch function that appends each batch's count and its new milestones under `folder`.

    Batches are written by id, so that a repeated batch replaces its own rows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.count("*").alias("documents")).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")
        done = spark.read.parquet(f"{folder}/counts").where(F.col("batch") <= batch_id).agg(F.sum("documents").alias("done"))
        earlier = spark.read.parquet(f"{folder}/counts").where(F.col("batch") < batch_id).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("before"))
        step = F.lit(every).cast("long")
        steps = done.crossJoin(earlier).where(F.col("done") >= every)  # one row beside one row
        steps = steps.select(F.explode(F.sequence(step, F.col("done"), step)).alias("milestone"), "before").where("milestone > before")
        steps.select("milestone").write.mode("overwrite").parquet(f"{folder}/milestones/batch={batch_id}")

    return each


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tumbling counts and sums by event type, closed when the watermark passes. An extra of this engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def gate(samples: DataFrame, real_mib: int = 64) -> DataFrame:
    """samples: stream, seq, reason, dedicated_mib. Reasons that pass the confirmation gate.

    The second sample running with a reason passes, one without a reason starts anew, and a real
    allocation passes at once; a stream's state is whether its last sample had a reason.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = state.get[0] if state.exists else False
        for frame in frames:
            out = []
            for row in frame.sort_values("seq").itertuples():
                has = isinstance(row.reason, str)
                if has and (waiting or row.dedicated_mib >= real_mib):
                    out.append((key[0], row.seq, row.reason))
                waiting = has
            yield pd.DataFrame(out, columns=["stream", "seq", "reason"])
        state.update((waiting,))

    return samples.groupBy("stream").applyInPandasWithState(step, "stream string, seq long, reason string", "waiting boolean", "append", "NoTimeout")
