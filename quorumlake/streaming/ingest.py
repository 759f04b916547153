"""Ingest as a stream: marker scan and gates are stateless, tallies run along.

The batch gates work on streaming frames unchanged; ``availableNow`` drains what
is there in bounded batches and keeps its place in the checkpoint, so a restarted
job goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.session import scratch
from quorumlake.sources.scans import gated


def gate_stream(rows: DataFrame, tests: list, otherwise: str, out: str, *, checkpoint: str) -> None:
    """Write gated rows of a streaming frame as Parquet, partitioned by gate."""
    query = (gated(rows, tests, otherwise).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .partitionBy("gate").outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def windowed_tally(rows: DataFrame, time: str, label: str, width: str, late: str) -> DataFrame:
    """Counts by window and label of a streaming (or plain) frame; rows later than ``late`` are out."""
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    return marked.groupBy(F.window(time, width).alias("w"), label).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), label, "n")


def drain(rows: DataFrame, name: str) -> DataFrame:
    """Run a streaming aggregate to the end of its input and return its last state."""
    out, check = scratch(rows.sparkSession, name), scratch(rows.sparkSession, f"{name}-checkpoint")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated batch replaces its own folder

    rows.writeStream.outputMode("complete").option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    done = rows.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, epoch long").parquet(out)
    last = done.agg(F.max("epoch").alias("epoch"))  # one row
    return done.join(F.broadcast(last), "epoch").drop("epoch")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, whether it is one file or a folder of files."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream, files = spark.readStream.schema(table.schema), table.inputFiles()
    if len(files) == 1 and files[0].endswith("/events.parquet"):
        return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.parquet(f"{sf_dir}/events.parquet")
