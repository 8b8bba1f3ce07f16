"""Event processing on Structured Streaming: duplicate guard, sessions, and how streams are run and published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.streaming.ordered import PROVIDER, ROCKS

def read_events(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of a folder of Parquet files; event time as a timestamp, which watermarks ask for."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Each event once, as long as its repeats come within the lateness; state is dropped behind the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str = "user_id", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """key, start, end, n of sessions that a gap ends."""
    windows = stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return windows.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Runs a stream over what there is now and returns its results as a Parquet table in `folder`, which driver and
    executors share; the checkpoint is there too. In append mode the file sink's log makes every batch count once. In
    complete mode each batch writes all results into a folder of its own, and the last is the table. A run goes on from the
    checkpoint of the one before in the same folder. `timers`: with the state store that processors with timers ask for."""
    spark = stream.sparkSession
    if timers:
        before = spark.conf.get(PROVIDER, None)
        spark.conf.set(PROVIDER, ROCKS)
        try:
            return run_to_table(stream, folder, mode)
        finally:
            spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/table").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/table")
    last: list[int] = []

    def write(frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{folder}/table/{batch_id}")
        last[:] = [batch_id]

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def publish(stream: DataFrame, write, checkpoint: str):
    """One writer: every micro-batch goes through `write(frame, batch_id)`, which makes it visible whole."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
