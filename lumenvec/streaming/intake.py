"""Stream intake: duplicate suppression within a watermark and snapshots by batch.

Intake state is bounded by the watermark.  A delivery that is older than the
watermark when it arrives is dropped, whether it is a duplicate or the first of
its number: the delay has to exceed what a source may be late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path
from ..sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    return fresh_path(spark, name)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    out, state = _folder(spark, name), _folder(spark, name + "-state")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    once = twice.withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["event_id"])
    return _run(once.select("event_id", "user_id", "event_type"), "dedup")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and latest sequence per type; each batch writes the whole state, the last one wins."""
    path = _folder(spark, "snapshots")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{path}/number={number}")

    counted = _stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("latest"))
    query = counted.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", _folder(spark, "snapshots-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.parquet(f"{path}/number=*")
    last = kept.agg(F.max("number").alias("number"))
    return kept.join(F.broadcast(last), "number").select("event_type", "n", "latest")  # one row
