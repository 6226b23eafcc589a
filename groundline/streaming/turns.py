"""Live conversations: turns as a stream, repeated rows dropped within the watermark, counted by day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.runtime import shared_folder

#: How late a row may come; what is known of older rows is dropped from the state.
LATENESS = "45 days"


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The turns under ``path`` (a Parquet file or folder) as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if not path.endswith(".parquet") else path + "*")


def counted(turns: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """day (seconds), role and turns; complete state, so every trigger gives the counts so far."""
    once = turns.withColumn("sent_at", F.col("sent_at").cast("timestamp")).withWatermark("sent_at", lateness).dropDuplicates(["conv_id", "turn", "role", "text", "sent_at"])
    return once.groupBy(F.unix_timestamp(F.date_trunc("day", "sent_at")).alias("day"), "role").agg(F.count("*").alias("turns"))


def daily_turns(spark: SparkSession, path: str, lateness: str = LATENESS) -> DataFrame:
    """Run the stream over what is there and give the final counts, a table in the shared folder that each trigger writes anew."""
    folder = f"{shared_folder(spark)}/turns_{uuid.uuid4().hex}"

    def write(counts: DataFrame, _: int) -> None:
        counts.write.mode("overwrite").parquet(f"{folder}/counts")

    run = counted(stream(spark, path), lateness).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/counts")
