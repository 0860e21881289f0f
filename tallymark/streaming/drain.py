"""Running a stream over all input present and reading the result back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.session import fresh_path


def table_stream(spark: SparkSession, folder: str, table: str, per_trigger: int = 100) -> DataFrame:
    """A Parquet table of a folder as a file stream, be it one file or a folder of part files.

    The pattern matches just the table's own name, and Spark lists what a matched folder holds.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", str(per_trigger))
        .parquet(f"{folder}/{table}.parque[t]")
    )


def drain_append(stream: DataFrame) -> DataFrame:
    """Append-mode output of all available input, through exactly-once Parquet files."""
    spark = stream.sparkSession
    out = fresh_path(spark, "stream-out")
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", fresh_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_complete(stream: DataFrame) -> DataFrame:
    """Complete-mode result of an aggregation, through Parquet files in the shared folder.

    Each micro-batch writes the whole result anew; the last one is read.
    """
    spark = stream.sparkSession
    out = fresh_path(spark, "stream-out")
    spark.createDataFrame([], stream.schema).write.parquet(out)
    query = (
        stream.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
        .option("checkpointLocation", fresh_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
