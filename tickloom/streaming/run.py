"""Start streams over files and drain them into a table of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table as a file stream, a bounded number of files per micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", f"{name}*.parquet")
        .parquet(sf_dir)
    )


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over everything available and return what it wrote."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = shared_path(spark, "stream")
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
