"""Running a stream over what is there and reading its result back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.session import first_partitions, run_folder

STORE_SETTING, PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
# State that grows with the input: a row is not looked up once more to be counted, and a commit writes what changed.
WIDE_STATE = {
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A file source; ``files_per_batch`` bounds how much one micro-batch takes in."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


def close_input(df: DataFrame, folder: str, at: str, last: Column, **values: object) -> None:
    """Add the closing record of a finished input: the time ``last`` (an aggregate over ``df``), all else null.

    It is written after the data, so a file stream takes it last; it moves the watermark over what still waits.  A join
    drops rows with null keys before they reach the watermark: there, ``values`` gives keys that no row has.
    """
    others = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != at]
    df.agg(last.alias(at)).select(at, *others).select(*df.columns).write.mode("append").parquet(folder)


@contextmanager
def _state_store(spark: SparkSession, timers: bool, wide: bool = False) -> Iterator[None]:
    """Streams with timers need the RocksDB store; a query takes the settings when it starts.

    ``wide``: for state that grows with the input, which then does not lie in the heap either; the number of its shares is
    fixed when the stream starts.
    """
    before = {key: spark.conf.get(key) for key in (STORE_SETTING, PARTITIONS)}
    ours = {key: value for key, value in WIDE_STATE.items() if wide and spark.conf.get(key, None) is None}
    if timers or wide:
        spark.conf.set(STORE_SETTING, ROCKSDB)
    if wide:
        spark.conf.set(PARTITIONS, str(first_partitions(spark)))
    for key, value in ours.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        for key in ours:
            spark.conf.unset(key)


def drain(stream: DataFrame, label: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Process everything available into a table in the shared folder and read that table.

    Both the output and the checkpoint live in the shared folder, so a lost executor or a restart resumes.
    """
    spark = stream.sparkSession
    folder = run_folder(spark, label)
    with _state_store(spark, timers):
        query = (
            stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(
    stream: DataFrame, label: str, each: Callable[[DataFrame, int, str], None], timers: bool = False, wide: bool = False
) -> str:
    """Hand every micro-batch to ``each(batch, batch_id, folder)``; gives the folder.

    ``each`` must write a batch to a place named by its id, so that a repeated batch overwrites itself.  A batch is written
    and read again in the caller's session: a stream's own has no adaptive execution and a fixed number of partitions.
    """
    spark = stream.sparkSession
    folder = run_folder(spark, label)

    def run(batch: DataFrame, batch_id: int) -> None:
        place = f"{folder}/batches/batch={batch_id}"
        batch.write.mode("overwrite").parquet(place)
        each(spark.read.schema(batch.schema).parquet(place), batch_id, f"{folder}/out")

    with _state_store(spark, timers, wide):
        query = (
            stream.writeStream.foreachBatch(run)
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return f"{folder}/out"
