"""Changes that arrive as a stream, merged by key: of each key the last one stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.lifecycle import last_wins
from corpusloom.sources.snapshots import SnapshotTable

PLACE = "_place"


def merge_stream(
    spark: SparkSession, source: str, schema: T.StructType, key: tuple[str, ...], order: tuple[str, ...], target: str, checkpoint: str, *, kind: str = "parquet", files_a_batch: int = 1
) -> SnapshotTable:
    """Takes every new file under ``source``, then stops; returns the table at ``target``, which ``merged`` reads.

    The last change of each key, in ``order``, is the query's state: changes are reduced before they are shuffled, so a
    key that has most of them costs no more than others, and a late one that is older than what stands changes
    nothing. A micro-batch adds the keys that it has changed as one commit under its number, so one that is repeated after
    a failure is there once.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(kind).load(source)
    # nulls are before all, as in a batch
    last = F.max_by(F.struct(*schema.names), F.struct(*order)).alias("last")
    latest = stream.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(last).select("last.*")
    table = SnapshotTable(spark, target)

    def write(frame: DataFrame, number: int) -> None:
        table.append(frame, run=(checkpoint, number))

    query = latest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return table


def merged(table: SnapshotTable, key: tuple[str, ...]) -> DataFrame:
    """The last change of each key. What a later commit says of a key stands, as the state has seen all before it."""
    return last_wins(table.read(order=PLACE), key, PLACE).drop(PLACE)


def compact(table: SnapshotTable, key: tuple[str, ...]) -> None:
    """One part with a row a key instead of a part for each commit; a conflict with a stream that goes on is raised."""
    version = table.latest()
    if version is not None and len(version.parts) > 1:
        table.replace(last_wins(table.read(version, order=PLACE), key, PLACE).drop(PLACE), base=version.number)
