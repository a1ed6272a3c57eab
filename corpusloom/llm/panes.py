"""Hourly panes of an event stream, with early results, revisions of them, and a horizon after which panes are forgotten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._common import Workspace, table

BATCHES = 8
HOUR, DAY = 3_600_000_000, 86_400_000_000  # microseconds
#: A pane is first written when the watermark is so far past its end, and forgotten when it is so far.
WAIT, KEEP = 6 * HOUR, 4 * DAY
#: Spark's own watermark starts at 1970 and takes what is older for late, so the stream's clock runs so far ahead.
ERA = 4_383_000 * DAY
FED = "click_id long, kind string, event long, hour long, cents long"
PANES = "kind string, hour long, n_rows long, cents long"
#: For the session of the streaming query. One batch a start: nothing runs but what was fed. Sums live in the executors' heap,
#: a short row a pane that isn't closed, of one version: a native store a partition and start takes megabytes even if it is
#: empty, so hundreds of partitions would take gigabytes for a few thousand panes. Those of an ended start are let go soon.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "spark.sql.streaming.maxBatchesToRetainInMemory": "1",
    "spark.sql.streaming.stateStore.maintenanceInterval": "2s",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def micros(name: str, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp; of one without a zone as its clock shows them, whatever the session's zone."""
    c = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    clock = F.hour(c).cast("long") * HOUR + F.minute(c).cast("long") * 60_000_000
    return F.unix_date(c.cast("date")).cast("long") * DAY + clock + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def fed(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """FED and batch: each click once, dealt to batches."""
    rows = clicks.where("ts is not null and arrived_at is not null and click_id is not null")
    day = F.unix_date(F.col("arrived_at").cast("date")).cast("long")
    cents = F.floor(100 * F.col("value") + 0.5)
    cents = F.when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), F.lit(0).cast("long")).otherwise(cents)
    late = F.crc32(F.col("click_id").cast("string")) % 30 - 23
    q = F.pmod(day, F.lit(batches))
    event = micros("ts", clicks.schema["ts"].dataType) - (day - q) * DAY
    rows = rows.select(
        F.col("click_id").cast("long").alias("click_id"), F.coalesce("kind", F.lit("none")).alias("kind"), event.alias("event"), cents.cast("long").alias("cents"),
        F.least(F.lit(batches - 1).cast("long"), q + F.greatest(F.lit(0).cast("long"), late)).cast("int").alias("batch"),
    )
    once = rows.groupBy("click_id").agg(F.min(F.struct("batch", "event", "kind", "cents")).alias("c"))
    hour = F.call_function("div", F.col("c.event") - F.pmod(F.col("c.event"), F.lit(HOUR)), F.lit(HOUR))
    return once.select("click_id", "c.kind", "c.event", hour.alias("hour"), "c.cents", "c.batch")


def past(watermark: int | None, by: int) -> Column:
    """Whether the watermark is ``by`` microseconds past the end of an hour."""
    return F.lit(False) if watermark is None else (F.col("hour") + 1) * HOUR + by <= watermark


class Feed:
    """A folder that a stream reads: a batch's files get there whole, by a rename, and no sooner than it is fed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.staged, self.path = spark, f"{root}/staged", f"{root}/feed"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def stage(self, rows: DataFrame) -> None:
        rows.write.partitionBy("batch").parquet(self.staged)
        self._fs.mkdirs(self._path(self.path))

    def give(self, batch: int) -> DataFrame:
        """Feeds a batch, also one without rows; returns its rows."""
        here, there = (self._path(f"{x}/batch={batch}") for x in (self.staged, self.path))
        if self._fs.exists(here):
            self._fs.rename(here, there)
        else:
            self.spark.createDataFrame([], FED).write.parquet(there.toString())
        return self.spark.read.schema(FED).parquet(there.toString())


def _advance(session: SparkSession, feed: Feed, checkpoint: str, watermark: int | None, keep: int) -> None:
    """Starts the query on its checkpoint, lets it take what was fed since, and ends it.

    Panes are sums by hour and kind in its state. Their end and the watermark tell Spark which to forget.
    """
    rows = session.readStream.schema(f"{FED}, batch int").parquet(feed.path).where(~past(watermark, keep))
    timed = rows.withColumn("time", F.timestamp_micros(F.col("event") + ERA)).withWatermark("time", f"{keep // 1000} milliseconds")
    panes = timed.groupBy(F.window("time", "1 hour"), "kind").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("cents"))
    query = panes.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _state(session: SparkSession, checkpoint: str, batch: int) -> DataFrame:
    """The panes held after a batch."""
    found = session.read.format("statestore").option("batchId", batch).load(checkpoint)
    hour = F.call_function("div", F.unix_micros("key.window.start") - ERA, F.lit(HOUR))
    n_rows, cents = (F.col("value")[c.name] for c in found.schema["value"].dataType.fields[:2])
    return found.select(F.col("key.kind").alias("kind"), hour.alias("hour"), n_rows.alias("n_rows"), cents.alias("cents"))


def revisions(clicks: DataFrame, *, batches: int = BATCHES, wait: int = WAIT, keep: int = KEEP) -> DataFrame:
    """(batch, record, kind, hour, click_id, n_rows, cents): what a stream of ``clicks`` writes about its panes.

    Clicks (click_id, ts, arrived_at, kind, value) are dealt to batches and fed in order to a stateful query that is
    started anew for each, on one checkpoint in a new folder under spark.checkpoint.dir. The watermark is the latest event
    time of earlier batches. A batch's records: ``late`` rows of panes that are closed; ``emit`` for panes that are
    due; ``retract`` and ``replace`` for panes written before that have new rows; after the last batch ``final``
    for all not written yet.

    The state after a batch, read with the statestore reader, is compared with what was held after the one before it, to
    find what changed; that table also tells which panes have been written and aren't closed. Everything but a number a
    batch stays in tables dealt by pane.

    Edge cases: rows without ts, arrived_at or click_id belong to no batch and are left out. Rows of one click_id count as
    one, that of the smallest (batch, event time, kind, cents). A null kind is ``none``; a null or non-finite value
    is 0 cents. Hours before 1970 are negative. No clicks at all: no records. Other columns aren't read.
    """
    spark = clicks.sparkSession
    work = Workspace(spark, "panes")
    session = spark.newSession()
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        session.conf.set(key, value)
    feed, checkpoint = Feed(spark, work.root), f"{work.root}/query"
    feed.stage(fed(clicks, batches))
    latest = {r.batch: r.event for r in spark.read.schema(f"{FED}, batch int").parquet(feed.staged).groupBy("batch").agg(F.max("event").alias("event")).collect()}  # a number a batch

    held = spark.createDataFrame([], f"{PANES}, written boolean")
    records, watermark = [], None
    for batch in range(batches):
        rows = feed.give(batch)
        _advance(session, feed, checkpoint, watermark, keep)
        before = held.select("kind", "hour", F.struct("n_rows", "cents").alias("b"), "written")
        after = _state(session, checkpoint, batch).select("kind", "hour", F.struct("n_rows", "cents").alias("a"))
        panes = before.join(after, ["kind", "hour"], "full")
        due, written = past(watermark, wait), F.coalesce("written", F.lit(False))
        now = F.coalesce("a", "b")  # a pane that is due and closed at once has left the state
        changed = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a.n_rows") != F.col("b.n_rows"))
        none = F.lit(None).cast("struct<record:string,n_rows:bigint,cents:bigint>")

        def entry(record: str, of: Column) -> Column:
            return F.struct(F.lit(record).alias("record"), of["n_rows"].alias("n_rows"), of["cents"].alias("cents"))

        revised = written & changed
        made = [F.when(~written & due, entry("emit", now)), F.when(revised, entry("retract", F.col("b"))), F.when(revised, entry("replace", F.col("a")))]
        made.append(F.when(~written & ~due, entry("final", now)) if batch == batches - 1 else none)
        panes = work.save(panes.select("kind", "hour", "a.n_rows", "a.cents", (written | due).alias("written"), F.filter(F.array(*made), lambda x: x.isNotNull()).alias("made")))
        told = panes.select("kind", "hour", F.explode("made").alias("m")).select(F.lit(batch).cast("long").alias("batch"), "m.record", "kind", "hour", F.lit(-1).cast("long").alias("click_id"), "m.n_rows", "m.cents")
        late = rows.where(past(watermark, keep)).select(F.lit(batch).cast("long").alias("batch"), F.lit("late").alias("record"), "kind", "hour", "click_id", F.lit(1).cast("long").alias("n_rows"), "cents")
        records += [told, late]

        held = panes.where("n_rows is not null").select("kind", "hour", "n_rows", "cents", "written")
        if batch in latest:
            watermark = max(latest[batch], latest[batch] if watermark is None else watermark)
    out = records[0]
    for more in records[1:]:
        out = out.unionAll(more)
    return out


def op12_pane_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(table(spark, sf_dir, "clicks"))


#: Each pane at each batch: its totals so far, without late rows, and the batch that writes it first.
OP12_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t),
once AS (SELECT DISTINCT click_id, ts, epoch_us(arrived_at) // 86400000000 AS d, coalesce(kind, 'none') AS kind, coalesce(floor(100 * value + 0.5), 0)::BIGINT AS cents FROM clicks WHERE ts IS NOT NULL),
dealt AS (SELECT click_id, kind, cents, d % 8 AS q, epoch_us(ts) - (d - d % 8) * 86400000000 AS event FROM once),
rows AS (SELECT click_id, kind, cents, event, (event - ((event % 3600000000) + 3600000000) % 3600000000) // 3600000000 AS hour,
  least(7, q + greatest(0, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(click_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda x, y: xor(x >> 8, t[1 + xor(x & 255, y)]))) % 30 - 23)) AS batch FROM dealt, crc),
b AS (SELECT unnest(range(8)) AS batch),
w AS (SELECT b.batch, max(event) AS w FROM b LEFT JOIN (SELECT batch, max(event) AS event FROM rows GROUP BY batch) m ON m.batch < b.batch GROUP BY b.batch),
marked AS (SELECT r.*, w IS NOT NULL AND (hour + 1) * 3600000000 + 345600000000 <= w AS late FROM rows r JOIN w USING (batch)),
adds AS (SELECT kind, hour, batch, count(*) AS n, sum(cents) AS c FROM marked WHERE NOT late GROUP BY ALL),
panes AS (SELECT kind, hour, min(batch) AS since FROM adds GROUP BY ALL),
life AS (SELECT kind, hour, since, min(w.batch) AS first FROM panes LEFT JOIN w ON w.batch >= since AND (hour + 1) * 3600000000 + 21600000000 <= w GROUP BY ALL),
sofar AS (SELECT kind, hour, b.batch, first, sum(n)::BIGINT AS n, sum(c)::BIGINT AS c, coalesce(sum(n) FILTER (adds.batch < b.batch), 0)::BIGINT AS n0, coalesce(sum(c) FILTER (adds.batch < b.batch), 0)::BIGINT AS c0
  FROM life JOIN b ON b.batch >= since JOIN adds USING (kind, hour) WHERE adds.batch <= b.batch GROUP BY ALL),
out AS (SELECT batch, 'late' AS record, kind, hour, click_id, 1 AS n_rows, cents FROM marked WHERE late
UNION ALL SELECT batch, 'emit', kind, hour, -1, n, c FROM sofar WHERE batch = first
UNION ALL SELECT batch, 'retract', kind, hour, -1, n0, c0 FROM sofar WHERE batch > first AND n > n0
UNION ALL SELECT batch, 'replace', kind, hour, -1, n, c FROM sofar WHERE batch > first AND n > n0
UNION ALL SELECT batch, 'final', kind, hour, -1, n, c FROM sofar WHERE first IS NULL AND batch = 7)
SELECT batch::BIGINT AS batch, record, kind, hour::BIGINT AS hour, click_id::BIGINT AS click_id, n_rows::BIGINT AS n_rows, cents::BIGINT AS cents FROM out
"""
