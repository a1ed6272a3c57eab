"""Shards of bounded size by extendible hashing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import Workspace, table

#: Bytes of text in a shard at most.
SHARD_BYTES = 16 << 20
#: Bits of the hash: 15 hexadecimal digits.
BITS = 60
#: Bits that one pass looks at beyond those in use.
STEP = 8


def row_hash(*keys: str) -> Column:
    """60 bits of md5 over the keys as text, null as the empty text."""
    text = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: str, bits: Column) -> Column:
    return F.call_function("shiftright", F.col(h), (F.lit(BITS) - bits).cast("int"))


def shard_directory(sized: DataFrame, limit: int, work: Workspace, start: int) -> DataFrame:
    """(depth, prefix, bytes, rows): the buckets that extendible hashing of ``sized`` (h, n_bytes) ends with.

    A bucket of more than ``limit`` bytes splits on the next bit, others don't. Rows are summed by a
    prefix of ``start`` bits before the shuffle; only where buckets of that depth are still too large
    are their rows summed by STEP further bits, and so on. Buckets at the last bit stay as they are.
    """
    found = None
    low, high = 0, min(BITS, start)
    rows = sized
    while True:
        fine = rows.groupBy(_prefix("h", F.lit(high)).alias("fine")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))
        depths = F.explode(F.sequence(F.lit(low), F.lit(high)))
        levels = fine.select("fine", "n_bytes", "n_rows", depths.alias("depth"))
        levels = levels.groupBy("depth", F.call_function("shiftright", F.col("fine"), (F.lit(high) - F.col("depth")).cast("int")).alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"))
        levels = work.save(levels)
        over = levels.where(F.col("n_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        fits = (F.col("n_bytes") <= limit) | (F.col("depth") == BITS)
        whole = levels.where(fits & (F.col("depth") == 0)) if low == 0 else levels.limit(0)
        leaves = levels.where(fits & (F.col("depth") > low)).withColumn("above", F.call_function("shiftright", F.col("prefix"), F.lit(1))).join(over, ["depth", "above"], "left_semi").drop("above")
        leaves = whole.unionByName(leaves)
        found = leaves if found is None else found.unionByName(leaves)
        still = levels.where((F.col("depth") == high) & (F.col("n_bytes") > limit)).select(F.col("prefix").alias("fine"))
        if high == BITS or still.isEmpty():
            return found
        rows = rows.withColumn("fine", _prefix("h", F.lit(high))).join(still, "fine", "left_semi").drop("fine")
        low, high = high, min(BITS, high + STEP)


def shard(docs: DataFrame, *, limit: int = SHARD_BYTES, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Assigns each document to a shard of at most ``limit`` bytes of text.

    Returns doc_id, n_bytes, depth, shard (the first ``depth`` bits of the row's hash, as text; empty
    if one shard holds all), shard_bytes, shard_rows. The directory has an entry for each prefix as
    long as the deepest bucket; rows find their shard by an equi-join on it. No text is shuffled.

    Edge cases: a null text has 0 bytes. A document beyond the limit, or documents of one hash that are
    together beyond it, split down to the last bit; such a shard keeps them and shows its size. Rows of
    a hot key can be told apart by further ``keys``. An empty table gives no rows. A limit below 1 is refused.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    work = Workspace(docs.sparkSession, "shards")
    sized = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), row_hash(*keys).alias("h"))
    sized = work.save(sized)
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    start = min(BITS, 3 + max(1, 4 * total // limit).bit_length())
    buckets = shard_directory(sized, limit, work, start).select("depth", "prefix", F.col("n_bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"))
    buckets = work.save(buckets)
    deepest = buckets.agg(F.max("depth")).first()[0] or 0
    common = min(deepest, start)  # entries a bucket has in the directory: 2 ** (common - depth)
    slots = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(common) - F.col("depth")).cast("int"))
    first = F.call_function("shiftleft", F.col("prefix"), (F.lit(common) - F.col("depth")).cast("int"))
    shallow = buckets.where(F.col("depth") <= common).withColumn("slot", F.explode(F.sequence(first, first + slots - 1)))
    deep = buckets.where(F.col("depth") > common).withColumn("slot", F.call_function("shiftright", F.col("prefix"), (F.col("depth") - F.lit(common)).cast("int")))
    directory = shallow.unionByName(deep)
    joined = sized.withColumn("slot", _prefix("h", F.lit(common))).join(directory, "slot").where(_prefix("h", F.col("depth")) == F.col("prefix"))
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth").cast("int"), F.lit("0")))
    return joined.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), name.alias("shard"), "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, *, limit: int = SHARD_BYTES) -> None:
    """Writes ``docs``, whose doc_id must be unique, to one folder a shard below ``path``."""
    where = shard(docs, limit=limit).select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"))
    out = docs.join(where, docs.doc_id == where._id).drop("_id").withColumn("shard", F.concat(F.lit("s"), "_shard")).drop("_shard")
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


#: So small a limit that the documents of a small table split too.
FINE_BYTES = 64 << 10


def sharding_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), limit=FINE_BYTES)


def shard_sql(limit: int = SHARD_BYTES) -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
levels AS (
  SELECT d.depth, h >> ({BITS} - d.depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM sized, (SELECT unnest(range(0, {BITS + 1}))::BIGINT AS depth) d GROUP BY ALL),
placed AS (
  SELECT doc_id, n_bytes, h, l.depth, l.prefix, shard_bytes, shard_rows, row_number() OVER (PARTITION BY doc_id ORDER BY l.depth) AS n
  FROM sized JOIN levels l ON l.prefix = h >> ({BITS} - l.depth) WHERE shard_bytes <= {limit} OR l.depth = {BITS})
SELECT doc_id, n_bytes, depth::INTEGER AS depth, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), {BITS}, '0'), depth::INTEGER) END AS shard, shard_bytes, shard_rows
FROM placed WHERE n = 1
"""
