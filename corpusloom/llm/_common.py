"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One batch of texts that Python works on at a time; a single longer text is a batch of its own.
CHUNK_BYTES = 2 << 20


# --- tables in the folder that all executors share ---------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of our own if all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: What goes to a Python worker at once, where the session has Spark's own settings: at 10,000 rows long texts would
#: fill gigabytes on either side.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers can import it, and bounds what they get at once."""
    for key, usual, value in BATCHES:
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    where = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(where))
    context._corpusloom_shipped = True


class Workspace:
    """Tables written for one run of an operator, under the shared folder.

    Each is removed by ``drop`` once nothing needs it, or when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._at_exit)

    def save(self, df: DataFrame) -> DataFrame:
        """Writes a table and reads it again: lineage ends there, and a lost executor costs nothing before it."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corpusloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._corpusloom_path)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished steps now, not when the driver next collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

    def _at_exit(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session has ended already; the folder is the cluster's to clean
            pass


def settled(df: DataFrame, work: Workspace) -> DataFrame:
    """``df`` if it only reads files, so that a task that is run again sees its rows in the same order; else a table of it."""

    def reads(node) -> bool:
        kind = node.getClass().getSimpleName()
        return kind == "LogicalRelation" or kind in ("Project", "Filter") and reads(node.child())

    return df if reads(df._jdf.queryExecution().optimizedPlan()) else work.save(df)


#: Size of the bitmap that ``maybe_in`` broadcasts: a 64th as many rows of two longs at most.
FILTER_BITS = 1 << 26


def maybe_in(df: DataFrame, key: Column | str, wanted: DataFrame) -> DataFrame:
    """(row, maybe): each row of ``df`` as a struct, and whether its key may be in the one column of ``wanted``.

    False is certain; true isn't. A bitmap of bounded size tells, so that rows of no use aren't shuffled;
    with more keys than bits most rows pass, and what follows costs what it would without.
    """
    key = F.col(key) if isinstance(key, str) else key
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS))
    word, bit = lambda k: F.shiftright(place(k), 6), lambda k: F.pmod(place(k), F.lit(64)).cast("int")
    own = F.col(wanted.columns[0])
    marks = wanted.select(word(own).alias("word"), bit(own).alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    rows = df.select(F.struct("*").alias("row"), word(key).alias("word"), bit(key).alias("bit"))
    return rows.join(F.broadcast(marks), "word", "left").select("row", F.coalesce(F.getbit("bits", F.col("bit")) == 1, F.lit(False)).alias("maybe"))


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size; for a plain scan, the size of its files. Where it knows nothing or
    multiplies sides of joins, 32 bytes a row and the texts, counted."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if found < 1 << 50:
        return found
    each = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    return int(df.agg(F.sum(sum(each, F.lit(32)).cast("long"))).first()[0] or 0)


def dealt(df: DataFrame, per_part: int) -> int:
    """A number of groups in proportion to the data, so that a group's size stays bounded."""
    return max(32, -(-size_in_bytes(df) // per_part))


# --- text ---------------------------------------------------------------------------------------

#: What ends a word: space, tab, line feed, vertical tab, form feed, carriage return. ``bytes.split`` uses these six.
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words met last."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of every run of k consecutive words: one value for each start that has k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, b = words[:n].copy(), np.uint64(base | 1)
    for j in range(1, k):
        out *= b
        out += words[j : j + n]
    return mix64(out)


def bytes_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each part holds about ``most`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64).cumsum()
        start = 0
        while start < batch.num_rows:
            before = at[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(at, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
