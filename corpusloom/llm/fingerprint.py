"""Bottom-k document fingerprints; DataFrame functions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import WORD_BREAK, ascii_lower, size_in_bytes, table

SHINGLE_WORDS = 5
#: Hashes in a sketch; a likeness of 1/3 is estimated with a standard error of 0.04.
K = 128
#: Bytes of input for each range of documents, and ranges at most; a larger range spills.
_RANGE_BYTES, _RANGES = 4 << 20, 1 << 16
#: Ids in the sample that a range is cut by.
_RANGE_SAMPLE = 32
_SPAN = 2.0**64


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """64-bit hashes of the word shingles, repeats included; with fewer words the whole sequence is one, without words none."""
    split = F.filter(F.split(ascii_lower(text), WORD_BREAK), lambda w: w != "")
    return F.transform(F.array(split), lambda w: F.when(F.size(w) >= words, _runs(w, words)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>")))[0]


def _runs(w: Column, words: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(words))))


def sketch(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together, shingles across their border aside."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Exact below k; else (k - 1) over the share of the hash range that the k smallest take."""
    share = (F.element_at(s, k).cast("double") + F.lit(_SPAN / 2)) / F.lit(_SPAN)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest of both that are in each; 1 if neither has any."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    r = resemblance(a, b, k)
    shared = r * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(s: Column) -> Column:
    """16 hexadecimal digits a hash, in order."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame, *, k: int = K, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, sketch (array<long>), n_shingles (estimated), fingerprint (text) of each row of ``docs``.

    Works row by row, without a shuffle. A null text is the empty text, whose sketch and fingerprint are empty.
    """
    s = docs.select("doc_id", sketch(shingle_hashes(F.coalesce("text", F.lit("")), words), k).alias("sketch"))
    return s.select("doc_id", "sketch", distinct_shingles(F.col("sketch"), k).alias("n_shingles"), as_text(F.col("sketch")).alias("fingerprint"))


def _longs(values: list[int]) -> Column:
    """An array of constants, made of one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _larger(falling: list[int], value: Column) -> Column:
    """How many of the constants, which fall, are larger than ``value``; found by halving."""
    steps = _longs([1 << i for i in reversed(range(len(falling).bit_length()))])
    return F.aggregate(steps, F.lit(0).cast("long"), lambda at, step: F.when(F.get(_longs(falling), (at + step - 1).cast("int")) > value, at + step).otherwise(at)).cast("int")


def _cuts(ids: DataFrame, ranges: int, total: int) -> list[int]:
    """Where ranges of about as many ids are cut, from a sample in proportion to ``ranges``, not to the ids; any cuts give right results."""
    if ranges < 2:
        return []
    share = min(1.0, _RANGE_SAMPLE * ranges / max(1, total))
    some = ids.sample(share, seed=7) if share < 1 else ids
    return [int(x) for x in some.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)]


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next``, a struct of ``columns`` of the row that follows in descending doc_id; after the last comes the first.

    Rows are dealt to ranges of doc_id of about equal size and ordered within; only the first row of each
    range goes to the range before it. Rows without doc_id come last; rows with the same are ordered by a hash
    of ``columns``, then by these. A doc_id of many rows, and the rows without one, are cut into ranges of that hash.
    """
    ranges = int(min(_RANGES, max(1, size_in_bytes(docs) // _RANGE_BYTES)))
    total, nameless = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first() if ranges > 1 else (1, 0)
    cuts = Counter(_cuts(docs.where("doc_id is not null").select("doc_id"), ranges, total - nameless))
    bounds = sorted(cuts, reverse=True)
    place = F.col("_place")
    part = F.when(F.col("doc_id").isNotNull(), place).otherwise(len(bounds) + 1).cast("long")
    # of a hash range: from 0 in the order of the hash
    slice_ = lambda n: F.least(F.floor((F.col("_hash").cast("double") + F.lit(_SPAN / 2)) / F.lit(_SPAN) * n), n - 1).cast("long")
    times = F.get(_longs([cuts[b] for b in bounds]), place)
    hot = (F.get(_longs(bounds), place) == F.col("doc_id")) & (times > 1)
    within = F.when(F.col("doc_id").isNull(), slice_(F.lit(max(1, round(ranges * nameless / max(1, total)))))).when(hot, 1 + slice_(times))
    placed = docs.withColumn("_hash", F.xxhash64(*columns)).withColumn("_place", _larger(bounds, F.col("doc_id")))
    dealt = placed.withColumn("_part", part * (_RANGES + 2) + within.otherwise(F.lit(0))).drop("_place")
    row = F.struct(*columns)
    window = Window.partitionBy("_part").orderBy(F.col("doc_id").desc_nulls_last(), "_hash", *columns)
    led = dealt.withColumn("_lead", F.lead(row).over(window))
    heads = dealt.groupBy("_part").agg(F.max(F.struct("doc_id", -F.col("_hash"))).alias("_head"))
    heads = heads.select(F.col("_part").alias("_of"), F.col("_head.doc_id").alias("_id"), F.negative("_head.col2").alias("_least"))  # three numbers a range
    firsts = dealt.join(F.broadcast(heads), (F.col("_part") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_least")))
    firsts = firsts.groupBy("_part").agg(F.min(row).alias("_first"))
    order = Window.orderBy("_part")  # one number a range
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = heads.select(F.col("_of").alias("_part"))
    after = numbers.select("_part", F.coalesce(F.lead("_part").over(order), F.first("_part").over(whole)).alias("_after"))
    following = after.join(firsts.select(F.col("_part").alias("_after"), F.col("_first").alias("_next_first")), "_after").drop("_after")
    return led.join(following, "_part").withColumn("next", F.coalesce("_lead", "_next_first")).drop("_part", "_lead", "_next_first", "_hash")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(docs, ["text"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), sketch(shingle_hashes(F.col("text"))).alias("own"), sketch(shingle_hashes(F.col("next.text"))).alias("next_own"), F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr(F.col("next.text"), F.lit(1), half)).alias("edited"))
    edited = edited.withColumn("new", sketch(shingle_hashes(F.col("edited"))))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("new")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("new")).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own")).alias("near_next"),
    )
