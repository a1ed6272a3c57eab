"""N-gram Jaccard join with PartEnum signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import WordHashes, Workspace, bytes_of, chunks, lists, maybe_in, mix64, table
from corpusloom.llm.near_dedup import grouped, shingle_sets

SHINGLE_WORDS = 4
THRESHOLD = 0.85
#: Largest size of a band to its smallest, about.
GROWTH = 1.25
#: (parts each partition is split into, parts a signature may leave out), cheapest first.
CHOICES = ((1, 0), (3, 1), (4, 1), (5, 2))
#: Shingles that a signature should stand for on average: fewer make texts meet that have little in common.
LEAST = 3.8
#: Share of the sets that may have more hollow partitions than ``Band.spare``.
RARE = 0.06
#: Bands are laid out for sets up to this size.
LARGEST = 1 << 36


class Band(NamedTuple):
    """How sets of first..last shingles, and those of the band below that can be linked to them, are signed."""

    number: int
    first: int
    last: int
    partitions: int
    parts: int
    left_out: int
    spare: int

    def needed(self, size: int, percent: int) -> int:
        """The partitions that a set of ``size`` has to sign: so many that more than ``spare`` agree up to ``left_out``
        parts with any set of this band that it can be linked to."""
        other = min(size * 100 // percent, self.last)
        return min(self.partitions, most_apart(size, other, percent) // (self.left_out + 1) + 1 + self.spare)


def most_apart(m: int, n: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of m and n shingles."""
    return (100 - percent) * (m + n) // (100 + percent)


def _spare(hollow: float) -> int:
    """So many that fewer than ``RARE`` of all sets have more, if ``hollow`` are expected."""
    if hollow >= 4:
        return math.ceil(hollow + 1.6 * math.sqrt(hollow))
    n, p = 0, math.exp(-hollow)
    within = p
    while 1 - within > RARE:
        n += 1
        p *= hollow / n
        within += p
    return n


def bands(percent: int, largest: int = LARGEST) -> list[Band]:
    """The bands of all sizes; a linked pair is in one band or in two neighbours."""
    out: list[Band] = []
    first = 1
    while first <= largest:
        last = max(first, int(first * max(GROWTH, 100 / percent)))
        low = max(-(-percent * first // 100), out[-1].first if out else 1)
        options = []
        for parts, left_out in CHOICES:
            base, spare = most_apart(last, last, percent) // (left_out + 1) + 1, 0
            for _ in range(6):  # more partitions are hollow more often
                held = low / (base + spare) * (parts - left_out) / parts
                spare = _spare((base + spare) * min(1.0, math.comb(parts, left_out) * math.exp(-held)))
                spare = min(spare, base)
            held = low / (base + spare) * (parts - left_out) / parts
            options.append(((base + spare) * math.comb(parts, left_out), held, Band(len(out), first, last, base + spare, parts, left_out, spare)))
        good = [o for o in options if o[1] >= LEAST]
        out.append(min(good)[2] if good else min(options, key=lambda o: o[0] / o[1])[2])
        first = last + 1
    return out


def signatures(values: np.ndarray, own: list[Band], percent: int) -> np.ndarray:
    """The signatures of a set of sorted shingle hashes, in its own band and, if it can be linked to larger sets there, the next.

    The domain of hashes is cut into partitions, each of them into parts; a signature stands for what the set has in
    one choice of a partition's parts. Empty ones say little, so a set leaves them out unless more of its partitions
    than ``spare`` have one: of the partitions in which a linked pair agrees, one at least then has none.
    """
    size, out = len(values), []
    high, low = values >> np.uint64(32), values & np.uint64(0xFFFFFFFF)
    hashed = mix64(values)
    for band in own:
        n = band.needed(size, percent)
        at = (high * np.uint64(band.partitions)) >> np.uint64(32)
        used = int(np.searchsorted(at, n))
        cell = (at[:used] * np.uint64(band.parts) + ((low[:used] * np.uint64(band.parts)) >> np.uint64(32))).astype(np.int64)
        sums = np.zeros(n * band.parts, np.uint64)
        np.add.at(sums, cell, hashed[:used])
        sums, filled = sums.reshape(n, band.parts), np.bincount(cell, minlength=n * band.parts).reshape(n, band.parts)
        chosen = np.array(list(combinations(range(band.parts), band.parts - band.left_out)))
        place = mix64((np.arange(n, dtype=np.uint64)[:, None] << np.uint64(16)) + np.uint64(band.number << 8) + np.arange(len(chosen), dtype=np.uint64)[None, :] + np.uint64(1))
        keys = mix64(sums[:, chosen].sum(axis=2, dtype=np.uint64) + place)
        empty = filled[:, chosen].sum(axis=2) == 0
        out.append(keys[~empty] if empty.any(axis=1).sum() <= band.spare else keys.reshape(-1))
    return np.concatenate(out)


def _signed(k: int, percent: int):
    every = bands(percent)
    lasts = np.array([b.last for b in every])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in chunks(batches):
            sets = shingle_sets(bytes_of(batch.column("text")), words_of, k)
            keys = []
            for s in sets:
                if not len(s):
                    keys.append(np.empty(0, np.uint64))
                    continue
                i = int(np.searchsorted(lasts, len(s)))
                own = [b for b in every[i : i + 2] if 100 * len(s) >= percent * b.first]
                keys.append(signatures(s, own, percent))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    lists(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64), np.array([len(x) for x in keys], np.int64), pa.int64()),
                ],
                ["doc_id", "n_shingles", "set_hash", "keys"],
            )

    return run


def jaccard_join(docs: DataFrame, *, threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """What links of Jaccard likeness ``threshold`` or more connect among ``docs`` (doc_id, text; other columns aren't read).

    Returns (doc_id, n_shingles, component_id), a row for each input row. Exact: any linked pair of texts shares a
    signature, and all pairs that could be linked are compared on their full sets unless links join them already.

    1. Sizes are cut into bands in which, with the band below, all links lie. A linked pair of a band differs in at
       most k shingles; with k // (left_out + 1) + 1 + spare partitions, more than ``spare`` of them differ in
       ``left_out`` shingles or fewer, so each of these agrees in all but ``left_out`` of its parts.
    2. Every choice of parts of every partition gives a signature. Texts of one set are signed once, and a signature
       that one set alone has goes no further: counts are combined before the shuffle, and a bitmap of bounded
       size keeps most others out of the join.
    3. What shares a signature is compared by ``near_dedup.grouped``: with one centre a bucket, then across components.

    Edge cases: a null or wordless text has no shingles, no links, and itself as component. Exact repeats of a row and
    a doc_id that is repeated with other texts are one node. A row without doc_id has no links and a null component_id.
    A text of fewer words than a shingle has them all as its one shingle.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    percent = round(100 * threshold)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = work.save(texts.mapInArrow(_signed(shingle_words, percent), "doc_id long, n_shingles long, set_hash binary, keys array<long>"))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    copies = work.save(usable.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("set_hash", "id"))

    marked = maybe_in(usable, "set_hash", copies.select("set_hash"))
    alone = marked.where("not maybe").select("row.doc_id", "row.n_shingles", "row.keys")
    first = marked.where("maybe").select("row.*").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    classes = alone.unionAll(first.select("doc_id", "n_shingles", "keys"))
    rows = classes.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    met = work.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    work.release()
    tables = work.save(maybe_in(rows, "key", met).where("maybe").select("row.*").join(met, "key").distinct())
    # signatures take most of what was saved, and nothing needs them from here on
    base = work.save(signed.select("doc_id", "n_shingles", "set_hash"))
    work.drop(signed, met)
    work.release()
    usable = base.where("n_shingles > 0 and doc_id is not null")
    sizes = usable.groupBy(F.col("doc_id").alias("id")).agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    labels = grouped(tables, sizes, texts, shingle_words, percent, work)

    base = base.join(copies, "set_hash", "left").withColumn("id", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")))
    return base.join(labels, base.id == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


#: All pairs of documents that share a shingle, and the smallest id that each reaches.
OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words WHERE w IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
edges AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT y, label FROM reach JOIN edges ON node = x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d JOIN (SELECT node, min(label) AS component_id FROM reach GROUP BY node) ON node = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""
