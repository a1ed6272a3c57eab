"""MinHash near-duplicate detection with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import WordHashes, Workspace, bytes_of, chunks, lists, maybe_in, mix64, rolled, table
from corpusloom.llm.components import connected_components

SHINGLE_WORDS = 5
THRESHOLD = 0.75
#: Two collections of HALVES half keys of ROWS minhashes each: HALVES * HALVES table keys of 2 * ROWS minhashes
#: out of 2 * HALVES * ROWS. A pair of likeness s meets with probability (1 - (1 - s**ROWS)**HALVES)**2:
#: 0.995 at 0.75, 0.9996 at 0.8, 0.0003 at 0.2.
HALVES, ROWS = 16, 4
_BASE = 0x9E3779B97F4A7C15
#: Elements hashed at once; fits the second-level cache.
_BLOCK = 1 << 15
_MASK = (1 << 64) - 1


def shingle_sets(texts: list[bytes | None], words_of: WordHashes, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A-Z are lower-cased and words split at the six ASCII spaces. With fewer than k words the whole
    sequence is one shingle; a text without words, or null, has none.
    """
    out = []
    for text in texts:
        words = text.lower().split() if text else []
        if not words:
            out.append(np.empty(0, np.uint64))
        elif len(words) < k:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64))
        else:
            out.append(np.unique(rolled(words_of.of(words), k, _BASE)))
    return out


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minhashes for each of the sets, none of them empty."""
    rng = np.random.default_rng(20240229)
    flip = rng.integers(0, 2**64, n, np.uint64)
    times = rng.integers(0, 2**64, n, np.uint64) | np.uint64(1)
    out = np.empty((len(sets), n), np.uint64)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= _BLOCK):
            total += len(sets[end])
            end += 1
        values = np.concatenate(sets[start:end])
        at = np.zeros(end - start, np.int64)
        np.cumsum([len(s) for s in sets[start : end - 1]], out=at[1:])
        buffer = np.empty_like(values)
        for j in range(n):
            np.bitwise_xor(values, flip[j], out=buffer)
            np.multiply(buffer, times[j], out=buffer)
            out[start:end, j] = np.minimum.reduceat(buffer, at)
        start = end
    return out


def _half_keys(sets: list[np.ndarray], halves: int, rows: int) -> np.ndarray:
    """2 * halves keys a set; each also tells its place, so equal keys are of the same half."""
    mins = minhashes(sets, 2 * halves * rows).reshape(len(sets), 2 * halves, rows)
    key = np.broadcast_to(mix64(np.arange(1, 2 * halves + 1, dtype=np.uint64)), (len(sets), 2 * halves)).copy()
    for r in range(rows):
        key = mix64(key * np.uint64(_BASE) + mins[:, :, r])
    return key


def _signatures(k: int, halves: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in chunks(batches):
            sets = shingle_sets(bytes_of(batch.column("text")), words_of, k)
            full = [s for s in sets if len(s)]
            keys = _half_keys(full, halves, rows) if full else np.empty((0, 2 * halves), np.uint64)
            counts = np.array([2 * halves if len(s) else 0 for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    lists(keys.reshape(-1).view(np.int64), counts, pa.int64()),
                ],
                ["doc_id", "n_shingles", "set_hash", "halves"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in chunks(batches):
            sets = shingle_sets(bytes_of(batch.column("text")), words_of, k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "members"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            keep = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set. ``part`` tells the texts of one id apart."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = part.column("members").to_pylist()
            values = [np.frombuffer(x, np.int64) for x in sets]
            counts = [len(v) for v in values]
            own = [np.asarray(part.column("id"), np.int64), np.asarray(part.column("component"), np.int64), np.array([xxhash.xxh3_64_intdigest(x) for x in sets], np.uint64).view(np.int64), np.array(counts, np.int64)]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(c, counts)) for c in own), pa.array(np.concatenate(values))], ["id", "component", "part", "size", "shingle"])


def _band(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size.cast("double"), F.lit(1.0))) * 28).cast("int")


def _across(members: DataFrame, sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """All pairs (a, b) of ``members`` (id, component) in two components whose sets can be linked; some can't. Saved, each once.

    Sets are read in one order, with what no other component has first and then from rare to frequent. A link of
    sizes m and n takes 100 * both >= percent * (m + n - both) for ``both`` common shingles, and in either set all
    of them stand at or after the first common one. So a pair meets at a shingle that leaves enough in both sets, and
    the larger set need look for a shingle only among sizes it leaves enough for. A text that is a little
    too far from the one it was copied from has too many shingles that others lack to meet them at all.
    """
    rows = members.join(sets, "id").mapInArrow(_shingles, "id long, component long, part long, size long, shingle long")
    held = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    # pairs inside the component that has a shingle most often aren't formed
    held = held.groupBy("shingle").agg(F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("most"), (F.min("component") < F.max("component")).alias("several"))
    several = work.save(held.where("several").drop("several"))
    work.release()
    # most shingles are of one component: a bitmap keeps most of those out of the shuffle, the join the rest
    rows = maybe_in(rows, "shingle", several.select("shingle")).where("maybe").select("row.*").join(several, "shingle")
    own = Window.partitionBy("id", "part")
    before = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("n", "shingle")) - 1
    rows = rows.withColumn("rest", F.col("size") - before).withColumn("rare", F.col("component") != F.col("most"))
    rows = rows.where(100 * F.col("rest") >= percent * F.col("size")).select("shingle", "id", "component", "size", "rest", "rare")
    far = F.least(F.floor((100 + percent) * F.col("rest") / percent) - F.col("size"), F.col("size"))
    larger = rows.withColumn("band", F.explode(F.sequence(_band(percent * F.col("size") / 100), _band(far)))).alias("x")
    smaller = rows.where((100 + percent) * F.col("rest") >= 2 * percent * F.col("size")).withColumn("band", _band(F.col("size"))).alias("y")
    fit = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component"))
    fit &= (F.col("y.size") < F.col("x.size")) | ((F.col("y.size") == F.col("x.size")) & (F.col("y.id") < F.col("x.id")))
    fit &= (100 + percent) * F.least("x.rest", "y.rest") >= percent * (F.col("x.size") + F.col("y.size"))
    met = [larger.where("rare").join(smaller, fit), larger.where("not rare").join(smaller.where("rare"), fit)]
    out = work.save(met[0].unionAll(met[1]).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    work.drop(several)
    work.release()
    return out


def near_dedup(docs: DataFrame, *, threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text; other columns are not read).

    Two documents are linked if the Jaccard likeness of their word-shingle sets is ``threshold`` or
    more; groups are what links connect. Returns (doc_id, n_shingles, component_id, kept), a row for
    each input row.

    1. Each text gives 2 * halves half keys. Texts of one shingle set are one class from here on.
    2. A half key that only one class has can't meet; each class forms its table keys by pairing
       what is left of its first collection with what is left of its second.
    3. In each table bucket all members are compared with one centre on their full sets, so the work
       grows with a bucket's size, not its square.
    4. Members of buckets whose members the links don't connect yet meet across components at
       shingles that are rare enough for a link (``_across``), and those pairs are compared.
       No bucket is capped and no candidate dropped.

    Edge cases: a null or wordless text has no shingles and no links. Exact repeats of a row are in one
    group and all kept or not, as they share a doc_id. A doc_id that is repeated with other texts joins
    the groups of those for which it is the smallest. A row without doc_id has no links, a null
    component_id, and is kept.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near")
    percent = round(100 * threshold)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = work.save(texts.mapInArrow(_signatures(shingle_words, halves, rows), "doc_id long, n_shingles long, set_hash binary, halves array<long>"))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = work.save(usable.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size"), F.first("halves").alias("halves")))

    half = classes.select("id", F.posexplode("halves").alias("place", "key"))
    met = half.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    left = half.join(met, "key").groupBy("id").agg(*(F.collect_set(F.when(side, F.col("key"))).alias(n) for n, side in (("first", F.col("place") < halves), ("second", F.col("place") >= halves))))
    tables = left.select("id", F.explode("first").alias("p"), "second").select("id", "p", F.explode("second").alias("q")).select(F.xxhash64("p", "q").alias("key"), "id")
    tables = work.save(tables)
    sizes = classes.groupBy("id").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    labels = grouped(tables, sizes, texts, shingle_words, percent, work)

    several = classes.where("copies > 1").select("set_hash", "id")
    base = signed.select("doc_id", "n_shingles", "set_hash").join(several, "set_hash", "left").withColumn("id", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")))
    out = base.join(labels, base.id == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def grouped(tables: DataFrame, sizes: DataFrame, texts: DataFrame, shingle_words: int, percent: int, work: Workspace) -> DataFrame:
    """(node, component) of what links of ``percent`` connect among ids that share buckets.

    ``tables``: saved rows (key, id), each once, any linked pair in a bucket of one key at least; it is dropped.
    ``sizes``: (id, lo, hi), the smallest and largest set of an id. ``texts``: (doc_id, text).
    Each bucket is compared with one centre; what stays apart meets across components (``_across``).
    """
    # many buckets hold the same classes; one of each is enough
    marks = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    met = tables.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *marks).where("n > 1")
    met = met.groupBy("n", "mark0", "mark1").agg(F.min("key").alias("key"))
    shared = work.save(tables.join(met.select("key", "n"), "key"))
    work.drop(tables)
    work.release()
    # the text that others are copies of meets more of them than they do each other: it makes the best centre
    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    buckets = work.save(shared.join(weight.join(sizes, "id"), "id").select("key", "id", "weight", "lo", "hi"))
    work.drop(shared)
    work.release()

    wanted = buckets.select(F.col("id").alias("doc_id")).distinct()
    # a set too many, where the bitmap lets one pass, costs less than a shuffle of the texts
    sets = work.save(maybe_in(texts, "doc_id", wanted).where("maybe").select("row.*").mapInArrow(_sets(shingle_words), "id long, members binary"))
    work.release()
    centre = buckets.groupBy("key").agg(F.max_by(F.struct("id", "lo", "hi"), F.struct(F.col("weight"), -F.col("id"))).alias("c"))
    others = buckets.join(centre, "key").where("id <> c.id")
    # sets whose sizes differ too much aren't linked; an id of several texts has the sizes lo to hi
    fit = (100 * F.col("hi") >= percent * F.col("c.lo")) & (100 * F.col("c.hi") >= percent * F.col("lo"))
    tested = work.save(others.where(fit).select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct())
    work.release()
    links = _linked(tested, sets, percent, work)
    work.release()
    labels = connected_components(links, work)
    work.release()

    component = F.coalesce("component", "id").alias("component")
    placed = others.select("key", "id").join(labels, F.col("id") == F.col("node"), "left").select("key", "id", component)
    apart = placed.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("two")).where("one < two").select("key")
    members = work.save(placed.join(apart, "key").select("id", "component").distinct())
    work.release()
    met = _across(members, sets, percent, work)
    rest = work.save(met.join(tested, ["a", "b"], "left_anti"))
    work.drop(met)
    more = _linked(rest, sets, percent, work)
    if not more.isEmpty():
        labels = connected_components(links.union(more), work)
    work.drop(buckets, sets, tested, links, members, rest, more)
    return labels


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("right")), "b").join(sets.select(F.col("id").alias("a"), F.col("members").alias("left")), "a")
    return work.save(joined.select("a", "b", "left", "right").mapInArrow(_confirmed(percent), "a long, b long"))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` without the documents whose group has one of a smaller doc_id, and without exact repeats.

    Of rows that are equal in doc_id and text one stays. A row without doc_id goes if another row has its text:
    one with a doc_id stays, else one of them. The texts of what may be repeated are shuffled, no others.
    """
    work = Workspace(docs.sparkSession, "keep")
    gone = work.save(groups.where("not kept").select("doc_id").distinct())
    same = F.xxhash64("doc_id", "text")
    again = work.save(docs.where("doc_id is not null").groupBy(same.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))

    def without(rows: DataFrame) -> DataFrame:
        marked = maybe_in(rows, "doc_id", gone)
        left = marked.where("maybe").select("row.*").join(gone.withColumnRenamed("doc_id", "_gone"), F.col("doc_id") == F.col("_gone"), "left_anti")
        return marked.where("not maybe").select("row.*").unionAll(left)

    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    if again.isEmpty():
        out = without(named)
    else:
        marked = maybe_in(named, same, again)
        out = without(marked.where("not maybe").select("row.*")).unionAll(without(marked.where("maybe").select("row.*")).dropDuplicates(["doc_id", "text"]))
    if nameless.isEmpty():
        return out
    by = {"_x": F.xxhash64("text"), "_y": F.hash("text")}
    texts = nameless.select(*(h.alias(n) for n, h in by.items())).distinct()
    owned = named.select(*(h.alias(n) for n, h in by.items())).join(texts, [*by], "left_semi").distinct()
    rows = nameless.select(F.struct("*").alias("row"), *(h.alias(n) for n, h in by.items())).join(owned, [*by], "left_anti").select("row.*")
    return out.unionAll(rows.dropDuplicates(["text"]))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


#: All pairs of documents that share a shingle, and the smallest id that each reaches.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words WHERE w IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
edges AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT y, label FROM reach JOIN edges ON node = x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN (SELECT node, min(label) AS component_id FROM reach GROUP BY node) ON node = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""
