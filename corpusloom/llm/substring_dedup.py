"""Removal of long word sequences that occur more than once, found from difference-cover anchors."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import WordHashes, Workspace, bytes_of, chunks, dealt, lists, maybe_in, rolled, settled, table

WINDOW_WORDS = 35
#: Positions modulo PERIOD at which anchors are hashed: 5 of 21.
PERIOD = 21
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Input bytes for each bucket of hashes; a bucket is compared in one task's memory.
_BUCKET_BYTES = 2 << 20

#: What a chunk of texts sends. To a bucket: its hashes and where they are; to itself: the places that it knows
#: to be repeated already, and which documents its rows are.
_SENT = "bucket long, chunk long, kind string, body binary"
_REPLY = "chunk long, kind string, body binary"
_FOUND = "doc long, sign long, places array<int>"


@lru_cache(maxsize=8)
def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues whose differences are all residues."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError(period)


class _Words:
    """The word hashes of all texts of a chunk in one array."""

    def __init__(self, texts: list[bytes | None], words_of: WordHashes):
        split = [t.split() if t else [] for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.concatenate([words_of.of(w) for w in split]) if split else np.empty(0, np.uint64)
        self.rows = np.repeat(np.arange(len(split), dtype=np.int32), self.sizes)
        self.places = (np.arange(len(self.hashes)) - np.repeat(self.starts, self.sizes)).astype(np.int32)
        self.left = np.repeat(self.sizes, self.sizes) - self.places  # words from here to the text's end


def _body(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in one compressed value; ascending ones as differences, which compress well."""
    raw = b"".join(x.tobytes() for x in arrays)
    return struct.pack("<II", len(arrays[0]), len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _arrays(body: bytes, *kinds: str) -> list[np.ndarray]:
    n, size = struct.unpack_from("<II", body)
    raw = pa.decompress(body[8:], size, codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype(np.int32)


#: One row of a chunk and the place in it, as one number each; the first word of a text is place 0.
_PLACE = np.int64(1) << np.int64(32)


def _chunk_rows(hashes: list[np.ndarray], rows: np.ndarray, places: np.ndarray, batch: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of hashes, split by bucket.

    What occurs twice in this chunk is known to be repeated already: those places stay with the chunk, and
    the bucket gets the hash once, marked by row -1. So a chunk sends a hash once at most, however frequent it is.
    """
    if not len(rows):
        return
    docs, signs = np.asarray(batch.column("doc"), np.int64), np.asarray(batch.column("sign"), np.int64)
    chunk = xxhash.xxh3_64_intdigest(docs.tobytes() + signs.tobytes()) >> 1
    order = np.lexsort(hashes[::-1])
    sorted_ = [h[order] for h in hashes]
    new = np.append(True, np.any([h[1:] != h[:-1] for h in sorted_], axis=0))
    several = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
    group = np.cumsum(new) - 1
    sure = np.empty(len(order), bool)
    sure[order] = several[group]
    sent = np.sort(order[new])  # in the order of the texts
    bucket = (hashes[0][sent] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    sent, bucket = sent[by], bucket[by]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    marked = np.where(sure, -1, rows).astype(np.int32)
    out: list[tuple[int, str, bytes]] = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sent)], strict=True):
        at = sent[a:b]
        kept = [h[at] // np.uint64(buckets) if i == 0 else h[at] for i, h in enumerate(hashes)]
        out.append((int(bucket[a]), "hash", _body(*(k.astype(np.uint32) if len(kept) == 1 or i else k for i, k in enumerate(kept)), _steps(marked[at]), _steps(places[at]))))
    own = chunk % buckets
    out.append((own, "rows", _body(docs, signs)))
    if sure.any():
        out.append((own, "sure", _body(_steps(rows[sure]), _steps(places[sure]))))
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.int64()), pa.array([chunk] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.binary())],
        ["bucket", "chunk", "kind", "body"],
    )


def _repeated(width: int):
    """Tells each chunk which of its places in one bucket have a hash that occurs elsewhere too; passes on what it sent to itself."""
    kinds = ("<u4",) if width == 1 else ("<u8", "<u4")

    def run(got: pa.Table) -> pa.Table:
        chunk, kind, body = (got.column(c).to_pylist() for c in ("chunk", "kind", "body"))
        out = [(c, k, b) for c, k, b in zip(chunk, kind, body, strict=True) if k != "hash"]
        at = [i for i, k in enumerate(kind) if k == "hash"]
        if at:
            parts = [_arrays(body[i], *kinds, "<i4", "<i4") for i in at]
            sizes = np.array([len(p[0]) for p in parts])
            hashes = [np.concatenate([p[j] for p in parts]) for j in range(len(kinds))]
            rows = np.concatenate([np.cumsum(p[-2]) for p in parts])
            order = np.lexsort(hashes[::-1])
            new = np.append(True, np.any([h[order][1:] != h[order][:-1] for h in hashes], axis=0))
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            shared = np.bincount(group) > 1
            shared[group[rows < 0]] = True
            reply = shared[group] & (rows >= 0)
            for i, p, a, n in zip(at, parts, np.cumsum(sizes) - sizes, sizes, strict=True):
                mine = reply[a : a + n]
                if mine.any():
                    out.append((chunk[i], "sure", _body(_steps(rows[a : a + n][mine]), _steps(np.cumsum(p[-1])[mine]))))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.binary())], ["chunk", "kind", "body"])

    return run


def _by_document(got: pa.Table) -> pa.Table:
    """The repeated places of one chunk by document."""
    kind, body = got.column("kind").to_pylist(), got.column("body").to_pylist()
    known = [_arrays(b, "<i8", "<i8") for k, b in zip(kind, body, strict=True) if k == "rows"]
    if not known:
        raise RuntimeError("a chunk of texts was made anew with other rows; the input's order isn't deterministic")
    docs, signs = known[0]
    parts = [[np.cumsum(x, dtype=np.int64) for x in _arrays(b, "<i4", "<i4")] for k, b in zip(kind, body, strict=True) if k == "sure"]
    if not parts:
        return pa.table({"doc": pa.array([], pa.int64()), "sign": pa.array([], pa.int64()), "places": pa.array([], pa.list_(pa.int32()))})
    rows, places = (np.concatenate(z) for z in zip(*parts, strict=True))
    order = np.argsort(rows * _PLACE + places, kind="stable")
    rows, places = rows[order], places[order]
    cuts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    at = rows[cuts]
    return pa.table({"doc": pa.array(docs[at], pa.int64()), "sign": pa.array(signs[at], pa.int64()), "places": lists(places, np.diff(np.append(cuts, len(rows))), pa.int32())})


def _anchors(window: int, period: int, buckets: int):
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    width = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in chunks(batches):
            w = _Words(bytes_of(batch.column("text")), words_of)
            h = rolled(w.hashes, width, _BASES[0])
            n = len(h)
            at = np.flatnonzero((w.left[:n] >= width) & cover[w.places[:n] % period] & (w.left[:n] + w.places[:n] >= window))
            yield from _chunk_rows([h[at]], w.rows[at], w.places[at], batch, buckets)

    return run


def _windows(window: int, period: int, buckets: int):
    """All windows around anchors that occur elsewhere."""
    reach = period - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in chunks(batches):
            w = _Words(bytes_of(batch.column("text")), words_of)
            column = batch.column("places")
            sizes = np.asarray(pc.list_value_length(column), np.int64)
            anchors = np.asarray(column.flatten(), np.int64)
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            edge = np.zeros(len(w.hashes) + 1, np.int64)
            np.add.at(edge, w.starts[rows] + np.maximum(anchors - reach, 0), 1)
            np.add.at(edge, w.starts[rows] + anchors + 1, -1)
            near = np.cumsum(edge)[:-1] > 0
            one = rolled(w.hashes, window, _BASES[0])
            two = rolled(w.hashes, window, _BASES[1])
            n = len(one)
            at = np.flatnonzero(near[:n] & (w.left[:n] >= window))
            yield from _chunk_rows([one[at], two[at]], w.rows[at], w.places[at], batch, buckets)

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = bytes_of(batch.column("text"))
            places = batch.column("places")
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(texts):
                words = text.split() if text else []
                n_words.append(len(words))
                starts = places[i].values if places[i].is_valid else None
                if starts is None or not len(starts):
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                edge = np.zeros(len(words) + 1, np.int32)
                starts = np.unique(np.asarray(starts, np.int64))
                edge[starts] += 1
                edge[starts + window] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column("_at"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["_at", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, *, window: int = WINDOW_WORDS, period: int = PERIOD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Removes every word that lies in a run of ``window`` words which also starts anywhere else.

    Words are what stands between the six ASCII spaces, unchanged. Returns the columns ``keep`` and
    n_words, n_removed, kept_text (kept words joined by one space), a row for each input row.

    1. Anchors, shorter by period - 1 words, are hashed at positions whose residue is in a difference
       cover. Two equal windows have anchors at the same place in both, so a window without a repeated
       anchor needs no further look.
    2. The windows around repeated anchors are hashed (96 bits) and those that occur twice are removed.

    Only texts with a repeated anchor, and in the end those with a repeated window, are shuffled. Hashes meet in buckets whose number follows the input. Each chunk of texts sends a hash once at most,
    so a passage of a third of all documents loads no task more than others.

    Edge cases: null and empty texts have no words. Rows equal in doc_id and text count as separate
    occurrences. A null doc_id is as good as any other. Other columns aren't read unless in ``keep``.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "substring")
    buckets = dealt(docs, _BUCKET_BYTES)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64("text").alias("sign"), "text")
    # chunks of texts are known by what is in them, so an executor that is lost has to be able to make them again
    keyed = settled(keyed.where("text is not null"), work)

    def met(sent: DataFrame, width: int) -> DataFrame:
        replies = sent.groupBy("bucket").applyInArrow(_repeated(width), _REPLY)
        found = replies.groupBy("chunk").applyInArrow(_by_document, _FOUND)
        # rows that are equal in doc_id and text may lie in several chunks
        return found.groupBy("doc", "sign").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))

    key = F.xxhash64("doc", "sign")
    anchors = work.save(met(keyed.mapInArrow(_anchors(window, period, buckets), _SENT), 1))
    work.release()
    near = maybe_in(keyed, key, anchors.select(key)).where("maybe").select("row.*")
    near = work.save(near.join(anchors, ["doc", "sign"]).select("doc", "sign", "text", "places"))
    work.drop(anchors)
    repeated = work.save(met(near.mapInArrow(_windows(window, period, buckets), _SENT), 2))
    work.drop(near)
    work.release()
    whole = docs.select(F.struct(*keep).alias("_at"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64("text").alias("sign"))
    marked = maybe_in(whole, key, repeated.select(key))
    untouched = marked.where("not maybe").select("row._at", "row.text", F.lit(None).cast("array<int>").alias("places"))
    cut = marked.where("maybe").select("row.*").join(repeated, ["doc", "sign"], "left").select("_at", "text", "places").unionAll(untouched)
    at = whole.schema["_at"].dataType.simpleString()
    out = cut.mapInArrow(_cut(window), f"_at {at}, n_words long, n_removed long, kept_text string")
    return out.select(*(F.col("_at").getField(c).alias(c) for c in keep), "n_words", "n_removed", "kept_text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Every window as text, those that start more than once, and the words that these cover.
OP5_SQL = rf"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW_WORDS - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW_WORDS - 2})) AS i FROM words)),
repeated AS (SELECT doc_id, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW_WORDS})) AS i FROM repeated),
gone AS (SELECT doc_id, list(i) AS at, count(*) AS n FROM covered GROUP BY doc_id),
kept AS (SELECT k.doc_id, string_agg(k.v, ' ' ORDER BY k.i) AS text FROM (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM words) k
  LEFT JOIN covered c ON c.doc_id = k.doc_id AND c.i = k.i WHERE c.i IS NULL GROUP BY k.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
