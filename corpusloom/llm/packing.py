"""Packing of token sequences, balanced by attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe as B
from corpusloom.llm._common import chunks, table

CAPACITY = 2048
END_ID = 1
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n. The ratio is that of a transformer block 1024
#: wide, 24 * width**2 operations a token against 4 * width for each token it attends to.
LINEAR, QUADRATIC = 1.0, 1 / 6144
#: Documents' rests packed together; bounds the memory of a task. Their tails pad nothing, being cut to powers of two.
GROUP = 4096
_PIECES = "group long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(name: str, capacity: int, end_id: int):
    """Each document's ids, cut: whole sequences, whose ids needn't travel, and a rest with its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = B.on_executor(name)
        end = np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches, most=B.TEXT_BYTES):
            out: list[list] = [[] for _ in range(7)]
            for group, doc, ids in zip(batch.column("group").to_pylist(), batch.column("doc_id").to_pylist(), bpe.encode_all(batch.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rest = len(part) < 4 * capacity
                    small = np.frombuffer(part, "<u4").astype("<u2") if rest and bpe.narrow else None
                    for column, value in zip(out, (group, doc, start, len(part) // 4, zlib.crc32(part), n, (part if small is None else small.tobytes()) if rest else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(out)], ["group", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int, int]]]:
    """Where pieces go: for each length a list of (start, length, sequence, offset).

    Longest first, each goes to the cheapest sequence that has room for it; if none has, the cheapest
    with any room takes what fits and the rest goes on. As many sequences as the tokens fill; what is
    over is cut into sequences of different powers of two. So no sequence is padded.
    """
    full, over = divmod(sum(lengths), capacity)
    room = np.full(full, capacity, np.int64)
    cost = np.zeros(full)
    tails = [1 << b for b in range(over.bit_length() - 1, -1, -1) if over >> b & 1]
    tail, filled = 0, 0
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[i]
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            if full and fits.any():
                at = int(np.argmin(np.where(fits, cost, np.inf)))
                take = min(left, int(room[at]))
                out[i].append((start, take, at, capacity - int(room[at])))
                room[at] -= take
                cost[at] += linear * take + quadratic * take * take
            else:
                take = min(left, tails[tail] - filled)
                out[i].append((start, take, full + tail, filled))
                filled += take
                if filled == tails[tail]:
                    tail, filled = tail + 1, 0
            start, left = start + take, left - take
    return out


def _packed(capacity: int, linear: float, quadratic: float, narrow: bool):
    def run(got: pa.Table) -> pa.Table:
        rows = got.to_pydict()
        base = rows["group"][0] << 32
        order = sorted(range(got.num_rows), key=lambda i: (rows["doc_id"][i] is None, rows["doc_id"][i] or 0, rows["start"][i], rows["ids_crc32"][i]))
        rests = [i for i in order if rows["ids"][i] is not None]
        where = assign([rows["length"][i] for i in rests], capacity, linear, quadratic)
        used = 1 + max((p[2] for parts in where for p in parts), default=-1)
        out: list[list[int | None]] = [[] for _ in range(7)]
        for i in order:
            if rows["ids"][i] is None:
                for c, v in zip(out, (rows["doc_id"][i], rows["start"][i], rows["length"][i], rows["ids_crc32"][i], rows["doc_tokens"][i], base + used, 0), strict=True):
                    c.append(v)
                used += 1
        for i, parts in zip(rests, where, strict=True):
            ids = np.frombuffer(rows["ids"][i], "<u2" if narrow else "<u4").astype("<u4")
            for start, length, sequence, offset in parts:
                crc = rows["ids_crc32"][i] if length == len(ids) else zlib.crc32(ids[start : start + length].tobytes())
                for c, v in zip(out, (rows["doc_id"][i], rows["start"][i] + start, length, crc, rows["doc_tokens"][i], base + sequence, offset), strict=True):
                    c.append(v)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC, group: int = GROUP) -> DataFrame:
    """Packs the token ids of ``docs`` (doc_id, text), each followed by ``end_id``, into sequences.

    Returns a row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A document that fills whole sequences is cut there; the rests are dealt to
    groups of about ``group`` by row, so no key is hot, and packed as ``assign`` says. Sequences hold
    ``capacity`` tokens, or a smaller power of two; none is padded. ``capacity`` must be a power of two.

    Edge cases: null and empty texts have the end id only. Repeated and null doc_ids are packed like
    others. Other columns aren't read. An empty table gives no pieces.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    name = B.shipped(docs.sparkSession, path)
    narrow = B.load(path or B.default_path()).narrow
    groups = max(1, -(-docs.count() // group))
    dealt = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("group"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dealt.mapInArrow(_pieces(name, capacity, end_id), _PIECES).groupBy("group").applyInArrow(_packed(capacity, linear, quadratic, narrow), _OUT)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
