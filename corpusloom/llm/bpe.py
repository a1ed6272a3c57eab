"""Byte-pair encoding and decoding of a ``tokenizers`` word-level BPE file."""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from corpusloom.llm._common import chunks, mix64, ship, table

VOCABULARY = "word_bpe_49k.json"
#: Of the two hashes of a pre-token.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Bytes of text encoded together.
TEXT_BYTES = 4 << 20
#: Pre-tokens: a contraction, a run of letters, one number, or a run of anything else but space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point, read off the library's own pattern engine, whose Unicode version decides.

    Many code points in one text: what is in no pre-token is space, and one of each other run tells its kind.
    """
    split = pre_tokenizers.Split(Regex(_PATTERN), "removed", invert=True)
    out = np.full(0x110000, _OTHER, np.uint8)
    for block in (*range(0, 0xD800, 0x800), *range(0xE000, 0x110000, 0x800)):
        out[block : block + 0x800] = _SPACE
        for piece, (start, stop) in split.pre_tokenize_str("".join(map(chr, range(block, block + 0x800)))):
            if len(split.pre_tokenize_str("a" + piece[0])) == 1:
                kind = _LETTER
            else:
                kind = _OTHER if len(split.pre_tokenize_str(piece[0] * 2)) == 1 else _NUMBER
            out[block + start : block + stop] = kind
    return out


@lru_cache(maxsize=1)
def _other_version() -> np.ndarray:
    """Code points that Python's Unicode version and the library's may treat differently: those that Python's
    doesn't know, marks that the two order differently, and marks that only one of them composes."""
    own = normalizers.NFC()
    odd = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)
    same = lambda text: own.normalize_str(text) == unicodedata.normalize("NFC", text)
    for c in map(chr, chain(range(0x300, 0xD800), range(0xE000, 0x110000))):
        if unicodedata.combining(c) and not (same("q\u0315" + c) and same("q" + c + "\u0301") and same("q" + c + "\u0334")):
            odd[ord(c)] = True
        elif unicodedata.decomposition(c)[:1] not in ("", "<"):
            parts = unicodedata.normalize("NFD", c)
            if not (same(c) and same(parts)):
                odd[[ord(c), ord(parts[-1])]] = True
    return odd


def _normal(parts: list[str]) -> list[str]:
    """Composed and in lower case. Capital sigma is lower-cased alike everywhere, at the end of words too."""
    out = [unicodedata.normalize("NFC", x).replace("Σ", "σ").lower() for x in parts]
    known = [x.isascii() or not _other_version()[np.frombuffer(x.encode("utf-32-le"), np.uint32)].any() for x in parts]
    if not all(known):
        own = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        out = [y if k else own.normalize_str(x) for x, y, k in zip(parts, out, known, strict=True)]
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class Merges:
    """(left, right) -> rank for whole arrays: two hash tables, each pair in one of its two slots."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        rng = np.random.default_rng(7)
        while True:
            self.times = rng.integers(0, 2**64, 2, np.uint64) | np.uint64(1)
            self.tables = [np.full(1 << bits, -1, np.int32) for _ in range(2)]
            if self._fill(keys):
                break
        self.keys = np.append(keys, np.uint64(2**64 - 1))  # rank -1 reads the last, which is no pair's

    def _fill(self, keys: np.ndarray) -> bool:
        """Cuckoo hashing: a key whose slot is taken moves the other one on."""
        slots = [((keys * t) >> self.shift).astype(np.int64).tolist() for t in self.times]
        tables = [t.tolist() for t in self.tables]
        for rank in range(len(keys)):
            at, side = rank, 0
            for _ in range(200):
                slot = slots[side][at]
                at, tables[side][slot] = tables[side][slot], at
                if at < 0:
                    break
                side = 1 - side
            else:
                return False
        self.tables = [np.array(t, np.int32) for t in tables]
        return True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the pair isn't merged."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        one = self.tables[0][((keys * self.times[0]) >> self.shift).view(np.int64)]
        two = self.tables[1][((keys * self.times[1]) >> self.shift).view(np.int64)]
        return np.where(self.keys[one] == keys, one, np.where(self.keys[two] == keys, two, np.int32(-1)))


class Bpe:
    """Encoder and decoder of one vocabulary file.

    Remembers the ids of the pre-tokens met last, as many as CACHE and those of one batch.
    """

    CACHE = 1 << 19

    def __init__(self, spec: dict):
        self.powers = [np.empty(0, np.uint64)] * 2
        self._forget()
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        left, right, merged = (np.array(x, np.int32) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.merges, self.left, self.right, self.merged = Merges(left, right), left.tolist(), right.tolist(), merged.tolist()
        self._check_order(left, right, merged)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.narrow = max(*vocab.values(), *self.special.values(), 0) < 1 << 16
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["pattern"]["Regex"] != _PATTERN:
            raise ValueError("the vocabulary's pre-tokens aren't those that this encoder makes")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in alphabet], np.int32)

    @staticmethod
    def _check_order(left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        """Equal ranks may be merged at once only if no merge uses a symbol that a later one makes."""
        last = np.full(max(left.max(), right.max(), merged.max()) + 1, -1)
        np.maximum.at(last, merged, np.arange(len(merged)))
        if (np.maximum(last[left], last[right]) >= np.arange(len(merged))).any():
            raise ValueError("the vocabulary's merges aren't in an order that this encoder takes")

    def merge(self, raw: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The symbol left at each byte, -1 where one was merged into an earlier one.

        raw: the pre-tokens' bytes; last: where a pre-token ends. Within each, the lowest-ranked merge comes
        first, the leftmost of equals, until none applies. All of them are one doubly linked list of symbols,
        cut between pre-tokens. The queue gives the lowest rank that any adjacent pair had when it was put in;
        its places are merged together, those whose symbols have changed since being skipped as stale. What
        this makes adjacent goes into the queue.
        """
        symbols = np.where(last, self.final[raw], self.inner[raw])
        n = len(symbols)
        if not n:
            return symbols
        after = np.arange(1, n + 1, dtype=np.int32)
        after[last] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[1:][last[:-1]] = -1
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def offer(places: np.ndarray) -> None:
            ranks = self.merges.ranks(symbols[places], symbols[after[places]])
            real = ranks >= 0
            places, ranks = places[real], ranks[real]
            if not len(places):
                return
            if len(places) > 1:
                order = np.argsort(ranks, kind="stable")
                places, ranks = places[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                starts = [0, *cuts.tolist()]
                groups = zip(ranks[starts].tolist(), starts, [*starts[1:], len(places)], strict=True)
            else:
                groups = ((int(ranks[0]), 0, 1),)
            for rank, start, end in groups:
                if rank in waiting:
                    waiting[rank].append(places[start:end])
                else:
                    waiting[rank] = [places[start:end]]
                    heapq.heappush(queue, rank)

        offer(np.flatnonzero(after >= 0).astype(np.int32))
        while queue:
            rank = heapq.heappop(queue)
            found = waiting.pop(rank)
            places = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            left, right = self.left[rank], self.right[rank]
            following = after[places]
            live = (symbols[places] == left) & (following >= 0) & (symbols[following] == right)
            if not live.all():
                places, following = places[live], following[live]
                if not len(places):
                    continue
            if left == right:  # in a run of equal symbols every other pair, from the left
                places = np.sort(places)
                following = after[places]
                chained = np.append(False, following[:-1] == places[1:])
                at = np.arange(len(places))
                odd = (at - np.maximum.accumulate(np.where(chained, 0, at))) % 2 == 1
                places, following = places[~odd], following[~odd]
            symbols[places] = self.merged[rank]
            symbols[following] = -1
            beyond = after[following]
            after[places] = beyond
            more = beyond >= 0
            before[beyond[more]] = places[more]
            ahead = before[places]
            fresh = np.concatenate([places[more], ahead[ahead >= 0]])
            if len(fresh):
                offer(np.unique(fresh) if len(places) > 1 else fresh)

        return symbols

    def _pretokens(self, text: str, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of normalised text: whether it is in a pre-token, and whether it ends one."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = _kinds()[points]
        begins = np.empty(len(kind), bool)
        begins[:1] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        quotes = np.flatnonzero(points == 0x27)
        if len(quotes):  # contractions, where no run of other characters has taken the quote
            quotes = quotes[(quotes == 0) | (kind[quotes - 1] != _OTHER)]
            padded = np.append(points, [0, 0])
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for found, size in ((quotes[short], 2), (quotes[long], 3)):
                begins[found + 1] = False
                stop = found + size
                begins[stop[stop < len(begins)]] = True
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        ends = np.zeros(len(raw), bool)
        ends[at[1:][begins[1:]] - 1] = True
        ends[-1:] = True
        inside = np.repeat(kind != _SPACE, np.diff(np.append(at, len(raw))))
        return inside, ends

    def _ids_of(self, raw: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in order, and how many each has; only those not met lately are merged."""
        if not len(raw):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        stops = np.flatnonzero(last) + 1
        starts = np.append(0, stops[:-1])
        sizes = stops - starts
        one, two = self._hashes(raw, starts, sizes)
        distinct, first, which = np.unique(one, return_index=True, return_inverse=True)
        check = two[first]
        if (check[which] != two).any():  # two pre-tokens share the first hash
            symbols = self.merge(raw, last)
            alive = symbols >= 0
            return symbols[alive], np.add.reduceat(alive, starts, dtype=np.int64)
        at = np.searchsorted(self.known, distinct)
        hit = self.known[at] == distinct
        hit &= self.checks[at] == check
        miss = np.flatnonzero(~hit)
        counts, offsets = self.counts[at], self.offsets[at]
        if len(miss):
            length = sizes[first[miss]]
            base = np.cumsum(length) - length
            gather = np.repeat(starts[first[miss]] - base, length) + np.arange(length.sum())
            closing = np.zeros(len(gather), bool)
            closing[base + length - 1] = True
            symbols = self.merge(raw[gather], closing)
            alive = symbols >= 0
            counts[miss] = np.add.reduceat(alive, base, dtype=np.int64)
            offsets[miss] = len(self.store) + np.cumsum(counts[miss]) - counts[miss]
            self.store = np.concatenate([self.store, symbols[alive]])
        each = counts[which]
        ids = self.store[np.repeat(offsets[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        if len(self.known) > self.CACHE:
            self._forget()
        elif len(miss):
            fresh = miss[self.known[at[miss]] != distinct[miss]]
            for name, new in (("known", distinct), ("checks", check), ("counts", counts), ("offsets", offsets)):
                setattr(self, name, np.insert(getattr(self, name), at[fresh], new[fresh]))
        return ids, each

    def _forget(self) -> None:
        self.known = np.array([2**64 - 1], np.uint64)  # no pre-token's, as its check is none either
        self.checks = np.zeros(1, np.uint64)
        self.counts = np.zeros(1, np.int64)
        self.offsets = np.zeros(1, np.int64)
        self.store = np.empty(0, np.int32)

    def _hashes(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of each pre-token; equal in both is taken as equal."""
        most = int(sizes.max())
        if most > len(self.powers[0]):
            self.powers = [np.cumprod(np.full(2 * most, base, np.uint64)) for base in _BASES]
        place = np.arange(len(raw)) - np.repeat(starts, sizes)
        value = raw.astype(np.uint64) + np.uint64(1)
        return [mix64(np.add.reduceat(value * p[place], starts)) for p in self.powers]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is the empty text."""
        if not texts:
            return []
        parts: list[str] = []
        plan: list[list[int | None]] = []  # of each text: None for the next of parts, else a special token's id
        for text in texts:
            steps: list[int | None] = []
            start = 0
            for m in self.specials.finditer(text) if text and self.specials and "<|" in text else ():
                parts.append(text[start : m.start()])
                steps += [None, self.special[m[0]]]
                start = m.end()
            parts.append((text or "")[start:])
            plan.append([*steps, None])
        parts = _normal(parts)
        text = "\n".join(parts)
        encoded = text.encode()
        raw = np.frombuffer(encoded, np.uint8)
        sizes = [len(x) if x.isascii() else len(x.encode()) for x in parts]
        inside, ends = self._pretokens(text, raw)
        closing = ends[inside]
        found, counts = self._ids_of(raw[inside], closing)
        ids = found.astype("<u4").tobytes()
        before = np.zeros(len(raw) + 1, np.int64)  # ids of the pre-tokens that end before each byte
        before[np.flatnonzero(inside)[closing] + 1] = counts
        np.cumsum(before, out=before)
        stops = np.cumsum(np.array(sizes, np.int64) + 1) - 1
        bounds = zip((before[stops - sizes] * 4).tolist(), (before[stops] * 4).tolist(), strict=True)
        return [b"".join([struct.pack("<I", step) if step is not None else ids[slice(*next(bounds))] for step in steps]) for steps in plan]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings, joined by a space, as the file names no decoder; ids outside it give nothing."""
        found = np.frombuffer(ids, "<u4").tolist()
        if len(found) > 1:
            try:
                return " ".join(itemgetter(*found)(self.strings))
            except KeyError:
                pass
        return " ".join([self.strings[i] for i in found if i in self.strings])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    with open(path, encoding="utf-8") as f:
        return Bpe(json.load(f))


def shipped(spark: SparkSession, path: str | None) -> str:
    """Sends the vocabulary file to all executors and returns the name it has there."""
    path = path or default_path()
    ship(spark)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def on_executor(name: str) -> Bpe:
    return load(SparkFiles.get(name))


def _encoded(name: str, text: str, keep: list[str], decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        bpe = on_executor(name)
        for batch in chunks(batches, text, TEXT_BYTES):
            ids = bpe.encode_all(batch.column(text).to_pylist())
            columns = [*(batch.column(c) for c in keep), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([bpe.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", *["decoded"] * decode])

    return run


def encode(docs: DataFrame, *, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """Token ids of ``text`` as the tokenizers library gives them without added special tokens.

    Returns the columns ``keep``, ``ids`` (binary, little-endian unsigned 32-bit) and, with ``decode``,
    ``decoded``. Null and empty texts have no ids and decode to the empty text. No shuffle; texts of any
    length are encoded whole. Other columns are not read, whatever their names.
    """
    name = shipped(docs.sparkSession, path)
    chosen = docs.select(*keep, F.col(text).alias("_text"))
    kinds = dict(chosen.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids binary" + ", decoded string" * decode
    return chosen.mapInArrow(_encoded(name, "_text", list(keep), decode), schema)


def decode(encoded: DataFrame, *, path: str | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Texts of id sequences as ``encode`` writes them; a null sequence gives a null text."""
    name = shipped(encoded.sparkSession, path)
    chosen = encoded.select(*keep, F.col(ids).alias("_ids"))
    kinds = dict(chosen.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = on_executor(name)
        for batch in chunks(batches, "_ids"):
            texts = [None if i is None else bpe.decode(i) for i in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return chosen.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", decoded string")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode(table(spark, sf_dir, "documents"), decode=True)
    return both.select("doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
