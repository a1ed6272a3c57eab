"""Document quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import bytes_of, chunks, ship, table

#: Labelled documents to learn from at most, chosen by a hash of their ids; everything else covers all rows.
TRAINING_ROWS = 20_000
#: Below this score a document is predicted to be of low quality.
CUT = 0.3
#: Bins of a feature, of each side of a pair; pairs; rounds over all features, over all pairs; shrinkage; leaves of a tree.
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 32, 8, 8, 150, 60, 0.15, 3
FOLDS = 5

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper_share", "upper_words", "digit_share", "point_share", "shout_share",
    "bar_share", "sign_share", "other_share", "wide_share", "lines_per_word", "distinct_words", "top_word", "short_words", "same_lines", "same_line_bytes", "closing_signs",
)


def _byte_classes() -> np.ndarray:
    """A column for each class of bytes that a feature counts."""
    out = np.zeros((256, 8))
    for column, members in enumerate((range(65, 91), range(48, 58), map(ord, ".,;:"), map(ord, "!?"), map(ord, "|"), map(ord, "#$%&*@~^"), map(ord, "<>{}[]()/\\=+_\"'-"), range(128, 256))):
        out[list(members), column] = 1
    return out


_CLASSES = _byte_classes()
_SIGNS = tuple(c.encode() for c in "!?#$%&*@~^|")


def features(text: bytes | None) -> list[float]:
    """FEATURES of one text, all of it; a null or empty text has none but zeros."""
    text = text or b""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    words = text.split()
    share = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES) / n
    count = len(words)
    if not count:
        return [math.log1p(n), *[0.0] * (len(FEATURES) - 1)]
    sizes = list(map(len, words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    kinds = set(lines)
    unique = sum(map(len, kinds))
    return [
        math.log1p(n), math.log1p(count), sum(sizes) / count, math.log1p(max(sizes)), share[0], sum(map(bytes.isupper, words)) / count,
        *share[1:8].tolist(), len(lines) / count, len(seen) / count, max(seen.values()) / count, sum(s <= 3 for s in sizes) / count,
        1 - len(kinds) / max(1, len(lines)), 1 - unique / n, sum(w.endswith(_SIGNS) for w in words) / count,
    ]


def _table_of_features(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = np.array([features(t) for t in bytes_of(batch.column("text"))], np.float64).reshape(batch.num_rows, len(FEATURES))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat], [*keep, "x"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Gam:
    """logit = bias + sum of a table over each feature's bin + sum of a table over each chosen pair's bins."""

    def __init__(self, bias: float, edges: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int]], pair_tables: list[np.ndarray]):
        self.bias, self.edges, self.tables = bias, edges, tables
        self.coarse, self.pairs, self.pair_tables = coarse, pairs, pair_tables

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        if self.pairs:
            low = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.coarse)]
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                z += t[low[a], low[b]]
        return _sigmoid(z)


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _steps(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A shallow tree over ordered bins: the value of each bin, from gradient and curvature sums."""
    cuts = [0, len(g)]
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    for _ in range(leaves - 1):
        best = max(((gain(a, k) + gain(k, b) - gain(a, b), k) for a, b in zip(cuts, cuts[1:], strict=False) for k in range(a + 1, b)), default=(0.0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of two cuts, one on each side of a pair: its gain and the value of each cell."""
    best, out = 0.0, np.zeros_like(g)
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = np.arange(1, max(2, g.shape[0]))[:, None], np.arange(1, max(2, g.shape[1]))[None, :]
    a, b = np.minimum(a, g.shape[0]), np.minimum(b, g.shape[1])
    tg = [cg[a, b], cg[a, -1] - cg[a, b], cg[-1, b] - cg[a, b], cg[-1, -1] - cg[a, -1] - cg[-1, b] + cg[a, b]]
    th = [ch[a, b], ch[a, -1] - ch[a, b], ch[-1, b] - ch[a, b], ch[-1, -1] - ch[a, -1] - ch[-1, b] + ch[a, b]]
    gains = sum(x * x / (y + 1.0) for x, y in zip(tg, th, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    if gains[i, j] > 0:
        best = float(gains[i, j])
        u, v = int(a[i, 0]), int(b[0, j])
        for q, part in enumerate((np.s_[:u, :v], np.s_[:u, v:], np.s_[u:, :v], np.s_[u:, v:])):
            out[part] = tg[q][i, j] / (th[q][i, j] + 1.0)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting: in each round every feature's table takes a shrunken step tree fitted to what the
    others leave; then the pairs with the largest gain on the rest take theirs. Without rows of both
    labels the model is the share of label 1, smoothed."""
    n, d = x.shape
    prior = (y.sum() + 1) / (n + 2)
    bias = float(math.log(prior / (1 - prior)))
    edges = [_edges(x[:, j], BINS) if n else np.empty(0) for j in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [_edges(x[:, j], PAIR_BINS) if n else np.empty(0) for j in range(d)]
    if n == 0 or y.min() == y.max():
        return Gam(bias, edges, tables, coarse, [], [])
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    z = np.full(n, bias)
    for _ in range(ROUNDS):
        for j in range(d):
            p = _sigmoid(z)
            size = len(tables[j])
            step = RATE * _steps(np.bincount(at[j], y - p, size), np.bincount(at[j], p * (1 - p), size), LEAVES)
            tables[j] += step
            z += step[at[j]]
    low = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]
    shape = [len(c) + 1 for c in coarse]
    cell = {(a, b): low[a] * shape[b] + low[b] for a, b in combinations(range(d), 2) if shape[a] > 1 and shape[b] > 1}

    def sums(pair: tuple[int, int], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = pair
        size = shape[a] * shape[b]
        return np.bincount(cell[pair], y - p, size).reshape(shape[a], shape[b]), np.bincount(cell[pair], p * (1 - p), size).reshape(shape[a], shape[b])

    p = _sigmoid(z)
    pairs = sorted(cell, key=lambda pair: -_quadrants(*sums(pair, p))[0])[:PAIRS]
    pair_tables = [np.zeros((shape[a], shape[b])) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, pair in enumerate(pairs):
            _, step = _quadrants(*sums(pair, _sigmoid(z)))
            pair_tables[k] += RATE * step
            z += RATE * step.reshape(-1)[cell[pair]]
    return Gam(bias, edges, tables, coarse, pairs, pair_tables)


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = TRAINING_ROWS, label: str = "quality") -> Gam:
    """Fits the model on labelled documents outside fold 0: at most ``rows``, those of the smallest id hashes.

    Of rows that share a doc_id one text is learnt from, so that what reaches the driver is bounded.
    """
    ship(docs.sparkSession)
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")  # at most ``rows`` pairs of numbers
    rated = texts.mapInArrow(_table_of_features(["_id", "_y"]), f"_id long, _y {dict(chosen.dtypes)['_y']}, x array<double>")
    got = rated.groupBy("_id").agg(F.max("_y").alias("_y"), F.max("x").alias("x")).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = np.array(got.column("_y").to_pylist(), np.float64)
    order = np.lexsort((*x.T, np.array(got.column("_id").to_pylist(), np.int64)))
    return fit(x[order], (y[order] > 0).astype(np.float64))


def rate(docs: DataFrame, model: Gam, *, keep: tuple[str, ...] = ("doc_id",), cut: float = CUT) -> DataFrame:
    """The columns ``keep`` and score, predicted for each row: each feature's bin and each pair's add up.

    No shuffle; whole texts. Null and empty texts are scored as texts of zeros.
    """
    ship(docs.sparkSession)
    chosen = docs.select(F.struct(*keep).alias("_at"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = np.array([features(t) for t in bytes_of(batch.column("text"))], np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("_at"), pa.array(model.score(x))], ["_at", "score"])

    out = chosen.mapInArrow(run, f"_at {chosen.schema['_at'].dataType.simpleString()}, score double")
    return out.select(*(F.col("_at").getField(c).alias(c) for c in keep), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = rate(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
