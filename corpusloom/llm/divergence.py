"""How the words of each source differ from those of other sources and of their language: an audit of a corpus's sources."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import Workspace, bytes_of, settled, table

MIN_DOCS = 3
TERM_RANKS = 200
#: Shares are whole parts of this.
UNIT = 1_000_000_000
#: Text that one automaton reads, about; a longer document is read whole.
BLOCK_BYTES = 8 << 20
#: What names a block: texts of one language and source, and a share of them.
BLOCK = ("lang", "source", "slot")
#: Groups of a language's sources that meet one another in a task each.
SLICES = 8
#: A byte that is no part of a term becomes a space, A-Z become a-z; all bytes of letters beyond ASCII are kept.
_PLAIN = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _padded(got: pa.Table) -> list[bytes]:
    """The terms of each text between single spaces."""
    return [b" " + b" ".join(terms) + b" " if (terms := text.translate(_PLAIN).split()) else b" " for text in bytes_of(got.column("text"))]


def _frequencies(got: pa.Table) -> pa.Table:
    """In how many of a block's documents each term is."""
    dfs: Counter[bytes] = Counter()
    for text in bytes_of(got.column("text")):
        dfs.update(set(text.translate(_PLAIN).split()))
    return pa.table([*_same(got, BLOCK, len(dfs)), pa.array([t.decode() for t in dfs], pa.string()), pa.array(dfs.values(), pa.int64())], [*BLOCK, "term", "n"])


def _same(got: pa.Table, columns: tuple[str, ...], n: int) -> list[pa.ChunkedArray]:
    """What all rows of a block have in these columns, n times."""
    return [got.column(c).take(pa.array([0] * n, pa.int64())) for c in columns]


def _recount(got: pa.Table, asked: pa.Table) -> pa.Table:
    """How often each kept term occurs in a block, which is of one source: an automaton of the block's kept terms, padded, reads its texts."""
    kept = asked.column("kept")[0].as_py() if asked.num_rows else []
    found: Counter[int] = Counter()
    if kept and got.num_rows:
        finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for j, term in enumerate(kept):
            finder.add_word(f" {term} ", j)
        finder.make_automaton()
        for text in _padded(got):
            found.update(map(itemgetter(1), finder.iter(text.decode())))
    return pa.table([*_same(got, BLOCK[:2], len(found)), pa.array(kept, pa.string()).take(pa.array(list(found), pa.int64())), pa.array(found.values(), pa.int64())], ["lang", "source", "term", "n"])


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


#: Pairs of sources whose sums wait in a task.
_SUMS = 1 << 20


def _common_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, x): for pairs of sources, what their common terms add to the sum of those that one alone has.

    Each row has the postings of a term: where it occurs (``at``), its share there (``p``) and a term's that
    doesn't (``base``). The postings of a batch are held sparsely by source; sums leave when many have gathered.
    """
    sums: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in sums.items():
            if own:
                pairs, x = zip(*own.items(), strict=True)
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(x, pa.int64())], ["lang", "source", "item", "x"])
        sums.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in dict.fromkeys(langs):
            rows = batch.filter(pa.array([x == lang for x in langs]))
            occ = rows.column("occ")
            flat = occ.flatten()
            term = np.repeat(np.arange(rows.num_rows), np.asarray(occ.value_lengths()))
            names = flat.field(0).dictionary_encode()
            source, p, base = np.asarray(names.indices), np.asarray(flat.field(1), np.int64), np.asarray(flat.field(2), np.int64)
            names = names.dictionary.to_pylist()
            order = np.argsort(source, kind="stable")
            starts = np.searchsorted(source[order], np.arange(len(names) + 1))
            share, here = np.empty(rows.num_rows, np.int64), np.zeros(rows.num_rows, bool)
            for g, name in enumerate(names):
                mine = order[starts[g] : starts[g + 1]]
                share[term[mine]], here[term[mine]] = p[mine], True
                other = np.flatnonzero(here[term] & (source != g))
                here[term[mine]] = False
                if not len(other):
                    continue
                pg, pg0, q, q0, whose = share[term[other]], base[mine[0]], p[other], base[other], source[other]
                x = divergence(pg, q) - divergence(pg, q0) - divergence(pg0, q) + divergence(pg0, q0)
                by = np.argsort(whose, kind="stable")
                cut = np.flatnonzero(np.diff(whose[by], prepend=-1))
                for h, v in zip(whose[by][cut].tolist(), np.add.reduceat(x[by], cut).tolist(), strict=True):
                    sums[lang][name, names[h]] += v
            if sum(map(len, sums.values())) >= _SUMS:
                yield from flush()
    yield from flush()


def _share(n: Column | str, total: Column | str, kinds: Column | str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kinds)), by decimals where the product is beyond a long's range."""
    n, total, kinds = (F.col(x) if isinstance(x, str) else x for x in (n, total, kinds))
    short = F.call_function("div", F.lit(UNIT).cast("long") * (n + 1), total + kinds)
    long = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + kinds).cast("decimal(20,0)"))
    return F.when(total + kinds > 0, F.lit(1).cast("long") + F.when(n < 9 * UNIT, short).otherwise(long))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) of ``docs`` (text, lang, source).

    Part ``pair``: every other source of the language by how far its shares of the kept terms are from this one's.
    Part ``term``: the ``term_ranks`` kept terms that the source has more of than its language, by how far. Equal
    values go by item. A term is kept in a language if ``min_docs`` of its documents have it.

    1. Texts are dealt by language and source into blocks of a bounded size, and each block counts in how many of its
       documents each term is; sums by language and term are the exact document frequencies.
    2. Each block is given the kept terms that it has, so an automaton holds no more than a block's terms however many a
       language has, and recounts their occurrences. The texts are shuffled once; both passes read that shuffle.
    3. Postings (lang, source, term) are sparse: a term that a source lacks has the source's base share. A pair's sum
       is that of two base shares over all terms, corrected where either source has the term, by a histogram of its
       shares, and where both do, from the postings of the term. All arithmetic is on whole numbers.

    Edge cases: null text, lang and source are read as ''. Each row is a document, repeated or not. A group
    without terms has all shares equal; a language that keeps no term has only pairs of value 0. Other columns aren't read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "audit")
    rows = settled(docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source"))), work)
    groups = work.save(rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")))

    # a group's rows are dealt to as many blocks as its size asks for, equal texts to different ones
    slots = groups.select("lang", "source", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("slots"))
    slot = F.pmod(F.xxhash64("number"), F.col("slots")).alias("slot")
    dealt = rows.withColumn("number", F.monotonically_increasing_id()).join(slots, ["lang", "source"]).select(*BLOCK[:2], slot, "text")
    pairs = dealt.groupBy(*BLOCK).applyInArrow(_frequencies, "lang string, source string, slot long, term string, n long")
    every = pairs.withColumn("every", F.sum("n").over(Window.partitionBy("lang", "term")))
    kept = every.where(F.col("every") >= min_docs).groupBy(*BLOCK).agg(F.collect_list("term").alias("kept"))
    counted = dealt.groupBy(*BLOCK).cogroup(kept.groupBy(*BLOCK)).applyInArrow(_recount, "lang string, source string, term string, n long")
    postings = work.save(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
    work.release()

    kinds = postings.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = groups.drop("bytes").join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").na.fill(0, ["total", "kinds"])
    stats = work.save(stats.select("lang", "source", "total", "kinds", _share(F.lit(0).cast("long"), "total", "kinds").alias("base")))
    shares = postings.join(stats, ["lang", "source"]).select("lang", "source", "term", "n", _share("n", "total", "kinds").alias("p"), "base")
    by_term = shares.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "p", "base")).alias("occ"))
    by_term = work.save(by_term)

    # terms
    whole = stats.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kinds").alias("kinds"))
    terms = by_term.join(whole, "lang").select("lang", "term", _share("n", "total", "kinds").alias("q"), F.explode("occ").alias("o"))
    terms = terms.select("lang", F.col("o.source").alias("source"), F.col("term").alias("item"), F.col("o.p").alias("p"), "q").where("p > q")
    terms = terms.select("lang", "source", "item", _f(F.col("p"), F.col("q")).alias("value"), F.pmod(F.xxhash64("item"), F.lit(16)).alias("slice"))
    best = (F.col("value").desc(), "item")
    # the best of each slice first, so that no task sees a whole group
    sliced = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "slice").orderBy(*best))).where(F.col("rank") <= term_ranks)
    top = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))).where(F.col("rank") <= term_ranks)

    # pairs
    both = by_term.select("lang", "occ").mapInArrow(_common_terms, "lang string, source string, item string, x long").groupBy("lang", "source", "item").agg(F.sum("x").alias("x"))
    shapes = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("shape"))
    own = stats.join(shapes, ["lang", "source"], "left").select("lang", "source", "kinds", F.struct("base", "shape").alias("g"))
    slice_of = F.pmod(F.xxhash64("source"), F.lit(SLICES))
    left = own.select("lang", "source", "kinds", "g", slice_of.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))).alias("j"))
    right = own.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), slice_of.alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))).alias("i"))
    g0, h0 = F.col("g.base"), F.col("h.base")

    def one_side(shape: Column, f) -> Column:
        """What terms of one source add, as if the other had none of them."""
        return F.coalesce(F.aggregate(shape, F.lit(0).cast("long"), lambda acc, t: acc + t["n"] * (f(t["p"]) - _f(g0, h0))), F.lit(0).cast("long"))

    alone = F.col("kinds") * _f(g0, h0) + one_side(F.col("g.shape"), lambda p: _f(p, h0)) + one_side(F.col("h.shape"), lambda p: _f(g0, p))
    met = left.join(right, ["lang", "i", "j"]).where("source <> item").select("lang", "source", "item", F.when(F.col("kinds") > 0, alone).otherwise(F.lit(0).cast("long")).alias("alone"))
    met = met.join(both, ["lang", "source", "item"], "left").select("lang", "source", "item", (F.col("alone") + F.coalesce("x", F.lit(0).cast("long"))).alias("value"))
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best)))

    columns = ("lang", "source", "part", "item", "value", "rank")
    return met.withColumn("part", F.lit("pair")).select(*columns).unionAll(top.withColumn("part", F.lit("term")).select(*columns))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: Every share of every kept term in every group, without any of the shortcuts.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS MATERIALIZED (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM occ GROUP BY ALL HAVING count(DISTINCT id) >= 3),
cells AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
dense AS MATERIALIZED (SELECT lang, g.source, term, coalesce(n, 0)::HUGEINT AS n, sum(coalesce(n, 0)::HUGEINT) OVER (PARTITION BY lang, g.source) AS total, v
  FROM groups g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN cells c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (total + v) AS p FROM dense),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n)::HUGEINT + 1)) // ((sum(sum(n)) OVER (PARTITION BY lang))::HUGEINT + any_value(v)) AS q FROM dense GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked) WHERE part = 'pair' OR rank <= 200
"""
