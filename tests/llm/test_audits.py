"""Source divergence, pane revisions and the n-gram join against brute force, on small tables with awkward rows."""

import datetime as dt
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import divergence, panes, partenum
from tests.llm.test_operators import LOWER, ROWS, SCHEMA, WORD, docs, empty, prose  # noqa: F401

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# --- n-gram join ----------------------------------------------------------------------------------


def components(sets, percent):
    """id -> smallest id that links reach."""
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in sets}


def shingles(text, k):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("percent", [60, 75, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    every = partenum.bands(percent, 1 << 16)
    assert [b.first for b in every[1:]] == [b.last + 1 for b in every[:-1]]

    def signed(s):
        i = next(i for i, b in enumerate(every) if len(s) <= b.last)
        own = [b for b in every[i : i + 2] if 100 * len(s) >= percent * b.first]
        return set(partenum.signatures(np.sort(s), own, percent).tolist())

    sizes = [*range(1, 60), *rng.integers(60, 3000, 60).tolist()]
    for size in sizes:
        for _ in range(6):
            other = int(rng.integers(size, size * 100 // percent + 1))
            both = -(-percent * (size + other) // (100 + percent))
            if both > size:
                continue
            values = rng.integers(0, 1 << 64, size + other - both, np.uint64)
            a, b = values[:size], np.concatenate([values[:both], values[size:]])
            assert len(a) == size and len(b) == other
            assert signed(a) & signed(b), (size, other, both)
    a = rng.integers(0, 1 << 64, 400, np.uint64)
    assert len(signed(a)) < (400 if percent > 70 else 1600) and not signed(a) & signed(rng.integers(0, 1 << 64, 400, np.uint64))


def test_jaccard_join(spark, docs, empty):  # noqa: F811
    sets = {r[0]: shingles(r[1], 4) for r in ROWS}
    want = components(sets, 85)
    got = {r.doc_id: r for r in partenum.jaccard_join(docs).collect()}
    assert len(got) == len(ROWS) and len(set(want.values())) < len(want)
    for d in sets:
        assert (got[d].n_shingles, got[d].component_id) == (len(sets[d]), want[d])
    assert partenum.jaccard_join(empty).count() == 0


def test_signatures_are_gone_before_texts_are_compared(spark, docs, monkeypatch):  # noqa: F811
    """They take most of the disk, so they go once it is known who meets."""
    left, grouped = [], partenum.grouped

    def watched(*args):
        root = Path(re.sub("^file:/*", "/", args[-1].root))
        left.extend(c for p in root.iterdir() for c in spark.read.parquet(f"file://{p}").columns)
        return grouped(*args)

    monkeypatch.setattr(partenum, "grouped", watched)
    assert partenum.jaccard_join(docs).count() == docs.count()
    assert "set_hash" in left and "keys" not in left


def test_jaccard_join_near_the_threshold(spark):
    """Texts that share a passage with all others, at likenesses just above and below the threshold; repeats; no doc_id."""
    rng = np.random.default_rng(3)
    passage, rows = prose(rng, 60), []
    for i in range(30):
        own = prose(rng, 90).split()
        for j in range(5):
            words = list(own)
            for at in rng.choice(len(words), j, replace=False):
                words[at] = f"x{i}{j}"
            rows.append((i * 10 + j, passage + " " + " ".join(words)))
    rows += [(7000, passage), (7000, passage), (7000, "a b c d e f"), (7001, "A b c D e f"), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, 4) for i, (_, t) in enumerate(rows)}
    got = partenum.jaccard_join(df).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None and r.component_id is None for r in got) == 1
    alone = {i: s for i, s in sets.items() if rows[i][0] is not None and rows[i][0] < 7000}
    want = {rows[i][0]: rows[c][0] for i, c in components(alone, 85).items()}
    found = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert {d: c for d, c in found.items() if d < 7000} == want and found[7000] == found[7001] == 7000
    assert 1 < len(set(want.values())) < len(want)


# --- source divergence ----------------------------------------------------------------------------


def audited(rows, ranks=200):
    """{(lang, source, part): [(item, value)]} by whole tables of shares."""
    count, having, groups = defaultdict(Counter), defaultdict(Counter), {}
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups.setdefault(lang or "", set()).add(source or "")
        count[lang or "", source or ""].update(terms)
        having[lang or ""].update(set(terms))
    out = {}
    for lang, sources in groups.items():
        kept = sorted((t for t, n in having[lang].items() if n >= 3), key=str.encode)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}

        def share(n, of, kept=kept):
            return 1 + 10**9 * (n + 1) // (of + len(kept))

        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, own in (("pair", pairs), ("term", terms)):
                own = sorted(own, key=lambda x: (-x[1], x[0].encode()))
                if own:
                    out[lang, s, part] = own[:ranks] if part == "term" else own
    return out


def test_divergence(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICES", 3)
    rng = np.random.default_rng(8)
    words = [prose(rng, 1) + str(i) * (i % 3 == 0) + chr(97 + i % 26) for i in range(120)] + ["Été", "ÉTÉ", "straße", "漢字", "İx"]
    rows = []
    for i in range(150):
        own = rng.choice(words, int(rng.integers(0, 60)), p=(w := 1 / np.arange(1, len(words) + 1)) / w.sum())
        rows.append((rng.choice([" ", "-", "1", "\x00", "\x7f", "\n_"]).join(own), ["en", "de", "", None, "xx"][min(i % 7, 4)], [f"s{i % 5}", None, "", "é"][0 if i % 3 else i % 4]))
    rows += [(None, "en", "silent"), ("", "en", "silent"), ("once only", "zz", "a"), (None, "zz", "b"), ("alpha " * 5000, "en", "s1"), *[("same row", "en", "s2")] * 4]
    df = spark.createDataFrame([(*r, i, "clash", 1) for i, r in enumerate(rows)], "text string, lang string, source string, doc_id long, term string, n int")
    got = defaultdict(dict)
    for r in divergence.audit(df.repartition(5), term_ranks=7).collect():
        got[r.lang, r.source, r.part][r.rank] = (r.item, r.value)
    want = audited(rows, 7)
    assert set(got) == set(want)
    for key, own in want.items():
        assert [got[key][i + 1] for i in range(len(own))] == own and len(got[key]) == len(own)
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_of_many_blocks(spark, monkeypatch, docs):  # noqa: F811
    docs = docs.withColumn("source", (F.col("doc_id") % 4).cast("string"))
    want = sorted(map(tuple, divergence.audit(docs).collect()))
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, divergence.audit(docs.repartition(20)).collect())) == want and want


def test_shares_beyond_a_long(spark):
    rows = [(n, t, k) for n in (0, 7, 8_999_999_999, 9_000_000_000, 10**12, 10**17) for t, k in ((n, 1), (3 * n, 10**6), (0, 0))]
    got = spark.createDataFrame(rows, "n long, t long, k long").select("n", "t", "k", divergence._share("n", "t", "k").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 1) // (t + k) if t + k else None for n, t, k in rows]


# --- panes ----------------------------------------------------------------------------------------


def told(rows, wait=6, keep=96):
    """The records of the whole stream, batch by batch."""
    hour, batches, seen = 3_600_000_000, defaultdict(list), set()
    start = dt.datetime(1970, 1, 1)
    for click_id, ts, arrived, kind, value in rows:
        if ts is None or arrived is None or click_id is None or click_id in seen:
            continue
        seen.add(click_id)
        day = (arrived - start).days
        q = day % 8
        batch = min(7, q + max(0, zlib.crc32(str(click_id).encode()) % 30 - 23))
        event = (ts - start) // dt.timedelta(microseconds=1) - (day - q) * 24 * hour
        batches[batch].append((click_id, event, kind or "none", int(np.floor(100 * value + 0.5)) if value is not None else 0))
    state, emitted, out, w = {}, {}, [], -np.inf
    for b in range(8):
        old = dict(state)
        for click_id, event, kind, cents in batches[b]:
            pane = (kind, event // hour)
            if w >= (pane[1] + 1 + keep) * hour:
                out.append((b, "late", *pane, click_id, 1, cents))
            else:
                n, c = state.get(pane, (0, 0))
                state[pane] = (n + 1, c + cents)
        for pane, (n, c) in state.items():
            if pane in emitted and old[pane] != (n, c):
                out += [(b, "retract", *pane, -1, *old[pane]), (b, "replace", *pane, -1, n, c)]
            elif pane not in emitted and w >= (pane[1] + 1 + wait) * hour:
                out.append((b, "emit", *pane, -1, n, c))
                emitted[pane] = b
            elif b == 7 and pane not in emitted:
                out.append((b, "final", *pane, -1, n, c))
        for pane in [p for p in state if w >= (p[1] + 1 + keep) * hour]:
            del state[pane]
            emitted.pop(pane, None)
        w = max([w, *(x[1] for x in batches[b])])
    return sorted(out)


KINDS = ["view", "click", None, "none", "buy"]
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, batch int, hour string, event int, record string"


def clicks_of(rng, n, first, days, spread):
    rows = []
    for i in range(n):
        arrived = first + dt.timedelta(seconds=int(rng.integers(0, days * 86400)))
        ts = arrived - dt.timedelta(microseconds=int(rng.exponential(spread) * 3.6e9))
        rows.append((i, ts, arrived, KINDS[int(rng.integers(0, 5))], [None, 1.005, -2.675, float(rng.normal())][int(rng.integers(0, 4))]))
    return rows


@pytest.mark.parametrize("first,days,spread", [(dt.datetime(2024, 3, 1), 20, 20), (dt.datetime(1969, 12, 20), 14, 60)])
def test_panes(spark, first, days, spread):
    rows = clicks_of(np.random.default_rng(days), 400, first, days, spread)
    rows += rows[:40] + [rows[3]] * 30 + [(9001, None, first, "view", 1.0), (9002, first, None, "view", 1.0), (None, first, first, "view", 1.0), (-5, first, first, "view", 3.0)]
    df = spark.createDataFrame([(*r, 1, "clash", 2, "clash") for r in rows], CLICKS)
    got = sorted((r.batch, r.record, r.kind, r.hour, r.click_id, r.n_rows, r.cents) for r in panes.revisions(df.repartition(3)).collect())
    assert got == told(rows)
    assert {r[1] for r in got} == {"late", "emit", "retract", "replace", "final"}


def test_panes_of_few_batches(spark):
    """Batches without rows, a jump past all horizons, a value that isn't finite, a session in a zone with summer time."""
    day = dt.datetime(2024, 3, 28)  # q = 2
    assert (day - dt.datetime(1970, 1, 1)).days % 8 == 2
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 30 <= 23][:3]
    slow = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 30 == 27)
    rows = [(ids[0], day, day, "view", 1.0), (ids[1], day + dt.timedelta(days=30), day, "view", 2.0), (slow, day, day, "view", 4.0), (ids[2], dt.datetime(2024, 3, 31, 2, 30), day, "view", 0.0)]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.createDataFrame([(*r, 1, "", 2, "") for r in rows], CLICKS)
        got = sorted((r.batch, r.record, r.kind, r.hour, r.click_id, r.n_rows, r.cents) for r in panes.revisions(df).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == told(rows) and {r[1] for r in got} == {"late", "emit", "final"}
    odd = spark.createDataFrame([(1, day, day, "view", float("nan"), 1, "", 2, "")], CLICKS)
    assert [(r.record, r.cents) for r in panes.revisions(odd).collect()] == [("final", 0)]
    assert panes.revisions(odd.limit(0)).count() == 0


def test_panes_in_many_partitions_open_no_native_store(spark, monkeypatch):
    """211 partitions of native stores, for each start and read, took gigabytes of an executor; a batch writes one table."""
    held, saved = [], []
    state, save = panes._state, panes.Workspace.save
    monkeypatch.setattr(panes, "_state", lambda session, checkpoint, batch: (held.append(checkpoint), state(session, checkpoint, batch))[1])
    monkeypatch.setattr(panes.Workspace, "save", lambda self, df: (saved.append(1), save(self, df))[1])
    rows = clicks_of(np.random.default_rng(5), 200, dt.datetime(2024, 3, 1), 12, 30)
    df = spark.createDataFrame([(*r, 1, "", 2, "") for r in rows], CLICKS)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = sorted((r.batch, r.record, r.kind, r.hour, r.click_id, r.n_rows, r.cents) for r in panes.revisions(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == told(rows) and len(saved) == panes.BATCHES
    log = "\n".join(r.value for r in spark.read.text(f"{held[0]}/offsets/0").collect())
    assert "HDFSBackedStateStoreProvider" in log and "RocksDB" not in log.split("providerClass")[1][:120]
