"""The operators against brute force and libraries, on small tables with awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, fingerprint, licenses, near_dedup, packing, quality, sharding, substring_dedup, topk, url_filter
from tests.llm.notices import NOTICES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sign string, key long"


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(n))


def corpus():
    """Near and exact copies, shared passages, null, empty, short and long texts; columns whose names operators use themselves."""
    rng = np.random.default_rng(5)
    base = [prose(rng, int(n)) for n in rng.integers(3, 300, 40)]
    passage = prose(rng, 60)
    texts = [*base, None, "", "   ", "one", "One  two\tthree", "one two three"]
    for i in range(25):  # near copies of one text
        words = base[0].split() + prose(rng, 80).split() if i == 0 else texts[-1].split()
        words[int(rng.integers(0, len(words)))] = "x"
        texts.append(" ".join(words))
    texts += [base[3]] * 12 + [base[4].upper()] + [prose(rng, 30) + " " + passage + " " + prose(rng, 5) for _ in range(8)]
    texts += [passage + " " + passage, prose(rng, 40_000), " ".join(["same"] * 200)]
    return [(i * 3, t, "en", "s", len(t or ""), "clash", i % 2) for i, t in enumerate(texts)]


ROWS = corpus()
TEXTS = {r[0]: r[1] for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('d')}/documents.parquet"
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, empty):
    sets = {}
    for d, t in TEXTS.items():
        w = [x.translate(LOWER) for x in WORD.findall(t or "")]
        sets[d] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: r for r in near_dedup.near_dedup(docs).collect()}
    assert len(got) == len(ROWS)
    for d in sets:
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(sets[d]), root(d), root(d) == d)
    kept = near_dedup.keep_one(docs, near_dedup.near_dedup(docs))
    assert kept.columns == docs.columns and kept.count() == sum(root(d) == d for d in sets)
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_duplicates_of_odd_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_dedup(df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]


def test_one_of_each_group_stays(spark, empty):
    rows = [(1, "t u v w x y"), (1, "t u v w x y"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "n"), (None, "n"), (3, None), (3, None), (None, None), (4, ""), (4, ""), (5, ""), (6, "A b c d e f")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, word long")
    kept = near_dedup.keep_one(df, near_dedup.near_dedup(df))
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "t u v w x y"), (2, "a b c d e f"), (None, "n"), (3, None), (4, ""), (5, "")], key=repr)
    assert near_dedup.keep_one(empty, near_dedup.near_dedup(empty)).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies near the limit: many are linked, many are just not, and sizes differ."""
    rng = np.random.default_rng(8)
    base = prose(rng, 120).split()
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(int(rng.integers(1, 9))):
            at = int(rng.integers(0, len(words)))
            words[at : at + int(rng.integers(1, 3))] = prose(rng, int(rng.integers(0, 3))).split()
        rows.append((i, " ".join(words[int(rng.integers(0, 6)) :])))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((up[a], up[b]))
                up = [x if u == y else u for u in up]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(up)) and 20 < len(set(up)) < 240


def cut_by_hand(texts):
    words = {d: WORD.findall(t or "") for d, t in texts.items()}
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substrings(docs, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == cut_by_hand(TEXTS)
    assert sum(n for _, n, _ in got.values()) > 1000
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substrings_of_repeated_rows(spark):
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, text), (1, text), (None, "a b"), (2, " ".join(map(str, range(100, 140))))], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.substring_dedup(df).collect()) == [("1", 50), ("1", 50), ("2", 0), ("None", 0)]


def test_difference_cover():
    for period in range(1, 25):
        cover = substring_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


ODD = ["", "   ", "we're!'s ''s's'll'x'vex '1's 1's", "'", "a'r", "'l 'v", "x<|endoftext|>y", "<|startoftext|> a <|endoftext|>", "e<|endoftext|>\u0301", "ΑΣ ΟΔΟΣ Σ", "İstanbul ß", "don't THEY'RE", "a\x1cb \x1d c\x85d\xa0e f\u200bg", "aaaaaaa aaaa", "123 4", "日本語 текст 😀", "a" * 3000]


def test_tokens(spark, docs, empty, tokenizer):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, *TEXTS.values()])], "doc_id long, text string")
    for r in bpe.encode(rows, keep=("doc_id", "text"), decode=True).collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert np.array(ids, "<u4").tobytes() == bytes(r.ids), r.text
        assert tokenizer.decode(ids, skip_special_tokens=False) == r.decoded
    encoded = bpe.encode(docs)
    assert {r.doc_id: r.decoded for r in bpe.decode(encoded).collect()} == {r.doc_id: r.decoded for r in bpe.encode(docs, decode=True).collect()}
    assert bpe.encode(empty).count() == 0


def test_tokens_of_every_code_point(tokenizer):
    """Alone between letters, digits and signs, after an accent, and next to its neighbours."""
    own = bpe.load(bpe.default_path())
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = ["".join(map(chr, points[i : i + 256])) for i in range(0, len(points), 256)]
    texts += ["".join(f"a{c}b1{c}!{c}e\u0301{c}\u0323\u0301 " for c in map(chr, points[i : i + 64])) for i in range(0, len(points), 64) if i < 0x33500 or i >= 0xE0000]
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        for text, ids, want in zip(part, own.encode_all(part), tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, hex(ord(text[0]))


def test_packing(docs, empty, tokenizer):
    pieces = packing.pack(docs, group=16).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for d, t in TEXTS.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by[d], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0  # nothing to pad
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, capacity=1000)


def test_packing_balances_cost():
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.integers(1, 1500, 400)]
    cost = collections.Counter()
    filled = collections.Counter()
    for parts in packing.assign(lengths, 2048):
        for _, n, s, _ in parts:
            cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
            filled[s] += n
    full = [cost[s] for s in cost if filled[s] == 2048]
    assert len(full) == sum(lengths) // 2048 and max(full) < 1.15 * min(full)


def test_urls(spark):
    urls = {
        1: "http://Example.COM/en/x?y", 2: "https://www.example.com/en/", 3: "http://badexample.com/en/", 4: "http://a.net/es/1#z", 5: "//com/", 6: None, 7: "http://com", 8: "x://a.b.example.com/EN/", 9: "http://net/fr/", 10: "http://net./fr/", 11: "http://.example.com/en/",
        12: "http://www.example.com:80/en/", 13: "", 14: "http://example.com?/en/",
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in urls.items()], "page_id long, url string, host string")
    for rules in (url_filter.RULES, (*url_filter.RULES, ("b.example.com", "", "block"), ("example.com", "/", "block"), ("com", "/", "allow")), ()):
        got = {r.page_id: r for r in url_filter.judge(pages, url_filter.rule_table(spark, rules), sweeps=3).collect()}
        for i, u in urls.items():
            rest = (u or "").partition("://")[2]
            host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
            fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fit, default=(0, 0, None, "allow"))
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[2], best[3]), (u, rules)


@pytest.mark.parametrize("limit", [1, 300, 5000, 1 << 20])
def test_shards(docs, empty, limit):
    rows = {r.doc_id: r for r in sharding.shard(docs, limit=limit).collect()}
    assert len(rows) == len(ROWS)
    size = {d: len((t or "").encode()) for d, t in TEXTS.items()}
    bits = {d: f"{int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16):060b}" for d in TEXTS}

    def total(prefix):
        return sum(n for d, n in size.items() if bits[d].startswith(prefix))

    for d, r in rows.items():
        assert r.shard == bits[d][: r.depth] and r.shard_bytes == total(r.shard) and r.n_bytes == size[d]
        assert r.shard_bytes <= limit or r.depth == 60
        assert r.depth == 0 or total(r.shard[:-1]) > limit  # split no further than needed
    assert sharding.shard(empty, limit=limit).count() == 0


def test_fingerprints(spark, docs, empty, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op6_fingerprint(spark, f"file://{tmp_path}").collect()}
    order = sorted(TEXTS, reverse=True)

    def shingles(t):
        w = [x.translate(LOWER) for x in WORD.findall(t)]
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def like(a, b):
        a, b = shingles(a), shingles(b)
        return 1.0 if not a | b else len(a & b) / len(a | b)

    prints = {}
    for i, d in enumerate(order):
        t, n = TEXTS[d] or "", TEXTS[order[(i + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        small = len(shingles(t) | shingles(edited)) <= fingerprint.K
        assert abs(r.near_edited - like(t, edited)) < (1e-9 if small else 0.2)
        assert abs(r.near_next - like(t, n)) < 0.2
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    est = {r.doc_id: r.n_shingles for r in fingerprint.fingerprints(docs).collect()}
    for d, t in TEXTS.items():
        assert abs(est[d] - len(shingles(t or ""))) <= 0.35 * len(shingles(t or ""))
    assert fingerprint.fingerprints(empty).count() == 0


@pytest.mark.parametrize("sampled", [32, 0.5])
def test_next_document_of_repeated_and_missing_ids(spark, monkeypatch, sampled):
    """Ranges of a few bytes: one doc_id and the rows without one are cut into several, also by few ids."""
    monkeypatch.setattr(fingerprint, "_RANGE_BYTES", 60)
    monkeypatch.setattr(fingerprint, "_RANGE_SAMPLE", sampled)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"t{i % 90}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprint.with_next(df, ["text"]).select("doc_id", "text", "next.text", F.xxhash64("text")).collect()
    order = sorted(got, key=lambda r: (r[0] is None, -(r[0] or 0), r[3], r[1]))
    assert sorted(map(str, rows)) == sorted(str((r[0], r[1])) for r in got)
    want, have = collections.Counter(), collections.Counter()
    for r, s in zip(order, [*order[1:], order[0]]):
        want[r[0], r[1], s[1]] += 1
        have[r[0], r[1], r[2]] += 1
    assert want == have


def test_ranges_found_by_halving(spark):
    for falling in ([], [5], [9, 7, 5], [*range(300, 0, -3)]):
        got = spark.range(-2, 305).select("id", fingerprint._larger(falling, F.col("id"))).collect()
        assert all(n == sum(b > i for b in falling) for i, n in got)


def test_fingerprints_merge(spark):
    df = spark.createDataFrame([("a b c d e f g h", "c d e f g h i j k")], "x string, y string").select(fingerprint.sketch(fingerprint.shingle_hashes(F.col("x"))).alias("x"), fingerprint.sketch(fingerprint.shingle_hashes(F.col("y"))).alias("y"))
    r = df.select(fingerprint.resemblance(F.col("x"), F.col("y")), fingerprint.containment(F.col("x"), F.col("y")), F.size(fingerprint.merge(F.col("x"), F.col("y")))).first()
    assert tuple(r) == (2 / 7, 0.5, 7)


def test_licences(spark, empty):
    texts = {
        1: ("Some words here.\nReleased under the MIT License.", {"mit"}), 2: ("Licensed under the Apache License, Version 2.0.", {"apache"}), 3: ("This work is licensed under the GNU General Public License, version 3.", {"gpl"}),
        4: ("Licensed under CC BY-NC 4.0.", {"cc"}), 5: ("Der Mann geht mit der Frau. By and by.", set()), 6: (None, set()), 7: ("", set()), 8: ("Licensed under the Zorblax Public License.", {"unknown"}), 9: ("and " * 500, set()),
        12: ("Er geht mit der Frau, mit dem Kind und mit dem Hund. " * 5, set()), 13: ("The this of that on in. Is the that of this. By on as is the that.", set()), 14: ('token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" From reha', set()),
        10: ("Dual licensed under the MIT license or Apache-2.0.", {"mit", "apache"}), 11: ("*** -- !!!\n\n ... ", set()),
    }
    model = licenses.trained()
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    for r in licenses.scan(df, model).collect():
        assert {f.family for f in r.found} == texts[r.doc_id][1], (texts[r.doc_id], r.found)
    assert licenses.scan(empty, model).count() == 0


def test_licence_probabilities_hold_on_what_training_has_not_seen():
    model = licenses.trained()
    assert model.kept > 0.9 and model.turned_away > 0.85
    assert all(abs(foretold - came) < 0.12 for foretold, came in model.reliability)


def test_licences_of_notices_in_free_wordings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: {f.family for f in r.found} for r in licenses.scan(df).collect()}
    assert sum(got[i] == want for i, (_, want) in enumerate(NOTICES)) >= 0.85 * len(NOTICES)


WRAPPED = """Copyright (c) 2020 Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def by_hand(model, words):
    """Probabilities of a window, summed feature by feature in plain Python."""
    ids = [model.words.get(w, 0) for w in words]
    pairs = {int(k): i for i, k in enumerate(model.pairs)}
    used = {i for i in ids if i} | {model.size + pairs[k] for a, b in zip(ids, ids[1:], strict=False) if (k := a * model.size + b) in pairs}
    z = [float(model.weights[-1, h]) + sum(float(model.weights[u, h]) for u in used) for h in range(model.weights.shape[1])]
    return np.array([1 / (1 + np.exp(-v)) for v in z])


def test_licences_like_one_window_after_the_other(spark):
    rng = np.random.default_rng(12)
    texts = [WRAPPED, "SPDX-License-Identifier: AGPL-3.0-or-later", "GPL-2.0-only", "You can redistribute it under the terms of the GNU Affero General Public License.", prose(rng, 30_000) + "\nReleased under the MIT License.\n" + prose(rng, 100)]
    texts += [f"{prose(rng, 90)} Licensed under the Apache License, Version 2.0. {prose(rng, 70)}\n{prose(rng, 5)}"]
    texts += [f"{' '.join(words)}\n{prose(rng, 5)} {' '.join(words)} {prose(rng, 80)}" for words, _, _ in licenses.examples(5)[::40]]
    texts += [t for t, _ in NOTICES] + ["\n".join(t for t, _ in NOTICES), " ".join(t for t, _ in NOTICES)]
    texts += [texts[0]] * 3
    model = licenses.trained()
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_paragraphs long, found string")
    got = {r.doc_id: r for r in licenses.scan(df, model).collect()}
    for i, text in enumerate(texts):
        want, lines = {}, licenses.paragraphs(text.encode())
        for number, line in enumerate(lines):
            words, here = licenses.tokens(line.decode()), {}
            for a, b in licenses.windows(len(words)):
                for family, (p, sure) in model.judge(by_hand(model, words[a:b]), words[a:b]).items():
                    here[family] = max(here.get(family, (False, 0.0)), (sure, p))
            want |= {(number, f): v for f, v in here.items() if f != licenses.UNKNOWN or len(here) == 1}
        assert got[i].n_paragraphs == len(lines)
        found = {(f.paragraph, f.family): (f.confirmed, f.probability) for f in got[i].found}
        assert found.keys() == want.keys(), text
        assert all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-4 for k in want)
    assert [(f.family, f.confirmed) for f in got[0].found] == [("isc", True)]
    assert [[(f.family, f.confirmed) for f in got[i].found] for i in (1, 2, 3, 4, 5)] == [[("agpl", True)], [("gpl", True)], [("agpl", True)], [("mit", True)], [("apache", True)]]


def test_quality(spark, empty):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = prose(rng, int(rng.integers(20, 200)))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), f"{i}"))
        if i % 5 != 1:
            labels.append((i, int(good), 0))
    rows += [(1000, None, ""), (1001, "", ""), (1001, "", ""), (None, "a", "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(docs, marks)
    got = quality.rate(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    right = [r.predicted == int(r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean(right) > 0.95
    assert np.allclose(model.score(np.zeros((1, len(quality.FEATURES)))), next(r.score for r in got if r.doc_id == 1000))
    # the vectorised additions against a walk through the tables, for texts and for values at and beyond every edge
    def by_hand(x):
        z = model.bias + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(x, model.edges, model.tables, strict=True))
        low = [sum(v >= e for e in edges) for v, edges in zip(x, model.coarse, strict=True)]
        z += sum(t[low[a]][low[b]] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        return 1 / (1 + np.exp(-z))

    assert model.pairs and any(np.ptp(t) > 0 for t in model.pair_tables) and sum(np.ptp(t) > 0 for t in model.tables) > 1
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is not None:
            assert abs(r.score - by_hand(quality.features(texts[r.doc_id].encode() if texts[r.doc_id] else None))) < 1e-9
    for j, edges in enumerate(model.edges):
        for v in [*edges, *(np.nextafter(edges, -np.inf)), -1e9, 1e9]:
            x = np.array(quality.features(texts[5].encode()), float)
            x[j] = v
            assert abs(model.score(x[None, :])[0] - by_hand(x)) < 1e-9
    nothing = quality.learn(empty, marks.limit(0))
    assert [r.score for r in quality.rate(docs, nothing).limit(1).collect()] == [0.5]
    assert quality.rate(empty, model).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.3, (700, 24)).astype(np.float32)
    x[50:80] = x[7]  # ties
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)]
    rows += [(700, None, 0), (800, [], 0), (900, [float("nan")] * 24, 0), (1000, [None] + [0.1] * 23, 0), (1100, [1.0, 2.0], 0), (None, [0.5] * 24, 0), (1101, [0.25, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    for i in range(0, 700, 100):
        scores = q @ q[i]
        assert got[i] == sorted(((int(j), int(scores[j])) for j in range(700) if j != i), key=lambda p: (-p[1], p[0]))[:10]
    assert got[1100] == [(1101, 256 * 1024 + 1024 * 2048)]
    assert set(got) == {*range(0, 700, 100), 1100}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    twice = df.where("vec_id < 60").unionAll(df.where("vec_id in (0, 5)"))
    again = topk.top_k(twice, twice.where("vec_id = 0")).orderBy("rank").collect()
    want = sorted([(int(j), int(q[j] @ q[0])) for j in [*range(1, 60), 5]], key=lambda p: (-p[1], p[0]))[:10]
    assert [(r.vec_id, r.score) for r in again] == want


def test_query_blocks_are_held(spark, monkeypatch):
    """Several query blocks in one part, taken in turns: each is made once, or again if too many are held; the result is the same."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 0.3, (260, 8))
    df = spark.createDataFrame([(i, [float(v) for v in e], "clash") for i, e in enumerate(x)], "vec_id long, embedding array<double>, rank string").coalesce(1)
    q = np.floor(x * 1024).astype(np.int64)
    want = {i: sorted(((int(j), int(s)) for j, s in enumerate(q @ q[i]) if j != i), key=lambda p: (-p[1], p[0]))[:10] for i in range(0, 260, 2)}
    for held in (64, 1):
        monkeypatch.setattr(topk, "HELD", held)
        got = collections.defaultdict(list)
        for r in topk.top_k(df, df.where("vec_id % 2 = 0"), block=16).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert got == want


def test_substrings_of_rows_in_no_order(spark, docs):
    """An input that comes out of a shuffle is written first: a task that runs again finds the same chunks."""
    plain = sorted((tuple(r) for r in substring_dedup.substring_dedup(docs).collect()), key=str)
    assert sorted((tuple(r) for r in substring_dedup.substring_dedup(docs.repartition(5).where("doc_id >= 0")).collect()), key=str) == plain


def test_very_long_texts(spark):
    rng = np.random.default_rng(6)
    long = prose(rng, 60_000)
    pages = spark.createDataFrame([(1, "https://www.example.com/en/" + long.replace(" ", "/"))], "page_id long, url string")
    r = url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).first()
    assert (r.rule, r.verdict) == ("www.example.com/en/", "allow") and r.path.startswith("/en/") and len(r.path) > 100_000
    docs = spark.createDataFrame([(i, long if i == 3 else prose(rng, 50)) for i in range(20)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert quality.rate(docs, quality.learn(docs.unionAll(docs), marks)).count() == 20
    assert [len(r.sketch) for r in fingerprint.fingerprints(docs.where("doc_id = 3")).collect()] == [fingerprint.K]
    assert sharding.shard(docs, limit=1000).where("doc_id = 3").first().n_bytes == len(long.encode())
