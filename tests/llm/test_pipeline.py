"""The pipeline's stages against brute force, each on what the one before kept."""

import numpy as np

import corpus_pipeline as P
from corpusloom.llm.quality import features, learn
from tests.llm.test_operators import LOWER, ROWS, SCHEMA, cut_by_hand, prose


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(9)
    junk = [(10_000 + i, prose(rng, 80).upper().replace(" ", "!! "), "en", "s", 0, "c", 1) for i in range(60)]
    marks = [(r[0], 1, 0) for r in ROWS if r[1] and len(r[1]) > 100] + [(r[0], 0, 0) for r in junk]
    d = f"file://{tmp_path}"
    spark.createDataFrame([*ROWS, *junk], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")

    kept = P.quality(spark, docs, d)
    assert tuple(kept.columns) == P.COLUMNS
    model = learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
    want = {r[0] for r in [*ROWS, *junk] if model.score(np.array([features(r[1].encode() if r[1] else None)]))[0] >= 0.3}
    assert {r.doc_id for r in kept.collect()} == want and not want & {r[0] for r in junk}

    kept.write.parquet(f"{d}/1")
    alone = P.near_duplicates(spark, spark.read.parquet(f"{d}/1"), d)
    assert tuple(alone.columns) == P.COLUMNS
    alone.write.parquet(f"{d}/2")
    left = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/2").collect()}
    texts = [" ".join(t.split()).translate(LOWER) for t in left.values() if t and t.strip()]
    assert len(texts) == len(set(texts))

    cut = P.substrings(spark, spark.read.parquet(f"{d}/2"), d)
    assert tuple(cut.columns) == P.COLUMNS
    by_hand = cut_by_hand(left)
    for r in cut.collect():
        n, gone, text = by_hand[r.doc_id]
        assert r.text == (text if gone else left[r.doc_id])
    cut.write.parquet(f"{d}/3")

    pieces = P.packing(spark, spark.read.parquet(f"{d}/3"), d).collect()
    assert {p.doc_id for p in pieces} == set(left)
    whole = {tuple(r) for r in P.run(spark, d).select("doc_id", "start", "length", "ids_crc32").collect()}
    assert {r[0] for r in whole} == set(left)


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    rng = np.random.default_rng(4)
    one, two, three = (prose(rng, 90) for _ in range(3))
    rows = [(1, one), (1, one), (2, two), (None, two), (None, three), (None, three), (7, None), (7, "")]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = f"file://{tmp_path}"
    left = P.substrings(spark, P.near_duplicates(spark, df, d), d)
    assert sorted((r.text for r in left.collect() if r.text)) == sorted([one, two, three])
    pieces = P.packing(spark, left, d).collect()
    assert sorted({p.doc_id for p in pieces}, key=str) == [1, 2, 7, None]

    df.limit(0).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert P.run(spark, d).count() == 0
