"""Tables with versions, unknown keys of records, streams of changes, selection and look-up: against plain Python."""

import hashlib
import io
import json
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import generate as G
from corpusloom.operators import lifecycle as L
from corpusloom.operators import report as P
from corpusloom.operators.phrases import phrases_of_table
from corpusloom.plans import commands as C
from corpusloom.sources import files
from corpusloom.sources import records as S
from corpusloom.sources import unknown as U
from corpusloom.sources import workbooks as W
from corpusloom.sources.snapshots import CommitConflict, SnapshotTable, upsert
from corpusloom.streaming import changes, translate as M


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/table"


def numbers(df):
    return sorted(r[0] for r in df.collect())


# --- versions ---------------------------------------------------------------------------------------


def test_versions(spark, place):
    t = SnapshotTable(spark, place)
    assert t.latest() is None
    with pytest.raises(LookupError):
        t.read()
    first = t.append(spark.range(3), run=("load", 0), fold=lambda notes, rows: {"n": notes.get("n", 0) + rows.count()})
    old = t.read(first)
    assert t.append(spark.range(3), run=("load", 0)).number == 0  # the step is there already
    t.append(spark.range(5, 7), run=("load", 1), fold=lambda notes, rows: {"n": notes.get("n", 0) + rows.count()})
    assert t.latest().notes == {"n": 5} and t.latest().runs == {"load": 1} and numbers(t.read()) == [0, 1, 2, 5, 6]
    assert {r.place: r.n for r in t.read(order="place").groupBy("place").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 2}
    with pytest.raises(CommitConflict):
        t.replace(spark.range(1), base=0)
    assert numbers(t.read()) == [0, 1, 2, 5, 6]
    t.replace(spark.range(1), base=1)
    assert numbers(t.read()) == [0] and numbers(t.read(1)) == [0, 1, 2, 5, 6] and numbers(old) == [0, 1, 2]
    assert [(r.number, r.operation, r.parts) for r in t.history().orderBy("number").collect()] == [(0, "append", 1), (1, "append", 2), (2, "replace", 1)]
    assert t.vacuum(1) == 2 and numbers(t.read()) == [0]
    with pytest.raises(LookupError):
        t.read(1)
    files.delete(spark, f"{place}/_log/_latest")  # only a hint
    assert t.latest().number == 2
    files.write_bytes(spark, f"{place}/_log/_latest", b"99")
    assert t.latest().number == 2 and numbers(t.read()) == [0]


def test_two_writers(spark, place):
    """Whoever comes second doesn't undo the first: appends go on, replacements are refused or begin again."""
    t = SnapshotTable(spark, place)
    t.append(spark.range(1))
    seen = []

    def slow(now):
        seen.append(numbers(now))
        if len(seen) == 1:
            SnapshotTable(spark, place).append(spark.range(10, 11))
        return now.union(spark.range(100 + len(seen), 101 + len(seen)))

    upsert(t, slow)
    assert seen == [[0], [0, 10]] and numbers(t.read()) == [0, 10, 102]
    failed = []

    def work(k):
        try:
            for i in range(3):
                SnapshotTable(spark, place).append(spark.range(1000 * k + i, 1000 * k + i + 1), run=(f"w{k}", i))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=work, args=(k,)) for k in (1, 2, 3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and numbers(t.read()) == sorted([0, 10, 102, *(1000 * k + i for k in (1, 2, 3) for i in range(3))])
    assert t.latest().number == 2 + 9 and not files.put_if_absent(spark, f"{place}/_log/{3:020d}.json", b"x")


def test_plain_data_is_a_first_version(spark, tmp_path):
    spark.range(2).write.parquet(f"file://{tmp_path}/plain")
    t = SnapshotTable(spark, f"file://{tmp_path}/plain")
    assert t.latest().number == -1 and numbers(t.read()) == [0, 1]
    t.append(spark.range(2, 3))
    assert numbers(t.read()) == [0, 1, 2]
    (tmp_path / "one.jsonl").write_text('{"a": 1}\n')
    one = SnapshotTable(spark, f"file://{tmp_path}/one.jsonl", "text")
    assert [r.value for r in one.read(schema="value string").collect()] == ['{"a": 1}']
    one.append(spark.createDataFrame([('{"a": 2}',)], "value string"))
    assert sorted(r.value for r in one.read(schema="value string").collect()) == ['{"a": 1}', '{"a": 2}']


def test_lines_are_compressed(spark, tmp_path):
    line = '{"a": "' + "the same again and again " * 40 + '", "n": %d}'
    rows = spark.createDataFrame([(line % i,) for i in range(500)], "value string").coalesce(1)
    for kind in ("text", "json"):
        table = SnapshotTable(spark, f"file://{tmp_path}/{kind}", kind)
        table.append(rows)
        table.append(rows.limit(1))
        assert sorted(r.value for r in table.read(schema="value string").collect()) == sorted([line % i for i in range(500)] + [line % 0])
        assert sum(f.stat().st_size for f in (tmp_path / kind).glob("data-*/part-*")) < 500 * len(line) / 20


# --- unknown keys --------------------------------------------------------------------------------------


def test_unknown_keys(spark, tmp_path):
    records = [
        {"id": "1", "mine": {"k": [1, "x", None, {"d": 1.5}]}, "a": {"x": 1, "own": 'é"q', "b": {"y": "s", "more": True}}, "n": None},
        {"id": "2"},
        {"id": "3", "a": None, "e": {"w": "12", "v": 12}, 'odd "key"': {}, "null": None},
    ]
    schema = "id string, a struct<x:int,b:struct<y:string>,z:array<string>>, n int, e struct<q:int>"
    df = spark.createDataFrame([], schema)
    (tmp_path / "r.jsonl").write_text("\n".join(["", *map(json.dumps, records), "  "]))
    got = S.read_records(spark, f"file://{tmp_path}/r.jsonl", df.schema)
    blank = {"id": None, "a": None, "n": None, "e": None}
    want = [{**blank, **r} for r in records]
    want[0]["a"]["z"], want[2]["e"]["q"] = None, None

    def texts(frame):
        return sorted((json.loads(r.value) for r in S.lines_of(frame).collect()), key=lambda r: r["id"])

    assert texts(got) == want
    changed = got.withColumn("a", F.col("a").withField("x", F.lit(7))).withColumn("n", F.lit(5)).join(spark.createDataFrame([("1", 1)], "id string, m int"), "id", "left").drop("m")
    assert texts(changed)[0] == {**want[0], "n": 5, "a": {**want[0]["a"], "x": 7}}
    assert texts(U.without(got, "a.b", "e"))[0]["a"]["b"] == {"y": "s"} and "w" not in texts(U.without(got, "e"))[2]["e"]
    assert texts(got.drop(U.UNKNOWN))[0] == {k: ({x: v[x] if x != "b" else {"y": "s"} for x in ("x", "b", "z")} if k == "a" else v) for k, v in want[0].items() if k != "mine"}
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n{broken\n')
    with pytest.raises(Exception):  # noqa: B017
        S.read_records(spark, f"file://{tmp_path}/bad.jsonl", df.schema).collect()


def test_a_build_keeps_unknown_keys_and_counts_each_commit(spark, tmp_path, monkeypatch, capsys):
    paths = C.Paths(**{k: f"file://{tmp_path}/{v}" for k, v in C.asdict(C.Paths()).items()})
    raw = [json.loads(r.value) for r in S.lines_of(G.raw_corpus(spark).where("tier = 'T1' and prompt_id like '%07'")).orderBy("value").limit(4).collect()]
    for i, r in enumerate(raw):
        r["notes_of_ours"], r["metadata"]["reviewers"], r["instruction_multilingual"]["hi"]["old"] = {"i": i}, [i, "b"], "x"
    (tmp_path / "corpus_build").mkdir()
    (tmp_path / "corpus_build/corpus_raw.jsonl").write_text("\n".join(map(json.dumps, raw)))
    C.prepare(spark, paths)
    assert "12" in capsys.readouterr().out
    seen = []
    plain = C._summarise

    def told(spark, path, counts, assumptions):
        plain(spark, path, counts, assumptions)
        manifest = C.read_manifest(spark, paths.manifest)
        state = tmp_path / "corpus_build/translation_run_state.json"
        done = json.loads(state.read_text())["translated_language_jobs"] if state.exists() else 0
        summary = json.loads((tmp_path / "corpus_build/translation_summary.json").read_text())
        seen.append((done, sum(c.get("model_translated", 0) for c in summary["translation_status_counts"].values()), manifest.where("translation_target.literal is not null").count(), manifest.count()))

    monkeypatch.setattr(C, "_summarise", told)
    assert C.translate(spark, paths, M.EchoTranslator, model="echo", verifier="echo", batch_size=2, batches_a_commit=2)
    assert seen == [(0, 0, 0, 12), (4, 4, 4, 12), (8, 8, 8, 12), (12, 12, 12, 12), (12, 12, 12, 12)]
    ready = C.read_records(spark, paths.ready)
    assert P.tally(ready) == P.plus(P.tally(ready), {}) and sum(n for k, n in P.tally(ready).items() if k[-1]) == 12
    assert P.summary(ready, {}) == P.summary(P.tally(ready), {})
    C.finalize(spark, paths)
    final = sorted((json.loads(x) for p in (tmp_path / "corpus_build/corpus_multilingual_final.jsonl").glob("part-*") for x in p.read_text().splitlines()), key=lambda r: r["prompt_id"])
    assert [(r["notes_of_ours"], r["metadata"]["reviewers"]) for r in final] == [({"i": i}, [i, "b"]) for i in range(4)]
    assert all("old" not in r["instruction_multilingual"]["hi"] and r["metadata"]["translation_status"] == "complete" for r in final)
    # a writer that changes the records while a run goes on loses nothing
    again = S.record_table(spark, paths.ready)
    assert again.latest().number >= 1


def test_gates_name_the_first_record(spark):
    raw = G.raw_corpus(spark).where("tier = 'T1' and prompt_id like '%03'")
    ready = L.make_ready(raw)
    first = ready.agg(F.min("prompt_id")).first()[0]
    with pytest.raises(L.NotReleasable, match=f"{first} is missing hi"):
        L.finalize(ready)
    done = L.merge_translations(ready, M.translate(M.jobs(ready), M.EchoTranslator), model="m", method="t")
    with pytest.raises(L.NotReleasable, match=f"{first} has untranslated or unapproved"):
        L.finalize(done, require_approved=True)
    assert L.finalize(done).count() == ready.count()


# --- streams of changes ---------------------------------------------------------------------------------


def test_changes_arrive_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 20)), int(rng.integers(0, 50)) if rng.random() > 0.1 else None, i, rng.choice(["I", "U", "D", None])) for i in range(300)]
    rows += [(None, 1, 900, "I"), (3, 99, 901, "U"), (3, 99, 901, "U")]
    schema = "k long, seq long, id long, op string"
    for i in range(5):
        spark.createDataFrame(rows[i::5], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    kind = spark.createDataFrame([], schema).schema
    args = (spark, f"file://{tmp_path}/in", kind, ("k",), ("seq", "id"), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    table = changes.merge_stream(*args)
    want = {}
    for r in rows:
        if r[0] not in want or (r[1] is not None, r[1] or 0, r[2]) > (want[r[0]][1] is not None, want[r[0]][1] or 0, want[r[0]][2]):
            want[r[0]] = r
    assert {r.k: tuple(r) for r in changes.merged(table, ("k",)).collect()} == want
    spark.createDataFrame([(4, 0, 0, "late"), (77, 0, 0, "new")], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
    changes.merge_stream(*args)  # takes up where it stopped
    want[77] = (77, 0, 0, "new")
    assert {r.k: tuple(r) for r in changes.merged(table, ("k",)).collect()} == want
    changes.compact(table, ("k",))
    assert len(table.latest().parts) == 1 and {r.k: tuple(r) for r in changes.merged(table, ("k",)).collect()} == want


# --- selection and look-up ------------------------------------------------------------------------------


@pytest.mark.parametrize("digits", [1, 3])
def test_first_of_each(spark, monkeypatch, digits):
    monkeypatch.setattr(G, "RANGE_DIGITS", digits)
    rows = [(g, f"t{i}") for g, n in (("a", 700), ("b", 3), (None, 40), ("", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, t string").repartition(5)
    got = G.first_of_each(df, by="g", text="t", wanted=F.least(F.lit(100), F.ceil(F.col("size") / 2)))
    for g in ("a", "b", None, ""):
        own = sorted((t for x, t in rows if x == g), key=lambda t: (hashlib.md5(f"{G.SEED}|{g or ''}|{t}".encode()).hexdigest(), t))
        found = {r.rank: r.t for r in got.collect() if r.g == g}
        assert [found[i + 1] for i in range(len(found))] == own[: min(100, -(-len(own) // 2))]
    assert G.first_of_each(df.limit(0), by="g", text="t", wanted=F.lit(5)).count() == 0


def test_dedupe_of_rows_equal_in_order(spark):
    rows = [("en", 1, "A b"), ("en", 1, "A b"), ("en", 1, "a  B"), ("en", 0, "c"), (None, 5, "a b"), (None, 4, "A B"), ("en", None, "d"), ("en", 2, None), ("en", 3, None)]
    once = G.dedupe_casefold(spark.createDataFrame(rows, "lang string, n int, t string"), "t", by=("lang",), order=("n",))
    got = sorted(((r.lang, r.n, (r.t or "-").lower()) for r in once.collect()), key=str)
    assert got == sorted([("en", 1, "a b"), ("en", 0, "c"), (None, 4, "a b"), ("en", None, "d"), ("en", 2, "-")], key=str)


def test_phrases_of_a_table(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcé"), rng.integers(1, 6)))
    texts = [(i, " ".join(word() for _ in range(int(rng.integers(0, 40))))) for i in range(120)] + [(500, None), (501, ""), (7, "zzz b c")]
    phrases = [" ".join(word() for _ in range(int(rng.integers(1, 5)))) for _ in range(200)]
    for _, t in texts[:40]:  # pieces that do occur, cut inside words too
        if t and len(t) > 12:
            at = int(rng.integers(0, len(t) - 10))
            phrases.append(t[at : at + int(rng.integers(3, 10))].strip())
    phrases += ["", " ", None, "zz", "b c", phrases[0]]
    got = {r.doc_id: r.phrases for r in phrases_of_table(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    want = {}
    for i, t in texts:
        want.setdefault(i, set()).update(p for p in phrases if t and p and p.strip() and p in t)
    assert got == {i: sorted(ps, key=str.encode) for i, ps in want.items() if ps}
    assert len(got) > 60


# --- workbooks and batches --------------------------------------------------------------------------------


def test_workbooks_of_many_tasks(spark, tmp_path):
    rows = [(f"{i:04d}", ["a<b>&", None, "न", " two  \n lines "][i % 4], i / 4, i % 2 == 0) for i in range(250)]
    df = spark.createDataFrame(rows, "id string, text string, x double, even boolean").repartition(4)
    path = f"file://{tmp_path}/books"
    W.write_workbooks(df, path, ("id",))
    got = W.read_workbooks(spark, path).orderBy("file", "sheet", "row").collect()
    assert [r.cells["id"] for r in got] == [r[0] for r in rows]
    assert [r.cells.get("text") for r in got] == [r[1] for r in rows] and [float(r.cells["x"]) for r in got] == [r[2] for r in rows]
    W.write_workbooks(df, path)
    several = W.read_workbooks(spark, path).collect()
    assert len(several) == 250 and len({r.file for r in several}) == 4
    W.write_workbooks(df.where("id < '0010'"), path)
    assert W.read_workbooks(spark, path).count() == 10 and not (tmp_path / "books/_temporary").exists()
    W.write_workbooks(df.where("id < '0005'"), path, overwrite=False)
    assert W.read_workbooks(spark, path).count() == 15
    with pytest.raises(Exception):  # noqa: B017  a task that fails leaves what was there
        W.write_workbooks(df.withColumn("x", F.when(F.col("id") == "0077", F.raise_error(F.lit("no"))).otherwise(F.col("x"))), path)
    assert W.read_workbooks(spark, path).count() == 15 and not (tmp_path / "books/_temporary").exists()


def test_sheets_of_a_workbook():
    out = io.BytesIO()
    assert W.write_book(out, ([i, True, None] for i in range(10)), ["n", "b", "z"], [5, 6, 7], sheet_rows=5) == 10
    with zipfile.ZipFile(out) as z:
        assert [z.read(f"xl/worksheets/sheet{i}.xml").count(b"<row ") for i in (1, 2, 3)] == [5, 5, 3] and z.read("xl/workbook.xml").count(b"<sheet ") == 3
    W.write_book(out := io.BytesIO(), [], ["n"], [5])
    with zipfile.ZipFile(out) as z:
        assert z.read("xl/worksheets/sheet1.xml").count(b"<row ") == 1


class Watched(M.EchoTranslator):
    """Writes each batch it is given into its texts."""

    def translate(self, sentences, source, target):
        longest = max(map(len, sentences))
        return [f"{len(sentences)} {longest} {sum(map(len, sentences))}" for _ in sentences]


def test_batches_of_like_lengths(spark):
    assert M.cuts([], 3, 100) == [] and M.cuts([5, 5, 5, 5], 3, 100) == [(0, 3), (3, 4)] and M.cuts([1, 40, 60, 500, 501], 9, 100) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    rng = np.random.default_rng(1)
    rows = [(f"p{i:04d}", c, "x" * int(rng.integers(1, 400)), "y") for i in range(300) for c in ("hi", "te")]
    todo = spark.createDataFrame(rows, "prompt_id string, code string, canonical string, natural string")
    made = M.translate(todo, Watched, verify=False, batch_size=16, budget=4000).collect()
    assert {(r.prompt_id, r.code) for r in made} == {r[:2] for r in rows}
    size = {r[:2]: len(r[2]) for r in rows}
    padded = used = 0
    for r in made:
        n, longest, total = map(int, r.literal.split(" "))
        assert n <= 16 and (n == 1 or n * longest <= 4000) and size[r.prompt_id, r.code] <= longest
        padded, used = padded + longest, used + total / n
    assert used / padded > 0.85  # of what a model would read is text


def test_numbers_are_dealt_from_keys_written_once(spark):
    from corpusloom.operators import lifecycle as L

    seen = spark.sparkContext.accumulator(0)

    def told(rows):
        for row in rows:
            seen.add(1)
            yield row

    df = spark.createDataFrame(spark.sparkContext.parallelize([(f"{i:03d}",) for i in range(200)]).mapPartitions(told), "k string")
    assert sorted((r.k, r.batch) for r in L.batches(df, "k", 7).collect()) == [(f"{i:03d}", i // 7) for i in range(200)]
    assert seen.value == 200  # sampling, counting and numbering made each row anew


def test_what_nobody_reads_of_translations_is_not_shuffled(spark):
    from corpusloom.operators import lifecycle as L

    ready = L.make_ready(G.entry_columns(spark.createDataFrame([("T1", "Walk.", 1, False)], "tier string, prompt string, number long, review_required boolean")))
    done = spark.createDataFrame([("kimodo_000001", "hi", "x", "y", (True, True, True, True), ["n"])], "prompt_id string, code string, literal string, robot_natural string, verification struct<action_preservation:boolean,order_preservation:boolean,direction_preservation:boolean,safety_preservation:boolean>, translation_notes array<string>")
    merged = L.merge_translations(ready, done, model="m", method="t")
    row = merged.first()
    assert (row.translation_hi.literal, row.translation_hi.translation_notes, row.translation_hi.provenance.translation_model, row.instruction_multilingual.hi.robot_natural) == ("x", ["n"], "m", "y")
    assert row.translation_bn.status == "pending" and row.translation_bn.literal is None and row.pipeline.stage == "translation_in_progress"
    plan = merged.select("prompt_id", F.col("translation_hi.status").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translation_notes" not in plan.split("Aggregate", 1)[1].splitlines()[0]


def test_the_words_of_phrases_meet_texts_without_a_shuffle_while_few(spark):
    texts = spark.createDataFrame([(i, f"w{i} turn left") for i in range(50)], "doc_id long, text string")
    plan = phrases_of_table(texts, spark.createDataFrame([("turn left",)], "phrase string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [word" in plan


def test_a_plan_without_listeners_holds_no_manifest(spark):
    from corpusloom.operators import lifecycle as L

    ready = L.make_ready(G.entry_columns(spark.createDataFrame([("T1", "Walk.", 1, False)], "tier string, prompt string, number long, review_required boolean")))
    assert "shown" in M.planned(ready).columns and "shown" not in M.planned(ready, shown=False).columns


def test_a_record_of_many_batches_is_handed_on_in_pieces():
    import pyarrow as pa

    texts = ["x" * 400_000, None] + ["y" * 700_000] * 9
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array(["hi"] * n), pa.array(texts), pa.array(texts)], ["prompt_id", "code", "canonical", "natural"])
    out = list(M._batch_runner(M.EchoTranslator, M.EchoTranslator, 32, M.BUDGET)(iter([batch])))
    assert len(out) > 2 and [i for b in out for i in b.column("prompt_id").to_pylist()] == [str(i) for i in range(n)]
    assert [t for b in out for t in b.column("literal").to_pylist()] == ["[hin] " + (t or "") for t in texts]


@pytest.mark.parametrize("name", ["translate_stub", "translate_notes", "pending_jobs"])
def test_blank_and_missing_texts_are_echoed_as_in_sql(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as E

    texts = ["", "  \n ", None, " Walk \t on. ", "Stop.", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    for table in ("documents", "labels"):
        duck.sql(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = E.queries()[name](spark, str(tmp_path))
    want = duck.sql(f"select {', '.join(got.columns)} from ({E.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_lines_are_parsed_once_and_written_at_once(spark):
    kind = "struct<id:long,a:struct<x:int,b:struct<y:string>>,n:struct<z:int>>"
    lines = spark.createDataFrame([(x,) for x in ('{"id":1,"a":{"x":2,"b":{"y":"q\\"}","u":[1,{"w":null}]}},"m":{"id":7},"n":null}', '{"id":2,"n":{"z":3,"end":0}}', '{"id":3}')], "value string")
    got = U.parsed(lines, spark.createDataFrame([], kind[7:-1]).schema)
    want = ['{"id":1,"a":{"x":2,"b":{"y":"q\\"}","u":[1,{"w":null}]}},"n":null,"m":{"id":7}}', '{"id":2,"a":null,"n":{"z":3,"end":0}}', '{"id":3,"a":null,"n":null}']
    out = S.lines_of(got)
    assert [r.value for r in out.collect()] == want
    count = lambda df, word: df._jdf.queryExecution().analyzed().toString().count(word)
    # a struct more is a look-up more, not a parsing or a writing more
    assert (count(got, "parse_json"), count(out, "to_json(")) == (1, 2)
