"""Invariants of the generated corpus and of its way to a release."""

import contextlib
import json
import os
import sys
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vocab as V
from corpusloom.operators import generate as G
from corpusloom.operators import lifecycle as L
from corpusloom.operators import report as P
from corpusloom.plans import commands as C
from corpusloom.sources import records as S
from corpusloom.streaming import models as K
from corpusloom.streaming import translate as M

#: Distinct candidates of each tier.
CANDIDATES = {"T1": 2660, "T2": 2528, "T5": 1760, "T6": 968, "T7": 4088}


@pytest.fixture(scope="module")
def raw(spark):
    return G.raw_corpus(spark).cache()


def test_candidate_counts(spark):
    counts = {r.tier: r.n for r in G.all_candidates(spark).groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(counts[t] == n for t, n in CANDIDATES.items()), counts
    assert all(counts[t] >= s[1] for t, s in V.TIERS.items())


def test_selection(raw):
    assert raw.count() == raw.select("prompt_id").distinct().count() == 10_000
    assert raw.where(f"{V.VALIDATOR}.review_required").count() == 2138
    assert {r[0]: r[1] for r in raw.groupBy("metadata.split").count().collect()} == {"dev": 1000, "test": 1000, "train": 8000}
    assert {r[0]: r[1] for r in raw.groupBy("tier").count().collect()} == {t: s[0] for t, s in V.TIERS.items()}


def test_dedupe_is_idempotent_and_keeps_the_first(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c"), (4, None), (5, None)], "n int, t string")
    once = G.dedupe_casefold(df, "t", order=("n",))
    assert sorted((r.n, r.t) for r in once.collect()) == [(1, "A b"), (3, "c"), (4, None)]
    assert once.count() == G.dedupe_casefold(once, "t", order=("n",)).count()


def test_build_to_release(spark, raw, tmp_path):
    paths = C.Paths(**{k: f"file://{tmp_path}/{v}" for k, v in C.asdict(C.Paths()).items()})
    S.write_jsonl(raw.where("tier in ('T3', 'T6')").where("prompt_id like '%7'"), paths.raw, ("prompt_id",))
    C.prepare(spark, paths, limit=40)
    ready = C.read_records(spark, paths.ready)
    assert ready.count() == 40 and P.manifest(ready).count() == 120
    with pytest.raises(L.NotReleasable, match="is missing hi"):
        C.finalize(spark, paths)
    assert not (tmp_path / "corpus_build/corpus_multilingual_final.jsonl").exists()
    with pytest.raises(ValueError):
        L.make_ready(ready, overwrite=False)
    # in two runs, the second takes up what the first left
    assert C.translate(spark, paths, M.EchoTranslator, model="echo", verifier="echo", batch_size=8, max_batches=2)
    assert L.pending(C.read_records(spark, paths.ready)).count() == 24
    assert C.translate(spark, paths, M.EchoTranslator, model="echo", verifier="echo", batch_size=8)
    assert not C.translate(spark, paths, M.EchoTranslator, model="echo", verifier="echo")
    done = C.read_records(spark, paths.ready)
    assert done.where("pipeline.stage = 'translation_generated_pending_review'").count() == 40
    row = done.where("tier = 'T3'").first()
    assert row.translation_hi.literal == "[hin] " + row.instruction_en.canonical and row.translation_hi.translation_notes[0].startswith("Translated locally")
    summary = json.loads((tmp_path / "corpus_build/translation_summary.json").read_text())
    assert summary["total_translation_jobs"] == 120 and summary["translation_status_counts"]["te"] == {"model_translated": 40}
    assert json.loads((tmp_path / "corpus_build/translation_run_state.json").read_text())["pending_language_jobs"] == 0
    with pytest.raises(L.NotReleasable, match="unapproved"):
        C.finalize(spark, paths, require_approved=True)
    C.finalize(spark, paths)
    final = C.read_records(spark, paths.final)
    assert final.where("metadata.translation_status = 'complete' and pipeline.review_gate = 'pending_or_partial'").count() == 40
    assert C.export(spark, paths) == 40
    with zipfile.ZipFile(tmp_path / "corpus_build/translations.xlsx") as z:
        assert b"translation_hi" not in z.read("xl/worksheets/sheet1.xml") and b'ySplit="1"' in z.read("xl/worksheets/sheet1.xml")
    assert len(P.flat(final).columns) == 70


def test_stream_gives_what_a_batch_gives(spark, raw, tmp_path):
    ready = L.make_ready(raw.where("tier = 'T1' and prompt_id like '%03'"))
    S.write_jsonl(ready, f"file://{tmp_path}/in")
    M.translate_stream(spark, f"file://{tmp_path}/in", ready.schema, f"file://{tmp_path}/out", f"file://{tmp_path}/check", M.EchoTranslator)
    key = ["prompt_id", "code", "literal", "robot_natural"]
    streamed = spark.read.parquet(f"file://{tmp_path}/out").select(key).collect()
    assert sorted(streamed) == sorted(M.translate(M.jobs(ready), M.EchoTranslator).select(key).collect())


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": null, "n": "नमस्ते"}\n\n{"n": "b", "extra": 1}\n')
    assert S.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "n string").count() == 2
    v = S.read_variants(spark, f"file://{tmp_path}/a.jsonl")
    assert sorted(map(str, [r[0] for r in v.select(S.variant_text("v", "$.x", F.lit("missing"))).collect()])) == ["None", "missing"]
    (tmp_path / "b.jsonl").write_text('{"n": "a"}\n{broken\n')
    with pytest.raises(Exception):  # noqa: B017
        S.read_jsonl(spark, f"file://{tmp_path}/b.jsonl", "n string").collect()
    df = S.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "x string, n string")
    S.write_jsonl(df, f"file://{tmp_path}/a.jsonl", ("n",), single=True)  # over its own input
    assert (tmp_path / "a.jsonl").read_text() == '{"x":null,"n":"b"}\n{"x":null,"n":"नमस्ते"}\n'


def test_rows_in_order(spark):
    df = spark.range(10).select(F.format_string("%02d", "id").alias("k"))
    assert [r.k for r in L.first_rows(df, "k", -7).orderBy("k").collect()] == ["00", "01", "02"]
    assert L.first_rows(df, "k", 0).count() == 0 and L.first_rows(df, "k", None).count() == 10
    assert {r.k: r.batch for r in L.batches(df, "k", 4).collect()} == {f"{i:02d}": i // 4 for i in range(10)}
    with pytest.raises(ValueError):
        L.batches(df, "k", 0)


class Backward(M.EchoTranslator):
    """A model of the way back only."""

    def translate(self, sentences, source, target):
        assert target == V.SOURCE_CODE
        return [s.split("] ", 1)[-1] + " carefully" for s in sentences]


def refused():
    raise OSError("403 Client Error: access to model is restricted")


def broken():
    raise ValueError("no such weights")


def test_two_models_and_a_verifier_that_is_refused(spark, raw, tmp_path):
    paths = C.Paths(**{k: f"file://{tmp_path}/{v}" for k, v in C.asdict(C.Paths()).items()})
    S.write_jsonl(raw.where("tier = 'T1' and prompt_id like '%07'"), paths.raw, ("prompt_id",))
    C.prepare(spark, paths, limit=6)
    with pytest.raises(RuntimeError, match="no such weights"):
        C.translate(spark, paths, M.EchoTranslator, model="there", back=broken, verifier="back")
    with pytest.raises(RuntimeError, match="403"):
        C.translate(spark, paths, M.EchoTranslator, model="there", back=refused, verifier="back", fallback=False)
    assert C.translate(spark, paths, M.EchoTranslator, model="there", back=refused, verifier="back", batch_size=2, max_batches=1)
    state = json.loads((tmp_path / "corpus_build/translation_run_state.json").read_text())
    assert state["verification_model"] is None and state["translated_language_jobs"] == 6 and state["pending_language_jobs"] == 12
    seen = []
    after = C.P.run_state
    C.P.run_state = lambda *a, **k: seen.append((k["completed"], k["total"])) or after(*a, **k)
    try:
        assert C.translate(spark, paths, M.EchoTranslator, model="there", back=Backward, verifier="back", batch_size=2, batches_a_commit=2)
    finally:
        C.P.run_state = after
    assert seen == [(2, 6), (4, 6), (6, 6)]
    done = C.read_records(spark, paths.ready).orderBy("prompt_id").collect()
    assert sum(r.translation_te.translation_notes[-1].endswith("was skipped for this run.") for r in done) == 2
    assert sum(any(n.endswith(" carefully") for n in r.translation_te.translation_notes) for r in done) == 4


def test_model_loading(tmp_path, monkeypatch):
    assert K.is_access_error(OSError("You are trying to access a GATED REPO.")) and not K.is_access_error("time out")
    assert K.is_network_error("Temporary failure in name resolution") and not K.is_network_error("gated repo")
    for i, name in enumerate(("old", "new")):
        (tmp_path / "models--a--b" / "snapshots" / name).mkdir(parents=True)
        os.utime(tmp_path / "models--a--b" / "snapshots" / name, (i, i))
    assert K.local_source("a/b", tmp_path).endswith("/new") and K.local_source("a/c", tmp_path) == "a/c" and K.local_source(str(tmp_path)) == str(tmp_path)
    asked = []

    class Batch(dict):
        def to(self, device):
            return self

    class Tokenizer:
        def __call__(self, batch, **options):
            return Batch(ids=batch)

        def batch_decode(self, made, **options):
            return made

    class Model:
        def to(self, device):
            self.device = device
            return self

        def generate(self, ids, **options):
            return [f"{options['num_beams']} {x}" for x in ids]

    def model(source, **options):
        asked.append(options)
        if len(asked) == 1:
            raise ImportError("flash_attention_2 isn't installed")
        return Model()

    def tokenizer(source, local_files_only=False, **options):
        if not local_files_only:
            raise OSError("Connection error")
        return Tokenizer()

    torch = SimpleNamespace(cuda=SimpleNamespace(is_available=lambda: True), float16="f16", float32="f32", bfloat16="bf16", no_grad=contextlib.nullcontext)
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "transformers", SimpleNamespace(AutoTokenizer=SimpleNamespace(from_pretrained=tokenizer), AutoModelForSeq2SeqLM=SimpleNamespace(from_pretrained=model)))
    made = K.Seq2SeqTranslator("a/b", num_beams=3)
    assert "attn_implementation" in asked[0] and "attn_implementation" not in asked[1] and asked[1]["torch_dtype"] == "f16" and made.model.device == "cuda"
    assert made.translate(["x", "y"], "s", "t") == ["3 x", "3 y"] and made.translate([], "s", "t") == []
    torch.cuda.is_available = lambda: False
    assert K.device_of(torch, "auto") == "cpu" and K.dtype_of(torch, "auto", "cpu") == "f32" and K.dtype_of(torch, "bfloat16", "cpu") == "bf16"
    with pytest.raises(OSError):
        K.device_of(torch, "cuda")
    with pytest.raises(ImportError, match="no_such_library"):
        K.library("no_such_library")


def test_a_move_that_was_cut_off(spark, tmp_path):
    df = spark.createDataFrame([("1",)], "n string")
    S.write_jsonl(df, f"file://{tmp_path}/t.jsonl")
    (tmp_path / "t.jsonl").rename(tmp_path / "t.jsonl.old-7")
    assert S.read_jsonl(spark, f"file://{tmp_path}/t.jsonl", "n string").count() == 1
    S.write_json(spark, f"file://{tmp_path}/one.json", {"a": 1})
    S.write_json(spark, f"file://{tmp_path}/one.json", {"a": 2})
    assert json.loads((tmp_path / "one.json").read_text()) == {"a": 2}
    assert not [p for p in tmp_path.iterdir() if "one.json" in p.name and p.name not in ("one.json", ".one.json.crc")]
