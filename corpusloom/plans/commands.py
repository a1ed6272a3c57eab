"""The steps of a corpus build as commands: generate, prepare, translate, finalize, export.

    spark-submit -m corpusloom.plans.commands generate --output corpus/raw.jsonl
"""

from __future__ import annotations

import argparse
import importlib
from dataclasses import asdict, dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import vocab as V
from corpusloom.operators import generate as G
from corpusloom.operators import lifecycle as L
from corpusloom.operators import report as P
from corpusloom.session import session
from corpusloom.sources import files
from corpusloom.sources import records as S
from corpusloom.sources.snapshots import SnapshotTable, Version, upsert
from corpusloom.sources.workbooks import write_workbooks
from corpusloom.streaming import translate as M
from corpusloom.streaming.models import DEVICES, DTYPES, Seq2SeqTranslator, usable_verifier


@dataclass
class Paths:
    raw: str = "corpus_build/corpus_raw.jsonl"
    ready: str = "corpus_build/corpus_translation_ready.jsonl"
    manifest: str = "corpus_build/translation_manifest.jsonl"
    summary: str = "corpus_build/translation_summary.json"
    state: str = "corpus_build/translation_run_state.json"
    translations: str = "corpus_build/translations.parquet"
    final: str = "corpus_build/corpus_multilingual_final.jsonl"
    final_manifest: str = "corpus_build/translation_manifest_final.jsonl"
    final_summary: str = "corpus_build/translation_summary_final.json"
    workbook: str = "corpus_build/translations.xlsx"


def generate(spark: SparkSession, paths: Paths) -> None:
    S.write_jsonl(G.raw_corpus(spark), paths.raw, ("prompt_id",))
    pool = G.dedupe_casefold(G.all_candidates(spark), "prompt", by=("tier",))
    rows = G.selection_report(pool).orderBy("tier").collect()  # a row a tier
    for r in rows:
        print(f"{r.tier}: {r.raw:5d} generated, {r.pool:5d} in the review pool, {r.selected:5d} selected" + (f", short by {r.shortfall}" if r.shortfall else ""))
    print(f"{sum(r.pool for r in rows)} candidates retained, {sum(r.selected for r in rows)} prompts selected, saved to {paths.raw}")


def _schema(spark: SparkSession, ready: bool) -> T.StructType:
    raw = G.entry_columns(spark.createDataFrame([], "tier string, prompt string, number long, review_required boolean"))
    return (L.make_ready(raw) if ready else raw).schema


def read_records(spark: SparkSession, path: str, ready: bool = True, version: Version | None = None) -> DataFrame:
    """Corpus records with their full schema, whatever fields the file happens to hold; keys that it lacks are kept beside."""
    return S.read_records(spark, path, _schema(spark, ready), version)


MANIFEST_KEY = ("prompt_id", "lang_ord")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as its last commit left it: of each record and language the row that came last."""
    empty = P.manifest(spark.createDataFrame([], _schema(spark, True)))
    table = S.record_table(spark, path)
    rows = table.read(schema="value string", order="_place")
    parsed = rows.select(F.from_json("value", empty.schema, {"mode": "FAILFAST"}).alias("r"), "_place").select("r.*", "_place")
    return L.last_wins(parsed, ("prompt_id", "lang_ord"), "_place").drop("_place")


def _publish(records: DataFrame, manifest: str, summary: str, assumptions: dict, counts: P.Tally | None = None) -> P.Tally:
    """Manifest and summary of records; returns what they count."""
    S.record_table(records.sparkSession, manifest).replace(S.lines_of(P.manifest(records), MANIFEST_KEY))
    counts = P.tally(records) if counts is None else counts
    _summarise(records.sparkSession, summary, counts, assumptions)
    return counts


def _summarise(spark: SparkSession, path: str, counts: P.Tally, assumptions: dict) -> None:
    S.write_json(spark, path, P.summary(counts, {"english_source_frozen": True, V.VALIDATION_COMPLETE: True} | assumptions))


def _report(**places: str | int | None) -> None:
    width = max(map(len, places))
    for name, value in places.items():
        print(f"{name.replace('_', ' '):{width}}  {value}")


def prepare(spark: SparkSession, paths: Paths, *, label: str = "validated_assumed", limit: int | None = None) -> None:
    raw = L.first_rows(read_records(spark, paths.raw, ready=False), "prompt_id", limit)
    version = S.record_table(spark, paths.ready).replace(S.lines_of(L.make_ready(raw, label=label), ("prompt_id",)))
    counts = _publish(read_records(spark, paths.ready, version=version), paths.manifest, paths.summary, {"validation_status_label": label})
    jobs = sum(counts.values())
    _report(records=paths.ready, manifest=paths.manifest, summary=paths.summary, prompts=jobs // len(V.LANGUAGES), language_jobs=jobs)


def translate(
    spark: SparkSession, paths: Paths, load: M.Load, *, model: str, back: M.Load | None = None, verifier: str | None = None, fallback: bool = True,
    method: str = "local", batch_size: int = 32, batches_a_commit: int = 64, max_batches: int | None = None,
) -> bool:
    """False if nothing was pending; then nothing is written and no model loaded.

    ``verifier`` names the model of the way back, which ``back`` makes (``load`` without it); None skips verification.
    With ``fallback`` a run goes on unverified if that model is refused.

    After every commit of ``batches_a_commit`` batches manifest, summary and run state are those of all that is
    translated by then: counts go on from those before the run by what the commit has changed, and the manifest gets the
    rows that it has changed. Records are merged when a run ends, onto whatever another writer has made of them meanwhile;
    until then, and after a crash, the table of translations holds what was done.
    """
    newest = S.record_table(spark, paths.ready).latest()
    records = read_records(spark, paths.ready, version=newest)
    todo = L.pending(records)
    waiting = todo.count()
    if not waiting or max_batches == 0:
        return False
    if verifier is not None and not usable_verifier(spark, back or load, fallback=fallback):
        verifier = None
    state = {"method": method, "model": model, "verifier": verifier}
    names = {"translation_method": method, "translation_model": model, "verification_model": verifier}
    table, manifest = SnapshotTable(spark, paths.translations), S.record_table(spark, paths.manifest)

    def merged(now: DataFrame, done: DataFrame) -> DataFrame:
        return L.merge_translations(now, done, model=model, method=method)

    held = table.latest()
    so_far = records if held is None else merged(records, table.read(held).dropDuplicates(["prompt_id", "code"]))
    counts = _publish(so_far, paths.manifest, paths.summary, names)

    def progress(completed: int, total: int, counts: P.Tally, rows: DataFrame) -> None:
        S.write_json(spark, paths.state, P.run_state(counts, **state, completed=completed, total=total))
        manifest.append(S.lines_of(rows))
        _summarise(spark, paths.summary, counts, names)
        print(f"{completed} of {total} batches")

    chosen = L.batches(todo, "prompt_id", batch_size, max_batches).drop("batch")
    done = M.translate_resumably(chosen, paths.translations, load, back=back, verify=verifier is not None, batch_size=batch_size, batches_a_commit=batches_a_commit, counts=counts, after=progress)
    ready = S.record_table(spark, paths.ready)

    def change(lines: DataFrame | None) -> DataFrame:
        return S.lines_of(merged(S.parsed(lines, _schema(spark, True)), done), ("prompt_id",))

    upsert(ready, change, schema="value string")
    _publish(read_records(spark, paths.ready), paths.manifest, paths.summary, names)
    for kept in (ready, manifest):
        kept.vacuum()
    _report(records=paths.ready, manifest=paths.manifest, summary=paths.summary, run_state=paths.state, model=model, verifier=verifier or "skipped")
    return True


def finalize(spark: SparkSession, paths: Paths, *, require_approved: bool = False) -> None:
    """Writes the released records and looks, in the same pass, for what forbids a release; then nothing is published."""
    records = read_records(spark, paths.ready).orderBy("prompt_id")
    watched, watch = L.watched(records, require_approved=require_approved)
    beside = S.stage_jsonl(L.released(watched), paths.final)
    try:
        L.refuse(watch)
    except L.NotReleasable:
        files.delete(spark, beside)
        raise
    files.move(spark, beside, paths.final)
    gate = {"release_ready": not require_approved, "review_gate": "approved_required" if require_approved else "not_enforced"}
    _publish(read_records(spark, paths.final), paths.final_manifest, paths.final_summary, gate)
    _report(released=paths.final, manifest=paths.final_manifest, summary=paths.final_summary)


def export(spark: SparkSession, paths: Paths, *, limit: int | None = None, folder: bool = False) -> int:
    """The flat table as one workbook, or with ``folder`` as a folder of workbooks that executors write; returns its rows."""
    table = P.flat(L.first_rows(read_records(spark, paths.ready), "prompt_id", limit))
    if folder:
        write_workbooks(table, paths.workbook, ("prompt_id",))
        return table.count()
    return S.write_workbook(table, paths.workbook, ("prompt_id",))


def _named(place: str) -> M.Load:
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("step", choices=["generate", "prepare", "translate", "finalize", "export"])
    for name, value in asdict(Paths()).items():
        parser.add_argument(f"--{name.replace('_', '-')}", default=value)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--validation-status-label", default="validated_assumed")
    parser.add_argument("--translator", help="module:function that makes the model, e.g. corpusloom.streaming.translate:EchoTranslator; without it --model and --verifier are loaded")
    parser.add_argument("--back-translator", help="the same for the way back")
    parser.add_argument("--model", default="unnamed", help="name or folder of the model into the languages")
    parser.add_argument("--verifier", help="name or folder of the model back to the source language")
    parser.add_argument("--processor", help="module:name of what prepares sentences for the models")
    parser.add_argument("--device", choices=DEVICES, default="auto")
    parser.add_argument("--dtype", choices=DTYPES, default="auto")
    parser.add_argument("--max-length", type=int, default=256)
    parser.add_argument("--num-beams", type=int, default=5)
    parser.add_argument("--allow-verification-fallback", action=argparse.BooleanOptionalAction, default=True)
    parser.add_argument("--skip-verification", action="store_true")
    parser.add_argument("--batch-size", type=int, default=32)
    parser.add_argument("--max-batches", type=int)
    parser.add_argument("--require-approved-review", action="store_true")
    parser.add_argument("--workbook-folder", action="store_true", help="export a folder of workbooks, written by the executors")
    parser.add_argument("--dry-run", action="store_true", help="print the settings and stop")
    got = parser.parse_args(args)
    if got.dry_run:
        print(vars(got))
        return
    paths = Paths(**{n: getattr(got, n) for n in asdict(Paths())})
    spark = session(f"corpusloom {got.step}")
    if got.step == "generate":
        generate(spark, paths)
    elif got.step == "prepare":
        prepare(spark, paths, label=got.validation_status_label, limit=got.limit)
    elif got.step == "translate":
        if not got.translator and got.model == "unnamed":
            parser.error("translate needs --translator or --model")
        options = {n: getattr(got, n) for n in ("device", "dtype", "max_length", "num_beams", "processor")}
        load = _named(got.translator) if got.translator else partial(Seq2SeqTranslator, got.model, **options)
        verifier = None if got.skip_verification else got.verifier or got.model
        back = _named(got.back_translator) if got.back_translator else None
        if back is None and got.verifier and not got.translator:
            back = partial(Seq2SeqTranslator, got.verifier, **options)
        if not translate(spark, paths, load, model=got.model, back=back, verifier=verifier, fallback=got.allow_verification_fallback, batch_size=got.batch_size, max_batches=got.max_batches):
            print("No pending translations.")
    elif got.step == "finalize":
        finalize(spark, paths, require_approved=got.require_approved_review)
    else:
        print(export(spark, paths, limit=got.limit, folder=got.workbook_folder), "records exported")


if __name__ == "__main__":
    main()
