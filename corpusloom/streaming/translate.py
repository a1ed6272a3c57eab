"""Translation of pending records by a model, in resumable runs or as a stream of new files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import verify as VF
from corpusloom.functions import vocab as V
from corpusloom.operators.lifecycle import batches, block_complete, long_form
from corpusloom.operators.report import Tally, manifest, plus, tallied
from corpusloom.session import ship
from corpusloom.sources import files
from corpusloom.sources.snapshots import SnapshotTable


class Translator(Protocol):
    def translate(self, sentences: list[str], source: str, target: str) -> list[str]:
        """As many texts as sentences."""


class EchoTranslator:
    """Marks a text with the target language, and takes the mark off on the way back. For rehearsals and tests."""

    def translate(self, sentences: list[str], source: str, target: str) -> list[str]:
        if target == V.SOURCE_CODE:
            return [s.split("] ", 1)[-1] for s in sentences]
        return [f"[{target[:3]}] {s}" for s in sentences]


#: Makes a translator; called once in each Python worker, so a model is loaded there and stays.
Load = Callable[[], Translator]

JOB = "prompt_id string, code string, canonical string, natural string"
DONE = JOB + ", literal string, robot_natural string, literal_back string, natural_back string"


#: Characters of a batch as the model sees it, with each sentence padded to the longest.
BUDGET = 1 << 16
#: Characters of sources after which a task hands its translations on.
HELD = 1 << 21


def cuts(lengths: list[int], most: int, budget: int) -> list[tuple[int, int]]:
    """Batches of rising lengths: ``most`` rows at most, ``budget`` characters with padding at most or one row."""
    out, start = [], 0
    for i, n in enumerate(lengths):
        if i > start and (i - start == most or (i - start + 1) * n > budget):
            out.append((start, i))
            start = i
    return [*out, (start, len(lengths))] if lengths else out


def _batch_runner(load: Load, back_load: Load | None, batch_size: int, budget: int):
    """Translates rows that come by language and length."""

    names = [c.split()[0] for c in DONE.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Translator | None = None
        backward: Translator | None = None
        for batch in rows:
            if not batch.num_rows:
                continue
            model = model or load()
            if back_load is not None:
                backward = backward or (model if back_load is load else back_load())
            given = {n: [t or "" for t in batch.column(n).to_pylist()] for n in ("canonical", "natural")}
            made: dict[str, list[str | None]] = {n: [] for n in names[4:]}
            start = end = held = 0

            def out(start: int, end: int, batch: pa.RecordBatch = batch, made: dict = made) -> pa.RecordBatch:
                columns = [*(batch.column(n).slice(start, end - start) for n in names[:4]), *(pa.array(made[n], pa.string()) for n in names[4:])]
                return pa.RecordBatch.from_arrays(columns, names)

            for code, run_ in groupby(batch.column("code").to_pylist()):
                target, first, n = V.LANGUAGES[code][1], end, sum(1 for _ in run_)
                # like lengths together pad less
                lengths = list(accumulate((len(t) for t in given["canonical"][first : first + n]), max))
                for a, b in cuts(lengths, batch_size, budget):
                    for source, column, back in (("canonical", "literal", "literal_back"), ("natural", "robot_natural", "natural_back")):
                        texts = list(model.translate(given[source][first + a : first + b], V.SOURCE_CODE, target))
                        made[column] += texts
                        made[back] += backward.translate(texts, target, V.SOURCE_CODE) if backward else [None] * len(texts)
                    end, held = first + b, held + (b - a) * lengths[b - 1]
                    if held > HELD:
                        yield out(start, end)
                        start, held = end, 0
                        for texts in made.values():
                            texts.clear()
            if end > start:
                yield out(start, end)

    return run


#: What a task hands on: translations without special tokens, and the checks of both forms.
MADE = "prompt_id string, code string, literal string, robot_natural string, literal_back string, natural_back string, verification struct<" + ", ".join(f"{c}: boolean" for c in V.CHECKS) + ">"


def _cleaned(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], verify: bool, source_order: bool):
    """Adds to a runner the cleaning of what the model has made and the checks: the texts are at hand, and searching them in
    Catalyst costs more than the rest of a task."""

    def cleaned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(rows):
            given = batch.to_pydict()
            codes = given["code"]
            clean = lambda n, targets: [t if t is None else X.sanitized_text(t, x) for t, x in zip(given[n], targets, strict=True)]
            targets, sources = [V.LANGUAGES[c][1] for c in codes], [V.SOURCE_CODE] * len(codes)
            made = {n: clean(n, x) for n, x in (("literal", targets), ("robot_natural", targets), ("literal_back", sources), ("natural_back", sources))}
            checks: list[tuple | None] = [None] * len(codes)
            if verify:
                both = [[X.match_text(t or "") for t in texts] for texts in (given["canonical"], given["natural"], made["literal_back"], made["natural_back"])]
                checks = [tuple(x and y for x, y in zip(VF.checked(a, c, source_order=source_order), VF.checked(b, d, source_order=source_order), strict=True)) for a, b, c, d in zip(*both, strict=True)]
            # the model is given the empty text where there is none, which doesn't make a translation of it
            made["literal"] = [None if s is None else t for s, t in zip(given["canonical"], made["literal"], strict=True)]
            kind = pa.struct([(c, pa.bool_()) for c in V.CHECKS])
            said = pa.array([None if x is None else dict(zip(V.CHECKS, x, strict=True)) for x in checks], kind)
            yield pa.RecordBatch.from_arrays([batch.column("prompt_id"), batch.column("code"), *(pa.array(x, pa.string()) for x in made.values()), said], ["prompt_id", "code", *made, "verification"])

    return cleaned


def jobs(records: DataFrame, *, whole_records: bool = False) -> DataFrame:
    """prompt_id, code, canonical, natural of what is to be translated: incomplete languages, or with
    ``whole_records`` all languages of records with any."""
    b = F.col("block")
    long = long_form(records, "prompt_id", F.col("instruction_en.canonical").alias("canonical"), F.col("instruction_en.robot_natural").alias("natural"), fields=("status", "literal", "robot_natural"))
    open_ = long.where(~block_complete(b["status"], b["literal"], b["robot_natural"])).select("prompt_id", "code", "canonical", "natural")
    if whole_records:
        ids = open_.select("prompt_id").distinct()
        return long.select("prompt_id", "code", "canonical", "natural").join(ids, "prompt_id", "left_semi")
    return open_


def translate(todo: DataFrame, load: Load, *, back: Load | None = None, verify: bool = True, batch_size: int = 32, budget: int = BUDGET, engine: str = "the translation model", source_order: bool = False) -> DataFrame:
    """Translations of jobs with their verification and notes: one Python stage, which has the texts at hand.

    Jobs are dealt evenly by their key, then each task takes its own by language and length, so a batch is of one
    language and of like lengths; keys, not places, tell whose a translation is.

    A job whose canonical text is null has no literal translation; a blank one has what the model makes of it.

    ``back`` makes the model of the way back to the source language; without it the same model goes both ways.

    A model that isn't deterministic must have its result written before it is used twice.
    """
    if batch_size < 1:
        raise ValueError("a batch has at least one row")
    ship(todo.sparkSession)
    # the model costs most by far: its work is dealt evenly, however the records came to lie
    parts = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a record's languages go together: its texts are said once more side by side, which the shuffle packs
    dealt = todo.select("prompt_id", "code", "canonical", "natural").repartition(parts, "prompt_id")
    dealt = dealt.sortWithinPartitions("code", F.length("canonical"), "prompt_id")
    made = dealt.mapInArrow(_cleaned(_batch_runner(load, (back or load) if verify else None, batch_size, budget), verify, source_order), MADE)
    done = made if verify else made.withColumn("verification", VF.skipped_verification())
    notes = VF.notes(F.col("verification"), F.coalesce("literal_back", F.lit("")), F.coalesce("natural_back", F.lit("")), F.lit(verify), engine)
    return done.withColumn("translation_notes", notes).select("prompt_id", "code", "literal", "robot_natural", "verification", "translation_notes")


def planned(records: DataFrame, *, shown: bool = True) -> DataFrame:
    """The open ``jobs`` with what a commit needs to say what it has changed: tier and ``was``, what counts take from
    it, and the manifest's ``shown`` row, unless nobody asks for it."""
    rows = manifest(records, counted=True)
    row = F.struct(*(F.col(c) for c in rows.columns if c != "was"))
    english = F.col("instruction_en")
    return rows.where(~F.col("was.complete")).select("prompt_id", F.col("language").alias("code"), english["canonical"].alias("canonical"), english["robot_natural"].alias("natural"), "tier", "was", *((row.alias("shown"),) if shown else ()))


def changed(plan: DataFrame, made: DataFrame) -> DataFrame:
    """Of translations and their jobs: rows of the manifest as they are now."""
    both = plan.join(made, ["prompt_id", "code"])
    row = F.col("shown")
    now = row.withField("translation_target", F.struct("literal", "robot_natural")).withField("verification", F.col("verification"))
    now = now.withField("review_assignment.status", F.lit("pending_bilingual_review")).withField("notes", F.col("translation_notes"))
    return both.select(now.alias("shown")).select("shown.*")


def moved(plan: DataFrame, made: DataFrame) -> DataFrame:
    """(tier, code, was, n): by how much counts change. What is counted is drawn from the texts before they would be shuffled."""
    checks = (F.coalesce(F.col("verification")[c], F.lit(False)).alias(c) for c in V.CHECKS)
    done = F.lit("model_translated")
    is_ = F.struct(done.alias("status"), F.lit("pending_bilingual_review").alias("review"), *checks, block_complete(done, F.col("literal"), F.col("robot_natural")).alias("complete"))
    both = plan.select("prompt_id", "code", "tier", "was").join(made.select("prompt_id", "code", is_.alias("is_")), ["prompt_id", "code"])
    both = both.groupBy("tier", "code", "was", "is_").agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(F.struct("was", (-F.col("n")).alias("n")), F.struct(F.col("is_").alias("was"), F.col("n").alias("n")))
    return both.select("tier", "code", F.explode(steps).alias("s")).groupBy("tier", "code", F.col("s.was").alias("was")).agg(F.sum("s.n").alias("n"))


class Commit(Protocol):
    def __call__(self, completed: int, total: int, counts: Tally, rows: DataFrame) -> None:
        """Told when a commit is in the table: batches done and of all, the counts now, the manifest's rows that it has changed."""


def translate_resumably(
    records: DataFrame, path: str, load: Load, *, batch_size: int = 32, batches_a_commit: int = 64, max_batches: int | None = None, counts: Tally | None = None, after: Commit | None = None, **options
) -> DataFrame:
    """Translates what ``records`` and the table at ``path`` lack, appending a commit for every
    ``batches_a_commit`` batches; returns all translations in the table.

    Jobs are planned once, in a table dealt by commit, so a commit reads its own. It is one version of a
    ``SnapshotTable``: a run that is stopped loses what its last commit had begun, a commit that is repeated is there
    once, and its part in ``counts`` (those before the run) is carried in the version's notes. No batch is taken twice, as
    what the table holds is left out; a key that it holds more than once counts once.
    """
    spark = records.sparkSession
    table = SnapshotTable(spark, path)
    todo = planned(records, shown=after is not None)
    held = table.latest()
    if held is not None:
        todo = todo.join(table.read(held).select("prompt_id", "code"), ["prompt_id", "code"], "left_anti")
    todo = batches(todo.withColumn("key", F.concat_ws("|", "prompt_id", "code")), "key", batch_size, max_batches)
    todo = todo.withColumn("commit", F.floor(F.col("batch") / batches_a_commit))
    name = uuid.uuid4().hex
    plan_path = f"{path.rstrip('/')}.plan-{name}"
    todo.write.partitionBy("commit").parquet(plan_path)
    plan = spark.read.schema(todo.schema).parquet(plan_path)
    last, total = plan.agg(F.max("commit"), F.max("batch") + 1).first()
    counts = dict(counts or {})
    for commit in range(0 if last is None else last + 1):
        part = plan.where(F.col("commit") == commit).drop("commit")
        written: list[DataFrame] = []

        def fold(notes: dict, made: DataFrame, part: DataFrame = part, written: list[DataFrame] = written) -> dict:
            written[:] = [made]
            return {"run": name, "counts": [[*key[:4], list(key[4]), key[5], n] for key, n in plus(counts, tallied(moved(part, made))).items()]}

        version = table.append(translate(part, load, batch_size=batch_size, **options), run=(name, commit), fold=fold)
        counts = {(*c[:4], tuple(c[4]), c[5]): c[6] for c in version.notes["counts"]}
        if after:
            after(min((commit + 1) * batches_a_commit, total), total, counts, changed(part, written[0]))
    files.delete(spark, plan_path)
    if table.latest() is None:
        return translate(todo.limit(0), load, batch_size=batch_size, **options)
    return table.read().dropDuplicates(["prompt_id", "code"])


def translate_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, load: Load, *, files_a_batch: int = 1, **options) -> None:
    """Translates the ready records of every new file under ``source`` (JSON lines), then stops.

    Each micro-batch writes the part of ``target`` that its number names, so one that is repeated after a
    failure replaces what it wrote before.
    """

    def write(frame: DataFrame, number: int) -> None:
        translate(jobs(frame), load, **options).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
