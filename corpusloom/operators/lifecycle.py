"""The life of a corpus record: ready for translation, translated, final; and the steps between."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as X
from corpusloom.functions import vocab as V
from corpusloom.session import scratch
from corpusloom.sources.unknown import without


def block_name(code: str) -> str:
    return f"translation_{code}"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _has(df: DataFrame, path: str) -> bool:
    """Whether the record has the field, a top-level column or one of a struct."""
    kind = df.schema
    for name in path.split("."):
        if not hasattr(kind, "names") or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def field(df: DataFrame, path: str, default: Column) -> Column:
    """A field, or ``default`` where the schema doesn't have it; null stays null."""
    return F.col(path) if _has(df, path) else default


def pending_block(code: str, prompt_id: Column, canonical: Column, natural: Column, metadata: dict[str, Column]) -> Column:
    """The block of a language before translation. Its fields have their types one by one: a cast of the whole
    would keep the optimizer from leaving out those that nobody reads."""
    return F.struct(
        F.lit(V.LANGUAGES[code][0]).alias("language"),
        _null().alias("literal"),
        _null().alias("robot_natural"),
        F.lit("pending").alias("status"),
        R.strings([]).alias("translation_notes"),
        F.struct(*(_null("boolean").alias(c) for c in V.CHECKS)).alias("verification"),
        F.struct(R.strings(["literal", "robot_natural"]).alias("translation_style_options"), *(c.cast("string" if n == "ambiguity_type" else "boolean").alias(n) for n, c in metadata.items())).alias("metadata"),
        F.struct(_null().alias("bilingual_reviewer"), _null().alias("adjudicator"), F.lit("pending").alias("review_status"), _null().alias("review_notes")).alias("review"),
        F.struct(
            F.lit("en").alias("source_language"),
            prompt_id.cast("string").alias("source_prompt_id"),
            canonical.alias("source_canonical"),
            natural.alias("source_robot_natural"),
            _null().alias("translation_model"),
            _null().alias("translation_method"),
        ).alias("provenance"),
    )


def make_ready(raw: DataFrame, *, label: str = "validated_assumed", overwrite: bool = True) -> DataFrame:
    """Freezes raw records for translation: validation stamped, subtier, tags and landmarks filled where
    missing or empty, protocol and pipeline state set, a pending block for each language.

    Preparing again drops the translations that records have; with ``overwrite=False`` that is refused.
    Two projections, the first of which folds the text once for all that looks into it.
    """
    if not overwrite and any(_has(raw, block_name(c)) for c in V.LANGUAGES):
        raise ValueError("the records have translation blocks already")
    canonical = F.coalesce(field(raw, "instruction_en.canonical", F.lit("")), F.lit(""))
    natural = field(raw, "instruction_en.robot_natural", canonical)
    flag = lambda n: field(raw, f"metadata.{n}", F.lit(False))
    metadata = {
        "ambiguity_flag": flag("ambiguity_flag"),
        "ambiguity_type": field(raw, "metadata.ambiguity_type", _null()),
        **{n: flag(n) for n in ("requires_scene_context", "requires_body_reference", "safe_for_direct_execution")},
    }
    own_landmarks = field(raw, f"{V.VALIDATOR}.constraint_payload.landmarks", _null("array<string>"))
    full = lambda c: F.when(F.size(F.coalesce(c, R.strings([]))) > 0, c)
    state = {"stage": "translation_ready", "next_required_step": "multilingual_translation", "translation_status": "ready_for_translation"}
    done = (F.lit(True).alias("english_source_frozen"), F.lit(True).alias(V.VALIDATION_COMPLETE))
    protocol = F.struct(
        F.lit(True).alias("source_bank_frozen"),
        F.lit(True).alias(V.VALIDATION_COMPLETE),
        R.strings(V.LANGUAGES).alias("languages"),
        R.strings(["literal", "robot_natural"]).alias("required_forms_per_language"),
        R.strings(V.CHECKS).alias("required_verification_checks"),
    )
    stub = F.struct(_null().alias("literal"), _null().alias("robot_natural"))
    forms = F.struct(F.struct(canonical.alias("canonical"), natural.alias("robot_natural")).alias("en"), *(field(raw, f"instruction_multilingual.{c}", stub).alias(c) for c in V.LANGUAGES))
    stamped = F.col("metadata") if _has(raw, "metadata") else F.struct(F.lit("").alias("translation_status"))
    validator = F.col(V.VALIDATOR) if _has(raw, V.VALIDATOR) else F.struct(F.lit(True).alias("validated"))
    raw = without(raw, "translation_protocol", "instruction_multilingual.en", *(block_name(c) for c in V.LANGUAGES))
    return raw.withColumn("_folded", X.casefold(canonical)).withColumns(
        {
            V.VALIDATOR: validator.withField("validated", F.lit(True)).withField("validation_status", F.lit(label)),
            "metadata": stamped.withField("translation_status", F.lit("ready_for_translation")).withField("validation_status", F.lit(label)),
            "subtier": F.coalesce(F.nullif(field(raw, "subtier", _null()), F.lit("")), R.subtier(F.col("tier"))),
            "primitive_tags": F.coalesce(full(field(raw, "primitive_tags", _null("array<string>"))), R.primitive_tags(F.col("_folded"))),
            "landmarks": F.coalesce(full(field(raw, "landmarks", _null("array<string>"))), R.landmarks(own_landmarks, F.col("_folded"))),
            "translation_protocol": protocol,
            "pipeline": F.struct(*(F.lit(v).alias(k) for k, v in state.items()), *done, _null().alias("review_gate")),
            "instruction_multilingual": forms,
            **{block_name(c): pending_block(c, F.col("prompt_id"), canonical, natural, metadata) for c in V.LANGUAGES},
        }
    ).drop("_folded")


def blocks(fields: tuple[str, ...]) -> Column:
    """The record's blocks as an array of (lang_ord, language_code, block), in the order of the languages."""
    some = lambda b: F.struct(*(b[f].alias(f) for f in fields))
    return F.array(*(F.struct(F.lit(i).alias("lang_ord"), F.lit(c).alias("code"), some(F.col(block_name(c))).alias("block")) for i, c in enumerate(V.LANGUAGES)))


def long_form(records: DataFrame, *keep: str | Column, fields: tuple[str, ...]) -> DataFrame:
    """One row for each record and language: ``keep``, lang_ord, code, block with those of its fields that are named."""
    return records.select(*keep, F.inline(blocks(fields)))


def text_given(c: Column) -> Column:
    """Not null and not blank."""
    return F.regexp_like(F.coalesce(c, F.lit("")), F.lit(X.TEXT))


def block_complete(status: Column, literal: Column, natural: Column) -> Column:
    return F.coalesce(status == "model_translated", F.lit(False)) & text_given(literal) & text_given(natural)


def is_complete(code: str) -> Column:
    b = F.col(block_name(code))
    return block_complete(b["status"], b["literal"], b["robot_natural"])


def pending(records: DataFrame) -> DataFrame:
    """Records with any language that isn't complete."""
    return records.where(reduce(lambda a, b: a | b, [~is_complete(c) for c in V.LANGUAGES]))


def batches(records: DataFrame, order: str, size: int, most: int | None = None) -> DataFrame:
    """Adds batch, from 0: consecutive rows in ``order``, ``size`` each; the first ``most`` batches.

    Numbers are dealt in ranges of ``order``, so no task sees all rows.
    """
    if size < 1:
        raise ValueError("a batch has at least one row")
    numbered = numbered_by(records, order).withColumn("batch", F.floor(F.col("row") / size)).drop("row")
    return numbered if most is None else numbered.where(F.col("batch") < most)


def numbered_by(df: DataFrame, order: str, ranges: int = 64) -> DataFrame:
    """Adds row, from 0 in ``order`` (ties in no fixed order): ranges are counted first, then numbered side by side.

    The ranges come from a bounded sample; their numbers are exact all the same. ``order`` is written once, so sampling and
    counting don't work the rows out anew.
    """
    spark = df.sparkSession
    path = f"{scratch(spark, 'order')}/keys"
    df.select(order).write.parquet(path)
    keys = spark.read.schema(df.select(order).schema).parquet(path)
    if df.columns == [order]:
        df = keys
    bounds = [r[0] for r in keys.where(F.col(order).isNotNull()).select(order).orderBy(F.rand(7)).limit(50 * ranges).orderBy(order).collect()][::50]
    part = reduce(lambda a, b: a + F.when(F.col(order) >= F.lit(b), 1).otherwise(0), bounds, F.lit(0)) if bounds else F.lit(0)
    dealt, counted = (x.withColumn("_part", F.coalesce(part, F.lit(-1))) for x in (df, keys))
    sizes = counted.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.withColumn("_row", within).join(before, "_part").withColumn("row", F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")


def first_rows(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows in ``order``; a negative n leaves out as many at the end, none at all keeps every row."""
    if n is None:
        return df
    if n >= 0:
        return df.orderBy(order).limit(n)
    return numbered_by(df, order).where(F.col("row") < df.count() + n).drop("row")


def last_wins(updates: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """One update a key: the last in ``order``, null being before all. A hot key's updates are reduced before the shuffle."""
    last = F.max_by(F.struct("*"), F.struct(order)).alias("_last")  # a struct, as a null alone is never the largest
    return updates.groupBy(*key).agg(last).select("_last.*")


def merge_translations(records: DataFrame, translations: DataFrame, *, model: str, method: str) -> DataFrame:
    """Writes translations into the blocks of their records and rolls the record's state up.

    ``translations``: prompt_id, code, literal, robot_natural, verification, translation_notes; one row a
    key. Records without one stay as they are. One shuffle of the translations by prompt_id, one join. Each field is
    a column of its own until the end: those that nobody reads are neither shuffled nor joined.
    """
    fields = ("literal", "robot_natural", "verification", "translation_notes")
    own = lambda c: (F.max(F.when(F.col("code") == c, F.lit(True))).alias(f"_{c}"), *(F.max(F.when(F.col("code") == c, F.col(n))).alias(f"_{c}_{n}") for n in fields))
    wide = translations.groupBy("prompt_id").agg(*(x for c in V.LANGUAGES for x in own(c)))
    joined = records.join(wide, "prompt_id", "left")
    columns = {}
    forms = F.col("instruction_multilingual")
    for c in V.LANGUAGES:
        b, new = F.col(block_name(c)), F.col(f"_{c}").isNotNull()
        values = {n: F.col(f"_{c}_{n}") for n in fields}
        values |= {"status": F.lit("model_translated"), "review.review_status": F.lit("pending_bilingual_review"), "provenance.translation_model": F.lit(model), "provenance.translation_method": F.lit(method)}
        updated = b
        for path, value in values.items():
            updated = updated.withField(path, F.when(new, value).otherwise(reduce(lambda x, n: x[n], path.split("."), b)))
        columns[block_name(c)] = updated
        form = forms[c]
        for n in ("literal", "robot_natural"):
            form = form.withField(n, F.when(new, values[n]).otherwise(forms[c][n]))
        columns["instruction_multilingual"] = columns.get("instruction_multilingual", forms).withField(c, form)
    merged = joined.withColumns(columns)
    touched = reduce(lambda a, b: a | b, [F.col(f"_{c}").isNotNull() for c in V.LANGUAGES])
    return rolled_up(merged, touched).drop(*(f"_{c}{n}" for c in V.LANGUAGES for n in ("", *(f"_{n}" for n in fields))))


def rolled_up(records: DataFrame, touched: Column) -> DataFrame:
    """Sets the state of touched records by whether all their languages are translated."""
    every = reduce(lambda a, b: a & b, [F.coalesce(F.col(block_name(c))["status"] == "model_translated", F.lit(False)) for c in V.LANGUAGES])
    status = F.when(every, "model_translated_pending_review").otherwise("translation_in_progress")
    stage = F.when(every, "translation_generated_pending_review").otherwise("translation_in_progress")
    step = F.when(every, "bilingual_translation_qc").otherwise("complete_remaining_language_translations")
    pipeline = F.col("pipeline").withField("stage", stage).withField("translation_status", status).withField("next_required_step", step)
    return records.withColumn("_t", touched).withColumns(
        {"metadata": F.when(F.col("_t"), F.col("metadata").withField("translation_status", status)).otherwise(F.col("metadata")), "pipeline": F.when(F.col("_t"), pipeline).otherwise(F.col("pipeline"))}
    ).drop("_t")


def missing_translations(records: DataFrame) -> DataFrame:
    """prompt_id, lang_ord, code of languages without a literal or a natural form; blanks count as text here."""
    b = F.col("block")
    none = lambda n: F.coalesce(b[n], F.lit("")) == ""
    return long_form(records, "prompt_id", fields=("literal", "robot_natural")).where(none("literal") | none("robot_natural")).select("prompt_id", "lang_ord", "code")


def unapproved(records: DataFrame) -> DataFrame:
    """prompt_id and the codes whose review isn't approved, of records with any."""
    codes = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(block_name(c))["review"]["review_status"] == "approved", F.lit(False)), c) for c in V.LANGUAGES)))
    return records.select("prompt_id", codes.alias("codes")).where(F.size("codes") > 0)


def review_gate(statuses: list[Column]) -> Column:
    return F.when(reduce(lambda a, b: a & b, [F.coalesce(s == "approved", F.lit(False)) for s in statuses]), "approved").otherwise("pending_or_partial")


class NotReleasable(ValueError):
    """A record keeps the corpus from being released; nothing has been written."""


def finalize(records: DataFrame, *, require_approved: bool = False) -> DataFrame:
    """The released records. The first record by prompt_id that lacks a translation or, if required, an approval is an error."""
    watched_, watch = watched(records, require_approved=require_approved)
    watched_.write.format("noop").mode("overwrite").save()
    refuse(watch)
    return released(records)


def watched(records: DataFrame, *, require_approved: bool) -> tuple[DataFrame, Observation]:
    """The records, and what forbids their release, known once they have been written in any way: no pass of its own.

    The smallest prompt_id decides which record is named; of it, the first language.
    """
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    block = {c: F.col(block_name(c)) for c in V.LANGUAGES}
    gaps = F.array_compact(F.array(*(F.when(empty(b["literal"]) | empty(b["robot_natural"]), c) for c, b in block.items())))
    closed = F.array_compact(F.array(*(F.when(~F.coalesce(b["review"]["review_status"] == "approved", F.lit(False)), c) for c, b in block.items())))
    first = lambda codes: F.min(F.when(F.size(codes) > 0, F.struct("prompt_id", codes.alias("codes"))))
    watch = Observation()
    return records.observe(watch, first(gaps).alias("untranslated"), (first(closed) if require_approved else F.max(F.lit(None))).alias("unapproved")), watch


def refuse(watch: Observation) -> None:
    """Raises what ``watched`` has found."""
    found = watch.get
    if gap := found.get("untranslated"):
        raise NotReleasable(f"{gap[0]} is missing {gap[1][0]} translations.")
    if gap := found.get("unapproved"):
        raise NotReleasable(f"{gap[0]} has untranslated or unapproved review blocks for {list(gap[1])}.")


def released(records: DataFrame) -> DataFrame:
    """The records in the form of a release, whether they may be released or not."""
    forms = F.col("instruction_multilingual")
    for c in V.LANGUAGES:
        b = F.col(block_name(c))
        forms = forms.withField(c, F.struct(b["literal"].alias("literal"), b["robot_natural"].alias("robot_natural")))
    pipeline = F.col("pipeline")
    for name, value in (("translation_status", "complete"), ("stage", "multilingual_complete"), ("next_required_step", "downstream_multilingual_qc_or_release")):
        pipeline = pipeline.withField(name, F.lit(value))
    gate = review_gate([F.col(block_name(c))["review"]["review_status"] for c in V.LANGUAGES])
    records = without(records, *(f"instruction_multilingual.{c}" for c in V.LANGUAGES))
    return records.withColumns({"instruction_multilingual": forms, "metadata": F.col("metadata").withField("translation_status", F.lit("complete")), "pipeline": pipeline.withField("review_gate", gate)})
