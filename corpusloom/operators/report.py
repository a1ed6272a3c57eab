"""What is derived from corpus records: manifest, summary, run state, flat table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as X
from corpusloom.functions import vocab as V
from corpusloom.operators.lifecycle import block_complete, block_name, field, long_form


def was(b: Column) -> Column:
    """What the counts of a corpus take from a language's block."""
    return F.struct(
        F.coalesce(b["status"], F.lit("missing")).alias("status"),
        F.coalesce(b["review"]["review_status"], F.lit("missing")).alias("review"),
        *(F.coalesce(b["verification"][c], F.lit(False)).alias(c) for c in V.CHECKS),
        block_complete(b["status"], b["literal"], b["robot_natural"]).alias("complete"),
    )


def manifest(records: DataFrame, *, counted: bool = False) -> DataFrame:
    """One row for each record and language, with lang_ord for the order within a record; ``counted`` adds ``was``."""
    meta = lambda n: field(records, f"metadata.{n}", F.lit(None).cast("boolean")).alias(n)
    kept = records.select(
        "prompt_id",
        "tier",
        field(records, "subtier", F.lit(None).cast("string")).alias("subtier"),
        "instruction_en",
        F.struct(
            F.col("motion_family"),
            F.coalesce(field(records, "primitive_tags", R.strings([])), R.strings([])).alias("primitive_tags"),
            F.col("constraint_type"),
            F.coalesce(field(records, "landmarks", R.strings([])), R.strings([])).alias("landmarks"),
            meta("requires_scene_context"),
            meta("requires_body_reference"),
            meta("safe_for_direct_execution"),
        ).alias("context"),
        *(block_name(c) for c in V.LANGUAGES),
    )
    b = F.col("block")
    name = F.element_at(F.create_map(*(F.lit(x) for c, (n, _) in V.LANGUAGES.items() for x in (c, n))), F.col("code"))
    return long_form(kept, "prompt_id", "tier", "subtier", "instruction_en", "context", fields=("literal", "robot_natural", "verification", "review", "translation_notes", *(("status",) if counted else ()))).select(
        *((was(b).alias("was"),) if counted else ()),
        "prompt_id",
        "tier",
        "subtier",
        "lang_ord",
        F.col("code").alias("language"),
        name.alias("language_name"),
        "instruction_en",
        F.struct(b["literal"].alias("literal"), b["robot_natural"].alias("robot_natural")).alias("translation_target"),
        "context",
        b["verification"].alias("verification"),
        F.struct(b["review"]["bilingual_reviewer"].alias("bilingual_reviewer"), b["review"]["adjudicator"].alias("adjudicator"), F.coalesce(b["review"]["review_status"], F.lit("pending")).alias("status")).alias("review_assignment"),
        F.coalesce(b["translation_notes"], R.strings([])).alias("notes"),
    )


def status_counts(long: DataFrame, status: Column, code: str = "code") -> DataFrame:
    """code, status, n; a missing status counts as ``missing``."""
    return long.select(F.col(code).alias("code"), F.coalesce(status, F.lit("missing")).alias("status")).groupBy("code", "status").agg(F.count(F.lit(1)).alias("n"))


def pass_counts(long: DataFrame, checks: dict[str, Column], code: str = "code") -> DataFrame:
    """How often each check is true, for each language with any that is."""
    counted = long.groupBy(F.col(code).alias("code")).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    return counted.where(" + ".join(checks) + " > 0")


#: (tier, code, status, review, which checks are passed, complete) -> language jobs. Its size is that of the vocabularies.
Tally = dict[tuple[str | None, str, str, str, tuple[bool, ...], bool], int]


def tally(records: DataFrame) -> Tally:
    """All that summary and run state count, in one pass; the driver gets counts only."""
    counted = long_form(records, "tier", fields=("status", "review", "verification", "literal", "robot_natural")).select("tier", "code", was(F.col("block")).alias("was"))
    return tallied(counted.groupBy("tier", "code", "was").agg(F.count(F.lit(1)).alias("n")))


def tallied(rows: DataFrame) -> Tally:
    """(tier, code, was, n) as a tally; n may be negative, for what is taken back."""
    out: Tally = {}
    for r in rows.collect():
        key = (r.tier, r.code, r.was.status, r.was.review, tuple(r.was[c] for c in V.CHECKS), r.was.complete)
        out[key] = out.get(key, 0) + r.n
    return out


def plus(a: Tally, b: Tally) -> Tally:
    both = {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}
    return {k: n for k, n in both.items() if n}


def summary(records: DataFrame | Tally, assumptions: dict[str, Any]) -> dict[str, Any]:
    """The summary document, of records or of their tally."""
    counts = tally(records) if isinstance(records, DataFrame) else records
    first = next(iter(V.LANGUAGES))
    tiers: dict[str | None, int] = {}
    status: dict[str, dict[str, int]] = {}
    review: dict[str, dict[str, int]] = {}
    passed: dict[str, dict[str, int]] = {}
    order = {c: i for i, c in enumerate(V.LANGUAGES)}
    for (tier, code, state, reviewed, checks, _), n in sorted(counts.items(), key=lambda x: (order[x[0][1]], x[0][2], x[0][3])):
        if code == first:
            tiers[tier] = tiers.get(tier, 0) + n
        for doc, key in ((status, state), (review, reviewed)):
            own = doc.setdefault(code, {})
            own[key] = own.get(key, 0) + n
        if any(checks):
            own = passed.setdefault(code, dict.fromkeys(V.CHECKS, 0))
            for c, is_passed in zip(V.CHECKS, checks, strict=True):
                own[c] += n * is_passed
    tiers = dict(sorted(tiers.items(), key=lambda x: (x[0] is None, x[0] or "")))
    total = sum(tiers.values())
    return {
        "assumptions": assumptions,
        "total_prompts": total,
        "languages": {c: n for c, (n, _) in V.LANGUAGES.items()},
        "total_translation_jobs": total * len(V.LANGUAGES),
        "required_forms_per_language": 2,
        "required_verification_checks": len(V.CHECKS),
        "tier_counts": tiers,
        "language_job_counts": dict.fromkeys(V.LANGUAGES, total),
        "tier_language_job_counts": {t: dict.fromkeys(V.LANGUAGES, n) for t, n in tiers.items()},
        "translation_status_counts": status,
        "review_status_counts": review,
        "verification_pass_counts": passed,
        "next_steps": list(V.NEXT_STEPS),
    }


def summary_rows(records: DataFrame) -> DataFrame:
    """section, key, n: the counts of the summary document as rows. One pass of grouping sets; nothing goes to the driver."""
    b = F.col("block")
    long = long_form(records, "tier", fields=("status", "review", "verification")).select(
        "tier", "lang_ord", "code", F.coalesce(b["status"], F.lit("missing")).alias("status"), F.coalesce(b["review"]["review_status"], F.lit("missing")).alias("review"),
        *(F.coalesce(b["verification"][c], F.lit(False)).alias(c) for c in V.CHECKS),
    )
    tier, code, status, review = (F.col(c) for c in ("tier", "code", "status", "review"))
    sets = long.groupingSets([[], [tier], [code], [code, status], [code, review]], tier, code, status, review)
    counted = sets.agg(F.grouping_id().alias("set"), F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("lang_ord") == 0).alias("prompts"), *(F.count_if(c).alias(c) for c in V.CHECKS))
    entry = lambda section, key, n: F.struct(F.lit(section).alias("section"), key.alias("key"), n.alias("n"))
    slash = lambda key: F.concat(code, F.lit("/"), key)
    checks = [entry("verification_pass_counts", slash(F.lit(c)), F.col(c)) for c in V.CHECKS]
    some = sum((F.col(c) for c in V.CHECKS), F.lit(0)) > 0
    # a bit of ``set`` is 1 for a column that the set leaves out: tier 8, code 4, status 2, review 1
    rows = F.when(F.col("set") == 15, F.array(entry("total", F.lit("prompts"), F.col("prompts")), entry("total", F.lit("jobs"), F.col("jobs"))))
    rows = rows.when(F.col("set") == 7, F.array(entry("tier", tier, F.col("prompts"))))
    rows = rows.when((F.col("set") == 11) & some, F.array(*checks))
    rows = rows.when(F.col("set") == 9, F.array(entry("translation_status_counts", slash(status), F.col("jobs"))))
    rows = rows.when(F.col("set") == 10, F.array(entry("review_status_counts", slash(review), F.col("jobs"))))
    return counted.select(F.inline(rows))


def job_counts(long: DataFrame, status: Column, literal: Column, natural: Column) -> DataFrame:
    """translated and pending language jobs, one row."""
    complete = block_complete(status, literal, natural)
    return long.agg(F.count_if(complete).alias("translated_language_jobs"), F.count_if(~complete).alias("pending_language_jobs"))


def run_state(records: DataFrame | Tally, *, method: str, model: str, verifier: str | None, completed: int, total: int) -> dict[str, Any]:
    counts = tally(records) if isinstance(records, DataFrame) else records
    done = sum(n for key, n in counts.items() if key[-1])
    return {
        "translation_method": method,
        "translation_model": model,
        "verification_model": verifier,
        "completed_batches": completed,
        "total_batches": total,
        "translated_language_jobs": done,
        "pending_language_jobs": sum(counts.values()) - done,
    }


def flat(records: DataFrame) -> DataFrame:
    """The export table: 25 columns of the record and 15 of each language."""
    nothing = F.lit(None).cast("string")
    at = lambda path: field(records, path, nothing)
    listed = lambda name: X.joined(field(records, name, R.strings([])), ", ")
    base = {
        **{n: at(n) for n in ("prompt_id", "tier", "subtier", "motion_family", "constraint_type")},
        "english_canonical": at("instruction_en.canonical"),
        "english_robot_natural": at("instruction_en.robot_natural"),
        **{n: at(f"metadata.{n}") for n in ("split", "translation_status", "validation_status", "safe_for_direct_execution", "ambiguity_flag", "ambiguity_type", "requires_scene_context", "requires_body_reference")},
        **{n: listed(n) for n in ("primitive_tags", "landmarks")},
        "pipeline_stage": at("pipeline.stage"),
        "pipeline_next_required_step": at("pipeline.next_required_step"),
        **{n: at(f"embodiment.{n}") for n in ("locomotion_type", "robot_feasibility", "terrain_dependence", "contact_complexity", "sequence_duration_s", "target_body")},
    }
    for code, (name, _) in V.LANGUAGES.items():
        b, language = block_name(code), name.lower()
        prefix = f"{code}_{language}"
        base |= {f"{language}_canonical": at(f"{b}.literal"), f"{language}_robot": at(f"{b}.robot_natural")}
        base |= {f"{prefix}_{n}": at(f"{b}.{n}") for n in ("literal", "robot_natural", "status")}
        base |= {f"{prefix}_review_status": at(f"{b}.review.review_status"), f"{prefix}_reviewer": at(f"{b}.review.bilingual_reviewer"), f"{prefix}_adjudicator": at(f"{b}.review.adjudicator")}
        base[f"{prefix}_translation_notes"] = X.joined(field(records, f"{b}.translation_notes", R.strings([])), " | ")
        base |= {f"{prefix}_{n}": at(f"{b}.provenance.{n}") for n in ("translation_model", "translation_method")}
        base |= {f"{prefix}_{n}": at(f"{b}.verification.{n}") for n in V.CHECKS}
    return records.select(*(c.alias(n) for n, c in base.items()))


def column_widths(table: DataFrame, most: int = 50) -> DataFrame:
    """name, width of each column: the longest of header and values, plus 2, at most ``most``. One aggregation.

    A null counts as its spelling, None for most columns and nan for numbers.
    """
    null = lambda kind: "nan" if kind in ("double", "float") else "None"
    shown = lambda n, kind: F.initcap(F.col(f"`{n}`").cast("string")) if kind == "boolean" else F.col(f"`{n}`").cast("string")
    longest = table.agg(*(F.max(F.length(F.coalesce(shown(n, kind), F.lit(null(kind))))).alias(n) for n, kind in table.dtypes))
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.least(F.greatest(F.lit(len(n)), F.coalesce(F.col(f"`{n}`"), F.lit(0))) + 2, F.lit(most)).alias("width")) for n in table.columns))
    return longest.select(F.inline(pairs))
