"""Instruction candidates from the grammar, and the selection of the corpus from them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as X
from corpusloom.functions import vocab as V
from corpusloom.functions.grammar import GRAMMAR, Block, Rule

#: Put before an instruction whose md5 decides its place in the pool.
SEED = 42
_SLOT = re.compile(r"\{(\w+)\}")


def _fill(pattern: str, parts: dict[str, Column]) -> Column:
    """{x}: the part x; {X}: the same with a capital first letter."""
    out = []
    for i, piece in enumerate(_SLOT.split(pattern)):
        if i % 2 == 0:
            out += [F.lit(piece)] if piece else []
        elif piece in parts:
            out.append(parts[piece])
        else:
            out.append(X.sentence_case(parts[piece[0].lower() + piece[1:]]))
    return F.concat(*out)


def expand_rule(spark: SparkSession, rule: Rule, templates: tuple[str, ...]) -> DataFrame:
    """All sentences of one rule: the slots' terms are unfolded one slot after the other, without a join."""
    df = spark.range(0, 1, 1, 1)  # one task a rule
    for slot, terms in rule.slots.items():
        df = df.select("*", F.posexplode(R.strings(terms)).alias(f"{slot}_n", slot))
    if rule.condition:
        kind, *slots = rule.condition
        numbers = [F.col(f"{s}_n") for s in slots]
        if kind == "<":
            df = df.where(numbers[0] < numbers[1])
        else:
            df = df.where(reduce(lambda a, b: a & b, (x != y for i, x in enumerate(numbers) for y in numbers[:i])))
    slots_ = {s: F.col(s) for s in rule.slots}
    parts = slots_ if rule.parts is None else {p: _fill(pattern, slots_) for p, pattern in rule.parts.items()}
    df = df.select(*(c.alias(p) for p, c in parts.items()))
    named = {p: F.col(p) for p in parts}
    return df.select(F.explode(F.array(*(_fill(t, named) for t in templates))).alias("prompt"))


def candidates(spark: SparkSession, tier: str, blocks: tuple[Block, ...] | None = None) -> DataFrame:
    """(tier, prompt): the distinct sentences of a tier."""
    found = [expand_rule(spark, r, b.templates) for b in (blocks or GRAMMAR[tier]) for r in b.rules]
    return reduce(DataFrame.unionByName, found).distinct().select(F.lit(tier).alias("tier"), "prompt")


def all_candidates(spark: SparkSession) -> DataFrame:
    """Of all tiers; a sentence of two tiers comes in both."""
    return reduce(DataFrame.unionByName, [candidates(spark, t) for t in GRAMMAR])


def dedupe_casefold(df: DataFrame, column: str, *, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """One row for each spelling that differs in more than case and white space: the first in ``order``, without one
    that in binary order. The text that stays has its white space normalised.

    Texts are told apart by 256 bits of SHA-2. With an ``order`` only that and the key are sorted, and joined back by both,
    so a frequent spelling is in no task whole and texts that nobody reads aren't moved. Rows equal in order
    are told apart by a hash of their text.
    """
    cleaned = X.normalize_space(column)
    key = F.unhex(F.sha2(X.casefold(cleaned), 256)).alias("_key")
    if not order:
        first = F.min_by(F.struct("*"), F.struct(cleaned, F.col(column))).alias("_first")
        return df.groupBy(*by, key).agg(first).select("_first.*").withColumn(column, cleaned)
    rows = df.select("*", key, F.struct(*order, F.xxhash64(column).alias("_text")).alias("_mark"))
    firsts = rows.groupBy(*by, "_key").agg(F.min("_mark").alias("_mark")).select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by)), F.col("_key").alias("_k"), F.col("_mark").alias("_m"))
    same = [F.col("_key").eqNullSafe(F.col("_k")), F.col("_mark") == F.col("_m"), *(F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by))]
    kept = rows.join(firsts, reduce(lambda a, b: a & b, same), "left_semi").dropDuplicates([*by, "_key", "_mark"])
    return kept.drop("_key", "_mark").withColumn(column, cleaned)


def pool_order(tier: Column, prompt: Column, seed: int = SEED) -> list[Column]:
    """The shuffled order: by md5 of seed, tier and instruction. The same on every run and every cluster."""
    return [F.md5(F.concat(F.lit(f"{seed}|"), tier, F.lit("|"), prompt).cast("binary")), prompt]


def ranked(df: DataFrame, *, by: str = "tier", text: str = "prompt", seed: int = SEED) -> DataFrame:
    """Adds rank, from 1, in the shuffled order of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*pool_order(F.col(by), F.col(text), seed))))


#: Hexadecimal digits of the shuffled order that deal a group's rows to ranges.
RANGE_DIGITS = 3


def first_of_each(df: DataFrame, *, by: str, text: str, wanted: Column, seed: int = SEED) -> DataFrame:
    """Adds rank: the first rows of each group in the shuffled order of ``ranked``, ``wanted`` of them, which may
    depend on ``size``, the rows of the group.

    The order is by a hash, so ranges of it hold like numbers of rows. Their exact counts tell the rank at which each
    range begins; ranges beyond what is wanted go before anything is sorted, and each of the others is ranked
    in a task of its own. So no task sees a group, and what is chosen is exact. A row without ``by`` is of a group
    of its own; ``text`` tells rows apart, equal ones having no order among them.
    """
    group = F.coalesce(F.col(by).cast("string"), F.lit(""))
    digest, _ = pool_order(group, F.coalesce(F.col(text).cast("string"), F.lit("")), seed)
    rows = df.withColumns({"_at": digest, "_range": F.substring(digest, 1, RANGE_DIGITS)})
    counts = rows.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(by)).alias("size"))
    starts = starts.withColumn("_wanted", wanted).where("_before < _wanted").drop("size")
    near = rows.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    within = F.row_number().over(Window.partitionBy(by, "_range").orderBy("_at", text))
    ranked_ = near.withColumn("rank", F.col("_before") + within).where("rank <= _wanted")
    return ranked_.drop("_at", "_range", "_by", "_r", "_before", "_wanted")


def select_corpus(pool: DataFrame) -> DataFrame:
    """tier, prompt, rank, number, review_required of the selected instructions.

    A tier keeps the first ``target`` of its pool of ``candidate_quota``; the first of each tier go to
    human review at its rate; numbers run through the tiers in order.
    """
    tier = F.col("tier")
    chosen = ranked(pool).where(F.col("rank") <= F.least(R.tier_value(tier, 1, "int"), R.tier_value(tier, 0, "int")))
    n = F.count(F.lit(1)).over(Window.partitionBy("tier"))
    review = F.col("rank") <= F.least(n, F.ceil(n * R.tier_value(tier, 2, "double")))
    # seven counts give each tier its first number; no window over all rows
    sizes = chosen.groupBy("tier").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("first", F.coalesce(F.sum("size").over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("tier", "first")
    return chosen.withColumn("review_required", review).join(before, "tier").withColumn("number", F.col("first") + F.col("rank") - 1).drop("first")


def entry_columns(selected: DataFrame, *keep: str, natural: bool = True) -> DataFrame:
    """The raw corpus record of each selected instruction, behind it the columns ``keep``.

    Without ``natural`` the plain wording, by far the dearest field, is null: for callers that don't read it, as the optimizer
    works out all fields of a struct of which any is read.
    """
    tier = F.col("tier")
    plain = X.robot_natural("prompt") if natural else F.lit(None).cast("string")
    df = selected.select(*keep, "tier", "number", "review_required", F.col("prompt").alias("canonical"), F.lower("prompt").alias("low"), plain.alias("natural"))
    low = F.col("low")
    df = df.withColumns({"motion_family": R.motion_family(tier, low), "constraint_type": R.constraint_type(low), "feasibility": R.robot_feasibility(tier, low), "ambiguity_type": R.ambiguity_type(low)})
    ambiguous = F.col("ambiguity_type").isNotNull()
    english = F.struct(F.col("canonical"), F.col("natural").alias("robot_natural"))
    stub = F.struct(F.lit(None).cast("string").alias("literal"), F.lit(None).cast("string").alias("robot_natural"))
    return df.select(
        X.prompt_id("number").alias("prompt_id"),
        "tier",
        english.alias("instruction_en"),
        F.struct(english.alias("en"), *(stub.alias(code) for code in V.LANGUAGES)).alias("instruction_multilingual"),
        "motion_family",
        "constraint_type",
        F.struct(
            F.lit(V.TARGET_BODY).alias("target_body"),
            R.locomotion_type(low).alias("locomotion_type"),
            F.col("constraint_type"),
            F.col("feasibility").alias("robot_feasibility"),
            R.terrain_dependence(low).alias("terrain_dependence"),
            R.contact_complexity(tier, low).alias("contact_complexity"),
            R.tier_value(tier, 4, "double").alias("sequence_duration_s"),
            F.lit(V.TARGET_FPS).alias("target_fps"),
            R.needs_postprocess(tier, F.col("constraint_type")).alias("requires_postprocess"),
        ).alias("embodiment"),
        F.struct(
            F.lit(False).alias("validated"),
            F.lit("unverified").alias("validation_status"),
            F.col("review_required"),
            R.tier_value(tier, 2, "double").alias("review_rate"),
            F.lit(None).cast("string").alias("motion_asset"),
            R.constraint_payload(low).alias("constraint_payload"),
        ).alias(V.VALIDATOR),
        F.struct(
            R.tier_value(tier, 3, "string").alias("qc_focus"),
            R.compositional_structure(tier, low).alias("compositional_structure"),
            ambiguous.alias("ambiguity_flag"),
            F.col("ambiguity_type"),
            R.needs_scene(low).alias("requires_scene_context"),
            R.needs_body(low).alias("requires_body_reference"),
            F.lit("pending").alias("translation_status"),
            R.safe_to_execute(F.col("feasibility"), ambiguous).alias("safe_for_direct_execution"),
            F.lit("unverified").alias("validation_status"),
            R.split_of(F.col("number")).alias("split"),
        ).alias("metadata"),
        *keep,
    )


def raw_corpus(spark: SparkSession) -> DataFrame:
    """The 10,000 raw records, in no order; prompt_id orders them."""
    return entry_columns(select_corpus(dedupe_casefold(all_candidates(spark), "prompt", by=("tier",))))


def selection_report(pool: DataFrame) -> DataFrame:
    """raw, pool, selected and shortfall of each tier."""
    tier = F.col("tier")
    counted = pool.groupBy("tier").agg(F.count(F.lit(1)).alias("raw"))
    sized = counted.withColumn("pool", F.least("raw", R.tier_value(tier, 1, "long"))).withColumn("selected", F.least("pool", R.tier_value(tier, 0, "long")))
    return sized.withColumn("shortfall", R.tier_value(tier, 0, "long") - F.col("selected"))
