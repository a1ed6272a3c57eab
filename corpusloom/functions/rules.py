"""Rules over instruction texts: tags, classes, payloads. All are expressions of whole-stage code.

A word matches wherever its letters stand, also inside another word; the first rule that matches decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import vocab as V
from corpusloom.functions.text import count_of


def strings(items: Iterable[str]) -> Column:
    found = [F.lit(x) for x in items]
    return F.array(*found) if found else F.array().cast("array<string>")


def any_of(text: Column, needles: Sequence[str]) -> Column:
    """Whether the text holds any of the needles; stops at the first."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles], F.lit(False))


def first_rule(text: Column, rules: Iterable[tuple[str, Sequence[str]]], default: str | None) -> Column:
    out = None
    for value, needles in rules:
        out = F.when(any_of(text, needles), value) if out is None else out.when(any_of(text, needles), value)
    return F.lit(default).cast("string") if out is None else out.otherwise(F.lit(default).cast("string"))


def present(text: Column, vocabulary: Sequence[str]) -> Column:
    """The entries that the text holds, in the vocabulary's order.

    The outer lambda holds the text: an expression would be worked out anew for every entry.
    """
    return F.get(F.transform(F.array(text), lambda t: F.filter(strings(vocabulary), lambda p: F.contains(t, p))), F.lit(0))


def first_present(text: Column, vocabulary: Sequence[str]) -> Column:
    return F.get(present(text, vocabulary), F.lit(0))


def motion_family(tier: Column, lowered: Column) -> Column:
    return F.when(tier == "T7", "long_horizon_mixed").otherwise(first_rule(lowered, V.MOTION_FAMILY, "basic_locomotion"))


def constraint_type(lowered: Column) -> Column:
    return first_rule(lowered, V.CONSTRAINT, "none")


def locomotion_type(lowered: Column) -> Column:
    return (
        F.when(any_of(lowered, V.GESTURE_WORDS), "gesture")
        .when(any_of(lowered, V.TURN_WORDS) & ~any_of(lowered, V.TRAVEL_WORDS), "turn")
        .when(any_of(lowered, V.POSE_WORDS), "pose")
        .when(any_of(lowered, V.JOINING_WORDS), "mixed")
        .otherwise("walk")
    )


def robot_feasibility(tier: Column, lowered: Column) -> Column:
    return F.when(tier.isin(*V.RISKY_TIERS) | any_of(lowered, V.RISKY_WORDS), "needs_review").otherwise("safe")


def terrain_dependence(lowered: Column) -> Column:
    return first_rule(lowered, V.TERRAIN_DEPENDENCE, "none")


def contact_complexity(tier: Column, lowered: Column) -> Column:
    return (
        F.when((tier == "T7") | any_of(lowered, V.HIGH_CONTACT), "high")
        .when(tier.isin(*V.MEDIUM_CONTACT_TIERS) | any_of(lowered, V.MEDIUM_CONTACT), "medium")
        .otherwise("low")
    )


def compositional_structure(tier: Column, lowered: Column) -> Column:
    three = (count_of(lowered, " then ") >= 2) | (count_of(lowered, ",") >= 2)
    out = F.when(tier == "T3", F.when(three, "3_step_sequence").otherwise("2_step_sequence"))
    for name, structure in V.STRUCTURE.items():
        out = out.when(tier == name, structure)
    return out.otherwise(V.LONG_STRUCTURE)


def ambiguity_type(lowered: Column) -> Column:
    return first_rule(lowered, V.AMBIGUITY, None)


def ambiguity_flag(lowered: Column) -> Column:
    return ambiguity_type(lowered).isNotNull()


def needs_scene(lowered: Column) -> Column:
    return any_of(lowered, V.SCENE_WORDS)


def needs_body(lowered: Column) -> Column:
    return any_of(lowered, V.BODY_WORDS)


def split_of(number: Column) -> Column:
    last = F.pmod(number, F.lit(10))
    return F.when(last == 0, "dev").when(last == 1, "test").otherwise("train")


def needs_postprocess(tier: Column, constraint: Column) -> Column:
    return tier.isin(*V.POSTPROCESS_TIERS) | (constraint != "none")


def safe_to_execute(feasibility: Column, ambiguous: Column) -> Column:
    return (feasibility == "safe") & ~ambiguous


def subtier(tier: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, spec in V.TIERS.items():
        out = out.when(tier == name, spec[5])
    return out.otherwise(V.UNKNOWN_SUBTIER)


def tier_value(tier: Column, field: int, kind: str) -> Column:
    """An entry of the tier's row; an unknown tier is an error."""
    out = F.when(F.lit(False), F.lit(None).cast(kind))
    for name, spec in V.TIERS.items():
        out = out.when(tier == name, F.lit(spec[field]).cast(kind))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown tier "), F.coalesce(tier, F.lit("null")))).cast(kind))


def primitive_tags(folded: Column, primitives: dict[str, Sequence[str]] = V.PRIMITIVES, unknown: str = V.UNKNOWN_PRIMITIVE) -> Column:
    """All tags with a needle in the text, in table order; ``unknown`` if there is none.

    ``folded`` is a column that holds the case-folded text: an expression would be worked out anew for every needle.
    """
    tags = F.array_compact(F.array(*(F.when(any_of(folded, needles), tag) for tag, needles in primitives.items())))
    return F.when(F.size(tags) == 0, strings([unknown])).otherwise(tags)


PAYLOAD = "path_type string, waypoints array<string>, obstacles array<string>, landmarks array<string>"


def constraint_payload(lowered: Column) -> Column:
    """A struct of what the text mentions; lists without an entry and the whole, if empty, are null."""
    some = lambda bank: F.nullif(F.filter(strings(V.BANKS[bank]), lambda t: F.contains(lowered, F.lower(t))), strings([]))
    path, waypoints, obstacles, landmarks = first_present(lowered, V.BANKS["path"]), some("waypoint"), some("obstacle"), some("landmark")
    whole = F.struct(path.alias("path_type"), waypoints.alias("waypoints"), obstacles.alias("obstacles"), landmarks.alias("landmarks"))
    return F.when(F.coalesce(path.isNotNull() | waypoints.isNotNull() | obstacles.isNotNull() | landmarks.isNotNull(), F.lit(False)), whole)


def payload_json(lowered: Column) -> Column:
    """As constraint_payload, as JSON text with the empty lists left out."""
    payload = constraint_payload(lowered)
    return F.when(payload.isNotNull(), F.to_json(payload))


def landmarks(payload_landmarks: Column, folded: Column) -> Column:
    """Distinct landmarks of the payload in order; if it has none, those named in the text, a column that holds it case-folded."""
    own = F.coalesce(payload_landmarks, strings([]))
    named = F.array_sort(F.filter(strings("the " + n for n in V.LANDMARK_NOUNS), lambda p: F.contains(folded, p)))
    return F.when(F.size(own) > 0, F.array_sort(F.array_distinct(own))).otherwise(named)
