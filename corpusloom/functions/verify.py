"""Whether a back-translation keeps the actions, order, directions and safety words of its source.

Texts are those that ``normalize_for_match`` gives, as columns: an expression would be worked out anew for
every phrase.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vocab as V
from corpusloom.functions.rules import present
from corpusloom.functions.text import normalize_for_match


def normalized(df: DataFrame, **texts: Column) -> DataFrame:
    """Adds each text as it is matched, under its name; a missing one is the empty text."""
    return df.withColumns({n: normalize_for_match(F.coalesce(c, F.lit(""))) for n, c in texts.items()})


def phrases_in(text: Column, phrases: Sequence[str]) -> Column:
    return present(text, phrases)


def keeps_set(source: Column, candidate: Column, phrases: Sequence[str]) -> Column:
    """Every phrase of the source is in the candidate; true if it has none."""
    return F.forall(phrases_in(source, phrases), lambda p: F.contains(candidate, p))


def keeps_vocabulary_order(source: Column, candidate: Column, phrases: Sequence[str]) -> Column:
    """The source's phrases, in the vocabulary's order, first occur in the candidate at places that don't decrease.

    This is the corpus's own test. It asks for the vocabulary's order, so a faithful translation may fail.
    """
    return _rising(candidate, phrases_in(source, phrases))


def _rising(candidate: Column, phrases: Column) -> Column:
    places = F.transform(phrases, lambda p: F.instr(candidate, p))
    return F.forall(places, lambda x: x > 0) & (places == F.array_sort(places))


def keeps_source_order(source: Column, candidate: Column, phrases: Sequence[str]) -> Column:
    """The phrases of the source, in the order of the source, first occur in the candidate in that order."""
    return _rising(candidate, _as_in(source, phrases_in(source, phrases)))


def _as_in(source: Column, phrases: Column) -> Column:
    """Phrases of the source by their first places in it."""
    return F.transform(F.array_sort(F.transform(phrases, lambda p: F.struct(F.instr(source, p).alias("at"), p.alias("p")))), lambda x: x["p"])


def verification(canonical: Column, natural: Column, literal_back: Column, natural_back: Column, *, source_order: bool = False) -> Column:
    """A struct of the four checks, each of both forms, over normalised texts.

    Each vocabulary is looked up once in each source; in a back-translation only what its source has is looked for.
    """
    found = lambda s, c: F.struct(s.alias("s"), c.alias("c"), *(phrases_in(s, v).alias(n) for n, v in (("a", V.ACTIONS), ("d", V.DIRECTIONS), ("f", V.SAFETY))))

    def tested(x: Column) -> Column:
        every = F.concat(x["a"], x["d"])
        order = _rising(x["c"], _as_in(x["s"], every) if source_order else every)
        a, d, f = (F.forall(x[n], lambda p: F.contains(x["c"], p)) for n in "adf")
        return F.struct(*(c.alias(n) for c, n in zip((a, order, d, f), V.CHECKS, strict=True)))

    forms = F.transform(F.array(found(canonical, literal_back), found(natural, natural_back)), tested)
    return F.get(F.transform(F.array(forms), lambda two: F.struct(*((two[0][n] & two[1][n]).alias(n) for n in V.CHECKS))), F.lit(0))


def checked(source: str, candidate: str, *, source_order: bool = False) -> tuple[bool, bool, bool, bool]:
    """The four checks of one form, over texts as they are matched, for a task that has them at hand: a look-up in a
    Python text costs a fraction of one in a column."""
    a, d, f = ([p for p in phrases if p in source] for phrases in (V.ACTIONS, V.DIRECTIONS, V.SAFETY))
    every = sorted(a + d, key=lambda p: (source.find(p), p)) if source_order else a + d
    places = [candidate.find(p) for p in every]
    order = all(x >= 0 for x in places) and places == sorted(places)
    return all(p in candidate for p in a), order, all(p in candidate for p in d), all(p in candidate for p in f)


def skipped_verification() -> Column:
    """What a run without a verifier records: all four true."""
    return F.struct(*(F.lit(True).alias(n) for n in V.CHECKS))


def notes(checks: Column, literal_back: Column, natural_back: Column, verified: Column, engine: str) -> Column:
    """The translation notes: how it was made and, if verified, the back-translations and what failed."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(checks.getField(n), F.lit(False)), n) for n in V.CHECKS)))
    made = F.lit(f"Translated locally with {engine}.")
    long = F.array_compact(
        F.array(
            made,
            F.lit(f"Verification was estimated via {engine} back-translation to English."),
            F.concat(F.lit("Literal back-translation: "), literal_back),
            F.concat(F.lit("Robot-natural back-translation: "), natural_back),
            F.when(F.size(failed) > 0, F.concat(F.lit("Automatic verification flagged: "), F.array_join(failed, ", "), F.lit("."))),
        )
    )
    return F.when(verified, long).otherwise(F.array(made, F.lit("Automatic back-translation verification was skipped for this run.")))


__all__ = ["checked", "keeps_set", "keeps_source_order", "keeps_vocabulary_order", "normalized", "notes", "phrases_in", "skipped_verification", "verification"]
