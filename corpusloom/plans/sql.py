"""The same rules and grammar in DuckDB SQL, to check the DataFrame operators against."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from corpusloom.functions import vocab as V
from corpusloom.functions.grammar import GRAMMAR, Block, Rule
from corpusloom.operators.generate import _SLOT, SEED


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def listed(items: Iterable[str]) -> str:
    return "[" + ", ".join(map(q, items)) + "]::VARCHAR[]"


def lower(x: str) -> str:
    """Lower case as Spark has it: the dotted capital I becomes i and a combining dot."""
    return f"lower(replace({x}, 'İ', 'i̇'))"


def casefold(x: str) -> str:
    return f"replace({lower(x)}, 'ß', 'ss')"


def normalize_space(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x1c-\x1f\x0b]+', ' ', 'g'))"


def sentence_case(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


def strip_period(x: str) -> str:
    return f"CASE WHEN ends_with({x}, '.') THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"


def replaced(x: str, pairs: Iterable[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def normalize_for_match(x: str) -> str:
    return normalize_space(replaced(casefold(normalize_space(x)), V.MATCH_REWRITES))


def sanitized(x: str, target: str) -> str:
    codes = [V.SOURCE_CODE, *(c for _, c in V.LANGUAGES.values())]
    return normalize_space(replaced(x, [(t, " ") for t in (*V.MODEL_TOKENS, *codes, target.replace("_", " "))]))


def robot_natural(x: str) -> str:
    out = f"trim({strip_period(x)})"
    for p in V.LEADING:
        out = rf"regexp_replace({out}, '^{p}\s+', '', 'i')"
    for p in V.TRAILING:
        out = rf"regexp_replace({out}, '\s+{p}$', '', 'i')"
    for p, start, new in V.REWRITES:
        out = rf"regexp_replace({out}, '{'^' if start else chr(92) + 'b'}{p}\b', {q(new)}, 'gi')"
    out = rf"trim(regexp_replace({out}, '\s+', ' ', 'g'), ' ,;')"
    return sentence_case(out) + " || '.'"


def any_of(x: str, needles: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def first_rule(x: str, rules: Iterable[tuple[str, Sequence[str]]], default: str | None) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, n)} THEN {q(v)}" for v, n in rules) + f" ELSE {q(default)} END"


def count_of(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(needle)}, ''))) // {len(needle)})::INTEGER"


def present(x: str, phrases: Sequence[str]) -> str:
    return f"list_filter({listed(phrases)}, lambda p: contains({x}, p))"


def motion_family(t: str, x: str) -> str:
    return f"CASE WHEN {t} = 'T7' THEN 'long_horizon_mixed' ELSE {first_rule(x, V.MOTION_FAMILY, 'basic_locomotion')} END"


def constraint_type(x: str) -> str:
    return first_rule(x, V.CONSTRAINT, "none")


def locomotion_type(x: str) -> str:
    return (
        f"CASE WHEN {any_of(x, V.GESTURE_WORDS)} THEN 'gesture' WHEN {any_of(x, V.TURN_WORDS)} AND NOT {any_of(x, V.TRAVEL_WORDS)} THEN 'turn' "
        f"WHEN {any_of(x, V.POSE_WORDS)} THEN 'pose' WHEN {any_of(x, V.JOINING_WORDS)} THEN 'mixed' ELSE 'walk' END"
    )


def _in(t: str, tiers: Sequence[str]) -> str:
    return f"{t} IN ({', '.join(map(q, tiers))})"


def robot_feasibility(t: str, x: str) -> str:
    return f"CASE WHEN {_in(t, V.RISKY_TIERS)} OR {any_of(x, V.RISKY_WORDS)} THEN 'needs_review' ELSE 'safe' END"


def terrain_dependence(x: str) -> str:
    return first_rule(x, V.TERRAIN_DEPENDENCE, "none")


def contact_complexity(t: str, x: str) -> str:
    return f"CASE WHEN {t} = 'T7' OR {any_of(x, V.HIGH_CONTACT)} THEN 'high' WHEN {_in(t, V.MEDIUM_CONTACT_TIERS)} OR {any_of(x, V.MEDIUM_CONTACT)} THEN 'medium' ELSE 'low' END"


def compositional_structure(t: str, x: str) -> str:
    three = f"{count_of(x, ' then ')} >= 2 OR {count_of(x, ',')} >= 2"
    rest = " ".join(f"WHEN {t} = {q(n)} THEN {q(s)}" for n, s in V.STRUCTURE.items())
    return f"CASE WHEN {t} = 'T3' THEN CASE WHEN {three} THEN '3_step_sequence' ELSE '2_step_sequence' END {rest} ELSE {q(V.LONG_STRUCTURE)} END"


def ambiguity_type(x: str) -> str:
    return first_rule(x, V.AMBIGUITY, None)


def subtier(t: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN {q(n)} THEN {q(s[5])}" for n, s in V.TIERS.items()) + f" ELSE {q(V.UNKNOWN_SUBTIER)} END"


def split_of(n: str) -> str:
    return f"CASE {n} % 10 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END"


def primitive_tags(x: str) -> str:
    tags = ", ".join(f"CASE WHEN {any_of(x, n)} THEN {q(t)} END" for t, n in V.PRIMITIVES.items())
    found = f"list_filter([{tags}], lambda t: t IS NOT NULL)"
    return f"CASE WHEN len({found}) = 0 THEN {listed([V.UNKNOWN_PRIMITIVE])} ELSE {found} END"


def bank_in(x: str, bank: str) -> str:
    return f"list_filter({listed(V.BANKS[bank])}, lambda p: contains({x}, lower(p)))"


def landmarks_in(folded: str) -> str:
    return f"list_sort({present(folded, ['the ' + n for n in V.LANDMARK_NOUNS])})"


def languages() -> str:
    return "(VALUES " + ", ".join(f"({i}, {q(c)}, {q(n)}, {q(m)})" for i, (c, (n, m)) in enumerate(V.LANGUAGES.items())) + ") AS lang(lang_ord, code, name, model_code)"


def tiers() -> str:
    return "(VALUES " + ", ".join(f"({q(t)}, {s[0]}, {s[1]}, {s[2]}::DOUBLE, {q(s[3])}, {s[4]}::DOUBLE, {q(s[5])})" for t, s in V.TIERS.items()) + ") AS tiers(tier, target, quota, review_rate, qc_focus, duration_s, subtier)"


def _fill(pattern: str, parts: dict[str, str]) -> str:
    out = []
    for i, piece in enumerate(_SLOT.split(pattern)):
        if i % 2 == 0:
            out += [q(piece)] if piece else []
        elif piece in parts:
            out.append(parts[piece])
        else:
            out.append(sentence_case(parts[piece[0].lower() + piece[1:]]))
    return " || ".join(out)


def _rule(rule: Rule, block: Block) -> str:
    banks = ", ".join(f"(VALUES {', '.join(f'({i}, {q(t)})' for i, t in enumerate(terms))}) AS {s}_(n, t)" for s, terms in rule.slots.items())
    slots = {s: f"{s}_.t" for s in rule.slots}
    where = ""
    if rule.condition:
        kind, *names = rule.condition
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        where = " WHERE " + " AND ".join(f"{a}_.n {'<' if kind == '<' else '<>'} {b}_.n" for a, b in pairs)
    parts = slots if rule.parts is None else {p: f"({_fill(pattern, slots)})" for p, pattern in rule.parts.items()}
    named = {p: f'p."{p}"' for p in parts}
    inner = "SELECT " + ", ".join(f'{e} AS "{p}"' for p, e in parts.items()) + f" FROM {banks}{where}"
    made = ", ".join(_fill(t, named) for t in block.templates)
    return f"SELECT unnest([{made}]) AS prompt FROM ({inner}) p"


def candidates(tier: str) -> str:
    """SELECT of the distinct sentences of a tier."""
    return f"SELECT {q(tier)} AS tier, prompt FROM (" + " UNION ".join(_rule(r, b) for b in GRAMMAR[tier] for r in b.rules) + ")"


def pool() -> str:
    """CTEs ending in ``ranked(tier, prompt, rank)`` over all tiers."""
    every = " UNION ALL ".join(candidates(t) for t in GRAMMAR)
    return f"""
cand AS ({every}),
firsts AS (SELECT tier, prompt, row_number() OVER (PARTITION BY tier, {casefold("prompt")} ORDER BY prompt) AS n FROM cand),
ranked AS (SELECT tier, prompt, row_number() OVER (PARTITION BY tier ORDER BY md5('{SEED}|' || tier || '|' || prompt), prompt) AS rank FROM firsts WHERE n = 1)"""


def selected() -> str:
    """CTEs ending in ``chosen(tier, prompt, rank, number, review_required)``."""
    return f"""{pool()},
kept AS (SELECT r.*, count(*) OVER (PARTITION BY tier) AS n FROM ranked r JOIN {tiers()} USING (tier) WHERE rank <= least(quota, target)),
chosen AS (SELECT k.tier, prompt, rank, row_number() OVER (ORDER BY k.tier, rank) - 1 AS number, rank <= least(n, ceil(n * review_rate)) AS review_required FROM kept k JOIN {tiers()} USING (tier))"""
