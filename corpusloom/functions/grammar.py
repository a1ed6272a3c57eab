"""The grammar of the seven tiers, as data: slots and sentence templates.

A rule has slots, each a bank's name or a list of terms, an optional condition on the slots' numbers and
what it makes of them; a block expands the rules with templates, {x} being a part and {X} the same with a
capital first letter. Spark and SQL are both generated from this. Terms and templates are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from corpusloom.functions.vocab import BANKS

Terms = tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    slots: dict[str, Terms] = field(default_factory=dict)
    parts: dict[str, str] | None = None  # part -> pattern over slots; None: the slots themselves
    condition: tuple[str, ...] = ()  # ("<", a, b): number of a's term below b's; ("distinct", a, b, ...)


@dataclass(frozen=True)
class Block:
    rules: tuple[Rule, ...]
    templates: Terms


def _terms(x: str | Terms) -> Terms:
    return BANKS[x] if isinstance(x, str) else tuple(x)


def rule(parts: str | tuple[str, ...] | None = None, condition: tuple[str, ...] = (), **slots) -> Rule:
    """``parts``: one pattern for {phrase}, or one for each of {a}, {b}, {c}."""
    named = None if parts is None else {"phrase": parts} if isinstance(parts, str) else dict(zip("abc", parts, strict=False))
    return Rule({k: _terms(v) for k, v in slots.items()}, named, condition)


def phrases(*terms: str) -> Rule:
    return Rule({"phrase": tuple(terms)})


def fixed(*sentences: str) -> Block:
    return Block((Rule({"s": tuple(sentences)}),), ("{s}",))


LR = ("left", "right")
AXES = ("forward", "backward", "left", "right")
TURN_LR = ("turn left", "turn right")
AHEAD = ("walk forward", "move forward", "step ahead")
ONWARD = ("walk forward", "move ahead", "step forward")

T1 = (
    Block(
        (
            phrases(*BANKS["stop"], *BANKS["posture"], *BANKS["gesture"], *BANKS["loco"]),
            rule("{v} {d}", v="turn", d="turn_direction"),
            phrases(
                "step forward", "step back", "step aside", "step left", "step right", "sidestep left", "sidestep right", "back up",
                "face left", "face right", "face forward", "face backward", "look left", "look right", "look up", "look down", "look around",
                "raise arms", "lower arms", "extend arms", "spread legs", "close stance", "open your hands", "close your hands", "shift your weight",
                "center your balance", "square your shoulders", "plant your feet", "lift your chin", "drop your shoulders", "steady yourself",
                "hold still", "breathe", "brace", "relax", "reset",
            ),
        ),
        (
            "{Phrase}.", "{Phrase} now.", "Immediately {phrase}.", "{Phrase} immediately.", "{Phrase} right away.", "{Phrase} at once.", "{Phrase} in place.",
            "{Phrase} here.", "{Phrase} without delay.", "At once, {phrase}.", "{Phrase} where you are.", "{Phrase} directly.", "{Phrase} promptly.",
            "{Phrase} straight away.", "Just {phrase}.", "{Phrase} for now.", "{Phrase} where you stand.", "{Phrase} in your current position.",
            "{Phrase} without moving away.", "{Phrase} with control.", "{Phrase} as instructed.", "{Phrase} on the spot.", "{Phrase} before anything else.",
            "{Phrase} and hold.", "{Phrase} with care.", "{Phrase} in a steady way.", "{Phrase} and stay ready.", "{Phrase} in a neutral manner.",
        ),
    ),
)

T2 = (
    Block(
        (
            rule("{v} {d}", v="loco", d="direction"),
            rule("{v} {n}", v=("walk", "move", "step", "go"), n="count"),
            rule("{v} {d} {n}", v=("walk", "move", "step"), d=AXES, n="count"),
            rule("{v} {s}", v=("walk", "move", "proceed", "advance"), s="speed"),
            rule("{v} {d} {s}", v=("walk", "move", "step"), d=AXES, s="speed"),
            rule("{v} {d}", v="turn", d=LR),
            rule("{v} {d} {s}", v="turn", d=LR, s=("slowly", "quickly", "carefully", "steadily")),
            rule("{v} {d} {e}", v="turn", d=LR, e="turn_extent"),
            rule("{v} {b}", v=("raise", "lower", "extend", "lift", "swing"), b="body_side"),
            rule("{v} {d}", v=("lean", "tilt", "bend"), d=("left", "right", "forward", "backward")),
            rule("sidestep {d} {n}", d=LR, n=("one step", "two steps", "three steps")),
            rule("sidestep {d} {s}", d=LR, s=("slowly", "quickly", "carefully")),
        ),
        ("{Phrase}.", "{Phrase} precisely.", "{Phrase} with control.", "{Phrase} now.", "{Phrase} carefully.", "{Phrase} steadily."),
    ),
)

T3 = (
    Block(
        (
            rule(("{v} {d}", "{t}"), v=("walk", "move", "step"), d=("forward", "ahead"), t=("turn left", "turn right", "turn around")),
            rule(("{t}", "{m}"), t=TURN_LR, m=("walk forward", "move ahead", "proceed forward")),
            rule(("{v} {d}", "stop"), v="loco", d=("forward", "ahead", "backward")),
            rule(("{p}", "{m}"), p=("crouch", "kneel", "squat", "duck", "bow"), m=("move forward", "walk forward", "step ahead", "stand up", "rise")),
            rule(("{g}", "{m}"), g=("wave", "clap", "nod", "salute", "point forward"), m=(*AHEAD, "stop")),
            rule(("{m}", "{g}"), g=("wave", "clap", "nod", "salute", "point forward"), m=AHEAD),
            rule(("{v} forward {n}", "{t}"), v=("walk", "move", "step"), n=("two steps", "three steps", "one metre", "two metres"), t=(*TURN_LR, "stop")),
            rule(("sidestep {d}", "{m}"), d=LR, m=(*AHEAD, *TURN_LR)),
        ),
        ("{A} and {b}.", "{A}, then {b}.", "{A}; then {b}.", "{A}, and after that {b}.", "{A}, followed by {b}.", "{A}. Then {B}.", "First {a}, then {b}."),
    ),
    Block(
        (
            rule(("{v} forward {n}", "{t}", "{f}"), v=("walk", "move", "step"), n=("two steps", "three steps", "one metre"), t=TURN_LR, f=("stop", "walk forward")),
            rule(("{t}", "{m}", "{u}"), t=TURN_LR, m=ONWARD, u=("turn left", "turn right", "turn around")),
            rule(("{p}", "{m}", "{f}"), p=("crouch", "kneel", "squat", "duck"), m=("move forward", "walk ahead", "step forward two steps"), f=("stand up", "rise", "stop")),
            rule(("{m}", "{g}", "stop"), m=(*ONWARD, "advance forward"), g=("wave", "clap", "nod", "salute")),
            rule(("{g}", "{m}", "{f}"), g=("wave", "clap", "nod", "point forward"), m=ONWARD, f=("stop", "salute", "wave", "nod")),
            rule(("sidestep {d}", "{m}", "{f}"), d=LR, m=ONWARD, f=("stop", *TURN_LR)),
        ),
        (
            "{A}, {b}, and {c}.", "{A}, then {b}, then {c}.", "{A}; then {b}; then {c}.", "{A}, after that {b}, then {c}.",
            "First {a}, then {b}, then {c}.", "{A}, followed by {b}, and finally {c}.", "{A}. Then {B}. Then {C}.",
        ),
    ),
    fixed(
        "Walk forward, turn left, and stop.", "Walk forward, turn right, and stop.", "Crouch, move ahead, then stand up.", "Turn right, wave, and stop.",
        "Sidestep left, move forward, then stop.", "Back up, turn around, and walk forward.", "Wave, step forward, then stop.", "Crouch, move forward three steps, then rise.",
        "Turn left, walk forward, then turn right.", "Stop, look around, then move forward.", "Turn right, sidestep left, then stop.", "Kneel, stand up, then walk forward.",
        "Move backward, turn around, then walk forward.", "Walk forward two steps, turn right, and stop.", "Walk forward three steps, turn left, and stop.", "Turn left, walk forward, and stop.",
        "Turn right, walk forward, and stop.", "Move forward, clap, then stop.", "Crouch, walk forward, then stand up.", "Move forward, nod, then stop.",
    ),
)

LOCAL_PATHS = ("the dense path", "the marked route", "the indicated path")

T4 = (
    Block((rule(pt="path"),), ("Follow {pt}.", "Follow {pt} and stop.", "Follow {pt} to the end.", "Follow {pt} to the end and stop.", "Stay on {pt}.", "Stay on {pt} until the end.")),
    Block((rule(pt="path", lm="landmark"),), ("Follow {pt} and stop at {lm}.", "Follow {pt} until you reach {lm}, then stop.", "Stay on {pt} and stop near {lm}.", "Use {pt} to reach {lm}, then hold position.")),
    Block(
        (rule(condition=("<", "u", "v"), u="waypoint", v="waypoint"),),
        ("Move to {u}, then to {v}.", "Move to {u}, then to {v}, then stop.", "Navigate to {u}, then proceed to {v}.", "Reach {u}, continue to {v}, and hold.", "Go by way of {u}, then finish at {v}."),
    ),
    Block(
        (rule(condition=("distinct", "u", "v", "w"), u=BANKS["waypoint"][:6], v=BANKS["waypoint"][:6], w=BANKS["waypoint"][:6]),),
        ("Move to {u}, then to {v}, then to {w}.", "Go to {u}, then {v}, then {w}, and stop.", "Navigate through {u}, then {v}, and finish at {w}."),
    ),
    Block((rule(v="obstacle_verb", o="obstacle"),), ("{V} {o}.", "{V} {o} and continue.", "{V} {o}, then move forward.", "{V} {o} and stop after clearing it.")),
    Block((rule(v="obstacle_verb", pt="path"),), ("{V} the obstacle along {pt}.", "{V} the obstacle, return to {pt}, and continue.")),
    fixed(
        "Reach the end of the path and stop in a neutral stance.", "Stop at the marked position and face forward.", "Walk to the target position and crouch.", "Move forward until the waypoint and hold position.",
        "Follow the path and end at the goal pose.", "Proceed to the goal marker and freeze.", "Walk to the keyframe position and stop.", "Move to the target position and face the marker.",
        "Reach the goal and lower your body into a crouch.", "Move to the endpoint and stand upright.", "Move to the final marker and bow.", "Go to the indicated position and kneel.",
    ),
    Block((rule(pt=LOCAL_PATHS, w="waypoint"),), ("Follow {pt} to {w} and stop.", "Follow {pt}, pass {w}, and continue.", "Stay on {pt}, reach {w}, and hold position.")),
    Block((rule(pt=LOCAL_PATHS, lm="landmark"),), ("Follow {pt} and stop near {lm}.", "Use {pt} to approach {lm}, then stop.")),
    Block((rule(pt="path", w="waypoint", lm=BANKS["landmark"][:8]),), ("Follow {pt} to {w}, continue to {lm}, and stop.", "Stay on {pt}, pass {w}, and finish near {lm}.")),
)

T5 = (
    Block((rule(lm="landmark", v=("move", "walk", "go", "proceed", "advance")),), ("{V} to {lm}.", "{V} to {lm} and stop.", "{V} toward {lm}.", "{V} toward {lm} and wait.")),
    Block((rule(lm="landmark", d=LR),), ("Turn {d} at {lm}.", "When you reach {lm}, turn {d}.", "At {lm}, turn {d}.")),
    Block((rule(lm="landmark", v=("pass", "walk past", "move past", "go past")),), ("{V} {lm}.", "{V} {lm} and continue forward.", "{V} {lm} and stop.")),
    Block((rule(lm="landmark", v=("stop", "halt", "pause")),), ("{V} near {lm}.", "{V} at {lm}.", "{V} beside {lm}.", "{V} in front of {lm}.")),
    Block(
        (rule(condition=("<", "u", "v"), u="landmark", v="landmark"),),
        ("Pass {u} and stop near {v}.", "Turn left at {u} and walk to {v}.", "Turn right at {u} and walk to {v}.", "Move from {u} to {v} and stop."),
    ),
)

T6 = (
    Block((rule(c="safety_condition", act="safety_act"),), ("{C}, {act}.", "{C}, {act} before continuing.")),
    Block(
        (rule(v=("move", "walk", "proceed", "advance"), s=("slowly", "carefully", "cautiously", "steadily"), t="terrain"),),
        ("{V} {s} over {t}.", "{V} {s} across {t}.", "{V} {s} through {t}.", "{V} {s} near {t}."),
    ),
    fixed(
        "Inspect the obstacle before moving.", "Check the path before proceeding.", "Pause and assess before continuing.", "Wait for the path to be clear before moving.",
        "Inspect the surface before stepping forward.", "Check for obstacles, then proceed.", "Look ahead carefully, then move forward.", "Assess the terrain before advancing.",
        "Pause, inspect the passage, then continue.", "Verify the path is clear, then proceed.", "Inspect the floor before walking.", "Stop, check the area, then move slowly.",
    ),
    Block((rule(c="social_condition", act="social_act"),), ("{Act} {c}.", "When {c}, {act}.", "{Act} {c} and continue only when clear.")),
    fixed(
        "Wait until the path is clear, then move forward.", "Hold position until it is safe to proceed.", "Pause and wait for further instruction.", "Stop and wait if you encounter an obstacle.",
        "Reduce speed and wait near the person.", "Slow down and yield to the pedestrian.", "Halt and wait before entering the narrow passage.", "Stop if the terrain is unsafe.",
        "If uncertain, stop and hold position.", "Slow down approaching the uneven surface.", "Move carefully and stop if the floor is slippery.", "Reduce speed near the crowd and yield.",
    ),
)

T7 = (
    Block(
        (rule(condition=("distinct", "lm", "lm2"), lm="landmark", lm2="landmark"),),
        (
            "Exit the room, turn right, walk forward, and stop at {lm}.",
            "Walk forward, turn left, pass {lm}, and stop near {lm2}.",
            "Crouch under the bar, move forward, stand up, then stop at {lm}.",
            "Walk to {lm}, turn left, go through the corridor, and stop.",
            "Move forward, turn right, follow the corridor, and stop at {lm}.",
            "Step over the obstacle, move to {lm}, turn left, and stop.",
            "Turn around, walk forward, pass {lm}, then stop.",
            "Walk to {lm}, turn right, move forward, then stop near {lm2}.",
            "Go through the corridor, turn left, pass {lm}, and stop.",
            "Turn left, walk to {lm}, turn right, and stop.",
            "Exit the room, turn right, follow the corridor, pass {lm}, and stop at {lm2}.",
            "Walk forward, turn left, pass {lm}, enter the corridor, and stop.",
            "Crouch, move forward three steps, stand up, turn right, and stop at {lm}.",
            "Walk forward, duck under the bar, continue, turn right, and stop near {lm}.",
            "Move to {lm}, turn left, pass {lm2}, proceed through the gate, and stop.",
            "Go to {lm}, turn left, walk through the corridor, pass {lm2}, and stop.",
            "Walk forward, sidestep right, pass {lm}, turn left, and stop.",
            "Pass {lm}, turn left, walk through the passage, go to {lm2}, and stop.",
            "Exit the room, turn right, follow the corridor, pass the chair, proceed to {lm}, and stop.",
            "Walk forward, turn left, pass {lm}, enter the hallway, go to {lm2}, and stop near the wall.",
            "Crouch under the bar, move forward, stand up, turn right, walk to {lm}, and stop.",
            "Turn right, walk to {lm}, turn left, pass {lm2}, follow the corridor, and stop at the exit.",
            "Move forward, pass {lm}, turn left, walk through the gate, go to {lm2}, and halt.",
            "Enter the corridor, walk forward, turn right, pass {lm}, go to {lm2}, and stop.",
        ),
    ),
    fixed(
        "Exit the room, turn right, follow the corridor, pass the chair, and stop at the door.",
        "Walk forward, turn left at the marker, pass the table, enter the corridor, and stop near the wall.",
        "Move to the gate, turn right, follow the curved path, pass the cone, and stop at the exit.",
        "Crouch under the bar, move forward, stand up, turn right, walk to the door, and stop.",
        "Back up two steps, turn around, walk forward to the marker, turn left, pass the pillar, and stop.",
        "Walk forward, turn left, pass the table, enter the hallway, go to the gate, and stop.",
        "Move to waypoint A, turn right, pass the cone, go through the corridor, and stop at the wall.",
        "Exit through the door, turn right, follow the marked path, pass the barrier, and stop at the gate.",
        "Walk forward three steps, turn left, pass the chair, proceed to the window, and stop.",
        "Move to the ramp, go up slowly, proceed forward, turn right, and stop at the marker.",
    ),
)

GRAMMAR: dict[str, tuple[Block, ...]] = {"T1": T1, "T2": T2, "T3": T3, "T4": T4, "T5": T5, "T6": T6, "T7": T7}
