"""Vocabularies of the instruction corpus.

Fixed values: they define the corpus and the order in which rules and vocabularies are tried, so results
depend on every entry and, where rules pick the first match, on the order.
"""

from __future__ import annotations

# --- word banks -----------------------------------------------------------------------------------

BANKS: dict[str, tuple[str, ...]] = {
    "loco": ("walk", "move", "go", "step", "proceed", "advance", "march"),
    "turn": ("turn", "rotate", "pivot", "spin"),
    "posture": ("crouch", "kneel", "stand up", "rise", "lean forward", "lean back", "bow", "sit down", "straighten up", "lower your body", "raise your body", "squat", "duck", "bend down"),
    "gesture": (
        "wave", "point forward", "raise your right arm", "raise your left arm", "lower your right arm", "lower your left arm", "clap", "nod",
        "shrug", "cross your arms", "extend your right arm", "extend your left arm", "lift your right hand", "lift your left hand", "salute", "give a thumbs up",
    ),
    "stop": ("stop", "halt", "freeze", "pause", "hold position", "stand still"),
    "direction": ("forward", "backward", "left", "right", "to the left", "to the right", "ahead", "back", "diagonally left", "diagonally right"),
    "turn_direction": ("left", "right", "around", "back"),
    "turn_extent": ("slightly", "sharply", "a little", "halfway", "completely"),
    "speed": ("slowly", "carefully", "steadily", "quickly", "cautiously"),
    "count": ("one step", "two steps", "three steps", "four steps", "five steps", "half a metre", "one metre", "two metres", "three metres"),
    "body_side": ("your left arm", "your right arm", "your left hand", "your right hand", "your left leg", "your right leg"),
    "landmark": (
        "the door", "the gate", "the marker", "the wall", "the corridor", "the table", "the chair", "the ramp", "the cone", "the barrier",
        "the pillar", "the window", "the shelf", "the entrance", "the exit", "the desk", "the cabinet", "the sofa", "the bench", "the post",
    ),
    "path": ("the straight path", "the curved path", "the zigzag path", "the marked route", "the narrow passage", "the designated path", "the indicated route", "the clear path"),
    "waypoint": ("waypoint A", "waypoint B", "waypoint C", "waypoint D", "the first marker", "the second marker", "the third marker", "the checkpoint", "the target point", "the goal position"),
    "obstacle": ("the low bar", "the gap", "the puddle", "the step", "the obstacle", "the barrier", "the debris", "the box", "the pole", "the cable", "the raised platform"),
    "obstacle_verb": ("duck under", "step over", "go around", "move past", "climb over", "squeeze through", "navigate around"),
    "safety_condition": (
        "if the path is blocked", "if it is unsafe", "if you detect an obstacle", "when the path is clear", "before crossing", "if uncertain", "if the floor is wet",
        "if there is a person nearby", "if the surface is uneven", "when visibility is low", "if the passage is narrow", "before proceeding", "if the way is obstructed",
    ),
    "safety_act": (
        "stop and wait", "stop immediately", "slow down", "inspect first", "retreat one step", "proceed carefully",
        "wait for clearance", "halt and assess", "pause and look around", "back up and reassess", "reduce speed", "stand still",
    ),
    "social_condition": ("near a person", "when a person approaches", "when someone is in the way", "if a person is nearby", "when passing a person"),
    "social_act": ("yield", "slow down", "keep your distance", "pause and wait", "move to the side", "stop briefly", "step aside", "give way"),
    "terrain": ("the wet floor", "the uneven surface", "the loose gravel", "the slippery tiles", "the rough ground", "the narrow ramp", "the steep incline", "the unstable surface"),
}

# --- tiers: target, candidate quota, review rate, focus of quality control, seconds, subtier --------

TIERS: dict[str, tuple[int, int, float, str, float, str]] = {
    "T1": (2400, 2500, 0.12, "lexical clarity, semantic uniqueness", 3.0, "atomic_primitive"),
    "T2": (1600, 1700, 0.12, "parameter preservation, modifier consistency", 3.5, "parameterized_atomic"),
    "T3": (2000, 2150, 0.22, "action order, temporal coherence", 5.0, "short_composite"),
    "T4": (1400, 1500, 0.22, "constraint compliance, path fidelity", 6.5, "constraint_conditioned"),
    "T5": (1200, 1350, 0.35, "landmark grounding, reference clarity", 5.5, "landmark_navigation"),
    "T6": (800, 900, 0.35, "safety semantics, abstention fidelity", 6.5, "safety_abstention_social"),
    "T7": (600, 750, 0.35, "long-range consistency, subgoal completion", 9.0, "long_horizon_multistep"),
}
UNKNOWN_SUBTIER = "unclassified"

# --- languages and checks --------------------------------------------------------------------------

#: code -> name, code of the translation model
LANGUAGES: dict[str, tuple[str, str]] = {"hi": ("Hindi", "hin_Deva"), "bn": ("Bengali", "ben_Beng"), "te": ("Telugu", "tel_Telu")}
SOURCE_CODE = "eng_Latn"
CHECKS = ("action_preservation", "order_preservation", "direction_preservation", "safety_preservation")
MODEL_TOKENS = ("<s>", "</s>", "<pad>", "<unk>")
NEXT_STEPS = (
    "Fill literal and robot-natural translations for Hindi, Bengali, and Telugu.",
    "Run bilingual review for action, order, direction, and safety preservation.",
    "Adjudicate disagreements on overlapping subsets.",
    "Merge approved translations back into the release corpus.",
)

# --- tags and landmarks ----------------------------------------------------------------------------

PRIMITIVES: dict[str, tuple[str, ...]] = {
    "follow_path": ("follow", "path", "route", "corridor"),
    "turn_left": ("turn left", "rotate left", "pivot left", "face left"),
    "turn_right": ("turn right", "rotate right", "pivot right", "face right"),
    "turn_around": ("turn around", "rotate around", "pivot around"),
    "move_forward": ("move forward", "walk forward", "step forward", "go forward", "ahead"),
    "move_backward": ("move backward", "walk backward", "step back", "back up"),
    "sidestep": ("sidestep", "step left", "step right"),
    "stop": ("stop", "halt", "freeze", "pause", "hold position", "stand still"),
    "crouch": ("crouch", "duck", "lower your body"),
    "kneel": ("kneel",),
    "rise": ("rise", "stand up", "straighten up", "raise your body"),
    "bow": ("bow", "lean forward"),
    "wave": ("wave",),
    "clap": ("clap",),
    "nod": ("nod",),
    "salute": ("salute",),
    "yield": ("yield", "give way", "move to the side", "step aside"),
    "inspect": ("inspect", "assess", "check", "look ahead"),
}
UNKNOWN_PRIMITIVE = "unclassified_motion"
#: Looked for behind "the ", where an instruction has no landmarks of its own.
LANDMARK_NOUNS = tuple(x.removeprefix("the ") for x in BANKS["landmark"])

# --- phrases that a back-translation must keep ------------------------------------------------------

ACTIONS = (
    "walk", "move", "go", "step", "proceed", "advance", "turn", "rotate", "pivot", "spin", "stop", "halt", "freeze", "pause", "hold", "crouch", "kneel", "stand up", "rise",
    "lean", "bow", "sit down", "duck", "bend", "wave", "point", "raise", "lower", "clap", "nod", "salute", "follow", "pass", "yield", "inspect", "wait", "slow down", "retreat",
)
DIRECTIONS = ("left", "right", "forward", "backward", "ahead", "back", "around", "through", "over", "under", "toward", "towards", "away", "near", "beside", "in front of")
SAFETY = (
    "safe", "unsafe", "stop", "wait", "yield", "inspect", "carefully", "cautiously", "slowly", "slow down",
    "if", "when", "uncertain", "obstacle", "blocked", "clear", "person", "pedestrian", "distance",
)
#: Replaced in this order before phrases are looked for.
MATCH_REWRITES = (("towards", "toward"), ("right away", ""), ("immediately", ""), ("promptly", ""), ("straight away", ""), ("at once", ""), ("directly", ""), ("robot natural", ""))

# --- plain wording: dropped in front, dropped at the end, rewritten; each once, in order -----------

LEADING = ("Immediately", "At once,", "Just")
TRAILING = ("for now", "straight away", "promptly", "directly", "now", "immediately", "right away", "at once", "in place", "here", "without delay", "where you are", "precisely", "with control")
#: (phrase, only at the beginning, replacement)
REWRITES = (
    ("Walk", True, "Move"), ("Go", True, "Move"), ("Proceed", True, "Move"), ("Advance", True, "Move"), ("March", True, "Move"),
    ("go to", False, "move to"), ("go toward", False, "move toward"), ("continue to", False, "move to"), ("turn back", False, "turn around"),
)

# --- classifiers: the first rule with a word that the lower-cased instruction holds decides ---------

MOTION_FAMILY = (
    ("posture_transition", ("crouch", "kneel", "bow", "lean", "rise", "stand", "squat")),
    ("obstacle_negotiation", ("duck under", "step over", "go around", "move past", "obstacle", "bar")),
    ("path_following", ("follow", "path", "waypoint", "route")),
    ("landmark_conditioned", ("door", "gate", "marker", "wall", "corridor", "table", "chair")),
    ("social_gesture", ("wave", "point", "clap", "nod", "shrug", "salute", "thumbs up")),
    ("safety_intervention", ("if", "when", "slow", "carefully", "inspect", "wait", "yield", "blocked")),
)
CONSTRAINT = (
    ("waypoint", ("waypoint",)),
    ("dense_path", ("path", "route")),
    ("keyframe", ("keyframe", "pose")),
    ("obstacle", ("bar", "gap", "obstacle", "barrier", "debris", "pole", "cable")),
    ("end_pose", ("stop at", "end at", "halt at")),
)
GESTURE_WORDS = ("wave", "clap", "nod", "salute", "arm", "hand")
TURN_WORDS = ("turn", "rotate", "pivot", "spin")
TRAVEL_WORDS = ("walk", "move", "go", "step", "follow", "pass")
POSE_WORDS = ("crouch", "kneel", "stand", "rise", "bow", "lean", "squat", "sit down")
JOINING_WORDS = ("and", "then", ",")
RISKY_TIERS = ("T6", "T7")
RISKY_WORDS = ("obstacle", "bar", "gap", "keyframe", "pose", "corridor", "ramp")
TERRAIN_DEPENDENCE = (
    ("scene_dependent", ("wet floor", "uneven surface", "loose gravel", "slippery tiles", "rough ground", "narrow ramp", "steep incline", "unstable surface", "corridor", "gate", "door", "marker", "wall", "path", "route")),
    ("mild_obstacle", ("obstacle", "bar", "gap", "barrier", "debris", "pole", "cable")),
    ("flat_only", ("forward", "backward", "left", "right")),
)
HIGH_CONTACT = ("step over", "duck under", "climb over", "squeeze through")
MEDIUM_CONTACT_TIERS = ("T4", "T5", "T6")
MEDIUM_CONTACT = ("crouch", "kneel", "bow", "turn", "sidestep")
STRUCTURE = {"T1": "single_action", "T2": "single_action_with_modifier", "T4": "constraint_conditioned", "T5": "landmark_grounded", "T6": "safety_or_social"}
LONG_STRUCTURE = "long_horizon_sequence"
AMBIGUITY = (
    ("relative_spatial_or_extent", ("near ", "beside ", "slightly", "a little")),
    ("condition_dependent", ("if uncertain", "when the path is clear", "if it is unsafe")),
)
SCENE_WORDS = ("door", "gate", "marker", "wall", "corridor", "table", "chair", "path", "route", "waypoint", "bar", "gap", "ramp", "cone", "barrier", "surface", "floor", "person")
BODY_WORDS = ("arm", "hand", "leg", "body", "chin", "shoulders", "stance")
POSTPROCESS_TIERS = ("T4", "T6", "T7")
TARGET_BODY, TARGET_FPS = "g1", 30
ID_FORMAT = "kimodo_%06d"
#: Record field of the motion validator's results, and of the protocol that says it has run.
VALIDATOR, VALIDATION_COMPLETE = "kimodo", "kimodo_validation_complete"
