"""Golden values and properties of the text functions and rules."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as X
from corpusloom.functions import verify as VF
from corpusloom.functions import vocab as V


def values(spark, texts, **columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("low", F.lower("t"))
    rows = df.orderBy("i").select(*(c.alias(n) for n, c in columns.items())).collect()
    return [r[0] if len(columns) == 1 else r for r in rows]


ROBOT = {
    "Walk forward now.": "Move forward.",
    "At once, turn back.": "Turn around.",
    "March in place.": "Move.",
    "If it is unsafe, stop immediately.": "If it is unsafe, stop.",
    "Reach waypoint A, continue to waypoint B, and hold.": "Reach waypoint A, move to waypoint B, and hold.",
    "Turn left, walk forward, and stop.": "Turn left, walk forward, and stop.",
    "Stop immediately for now.": "Stop.",
    "Stop for now immediately.": "Stop for now.",
    "": ".",
}


def test_robot_natural(spark):
    assert values(spark, [*ROBOT, None], v=X.robot_natural("t")) == [*ROBOT.values(), None]


def test_spaces_and_case(spark):
    texts = [" a\t b  c\x1cd ", "", None, "Straße İ"]
    assert values(spark, texts, v=X.normalize_space("t")) == ["a b c d", "", None, "Straße İ"]
    assert values(spark, texts, v=X.normalize_space(X.normalize_space("t"))) == ["a b c d", "", None, "Straße İ"]
    assert values(spark, ["Straße"], v=X.casefold("t")) == ["strasse"]
    assert values(spark, ["turn LEFT", "", "ß"], v=X.sentence_case("t")) == ["Turn LEFT", "", "SS"]
    assert values(spark, ["a..", "a", ""], v=X.strip_period("t")) == ["a.", "a", ""]


def test_matching_text(spark):
    assert values(spark, ["Go towards it right away."], v=X.normalize_for_match("t")) == ["go toward it ."]
    assert values(spark, ["<s> hin_Deva  a hin Deva </s>"], v=X.sanitize_decoded("t", "hin_Deva")) == ["a"]
    assert values(spark, ["aaaa, a, b"], n=X.count_of("t", "aa")) == [2]


CLASSES = [("T1", "Shift your weight.", "safety_intervention"), ("T4", "Go around the barrier.", "obstacle_negotiation"), ("T7", "Brace.", "long_horizon_mixed"), ("T1", "Brace.", "basic_locomotion")]


@pytest.mark.parametrize("tier,text,family", CLASSES)
def test_motion_family(spark, tier, text, family):
    assert values(spark, [text], v=R.motion_family(F.lit(tier), F.col("low"))) == [family]


def test_barrier(spark):
    low, tier = F.col("low"), F.lit("T4")
    got = values(spark, ["Go around the barrier."], a=R.constraint_type(low), b=R.robot_feasibility(tier, low), c=R.terrain_dependence(low), d=R.contact_complexity(tier, low), e=R.constraint_payload(low))[0]
    assert tuple(got)[:4] == ("obstacle", "needs_review", "mild_obstacle", "medium")
    assert got.e.asDict() == {"path_type": None, "waypoints": None, "obstacles": ["the barrier"], "landmarks": ["the barrier"]}
    assert values(spark, ["Go around the barrier.", "Brace."], v=R.payload_json(low)) == ['{"obstacles":["the barrier"],"landmarks":["the barrier"]}', None]


def test_payload_matches_inside_words(spark):
    got = values(spark, ["Move forward until the waypoint and hold position."], v=R.constraint_payload(F.col("low")))[0]
    assert got.waypoints == ["waypoint A"]


def test_structure_tags_split(spark):
    assert values(spark, ["Walk forward, and after that turn left."], v=R.compositional_structure(F.lit("T3"), F.col("low"))) == ["2_step_sequence"]
    assert values(spark, ["Walk to the checkpoint.", "Xyz."], v=R.primitive_tags(X.casefold("t"))) == [["inspect"], [V.UNKNOWN_PRIMITIVE]]
    assert [r[0] for r in spark.createDataFrame([(i,) for i in (0, 1, 2, 10, 11)], "n long").select(R.split_of(F.col("n"))).collect()] == ["dev", "test", "train", "dev", "test"]


def test_unknown_tier_is_an_error(spark):
    with pytest.raises(Exception, match="unknown tier"):
        values(spark, ["x"], v=R.tier_value(F.lit("T9"), 0, "int"))


VERIFY = [
    ("Turn left, walk forward, and stop.", "Turn left, walk forward, and stop.", (True, False, True, True)),
    ("Turn left.", "Turn left.", (True, True, True, True)),
    ("Walk backward.", "Walk backward.", (True, True, True, True)),
    ("Lift your chin.", "Raise your chin.", (True, True, True, False)),
    ("Brace.", "", (True, True, True, True)),
]


@pytest.mark.parametrize("source,back,expected", VERIFY)
def test_verification(spark, source, back, expected):
    df = VF.normalized(spark.createDataFrame([(source, back)], "a string, b string"), a=F.col("a"), b=F.col("b"))
    got = df.select(VF.verification(F.col("a"), F.col("a"), F.col("b"), F.col("b"))).first()[0]
    assert tuple(got) == expected


def test_source_order_accepts_the_source(spark):
    df = VF.normalized(spark.createDataFrame([("Turn left, walk forward, and stop.",)], "a string"), a=F.col("a"))
    assert df.select(VF.keeps_source_order(F.col("a"), F.col("a"), V.ACTIONS + V.DIRECTIONS)).first()[0]


def test_single_capitals(spark):
    texts = ["ßa", "ᾀx", "ﬁn", "éa", "ƛq", "", None, "aß"]
    assert values(spark, texts, v=X.sentence_case("t", single=True)) == ["ẞa", "ᾈx", "ﬁn", "Éa", "ƛq", "", None, "Aß"]


def test_slots_in_slots(spark):
    got = values(spark, ["a{b}", "{a}", None], v=X.fill_template(F.lit("{a} / {b}."), a=F.col("t"), b=F.concat(F.lit("x"), "t")))
    assert got == ["a{b} / xa{b}.", "{a} / x{a}.", None]


def test_runs_of_spaces(spark):
    spaces = ["a b", " a b ", "a  b", "a \tb", "a\t b", "　a\x1c \x85b\xa0", "a\nb", "  ", " \t ", ""]
    assert values(spark, spaces, v=X.normalize_space("t")) == [" ".join(t.split()) for t in spaces]


def test_a_text_is_worked_out_once_for_all_phrases(spark):
    df = spark.createDataFrame([("Turn left and stop",)], "t string").select(VF.phrases_in(X.normalize_for_match("t"), V.ACTIONS).alias("v"))
    assert df.first().v == ["turn", "stop"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan.split("filter(", 1)[1]


def test_cleaning_in_a_task_is_the_columns(spark):
    texts = ["<s> hin_Deva  a hin Deva </s>", "[hin] \t x\x1c\x85y\u3000", "", " <pad>", "a<unk>b eng_Latn", "no mark", "hin\nDeva", "<<s>s>"]
    for target in ("hin_Deva", V.SOURCE_CODE):
        assert values(spark, texts, v=X.sanitize_decoded("t", target)) == [X.sanitized_text(t, target) for t in texts]


def test_plain_letters_tell_which_texts_are_searched(spark):
    texts = ["Then CONTINUE TO B.", "Then cont\u0131nue to B.", "Then go  to B.", "Ergo toward B.", "So turn back.", "x" * 300 + " go to B."]
    assert values(spark, texts, v=X.robot_natural("t")) == ["Then move to B.", "Then move to B.", "Then go to B.", "Ergo toward B.", "So turn around.", "X" + "x" * 299 + " move to B."]
    one = spark.createDataFrame([(t,) for t in ("Go right away", "towards  it", "at  once", "directly", "plain")], "t string").select("t", X.normalize_for_match("t").alias("v"))
    assert dict(one.collect()) == {"Go right away": "go", "towards  it": "toward it", "at  once": "", "directly": "", "plain": "plain"}


def test_model_output_is_not_searched_by_patterns(spark):
    """Four texts a job went through a pattern for cleaning and two for matching."""
    from corpusloom.streaming import translate as M

    todo = spark.createDataFrame([("p", "hi", "Walk \n on", "Walk on."), ("q", "te", None, None)], "prompt_id string, code string, canonical string, natural string")
    made = M.translate(todo, M.EchoTranslator)
    got = {r.prompt_id: r for r in made.collect()}
    assert (got["p"].literal, got["q"].literal, got["p"].translation_notes[2]) == ("[hin] Walk on", None, "Literal back-translation: Walk on")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 0


def test_checks_in_a_task_are_the_columns(spark):
    texts = ["Walk forward, then turn left at once and stop.", "Turn İeft; go straight away towards the ßafe door", "STOP if uncertain. \u212aneel.", "", "slow  down \t behind", "left wait walk", "turn left walk forward"]
    pairs = [(a, b) for a in texts for b in texts]
    df = VF.normalized(spark.createDataFrame(pairs, "a string, b string"), x=F.col("a"), y=F.col("b"))
    for source_order in (False, True):
        want = [tuple(r.v) for r in df.select(VF.verification(F.col("x"), F.col("x"), F.col("y"), F.col("y"), source_order=source_order).alias("v")).collect()]
        assert want == [VF.checked(X.match_text(a), X.match_text(b), source_order=source_order) for a, b in pairs]
