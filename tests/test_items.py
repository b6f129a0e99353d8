"""Items: tags by context, attributes, review flags and the hierarchy on small cases."""

import pytest

from orderloom.functions.corrections import Rule, corrected, extreme_values, owners
from orderloom.functions.text import normalize
from orderloom.operators import documents, items
from pyspark.sql import functions as F


def read(spark, rows):
    frame = spark.createDataFrame(rows, "k int, raw string, details array<string>, section string, parts boolean, tags string")
    got = items.read_items(frame, "raw", "details", section="section", parts_only="parts")
    return {r.k: (r.tags, r.attributes) for r in got.collect()}


def test_tags_depend_on_context(spark):
    got = read(
        spark,
        [
            (1, "Outlet damper with actuator", ["Product: Actuator"], None, None, "old"),
            (2, "A. see the customer's sheet", [], "Additional Features", None, None),
            (3, "Construction, 304SS", [], None, True, None),
            (4, None, None, None, None, None),
            (5, "", [None, "  "], None, False, None),
            (6, "Construction, 304SS", [], None, True, None),
            (7, "Fan, wheel and accessory weights for fan drawings", ["fan, accessory, motor, total weight"], None, None, None),
        ],
    )
    assert got[1][0] == ["ACTUATOR", "DAMPER"]
    assert got[2][0] == ["ADDITIONAL FEATURES / NOTES"]
    assert "PARTS-ONLY ORDER" in got[3][0] and got[3] == got[6]
    assert got[4] == got[5] == ([], {})
    assert got[7][0] == ["FAN DRAWING WEIGHTS"]


def test_facts_of_components(spark):
    rows = [
        (1, "Explosion proof motor, Class I, Class II, Group C, D, Div. 1, Div 2", [], None, None, None),
        (2, "Trash screen for discharge of weather hood", None, None, None, None),
        (3, "Fan, class I div 1", [], None, None, None),
        (4, "Circular inlet silencer with inlet and outlet transitions", ["Autocad and PDF drawings"], None, None, None),
        (5, "Silencer", ["for discharge", "99VCIB V99 SN12 unit"], None, None, None),
        (6, "Weld conduit box to housing, conduit box hugging", [], None, None, None),
        (7, "Screen", ["for silencer"], None, None, None),
        (8, "Access door for inlet volume control", [], None, None, None),
        (9, "Bearing adder", ["12, 345 hours", "1 1/2 in. bore"], None, None, None),
        (10, "Insulation 3", ["thermal"], None, None, None),
    ]
    got = {k: a for k, (_, a) in read(spark, rows).items()}
    assert got[1]["motor_explosion_class"] == "I, II" and got[1]["motor_explosion_groups"] == "C, D" and got[1]["motor_explosion_division"] == "1, 2"
    assert got[2]["screen_subcategory"] == "TRASH SCREEN, RAINHOOD SCREEN" and got[2]["used_on"] == "WEATHER COVER, OUTLET"
    assert got[3]["motor_enclosure"] == "EXPLOSION PROOF" and got[3]["motor_explosion_division"] == "1"
    assert (got[4]["component"], got[4]["silencer_type"], got[4]["drawing_requirement"]) == ("INLET SILENCER", "CIRCULAR INLET SILENCER", "PDF, AUTOCAD") and "used_on" not in got[4]
    assert (got[5]["component"], got[5]["model"]) == ("OUTLET SILENCER", "99VCIB-V99-SN12")
    assert got[6]["motor_conduit_box_location"] == "HUGGING HOUSING" and got[6]["component"] == "MOTOR"
    assert got[7]["component"] == "SILENCER" and "used_on" not in got[7] and "screen_subcategory" not in got[7]  # a silencer that is named owns the line
    assert got[8].get("component") is None and got[8]["used_on"] == "IVC"
    assert (got[9]["bearing_life_hours"], got[9]["bearing_bore"], got[9]["bearing_life_adder"]) == ("12,345", '1-1/2"', "YES")
    assert (got[10]["insulation_type"], got[10]["insulation_thickness"]) == ("THERMAL", "3")


def test_rules_apply_in_order_and_stop(spark):
    table = [Rule(has=("A",), drop=("B",), add=("C",)), Rule(some=("C", "X"), lacks=("B",), add=("D",)), Rule(F.col("n") == 1, add=("ONLY",), alone=True), Rule(add=("LATE",)), Rule(F.lit(None).cast("boolean"), add=("NULL",))]
    frame = spark.createDataFrame([(0, ["A", "B"]), (1, ["A"]), (2, [])], "n int, t array<string>")
    got = {r.n: r.x for r in frame.select("n", corrected(F.col("t"), table).alias("x")).collect()}
    assert got == {0: ["A", "C", "D", "LATE"], 1: ["ONLY"], 2: ["LATE"]}


@pytest.mark.parametrize(
    "text, want",
    [
        ("PRESPIN AND FRESH AIR DAMPER ACTUATORS", ["PRESPIN DAMPER", "FRESH AIR DAMPER"]),
        ("FRESH AIR AND PRESPIN DAMPER ACTUATOR", ["FRESH AIR DAMPER", "PRESPIN DAMPER"]),
        ("ACTUATOR FOR IVC AND OUTLET DAMPER", ["IVC", "OUTLET DAMPER"]),
        ("INLET DAMPER", ["INLET DAMPER"]),
        ("INLET FLANGED WITH IVC", []),
        ("OUTLET DAMPER WITHOUT IVC", []),
        ("", []),
    ],
)
def test_owners(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(owners(F.col("t")).alias("o")).first().o == want


@pytest.mark.parametrize("text, want", [("RATED 150 F", ["150F"]), ("150 F FRAME", []), ("FROM -40 C TO 60 C", ["60C", "-40C"]), ("100 F AMBIENT", []), ("200F", []), ("200°F", ["200F"]), ("", [])])
def test_temperatures_need_a_context(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(extreme_values(F.col("t")).alias("o")).first().o
    assert sorted(got) == sorted(want)


def test_texts_without_abbreviations_are_normalized_alike(spark):
    rows = [("plain  words\there",), ("W/ motor, SS",), ("(304SS) nan c/w",), ("  ",), (None,), ("a W/O b TEMP.",), ("glass ssx stlx",)]
    got = [r.n for r in spark.createDataFrame(rows, "t string").select(normalize(F.col("t")).alias("n")).collect()]
    assert got == ["PLAIN WORDS HERE", "WITH MOTOR STAINLESS STEEL", "304 STAINLESS STEEL COMPLETE WITH", "", "", "A WITHOUT B TEMPERATURE", "GLASS SSX STLX"]


def test_details_that_add_nothing_are_flagged(spark):
    frame = spark.createDataFrame([(1, "Inlet volume control", ["Actuator: by others", "blah", "blah", "Vendor: x"]), (2, "Something", None), (3, None, [None, "zz"])], "k int, raw string, d array<string>")
    got = {r.k: r.flags for r in items.review_flags(frame, "k", "raw", "d").collect()}
    assert got == {1: ["UNCLASSIFIED DETAIL: blah"], 2: ["UNTAGGED"], 3: ["UNTAGGED", "UNCLASSIFIED DETAIL: zz"]}
    assert items.review_flags(frame.limit(0), "k", "raw", "d").count() == 0


def test_hierarchy(spark):
    rows = [
        (1, 1, "motor a", 5.0, {"component": "MOTOR", "hp": "5", "motor_feature": "TEFC"}),
        (1, 2, "motor b", 9.0, {"component": "motor", "hp": "7", "motor_feature": "TEFC, XP", "hp_review": "x"}),
        (1, 3, "actuator", 4.0, {"component": "ACTUATOR", "used_on": "IVC | OUTLET DAMPER", "model": "R"}),
        (1, 4, "same text", 1.0, {}),
        (1, 5, "same text", None, None),
        (2, 1, "motor c", 5.0, {"component": "MOTOR", "hp": ""}),
    ]
    frame = spark.createDataFrame(rows, "job int, place int, text string, price double, said map<string,string>")
    got = {(r.job, r.parent, r.name, r.place): r for r in items.hierarchy(frame, "job", "place", "text", "price", "said").collect()}
    assert len(got) == 6
    motor = got[1, "", "MOTOR", 1]
    assert (motor.price, motor.primary, motor.members, motor.conflicts) == (14.0, "motor b", 2, ["hp"])
    assert motor.attributes == {"hp": "7 | 5", "motor_feature": "TEFC, XP"}
    assert got[1, "IVC", "ACTUATOR", 3].price == 4.0 and got[1, "OUTLET DAMPER", "ACTUATOR", 3].price == 0.0
    assert not got[1, "", "same text", 4].keyed and got[1, "", "same text", 5].price == 0.0
    assert got[2, "", "MOTOR", 1].attributes == {}
    assert items.hierarchy(frame.limit(0), "job", "place", "text", "price", "said").count() == 0


def test_context_of_the_whole_order(spark):
    """A head below the item counts as well; an order's context does not reach another's; documents without items give none."""
    lines = [(1, 0, "Sales Order"), (1, 1, "1. Extended lube lines L 12.00"), (1, 2, "Arrangement A/4"), (2, 0, "ARRANGEMENT: 8"), (2, 1, "1. Extended lube lines L 12.00"), (2, 2, "arrangement 4"), (3, 0, "1. Extended lube lines L 12.00"), (3, 1, None), (4, 0, "arrangement 9")]
    got = {r.doc: (r.arrangement, r.parts_only, list(r.tags)) for r in documents.order_items(spark.createDataFrame(lines, "doc int, pos int, line string"), "doc", "pos", "line").collect()}
    assert got == {1: ("A/4", False, ["MOTOR"]), 2: ("8", False, ["BEARINGS"]), 3: ("", False, ["BEARINGS", "MOTOR"])}


def test_items_are_not_sent_to_all_tasks(spark):
    """Flags depend on texts alone: texts of many items are read once, and only they may be broadcast."""
    frame = spark.range(30_000).select("id", F.lit("Motor, 5 HP").alias("raw"), F.array(F.lit("blah"), F.concat(F.lit("x"), (F.col("id") % 3).cast("string"))).alias("d"))
    got = items.review_flags(frame, "id", "raw", "d")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftOuter, BuildRight" in plan and plan.count("Range (0, 30000") == 1
    assert got.groupBy("flags").count().count() == 3 and got.count() == 30_000
