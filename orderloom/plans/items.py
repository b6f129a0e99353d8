"""Queries on items of order documents, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.operators import items
from orderloom.sources.tables import table

#: lines of orders that a task takes
LINES = 2**17
# lines of documents with their details, the tags and the attributes that they must get; parts stand in for the items that print them
CASES = [
    ("Base Fan with motor, mounted", [], "BASE FAN", ""),
    ("Motor, 5 HP, explosion proof", ["C-flange"], "MOTOR", "component=MOTOR; motor_enclosure=EXPLOSION PROOF; motor_mounting=C-FLANGE"),
    ("Inlet, Flanged, Punched (with IVC)", [], "FLANGE,INLET", ""),
    ("Inlet Volume Control, Low Leak", ["Actuator: by others"], "ACTUATOR,DAMPER,INLET VANES,LOW LEAKAGE", "leakage_class=LOW LEAKAGE; used_on=IVC"),
    ("Outlet Damper with actuator", [], "ACTUATOR,DAMPER", "used_on=OUTLET DAMPER"),
    ("Housing drain", [], "DRAIN", "component=HOUSING DRAIN; size=STD"),
    ("Weather cover painted yellow", [], "WEATHER COVER", "component=WEATHER COVER; weather_cover_type=WEATHER COVER"),
    ("Belt guard, painted, motor end", [], "BELT GUARD", "component=BELT GUARD; tach_hole_location=MOTOR END"),
    ("Paint wheel with epoxy", [], "COATING", ""),
    ("Assembly of wheel by others", [], "MISC NOTE", ""),
    ("Motor 316SS hardware", [], "MOTOR", "component=MOTOR; component_material=STAINLESS STEEL; component_material_grade=316 SS"),
    ("Housing 304SS", [], "HOUSING,MATERIALS,STAINLESS STEEL", "material=STAINLESS STEEL; material_grade=304 SS"),
    ("Extended lube lines", [], "BEARINGS,MOTOR", "component_review=UNCLEAR GREASE TARGET - VERIFY MOTOR/BEARINGS/ARRANGEMENT; extended_grease_fittings=YES"),
    ("Grease fittings for motor bearings", [], "MOTOR", "component=MOTOR; extended_grease_fittings=YES"),
    ("Fan suitable for operation to 150 F", [], "EXTREME TEMP", "temperature_rating=150F; temperature_service=HIGH TEMPERATURE"),
    ("Silencer, zinc coated", [], "SILENCER", "component=SILENCER"),
    ("Split housing, wheel inside", [], "SPLIT HOUSING,WHEEL", "component=SPLIT HOUSING"),
    ("Flex connector with flange", ["Flow liner"], "FLEX CONNECTOR", "component=FLEX CONNECTOR; feature=FLOW LINER; flex_connector_type=FLEX CONNECTOR"),
    ("Non-wheel end bearing support", [], "HOUSING", ""),
    ("Customer assumes responsibility for the motor", [], "MISC NOTE", ""),
    ("Warranty 24 months from shipment, motor", [], "WARRANTY", "note_type=WARRANTY; warranty_duration=24 MONTHS; warranty_scope=MOTOR"),
    ("V-belt drive, motor sheave", [], "DRIVE COMPONENTS", "component=DRIVE COMPONENTS; drive_subcategory=V-BELT DRIVE"),
    ("Isolated bearings, rubber in shear", [], "", ""),
    ("Mixing box, inlet open", [], "MIXING BOX", "component=MIXING BOX"),
    ("Liner on blades and scroll", [], "HOUSING,LINING,WHEEL", "lining_scope=HOUSING SCROLL, WHEEL BLADES"),
    ("Changed ship via UPS ground, damper", [], "SHIPPING", "shipping_instruction=SHIP VIA; shipping_method=UPS GROUND"),
    ("Something else", [], "", ""),
    ("Mechanical run test, customer witness, 4 hour", [], "TESTING", "component=MECHANICAL RUN TEST; testing_duration=4 HOUR; witnessed=CUSTOMER"),
    ("Square housing, flange thickness", [], "FLANGE,HOUSING", "housing_feature=FLANGE THICKNESS; housing_subcategory=SQUARE, MODIFIED FLANGE"),
    ("Final inspection report", [], "INSPECTION", "component=INSPECTION; inspection_subcategory=FINAL INSPECTION REPORT"),
    ("Wheel with 90% effective diameter", [], "SPECIAL CONSTRUCTION,WHEEL", "component=WHEEL; wheel_effective_diameter_percent=90; wheel_feature=EFFECTIVE DIAMETER"),
    ("Taperlock bushing, 1 7/8 bore", [], "WHEEL", 'bearing_bore=1-7/8"; component=WHEEL; wheel_bore=1-7/8"; wheel_feature=TAPER LOCK BUSHING; wheel_hub_construction=TAPER LOCK BUSHING'),
    ("6 inch channel base", [], "UNITARY BASE", 'component=UNITARY BASE; unitary_base_size=6"; unitary_base_type=CHANNEL BASE'),
    ("Shipping label required", [], "LABEL,SHIPPING", "label_scope=SHIPPING; label_type=SHIPPING LABEL"),
    ("Vibration base, spring isolators, 1 inch deflection", [], "VIBRATION ISOLATION", 'component=VIBRATION ISOLATION; isolation_deflection=1"; vibration_isolation_type=VIBRATION BASE, SPRING ISOLATOR'),
    ("Flexible coupling, Rexnord Thomas series 52, size 202", [], "COUPLING", "component=COUPLING; coupling_subcategory=FLEXIBLE COUPLING; coupling_type=REXNORD THOMAS SERIES 52; manufacturer=REXNORD; size=202"),
    ("Low temperature fan to -40 F", [], "EXTREME TEMP", "temperature_rating=-40F; temperature_service=LOW TEMPERATURE"),
    ("Discharge evase, flanged, with drain", [], "DRAIN,EVASE,FLANGE", "component=EVASE; evase_feature=DRAIN, FLANGED; size=STD"),
    ("Motor, VFD by others, inverter duty", [], "MOTOR,VFD", "component=MOTOR; motor_vfd_suitability=INVERTER DUTY; vfd_context=MOTOR; vfd_supplied_by=OTHERS"),
]


def part_items(spark, sf):
    """An item for each part: the line, with number, type and price, and its details."""
    cases = F.array(*(F.struct(F.lit(line).alias("line"), F.array(*map(F.lit, d)).cast("array<string>").alias("details")) for line, d, _, _ in CASES))
    p = table(spark, sf, "part").withColumn("case", F.get(cases, (F.col("p_partkey") % len(CASES)).cast("int")))
    return p.select("p_partkey", "p_size", F.concat_ws("", F.col("p_size").cast("string"), F.lit(". "), F.col("case.line"), F.lit(" L 1,250.00")).alias("raw"), "case.details")


def composed_facts(spark, sf):
    """Lines and details put together from the columns of each part, nine kinds of component, read for what they say."""
    p = table(spark, sf, "part").withColumns({"n": F.col("p_size").cast("string"), "q": F.floor("p_retailprice").cast("string"), "hour": (F.col("p_size") % 12 + 1).cast("string")})
    odd, third = F.col("p_size") % 2 == 1, F.col("p_size") % 3 == 0
    text = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    n, q, hour = F.col("n"), F.col("q"), F.col("hour")
    kinds = [
        (text("Explosion proof motor, Class I, Group ", F.substring(F.lit("ABCD"), F.col("p_size") % 4 + 1, F.lit(1)), ", Div. ", F.when(odd, "1").otherwise("2")), ()),
        (text("Mixing box"), (F.when(~third, text(n, " inch FGR port")), F.when(odd, text("Size ", q, " inlet box")))),
        (F.when(odd, text("Inlet screen, size ", q, ", mounted to bell")).otherwise(text("Outlet wire screen, mounted to fan")), (F.when(third, F.lit("Oversized")),)),
        (text(F.when(odd, "Inlet").otherwise("Outlet"), " silencer, ", (F.col("p_size") + 40).cast("string"), " dBA"), (text("Model: CI-", n, "-A"), F.when(third, text("Pressure drop: .", n)))),
        (text("Bearings split pillow block"), (F.when(odd, text(n, " inch bore")), F.when(third, text(n, ",00 hours")).otherwise(text(q, "7 hours")))),
        (text("Inlet vane damper, ", F.when(odd, "manual").otherwise("automatic"), ", size ", q), (F.when(third, F.lit("Locking quadrant")),)),
        (text("Housing insulation ", n, " inch"), (F.when(odd, F.lit("Mineral wool")).otherwise(F.lit("Acoustic")),)),
        (text("Access door, ", F.when(odd, "quick clamp").otherwise("raised")), (F.when(third, text("Door location: @ ", hour, ":00")),)),
        (text("Motor conduit box location, ", hour, ":00 viewed from outlet"), (F.when(odd, F.lit("Knockout faces downward")),)),
    ]
    none = F.array().cast("array<string>")
    cases = F.array(*(F.struct(line.alias("line"), (F.array_compact(F.array(*d)) if d else none).alias("details")) for line, d in kinds))
    given = p.withColumn("c", F.get(cases, (F.col("p_partkey") % len(kinds)).cast("int"))).select("p_partkey", text(n, ". ", F.col("c.line"), " L 1,250.00").alias("raw"), "c.details")
    return items.read_items(given, "raw", "details").select("p_partkey", items.said(F.col("attributes")).alias("attributes"))


COMPOSED = """
WITH p AS (SELECT p_partkey, p_partkey % 9 AS k, p_size AS n, CAST(floor(p_retailprice) AS BIGINT) AS q, p_size % 12 + 1 AS hour, p_size % 2 = 1 AS odd, p_size % 3 = 0 AS third FROM part)
SELECT p_partkey, CASE k
  WHEN 0 THEN concat_ws('; ', 'component=MOTOR', 'motor_enclosure=EXPLOSION PROOF', 'motor_explosion_class=I', 'motor_explosion_division=' || CASE WHEN odd THEN 1 ELSE 2 END, 'motor_explosion_groups=' || substr('ABCD', n % 4 + 1, 1))
  WHEN 1 THEN concat_ws('; ', 'component=MIXING BOX', CASE WHEN NOT third THEN 'fgr_port=' || n || '"' END, CASE WHEN odd THEN 'used_on=INLET BOX' END, CASE WHEN odd THEN 'used_on_size=' || q END)
  WHEN 2 THEN concat_ws('; ', CASE WHEN odd THEN 'component=INLET SCREEN' ELSE 'component=OUTLET SCREEN' END, CASE WHEN odd THEN 'mount_location=BELL' ELSE 'mount_location=FAN' END, CASE WHEN third THEN 'screen_feature=OVERSIZED' END, CASE WHEN odd THEN 'screen_size=' || q ELSE 'screen_subcategory=WIRE SCREEN GUARD' END)
  WHEN 3 THEN concat_ws('; ', CASE WHEN odd THEN 'component=INLET SILENCER' ELSE 'component=OUTLET SILENCER' END, 'model=CI-' || n || '-A', 'noise_target=' || (n + 40) || ' DBA', CASE WHEN third THEN 'pressure_drop=.' || n END, CASE WHEN NOT odd THEN 'silencer_type=CIRCULAR DISCHARGE SILENCER' END)
  WHEN 4 THEN concat_ws('; ', CASE WHEN odd THEN 'bearing_bore=' || n || '"' END, 'bearing_life_hours=' || CASE WHEN third THEN n || ',000' ELSE ((q * 10 + 7) // 1000) || ',' || lpad(CAST((q * 10 + 7) % 1000 AS VARCHAR), 3, '0') END, 'bearing_type=SPLIT PILLOW BLOCK', 'component=BEARINGS')
  WHEN 5 THEN concat_ws('; ', 'component=INLET VANE DAMPER', 'damper_subcategory=INLET VANE DAMPER', CASE WHEN third THEN 'ivc_feature=LOCKING QUADRANT' END, 'ivc_size=' || q, CASE WHEN odd THEN 'operation=Manual' ELSE 'operation=Automatic' END)
  WHEN 6 THEN concat_ws('; ', CASE WHEN odd THEN 'insulation_material=MINERAL WOOL' END, 'insulation_scope=HOUSING', 'insulation_thickness=' || n || '"', CASE WHEN NOT odd THEN 'insulation_type=ACOUSTIC' END)
  WHEN 7 THEN concat_ws('; ', 'component=ACCESS DOOR', CASE WHEN third THEN 'door_location=' || hour || ':00' END, CASE WHEN odd THEN 'door_type=QUICK CLAMP' ELSE 'door_type=RAISED' END)
  ELSE concat_ws('; ', 'component=MOTOR', CASE WHEN odd THEN 'motor_conduit_box_orientation=KNOCKOUT FACES DOWNWARD' END, 'motor_conduit_box_position=' || hour || ':00 VIEWED FROM OUTLET', 'motor_feature=CONDUIT BOX LOCATION') END AS attributes FROM p"""


def corrected_tags(spark, sf):
    return items.read_items(part_items(spark, sf), "raw", "details").select("p_partkey", F.array_join("tags", ",").alias("tags"))


def item_attributes(spark, sf):
    return items.read_items(part_items(spark, sf), "raw", "details").select("p_partkey", items.said(F.col("attributes")).alias("attributes"))


def item_review(spark, sf):
    given = part_items(spark, sf).withColumn("details", F.array_append("details", F.lit("see sheet")))
    return items.review_flags(given, "p_partkey", "raw", "details").select("p_partkey", F.array_join("flags", "|").alias("flags"))


def item_hierarchy(spark, sf):
    """Lines of orders as items: motors, dampers on a control, actuators with two owners, and others. Lines are dealt by their orders,
    once for all that follows, over as many tasks as keep what each sorts and groups in its memory."""
    lines = table(spark, sf, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines.count() / LINES))
    l = lines.repartition(tasks, "l_orderkey").groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("place"))
    l = l.agg(F.min("l_partkey").alias("k"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"), F.min("l_returnflag").alias("colour"), F.min("l_linestatus").alias("feature"))
    kind = (F.col("k") % 4).cast("int")
    own = F.get(F.array(*(F.create_map(*map(F.lit, m)).cast("map<string,string>") for m in (["component", "Motor"], ["component", "damper", "used_on", "ivc"], ["component", "actuator", "used_on", "IVC, Damper"], ["x_review", "unknown"]))), kind)
    said = F.map_concat(own, F.create_map(F.lit("colour"), F.col("colour"), F.lit("x_feature"), F.col("feature")))
    got = items.hierarchy(l.select("job", "place", "price", F.concat(F.lit("part "), F.col("k").cast("string")).alias("text"), said.alias("said")), "job", "place", "text", "price", "said")
    return got.withColumn("attributes", items.said(F.col("attributes"))).withColumn("conflicts", F.array_join("conflicts", ","))


HIERARCHY = """
WITH r AS (SELECT l_orderkey AS job, l_linenumber AS place, min(l_partkey) AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price, min(l_returnflag) AS colour, min(l_linestatus) AS feature FROM lineitem GROUP BY 1, 2),
v AS (SELECT job, place, 'part ' || k AS t, colour, feature, '' AS parent, CASE k % 4 WHEN 0 THEN 'MOTOR' WHEN 1 THEN 'IVC' ELSE 'part ' || k END AS name, k % 4 <> 3 AS keyed, price AS cost FROM r WHERE k % 4 <> 2
  UNION ALL SELECT job, place, 'part ' || k, colour, feature, p, 'ACTUATOR', true, CASE WHEN p = 'IVC' THEN price ELSE 0 END FROM r, (VALUES ('IVC'), ('DAMPER')) o(p) WHERE k % 4 = 2),
x AS (SELECT *, CASE WHEN keyed THEN -1 ELSE place END AS thing FROM v),
y AS (SELECT *, row_number() OVER (PARTITION BY job, parent, name, keyed, thing ORDER BY cost DESC, place) AS n FROM x),
z AS (SELECT *, CASE WHEN n = 1 THEN -1 ELSE place END AS turn FROM y),
c AS (SELECT job, parent, name, keyed, thing, string_agg(colour, ' | ' ORDER BY turn) AS colours, count(*) AS n FROM (SELECT job, parent, name, keyed, thing, colour, min(turn) AS turn FROM z GROUP BY ALL) GROUP BY ALL),
f AS (SELECT job, parent, name, keyed, thing, string_agg(feature, ', ' ORDER BY turn) AS features FROM (SELECT job, parent, name, keyed, thing, feature, min(turn) AS turn FROM z GROUP BY ALL) GROUP BY ALL),
g AS (SELECT job, parent, name, keyed, thing, min(place) AS place, CAST(sum(cost) AS DOUBLE) AS price, max(t) FILTER (n = 1) AS "primary", count(*) AS members FROM z GROUP BY ALL)
SELECT g.job, g.parent, g.name, g.keyed, g.place, g.price, g."primary", g.members, 'colour=' || colours || '; x_feature=' || features AS attributes, CASE WHEN c.n > 1 THEN 'colour' ELSE '' END AS conflicts
FROM g JOIN c USING (job, parent, name, keyed, thing) JOIN f USING (job, parent, name, keyed, thing)"""


def by_case(values: list[str], name: str) -> str:
    """SQL: the value of each part's case."""
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"SELECT p_partkey, ([{listed}])[CAST(p_partkey % {len(values)} + 1 AS INT)] AS {name} FROM part"


def flags(tags: str, said: str) -> str:
    doubt = [f"COMPONENT REVIEW: {v.split('=')[1]}" for v in said.split("; ") if v.startswith("component_review=")]
    return "|".join(["UNTAGGED"] * (tags == "") + doubt + ["UNCLASSIFIED DETAIL: see sheet"])


QUERIES = {
    "corrected_tags": (corrected_tags, by_case([c[2] for c in CASES], "tags")),
    "item_attributes": (item_attributes, by_case([c[3] for c in CASES], "attributes")),
    "composed_facts": (composed_facts, COMPOSED),
    "item_review": (item_review, by_case([flags(c[2], c[3]) for c in CASES], "flags")),
    "item_hierarchy": (item_hierarchy, HIERARCHY),
}
