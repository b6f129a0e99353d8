"""Corrections of an item's tags by its context, as a table of rules that one fold applies in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.text import normalize, split_lead, split_price, split_type

# fixed values: groups of tags
MATERIAL = ("MATERIALS", "STAINLESS STEEL", "ALUMINUM")
GUARD = "SHAFT/BEARING/COUPLING GUARD"
WARRANTY_SCOPE = ("MOTOR", "VIBRATION ISOLATION", "DRIVE COMPONENTS", "BEARINGS", "FLEX CONNECTOR", "SILENCER", "SCREEN", "WEATHER COVER")
PACKED = ("COATING", "FLANGE", "INLET", "MATERIALS", "OUTLET", "SCREEN", "SILENCER", "STAINLESS STEEL", "ALUMINUM")
SHIPPED = ("ACTUATOR", "DAMPER", "FLEX CONNECTOR", "INLET VANES", "SILENCER", "OUTLET")
COATED_ACCESSORY = ("BELT GUARD", GUARD, "MOTOR", "SILENCER", "FLEX CONNECTOR", "WEATHER COVER", "SCREEN")
COATED_FAN = ("BASE FAN", "WHEEL", "INLET", "OUTLET", "HOUSING")
HOT_PARTS = ("BASE FAN", "INLET VANES", "DAMPER", "SPARK RESISTANT")
# fixed values: patterns
LUBE = r"\b(?:EXTENDED\s+LUBE|LUBE\s+LINES?|GREASE\s+(?:LINES?|FITTINGS?|LEADS?)|ZERK\s+FITTINGS?)\b"
COATING = r"\b(?:PAINT(?:ED|ING)?|COAT(?:ED|ING|S)?|EPOXY|PRIMER|PLASITE|HERESITE|ZINC|ENAMEL|UNPAINTED|GALVANIZ(?:ED|ING)?|VEGETABLE\s+OIL)\b"
NOTE_WORDING = (
    r"(?i)^(?:[A-Z]\.|ALL\s+PIECES\s+NEED\s+TO\s+BE\s+PHYSICALLY\s+LABELLED\b|THE\s+INLET\s+STACK\s+IS\s+TO\s+BE\s+SEPARATE\b|"
    r"(?:FAN|OUTLET\s+DAMPER|INLET\s+BOX|PRE\s*SPIN\s+DAMPER|MIXING\s+BOX|FRESH\s+AIR\s+DAMPER|SILENCER)\s*:\s*\d+\b)"
)
INSPECTION = r"\bISPM\b|\bORDER\s+IS\s+SHIPPING\s+OVERSEAS\b.*\bINSPECTION\s*/?\s*CRATE\s+REPORT\b|\bCUSTOMER\s+FINAL\s+INSPECTION\b|\bUNWITNESSED\s+DIMENSIONAL\s+INSPECTION\b|\bFINAL\s+INSPECTION\s+REPORT\b"
LABELLED = r"\b(?:ONLY\s+APPLY\s+.*WARNING\s+LABEL|SHIPPING\s+BARCODE\s+LABEL|FEI\s+LABEL|LABEL\s+REQUIRED\s+ON\s+EACH\s+ITEM|ON\s+FEDEX\s+SHIPPING\s+LABEL|MARK\s+ALL\s+ITEMS|MARKED\s+WITH\s+THIS\s+INFORMATION)\b"
MOTOR_INSULATION = r"\b(?:(?:CLASS\s+)?[ABFH]\s+INSULATION|INSULATED\s+BEARINGS?|DUAL\s+INSULATED\s+BEARINGS?|(?:DE|NDE)\s+INSULATED\s+BEARING|INSULATED\s+(?:DE|NDE)\s+BEARING)\b"
_PANEL, _WOOL = r"\b(?:PLUG\s+PANEL|HOUSING|INLET\s+BOX|SILENCER|DUCT|FAN)\b", r"LAGGING|JACKET(?:ED)?|MINERAL\s+WOOL|FIBERGLASS|FIBRE\s*GLASS"
FAN_INSULATION = rf"{_PANEL}.{{0,80}}\b(?:INSULAT|{_WOOL})\b|\b(?:INSULAT\w*|{_WOOL})\b.{{0,80}}{_PANEL}"
SHIPMENT_WARRANTY = r"\b(?:WARRANTY|MONTHS?)\b.{0,120}\b(?:SHIPMENT|SHIP\s+DATE|DATE\s+OF\s+SHIP)\b|\b(?:SHIPMENT|SHIP\s+DATE|DATE\s+OF\s+SHIP)\b.{0,120}\b(?:WARRANTY|MONTHS?)\b"
SHIPPING_ORDER = r"\b(?:SHIP\s+DIRECT|DIRECT\s+SHIP|SHIP\s+LOOSE|SHIPPED\s+LOOSE|SHIP\s+VIA|SHIPPING\s+INSTRUCTIONS?|SHIPMENT\s+ONLINE|BOL|FREIGHT|SHIP\s+COMPLETE|SHIP\s+WITH\s+FANS?)\b"
END_LOCATION = r"\bNON\s*[- ]?\s*WHEEL\s+END\b"
HOUSING_WORK = (
    r"\b(?:HOUSING\s+FLANGE|DRUM\s+HOUSING\s+BOLT\s+PATTERN|HOUSING\s+LENGTH|HOUSING\s+THICK(?:NESS)?|HOUSING\s+STIFF(?:E|NE)R|STIFF(?:E|NE)R\s+PLATES?|HOUSING\s+MOUNTING|MOUNT\s+HOUSING|"
    r"HOUSING\s+TO\s+DRIVE\s+COVER|TAP\s+DRIVE\s+SIDE\s+HOUSING|CASING\s+EXTENSION|SQUARE\s+HOUSING|UNIVERSAL\s+HOUSING|RIVETED\s+TO\s+HOUSING|NAMEPLATE\s+TO\s+(?:FAN\s+)?HOUSING|LINERS?\b.*\bHOUSING|HOUSING\s+SCROLL)\b|"
    + END_LOCATION
)
CONDUIT_PLACE = r"\b(?:HUGGING|CLOSE\s+TO|AS\s+CLOSE\s+TO|TACK\s+AND\s+WELD|WELD\s+CONDUIT\s+BOX|CONDUIT\s+BOX\s+TO\s+HOUSING)\b"
CONDUIT_MOTOR = r"\bVIEWED\s+FROM\s+OUTLET\b|\bF[123]\s+CONDUIT\s+BOX\b|\b(?:ROTATE\s+MOTOR\s+CONDUIT\s+BOX|KNOCKOUT\s+FACES|CONDUIT\s+BOX\s+(?:HUGGING|LOCATION)|MOUNT\s+CONDUIT\s+BOX\s+AS\s+CLOSE)\b"
CONDUIT_WORK = r"\b(?:RUN\s+SECOND\s+CONDUIT|THREADED\s+PLUG|VERTICAL\s+MOUNTING\s+PLATE|FLEXIBLE\s+CONDUIT|AUXILIARY\s+BOX)\b"
DRIVE_ROW = r"^\*?\s*\d{3,4}\s*/?\s+\d{3,4}\s+[A-Z]{1,3}\d+\s+\d+\b"
DRIVE_NAME = r"^(?:SPARE\s+)?V\s*[- ]?\s*BELT\s+DRIVE\b|^(?:NPO\s+)?(?:REPAIR|REPLACEMENT)\s+DRIVE\s+SET\b"
DRIVE_FACT = r"\b(?:MOTOR|MTR|FAN)\s+SHEAVE\b|\b(?:ACTUAL\s+SF|ACTUAL\s+CD|SPECIFIED\s+MINIMUM\s+BELT\s+SERVICE\s+FACTOR)\b|\bSELECTED\s+DRIVE\b|\bV\s*[- ]?\s*BELT\s+DRIVE\b"
ISOLATED = r"\b(?:ISOLATORS?|VIBRATION\s+BASE|RUBBER\s+IN\s+SHEAR|SPRING\s+MOUNT|SEISMIC|RIS)\b"
HEAT_WORDS = ("DEG", "TEMPERATURE", "TEMP", "AMBIENT", "OPERATION", "SERVICE", "SUITABLE", "RATED", "MAX")
#: fixed values: what an item belongs to, by the first place of its pattern
OWNERS = {
    "FRESH AIR DAMPER": r"\b(?:FRESH\s+AIR|FA)\s+DAMPER\b|\bFRESH\s+AIR\s+(?:AND\s+)?PRE\s*SPIN\s+DAMPER\s+ACTUATORS?\b",
    "PRESPIN DAMPER": r"\bPRE\s*SPIN\s+(?:INLET\s+BOX\s+)?DAMPER\b|\bPRE\s*SPIN\s+(?:AND\s+)?FRESH\s+AIR\s+DAMPER\s+ACTUATORS?\b",
    "OUTLET DAMPER": r"\bOUTLET\s+(?:VOLUME\s+CONTROL|DAMPER)\b|\bDISCHARGE\s+DAMPER\b",
    "INLET VANE DAMPER": r"\bINLET\s+VANE\s+DAMPER\b|\bIVD\b",
    "IVC": r"\bINLET\s+VOLUME\s+CONTROL\b|\bIVC\b",
}
NO_CONTROL = r"\b(?:WITHOUT|LESS|NO)\s+IVC\b|\bWITHOUT\s+INLET\s+VOLUME\s+CONTROL\b"


@dataclass(frozen=True)
class Rule:
    """Where `on` holds and the tags have all of `has`, one of `some` (if given) and none of `lacks`: `drop` goes, `add` comes;
    `alone`: `add` are the tags, and no later rule applies."""

    on: Column | bool = True
    has: tuple[str, ...] = ()
    some: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    add: tuple[str, ...] = ()
    alone: bool = False


def with_texts(items: DataFrame, raw: str, details: str) -> DataFrame:
    """items with __primary, __blob: normal forms of the line, and of it with its details; __sought: the same, in which tags are
    looked for; __said: all as it stands, upper case; __wording: as it stands, without columns. raw and details have no nulls."""
    squeezed = lambda parts: F.array_join(F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), " ")
    bare = split_type(split_price(split_lead(F.col(raw))["text"])["text"])["text"]
    rows = items.withColumns({"__primary": normalize(F.col(raw)), "__plain": F.transform(details, lambda d: normalize(d, strip_columns=False)), "__said": F.upper(squeezed(F.concat(F.array(raw), F.col(details)))), "__wording": squeezed(F.concat(F.array(bare), F.col(details)))})
    all_forms = F.filter(F.concat(F.array("__primary"), F.col("__plain")), lambda x: x != "")
    return rows.withColumns({"__blob": F.array_join(all_forms, " "), "__sought": F.array_join(all_forms, " ; ")}).drop("__plain")


def owners(blob: Column) -> Column:
    """What the item belongs to, in the order in which it is named; an inlet that only mentions a control belongs to nothing."""
    place = lambda p: F.regexp_instr(blob, F.lit(p))
    found = F.filter(F.array(*(F.struct(place(p).alias("at"), F.lit(name).alias("name")) for name, p in OWNERS.items())), lambda x: x["at"] > 0)
    # both owners of one shared last word start at its first: the name printed first comes first
    first = F.when(blob.rlike(r"\bPRE\s*SPIN\s+(?:AND\s+)?FRESH\s+AIR\s+DAMPER\s+ACTUATORS?\b"), "PRESPIN DAMPER").otherwise("FRESH AIR DAMPER")
    ordered = F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["at"].alias("at"), (x["name"] != first).alias("later"), x["name"].alias("name")))), lambda x: x["name"])
    alone = F.when(blob.rlike(r"\bINLET\s+DAMPER\b"), F.array(F.lit("INLET DAMPER"))).otherwise(F.array().cast("array<string>"))
    nothing = blob.rlike(NO_CONTROL) | (blob.rlike(r"^INLET\b") & blob.rlike(r"\bWITH\s+IVC\b")) | ~blob.rlike("DAMPER|ACTUATOR|VOLUME CONTROL|IVC")
    return F.when(nothing, F.array().cast("array<string>")).when(F.size(ordered) > 0, ordered).otherwise(alone)


def extreme_values(text: Column) -> Column:
    """Temperatures (as `-20F`) below 0, of 130 F or of 50 C and more, that a word within 35 signs or a degree shows to be one."""
    degree = r"(?<![A-Z0-9])-?\d{2,3}\s*(?:(?:DEG(?:REE)?|°)\s*)?[FC]\b"
    before = "|".join(rf"\b{w}\b.{{0,{35 - len(w)}}}" for w in HEAT_WORDS)
    after = "|".join(rf".{{0,{35 - len(w)}}}\b{w}\b" for w in HEAT_WORDS)
    shown = rf"\bTO\s*-?\d{{2,3}}\s*(?:(?:DEG(?:REE)?|°)\s*)?[FC]\b|(?<={before}){degree}|{degree}(?={after})|(?<=\b(?:FOR|AT|TO)\s{{0,7}}){degree}|{degree}(?=.{{0,8}}\bTO\b)|(?<![A-Z0-9])-?\d{{2,3}}\s*(?:DEG|°)\s*[FC]\b"
    values = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(shown), F.lit(0)), lambda x: F.concat(F.regexp_extract(x, r"-?\d{2,3}", 0), F.regexp_extract(x, "[FC]$", 0))))
    number = lambda x: F.regexp_extract(x, r"-?\d+", 0).cast("int")
    return F.filter(values, lambda x: (number(x) < 0) | (x.endswith("F") & (number(x) >= 130)) | (x.endswith("C") & (number(x) >= 50)))


def rules(texts: dict[str, Column], found: Column, section: Column, product: Column, arrangement: Column, parts_only: Column) -> list[Rule]:
    """The corrections, in their order. found: the tags before any of them."""
    primary, blob = texts["primary"], texts["blob"]
    p, b = primary.rlike, blob.rlike
    had = lambda *names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    temperature = F.concat_ws(" ", blob, texts["said"])
    responsibility, admin, assembly = p(r"^CUSTOMER\s+ASSUMES\s+RESPONSIBILITY\b"), p(r"\b(?:SLOW\s+PAY\s+ADDITION|PAYMODE[-\s]*X|FEE|CHARGE)\b"), p(r"^ASSEMBLY\b")
    guard, belt, paint, motor = p(r"\bSHAFT\b.*\bBEARING\b.*\bGUARD\b|\bGUARD\b.*\bSHAFT\b.*\bBEARING\b"), p(r"\bBELT\s+GUARD\b"), p(r"^PAINT\b"), p(r"^MOTOR\b")
    conduit_place = b(r"\bCONDUIT\s+BOX\b") & b(r"\bHOUSING\b") & b(CONDUIT_PLACE)
    conduit = b(r"\bCONDUIT\s+BOX\b") & (p(r"^MOTOR\s+CONDUIT\s+BOX\s+LOCATION\b") | b(CONDUIT_MOTOR) | conduit_place)
    nameplate = b(r"\b(?:NAMEPLATE|REPLAT(?:E|ED|ING))\b") & (
        motor
        | b(r"\bMOTOR\b.{0,80}\bNAMEPLATE\b|\bNAMEPLATE\b.{0,80}\bMOTOR\b")
        | (b(r"\bMOTOR\b") & b(r"\bREPLAT(?:E|ED|ING)\b"))
        | (b(r"\b\d+(?:\.\d+)?\s*HP\b") & b(r"\b(?:RPM|FRAME|TEFC|TENV|XP[A-Z]*|PH|HZ|SF)\b"))
    )
    hot = b(r"\bLOW\s+TEMP(?:ERATURE)?\b|\b(?:HIGH\s+TEMP(?:ERATURE)?|HEAT\s+FAN)\b") | temperature.rlike(r"\bLOW\s+TEMP(?:ERATURE)?\b|\b(?:HIGH\s+TEMP(?:ERATURE)?|HEAT\s+FAN)\b") | (F.size(extreme_values(temperature)) > 0)
    hot_words = b(r"\bFANS?\b|IVC|INLET VOLUME CONTROL")
    drive = p(DRIVE_ROW) | ((~p(r"\bWARRANTY\b") | p(DRIVE_NAME)) & (p(rf"^DRIVE\b|{DRIVE_NAME}|^CENTER\s+DISTANCE\b") | b(DRIVE_FACT) | (b(r"\bDRIVE\s+SET\b") & ~p("WARRANTY"))))
    isolation = ~b(r"\bISOLATED\s+BEARINGS?\b") & (~p(r"\bWARRANTY\b") | p(r"^(?:ISOLATORS?|VIBRATION\s+BASE|SPRING\s+TYPE\s+VIBRATION\s+BASE|SET\s+OF)")) & b(ISOLATED)
    fan_coat = paint | p(r"^(?:SPECIAL\s+PAINT|PRE\s+COATING)\b") | ((p(r"\b(?:AIRSTREAM|EXTERIOR)\b") | had(*COATED_FAN)) & p(COATING))
    accessory_coat = had("COATING") & ((had("SILENCER") & b(COATING)) | (~fan_coat & (belt | guard | primary.startswith("MOTOR") | (had(*COATED_ACCESSORY) & b(COATING)))))
    insulated_fan = p(FAN_INSULATION) | b(FAN_INSULATION)
    material = b(r"\bALUMINUM\b|\bSTAINLESS\s+STEEL\b|\bPASSIVAT")
    lube, motor_bearing, bearing, names_motor = p(LUBE) | b(LUBE), b(r"\bMOTOR\s+BEARINGS?\b"), b(r"\bBEARINGS?\b"), b(r"\bMOTOR\b")
    unknown = F.trim(F.coalesce(arrangement, F.lit(""))) == ""
    fan_bearing = normalize(arrangement).rlike(r"(?:^|\bA\s*/?\s*)(?:1|3|8|9)(?:[A-Z])?\b")
    housing_work = b(HOUSING_WORK)
    covers = b(r"\b(?:RAIN\s*HOOD|RAINHOOD|WEATHER\s+COVER|WEATHER\s+HOOD|DRIP\s*COVER|DRIPCOVER|INLET\s+HOOD)\b")
    return [
        Rule(section.rlike(r"(?i)\bADDITIONAL\s+FEATURES?\b") & ~p(r"\bRUN\s+TEST\b") & ~(responsibility | admin | assembly) & (texts["wording"].rlike(NOTE_WORDING) | (F.size(found) == 0)), add=("ADDITIONAL FEATURES / NOTES",), alone=True),
        Rule(b(r"\bFAN\s+DRAWINGS?\b") & b(r"\bFAN\b.*\bACCESSOR(?:Y|IES)\b.*\bMOTOR\b.*\bTOTAL\b") & b("WEIGHT"), add=("FAN DRAWING WEIGHTS",), alone=True),
        Rule(b(r"\bTHREADED\s+PLUG\b.*\bCONDUIT\s+BOX\b"), add=("THREADED PLUG FOR CONDUIT BOX OPENING",), alone=True),
        Rule(p(r"^ALL\s+(?:\w+\s+)*WHEELS\s+ARE\s+PRECISION\s+BALANCED\b") | admin | responsibility, add=("MISC NOTE",), alone=True),
        Rule(p(r"^MOUNTED\s+BY\s+OTHERS$"), add=("MOTOR",)),
        Rule(~p(r"\bWARRANTY\b"), drop=("WARRANTY",)),
        Rule(has=("WARRANTY",), drop=WARRANTY_SCOPE),
        Rule(covers & p(r"\b(?:ENGINEERING|DRAWINGS?)\b") & p(r"\b(?:SHOW|WEIGHT|DRAWING)\b"), drop=("WEATHER COVER",)),
        Rule(~guard, drop=(GUARD,)),
        Rule(p(r"^BASE\s+FAN\b"), drop=("MOTOR", "MOUNTING")),
        Rule(has=("SPLIT HOUSING",), drop=("HOUSING",)),
        Rule(p(r"\bMOTOR\b|\bEXPLOSION\s+PROOF\b|\bCLASS\s*[0-9IVX]+\b.*\bDIV(?:ISION)?\b"), has=("EXPLOSION PROOF",), add=("MOTOR",)),
        Rule(drop=("EXPLOSION PROOF",)),
        Rule(b("MIXING BOX") | p(r"^MIXING\s+BOX\b"), has=("MIXING BOX",), drop=("INLET",)),
        Rule(~p(r"^INLET\b") & b(r"\bMOUNTED\s+ON\s+(?:OVERSIZED\s+)?INLET\s+BOX\b"), some=("DAMPER", "ACTUATOR", "FLEX CONNECTOR"), drop=("INLET",)),
        Rule(p(r"\bPRE\s*SPIN\s+(?:INLET\s+BOX\s+)?DAMPER\b"), drop=("INLET",)),
        Rule(~motor & b(LABELLED), has=("LABEL",), drop=("MOTOR", "NAMEPLATE")),
        Rule(nameplate, has=("NAMEPLATE",), add=("MOTOR",)),
        Rule(b(r"\b(?:UPDATED|CHANGE|CHANGED)\s+SHIP\s+VIA\b") | p(r"\bSHIP\s+VIA\b"), drop=SHIPPED, add=("SHIPPING",)),
        Rule(~p(r"^LIFTING\s+LUGS?\b"), drop=("LIFTING LUGS",)),
        Rule(b(r"\bFLOW\s+LINERS?\b"), has=("FLEX CONNECTOR",), drop=("LINING",)),
        Rule(b(r"\bC\s*[- ]?\s*FLANGE\b|\bMOTOR\b.{0,50}\bFLANGE\b|\bFLANGE\b.{0,50}\bMOTOR\b") & ~(b(r"\b(?:HOUSING|INLET|OUTLET)\s+FLANGE\b") & b(r"\bMOTOR\s+CONDUIT\s+BOX\b")), drop=("FLANGE",), add=("MOTOR",)),
        Rule(b(END_LOCATION), drop=("WHEEL",), add=("HOUSING",)),
        Rule(conduit, add=("MOTOR",)),
        Rule(conduit & ~b(CONDUIT_WORK) & ~housing_work, drop=("SPECIAL CONSTRUCTION",)),
        Rule(conduit & ~housing_work, drop=("HOUSING",)),
        Rule(b(NO_CONTROL), drop=("INLET VANES",)),
        Rule(p(r"^INLET\b") & b(r"\bWITH\s+IVC\b") & b(r"\b(?:FLANGED|PUNCHED|UNPUNCHED|OPEN|SLIP|BELL|TUBE)\b"), drop=("DAMPER", "INLET VANES")),
        Rule(b(r"\bACTUATOR\b") & b(r"\b(?:IVC|INLET\s+VOLUME\s+CONTROL)\b"), has=("INLET VANES",), add=("DAMPER",)),
        Rule(b(r"\bINLET\s+CONE\b") & b(r"\b\d+(?:\.\d+)?\s*%\s*WIDTH\b|\bPERCENT\s+WIDTH\b") & ~b(r"\bWHEEL\b"), drop=("WHEEL",)),
        Rule(b(r"\b(?:FLEX(?:IBLE)?\s+CONNECTOR|EXPANSION\s+JOINT|EJ)\b"), has=("FLEX CONNECTOR",), drop=("FLANGE",)),
        Rule(b(r"\bEXPAN(?:S|T)ION\s+JOINT\b"), has=("FLEX CONNECTOR",), drop=("INLET", "OUTLET")),
        Rule(hot & ~motor & hot_words, lacks=("SHAFT SEAL",), add=("EXTREME TEMP",)),
        Rule(hot & ~motor, some=HOT_PARTS, lacks=("SHAFT SEAL",), add=("EXTREME TEMP",)),
        Rule(motor, drop=("EXTREME TEMP",)),
        Rule(has=("SHAFT SEAL",), drop=("EXTREME TEMP",)),
        Rule(~hot_words, lacks=HOT_PARTS, drop=("EXTREME TEMP",)),
        Rule(b(r"\bHOUSING\s+DRAINS?\b"), drop=("HOUSING",)),
        Rule(b(r"\bINLET\s+BOX\b") & b("DRAIN") & ~b(r"\bHOUSING\s+DRAINS?\b"), drop=("INLET",)),
        Rule(F.coalesce(F.get(owners(blob), F.lit(0)) == "OUTLET DAMPER", F.lit(False)), has=("DAMPER",), drop=("OUTLET",)),
        Rule(b(r"\bSTUFFING\s+BOX(?:ES)?\b") & ~b(r"\bSHAFT\s+SEALS?\b|\bCERAMIC\s+FELT\b"), has=("DAMPER",), drop=("SHAFT SEAL",)),
        Rule(b(r"\bDOUBLE\s+LIP\s+SEALS?\s+BOTH\s+ENDS\b") & ~b(r"\bSHAFT\s+SEALS?\b|\bCERAMIC\s+FELT\b"), drop=("SHAFT SEAL",)),
        Rule(b(r"\bALL\s+AUXILIARY\s+ITEMS\s+EXCEPT\s+MOTOR\b"), has=("SHIPPING",), drop=("MOTOR",)),
        Rule(b(r"\b(?:SHIPPED|SHIP)\s+WITH\s+(?:THE\s+)?FAN\b") & ~b(r"\b(?:SHIPPING\s+BAR\s*CODE\s+LABEL|SHIPPING\s+LABEL)\b"), has=("LABEL",), drop=("SHIPPING",)),
        Rule(b(SHIPMENT_WARRANTY) & ~b(SHIPPING_ORDER), drop=("SHIPPING",)),
        Rule(~p(r"^(?:NPO\s+)?(?:SPARE|REPAIR|REPLACEMENT)\b"), drop=("SPARE PARTS",)),
        Rule(drive & (~motor | p(r"^MOTOR\s+SHEAVE\b")), has=("DRIVE COMPONENTS",), drop=("MOTOR",)),
        Rule(~drive, drop=("DRIVE COMPONENTS",)),
        Rule(~isolation, drop=("VIBRATION ISOLATION",)),
        Rule(belt, drop=("COATING", "MOUNTING", "MOTOR")),
        Rule(accessory_coat & ~belt, drop=("COATING",)),
        Rule(p(DRIVE_ROW), drop=("DRAWINGS", "MOTOR", "SPECIAL CONSTRUCTION")),
        Rule(paint, has=("COATING",), drop=("MOTOR", "UNITARY BASE", "WHEEL")),
        Rule(~(p(INSPECTION) | b(INSPECTION)), drop=("INSPECTION",)),
        Rule(~p(r"\b(?:TEST|WITNESS|INSPECTION|AMP\s+DRAW|ROUTINE\s+TEST|IEEE\s*112)\b") & ~b(r"\b(?:IEEE\s*112|ROUTINE\s+TEST|UNWITNESSED)\b"), drop=("TESTING",)),
        Rule(~p(r"\b(?:TEST|WITNESS|INSPECTION|AMP\s+DRAW|ROUTINE\s+TEST|IEEE\s*112)\b"), lacks=("MOTOR",), drop=("TESTING",)),
        Rule(p(r"\b(?:ISPM|WOOD\s+INSPECTION\s+STAMP|LUMBER|SKID)\b"), has=("INSPECTION", "PACKAGING"), lacks=("DRAWINGS", "3D STEP DRAWINGS"), drop=PACKED),
        Rule(~insulated_fan & b(MOTOR_INSULATION), has=("INSULATION", "MOTOR"), drop=("INSULATION",)),
        Rule(b(r"\b(?:SCROLL|SIDE\s+SHEET)\b"), has=("LINING",), add=("HOUSING",)),
        Rule(b(r"\bBLADES?\b"), has=("LINING",), add=("WHEEL",)),
        Rule(~housing_work & b(r"\b(?:SKID|SCRAP\s+WOOD|BLOCKING|BANDING|CRAT(?:E|ING)|CARTON|PACKAG)\b"), some=("PACKAGING", "SHIPPING"), drop=("HOUSING",)),
        Rule(assembly, drop=("WHEEL",), add=("MISC NOTE",)),
        Rule(parts_only & p(r"^CONSTRUCTION\b") & material, add=("PARTS-ONLY ORDER",)),
        Rule(lube & ~motor_bearing & (bearing | (~names_motor & (unknown | fan_bearing))), add=("BEARINGS",)),
        Rule(lube & (motor_bearing | (~bearing & (names_motor | unknown | ~fan_bearing))), add=("MOTOR",)),
        Rule(material & (p("ACTUATOR") | product.eqNullSafe("ACTUATOR") | (motor & ~p(r"^MOTOR\s+MOUNTING\b"))), drop=MATERIAL),
        Rule(drop=("MOUNTING",)),
    ]


def corrected(found: Column, table: list[Rule]) -> Column:
    """The tags after the rules, sorted. One fold over the table, whatever its length."""
    names = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    on = F.array(*(F.coalesce(r.on, F.lit(False)) if isinstance(r.on, Column) else F.lit(r.on) for r in table))
    given = F.array(*(F.struct(*(names(getattr(r, f)).alias(f) for f in ("has", "some", "lacks", "drop", "add")), F.lit(r.alone).alias("alone")) for r in table))

    def step(state: Column, x: Column) -> Column:
        have, r = state["tags"], x["r"]
        met = (F.size(F.array_except(r["has"], have)) == 0) & ((F.size(r["some"]) == 0) | F.arrays_overlap(r["some"], have)) & ~F.arrays_overlap(r["lacks"], have)
        after = F.when(r["alone"], r["add"]).otherwise(F.array_union(F.array_except(have, r["drop"]), r["add"]))
        return F.when(~state["done"] & x["on"] & met, F.struct(after.alias("tags"), r["alone"].alias("done"))).otherwise(state)

    start = F.struct(found.alias("tags"), F.lit(False).alias("done"))
    return F.aggregate(F.zip_with(on, given, lambda o, r: F.struct(o.alias("on"), r.alias("r"))), start, step, lambda s: F.array_sort(s["tags"]))
