"""What an item's text says of its component, as a table of facts. A later fact of the same name replaces an earlier one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions.corrections import CONDUIT_MOTOR, CONDUIT_PLACE, LUBE, extreme_values, owners

Value = str | Callable[[Column], Column]


@dataclass(frozen=True)
class Fact:
    """name: the first value whose pattern is found in the text (`every`: all of them, joined by commas). `$1` is the pattern's group.
    tag: needed (several: joined by +; blank: none). needs: a pattern that the line itself must have, given: one that the text must
    have. of: primary, blob or said."""

    name: str
    choices: tuple[tuple[str, Value], ...]
    tag: str = ""
    every: bool = False
    of: str = "blob"
    needs: str = ""
    given: str = ""


def facts(tag: str, name: str, *choices: tuple[str, Value], every: bool = False, of: str = "blob", needs: str = "", given: str = "") -> Fact:
    return Fact(name, choices, tag, every, of, needs, given)


def each(text: Column, pattern: str) -> Column:
    """The pattern's group wherever it is found, each value once, joined by commas."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), ", ")


def each_letter(text: Column, pattern: str) -> Column:
    """The single letters within the pattern's group, likewise."""
    return each(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), " "), r"\b([A-Z])\b")


#: These read the whole text; any other function gets the pattern's group.
WHOLE_TEXT = (each, each_letter)


def model(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"\s+", "-"), r"-(?:AND|WITH|INCLUDES?|INLET|OUTLET|DISCHARGE|SILENCER|UNIT|VENDOR|PRODUCT).*$", "")


def grouped(value: Column) -> Column:
    """Digits by thousands; a last group of two digits has lost its zero."""
    digits = F.when(value.rlike(r",\s*\d{2}$"), F.concat(value, F.lit("0"))).otherwise(value)
    return F.format_number(F.regexp_replace(digits, r"\D", "").cast("long"), 0)


def dashed(value: Column) -> Column:
    return F.concat(F.regexp_replace(F.trim(value), r"\s+", "-"), F.lit('"'))


def squeezed(value: Column) -> Column:
    return F.concat(F.regexp_replace(value, r"\s+", ""), F.lit('"'))


_SIZE = r"\d+[-\s]\d+/\d+|\d+/\d+|\d+(?:\.\d+)?"
_DRAIN = r"(?:\d+\s+)?\d+/\d+|\d+(?:\.\d+)?"
_INCH = r"(?:\"|INCH(?:ES)?)"
_GUARD = r"\bSHAFT\b.*\bBEARING\b.*\bGUARD\b|\bGUARD\b.*\bSHAFT\b.*\bBEARING\b"
_SEAL = "SHAFT SEAL"
_OWN_EVASE = r"^(?!.*\b(?:FOR|ON|TO|OF)\s+(?:THE\s+)?(?:(?:FAN|DISCHARGE|OUTLET)\s+)*EVASEE?\b)"
_METAL = r"\bALUMINUM\b|\bSTAINLESS\s+STEEL\b|\bPASSIVAT"
_GRADES = tuple((rf"\bT?{grade}\s+STAINLESS\s+STEEL\b", f"{grade} SS") for grade in ("304", "304L", "316", "316L"))
_OWNER = r"ACTUATOR|^MOTOR\b(?!\s+MOUNTING\b)"
_NO_OWNER = r"^(?!.*ACTUATOR)(?!MOTOR\b(?!\s+MOUNTING\b))"
_EXPLOSIVE = r"\bEXPLOSION[\s;-]*PROOF\b|CLASS\s*I+\b.*DIV"
_EXPLOSIVE_MOTOR = r"\bMOTOR\b|\bEXPLOSION\s+PROOF\b|\bCLASS\s*[0-9IVX]+\b.*\bDIV(?:ISION)?\b"
_CONDUIT = rf"^(?=.*\bCONDUIT\s+BOX\b)(?:MOTOR\s+CONDUIT\s+BOX\s+LOCATION\b|.*(?:{CONDUIT_MOTOR})|(?=.*\bHOUSING\b).*(?:{CONDUIT_PLACE}))"
_SCREEN_RING = r"\bINLET\s+SCREEN\s+MOUNTING\s+RING\b|\bSELF\s+TAPPERS?\b.*\bINLET\s+SCREEN\b"
_SCREEN_HEAD = r"(?:OUTLET\s+AND\s+INLET\s+SCREEN|(?:INLET|OUTLET)\s+(?:WIRE\s+)?SCREEN|SCREEN)\b|(?:LASER\s*[- ]?\s*CUT|OVERSIZED|STANDARD)\b.*\bSCREEN\b"
_SCREEN_ITSELF, _SCREEN_PART = rf"^(?:{_SCREEN_HEAD})|{_SCREEN_RING}", rf"^(?!{_SCREEN_HEAD}|.*(?:{_SCREEN_RING}))"
_RAINHOOD = r"\b(?:RAIN\s*HOOD|WEATHER\s+HOOD|WEATHER\s+COVER)\b"
_INLET_SILENCER, _OUTLET_SILENCER = r"\b(?:CIRCULAR\s+)?INLET\s+SILENCER\b", r"\b(?:OUTLET|(?:CIRCULAR\s+)?DISCHARGE)\s+SILENCER\b"
_OTHER_SILENCER = r"\bCIRCULAR\s+DISCHARGE\s+SILENCER\b|\bCIB\b"
_PACKED = r"\b(?:PLUG PANEL|HOUSING|INLET BOX|SILENCER|DUCT|FAN)\b"
_THICK = r"[0-9]+(?:\.[0-9]+)?"
_BORE = r"\b(\d+(?:[-\s]\d+/\d+)?|\d+/\d+)\s*(?:\"|IN(?:CH(?:ES)?)?\.?)?\s*BORE\b"
_HOURS = r"\b(\d{1,3}\s*,\s*\d{2,3}|\d{4,})\s+HOURS?\b"
_BEARING_TYPES = ((r"\bBEARINGS?\s+SPLIT\s+PILLOW\s+BLOCK\b", "SPLIT PILLOW BLOCK"), (r"\bBEARINGS?\s+STANDARD\b", "STANDARD"), (r"\bREPAIR\s+BEARINGS?\b", "REPAIR BEARINGS"), (r"\bSPARE\s+BEARINGS?\b", "SPARE BEARINGS"))


def _near_screen(side: str) -> str:
    return rf"^(?=.*SILENCER).*(?:\b{side}\s+SCREEN\b|\bSCREEN\b.{{0,20}}\b{side}\b)|^(?!.*SILENCER).*(?:\b{side}\b.{{0,40}}\bSCREEN\b|\bSCREEN\b.{{0,40}}\b{side}\b)"


# fixed values: names, patterns and values of facts, by component
FACTS = [
    facts("", "component", (r"\bBEARING\s+ADDER\b", "BEARINGS"), *((p, "BEARINGS") for p, _ in _BEARING_TYPES)),
    facts("", "component", (rf"{_BORE}|{_HOURS}", "BEARINGS"), of="said"),
    facts("", "component", (_METAL, "MOTOR"), needs=r"^MOTOR\b(?!\s+MOUNTING\b)"),
    facts("", "component", (_METAL, "ACTUATOR"), needs="ACTUATOR"),
    facts("DRIVE COMPONENTS", "component", ("", "DRIVE COMPONENTS")),
    facts("SPLIT HOUSING", "component", ("", "SPLIT HOUSING")),
    facts("SPLIT HOUSING", "split_type", (r"\bHORIZONTAL\s+SPLIT\s+HOUSINGS?\b", "HORIZONTAL"), (r"\bPIE\s+WEDGE\s+SPLIT\s+HOUSINGS?\b", "PIE WEDGE"), (r"\b(?:SHIPPING|SHIPMENT)\s+SPLITS?\b|\bSPLIT\s+(?:HOUSINGS?\s+)?(?:FOR\s+)?(?:SHIPPING|SHIPMENT)\b|\bSPLIT\s+(?:HOUSINGS?\s+)?TO\s+SHIP\b|\bHOUSINGS?\s+SPLIT\s+(?:FOR\s+)?(?:SHIPPING|SHIPMENT)\b", "SHIPPING"), every=True),
    facts("", "component", ("", "MOTOR"), needs=_EXPLOSIVE_MOTOR, given=_EXPLOSIVE),
    facts("", "motor_enclosure", ("", "EXPLOSION PROOF"), needs=_EXPLOSIVE_MOTOR, given=_EXPLOSIVE),
    facts("", "motor_explosion_class", (r"\bCL(?:ASS|S)?\.?\s*([0-9IVX]+)\b", each), needs=_EXPLOSIVE_MOTOR, given=_EXPLOSIVE),
    facts("", "motor_explosion_groups", (r"\bGR(?:OU)?PS?\.?\s+([A-Z](?:[\s,]+[A-Z])*)(?=\s+CL(?:ASS|S)?\b|\s+DIV(?:ISION)?\b|$)", each_letter), needs=_EXPLOSIVE_MOTOR, given=_EXPLOSIVE),
    facts("", "motor_explosion_division", (r"\bDIV(?:ISION)?\.?\s*([0-9]+)\b", each), needs=_EXPLOSIVE_MOTOR, given=_EXPLOSIVE),
    facts("WHEEL", "wheel_effective_diameter_percent", (r"\b(\d+(?:\.\d+)?)\s*%\s+EFFECTIVE\s+DIAMETER\b", "$1")),
    facts("WHEEL", "wheel_hub_construction", (r"\bTAPER\s*LOCK\s+BUSHING\b", "TAPER LOCK BUSHING"), (r"\bCAST\s+HUB\b", "CAST HUB")),
    facts("WHEEL", "wheel_hub_bore", (r"^(?=.*\bCAST\s+HUB\b).*STRAIGHT BORE", "STRAIGHT BORE")),
    facts("WHEEL", "wheel_bore", (rf"^(?=.*\bTAPER\s*LOCK\s+BUSHING\b).*?\bBORE\s*:?\s*({_SIZE})(?!\w)", dashed), (rf"^(?=.*\bTAPER\s*LOCK\s+BUSHING\b).*?\b({_SIZE})\s*(?:\"|''|INCH(?:ES)?)?\s+BORE\b", dashed), of="said"),
    facts("WHEEL", "component", (r"\bEFFECTIVE\s+DIAMETER\b|\bCAST\s+HUB\b|\bTAPER\s*LOCK\s+BUSHING\b", "WHEEL")),
    facts("WHEEL", "wheel_feature", (r"\bEFFECTIVE\s+DIAMETER\b", "EFFECTIVE DIAMETER"), (r"\bCAST\s+HUB\b", "CAST HUB"), (r"\bTAPER\s*LOCK\s+BUSHING\b", "TAPER LOCK BUSHING"), every=True),
    facts("UNITARY BASE", "component", ("", "UNITARY BASE")),
    facts("UNITARY BASE", "unitary_base_size", (r"\b(\d+(?:\.\d+)?)\s*(?:\"|INCH(?:ES)?)?\s+CHANNEL\s+BASE\b", '$1"')),
    facts("UNITARY BASE", "unitary_base_clearance", (r"\bSLIP\s+OUTLET\b.*\bPAST\s+CHANNEL\s+BASE\s+BY\s+(\d+(?:\.\d+)?)\b", '$1"')),
    facts("UNITARY BASE", "unitary_base_type", (r"\bUNITARY\s+BASE\b", "UNITARY BASE"), (r"\bSTRUCTURAL\s+(?:STEEL\s+)?BASE\b", "STRUCTURAL STEEL BASE"), (r"\bCHANNEL\s+BASE\b", "CHANNEL BASE"), every=True),
    facts("UNITARY BASE", "unitary_base_detail", (r"\bCOMMON\s*/?\s+UNITARY\s+BASE\b", "COMMON UNITARY BASE"), (r"\bSLIP\s+OUTLET\b.*\bCHANNEL\s+BASE\b", "OUTLET EXTENDS PAST CHANNEL BASE"), every=True),
    facts("UNITARY BASE", "unitary_base_type", (r"\bOFFSET\s+BASE\b", "OFFSET BASE"), (r"\bT\s*RAILS?\b", "T RAILS")),
    facts("", "component", (r"\bPANEL\s+MOUNTING\s+HOLES?\b", "PANEL MOUNTING HOLES"), (r"\bMOUNTING\s+(?:FEET|LUGS?)\b", "MOUNTING")),
    facts("", "mounting_holes", (r"\bPANEL\s+MOUNTING\s+HOLES?\b", "YES")),
    facts("", "mounting_type", (r"^(?!.*\bPANEL\s+MOUNTING\s+HOLES?\b)(?=.*\bFEET\b).*\bMOUNTING\s+(?:FEET|LUGS?)\b", "FEET"), (r"^(?!.*\bPANEL\s+MOUNTING\s+HOLES?\b).*\bMOUNTING\s+LUGS?\b", "LUGS")),
    facts("INLET", "component", (r"\bINLET\s+VENTURI\b", "INLET")),
    facts("INLET", "inlet_subcategory", (r"\bINLET\s+VENTURI\b", "VENTURI")),
    facts("", "component", (r"\bBLADE\s*SIDE\s+GUARD\b", "BLADE SIDE GUARD")),
    facts("", "guard_type", (r"\bBLADE\s*SIDE\s+GUARD\b", "BLADE SIDE")),
    facts("FILTER", "component", (r"\bFILTER\s+BOX(?:ES)?\b", "FILTER BOX"), ("", "FILTER")),
    facts("FILTER", "filter_type", (r"\bFILTER\s+BOX(?:ES)?\b", "FILTER BOX"), ("", "FILTER")),
    facts("", "component", (r"\bPIEZOMETER\s+RINGS?\b", "PIEZOMETER RING")),
    facts("", "piezometer_ring", (r"\bPIEZOMETER\s+RINGS?\b", "YES")),
    facts("VFD", "component", (r"\b(?:MOTOR|INVERTER\s+DUTY|VFD\s+(?:SUITAB|OPERATION|CONTROLLED|RATED|COMPATIB))\b", "MOTOR")),
    facts("VFD", "vfd_context", (r"\b(?:MOTOR|INVERTER\s+DUTY|VFD\s+(?:SUITAB|OPERATION|CONTROLLED|RATED|COMPATIB))\b", "MOTOR")),
    facts("VFD", "vfd_supplied_by", (r"\bVFD\s+BY\s+OTHERS\b", "OTHERS")),
    facts("VFD", "motor_vfd_suitability", (r"\b(?:NOT\s+VFD\s+SUITAB(?:LE|ILITY)|NOT\s+(?:FOR|SUITABLE\s+FOR)\s+VFD)\b", "NOT VFD SUITABLE"), (r"\bINVERTER\s+DUTY\b", "INVERTER DUTY"), (r"\bVFD\s+(?:SUITAB(?:LE|ILITY)|COMPATIBLE|RATED)\b", "VFD SUITABLE")),
    facts("VFD", "motor_vfd_operation", (r"\bDOL\s+OR\s+VFD\s+OPERATION\b", "DOL OR VFD"), (r"\bVFD\s+CONTROLLED\b", "VFD CONTROLLED")),
    facts("VIBRATION ISOLATION", "component", ("", "VIBRATION ISOLATION")),
    facts("VIBRATION ISOLATION", "isolation_deflection", (r"\b(\d+\s*/\s*\d+|\d+(?:\.\d+)?)\s*(?:\"|INCH(?:ES)?)?\s+DEFLECTION\b", squeezed), of="said"),
    facts("VIBRATION ISOLATION", "isolation_frame", (r"\b(\d+)\s*(?:-|\s)\s*(\d+)\s+FRAME\b", "$1 - $2"), (r"\b(OCT\d+)\b", "$1")),
    facts("VIBRATION ISOLATION", "furnished_by", (r"\bFURNISHED\s+BY\s*:?\s*([A-Z0-9 /&.-]+?)(?=\s+(?:SHIP|INQUIRY)\b|$)", "$1")),
    facts("VIBRATION ISOLATION", "vibration_isolation_type", (r"\bVIBRATION\s+BASE\b", "VIBRATION BASE"), (r"\bSPRING\b", "SPRING ISOLATOR"), (r"\bRUBBER\b|\bRIS\b", "RUBBER ISOLATOR"), (r"\bSEISMIC\b", "SEISMIC ISOLATOR"), (r"\bCUT\s+SHEET\b", "CUT SHEET/POSITION NOTE"), every=True),
    facts("FLEX CONNECTOR", "component", (r"^(?=.*OUTLET).*\b(?:EXPAN(?:S|T)ION\s+JOINT|EJ)\b", "OUTLET EXPANSION JOINT"), (r"^(?=.*INLET).*\b(?:EXPAN(?:S|T)ION\s+JOINT|EJ)\b", "INLET EXPANSION JOINT"), (r"\b(?:EXPAN(?:S|T)ION\s+JOINT|EJ)\b", "EXPANSION JOINT"), ("", "FLEX CONNECTOR")),
    facts("FLEX CONNECTOR", "flex_connector_type", (r"^(?!.*\b(?:EXPAN(?:S|T)ION\s+JOINT|EJ)\b).*\bFLEX\s+CONNECTOR\b", "FLEX CONNECTOR"), (r"^(?!.*\b(?:EXPAN(?:S|T)ION\s+JOINT|EJ)\b).*\bFLEXIBLE\s+CONNECTOR\b", "FLEXIBLE CONNECTOR")),
    facts("FLEX CONNECTOR", "feature", (r"\bFLOW\s+LINERS?\b", "FLOW LINER")),
    facts("FLEX CONNECTOR", "insulation", (r"\bFIBERGLASS\s+SOUND\s+PILLOW\b", "FIBERGLASS SOUND PILLOW"), (r"\bSOUND\s+PILLOW\b", "SOUND PILLOW")),
    facts("FLEX CONNECTOR", "face_to_face", (r"\b(\d+(?:\.\d+)?)\s*(?:INCH(?:ES)?\s+)?F\s+F\b", '$1"')),
    facts("FLEX CONNECTOR", "punched_to_match", (r"\bPUNCHED\s+TO\s+MATCH\s+(?:THE\s+)?(?:FAN\s+)?OUTLET\s+FLANGE\b", "OUTLET FLANGE")),
    facts("COUPLING", "component", ("", "COUPLING")),
    facts("COUPLING", "coupling_subcategory", ("", "FLEXIBLE COUPLING")),
    facts("COUPLING", "manufacturer", ("REXNORD", "REXNORD"), ("FALK|STEELFLEX", "FALK")),
    facts("COUPLING", "coupling_type", (r"\bHALF\s+COUPLING\b", "HALF COUPLING"), (r"\bREXNORD\s+(THOMAS\s+SERIES\s+\d+)\b", "REXNORD $1"), ("REXNORD", "REXNORD THOMAS SERIES"), ("FALK|STEELFLEX", "FALK TYPE T STEELFLEX")),
    facts("COUPLING", "size", (r"\bSIZE\s+([A-Z0-9-]+)\b", "$1")),
    facts("COUPLING", "fit", ("CLEARANCE", "CLEARANCE"), ("INTERFERENCE", "INTERFERENCE")),
    facts("COUPLING", "cover_type", (r"\b(HORIZONTAL\s+SPLIT\s+COVER\s+T10)\b", "$1")),
    facts("COUPLING", "set_screws", (r"\bSET\s+SCREWS?\b", "YES")),
    facts("COUPLING", "puller_holes", (r"\bPULLER\s+HOLES?\s*:?\s*(NONE|YES|NO|[A-Z0-9./-]+)\b", "$1")),
    facts("COUPLING", "mounting_options", (r"\bMOUNTING\s+OPTIONS?\s*:?\s*(BOTH\s+HALVES)\b", "$1")),
    facts("", "component", (r"^(?!.*ACTUATOR).*\bFRESH\s+AIR\s+DAMPER\b", "FRESH AIR DAMPER"), (r"^(?!.*ACTUATOR).*\bPRE\s*SPIN\s+(?:INLET\s+BOX\s+)?DAMPER\b", "PRESPIN DAMPER"), (r"^(?!.*ACTUATOR).*\b(?:OUTLET|DISCHARGE)\s+DAMPER\b", "OUTLET DAMPER"), (r"^(?!.*ACTUATOR).*\bINLET\s+VANE\s+DAMPER\b", "INLET VANE DAMPER"), of="primary"),
    facts("", "leakage_class", (r"\bLOW\s*[- ]?LEAK(?:AGE)?\b", "LOW LEAKAGE")),
    facts("LOW LEAKAGE", "leakage_class", ("", "LOW LEAKAGE")),
    facts("HEAVY DUTY", "heavy_duty", ("", "YES")),
    facts("HEAVY DUTY", "component", (r"\bWHEEL\b", "WHEEL"), (r"\bHOUSING\b", "HOUSING")),
    facts("MIXING BOX", "component", ("", "MIXING BOX")),
    facts("MIXING BOX", "fgr_port", (rf"\b({_THICK})\s*(?:\"|IN(?:CH(?:ES)?)?\.?)?\s+FGR\s+PORT\b", '$1"'), ("FGR PORT", "YES"), of="said"),
    facts("MIXING BOX", "shipping_state", (r"SHIPPED LOOSE|SHIP LOOSE", "SHIPPED LOOSE")),
    facts("INLET VANES", "used_on", ("", "IVC")),
    facts("MIXING BOX", "used_on", ("INLET BOX", "INLET BOX")),
    facts("MIXING BOX", "used_on_size", (r"\bSIZE\s+(\d+)\s+INLET\s+BOX\b|\bINLET\s+BOX\s+SIZE\s+(\d+)\b", "$1$2")),
    facts("MIXING BOX", "size", (rf"^\s*({_THICK})\s*(?:\"|IN(?:CH(?:ES)?)?\.?)?\s+MIXING\s+BOX\b", '$1"'), of="said"),
    facts("INLET VANES", "damper_subcategory", (r"INLET VANE DAMPER|\bIVD\b", "INLET VANE DAMPER")),
    facts("INLET VANES", "operation", (r"\bAUTOMATIC\b", "Automatic"), (r"\bMANUAL\b", "Manual")),
    facts("INLET VANES", "ivc_feature", (r"\bLOCKING(?:\s+QUADRANT)?\b", "LOCKING QUADRANT"), (r"\bROTATING\s+RING\s+ARM\b", "ROTATING RING ARM"), every=True),
    facts("INLET VANES", "ivc_size", (r"\bSIZE\s+(\d{3,4})\b|\b(\d{3,4})\s+LOW\s+LEAK\s+IVC\b", "$1$2")),
    facts("INLET VANES", "ivc_arm_position", (r"(?:@\s*)?([0-9]{1,2})\s+O\s*CLOCK", "$1 O'CLOCK")),
    facts("INSPECTION", "component", ("", "INSPECTION")),
    facts("INSPECTION", "inspection_subcategory", (r"\bISPM\b.*\b(?:STAMP|STAMPING|INSPECTION)\b", "ISPM WOOD STAMP"), (r"\bISPM\b", "ISPM REQUIREMENTS"), (r"\bORDER\s+IS\s+SHIPPING\s+OVERSEAS\b", "OVERSEAS CRATE REPORT"), (r"\bCUSTOMER\s+FINAL\s+INSPECTION\b", "CUSTOMER FINAL INSPECTION"), (r"\bUNWITNESSED\s+DIMENSIONAL\s+INSPECTION\b", "DIMENSIONAL INSPECTION"), (r"\bFINAL\s+INSPECTION\s+REPORT\b", "FINAL INSPECTION REPORT")),
    facts("INSPECTION", "inspection_scope", (r"^(?!.*\bISPM\b).*\bORDER\s+IS\s+SHIPPING\s+OVERSEAS\b", "PACKAGING")),
    facts("INSPECTION+PACKAGING", "inspection_scope", (r"\bISPM\b", "PACKAGING")),
    facts("CERTIFICATION", "component", ("", "CERTIFICATION")),
    facts("CERTIFICATION", "certification_type", (r"\bGENERAL\s+MILL\s+CERTIFICATIONS?\b", "GENERAL MILL CERTIFICATIONS")),
    facts("INSULATION", "insulation_scope", *((place, place) for place in ("PLUG PANEL", "HOUSING", "INLET BOX", "SILENCER", "DUCT", "FAN"))),
    facts("INSULATION", "insulation_type", (r"\bACOUSTIC\b|\bSOUND\s+PILLOW\b", "ACOUSTIC"), (r"\bTHERMAL\b", "THERMAL"), (r"\bLAGGING\b", "LAGGING"), (r"\bJACKET(?:ED)?\b", "JACKET")),
    facts("INSULATION", "insulation_material", (r"\bMINERAL\s+WOOL\b", "MINERAL WOOL"), (r"\bFIBERGLASS\b|\bFIBRE\s*GLASS\b", "FIBERGLASS"), given=r"^(?!.*\b(?:ACOUSTIC|SOUND\s+PILLOW|THERMAL|LAGGING|JACKET(?:ED)?)\b)"),
    facts("INSULATION", "insulation_thickness", (rf"^(?=.*{_PACKED}).*?(?:\b(?:INSULATION|LAGGING)\s+({_THICK})|\b({_THICK})\s*\"?\s+(?:INSULATION|LAGGING)\b)", '$1$2"'), (rf"\b(?:INSULATION|LAGGING)\s+({_THICK})\s*\"|\b({_THICK})\s*\"\s+(?:INSULATION|LAGGING)\b", '$1$2"'), (rf"\b(?:INSULATION|LAGGING)\s+({_THICK})|\b({_THICK})\s+(?:INSULATION|LAGGING)\b", "$1$2"), of="said"),
    facts("INSULATION", "insulated_by", (r"\bINSULATED\s+BY\s*:\s*(.*?)(?=\s+(?:VENDOR|PRODUCT|QUOTE NUM(?:BER)?|QUOTE NO|OPERATION)\s*:|$)", "$1"), of="said"),
    facts("LABEL", "label_type", (r"\bSHIPPING\s+BAR\s*CODE\s+LABEL\b", "SHIPPING BARCODE LABEL"), (r"\bFEI\s+LABEL\b", "FEI LABEL"), (r"\bWARNING\s+LABEL\b", "WARNING LABEL"), (r"\bRETIE\s+LABEL\b", "RETIE LABEL"), (r"\bLABEL\s+REQUIRED\s+ON\s+EACH\s+ITEM\b", "ITEM LABEL"), (r"\bMARK\s+ALL\s+ITEMS\b|\bMARKED\s+WITH\s+THIS\s+INFORMATION\b", "ITEM MARKING"), (r"\bSHIPPING\s+LABEL\b", "SHIPPING LABEL")),
    facts("LABEL", "label_scope", (r"\bSHIPPING\s+BAR\s*CODE\s+LABEL\b", "SHIPPING"), (r"\bFEI\s+LABEL\b", ""), (r"^(?=.*FAN).*\bWARNING\s+LABEL\b", "FAN"), (r"\bWARNING\s+LABEL\b", "WARNING"), (r"\bRETIE\s+LABEL\b", "MOTOR"), (r"\bLABEL\s+REQUIRED\s+ON\s+EACH\s+ITEM\b|\bMARK\s+ALL\s+ITEMS\b|\bMARKED\s+WITH\s+THIS\s+INFORMATION\b", "EACH ITEM"), (r"\bSHIPPING\s+LABEL\b", "SHIPPING")),
    facts("LABEL", "label_handling", (r"\bSTICKERS?\s*/?\s*LABELS?.*\bNAMEPLATE\b.*\bBAG\b", "OTHER LABELS/NAMEPLATE BAGGED")),
    facts("MOTOR", "motor_base", (r"\bADJUSTABLE\s+MOTOR\s+BASE\b", "ADJUSTABLE MOTOR BASE")),
    facts("MOTOR", "component", (r"\bC\s*[- ]?\s*FLANGE\b|\bC\s*[- ]?\s*FACE\b|\bFOOT\s*MOUNT(?:ED|ING)?\b|\b(?:WITH|NO|WITHOUT|LESS)\s+FEET\b|\bMULTI\s*MOUNT(?:ING)?\b|\bMOTOR\s+MOUNTING\s+FRAME\b", "MOTOR")),
    facts("MOTOR", "motor_mounting", (r"\bC\s*[- ]?\s*FLANGE\b|\bC\s*[- ]?\s*FACE\b", "C-FLANGE"), (r"\bFOOT\s*MOUNT(?:ED|ING)?\b", "FOOT MOUNTED"), (r"\bWITH\s+FEET\b", "WITH FEET"), (r"\b(?:NO|WITHOUT|LESS)\s+FEET\b", "NO FEET"), (r"\bMULTI\s*MOUNT(?:ING)?\b", "MULTIMOUNTING"), (r"\bMOTOR\s+MOUNTING\s+FRAME\b", "MOTOR MOUNTING FRAME"), every=True),
    facts("NAMEPLATE", "component", (r"^(?!.*\bHOUSING\b)", "NAMEPLATE")),
    facts("NAMEPLATE+HOUSING", "nameplate_mount_location", ("", "HOUSING")),
    facts("NAMEPLATE+HOUSING", "nameplate_mounting", (r"\bRIVETED\s+TO\s+HOUSING\b", "RIVETED")),
    facts("NAMEPLATE+MOTOR", "component", ("", "MOTOR")),
    facts("NAMEPLATE+MOTOR", "motor_nameplate", ("", "YES")),
    facts("NAMEPLATE+MOTOR", "motor_nameplate_action", (r"\bREPLACE\s+NAMEPLATE\b", "REPLACE NAMEPLATE"), (r"\bREPLAT(?:E|ED|ING)\b", "REPLATE"), (r"\bNAMEPLATE\s+RR\b", "REPLACE NAMEPLATE")),
    facts("LIFTING LUGS", "component", ("", "HOUSING")),
    facts("LIFTING LUGS", "lifting_lugs", ("", "YES")),
    facts("SCREEN", "component", (rf"^OUTLET\s+(?:WIRE\s+)?SCREEN\b(?=.*(?:{_SCREEN_RING}))", "SCREEN"), (rf"^INLET\s+(?:WIRE\s+)?SCREEN\b|{_SCREEN_RING}", "INLET SCREEN"), (r"^OUTLET\s+(?:WIRE\s+)?SCREEN\b", "OUTLET SCREEN"), ("", "SCREEN"), of="primary", needs=_SCREEN_ITSELF),
    facts("SCREEN", "screen_subcategory", ("", "SCREEN"), needs=_SCREEN_PART),
    facts("SCREEN", "screen_subcategory", (r"\bTRASH\s+SCREEN\b", "TRASH SCREEN"), (r"\bWIRE\s+SCREEN\b", "WIRE SCREEN GUARD"), (r"\bSCREEN\s+MOUNTING\s+RING\b", "MOUNTING RING"), (r"\bSELF\s+TAPPERS?\b.*\bSCREEN\b|\bSCREEN\b.{0,40}\bHARDWARE\b|\bHARDWARE\b.{0,40}\bSCREEN\b", "HARDWARE"), (_RAINHOOD, "RAINHOOD SCREEN"), every=True),
    facts("SCREEN", "screen_feature", (r"\bOVERSIZED\b", "OVERSIZED"), (r"\bSTANDARD\b", "STANDARD"), (r"\bLASER\s*[- ]?\s*CUT\b", "LASER-CUT"), (r"\bBOLT\s*[- ]?\s*ON\b", "BOLT-ON"), every=True),
    facts("SCREEN", "shipping_state", (r"\bSHIP(?:PED)?\s+LOOSE\b", "SHIPPED LOOSE")),
    facts("SCREEN", "used_on", (_RAINHOOD, "WEATHER COVER"), ("SILENCER", "SILENCER"), every=True, needs=_SCREEN_ITSELF),
    facts("SCREEN", "used_on", (_RAINHOOD, "WEATHER COVER"), (_near_screen("INLET"), "INLET"), (_near_screen("(?:OUTLET|DISCHARGE)"), "OUTLET"), ("SILENCER", "SILENCER"), every=True, needs=_SCREEN_PART),
    facts("SCREEN", "mount_location", (r"\bMOUNTED\s+TO\s+BELL\b", "BELL"), (r"\bMOUNTED\s+TO\s+FAN\b", "FAN"), (r"\bMOUNTED\s+TO\s+INLET\s+CONE\b", "INLET CONE")),
    facts("SCREEN", "screen_diameter", (rf"\bINLET\s+DIA\s+({_THICK})\b", "$1")),
    facts("SCREEN", "screen_size", (r"\bSIZE\s+([0-9]{2,4})\b", "$1"), of="primary"),
    facts("WEATHER COVER", "weather_cover_type", (r"\bDRIP\s*COVER|DRIPCOVER\b", "DRIP COVER"), (r"\bRAIN\s*HOOD|RAINHOOD\b", "RAINHOOD"), ("INLET HOOD", "INLET HOOD"), ("WEATHER HOOD", "WEATHER HOOD"), ("WEATHER COVER", "WEATHER COVER"), ("WEATHER ?PROOF", "WEATHERPROOF"), every=True),
    facts("WEATHER COVER", "weather_cover_used_on", (r"\bINLET\b", "INLET"), (r"\b(?:OUTLET|DISCHARGE)\b", "OUTLET"), every=True),
    facts("WEATHER COVER", "weather_cover_feature", (r"\bINLET\s+SCREEN\b", "INLET SCREEN"), ("TRASH SCREEN", "TRASH SCREEN"), (r"\bGALVANIZ(?:ED|ING)?\s+SCREEN\b", "GALVANIZED SCREEN"), (r"\bFILTER\b", "FILTER"), every=True),
    facts("WEATHER COVER", "weather_cover_scope", (r"^MOTOR\b", "MOTOR"), ("SILENCER", "SILENCER"), every=True),
    facts("WEATHER COVER", "component", (r"^MOTOR\b", "MOTOR"), (r"^(?!.*SILENCER)", "WEATHER COVER")),
    facts("EVASE", "evase_feature", (r"\bDRAIN\b", "DRAIN"), (r"\bBOLTED\b", "BOLTED"), (r"\bWELDED\b", "WELDED"), (r"\bREMOVABLE\b", "REMOVABLE"), (r"\bFLANGED?\b", "FLANGED"), every=True, needs=_OWN_EVASE),
    facts("WEATHER COVER+MOTOR", "weather_cover_scope", ("SILENCER", "MOTOR, SILENCER"), ("", "MOTOR")),
    facts("WEATHER COVER+MOTOR", "component", ("", "MOTOR")),
    facts("SHAFT COOLER", "component", (r"^(?:SHAFT\s+COOLER|HEAT\s+SLINGER)\b", "SHAFT COOLER"), of="primary"),
    facts("SHAFT COOLER", "shaft_cooler_type", (r"\bHEAT\s+SLINGER\b", "HEAT SLINGER")),
    facts("SHAFT COOLER", "shaft_cooler_construction", ("CAST", "CAST")),
    facts(_SEAL, "component", ("", _SEAL)),
    facts(_SEAL, "shaft_seal_type", (r"\bNOT\s+GAS\s+TIGHT\b", "NOT GAS TIGHT"), (r"\bLEAK\s+RESISTANT\b", "LEAK RESISTANT"), (r"\bPTFE\b", "PTFE SEAL RING"), (r"\bDOUBLE\s+CARBON\b", "DOUBLE CARBON"), (r"\bCERAMIC\s+FELT\b", "CERAMIC FELT"), (r"\bLIP\s+SEALS?\b", "LIP SEAL"), (r"\bSTUFFING\s+BOX(?:ES)?\b", "STUFFING BOX"), every=True),
    facts(_SEAL, "manufacturer", (r"\bJOHN\s+CRANE\b", "JOHN CRANE")),
    facts("SHAFT SLEEVE", "component", ("", "SHAFT SLEEVE")),
    facts("SHAFT SLEEVE", "shaft_sleeve", ("", "YES")),
    facts("SHAFT SLEEVE", "shaft_sleeve_type", (r"\bSPLIT\s+SLEEVE\b", "SPLIT SLEEVE")),
    facts("LINING", "lining_type", ("FIRMEX", "FIRMEX"), (r"\bRUBBER\s+LIN", "RUBBER")),
    facts("LINING", "lining_service", ("ABRASION", "ABRASION")),
    facts("LINING", "lining_scope", (r"\bINLET\s+BOX\b", "INLET BOX"), (r"\bSCROLL\b", "HOUSING SCROLL"), (r"\bSIDE\s+SHEET\b", "SIDE SHEET"), (r"\bBLADES?\b", "WHEEL BLADES"), every=True),
    facts("HOUSING", "housing_subcategory", (r"\bSQUARE\s+HOUSING\b|\bHOUSING\s+SQUARE\b", "SQUARE"), (r"\bUNIVERSAL\s+HOUSING\b|\bHOUSING\s+UNIVERSAL\b", "UNIVERSAL"), (r"\b(?:FIRMEX|LINERS?|LINING)\b.*\bHOUSING\b", "LINING"), (r"\b(?:FLANGE\s+THICKNESS|BOLT\s+PATTERN|REINFORCING\s+GUSSETS?)\b", "MODIFIED FLANGE"), (r"^(?=.*\bFLANGE\s+TO\s+FLANGE\b).*\bHOUSING\s+LENGTH\b", "DIMENSION NOTE"), (r"\bHOUSING\s+THICKNESS\b", "THICKNESS"), (r"\bHOUSING\s+STIFF(?:E|NE)R\s+PLATES?\b", "STIFFENER PLATES"), ("CASING EXTENSION", "CASING EXTENSION"), (r"\b(?:TAP\s+DRIVE\s+SIDE\s+HOUSING|TAP\s+.*HOUSING\s+HALF)\b", "TAPPED HOUSING"), (r"\b(?:MOUNT\s+HOUSING|HOUSING\s+MOUNTING|HOUSING\s+TO\s+DRIVE\s+COVER)\b", "MOUNTING/SUPPORT"), (r"\bNAMEPLATE\b.*\bHOUSING\b|\bRIVETED\s+TO\s+HOUSING\b", "NAMEPLATE LOCATION"), every=True),
    facts("HOUSING", "housing_feature", ("FLANGE THICKNESS", "FLANGE THICKNESS"), ("BOLT PATTERN", "BOLT PATTERN"), (r"\bREINFORCING\s+GUSSETS?\b", "REINFORCING GUSSETS"), every=True),
    facts("HOUSING", "housing_dimension", (r"^(?=.*\bFLANGE\s+TO\s+FLANGE\b).*\bHOUSING\s+LENGTH\b", "FLANGE-TO-FLANGE LENGTH")),
    facts("HOUSING", "housing_thickness", (r"\b(\d+\s*GA)\s+HOUSING\s+THICKNESS\b", "$1")),
    facts("HOUSING", "mount_location", (r"\bNAMEPLATE\b.*\bHOUSING\b|\bRIVETED\s+TO\s+HOUSING\b", "HOUSING")),
    facts("", "component", ("", "MOTOR"), given=_CONDUIT),
    facts("", "motor_feature", ("", "CONDUIT BOX LOCATION"), given=_CONDUIT),
    facts("", "motor_conduit_box_location", ("HUGGING", "HUGGING HOUSING"), (r"\bCLOSE\s+TO\b", "CLOSE TO HOUSING"), (r"\b(?:TACK\s+AND\s+WELD|WELD\s+CONDUIT\s+BOX|CONDUIT\s+BOX\s+TO\s+HOUSING)\b", "MOUNTED TO HOUSING"), (r"\b(F[123]|RF)\s+CONDUIT\s+BOX\b", "$1"), given=_CONDUIT),
    facts("", "motor_conduit_box_position", (r"^(?=.*VIEWED FROM OUTLET).*?(?:@\s*)?\b([0-9]{1,2})\s*:?\s*00\b", "$1:00 VIEWED FROM OUTLET"), given=_CONDUIT),
    facts("", "motor_conduit_box_orientation", (r"\bKNOCKOUT\s+FACES?.{0,20}\bDOWNWARD\b", "KNOCKOUT FACES DOWNWARD"), given=_CONDUIT),
    facts("SILENCER", "component", (r"\bINLET\b", "INLET SILENCER"), (r"\b(?:OUTLET|DISCHARGE)\b", "OUTLET SILENCER"), ("", "SILENCER")),
    facts("SILENCER", "component", (r"\b(?:OUTLET|DISCHARGE)\b", "OUTLET SILENCER"), (r"\bINLET\b", "INLET SILENCER"), of="primary"),
    facts("SILENCER", "component", (_OTHER_SILENCER, "OUTLET SILENCER")),
    facts("SILENCER", "component", (_INLET_SILENCER, "INLET SILENCER"), (_OUTLET_SILENCER, "OUTLET SILENCER"), of="primary"),
    facts("SILENCER", "silencer_type", (_OTHER_SILENCER, "CIRCULAR DISCHARGE SILENCER"), needs=rf"^(?!.*{_INLET_SILENCER})"),
    facts("SILENCER", "silencer_type", (r"\bCIRCULAR\s+INLET\s+SILENCER\b", "CIRCULAR INLET SILENCER"), (rf"^(?!.*{_INLET_SILENCER}).*{_OUTLET_SILENCER}", "CIRCULAR DISCHARGE SILENCER"), of="primary"),
    facts("SILENCER", "brand", ("AEROACOUSTIC", "AEROACOUSTIC"), (r"\bVAW\b", "VAW")),
    facts("SILENCER", "model", (r"\bMODEL\s*:?\s*([A-Z0-9]+(?:[.-][A-Z0-9]+)+)\b", model), (r"\b(?:VAW\s+)?SILENCER\s+([0-9A-Z]+VRSB[-\s][A-Z0-9]+)\b", model), (r"\b([0-9]{2}VCIB[-\s]V99[-\s]SN\d+)\b", model), (r"\b((?:CI|IB|SI)[-\s]\d+[-\s][A-Z0-9.]+|[0-9]+[-\s]TA[-\s][A-Z0-9]+)\b", model), of="said"),
    facts("SILENCER", "noise_target", (r"\b(\d{2,3})\s*DBA\b", "$1 DBA")),
    facts("SILENCER", "pressure_drop", (r"\bPRESSURE\s+DROP(?:\s+OF)?\s*:?\s*(\d+(?:\.\d+)?|\.\d+)", "$1"), of="said"),
    *(facts("SILENCER", name, (pattern, "YES")) for name, pattern in (("piezometer_tube", r"\bPIEZOMETER\s+TUBE\b"), ("velocity_tube", r"\bVELOCITY\s+TUBE\b"), ("thermowell_port", r"\bTHERMOWELL\s+PORT\b"), ("trash_screen", r"\bTRASH\s+SCREEN\b"), ("rain_hood", r"\bRAIN\s*HOOD\b"), ("filter", r"\bFILTER\b"), ("support_legs", r"\b(?:SUPPORT|EXTENDED)\s+LEGS?\b"), ("mounting_lugs", r"\bMOUNTING\s+LUGS?\b"), ("lifting_lugs", r"\bLIFTING\s+LUGS?\b"), ("mounting_hardware", r"\bMOUNTING\s+HARDWARE\b"), ("gasket", r"\b(?:H\s*&\s*G|H\s+G|HARDWARE\s+AND\s+GASKET|GASKET)\b"))),
    facts("SILENCER", "drawing_requirement", (r"\bDRAWINGS?\s+FOR\s+(?:THE\s+)?RECORD\b", "DRAWING FOR RECORD")),
    facts("SILENCER", "drawing_requirement", (r"\bPDF\b", "PDF"), (r"\bAUTO\s*CAD\b", "AUTOCAD"), (r"\b3D\b", "3D"), every=True, given=r"\bDRAWINGS?\b"),
    facts("WARRANTY", "note_type", ("", "WARRANTY")),
    facts("WARRANTY", "warranty_type", ("EXTENDED WARRANTY", "EXTENDED WARRANTY"), ("EXCLUSIVE", "EXCLUSIVE WARRANTY"), ("STANDARD", "STANDARD WARRANTY")),
    facts("WARRANTY", "warranty_duration", (r"\b1\s*[- ]?\s*YEARS?\b.{0,40}\bWARRANTY\b|\bWARRANTY\b.{0,80}\b1\s*[- ]?\s*YEARS?\b", "1 YEAR"), (r"\b(?!1\D)(\d+)\s*[- ]?\s*YEARS?\b.{0,40}\bWARRANTY\b", "$1 YEARS"), (r"\bWARRANTY\b.{0,80}\b(?!1\D)(\d+)\s*[- ]?\s*YEARS?\b", "$1 YEARS"), (r"\b1\s*[- ]?\s*MONTHS?\b.{0,40}\bWARRANTY\b|\bWARRANTY\b.{0,80}\b1\s*[- ]?\s*MONTHS?\b", "1 MONTH"), (r"\b(?!1\D)(\d+)\s*[- ]?\s*MONTHS?\b.{0,40}\bWARRANTY\b", "$1 MONTHS"), (r"\bWARRANTY\b.{0,80}\b(?!1\D)(\d+)\s*[- ]?\s*MONTHS?\b", "$1 MONTHS"), every=True),
    facts("WARRANTY", "warranty_scope", ("BUYOUT ITEMS", "BUYOUT ITEMS"), ("MOTOR", "MOTOR"), (r"\bISOLATORS?\b", "VIBRATION ISOLATION"), ("DRIVE SET", "DRIVE COMPONENTS"), every=True),
    facts("WARRANTY", "warranty_start", (r"\b(?:DATE\s+OF\s+SHIPMENT|SHIP\s+DATE)\b", "SHIP DATE")),
    facts("WARRANTY", "warranty_source", ("COMPONENT MANUFACTURER", "COMPONENT MANUFACTURER"), ("VENDOR", "VENDOR")),
    facts("SHIPPING", "shipping_state", (r"\bSHIP(?:PED)?\s+LOOSE\b", "SHIPPED LOOSE")),
    facts("SHIPPING", "shipping_method", (r"\bDIRECT\s+SHIP\b|\bSHIP\b(?:\s+\S+){0,8}\s+DIRECT\b", "SHIP DIRECT"), (r"\bFREIGHT\s+INCLUDED\b", "FREIGHT INCLUDED"), (r"\bUPS\s+GROUND\b", "UPS GROUND"), (r"\bDOMESTIC\s+FREIGHT\b", "DOMESTIC FREIGHT"), every=True),
    facts("SHIPPING", "shipping_instruction", (r"\bSHIP\s+VIA\b", "SHIP VIA"), (r"\bUPDATED\s+SHIP\s+VIA\b", "UPDATED SHIP VIA"), (r"\bSHIP\s+WITH\s+FANS?\b", "SHIP WITH REFERENCED FANS"), (r"\bALL\s+AUXILIARY\s+ITEMS\s+EXCEPT\s+MOTOR\b", "SHIP AUXILIARY ITEMS LOOSE"), (r"\bPICTURES?\b.*\bPRIOR\s+TO\s+SHIPPING\b", "PICTURES PRIOR TO SHIPPING"), (r"\b(?:SHIPPING\s+(?:PAPERS|DOCUMENTS|BOXES)|PACKING\s+LIST|BOL)\b", "SHIPPING DOCUMENTS/MARKING"), (r"\b(?:SHIPPING\s+INSTRUCTIONS?|SHIPPING\s+INFORMATION|INVOICE\s+INSTRUCTIONS)\b", "SHIPPING/INVOICE INSTRUCTIONS"), (r"\bSHIPPING\s+PAPERS\b", "MARK SHIPPING PAPERS"), (r"\bSHIPMENT\s+ONLINE\b", "ENTER SHIPMENT ONLINE"), (r"\bSET\s+UP\s+SHIPMENT\b", "SHIPMENT SETUP DIMENSIONS"), (r"\bSEND\b.{0,80}\bCUSTOMS?\s+DOCUMENTS?\b.{0,80}\bSHIPMENT\b", "SEND CUSTOMS DOCUMENTS"), (r"\bNOT\s+SHIP\s+EARLY\b", "DO NOT SHIP EARLY"), (r"\bSHIP\s+COMPLETE\b|\bNO\s+PARTIAL\b", "SHIP COMPLETE"), (r"\bWEIGHT\b.*\bDIMS?\b|\bDIMS?\b.*\bWEIGHT\b", "PROVIDE WEIGHT/DIMS"), (r"\bMOTOR\s+BASE\b.*\bSHIPPING\s+PURPOSES\b", "MOTOR BASE FOR SHIPPING ONLY"), every=True),
    facts("SHIPPING", "component", (r"\bSHIPPING\s+COVERS?\b", "SHIPPING COVER")),
    facts("TESTING", "component", (r"\bRUN\s+TEST\b", "MECHANICAL RUN TEST"), of="primary"),
    facts("TESTING", "testing_type", (r"\bSOAP\s+BUBBLE\s+PRESSURE\s+TEST\b", "SOAP BUBBLE PRESSURE TEST"), (r"\bOVERSPEED\s+TEST\b", "OVERSPEED TEST"), (r"\bDIMENSIONAL\s+INSPECTION\b", "DIMENSIONAL INSPECTION"), (r"\b(?:IEEE\s*112|ROUTINE\s+TEST)\b", "MOTOR ROUTINE TEST"), (r"\bAMP\s+DRAW\b", "AMP DRAW MEASUREMENT"), (r"\bTEST\s+REPORTS?\b", "TEST REPORT"), every=True),
    facts("TESTING", "testing_status", (r"\bNOT\s+AVAILABLE\b", "NOT AVAILABLE"), (r"\bN\s*/?\s*A\b", "N/A"), every=True),
    facts("TESTING", "witnessed", (r"\bCUSTOMER\s+WITNESS\b", "CUSTOMER"), (r"\bUNWITNESSED\b", "NO")),
    facts("TESTING", "testing_duration", (r"\b(\d+)\s+HOUR\b", "$1 HOUR")),
    facts("TESTING", "testing_measurements", (r"\bAMP\s+DRAW\b", "AMP DRAW"), (r"\bVIBRATION\s+READINGS?\b", "VIBRATION READINGS"), every=True),
    facts("SPARK RESISTANT", "spark_resistant", ("", "YES")),
    facts("SPARK RESISTANT", "spark_resistant_type", (r"\bAMCA\s+(?:TYPE\s+)?([ABC])\b", "AMCA $1"), (r"\bSPARK\s+RESISTANT\s+CONSTRUCTION\s+([ABC])\b", "AMCA $1")),
    facts("", "component", (r"\bBELT\s+GUARD\b", "BELT GUARD"), (_GUARD, "SHAFT/BEARING/COUPLING GUARD"), of="primary"),
    facts("BELT GUARD", "guard_type", ("HINGED", "HINGED")),
    facts("BELT GUARD", "supplied_by", ("PROVIDED BY OTHERS", "OTHERS")),
    facts("BELT GUARD", "guard_material", ("STANDARD STEEL", "STANDARD STEEL")),
    facts("BELT GUARD", "tach_hole", ("TACH HOLE IN GUARD WITH PLUG", "WITH PLUG"), ("TACH HOLE IN GUARD NONE", "NONE")),
    facts("BELT GUARD", "tach_hole_location", ("FAN END", "FAN END"), ("MOTOR END", "MOTOR END"), every=True),
    facts("", "component", (r"\bHOUSING\s+DRAINS?\b", "HOUSING DRAIN"), (r"^(?=.*\bINLET\s+BOX\b).*DRAIN", "INLET BOX DRAIN"), (r"^MOTOR\b.*DRAIN|\bCONDENSATION\s+DRAIN\b|\bCONDUIT\s+BOX\s+DRAIN\b|\bDRAIN\s+HOLES?\b", "MOTOR CONDUIT BOX DRAIN"), ("DRAIN", "DRAIN")),
    facts("DRAIN", "size", (rf"\bDRAIN(?:\s+PLUG)?(?:\s+SIZE)?\s*[:,]?\s*({_DRAIN})\s*{_INCH}", dashed), (rf"\b({_DRAIN})\s*{_INCH}\s*(?:DIAMETER\s+)?(?:HOUSING\s+|INLET\s+BOX\s+|CONDUIT\s+BOX\s+)?DRAIN\b", dashed), ("", "STD"), of="said"),
    facts("", "component", (rf"^(?=.*{LUBE}).*\bMOTOR\s+BEARINGS?\b", "MOTOR"), (rf"^(?=.*{LUBE}).*\bBEARINGS?\b", "BEARINGS"), (rf"^(?=.*{LUBE}).*\bMOTOR\b", "MOTOR")),
    facts("", "component_review", (rf"^(?!.*\b(?:BEARINGS?|MOTOR)\b).*{LUBE}", "UNCLEAR GREASE TARGET - VERIFY MOTOR/BEARINGS/ARRANGEMENT")),
    facts("", "extended_grease_fittings", (LUBE, "YES")),
    facts("", "material", (r"\bALUMINUM\b", "ALUMINUM"), (r"\bSTAINLESS\s+STEEL\b|\bPASSIVAT", "STAINLESS STEEL"), every=True, needs=_NO_OWNER),
    facts("", "component_material", (r"\bALUMINUM\b", "ALUMINUM"), (r"\bSTAINLESS\s+STEEL\b|\bPASSIVAT", "STAINLESS STEEL"), every=True, needs=_OWNER),
    facts("", "material_grade", *_GRADES, every=True, needs=_NO_OWNER),
    facts("", "component_material_grade", *_GRADES, every=True, needs=_OWNER),
    facts("", "material_treatment", (r"^(?=.*WELDS).*\bPASSIVAT", "PASSIVATION OF WELDS"), (r"\bPASSIVAT", "PASSIVATION")),
    facts("", "balance_grade", (r"\bG\s*(\d+(?:\.\d+)?)\s+BALANCE\b", "G$1")),
    facts("", "balance_type", (r"\bWELDED\s+BALANCE\s+WEIGHTS?\b", "WELDED BALANCE WEIGHTS")),
    facts("", "component", (r"\bG\s*\d+(?:\.\d+)?\s+BALANCE\b|\bWELDED\s+BALANCE\s+WEIGHTS?\b", "BALANCE")),
    facts("", "bearing_type", *_BEARING_TYPES),
    facts("", "bearing_life_adder", (r"\bBEARING\s+ADDER\b", "YES")),
    facts("", "bearing_bore", (_BORE, dashed), of="said"),
    facts("", "bearing_life_hours", (_HOURS, grouped), of="said"),
    facts("EVASE", "component", ("", "EVASE"), needs=_OWN_EVASE),
    facts("DRIVE COMPONENTS", "max_rpm", (r"MAX/MIN RPM:\s*(\d+)\s*/\s*\d+", "$1"), of="said"),
    facts("DRIVE COMPONENTS", "min_rpm", (r"MAX/MIN RPM:\s*\d+\s*/\s*(\d+)", "$1"), of="said"),
    facts("DRIVE COMPONENTS", "belt_qty", (r"\b(\d+)\s+BELTS?\s*:\s*[A-Z0-9-]+", "$1"), of="said"),
    facts("DRIVE COMPONENTS", "belt", (r"\b\d+\s+BELTS?\s*:\s*([A-Z0-9-]+)", "$1"), of="said"),
    facts("DRIVE COMPONENTS", "actual_sf", (r"\bACTUAL SF\s*:\s*([0-9.]+)", "$1"), of="said"),
    facts("DRIVE COMPONENTS", "actual_cd", (r"\bACTUAL CD\s*:\s*([0-9.]+)", "$1"), of="said"),
    facts("DRIVE COMPONENTS", "service_factor", (r"SPECIFIED MINIMUM BELT SERVICE FACTOR:\s*([0-9.]+)", "$1"), (r"CONSTANT SPEED,\s*SF:\s*([0-9.]+)", "$1"), of="said"),
    facts("DRIVE COMPONENTS", "drive_subcategory", (r"^CENTER\s+DISTANCE\b", "CENTER DISTANCE"), (r"^(?:SPARE\s+)?V\s*[- ]?\s*BELT\s+DRIVE\b", "V-BELT DRIVE"), (r"^(?:NPO\s+)?(?:REPAIR|REPLACEMENT)\s+DRIVE\s+SET\b", "DRIVE SET"), (r"\b(?:MOTOR|MTR|FAN)\s+SHEAVE\b|\bSHEAVE\s*/?\s+BUSHING\b", "SHEAVE/BUSHING"), (r"\bCENTER\s+DISTANCE\b", "CENTER DISTANCE"), (r"\bDRIVE\s+SET\b", "DRIVE SET"), ("", "V-BELT DRIVE")),
    facts("", "pct_width_customer", (r"(\d{1,3}(?:\.\d+)?)\s*%", "$1%"), of="said", needs=r"^PERCENT\s+WIDTH\b"),
    facts("", "door_type", (r"\bQUICK\s+CLAMP\b", "QUICK CLAMP"), (r"\bBOLT[ -]?ON\b|\bBOLTED\b", "BOLT-ON"), (r"\bRAISED\b", "RAISED"), given=r"\bACCESS\s+DOOR\b"),
    facts("", "door_location", (r"^(?=.*\bACCESS\s+DOOR\b).*?\bDOOR\s+LOCATION\s*:?\s*@?\s*(\d{1,2}(?::\d{2})?)", "$1"), of="said"),
    facts("", "vendor", (r"(?i)\bVENDOR\s*:\s*(.*?)(?=\s+(?:PRODUCT|QUOTE NUM(?:BER)?|QUOTE NO|OPERATION)\s*:|$)", "$1"), of="said"),
    facts("", "product", (r"(?i)\bPRODUCT\s*:\s*(.*?)(?=\s+(?:VENDOR|QUOTE NUM(?:BER)?|QUOTE NO|OPERATION)\s*:|$)", "$1"), of="said"),
    facts("", "quote_number", (r"(?i)\bQUOTE\s+(?:NUM(?:BER)?|NO)\s*:\s*(.*?)(?=\s+(?:VENDOR|PRODUCT|OPERATION)\s*:|$)", "$1"), of="said"),
]


# fixed values: what a line is of that names no component and belongs to none, by rank
CLAIMS = (("PERCENT WIDTH", r"^PERCENT\s+WIDTH\b"), ("SHRINK WRAP", r"\bSHRINK\s*WRAP\b"), ("ACCESS DOOR", r"\bACCESS\s+DOOR\b"))


def _value(text: Column, pattern: str, value: Value) -> Column:
    if value in WHOLE_TEXT:
        return value(text, pattern)
    if callable(value):
        return value(F.regexp_extract(text, pattern, 1))
    if "$" not in value:
        return F.lit(value)
    first, _, rest = value.partition("$1")
    second = rest.partition("$2")
    return F.concat(F.lit(first), F.regexp_extract(text, pattern, 1), F.lit(second[0]), *((F.regexp_extract(text, pattern, 2), F.lit(second[2])) if second[1] else ()))


def stated(fact: Fact, texts: dict[str, Column], tags: Column) -> Column:
    """The fact's value, or null."""
    text = texts[fact.of]
    met = [(F.lit(True) if p == "" else text.rlike(p), _value(text, p, v)) for p, v in fact.choices]
    if fact.every:
        value = F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(*(F.when(on, v) for on, v in met)))), ", "), F.lit(""))
    else:
        value = F.coalesce(*(F.when(on, v) for on, v in met))
    needed = [F.array_contains(tags, t) for t in fact.tag.split("+") if t] + ([texts["primary"].rlike(fact.needs)] if fact.needs else [])
    for condition in needed + ([text.rlike(fact.given)] if fact.given else []):
        value = F.when(condition, value)
    return value


def attributes(texts: dict[str, Column], tags: Column, table: list[Fact] | None = None) -> Column:
    """map of what the texts say, without empty values. `used_on` is the owner that they name, `temperature_rating` the temperatures
    beyond the limits."""
    named: dict[str, list[Column]] = {}
    for fact in FACTS if table is None else table:
        named.setdefault(fact.name, []).append(stated(fact, texts, tags))
    belongs = F.when(~F.array_contains(tags, "SPARE PARTS"), F.array_join(owners(texts["blob"]), ", "))
    hot = F.concat_ws(" ", texts["blob"], texts["said"])
    beyond = extreme_values(hot)
    low = hot.rlike(r"\bLOW\s+TEMP(?:ERATURE)?\b") | F.exists(beyond, lambda v: v.startswith("-"))
    high = hot.rlike(r"\b(?:HIGH\s+TEMP(?:ERATURE)?|HEAT\s+FAN)\b") | F.exists(beyond, lambda v: ~v.startswith("-"))
    more = {
        "temperature_rating": F.array_join(beyond, ", "),
        "temperature_service": F.concat_ws(", ", F.when(low, "LOW TEMPERATURE"), F.when(high, "HIGH TEMPERATURE")),
    }
    last = {name: F.coalesce(*reversed(values)) for name, values in named.items()} | more
    spare = F.array_contains(tags, "SPARE PARTS")
    owner = F.when(F.array_contains(tags, "SHAFT SLEEVE"), F.lit("SHAFT")).otherwise(F.coalesce(F.nullif(belongs, F.lit("")), F.when(~spare, last.get("used_on", F.lit(None)))))
    claimed = F.coalesce(*(F.when(texts["blob"].rlike(p), F.lit(name)) for name, p in CLAIMS))
    last |= {"used_on": owner, "component": F.coalesce(last.get("component", F.lit(None)), F.when(owner.isNull(), claimed))}
    entries = F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in sorted(last.items(), key=lambda x: x[0])))
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


SILENCERS = ("INLET SILENCER", "OUTLET SILENCER", "SILENCER")
JOINTS = ("INLET EXPANSION JOINT", "OUTLET EXPANSION JOINT", "EXPANSION JOINT")


def without_own(known: Column) -> Column:
    """A damper is not used on itself, and a silencer or joint not on what it is named by."""
    alone = ["FRESH AIR DAMPER", "OUTLET DAMPER", "PRESPIN DAMPER", "INLET VANE DAMPER", "IVC", *SILENCERS, *JOINTS]
    return F.when(F.coalesce(F.try_element_at(known, F.lit("component")).isin(alone), F.lit(False)), F.map_filter(known, lambda k, _: k != "used_on")).otherwise(known)
