"""Rules of the text functions. A rule file may add to them."""

# fixed values: lines that are never items
SKIP = [
    r"^\s*c\s*/?\s*o\s*#?\s*\d",
    r"^v\d+\.\d+",
    r"^(sub\s*)?total\b",
    r"total\s+(billing|price|order|commission)",
    r"^amount\s+due",
    r"^list\s+total\b",
    r"deduction",
    r"^freight\b",
    r"^fob\b",
    r"^(sales\s+)?tax\b",
    r"surcharge",
    r"^lead\s+time\b",
    r"^customs\s+invoice\b",
    r"^type\s+price\b",
    r"^max\s+temp,\s+elevation,\s+density\b",
    r"^page\s+\d+",
    r"^\d+\s+of\s+\d+$",
    r"^sales\s+order\b",
    r"^order\s*#",
    r"^order\s+(no|number|date)\b",
    r"^job\s+(no|number)\b",
    r"^job\s+name\s*:",
    r"^location\s*:",
    r"^sold\s+to\b",
    r"^ship\s+to\b",
    r"^bill\s+to\b",
    r"^customer\s+(po|p\.o\.|order|#|contact)",
    r"^p\.?\s*o\.?\s*(no|number|#)",
    r"^terms\b",
    r"^net\s+\d+",
    r"^quote\b",
    r"^quotation\b",
    r"^phone\b",
    r"^fax\b",
    r"^www\.",
    r"\w@\w",
    r"^date\b",
    r"^entered\s+by\b",
    r"^salesman\b",
    r"^rep\b",
    r"^sales\s+office\b",
    r"^splits?\b",
    r"list\s+price",
    r"multiplier",
    r"^unit\s+price",
    r"^price\s+each",
    r"^discount\b",
    r"^see\s+(additional|special)\b",
    r"^warranty\b",
    r"^commission\s+override\b",
    r"\b(charge|fee)\b",
    r"^prints?\s*:?\s*$",
    r"^product\s*:?\s*$",
    r"^product\s+\$?\d",
    r"^additional\s+shipping\s+notes?\b",
    r"^traffic\s+note\b",
    r"shipping\s+barcode",
    r"^(?!.*\bdrawings?\b).*do\s+not\s+stack",
    r"no\s+metal\s+banding",
    r"^order\s+is\s+shipping\s+overseas\b",
    r"^customer\s+broker\b",
    r"^standard\s+address\b",
    r"^https?\b",
    r"^(last\s+choice\s+)?(fedex|ups)\b",
    r"^please\s+send\b",
    r"^if\s+the\s+shipment\b",
    r"^lbs\.?\s+contact\b",
    r"^above\s+email\s+after\b",
    r"^as\s+well\b",
    r"^appointment\s+required\b",
    r"^for\s+(orders|packages)\b",
    r"^with\s+a\s+ship\s+date\b",
    r"^contact\s*$",
    r"^must\s+(appear|be)\b",
    r"^reference\s+sn\b",
    r"\bppap\b",
    r"^kindly\s+note\b",
    r"^please\s+confirm\b",
    r"^be\s+necessary\b.*\bfor\s+more\s+information\b",
    r"^fan\s+drawings?\b",
    r"^motor\s+prints?\b",
    r"^motor\s+data\s+sheets?\b",
    r"^buyout\s+prints?\b",
    r"^emailed\b",
    r"^mailed\b",
    r"^o\s*&\s*m\b",
    r"^other\s*$",
    r"^special\s+invoicing\b",
]
# fixed values: short lines that open a section
SECTION_START = [
    r"^additional\s+features?\b",
    r"^special\s+features?\b",
    r"^accessor(y|ies)\b",
    r"^features?\s*:?\s*$",
    r"^options?\s*:?\s*$",
    r"^includes?\s*:?\s*$",
    r"^scope\s+of\s+supply\b",
]
# fixed values: lines that close an open section
SECTION_END = [
    r"^notes?\b",
    r"^tag\b",
    r"^nameplate\b",
    r"^total\b",
    r"^sold\s+to\b",
    r"^ship\s+to\b",
    r"^terms\b",
    r"^approval\b",
    r"^signature\b",
    r"^change\s+order",
    r"^fan\s+drawings?\b",
    r"^special\s+invoicing\b",
]
# fixed values: slots of components: id, group, weight, words of names, beginnings of attributes
SLOTS = [
    ("damper", "accessories", 0.02, ["DAMPER", "IVC", "INLET VANE", "VOLUME CONTROL"], ["damper_", "ivc_"]),
    ("actuator", "accessories", 0.015, ["ACTUATOR", "POSITIONER"], ["actuator_", "positioner_"]),
    ("silencer", "accessories", 0.01, ["SILENCER", "MUFFLER"], ["silencer_"]),
    ("door-drain", "accessories", 0.01, ["ACCESS DOOR", "INSPECTION DOOR", "DRAIN", "PRESSURE TAP"], ["door_"]),
    ("base-isolation", "accessories", 0.02, ["UNITARY BASE", "VIBRATION BASE", "STRUCTURAL BASE", "BASE FRAME", "T-RAIL", "ISOLATOR", "ISOLATION"], ["unitary_base_", "isolation_"]),
    ("cover-screen-guard", "accessories", 0.02, ["WEATHER COVER", "SCREEN", "GUARD"], ["weather_cover_", "screen_", "guard_"]),
    ("flex-connector", "accessories", 0.005, ["FLEX CONNECTOR", "FLEXIBLE CONNECTOR", "EXPANSION JOINT"], ["flex_connector_"]),
    ("motor", "motor", 0.08, ["MOTOR"], ["motor_"]),
    ("drive-vfd", "motor", 0.04, ["DRIVE", "VFD", "VARIABLE FREQUENCY"], ["drive_", "vfd_"]),
    ("coupling-belt", "motor", 0.03, ["COUPLING", "BELT", "SHEAVE", "BUSHING"], ["coupling_", "belt_"]),
    ("wheel", "construction", 0.045, ["WHEEL"], ["wheel_"]),
    ("housing", "construction", 0.035, ["HOUSING"], ["housing_"]),
    ("inlet", "construction", 0.025, ["INLET"], ["inlet_"]),
    ("outlet", "construction", 0.025, ["OUTLET", "DISCHARGE"], ["outlet_"]),
    ("shaft-bearing", "construction", 0.035, ["SHAFT", "BEARING", "SEAL", "SLEEVE", "COOLER"], ["shaft_", "bearing_"]),
    ("materials", "construction", 0.035, ["MATERIAL", "STAINLESS", "ALUMINUM"], ["material_"]),
    ("finish", "construction", 0.03, ["COATING", "PAINT", "PRIMER", "EPOXY", "LINING", "INSULATION"], ["coating_", "lining_", "insulation_"]),
    ("special", "construction", 0.02, ["SPECIAL CONSTRUCTION", "SPARK", "SPLIT", "FLANGE"], ["special_construction_", "spark_", "split_", "flange_"]),
]
# fixed values: attributes and components that say nothing about likeness
IGNORED_ATTRIBUTES = r"^(?:applies_to|component|description|drawing_|inquiry_num|job_number|label_|note(?:_|$)|quote_number|referenced_po|related_nameplate_|ship_|shipping_|used_on|vendor_quote|warranty_)"
IGNORED_COMPONENTS = r"(?:\bBASE FAN\b|\bPERCENT WIDTH\b|\bRUN TEST\b|\bINSPECTION\b|\bDRAWINGS?\b|\bTRANSMITTAL\b|\bNAMEPLATE\b|\bLABEL\b|\bMARK\b|\bSHIP(?:PING)?\b|\bFREIGHT\b|\bCRAT(?:E|ING)\b|\bPACKING\b|\bTRUCKING\b|\bSKID\b|\bPAYMODE\b|\bSLOW PAY\b|\bINVOICE\b|\bWARRANTY\b)"
# fixed values: abbreviations and what they stand for
ABBREVIATIONS = {
    "W/": "WITH",
    "W/O": "WITHOUT",
    "C/W": "COMPLETE WITH",
    "SS": "STAINLESS STEEL",
    "S/S": "STAINLESS STEEL",
    "SST": "STAINLESS STEEL",
    "STL": "STEEL",
    "GALV": "GALVANIZED",
    "ALUM": "ALUMINUM",
    "ALUMINIUM": "ALUMINUM",
    "CONST": "CONSTRUCTION",
    "CONSTR": "CONSTRUCTION",
    "ARR": "ARRANGEMENT",
    "ARRG": "ARRANGEMENT",
    "ARRGT": "ARRANGEMENT",
    "ASSY": "ASSEMBLY",
    "MTR": "MOTOR",
    "TEMP": "TEMPERATURE",
    "FA": "FRESH AIR",
    "BRG": "BEARING",
    "BRGS": "BEARINGS",
    "SLV": "SLEEVE",
    "HSG": "HOUSING",
    "WHL": "WHEEL",
    "CONN": "CONNECTOR",
    "HVY": "HEAVY",
    "DTY": "DUTY",
    "HD": "HEAVY DUTY",
    "XP": "EXPLOSION PROOF",
    "EXPL": "EXPLOSION",
    "IVD": "INLET VANE DAMPER",
}

# fixed values: tags, each with the patterns that give it (any of them, upper or lower case)
TAGS = {
    "BASE FAN": [r"^base\s+fan\b"],
    "ACTUATOR": [r"\bactuator\b"],
    "SPARK RESISTANT": [r"spark", r"\bAMCA\s+(?:TYPE\s+)?[ABC]\b"],
    "SHAFT SEAL": [r"shaft\s*seal", r"stuffing\s*box", r"lip\s*seal", r"ceramic\s*felt"],
    "SHAFT SLEEVE": [r"shaft\s*sleeve"],
    "SHAFT COOLER": [r"shaft\s*cooler", r"heat\s*slinger"],
    "MATERIALS": [r"stainless", r"\b304L?\b", r"\b316L?\b", r"passivat", r"aluminum", r"aluminium"],
    "STAINLESS STEEL": [r"stainless", r"\b304L?\b", r"\b316L?\b", r"passivat"],
    "ALUMINUM": [r"aluminum", r"aluminium"],
    "EXTREME TEMP": [r"high\s*temp", r"heat\s*fan", r"low\s*temp", r"\bsuitable\s+for\s+-?\d{2,3}\s*(?:F|C)\b", r"\brated\s+for\s+\d{3}\s*F\b", r"\bto\s*-?\d{2,3}\s*(?:deg(?:ree)?\s*)?C\b", r"\b-\s*\d{2,3}\s*C\s+temperature\b"],
    "HEAVY DUTY": [r"heavy\s*duty"],
    "LOW LEAKAGE": [r"low\s*[- ]?leak(?:age)?"],
    "COATING": [r"epoxy", r"\bcoat(?:ed|ing|s)?\b", r"paint", r"primer", r"plasite", r"heresite", r"\bzinc\b"],
    "LINING": [r"rubber\s*lin", r"\bliners?\b", r"\blined\b", r"\blining\b", r"abrasion", r"firmex"],
    "INSULATION": [r"insulat", r"\b(?:housing|fan)\b.*\b(lagging|jacket(?:ed)?|mineral\s+wool|fiberglass|fibre\s*glass)\b", r"\b(lagging|jacket(?:ed)?|mineral\s+wool|fiberglass|fibre\s*glass)\b.*\b(?:housing|fan)\b"],
    "VIBRATION ISOLATION": [r"\bisolators?\b", r"vibration\s*isolat(?:ion|ors?)", r"rubber[\s-]*in[\s-]*shear", r"\bRIS\b", r"spring\s*mount", r"seismic", r"vibration\s*base"],
    "VIBRATION SWITCH": [r"vibration\s*(switch|detector|monitor|sensor)"],
    "DAMPER": [r"damper", r"backdraft", r"volume\s*control"],
    "INLET VANES": [r"inlet\s*vane", r"\bVIV\b", r"\bIVC\b", r"variable\s*inlet", r"inlet\s*volume\s*control"],
    "INLET": [r"\binlet\s+(open|slip|bell|cone|box|tube|flanged|punched|venturi)", r"\binlet\s+direction"],
    "MIXING BOX": [r"\bmixing\s+box\b"],
    "OUTLET": [r"\boutlet\s+(open|slip|flanged|punched|pressure\s*tap|volume\s*control)", r"\bslip\s+outlet\b", r"\bdischarge\s+elbow"],
    "EVASE": [r"\bevas[eé]e?\b"],
    "WHEEL": [r"\bwheel\b", r"\bpercent\s+width\b", r"%\s*width\b", r"effective\s*diameter", r"cast\s*hub", r"taper\s*lock\s*bushing", r"taperlock\s*bushing"],
    "HOUSING": [r"\bhousing\b"],
    "SPLIT HOUSING": [r"\bsplit\s+housings?\b", r"\bshipping\s+splits?\b", r"\bhousings?\b.*\bsplit\b.*\b(ship|shipping|shipment)\b"],
    "SILENCER": [r"silencer", r"muffler", r"sound\s*atten"],
    "ACCESS DOOR": [r"access\s*door", r"inspection\s*door", r"clean\s*out", r"quick\s*open"],
    "DRAIN": [r"\bdrain"],
    "BELT GUARD": [r"belt\s*guard"],
    "FILTER": [r"\bfilter(?:s|\s+box(?:es)?)?\b"],
    "SHAFT/BEARING/COUPLING GUARD": [r"\bshaft\b.*\bbearing\b.*\bguard\b", r"\bguard\b.*\bshaft\b.*\bbearing\b"],
    "WEATHER COVER": [r"weather\s*(cover|hood|proof)", r"rain\s*hood", r"rainhood", r"drip\s*cover", r"dripcover", r"\binlet\s+hood\b"],
    "SCREEN": [r"\bscreen"],
    "FLANGE": [r"flange"],
    "FLEX CONNECTOR": [r"flex(ible)?\s*conn", r"expan(?:s|t)ion\s*joint"],
    "COUPLING": [r"flexible\s*coupling", r"steelflex", r"thomas\s+series", r"\bhalf\s+coupling\b", r"^mounting\s+options?\s*:?[ ]*both\s+halves\b"],
    "UNITARY BASE": [r"unitary\s*base", r"structural\s*(steel\s*)?base", r"channel\s*base", r"\bt\s*rails?\b", r"\boffset\s+base\b"],
    "BEARINGS": [r"^bearings?\s+(standard|split\s+pillow\s+block)\b", r"^repair\s+bearings?\b", r"^spare\s+bearings?\b", r"^bearing\s+adder\b"],
    "LIFTING LUGS": [r"lifting\s*lugs?"],
    "LABEL": [r"\blabel\b", r"\bmark\s+all\s+items\b", r"\bmarked\s+with\s+this\s+information\b"],
    "NAMEPLATE": [r"nameplate"],
    "PACKAGING": [r"\bcrate\b", r"\bcrating\b", r"shrink\s*wrap", r"\bskid\b", r"\bISPM\b", r"do\s*not\s*stack", r"metal\s*banding"],
    "SHIPPING": [r"\bship(?:ped|ping|ments?)?\b", r"freight", r"\bBOL\b", r"\bUPS\s+ground\b"],
    "WARRANTY": [r"warranty"],
    "MOUNTING": [r"\bmounting\b", r"\bmounted\b"],
    "SPECIAL CONSTRUCTION": [r"set\s*screws?", r"loc\s*tite", r"\bcaulk(?:ing)?\b", r"\bweld(?:ing)?\b", r"tie\s*rod\s*support", r"buffer\s*tube", r"cast\s*hub", r"plug\s*panel", r"pressure\s*tap", r"\bconduit\b", r"\boverhang\b", r"effective\s*diameter", r"threaded\s*plug", r"hole\s*diameters?", r"panel\s+mounting\s+holes?", r"blade\s*side\s+guard", r"piezometer\s+rings?", r"earthing\s*boss"],
    "INSPECTION": [r"\binspection\b", r"\bISPM\b"],
    "CERTIFICATION": [r"\bgeneral\s+mill\s+certifications?\b"],
    "DRAWINGS": [r"\bcertified\s*drawings?\b", r"\bprints?\b", r"\bdrawings?\b"],
    "FAN DRAWING WEIGHTS": [r"\b(?:fan|accessor(?:y|ies)|motor|total)\s+weights?\b.*\bfan\s+drawings?\b"],
    "THREADED PLUG FOR CONDUIT BOX OPENING": [r"\bthreaded\s+plug\b.*\bconduit\s+box\b"],
    "MOTOR": [r"\bmotor\b", r"\bc\s*[- ]?\s*flange\b"],
    "VFD": [r"\bVFD\b", r"variable\s*freq", r"inverter"],
    "EXPLOSION PROOF": [r"explosion(?:\s|;|-)*proof", r"class\s*i+\b.*div"],
    "DRIVE COMPONENTS": [r"^drive\b", r"v[\s-]*belt", r"drive\s*set", r"sheave\s*/?\s*bushing", r"\bsheave\b", r"\b(?:motor|mtr|fan)\s+bushing\b", r"\bactual\s+sf\b", r"\bactual\s+cd\b", r"selected\s+drive", r"center\s+distance", r"^\d{3,4}\s+\d{3,4}\s+[A-Z]{1,2}\d+\s+\d+\s+"],
    "BALANCE": [r"\bG\s*\d+(?:\.\d+)?\s+balance\b", r"welded\s+balance\s+weights?"],
    "TESTING": [r"witness", r"\btest"],
    "SPARE PARTS": [r"\bspare\b", r"^(?:npo\s+)?(?:repair|replacement)\b"],
    "3D STEP DRAWINGS": [r"3\s*-?\s*d(?:[\s\-_]*step)?(?:[\s\-_]*file)?[\s\-_]*drawings?", r"3\s*-?\s*d[\s\-_]*step"],
}


def merged(tags: dict[str, list[str]], more: dict[str, list[str]]) -> dict[str, list[str]]:
    """Tags with further patterns and further tags; none goes."""
    return {t: [*tags.get(t, []), *(p for p in more.get(t, []) if p not in tags.get(t, []))] for t in [*tags, *(t for t in more if t not in tags)]}
