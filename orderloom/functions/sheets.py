"""What order documents say, read from their lines: order numbers and kinds, specs, outline tables, pages of one arrangement, context
of an order, and the type and text of files' bytes. All are column expressions; a document's lines are an array in its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions.text import let, order_number

# fixed values: where a document's own number stands, by rank, and what names its kind
NUMBERS = [
    ("order-job-table", r"\bOrder\s*#\s+Job\s*#[^\r\n]*(?:\r?\n)+\s*([0-9]{5,7}[A-Z]?)\b"),
    ("header", r"\bOrder\s*#\s*(?:Rep\s*Ref\.?\s*#|RepRef\.?\s*#)[^\r\n]*(?:\r?\n)+[ \t]*([0-9]{5,7}[A-Z]?)\b"),
    ("inline", r"\bOrder\s*#\s*[:\-]?\s*([0-9]{5,7}[A-Z]?)\b"),
    ("order-verification-table", r"\bOrder\s+Cust\s+PO\s+Ship\s+Via\s+Package\s+Prepaid\s+Date\s+Order\s+Terms\s+Verification\s+Date\s*(?:\r?\n)+\s*([0-9]{5,7}[A-Z]?)\b"),
    ("sales-order-label", r"\bSales\s+Order\s+(?:No\.?\s*)?([0-9]{5,7}[A-Z]?)\b"),
]
WEAK = ["header", "inline", "sales-order-label"]
VERIFICATION, SALES = r"\bOrder\s+Verification\s+Report\b", r"\bSales\s+Order\b"
# fixed values: labels of spec cells, the old comma line's heading, its end, arrangements and names of wheels
CELL = r"^(DesignTemp|MaxTemp|Design|Size|Arrangement|MotorPos|Class|Rotation|Discharge|%Width|WheelType)\b\s*(.*)$"
LABELS = ["Design", "Size", "Arrangement", "MotorPos", "Class", "Rotation", "Discharge", "%Width", "WheelType", "DesignTemp", "MaxTemp"]
DESIGN_INFO = r"^\s*Design\s+Info\s*$"
SECTION_STOP = r"^(?:_+|Performance\b|Base\s+Fan\b|Inquiry\b|Motor\b|CSIV\w*\b|\S+@\S+)"
ARRANGEMENT = r"^((?:A/[A-Z0-9-]+(?:\s+[A-Z])?)|(?:Arrangement\s+[A-Z0-9/-]+))(?:\s|$)"
WHEELS = {"airfoil": "AF", "backward curved": "BC", "backward inclined": "BI", "forward curved": "FC", "radial blade": "RB"}
TEMPERATURE = r"\s+(-?\d+(?:\.\d+)?(?:[ \t]*(?:°[ \t]*)?[CF]\b)?)"
# fixed values: rows of an outline table, its begin and end, names of its codes; lines between pages and the arrangement of a page
OUTLINE_ROW = r"^\s*([A-Z]{1,3}(?:/\d)?)\s{2,}([A-Z][A-Z0-9 ./&\-]+?)\s{2,}(\d+(?:\s+\d+/\d+)?)\s{2,}\d+\s*$"
OUTLINE_NAMES = {
    "A": "Discharge Height (A)", "W": "Bottom of Disch to CL (W)",
    "KK": "Outlet/Inlet Flange (KK)", "E": "Discharge Flange to CL (E)",
    "RB": "Unitary Base to CL (RB)", "RM": "Motor CL to Fan CL (RM)",
    "F/2": "Base to CL (F)", "H": "Shaft Height (H)",
    "TV": "Total Vert Height (TV)", "RH": "Max Right of CL to Hsg (RH)",
    "LH": "Max Left of CL to Disch (LH)", "MA": "Mounting Channel (MA)",
    "D": "Base Flange to CL (D)", "K": "Drive End of Shaft to CL (K)",
    "N": "Housing Width (N)", "LR": "Mtg Flange to CL (LR)",
}
PAGE, PAGE_ARRANGEMENT = r"^\s*-{15,}\s*$", r"\bARR\s+(\d[0-9A-Z]*)"
# fixed values: an order's context in its lines
PARTS_ONLY, CONTEXT_ARRANGEMENT = r"\bSALES\s+ORDER\s+FOR\s+(?:REPAIR\s+)?PARTS\b", r"\bARRANGEMENT\s*:?[ ]*([A-Z]?\s*/?\s*\d+[A-Z]?)\b"
# fixed values: first bytes of files, and letters of the bytes 80 to 9F (the five that have none become the replacement sign)
MAGIC = [("255044462D", ".pdf"), ("504B0304", ".zip"), ("D0CF11E0A1B11AE1", ".bin")]
INSIDE = [("xl/workbook.xml", ".xlsx"), ("word/document.xml", ".docx")]
HIGH = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"


def _any_case(pattern: str) -> str:
    return f"(?i){pattern}"


def own_number(text: Column) -> Column:
    """struct(number, method): the number that a document gives as its own, by the first of NUMBERS that it has."""
    out = F.struct(F.lit("").alias("number"), F.lit("none").alias("method"))
    for method, pattern in reversed(NUMBERS):
        found = F.regexp_extract(text, _any_case(pattern), 1)
        out = F.when(found != "", F.struct(order_number(found).alias("number"), F.lit(method).alias("method"))).otherwise(out)
    return out


def document_kind(text: Column) -> Column:
    verification = text.rlike(_any_case(VERIFICATION)) | text.rlike(_any_case(dict(NUMBERS)["order-verification-table"]))
    return F.when(verification, "ORDER_VERIFICATION").when(text.rlike(_any_case(SALES)), "SALES_ORDER").otherwise("UNKNOWN")


def validated(expected: Column, text: Column, required: str | None = None) -> Column:
    """struct(status, number, method, kind) of a document (null: it could not be read) held against an order's number. A number that
    differs is a mismatch, unless a sales order gives it at a place that once meant something else; the right number on another kind
    than required is WRONG_DOCUMENT."""
    wanted = order_number(expected)

    def of(own: Column, kind: Column) -> Column:
        sales = kind == "SALES_ORDER"
        status = (
            F.when(own["number"] == "", F.when(sales, "UNVERIFIABLE").otherwise("UNREADABLE"))
            .when(own["number"] != wanted, F.when(sales & own["method"].isin(WEAK), "UNVERIFIABLE").otherwise("MISMATCH"))
            .when(kind != required if required else F.lit(False), "WRONG_DOCUMENT")
            .otherwise("MATCH")
        )
        return F.struct(status.alias("status"), own["number"].alias("number"), own["method"].alias("method"), kind.alias("kind"))

    error = F.struct(F.lit("ERROR").alias("status"), F.lit("").alias("number"), F.lit("none").alias("method"), F.lit("UNKNOWN").alias("kind"))
    return F.when(text.isNull(), error).otherwise(let(own_number(text), lambda own: let(document_kind(text), lambda kind: of(own, kind))))


def spec_cells(cells: Column) -> Column:
    """label -> value of the cells (an array) `Label value`; the first filled one of a label counts."""
    flat = F.transform(F.filter(cells, F.isnotnull), lambda c: F.trim(F.regexp_replace(c, "\n", " ")))
    label = lambda c: F.lower(F.regexp_extract(c, _any_case(CELL), 1))
    pairs = F.transform(flat, lambda c: F.struct(label(c).alias("l"), F.trim(F.regexp_extract(c, _any_case(CELL), 2)).alias("v")))
    known = F.filter(pairs, lambda p: (p["l"] != "") & (p["v"] != ""))
    names = F.array(*map(F.lit, LABELS))
    first = lambda ps, n: F.get(F.filter(ps, lambda p: p["l"] == F.lower(n)), F.lit(0))
    return let(known, lambda ps: F.map_from_entries(F.filter(F.transform(names, lambda n: F.struct(n.alias("key"), first(ps, n)["v"].alias("value"))), lambda e: e["value"].isNotNull())))


def between(lines: Column, opens: Callable[[Column], Column], closes: Callable[[Column], Column]) -> Column:
    """Lines after the first for which opens() holds, up to the next for which closes() does."""

    def step(acc: Column, line: Column) -> Column:
        state = F.when((acc["state"] == 0) & opens(line), 1).when((acc["state"] == 1) & closes(line), 2).otherwise(acc["state"])
        take = (acc["state"] == 1) & (state == 1)
        return F.struct(state.alias("state"), F.when(take, F.array_append(acc["lines"], line)).otherwise(acc["lines"]).alias("lines"))

    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("lines"))
    return F.aggregate(lines, start, step, lambda acc: acc["lines"])


def legacy_spec(lines: Column) -> Column:
    """struct of the fields in the comma line under "Design Info", null where there is none that can be read.

    One fold over the line's parts; what a part is depends on what came before: parts of the design up to SIZE, then arrangement and
    class in any order up to the rotation, then discharge and width; WHEEL TYPE takes all that follows."""
    clean = F.transform(F.filter(lines, F.isnotnull), lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    block = between(F.filter(clean, lambda v: v != ""), lambda v: v.rlike(_any_case(DESIGN_INFO)), lambda v: v.rlike(_any_case(SECTION_STOP)))
    names = ["design", "size", "arrangement", "fan_class", "rotation", "discharge", "pct_width", "wheel"]
    start = F.struct(F.lit("design").alias("state"), *(F.lit("").alias(n) for n in names))

    def step(acc: Column, raw: Column) -> Column:
        part, state = F.trim(raw), acc["state"]
        size, wheel = part.rlike(r"(?i)^SIZE\s+\S") & (state == "design") & (acc["design"] != ""), part.rlike(r"(?i)^WHEEL\s+TYPE") & ~state.isin("design", "wheel")
        turn = F.upper(part).isin("CW", "CCW") & (state == "sized")
        blank = (part == "") & ~state.isin("design", "wheel")
        now = F.when(size, "sized").when(wheel, "wheel").when(turn, "turned").when(blank, state).when(state == "turned", "discharged").when(state == "discharged", "done").otherwise(state)
        joined = lambda old, new: F.when(old == "", new).otherwise(F.concat_ws(", ", old, new))
        stays = state == now
        new = {
            "design": F.when((state == "design") & ~size, joined(acc["design"], part)),
            "size": F.when(size, F.trim(F.regexp_replace(part, r"(?i)^SIZE\s+", ""))),
            "arrangement": F.when((state == "sized") & stays & (acc["arrangement"] == ""), F.regexp_extract(part, _any_case(ARRANGEMENT), 1)),
            "fan_class": F.when((state == "sized") & stays & (acc["fan_class"] == "") & part.rlike(r"(?i)^C/[A-Z0-9-]+$"), part),
            "rotation": F.when(turn, F.upper(part)),
            "discharge": F.when(now == "discharged", F.when(stays, acc["discharge"]).otherwise(part)),
            "pct_width": F.when((now == "done") & ~stays, F.trim(F.regexp_replace(part, "%+$", ""))),
            "wheel": F.when(wheel, F.trim(F.regexp_replace(part, r"(?i)^WHEEL\s+TYPE\s*", ""))).when(state == "wheel", joined(acc["wheel"], part)),
        }
        return F.struct(now.alias("state"), *(F.coalesce(new[n], acc[n]).alias(n) for n in names))

    def fields(got: Column) -> Column:
        design = F.regexp_extract(got["design"], r"(?i)^(?:Design\s+[0-9A-Z-]+|D[0-9A-Z-]+)\s+(.+)$", 1)
        wheel = F.trim(F.regexp_replace(got["wheel"], "^[ ,]+|[ ,]+$", ""))
        code = wheel
        for name, short in WHEELS.items():
            code = F.when(F.lower(wheel) == name, short).otherwise(code)
        text = F.array_join(lines, "\n")
        known = lambda v: F.when(v == "", "N/A").otherwise(v)
        return F.when(
            got["rotation"] != "",
            F.struct(
                F.when(design == "", got["design"]).otherwise(F.trim(design)).alias("design_desc"), got["size"].alias("size"), known(got["arrangement"]).alias("arrangement"), known(got["fan_class"]).alias("fan_class"),
                got["rotation"].alias("rotation"), got["discharge"].alias("discharge"), got["pct_width"].alias("pct_width"), code.alias("wheel_type"),
                F.trim(F.regexp_extract(text, _any_case(rf"\bDESIGN\s+TEMP{TEMPERATURE}"), 1)).alias("design_temp"), F.trim(F.regexp_extract(text, _any_case(rf"\bMAX\s+TEMP{TEMPERATURE}"), 1)).alias("max_temp"),
            ),
        )

    return let(F.aggregate(F.split(F.array_join(block, " "), ","), start, step), fields)


def outline_dims(lines: Column) -> Column:
    """name -> inches of the rows of the table that "AXIAL VIEW" opens; the first of a name counts."""
    rows = between(lines, lambda v: F.upper(v).contains("AXIAL VIEW"), lambda v: F.upper(v).contains("PUNCHING DETAIL") | F.upper(v).contains("PART NAME") | F.trim(v).startswith("---"))
    part = lambda v, k: F.regexp_extract(v, OUTLINE_ROW, k)
    names = F.create_map(*(F.lit(x) for e in OUTLINE_NAMES.items() for x in e))
    title = lambda v: F.concat(F.initcap(F.trim(part(v, 2))), F.lit(" ("), part(v, 1), F.lit(")"))
    pairs = F.transform(F.filter(rows, lambda v: v.rlike(OUTLINE_ROW)), lambda v: F.struct(F.coalesce(names[part(v, 1)], title(v)).alias("key"), F.regexp_replace(F.trim(part(v, 3)), r"\s{2,}", " ").alias("value")))
    again = lambda every: F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: y["key"]), x["key"]) == i + 1)
    return F.map_from_entries(let(pairs, again))


def primary_lines(lines: Column) -> Column:
    """Lines of the pages of arrangement 4, where a document has pages of that family and of another; else all lines. A page without
    an arrangement belongs to the page before."""

    def step(acc: Column, line: Column) -> Column:
        found = F.upper(F.regexp_extract(line, _any_case(PAGE_ARRANGEMENT), 1))
        breaks = line.rlike(PAGE)
        page = F.when(breaks, acc["page"] + 1).otherwise(acc["page"])
        put = F.struct(page.alias("page"), line.alias("line"), F.when(breaks, "").otherwise(F.substring(found, 1, 1)).alias("family"), breaks.alias("breaks"))
        return F.struct(page.alias("page"), F.array_append(acc["rows"], put).alias("rows"))

    rows = F.aggregate(lines, F.struct(F.lit(0).alias("page"), F.array().cast("array<struct<page:int,line:string,family:string,breaks:boolean>>").alias("rows")), step, lambda acc: F.filter(acc["rows"], lambda r: ~r["breaks"]))

    def chosen(every: Column) -> Column:
        pages = F.array_distinct(F.transform(every, lambda r: r["page"]))
        own = F.transform(pages, lambda p: F.coalesce(F.get(F.filter(F.transform(F.filter(every, lambda r: r["page"] == p), lambda r: r["family"]), lambda f: f != ""), F.lit(0)), F.lit("")))
        carried = F.aggregate(own, F.array().cast("array<string>"), lambda acc, f: F.array_append(acc, F.when(f != "", f).otherwise(F.coalesce(F.element_at(F.concat(F.array(F.lit("")), acc), -1), F.lit("")))))

        def pick(families: Column) -> Column:
            known = F.array_distinct(F.filter(families, lambda f: f != ""))
            four = F.transform(F.filter(every, lambda r: F.get(families, (F.array_position(pages, r["page"]) - 1).cast("int")) == "4"), lambda r: r["line"])
            return F.when((F.size(pages) > 1) & (F.size(known) > 1) & F.array_contains(known, "4"), four).otherwise(lines)

        return let(carried, pick)

    return let(rows, chosen)


def order_context(lines: Column, arrangement: Column | None = None) -> Column:
    """struct(arrangement, parts_only): what holds for the whole order, from any of its lines; a given arrangement comes first."""
    hit = F.get(F.filter(F.transform(lines, lambda v: F.regexp_extract(v, _any_case(CONTEXT_ARRANGEMENT), 1)), lambda v: v != ""), F.lit(0))
    found = F.coalesce(F.upper(F.regexp_replace(hit, r"\s+", "")), F.lit(""))
    given = found if arrangement is None else F.when(F.coalesce(arrangement, F.lit("")) != "", F.trim(arrangement)).otherwise(found)
    return F.struct(given.alias("arrangement"), F.exists(lines, lambda v: F.coalesce(v.rlike(_any_case(PARTS_ONLY)), F.lit(False))).alias("parts_only"))


def sniffed(content: Column) -> Column:
    """Extension by a file's first bytes, and for an archive by what lies in it; empty where they say nothing."""
    head, text = F.hex(F.substring(content, 1, 8)), F.decode(content, "ISO-8859-1")
    kind = F.lit("")
    for begin, ext in reversed(MAGIC):
        kind = F.when(head.startswith(begin), ext).otherwise(kind)
    for name, ext in INSIDE:
        kind = F.when((kind == ".zip") & text.contains(name), ext).otherwise(kind)
    return kind


def decoded(content: Column) -> Column:
    """Text of a file's bytes: UTF-8, else the old one-byte letters. Empty where the first 8192 bytes have a zero, or over 2 percent
    of control signs: such bytes are no text."""
    latin = F.decode(content, "ISO-8859-1")
    sample = F.substring(latin, 1, 8192)
    controls = F.regexp_count(sample, F.lit(r"[\x01-\x08\x0B\x0E-\x1F]"))
    old = F.translate(latin, "".join(map(chr, range(0x80, 0xA0))), HIGH)
    text = content.cast("string")
    return F.when((F.length(sample) == 0) | sample.contains("\0") | (controls / F.length(sample) > 0.02), "").when(F.is_valid_utf8(text), text).otherwise(old)
