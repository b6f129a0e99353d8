"""Labels and records as they are shown: times, change orders, drawings, features, suggestions, runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: facts of a wheel, each with the names that runs give it
WHEEL_FACTS = {
    "Blades": ["Blades", "Number of Blades", "Blade Count"],
    "Blade Material": ["Blade Material"],
    "Blade Gauge": ["Blade Gauge"],
    "Sideplate Material": ["Sideplate Material"],
    "Sideplate Gauge": ["Sideplate Gauge"],
    "Backplate Material": ["Backplate Material"],
    "Backplate Gauge": ["Backplate Gauge"],
    "Hub": ["Hub"],
    "Hub Bore": ["Hub Bore"],
    "Hub Bushing": ["Hub Bushing"],
    "Wheel Material": ["Wheel Material", "Non-Std Wheel Materials"],
    "Effective Wheel Dia": ["Effective Wheel Dia"],
    "STH": ["STH"],
}
# fixed values: words of labels that lead a summary, in this order
OF_INTEREST = ["material", "construction", "gauge", "weld", "welder", "coating", "paint", "finish", "bearing", "shaft", "seal", "flange", "spark", "duty", "service", "wheel", "hub", "rim", "blade", "backplate"]
# fixed values: fields of the context list, of the kinds of run files, of settled states
CONTEXT = ["job", "customer", "primary_rep", "design", "oper", "end_date", "fannet_date", "ship_with"]
RUN_NAMES = [r"qt\s*run", r"quote\s*run", "wheel", "construction"]
RUN_KINDS = [".txt", ".pdf", ".rtf", ".xlsx", ".xlsm", ".xls", ".doc", ".docx", ".csv", ".md"]
SETTLED = ["OK", "DRAWING", "CHECK VISION", "NEEDS HUMAN"]
NO_TEXT, CHECK = "PDF (no text layer)", "CHECK VISION"
# fixed values: parts of a document's id, a change order's first line
DOCUMENT = r"^(.+?)-(\d+)-(\d+)-([A-Za-z0-9]+)$"
CHANGE_ORDER = r"(?i)^\s*C\s*/?\s*O\s*#?\s*(\d+)"


def time_label(at: Column, now: Column, missing: str) -> Column:
    """The time of day if it was today, else the date; `missing` where there is none."""
    return F.when(at.isNull(), F.lit(missing)).when(at.cast("date") == now.cast("date"), F.date_format(at, "h:mm a")).otherwise(F.date_format(at, "MMM d, yyyy"))


def change_order_note(history: Column) -> Column:
    """The history under a heading, highest number first; lines of one number in their order; null where there is none."""
    number = lambda t: F.coalesce(F.regexp_extract(t, r"(?i)C\s*/?\s*O\s*#?\s*(\d+)", 1).try_cast("int"), F.lit(0))
    keyed = F.array_sort(F.transform(history, lambda t, i: F.struct((-number(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.when(F.size(history) > 0, F.concat(F.lit("Change orders (most recent first):\n"), F.array_join(F.transform(keyed, lambda x: x["t"]), "\n")))


def by_suffix(suffixes: Column) -> Column:
    """Numbers by value, other suffixes after them."""
    keyed = F.transform(suffixes, lambda s: F.struct(F.coalesce(F.when(s.rlike(r"^\d+$"), s.try_cast("int")), F.lit(10**9)).alias("n"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def drawing_label(extras: Column, formats: bool = False) -> Column:
    """"-07, -51" of a map from suffix to format; with formats in the map's order, as "-07 (DWG), -51 (PDF+DWG)"."""
    if formats:
        return F.array_join(F.transform(F.map_entries(extras), lambda e: F.concat(F.lit("-"), e["key"], F.when(F.coalesce(e["value"], F.lit("")) != "", F.concat(F.lit(" ("), e["value"], F.lit(")"))).otherwise(""))), ", ")
    return F.array_join(F.transform(by_suffix(F.map_keys(extras)), lambda s: F.concat(F.lit("-"), s)), ", ")


def drawing_links(extras: Column) -> Column:
    """(suffix, kind) by number; a PDF is preferred where there is one."""
    return F.transform(by_suffix(F.map_keys(extras)), lambda s: F.struct(s.alias("suffix"), F.when(F.upper(F.coalesce(extras[s], F.lit(""))).contains("PDF"), "pdf").otherwise("dwg").alias("kind")))


def features_label(items: Column) -> Column:
    """The union of the tags of an order's items (an array of arrays), else how many items there are."""
    tags = F.array_sort(F.array_distinct(F.flatten(items)))
    return F.when(F.size(tags) > 0, F.array_join(tags, ", ")).when(F.size(items) > 0, F.format_string("(%d items)", F.size(items))).otherwise("")


def reuse_label(found: Column) -> Column:
    """"421100 (-07,-51) +2" of an array of struct(job, suffixes)."""
    first = F.get(found, 0)
    suffixes = F.array_join(F.transform(first["suffixes"], lambda s: F.concat(F.lit("-"), s)), ",")
    return F.when(F.size(found) > 0, F.concat(first["job"].cast("string"), F.lit(" ("), suffixes, F.lit(")"), F.when(F.size(found) > 1, F.format_string(" +%d", F.size(found) - 1)).otherwise(""))).otherwise("")


def reuse_note(found: Column) -> Column:
    """A line for each candidate (job, customer, score), then its drawings and the lines that it shares."""
    entry = lambda r: F.concat_ws(
        "\n",
        F.concat(r["job"].cast("string"), F.when(F.coalesce(r["customer"], F.lit("")) != "", F.concat(F.lit("  "), r["customer"])).otherwise(""), F.lit(" — score "), F.format_string("%.2f", r["score"])),
        F.when(F.size(r["suffixes"]) > 0, F.concat(F.lit("  custom DWGs: "), F.array_join(F.transform(r["suffixes"], lambda s: F.concat(F.lit("-"), s)), ", "))),
        F.nullif(F.array_join(F.transform(r["lines"], lambda n: F.concat(F.lit("  = "), n)), "\n"), F.lit("")),
    )
    return F.array_join(F.transform(found, entry), "\n")


def document_of(href: Column) -> Column:
    """struct(fn, type, rev) from the query of a document's link; an id of another form is the type itself."""
    part = lambda name: F.coalesce(F.url_decode(F.parse_url(href, F.lit("QUERY"), F.lit(name))), F.lit(""))
    kind = F.regexp_extract(part("pid"), DOCUMENT, 1)
    return F.struct(part("fn").alias("fn"), F.when(kind != "", kind).otherwise(part("pid")).alias("type"), F.regexp_extract(part("pid"), DOCUMENT, 3).try_cast("int").alias("rev"))


def plain_type(kind: Column, prefixes: list[str]) -> Column:
    """Lower case, without the prefix of a site."""
    return F.regexp_replace(F.lower(F.coalesce(kind, F.lit(""))), f"^(?:{'|'.join(prefixes)})", "")


def filled_json(fields: dict[str, Column]) -> Column:
    """JSON of the fields that are neither null nor empty."""
    return F.to_json(F.struct(*(F.when(F.coalesce(c.cast("string"), F.lit("")) != "", c).alias(n) for n, c in fields.items())))


def wheel_facts(run: Column, blade: Column) -> Column:
    """Array of struct(label, value, norm) of a run (a map): the blade type of the order, then the first filled name of each fact."""
    value = lambda names: F.coalesce(*(F.nullif(F.trim(F.coalesce(run[n], F.lit(""))), F.lit("")) for n in names))
    norm = lambda label, v: F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.concat(F.lit(f"WHEEL {label} "), v)), "[^A-Z0-9 ]", " "), r"\s+", " "))
    kind = F.when(~F.upper(F.trim(blade)).isin("", "N/A", "NONE"), F.trim(blade))
    facts = [("Blade Type", kind), *((label, value(names)) for label, names in WHEEL_FACTS.items())]
    rows = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(label).alias("label"), v.alias("value"), norm(label, v).alias("norm"))) for label, v in facts)))
    return F.when(F.size(run) > 0, rows).otherwise(F.array().cast("array<struct<label:string,value:string,norm:string>>"))


def summary(fields: Column, most: int = 12) -> Column:
    """"label=value; ..." of a map: labels of interest first, in that order, then the rest by name, `most` at most."""
    rank = lambda label: F.coalesce(*(F.when(F.lower(label).contains(word), F.lit(k)) for k, word in enumerate(OF_INTEREST)), F.lit(len(OF_INTEREST)))
    keyed = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(rank(e["key"]).alias("r"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.array_join(F.transform(F.slice(keyed, 1, most), lambda e: F.concat(e["k"], F.lit("="), e["v"])), "; ")


def first_of(values: Column, most: int) -> Column:
    """Distinct values in their order, `most` at most."""
    return F.slice(F.array_distinct(values), 1, most)


def run_file(path: Column) -> Column:
    """Whether a file is a run's document: by name and kind, no lock file, in no folder of superseded copies."""
    name = F.regexp_extract(path, r"([^\\/]*)$", 1)
    folders = F.regexp_extract(path, r"^(.*)[\\/]", 1)
    kind = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    named = F.lit(False)
    for pattern in RUN_NAMES:
        named = named | name.rlike(f"(?i){pattern}")
    return ~name.startswith("~$") & kind.isin(RUN_KINDS) & ~folders.rlike(r"(?i)\bhist(ory)?\b") & named


def damper_run(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1).rlike("(?i)damper")


def detail_worthy(line: Column) -> Column:
    """Two letters in a row, and a word without digits."""
    return line.rlike("[A-Za-z]{2}") & F.exists(F.split(F.trim(line), r"\s+"), lambda t: ~t.rlike("[0-9]"))


def to_read(run: Column, again: bool = False) -> Column:
    """Whether a run (path, status, vision) is to be read from its pages: a PDF without text not yet read, or one that was read
    badly; with `again` all that were read."""
    fresh = (run["status"] == NO_TEXT) & ~F.coalesce(run["vision"], F.lit(False))
    return F.lower(run["path"]).endswith(".pdf") & (fresh | (run["status"] == CHECK) | (F.lit(again) & F.coalesce(run["vision"], F.lit(False))))


def unsettled(runs: Column) -> Column:
    return F.exists(runs, lambda r: ~r["status"].isin(SETTLED))
