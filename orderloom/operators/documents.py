"""Order documents: items with their details, labelled values, templates, notes on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.functions.sheets import order_context
from orderloom.functions.text import closes_section, let, line_kind, normalize, opens_section, split_lead, split_price, split_type
from orderloom.operators.items import read_items
from orderloom.sources.steps import met, spread, stored


ITEMS = ("item_priced", "item_section")


def read_lines(lines: DataFrame, line: str) -> DataFrame:
    """lines with `__read`, what each says by itself: whether it opens or closes a section, the section's name, its kind outside a
    section and inside one, its parts as an item, and what it says of its order. Each distinct text is read once, dealt over all tasks."""
    rows = lines.withColumn("__line", F.struct(F.col(line).alias("text")))
    text = F.col("__line.text")
    each = spread(rows.select("__line").distinct(), F.xxhash64("__line"))
    each = each.select("__line", line_kind(text, F.lit(None).cast("string")).alias("outside"), line_kind(text, F.lit("x")).alias("inside"))
    priced = let(split_lead(text), lambda lead: let(split_price(lead["text"]), lambda p: let(split_type(p["text"]), lambda t: F.struct(normalize(text).alias("norm"), lead["qty"].alias("qty"), F.coalesce(F.nullif(p["price"], F.lit("")), t["mark"]).alias("price"), t["type"].alias("type")))))
    parts = F.when(F.col("outside").isin(*ITEMS) | F.col("inside").isin(*ITEMS), priced)
    said = F.struct(opens_section(text).alias("opens"), closes_section(text).alias("closes"), F.regexp_replace(F.trim(text), r"\s*:\s*$", "").alias("name"), "outside", "inside", parts.alias("parts"), order_context(F.array(F.coalesce(text, F.lit("")))).alias("context"))
    return met(rows, stored(each.select("__line", said.alias("__read")), "read-lines"), "__line").drop("__line")


def classified(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """lines with the section that is open after each (null: none), and its kind, which depends on the one open before it."""
    return _classified(read_lines(lines, line), doc, pos).drop("__read")


def _classified(read: DataFrame, doc: str, pos: str) -> DataFrame:
    order = W.partitionBy(doc).orderBy(pos)
    event = F.when(F.col("__read.opens"), F.struct(F.col("__read.name").alias("s"))).when(F.col("__read.closes"), F.struct(F.lit(None).cast("string").alias("s")))
    rows = read.withColumn("__event", event)
    before = F.last("__event", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))["s"]
    after = F.last("__event", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))["s"]
    return rows.withColumns({"__before": before, "section": after}).withColumn("kind", F.when(F.col("__before").isNull(), F.col("__read.outside")).otherwise(F.col("__read.inside"))).drop("__event", "__before")


def extract_items(lines: DataFrame, doc: str, pos: str, line: str, raw_line: bool = False) -> DataFrame:
    """doc, item, norm, qty, price, type, section, details: items of each document, equal ones once (the first), with the text
    lines that follow them. raw_line: the item's line as it stands comes as `raw`.

    The section holds from its heading to a total. A priced line is an item, any line within a section too. Text lines belong
    to the last item before them, unless a heading or a total stands between: an item or a reset, whichever came last."""
    return _extracted(read_lines(lines, line), doc, pos, line).drop(*([] if raw_line else ["raw"]))


def _extracted(read: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    own = W.partitionBy(doc).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    marked = _classified(read, doc, pos)
    is_item = F.col("kind").isin(*ITEMS)
    event = F.when(is_item, F.struct(F.col(pos).cast("long").alias("at"))).when(F.col("kind").isin("section_start", "section_end"), F.struct(F.lit(None).cast("long").alias("at")))
    open_item = marked.withColumn("item", F.last(event, ignorenulls=True).over(own)["at"]).filter("item is not null and kind in ('item_priced', 'item_section', 'text')")
    details = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct(F.col(pos).alias("p"), F.trim(line).alias("t"))))), lambda x: x["t"])
    head = F.max(F.when(F.col(pos) == F.col("item"), F.struct(F.col(line).alias("raw"), "section", "__read.parts")))
    items = open_item.groupBy(doc, "item").agg(head.alias("h"), details.alias("details")).select(doc, "item", "h.raw", "h.section", "details", "h.parts.*")
    return items.withColumn("__n", F.row_number().over(W.partitionBy(doc, "norm").orderBy("item"))).filter("__n = 1").drop("__n")


def order_items(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """Items of each document with tags and attributes that depend on the whole order, as extract_items and arrangement, parts_only,
    tags, attributes.

    Documents are read twice: what holds for the order is gathered from all its lines, one row for each, and joined to the items
    before their tags are corrected. The first line by pos that names an arrangement counts. Lines are dealt by document once, into
    as many partitions as the session has; what a line says is read once for each distinct text."""
    read = read_lines(spread(lines, doc), line)
    context = read.select(doc, pos, F.col("__read.context").alias("c")).groupBy(doc).agg(F.coalesce(F.min_by("c.arrangement", F.when(F.col("c.arrangement") != "", F.col(pos))), F.lit("")).alias("arrangement"), F.bool_or("c.parts_only").alias("parts_only"))
    items = _extracted(read, doc, pos, line).join(context, doc)
    return read_items(items, "raw", "details", "section", "arrangement", "parts_only")


def labelled_values(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """doc, label, value: the first value of each label `Label: value`."""
    pattern = r"^\s*([A-Za-z][A-Za-z0-9 .#%/-]{0,40}?)\s*:\s*(\S.*?)\s*$"
    pairs = lines.select(doc, pos, F.upper(F.regexp_extract(line, pattern, 1)).alias("label"), F.regexp_extract(line, pattern, 2).alias("value")).filter("label <> ''")
    return pairs.groupBy(doc, "label").agg(F.min_by("value", pos).alias("value"))


def pattern_fields(rows: DataFrame, text: str, patterns: dict[str, list[str]]) -> DataFrame:
    """A column for each field: the first group of the first of its patterns that is found."""
    found = lambda ps: F.coalesce(*(F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in ps))
    return rows.withColumns({name: found(ps) for name, ps in patterns.items()})


def best_template(rows: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """template: the name of the highest score over 0, of equal ones the first given; null where none is."""
    ranked = F.array(*(F.struct(s.cast("double").alias("score"), F.lit(-k).alias("place"), F.lit(n).alias("name")) for k, (n, s) in enumerate(scores.items())))
    best = F.array_max(ranked)
    return rows.withColumn("template", F.when(best["score"] > 0, best["name"]))


def notes_on_rows(notes: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """note id, row: the row a note means: by key, else by number, else by text, else the order's first."""
    keyed = rows.select(order, F.col("row_key"), F.col("row").alias("by_key"))
    one = lambda by, name: rows.filter(F.col(by).isNotNull()).groupBy(order, by).agg(F.min("row").alias(name))
    joined = notes.join(keyed, [order, "row_key"], "left").join(one("item_no", "by_number"), [order, "item_no"], "left").join(one("item_text", "by_text"), [order, "item_text"], "left")
    joined = joined.join(rows.groupBy(order).agg(F.min("row").alias("first_row")), order, "left")
    return joined.select("id", F.coalesce("by_key", "by_number", "by_text", "first_row").alias("row"))


def temperatures(text: Column, low: float = 0, high_f: float = 130, high_c: float = 50) -> Column:
    """Extreme temperatures of a text: below `low`, or at or over the limit of their unit; numbers without a unit do not count."""
    parts = F.regexp_extract_all(text, F.lit(r"(-?\d{1,4})\s*(?:DEG(?:REES?)?\.?\s*)?[FC]\b"), F.lit(0))
    value = lambda p: F.regexp_extract(p, r"-?\d+", 0).cast("int")
    return F.filter(parts, lambda p: (value(p) < low) | (p.rlike("F$") & (value(p) >= high_f)) | (p.rlike("C$") & (value(p) >= high_c)))


def inquiry_numbers(text: Column) -> Column:
    """Numbers named as inquiries; a number broken by a line's end is put together."""
    joined = F.regexp_replace(text, r"(\d)-\s*\n\s*(\d)", "$1$2")
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(r"(?i)INQ(?:UIRY)?\.?\s*(?:NO\.?|#|:)?\s*(\d{4,10})"), F.lit(1)))


def plausible(values: DataFrame, rules: dict[str, str], read: str, seen: str) -> DataFrame:
    """finding of each (field, read, seen): bad form, disagree (numbers over one percent apart) or ok."""
    form = F.lit(True)
    for field, pattern in rules.items():
        form = F.when(F.col("field") == field, F.col(read).rlike(pattern)).otherwise(form)
    a, b = F.col(read).try_cast("double"), F.col(seen).try_cast("double")
    apart = F.coalesce(F.abs(a - b) > 0.01 * F.greatest(F.abs(a), F.abs(b)), F.lit(False))
    return values.withColumn("finding", F.when(~form, "bad form").when(apart, "disagree").otherwise("ok"))


def field_differences(pairs: DataFrame, fields: list[str], ignore: list[str]) -> DataFrame:
    """differences: names of the fields (left_x, right_x) that both sides know and that differ."""
    differ = [F.when((F.coalesce(f"left_{f}", F.lit("")) != "") & (F.coalesce(f"right_{f}", F.lit("")) != "") & (F.upper(f"left_{f}") != F.upper(f"right_{f}")), F.lit(f)) for f in fields if f not in ignore]
    return pairs.withColumn("differences", F.array_compact(F.array(*differ)))
