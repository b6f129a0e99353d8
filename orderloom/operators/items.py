"""Items of order documents: their tags by context, what they say, what needs review, and the components that they make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.functions.attributes import attributes, without_own
from orderloom.functions.corrections import corrected, rules, with_texts
from orderloom.functions.text import tags
from orderloom.sources.steps import met, spread, stored

# fixed values: attributes whose values of several lines add up; those that are no attributes of a component
ADDING = r"(?:_subcategory|_feature|_scope|_instruction|_state|_method)$"
STRUCTURE = ("used_on", "component", "vfd_context")


def _given(details: str) -> Column:
    return F.filter(F.coalesce(F.col(details), F.array().cast("array<string>")), lambda d: d.isNotNull())


def read_items(items: DataFrame, raw: str, details: str, section: str | None = None, arrangement: str | None = None, parts_only: str | None = None) -> DataFrame:
    """items with `tags` (what line and details name, corrected by context) and `attributes` (map of what they say).

    section, arrangement, parts_only: columns; none: unknown. Each distinct text is read once, dealt over all tasks (few bytes,
    but much work), and stored; items are joined to them and never sent to all tasks. Null texts and details are empty; former columns `tags` and `attributes` are replaced."""
    text = lambda name: F.coalesce(F.col(name), F.lit("")) if name else F.lit("")
    keyed = items.withColumn(
        "__item",
        F.struct(text(raw).alias("raw"), _given(details).alias("details"), text(section).alias("section"), text(arrangement).alias("arrangement"), (F.coalesce(F.col(parts_only), F.lit(False)) if parts_only else F.lit(False)).alias("parts_only")),
    )
    distinct = spread(keyed.select("__item").distinct(), F.xxhash64("__item")).withColumns({"__raw": F.col("__item.raw"), "__details": F.col("__item.details")})
    read = with_texts(distinct, "__raw", "__details").withColumn("__found", tags(F.col("__sought")))
    texts = {n: F.col(f"__{n}") for n in ("primary", "blob", "said", "wording")}
    product = F.upper(F.regexp_extract(F.get(F.filter(F.concat(F.array("__item.raw"), F.col("__item.details")), lambda x: x.rlike(r"(?i)^\s*Product\s*:\s*\S")), F.lit(0)), r"(?i)^\s*Product\s*:\s*(.*?)[ ,;]*$", 1))
    table = rules(texts, F.col("__found"), F.col("__item.section"), product, F.col("__item.arrangement"), F.col("__item.parts_only"))
    tagged = read.withColumn("tags", corrected(F.col("__found"), table)).withColumn("attributes", attributes(texts, F.col("tags")))
    done = tagged.select("__item", "tags", without_own(F.col("attributes")).alias("attributes"))
    return met(keyed.drop("tags", "attributes"), stored(done, "read-items"), "__item").drop("__item")


def said(attributes_of: Column) -> Column:
    """name=value of each attribute, by name, joined by semicolons: a map as one string."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attributes_of)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


def review_flags(items: DataFrame, key: str, raw: str, details: str) -> DataFrame:
    """key (unique), flags: UNTAGGED, attributes that are named *_review, and each detail that adds no tag and no attribute.

    An item is read with the first 0, 1, ... of its details, and with each detail alone. A detail is unclassified if it changes
    nothing where it stands, says nothing alone, and is not the head of a value on the next line (which says nothing alone, but
    does with it). Items of equal texts are judged once. Every reading is a row, so long lists of details are spread over tasks."""
    base = items.select(F.col(key).alias("key"), F.coalesce(F.col(raw), F.lit("")).alias("raw"), _given(details).alias("all"))
    each = base.select("raw", "all").distinct()
    whole = F.transform(F.sequence(F.lit(0), F.size("all")), lambda k: F.struct(F.lit("whole").alias("kind"), k.alias("k"), F.slice("all", 1, k).alias("details")))
    alone = F.transform("all", lambda d, k: F.struct(F.lit("alone").alias("kind"), k.alias("k"), F.array(d).alias("details")))
    readings = each.select("raw", "all", F.explode(F.concat(whole, alone)).alias("r")).select("raw", "all", "r.*")
    read = read_items(readings, "raw", "details").withColumn("sign", F.concat_ws("|", F.array_join("tags", ","), said(F.col("attributes"))))
    by = F.array_sort(F.collect_list(F.when(F.col("kind") == "whole", F.struct("k", "sign"))))
    one = F.array_sort(F.collect_list(F.when(F.col("kind") == "alone", F.struct("k", "sign"))))
    last = F.max_by(F.struct("tags", "attributes"), F.when(F.col("kind") == "whole", F.col("k")))
    signs = read.groupBy("raw", "all").agg(F.transform(by, lambda x: x["sign"]).alias("by"), F.transform(one, lambda x: x["sign"]).alias("one"), last.alias("last"))

    def idle(k: Column) -> Column:
        empty = F.get("by", F.lit(0))
        headed = F.coalesce((F.get("by", k + 2) != F.get("by", k + 1)) & (F.get("one", k + 1) == empty), F.lit(False))
        return (F.get("by", k + 1) == F.get("by", k)) & (F.get("one", k) == empty) & ~headed

    unclassified = F.array_compact(F.transform("all", lambda d, k: F.when(idle(k) & ~d.rlike(r"(?i)^\s*(?:equivalent|(?:Vendor|Product|Quote Num|Quote Number|Quote No|Operation)\s*:.*)\s*$"), F.concat(F.lit("UNCLASSIFIED DETAIL: "), d))))
    doubts = F.transform(F.array_sort(F.filter(F.map_entries("last.attributes"), lambda e: e["key"].endswith("_review"))), lambda e: F.concat(F.upper(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), e["value"]))
    flags = F.concat(F.when(F.size("last.tags") == 0, F.array(F.lit("UNTAGGED"))).otherwise(F.array().cast("array<string>")), doubts, F.array_distinct(unclassified))
    return met(base, stored(signs.select("raw", "all", flags.alias("flags")), "review-flags"), "raw", "all").select(F.col("key").alias(key), "flags")


def hierarchy(items: DataFrame, job: str, place: str, text: str, price: str, attributes_of: str) -> DataFrame:
    """job, parent, name, keyed, price, primary, members, attributes, conflicts: the things that an order's items are evidence of.

    Items meet by what they are used on, else by their component; an item with neither stands alone, under its text. An actuator
    with owners becomes a child of each of them, priced with the first. The dearest item (the first of equal ones) is the primary;
    its values come first, then the others' in order. Values of names in ADDING join by commas; of others by bars, and the name is
    in `conflicts`. Items of an order are grouped by thing, so a large order is spread over its things; items that lie by their
    orders already are not dealt again."""
    a = lambda name: F.trim(F.upper(F.coalesce(F.try_element_at(F.col(attributes_of), F.lit(name)), F.lit(""))))
    owned = F.filter(F.array_distinct(F.split(a("used_on"), r"\s*[,|]\s*")), lambda x: x != "")
    adds = lambda k: k.rlike(ADDING)
    told = F.filter(F.map_entries(F.coalesce(F.col(attributes_of), F.create_map().cast("map<string,string>"))), lambda e: ~e["key"].isin(*STRUCTURE) & ~e["key"].endswith("_review") & (F.coalesce(e["value"], F.lit("")) != ""))
    pairs = F.flatten(F.transform(told, lambda e: F.transform(F.when(adds(e["key"]), F.split(e["value"], ", ")).otherwise(F.array(e["value"])), lambda v: F.struct(e["key"].alias("k"), v.alias("v")))))
    rows = items.select(F.col(job).alias("job"), F.col(place).alias("place"), F.col(text).alias("text"), F.coalesce(F.col(price), F.lit(0)).cast("decimal(18,2)").alias("price"), pairs.alias("pairs"), a("component").alias("component"), a("used_on").alias("used_on"), owned.alias("owners"))
    nested = (F.col("component") == "ACTUATOR") & (F.size("owners") > 0)
    own = F.coalesce(F.nullif("used_on", F.lit("")), F.nullif("component", F.lit("")))
    child = F.transform("owners", lambda o, k: F.struct(o.alias("parent"), F.col("component").alias("name"), F.lit(True).alias("keyed"), F.when(k == 0, F.col("price")).otherwise(F.lit(0).cast("decimal(18,2)")).alias("cost")))
    single = F.array(F.struct(F.lit("").alias("parent"), F.coalesce(own, F.col("text")).alias("name"), own.isNotNull().alias("keyed"), F.col("price").alias("cost")))
    views = rows.withColumn("v", F.explode(F.when(nested, child).otherwise(single))).select("job", "place", "text", "pairs", "v.*")
    # a thing without a key is a thing of its own even if its text repeats
    views = views.withColumn("thing", F.when(F.col("keyed"), F.lit(None)).otherwise(F.col("place")))
    by = ["job", "parent", "name", "keyed", "thing"]
    first = W.partitionBy(*by).orderBy(F.desc("cost"), "place")
    ranked = views.withColumn("rank", F.row_number().over(first)).withColumn("turn", F.when(F.col("rank") == 1, F.lit(None)).otherwise(F.col("place")))
    # each item says its pairs, and once, without a name, that it is there, the primary with its text; so one grouping by things does for both
    said = ranked.select(*by, "place", "cost", "rank", "turn", F.explode(F.array_append("pairs", F.struct(F.lit(None).cast("string").alias("k"), F.when(F.col("rank") == 1, F.col("text")).alias("v")))).alias("p")).withColumns({"k": F.col("p.k"), "v": F.col("p.v")})
    met = said.groupBy(*by, "k", "v").agg(F.min("turn").alias("turn"), F.min("rank").alias("rank"), F.min("place").alias("place"), F.sum("cost").alias("cost"), F.count("*").alias("n")).withColumn("turn", F.when(F.col("rank") == 1, F.lit(None)).otherwise(F.col("turn")))
    there = lambda c: F.when(F.col("k").isNull(), F.col(c))
    listed = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", F.coalesce("turn", F.lit(-1)).alias("turn"), "v"))))
    things = met.groupBy(*by).agg(F.min(there("place")).alias("place"), F.sum(there("cost")).cast("double").alias("price"), F.max(there("v")).alias("primary"), F.sum(there("n")).alias("members"), listed.alias("listed"))
    of = lambda k: F.transform(F.filter("listed", lambda x: x["k"] == k), lambda x: x["v"])
    names = F.array_distinct(F.transform("listed", lambda x: x["k"]))
    facts = F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), F.when(adds(k), F.array_join(of(k), ", ")).otherwise(F.array_join(of(k), " | ")).alias("value"))))
    conflicts = F.filter(names, lambda k: ~adds(k) & (F.size(of(k)) > 1))
    return things.select("job", "parent", "name", "keyed", "place", "price", "primary", "members", facts.alias("attributes"), conflicts.alias("conflicts")).withColumnRenamed("job", job)
