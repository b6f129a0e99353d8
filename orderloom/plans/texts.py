"""Queries on scalar and text functions, search and likeness, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.functions import scalars, text
from orderloom.functions.rules import TAGS
from orderloom.functions.text import let
from orderloom.operators import documents, likeness, search
from orderloom.plans.board import D2, board, board_sql
from orderloom.sources.steps import spread, stored
from orderloom.sources.tables import table

B2 = board_sql(D2)
PHRASES = ["shaft seal", "spark resistant wheel, AMCA type B", "inlet vane damper with actuator", "epoxy coated housing", "316SS shaft sleeve", "rain hood and drain", "motor with VFD", "nothing of note"]


def phrase(key):
    return F.element_at(F.array(*map(F.lit, PHRASES)), (key % len(PHRASES) + 1).cast("int"))


PHRASE = "([" + ", ".join(f"'{p}'" for p in PHRASES) + "])[{} % " + str(len(PHRASES)) + " + 1]"


def normalize_lines(spark, sf):
    """Lines with a number in front and a type and a price behind normalise to the words between."""
    p = table(spark, sf, "part")
    raw = F.concat(F.lit("ITEM "), (F.col("p_partkey") % 99).cast("string"), F.lit(": "), F.initcap("p_name"), F.lit(" W/Drain, 316SS brg. L "), (F.col("p_partkey") % 900 + 10).cast("string"), F.lit(".50 EA"))
    return p.select("p_partkey", text.normalize(raw).alias("norm"))


def normalize_documents(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(text.normalize(F.col("text"), strip_columns=False, abbreviations={"THE": "DIE"}).cast("binary")).alias("digest"))


ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
NORMALIZE = f"""
WITH u AS (SELECT doc_id, upper(replace(translate(trim(text), '{ACCENTS}', '{PLAIN}'), 'ß', 'SS')) AS s FROM documents),
t AS (SELECT doc_id, list_transform(regexp_split_to_array(s, '[ \\t\\n\\x0b\\f\\r]+'), lambda t: CASE
  WHEN regexp_replace(t, '^[.,;:()\\[\\]]+|[.,;:()\\[\\]]+$', '', 'g') = 'NAN' THEN ''
  WHEN regexp_replace(t, '^[.,;:()\\[\\]]+|[.,;:()\\[\\]]+$', '', 'g') = 'THE' THEN 'DIE'
  WHEN regexp_matches(regexp_replace(t, '^[.,;:()\\[\\]]+|[.,;:()\\[\\]]+$', '', 'g'), '^T?[0-9]{{3}}L?(SST?|SS)$') THEN regexp_extract(t, '[0-9]{{3}}L?') || ' STAINLESS STEEL'
  WHEN regexp_matches(regexp_replace(t, '^[.,;:()\\[\\]]+|[.,;:()\\[\\]]+$', '', 'g'), '^W/.') THEN 'WITH ' || substr(regexp_replace(t, '^[.,;:()\\[\\]]+|[.,;:()\\[\\]]+$', '', 'g'), 3)
  ELSE t END) AS ts FROM u),
j AS (SELECT doc_id, array_to_string(ts, ' ') AS s FROM t),
a AS (SELECT doc_id, regexp_replace(regexp_replace(s, '(^|[^0-9])[.]', '\\1 ', 'g'), '(^|[^0-9])[.]', '\\1 ', 'g') AS s FROM j),
b AS (SELECT doc_id, regexp_replace(s, '[.]([^0-9]|$)', ' \\1', 'g') AS s FROM a)
SELECT doc_id, md5(trim(regexp_replace(s, '[^A-Z0-9.%#]+', ' ', 'g'))) AS digest FROM b"""


def tag_items(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", phrase(F.col("l_partkey")).alias("line"))
    return search.tagged(rows, "line", strip_columns=False).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("tags", ", ").alias("tags"))


def tag_sql(norm: str) -> str:
    return "array_to_string(list_filter([" + ", ".join("CASE WHEN regexp_matches({n}, '{p}', 'i') THEN '{t}' END".format(n=norm, p="|".join(f"(?:{x})" for x in ps).replace("'", "''"), t=t) for t, ps in sorted(TAGS.items())) + "], lambda x: x IS NOT NULL), ', ')"


TAG = f"WITH p AS (SELECT unnest(range({len(PHRASES)})) AS k), n AS (SELECT k, {tag_sql('replace(replace(upper(' + PHRASE.format('k') + '), $$316SS$$, $$316 STAINLESS STEEL$$), $$,$$, $$$$)')} AS tags FROM p) SELECT l_orderkey, l_linenumber, l_partkey, tags FROM lineitem JOIN n ON l_partkey % {len(PHRASES)} = k"


def items(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("line"), F.upper("p_name").alias("norm"), F.array("p_type", "l_returnflag").alias("tags"))


ITEMS = "(SELECT l_orderkey AS job, l_linenumber AS line, upper(p_name) AS norm, [p_type, l_returnflag] AS tags, upper(p_name) || chr(10) || p_type || chr(10) || l_returnflag AS hay FROM lineitem JOIN part ON l_partkey = p_partkey)"


def search_all(spark, sf):
    return search.search(items(spark, sf), "job", "norm", "tags", ["widget", "promo"]).select("job", "line", "norm")


def search_any(spark, sf):
    return search.search(items(spark, sf), "job", "norm", "tags", ["bolt", "large"], any_term=True).select("job", "line", "norm")


def search_tag(spark, sf):
    return search.search(items(spark, sf), "job", "norm", "tags", ["gear"], tag="SMALL").select("job", "line", "norm")


def search_sql(rule: str, hit: str) -> str:
    return f"WITH i AS {ITEMS}, g AS (SELECT job FROM i GROUP BY job HAVING {rule}) SELECT job, line, norm FROM i WHERE job IN (SELECT job FROM g) AND ({hit})"


def fuzzy_search(spark, sf):
    return search.fuzzy(items(spark, sf).select("job", "line", "norm"), "norm", "widgett")


def explorer_search(spark, sf):
    rows = items(spark, sf)
    hay = rows.select("job", text.compare_form(F.col("norm")).alias("text")).union(rows.select("job", F.explode("tags")))
    return search.explorer(hay, "job", "text", "promo and gear small, R")


EXPLORER = f"""
WITH i AS {ITEMS}, h AS (SELECT job, norm AS t FROM i UNION ALL SELECT job, unnest(tags) FROM i),
s AS (SELECT job, max(CASE WHEN t = 'PROMO' THEN 1.0 WHEN contains(t, 'PROMO') THEN 0.92 ELSE 0 END) AS a,
  max(CASE WHEN t = 'GEAR SMALL' THEN 1.0 WHEN contains(t, 'GEAR SMALL') THEN 0.92 ELSE 0.55 * (contains(t, 'GEAR')::INT + contains(t, 'SMALL')::INT) / 2 END) AS b,
  max(CASE WHEN t = 'R' THEN 1.0 WHEN contains(t, 'R') THEN 0.92 ELSE 0 END) AS c FROM h GROUP BY job)
SELECT job, CAST(least(1.0, (CAST(a AS DOUBLE) + CAST(b AS DOUBLE) + CAST(c AS DOUBLE)) / 3) AS DOUBLE) AS score, (a >= 0.9)::INT + (b >= 0.9)::INT + (c >= 0.9)::INT AS matched, a >= 0.9 AND b >= 0.9 AND c >= 0.9 AS all_matched
FROM s WHERE a + b + c > 0 ORDER BY all_matched DESC, score DESC, matched DESC, job DESC LIMIT 10"""


def features(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    each = F.explode(F.array(F.struct(F.lit("tag").alias("kind"), F.col("p_type").alias("feature")), F.struct(F.lit("fact").alias("kind"), F.concat_ws("=", F.col("p_brand"), F.col("p_size").cast("string")).alias("feature")), F.struct(F.lit("line").alias("kind"), F.upper("p_name").alias("feature")), F.struct(F.lit("context").alias("kind"), F.col("l_returnflag").alias("feature"))))
    return rows.select(F.col("l_orderkey").alias("job"), each.alias("f")).select("job", "f.*")


FEATURES = "(SELECT DISTINCT l_orderkey AS job, f.kind, f.feature FROM (SELECT l_orderkey, unnest([{'kind': 'tag', 'feature': p_type}, {'kind': 'fact', 'feature': p_brand || '=' || p_size}, {'kind': 'line', 'feature': upper(p_name)}, {'kind': 'context', 'feature': l_returnflag}]) AS f FROM lineitem JOIN part ON l_partkey = p_partkey))"
TARGET = 33


def similar_orders(spark, sf):
    all_features = features(spark, sf)
    return search.similar(all_features.filter(F.col("job") != TARGET), all_features.filter(F.col("job") == TARGET), top=15)


SIMILAR = f"""
WITH f AS {FEATURES}, t AS (SELECT DISTINCT kind, feature FROM f WHERE job = {TARGET}), o AS (SELECT * FROM f WHERE job <> {TARGET}),
d AS (SELECT kind, feature, count(*) AS df FROM o JOIN t USING (kind, feature) GROUP BY 1, 2)
SELECT job, CAST(sum(CAST(CAST(CASE kind WHEN 'tag' THEN 1.0 WHEN 'context' THEN 1.5 WHEN 'fact' THEN 2.0 ELSE 0.5 END AS DOUBLE) / df AS DECIMAL(20,12))) AS DOUBLE) AS score, count(*) AS shared FROM o JOIN d USING (kind, feature) GROUP BY job ORDER BY score DESC, job DESC LIMIT 15"""


def reuse_shortlist(spark, sf):
    """The best of all other orders, by what is rare among all of them."""
    all_features = features(spark, sf)
    ranked = search.similar(all_features.filter(F.col("job") != TARGET), all_features.filter(F.col("job") == TARGET), top=15)
    return search.reuse(ranked, least=0.001, top=3)


REUSE = "SELECT job, score, shared FROM (" + SIMILAR + ") WHERE score >= 0.001 ORDER BY score DESC, job DESC LIMIT 3"


def value_similarity(spark, sf):
    p = table(spark, sf, "part")
    a = F.concat_ws(" | ", "p_type", "p_brand")
    b = F.concat_ws(", ", F.when(F.col("p_size") > 10, F.col("p_brand")), F.lower("p_type"), F.lit("n/a"), F.when(F.col("p_size") > 30, F.col("p_name")))
    return p.select("p_partkey", F.round(search.value_likeness(a, F.when(F.col("p_size") > 3, b)), 6).alias("likeness"))


VALUE = """
SELECT p_partkey, round(CASE WHEN p_size <= 3 THEN 0.5 ELSE 2.0 * (1 + CASE WHEN p_size > 10 THEN 1 ELSE 0 END) / (2 + 1 + CASE WHEN p_size > 10 THEN 1 ELSE 0 END + CASE WHEN p_size > 30 THEN 1 ELSE 0 END) END, 6) AS likeness FROM part"""


def two_orders(spark, sf):
    """Each order with the next, as two sets of fields."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_custkey") % 3).cast("string")).alias("c"))
    return o.alias("a").join(o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("c").alias("c2")).alias("b"), "o_orderkey")


TWO = """(SELECT a.*, b.s AS s2, b.p AS p2, b.c AS c2 FROM (SELECT o_orderkey, upper(o_orderstatus) AS s, upper(o_orderpriority) AS p, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 3 AS VARCHAR) END AS c FROM orders) a
JOIN (SELECT o_orderkey - 1 AS o_orderkey, upper(o_orderstatus) AS s, upper(o_orderpriority) AS p, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 3 AS VARCHAR) END AS c FROM orders) b USING (o_orderkey))"""


def fields(suffix=""):
    return {"Design": F.col(f"c{suffix}"), "Size": F.col(f"s{suffix}"), "Class": F.col(f"p{suffix}")}


def base_fan_match(spark, sf):
    return two_orders(spark, sf).select("o_orderkey", search.base_fan(fields(), fields("2")).alias("score"))


def core_similarity(spark, sf):
    got = search.core_likeness(fields(), fields("2"))
    return two_orders(spark, sf).select("o_orderkey", F.round(got["score"], 6).alias("score"), F.round(got["coverage"], 6).alias("coverage"))


CORE = f"""
WITH t AS {TWO}, k AS (SELECT *, c IS NOT NULL AND c2 IS NOT NULL AS kd, coalesce(c = c2, false) AS ks FROM t),
x AS (SELECT o_orderkey, (CASE WHEN kd THEN (c = c2)::INT ELSE 0.5 END * 0.10 + CASE WHEN ks OR (c IS NULL AND c2 IS NULL) THEN (s = s2)::INT ELSE 0.5 END * 0.10 + (p = p2)::INT * 0.04) / 0.24 AS pts, (kd::INT * 0.10 + (ks OR (c IS NULL AND c2 IS NULL))::INT * 0.10 + 0.04) / 0.24 AS cov FROM k)
SELECT o_orderkey, round(CAST(pts AS DOUBLE) * (0.5 + 0.5 * CAST(cov AS DOUBLE)), 6) AS score, round(CAST(cov AS DOUBLE), 6) AS coverage FROM x"""


def order_similarity(spark, sf):
    """Greedy pairing of the parts of each order with those of the next."""
    parts = items(spark, sf).groupBy("job").agg(F.collect_list(F.struct(F.col("norm").alias("name"), F.array_join("tags", "|").alias("value"))).alias("parts"))
    both = parts.join(parts.select((F.col("job") - 1).alias("job"), F.col("parts").alias("others")), "job")
    return search.collection_likeness(both, "parts", "others").select("job", F.round("likeness", 6).alias("likeness"))


COMPONENTS = ["Inlet Damper", "Actuator", "Motor", "Shaft Seal", "Wheel", "Epoxy coating", "Nameplate", "Rain Hood", "motor", "Coupling guard"]


NO_COMPONENTS = "array<struct<name:string,attrs:map<string,string>>>"


def bare_lines(spark, sf):
    """job, line: what a component is made of, few bytes to shuffle."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p_partkey"), F.min("l_quantity").cast("int").alias("q")).join(p, "p_partkey")
    kind, rest = (F.col("p_partkey") % len(COMPONENTS)).cast("tinyint"), (F.col("q") % 3).cast("tinyint")
    return l.select(F.col("l_orderkey").alias("job"), F.struct("l_linenumber", kind.alias("kind"), rest.alias("rest"), "p_brand", "p_type", "p_size").alias("line"))


def component(line):
    """A component for a line: named by its part, with attributes of line and part."""
    name = F.element_at(F.array(*map(F.lit, COMPONENTS)), (line["kind"] + 1).cast("int"))
    attrs = F.map_filter(F.create_map(F.lit("quantity"), F.concat(line["rest"].cast("string"), F.lit(" ea")), F.lit("material"), F.concat_ws(" | ", line["p_brand"], line["p_type"]), F.lit("note_text"), line["p_type"], F.lit("damper_size"), F.when(line["p_size"] > 25, line["p_size"].cast("string"))), lambda k, v: v.isNotNull())
    return F.struct(name.alias("name"), attrs.alias("attrs"))


def bare_orders(spark, sf):
    """job, fields: what specs are made of."""
    kind = F.when(F.col("o_custkey") % 4 > 0, (F.col("o_custkey") % 3).cast("string"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.struct("o_orderstatus", "o_orderpriority", kind.alias("class")).alias("fields"))


def whole_order(fields, components):
    specs = F.create_map(F.lit("Design"), fields["o_orderstatus"], F.lit("Size"), fields["o_orderpriority"], F.lit("Class"), fields["class"])
    return F.struct(specs.alias("specs"), components.alias("components"), (F.size(components) > 0).alias("observed"))


def whole_orders(spark, sf):
    """Orders with specs, and a component for each line."""
    parts = bare_lines(spark, sf).groupBy("job").agg(F.transform(F.array_sort(F.collect_list("line")), component).alias("components"))
    rows = bare_orders(spark, sf).join(parts, "job", "left").withColumn("components", F.coalesce("components", F.array().cast(NO_COMPONENTS)))
    return rows.select("job", whole_order(F.col("fields"), F.col("components")).alias("o"))


#: Orders of so many consecutive numbers lie together.
RANGE = 64


def ranged(rows):
    """Rows of orders by the first number of their range; those that begin a range lie at the end of the former one as well."""
    first = lambda job: job - F.pmod(job, F.lit(RANGE))
    return spread(rows.filter("job is not null").withColumn("first", F.explode(F.array_distinct(F.array(first(F.col("job")), first(F.col("job") - 1))))), "first")


def order_ranges(spark, sf):
    """first, orders (job, pinned: the first component, prepared; o: likeness.bare()) of each range. Lines and orders are shuffled as few
    bytes, and components are made where they stay."""
    lines = ranged(bare_lines(spark, sf)).groupBy("first").agg(F.collect_list(F.struct("job", "line")).alias("lines"))
    orders = ranged(bare_orders(spark, sf)).groupBy("first").agg(F.collect_list(F.struct("job", "fields")).alias("orders"))

    def one(o):
        own = F.transform(F.filter(F.coalesce("lines", F.array()), lambda x: x["job"] == o["job"]), lambda x: x["line"])
        whole = lambda cs: whole_order(o["fields"], cs)
        made = lambda w, ps: F.struct(o["job"].alias("job"), F.get(ps, F.lit(0)).alias("pinned"), likeness.bare(w, ps).alias("o"))
        return let(F.transform(F.array_sort(own), component), lambda cs: let(likeness.prepared(cs), lambda ps: made(whole(cs), ps)))

    return orders.join(lines, "first", "left").select("first", F.transform("orders", one).alias("orders"))


def order_likeness(spark, sf):
    """Each order with the next; in focus its first component, which should be of that component's first material. What is compared
    of an order is worked out once, for both pairs that it is in, and pairs are made within ranges: nothing of that is shuffled."""
    ready = F.transform("orders", lambda x: F.struct(x["job"].alias("job"), x["pinned"].alias("first"), likeness.slotted(x["o"]).alias("o")))
    next_to = lambda a, xs: F.transform(F.filter(xs, lambda b: b["job"] == a["job"] + 1), lambda b: F.struct(a["job"].alias("job"), a["first"].alias("first"), a["o"].alias("o"), b["o"].alias("other")))
    ranges = stored(order_ranges(spark, sf), "order-likeness")
    pairs = ranges.select(F.explode(let(ready, lambda xs: F.flatten(F.transform(xs, lambda a: next_to(a, xs))))).alias("p")).select("p.*")
    both = pairs.withColumn("r", likeness.ready_likeness(F.col("o"), F.col("other")))
    focus = likeness.focused(F.col("r.score"), F.col("first"), F.col("other.components"), {"material": "PROMO"})
    rounded = [F.round(f"r.{c}", 6).alias(c) for c in ("score", "raw", "coverage")]
    return both.select("job", *rounded, "r.shared", F.round(focus["score"], 6).alias("focused"), focus["matched"].alias("pins"))


ROSTER = {"Ana Holt": ["Ana Holt", "A. Holt"], "Ben": ["Ben"], "The One": ["the"]}


def engineer_detect(spark, sf):
    d = table(spark, sf, "documents")
    said = F.concat(F.col("text"), F.element_at(F.array(*map(F.lit, [" by A. Holt", "; BEN-made", " Bens", ""])), (F.col("doc_id") % 4 + 1).cast("int")))
    return d.select("doc_id", F.array_join(text.names_in(said, ROSTER), ", ").alias("names"))


ENGINEERS = """
WITH s AS (SELECT doc_id, ' ' || text || ([' by A. Holt', '; BEN-made', ' Bens', ''])[doc_id % 4 + 1] || ' ' AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '[^A-Za-z0-9](Ana Holt|A. Holt)[^A-Za-z0-9]', 'i') THEN 'Ana Holt' END, CASE WHEN regexp_matches(t, '[^A-Za-z0-9]ben[^A-Za-z0-9]', 'i') THEN 'Ben' END, CASE WHEN regexp_matches(t, '[^A-Za-z0-9]the[^A-Za-z0-9]', 'i') THEN 'The One' END], lambda x: x IS NOT NULL), ', ') AS names FROM s"""


def scalar_columns(spark, sf):
    """Labels, urgency and dates of the queue."""
    b = board(spark, sf, D2)
    ship, today = F.col("first_ship").cast("date"), F.lit(D2).cast("date")
    return b.select(
        "job",
        scalars.co_label(F.col("co_number")).alias("label"),
        scalars.urgency(ship, today).alias("urgency"),
        scalars.previous_business_day(ship).alias("before"),
        scalars.serial_day(ship).alias("serial"),
        scalars.flags({"UNAPPROVED": F.col("status") == "O", "CREDIT HOLD": F.col("price") > 300000, "NOTES": F.col("priority").startswith("1")}).alias("flags"),
        scalars.run_label(F.col("due_lines")).alias("runs"),
        scalars.route_owner([(F.col("priority").startswith("1"), "rush"), (F.col("due_lines") > 2, "big")], "desk").alias("owner"),
    )


SCALARS = f"""
SELECT job, CASE WHEN co_number > 0 THEN 'CO#' || co_number ELSE '' END AS label,
  CASE WHEN CAST(first_ship AS DATE) < DATE '{D2}' THEN 'overdue' WHEN CAST(first_ship AS DATE) = DATE '{D2}' THEN 'due today' WHEN CAST(first_ship AS DATE) <= DATE '{D2}' + 3 THEN 'soon' ELSE 'none' END AS urgency,
  CAST(first_ship AS DATE) - CASE dayofweek(CAST(first_ship AS DATE)) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS before, CAST(first_ship AS DATE) - DATE '1899-12-30' AS serial,
  concat_ws(', ', CASE WHEN status = 'O' THEN 'UNAPPROVED' END, CASE WHEN price > 300000 THEN 'CREDIT HOLD' END, CASE WHEN priority LIKE '1%' THEN 'NOTES' END) AS flags,
  CASE WHEN due_lines > 1 THEN 'YES (' || due_lines || ')' WHEN due_lines = 1 THEN 'YES' ELSE '' END AS runs, CASE WHEN priority LIKE '1%' THEN 'rush' WHEN due_lines > 2 THEN 'big' ELSE 'desk' END AS owner FROM {B2}"""


def split_columns(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    arr = F.concat(F.element_at(F.array(*map(F.lit, ["A/4V ", "Arr. 9 ", "ARRANGEMENT 10x ", ""])), (k + 1).cast("int")), F.col("p_name"))
    size = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ["", " 1/2", ".5", "-3/4"])), (k + 1).cast("int")), F.lit(" "), F.col("p_brand"))
    design = F.element_at(F.array(F.concat(F.lit("DESIGN "), F.col("p_brand")), F.concat(F.col("p_size").cast("string"), F.lit("-0-0000")), F.col("p_name"), F.lit(" x ")), (k + 1).cast("int"))
    a, s = scalars.split_arrangement(arr), scalars.split_size(size)
    return p.select("p_partkey", a["code"].alias("code"), a["note"].alias("note"), s["size"].alias("size"), s["rest"].alias("rest"), scalars.design_of(design).alias("design"))


SPLIT = """
SELECT p_partkey, (['A/4V', 'A/9', 'A/10X', ''])[p_partkey % 4 + 1] AS code, p_name AS note, p_size || (['', ' 1/2', '.5', '-3/4'])[p_partkey % 4 + 1] AS size, p_brand AS rest, ([p_brand, CAST(p_size AS VARCHAR), p_name, 'x'])[p_partkey % 4 + 1] AS design FROM part"""


# lines and what they are: without an open section, and within one
KINDS = [
    ("Accessories:", "section_start", "section_start"), ("  Additional Features", "section_start", "section_start"), ("Additional features that a heading has no room for at all", "text", "item_section"),
    ("Notes", "text", "section_end"), ("Total 12.00", "skip", "section_end"), ("FREIGHT ALLOWED", "skip", "skip"), ("www.example.com", "skip", "skip"), ("do not stack", "skip", "skip"), ("drawings: do not stack", "text", "item_section"),
    ("Inlet screen L 45.00", "item_priced", "item_priced"), ("Shaft seal N/C", "item_priced", "item_priced"), ("1200 1750 45.00", "text", "text"), ("AB L", "text", "text"), ("Drain L", "item_priced", "item_priced"), ("Rain hood L STD", "item_priced", "item_priced"),
    ("Base Fan size 27", "item_section", "item_section"), ("plain words", "text", "item_section"), ("   ", "blank", "blank"), ("co#2 changed", "skip", "skip"), ("SCOPE OF SUPPLY", "section_start", "section_start"),
]


def classify_lines(spark, sf):
    """Events of a user as lines of a document."""
    line = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), ((F.col("event_id") * 7 + F.col("user_id")) % len(KINDS) + 1).cast("int"))
    rows = documents.classified(table(spark, sf, "events").select("user_id", "event_id", line.alias("line")), "user_id", "event_id", "line")
    return rows.select("event_id", "kind", F.coalesce("section", F.lit("")).alias("section"))


CLASSIFY = f"""
WITH k AS (SELECT unnest([{", ".join(f"{{'i': {i}, 'line': '{a}', 'out': '{b}', 'ins': '{c}'}}" for i, (a, b, c) in enumerate(KINDS))}]) AS k), e AS (SELECT event_id, user_id, k.k AS k FROM events JOIN k ON k.k.i = (event_id * 7 + user_id) % {len(KINDS)}),
s AS (SELECT *, CASE WHEN k.out = 'section_start' THEN event_id WHEN k.ins = 'section_end' THEN -event_id END AS ev FROM e),
w AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, last_value(ev IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS after FROM s)
SELECT w.event_id, CASE WHEN before > 0 THEN w.k.ins ELSE w.k.out END AS kind, CASE WHEN after > 0 THEN rtrim(trim(o.k.line), ':') ELSE '' END AS section FROM w LEFT JOIN e o ON o.event_id = w.after"""


def validate_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("expected"))
    found = F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), F.col("expected"))).otherwise(F.concat(F.lit(" "), F.col("expected"), F.lit("-")))
    return o.select("o_orderkey", text.validation(F.col("expected"), found, F.col("o_orderkey") % 11 > 0).alias("verdict"))


def contact_emails(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(text.emails(F.col("text"))), ",").alias("emails")).filter("emails <> ''")


QUERIES = {
    "normalize_lines": (normalize_lines, "SELECT p_partkey, upper(p_name) || ' WITH DRAIN 316 STAINLESS STEEL BEARING' AS norm FROM part"),
    "normalize_text": (normalize_documents, NORMALIZE),
    "tag_items": (tag_items, TAG),
    "search_all": (search_all, search_sql("bool_or(contains(hay, 'WIDGET')) AND bool_or(contains(hay, 'PROMO'))", "contains(hay, 'WIDGET') OR contains(hay, 'PROMO')")),
    "search_any": (search_any, search_sql("bool_or(contains(hay, 'BOLT')) OR bool_or(contains(hay, 'LARGE'))", "contains(hay, 'BOLT') OR contains(hay, 'LARGE')")),
    "search_tag": (search_tag, search_sql("bool_or(contains(hay, 'GEAR')) AND bool_or(list_contains(tags, 'SMALL'))", "contains(hay, 'GEAR') OR list_contains(tags, 'SMALL')")),
    "fuzzy_search": (fuzzy_search, None),
    "explorer_search": (explorer_search, EXPLORER),
    "similar_orders": (similar_orders, SIMILAR),
    "reuse_shortlist": (reuse_shortlist, REUSE),
    "value_similarity": (value_similarity, VALUE),
    "base_fan_match": (base_fan_match, f"SELECT o_orderkey, CASE WHEN s <> s2 OR p <> p2 OR coalesce(c <> c2, false) THEN 0.0 WHEN c IS NULL OR c2 IS NULL THEN 0.995 ELSE 1.0 END::DOUBLE AS score FROM {TWO}"),
    "core_similarity": (core_similarity, CORE),
    "order_similarity": (order_similarity, None),
    "order_likeness": (order_likeness, None),
    "engineer_detect": (engineer_detect, ENGINEERS),
    "scalar_columns": (scalar_columns, SCALARS),
    "split_columns": (split_columns, SPLIT),
    "classify_lines": (classify_lines, CLASSIFY),
    "validate_orders": (validate_orders, "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'UNREADABLE' WHEN o_orderkey % 7 = 0 THEN 'UNVERIFIABLE' WHEN o_orderkey % 5 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS verdict FROM orders"),
    "contact_emails": (contact_emails, r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+'))), ',') AS emails FROM documents WHERE regexp_matches(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+')"),
}
