"""Search over line items, and likeness of orders."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.functions.text import compare_form, let, normalize, tags
from orderloom.sources.steps import spread

#: Score of a field that one side does not know.
UNKNOWN = 0.5
# fixed values: weights of shared features by kind
WEIGHTS = {"tag": 1.0, "context": 1.5, "fact": 2.0, "line": 0.5}
# fixed values: weights of an order's core fields
CORE = {"Design": 0.10, "Size": 0.10, "Arrangement": 0.06, "Class": 0.04, "Wheel": 0.05, "% Width": 0.04, "Rotation": 0.025, "Discharge": 0.025, "Motor Pos": 0.02, "Design Temp": 0.013333, "Max Temp": 0.013333, "Special Temp": 0.013334}
# fixed values: scores of a search part
EXACT, CONTAINS, WORDS, FOUND = 1.0, 0.92, 0.55, 0.90


def tagged(items: DataFrame, line: str, rules: dict[str, list[str]] | None = None, strip_columns: bool = True) -> DataFrame:
    """items with norm and tags. Rules are many and lines repeat: they are normalised and tagged once per distinct line, then
    joined back."""
    both = let(normalize(F.col(line), strip_columns), lambda n: F.struct(n.alias("norm"), tags(n, rules).alias("tags")))
    lines = items.select(line).distinct().withColumn("__r", both).select(line, "__r.norm", "__r.tags")
    return items.join(lines, line, "left")


def search(items: DataFrame, job: str, text: str, tags: str, terms: list[str], any_term: bool = False, tag: str | None = None) -> DataFrame:
    """Items that meet a criterion, of the jobs that meet all of them (with any_term: one of the terms). One pass marks the
    items, one aggregation decides on the jobs."""
    hits = [F.upper(F.concat_ws("\n", F.col(text), F.col(tags))).contains(t.upper()) for t in terms]
    tagged = F.exists(tags, lambda x: F.upper(x) == tag.upper()) if tag else F.lit(True)
    marked = items.withColumn("__hits", F.array(*hits) if hits else F.array().cast("array<boolean>")).withColumn("__tag", tagged)
    of_job = [F.max(F.element_at("__hits", k + 1)) for k in range(len(terms))]
    good = marked.groupBy(job).agg(*(c.alias(f"__t{k}") for k, c in enumerate(of_job)), F.max("__tag").alias("__any_tag"))
    rule = F.col("__any_tag")
    if terms:
        found = [F.col(f"__t{k}") for k in range(len(terms))]
        rule = rule & (F.greatest(*found, F.lit(False)) if any_term else F.least(*found, F.lit(True)))
    matched = F.exists("__hits", lambda h: h) | (F.col("__tag") if tag else F.lit(not terms))
    return marked.join(good.filter(rule).select(job), job, "left_semi").filter(matched).drop("__hits", "__tag")


# fixed values: what separates words, as Python has it
_BLANKS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"


def may_be_near(text: Column, term: str, least: float) -> Column:
    """Whether a window of as many words as the term has enough of its characters, in whatever order: without that its ratio, twice
    the matching characters by both lengths, cannot be `least`. Both are in upper case."""
    n, counts = max(1, len(term.split())), Counter(term)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _BLANKS), lambda w: w != "")
    last = lambda w: F.greatest(F.size(w) - F.lit(n), F.lit(0))
    windows = let(words, lambda ws: F.transform(F.sequence(F.lit(1), last(ws) + 1), lambda i: F.array_join(F.slice(ws, i, n), " ")))

    def shared(window: Column) -> Column:
        return sum((F.least(F.lit(k), F.length(window) - F.length(F.replace(window, F.lit(c), F.lit("")))) for c, k in counts.items()), F.lit(0))

    return F.exists(windows, lambda w: (w != "") & (2 * shared(w) >= F.lit(least - 1e-9) * (F.length(w) + len(term))))


def fuzzy(items: DataFrame, text: str, term: str, least: float = 0.84) -> DataFrame:
    """Items with a window of as many words as the term whose matching-blocks ratio is `least` or more. Only texts that can reach
    it by their characters are compared in Python."""

    @F.pandas_udf("boolean")
    def near(values: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        wanted, n = term.upper(), max(1, len(term.split()))

        def hit(value: str | None) -> bool:
            words = (value or "").split()
            windows = (" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))
            return any(w and SequenceMatcher(None, wanted, w).ratio() >= least for w in windows)

        cache: dict = {}
        return pd.Series([cache[v] if v in cache else cache.setdefault(v, hit(v)) for v in values])

    return items.filter(may_be_near(F.upper(text), term.upper(), least)).filter(near(F.upper(text)))


#: a target of more features than this is joined without broadcast
MOST_WANTED = 10_000


def frequencies(features: DataFrame) -> DataFrame:
    """In how many jobs each feature (kind, feature) occurs. features: job, kind, feature, distinct."""
    return features.groupBy("kind", "feature").agg(F.count("*").alias("df"))


def similar(features: DataFrame, target: DataFrame, only: DataFrame | None = None, top: int = 15) -> DataFrame:
    """job, score, shared: jobs by the weighted rarity of what they share with the target's features (kind, feature). Rows of
    features may repeat.

    The target's features are sifted out before anything is shuffled: a target of at most MOST_WANTED features is broadcast, a
    larger one is joined as the optimiser chooses. What is left is dealt by job once, over all tasks. Frequencies come from the same
    sifted rows."""
    wanted = target.select("kind", "feature").distinct()
    few = F.broadcast if wanted.limit(MOST_WANTED + 1).count() <= MOST_WANTED else lambda frame: frame
    rows = spread(features.select("job", "kind", "feature").join(few(wanted), ["kind", "feature"], "left_semi"), "job")
    hits = (rows if only is None else rows.join(only.hint("shuffle_hash"), "job", "left_semi")).distinct()
    weight = F.lit(0.0)
    for kind, w in WEIGHTS.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    scored = hits.join(few(frequencies(hits)), ["kind", "feature"])
    scored = scored.groupBy("job").agg(F.sum((weight / F.col("df")).cast("decimal(20,12)")).cast("double").alias("score"), F.count("*").alias("shared"))
    return scored.orderBy(F.desc("score"), F.desc("job")).limit(top) if top else scored


def reuse(ranked: DataFrame, least: float = 0.5, top: int = 3) -> DataFrame:
    """The threshold is applied to the rows that were ranked."""
    return ranked.filter(F.col("score") >= least).orderBy(F.desc("score"), F.desc("job")).limit(top)


def parts(value: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"\s*(?:\||,)\s*"), compare_form), lambda x: x != ""))


def value_likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of the values' parts; UNKNOWN where one side has none."""
    x, y = parts(a), parts(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), UNKNOWN).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def base_fan(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """1 all fields equal, 0.995 all but an unknown Design, 0.5 none unequal but others unknown, 0 one unequal."""
    known = {f: (compare_form(a[f]) != "") & (compare_form(b[f]) != "") for f in a}
    unequal = [known[f] & (compare_form(a[f]) != compare_form(b[f])) for f in a]
    missing = [~known[f] for f in a if f != "Design"]
    any_of = lambda cs: F.greatest(*cs, F.lit(False))
    return F.when(any_of(unequal), 0.0).when(any_of(missing), 0.5).when(~known.get("Design", F.lit(True)), 0.995).otherwise(1.0)


def core_likeness(a: dict[str, Column], b: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """struct(score, coverage) over core fields: equal values count whole, unknown ones half and less coverage; sizes of
    different designs are not compared. The score is discounted to half at no coverage."""
    weights = {f: w for f, w in (weights or CORE).items() if f in a}
    total = sum(weights.values())
    points, known = F.lit(0.0), F.lit(0.0)
    for f, w in weights.items():
        x, y = compare_form(a[f]), compare_form(b[f])
        there = (x != "") & (y != "")
        if f == "Size" and "Design" in a:
            there = there & (compare_form(a["Design"]) == compare_form(b["Design"]))
        points = points + F.when(there, value_likeness(a[f], b[f])).otherwise(UNKNOWN) * w
        known = known + F.when(there, w).otherwise(0.0)
    coverage = known / total
    return F.struct(((points / total) * (0.5 + 0.5 * coverage)).alias("score"), coverage.alias("coverage"))


def search_parts(value: str) -> list[str]:
    import re

    found = (re.sub(r"\s+", " ", re.sub(r"[^A-Z0-9.%+/-]+", " ", p.upper())).strip() for p in re.split(r"[,;]+|\s+\b(?:AND|OR)\b\s+", value, flags=re.I))
    return [p for p in found if p]


def explorer(haystacks: DataFrame, job: str, text: str, query: str, top: int = 10) -> DataFrame:
    """job, score, matched, all_matched: the best haystack of each part (equal, containing, or some of its words), averaged."""
    asked = search_parts(query)
    scores = []
    for part in asked:
        words = part.split(" ")
        some = sum((F.when(F.col(text).contains(w), 1).otherwise(0) for w in words), F.lit(0)) if len(words) > 1 else F.lit(0)
        scores.append(F.when(F.col(text) == part, EXACT).when(F.col(text).contains(part), CONTAINS).otherwise(WORDS * some / len(words)))
    best = haystacks.filter(F.col(text) != "").groupBy(job).agg(*(F.max(s).alias(f"__s{k}") for k, s in enumerate(scores)))
    own = [F.col(f"__s{k}") for k in range(len(asked))]
    matched = sum((F.when(s >= FOUND, 1).otherwise(0) for s in own), F.lit(0))
    out = best.select(job, F.least(F.lit(1.0), sum(own, F.lit(0.0)) / len(asked)).alias("score"), matched.alias("matched"), (matched == len(asked)).alias("all_matched"))
    return out.filter("score > 0").orderBy(F.desc("all_matched"), F.desc("score"), F.desc("matched"), F.desc(job)).limit(top)


def collection_likeness(rows: DataFrame, left: str, right: str, into: str = "likeness") -> DataFrame:
    """Greedy best pairing of two arrays of (name, value) parts, the shorter one choosing first, over the longer one's length.

    Choosing one after another is no column expression; each row's arrays are small and stay in their row."""

    def score(a: dict, b: dict) -> float:
        x, y = ({p.strip().upper() for p in (v["value"] or "").replace("|", ",").split(",") if p.strip()} for v in (a, b))
        value = UNKNOWN if not x or not y else 2 * len(x & y) / (len(x) + len(y))
        return 0.5 * ((a["name"] or "").upper() == (b["name"] or "").upper()) + 0.5 * value

    def pair(a: list, b: list) -> float:
        if len(a) == 0 and len(b) == 0:
            return 1.0
        if len(a) == 0 or len(b) == 0:
            return 0.0
        key = lambda v: (v["name"] or "", v["value"] or "")
        few, many = sorted((sorted(a, key=key), sorted(b, key=key)), key=lambda s: (len(s), [key(v) for v in s]))
        free, total = list(many), 0.0
        for one in few:
            got = [score(one, other) for other in free]
            k = got.index(max(got))
            total += got[k]
            free.pop(k)
        return total / len(many)

    @F.pandas_udf("double")
    def paired(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([pair(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b)], dtype="float64")

    return rows.withColumn(into, paired(left, right))


def top_each(pairs: DataFrame, source: str, order: list[Column], top: int = 8) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(source).orderBy(*order))).filter(F.col("rank") <= top)
