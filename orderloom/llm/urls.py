"""URL filters: gradient-boosted trees on lexical features, learned from URLs that rules label.

Rules judge what they fit. They also label the training rows: a bounded sample (max_rows of each verdict, those of least hash)
of the distinct URLs that some rule fits. Features are lengths, depth, digit ratio, entropy, parameter counts and statistics of
host suffixes; the latter are smoothed block rates of the last two labels of the host, among all rows that some rule fits. Trees
judge the URLs that no rule fits. All features are column expressions; trees are grown by Spark's own distributed trainer.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.common import stored, table

#: verdict, host, path prefix
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens", "f_entropy", "f_params", "f_fragment", "f_secure", "f_extension", "f_suffix_rate", "f_suffix_count"]


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; null or no "://": empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    _, own, prefix = rule
    return ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(prefix))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equally long ones the first given), else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        hit = fits(rule, host, path)
        text, verdict = F.when(hit, rule[1] + rule[2]).otherwise(text), F.when(hit, rule[0]).otherwise(verdict)
    return text, verdict


def entropy(text: Column) -> Column:
    """Bits a character, from counts of each character."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = F.transform(chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return -F.aggregate(share, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def lexical(urls: DataFrame, url: Column, host: Column, path: Column) -> DataFrame:
    text = F.coalesce(url, F.lit(""))
    length = F.greatest(F.length(text), F.lit(1))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    count = lambda t, pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    return urls.withColumns(
        {
            "f_length": F.length(text).cast("double"),
            "f_host_length": F.length(host).cast("double"),
            "f_path_length": F.length(path).cast("double"),
            "f_depth": count(path, "/[^/]"),
            "f_labels": F.when(host == "", 0.0).otherwise(count(host, r"\.") + 1),
            "f_digits": count(text, "[0-9]") / length,
            "f_host_digits": count(host, "[0-9]"),
            "f_hyphens": count(host, "-"),
            "f_entropy": entropy(text),
            "f_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
            "f_fragment": F.contains(text, F.lit("#")).cast("double"),
            "f_secure": F.startswith(F.lower(text), F.lit("https:")).cast("double"),
            "f_extension": F.regexp_like(path, F.lit(r"\.[A-Za-z0-9]{1,5}$")).cast("double"),
            "suffix": suffix_of(host),
        }
    )


def with_suffixes(rows: DataFrame, suffixes: DataFrame, rate: float, smooth: float = 10.0, own: tuple[Column, Column] | None = None) -> DataFrame:
    """suffixes: a row for each suffix of labelled rows (seen, blocked); the planner knows its size and broadcasts it where it is
    small. own: what a row itself adds to both, which is taken off, so that no row learns from its own label."""
    seen, blocked = (F.coalesce(c, F.lit(0)) - (o if own else 0) for c, o in zip(("seen", "blocked"), own or (None, None)))
    joined = rows.join(suffixes, "suffix", "left")
    return joined.withColumns({"f_suffix_rate": (blocked + smooth * rate) / (seen + smooth), "f_suffix_count": F.log1p(seen.cast("double"))}).drop("seen", "blocked", "suffix")


def assemble(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows)


def train(labelled: DataFrame, max_rows: int = 8_192, trees: int = 10, depth: int = 4, smooth: float = 10.0) -> tuple[GBTClassificationModel | None, DataFrame, float]:
    """labelled: url, host, path, verdict. The model, suffix statistics and the block rate, both of all rows; no model where one verdict alone is labelled."""
    counts = labelled.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.count("*").alias("seen"), F.count_if(F.col("verdict") == "block").cast("double").alias("blocked"))
    counted = stored(counts, "suffix-counts")
    known = counted.agg(F.sum("seen").alias("n"), F.sum("blocked").alias("b")).first()
    rate = (known.b or 0.0) / (known.n or 1)
    if rate in (0.0, 1.0):
        return None, counted, rate
    distinct = labelled.groupBy("url", "host", "path", "verdict").agg(F.count("*").alias("copies"))
    parts = [distinct.filter(F.col("verdict") == v).orderBy(F.xxhash64("url"), "url").limit(max_rows) for v in ("block", "allow")]
    chosen = parts[0].unionByName(parts[1]).withColumn("label", (F.col("verdict") == "block").cast("double"))
    sample = stored(lexical(chosen, F.col("url"), F.col("host"), F.col("path")), "labelled-urls")
    rows = assemble(with_suffixes(sample, counted, rate, smooth, (F.col("copies"), F.col("copies") * F.col("label")))).select("features", "label").repartition(4)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=7, stepSize=0.2).fit(rows)
    return model, counted, rate


def judged(urls: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", max_rows: int = 8_192) -> DataFrame:
    """id_col, host, path, rule, verdict and score (the trees' probability of block) of every row.

    A null URL, or one without "://", has an empty host and path and no rule; the trees judge it. Repeated rows give a row
    each. Rules of equal length: the first given wins. An empty table gives an empty one; where no rule fits any URL, or
    rules of one verdict only, the trees' place is taken by the block rate of the labelled URLs. Other columns are left out."""
    rules = RULES if rules is None else rules
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    text, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "given": verdict})
    with_features = lexical(rows, F.col("url"), F.col("host"), F.col("path"))
    model, suffixes, rate = train(rows.filter(F.col("given").isNotNull()).withColumnRenamed("given", "verdict"), max_rows)
    ready = with_suffixes(with_features, suffixes, rate)
    if model is None:
        ready = ready.withColumn("score", F.lit(float(rate)))
    else:
        ready = model.transform(assemble(ready)).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return ready.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
