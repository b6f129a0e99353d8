"""Roll-ups, audits and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tag_counts(items: DataFrame, job: str, tags: str) -> DataFrame:
    """tag, jobs, items. Counted in two steps, a row for each job and tag between them."""
    each = items.select(job, F.explode(tags).alias("tag")).groupBy("tag", job).agg(F.count("*").alias("n"))
    return each.groupBy("tag").agg(F.count("*").alias("jobs"), F.sum("n").alias("items"))


def audit(items: DataFrame, by: list[str], job: str, most: int | None = None) -> DataFrame:
    """by, items, jobs: the first `most` jobs (all if None), by number, joined by commas. Jobs are ranked before they are gathered."""
    each = items.groupBy(*by, job).agg(F.count("*").alias("n"))
    if most is None:
        return each.groupBy(*by).agg(F.sum("n").alias("items"), F.array_join(F.array_sort(F.collect_list(job)).cast("array<string>"), ",").alias("jobs"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(job))
    first = each.withColumn("place", place).filter(F.col("place") <= most).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(job)).cast("array<string>"), ",").alias("jobs"))
    return each.groupBy(*by).agg(F.sum("n").alias("items")).join(first, by)


def mentions(items: DataFrame, by: list[str], job: str) -> DataFrame:
    """by, job, n: how often each job has each value, and a row of level "total" with the value's sum, its job null. Jobs are rows,
    so a value that all jobs have is no larger than another."""
    each = items.groupBy(*by, job).agg(F.count("*").alias("n"))
    return each.select(*by, F.lit("job").alias("level"), job, "n").unionByName(each.groupBy(*by).agg(F.sum("n").alias("n")).select(*by, F.lit("total").alias("level"), F.lit(None).cast(items.schema[job].dataType).alias(job), "n"))


def rates(rows: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """Rows, and for each flag how many have it and at what rate (four places)."""
    n = F.count("*")
    columns = [c for name, flag in flags.items() for c in (F.count_if(flag).alias(name), F.round(F.count_if(flag) / n, 4).alias(f"{name}_rate"))]
    return rows.groupBy(by).agg(n.alias("n"), *columns)


def set_audit(trusted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    missing = trusted.join(stored, key, "left_anti").select(key, F.lit("missing").alias("finding"))
    extra = stored.join(trusted, key, "left_anti").select(key, F.lit("extra").alias("finding"))
    return missing.unionByName(extra)


def actions(figures: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Names of the rules that hold, in the order given."""
    return figures.withColumn("actions", F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))))


def totals(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Counts and sums by group, with a footer whose group is null."""
    return rows.rollup(*by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))


def components(rows: DataFrame, by: list[str], price: str, name: str, order: str, attribute: str) -> DataFrame:
    """Of each component: its primary line (the dearest, the first on ties), the sum of prices, and its attribute's values; more
    than one value needs review."""
    values = F.array_sort(F.collect_set(attribute))
    return rows.groupBy(*by).agg(
        F.max_by(name, F.struct(price, -F.col(order))).alias("primary"),
        F.round(F.sum(F.col(price).cast("decimal(18,2)")).cast("double"), 2).alias("total"),
        F.count("*").alias("members"),
        F.array_join(values, " | ").alias("attribute"),
        (F.size(values) > 1).alias("review"),
    )


def delta(before: DataFrame, after: DataFrame, key: str, figures: list[str]) -> DataFrame:
    old, new = before.alias("b"), after.alias("a")
    both = new.join(old, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *((F.coalesce(f"a.{f}", F.lit(0)) - F.coalesce(f"b.{f}", F.lit(0))).alias(f) for f in figures))


def next_number(sent: DataFrame, key: str, number: str) -> DataFrame:
    """The number after the highest sent, with two digits."""
    return sent.groupBy(key).agg(F.lpad((F.max(number) + 1).cast("string"), 2, "0").alias("next"))


def matrix(rows: DataFrame, key: str, feature: str, columns: list[str], mark: str = "✓") -> DataFrame:
    """key by feature; the columns are given, so that no pass is needed to find them and their order never changes."""
    return rows.select(key, feature).groupBy(key).pivot(feature, columns).agg(F.max(F.lit(mark)))


def append_only(previous: list[str], present: DataFrame, feature: str) -> list[str]:
    """Columns of a matrix that keeps what it had and adds new features, sorted. The driver holds the names of columns only."""
    new = [r[0] for r in present.select(feature).distinct().filter(~F.col(feature).isin(previous)).orderBy(feature).collect()]
    return [*previous, *new]


def numbered_values(rows: DataFrame, by: list[str], order: str, value: str, number: str = "field") -> DataFrame:
    """All values of each group, numbered from 1: a row for each, however many a group has."""
    return rows.select(*by, F.row_number().over(W.partitionBy(*by).orderBy(order)).alias(number), value)


def numbered_columns(rows: DataFrame, by: list[str], order: str, value: str, prefix: str, columns: int) -> DataFrame:
    """The first `columns` values of each group side by side, for groups that are known to have no more (see numbered_values)."""
    place = numbered_values(rows, by, order, value, "__n")
    return place.groupBy(*by).agg(*(F.max(F.when(F.col("__n") == k, F.col(value))).alias(f"{prefix}{k}") for k in range(1, columns + 1)))


def full_outer_flags(a: DataFrame, b: DataFrame, key: str, in_a: str, in_b: str) -> DataFrame:
    both = a.withColumn(in_a, F.lit(True)).join(b.withColumn(in_b, F.lit(True)), key, "full_outer")
    return both.select(key, F.coalesce(in_a, F.lit(False)).alias(in_a), F.coalesce(in_b, F.lit(False)).alias(in_b))
