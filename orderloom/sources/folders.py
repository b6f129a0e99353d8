"""Where jobs' folders lie: expected paths, and a lookup of jobs in a listing of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: types of the second share, its other name of one, the width of its ranges and the range that breaks the rule
TYPES = ["GENERAL LINE", "HD-PFD", "HDX", "AXIAL"]
ALIASES = {"HD-PFD-IAF": "HD-PFD"}
WIDTH = 5
IRREGULAR = {(401, 405): "400-405"}


def range_folder(prefix: Column) -> Column:
    """Name of the range of WIDTH numbers that holds a prefix: 420 lies in 416-420."""
    end = (F.ceil(prefix / WIDTH) * WIDTH).cast("int")
    name = F.concat_ws("-", (end - WIDTH + 1).cast("string"), end.cast("string"))
    for (_, last), other in IRREGULAR.items():
        name = F.when(end == last, other).otherwise(name)
    return name


def candidates(job: Column, kind: Column) -> Column:
    """Paths below the root at which a job of six digits or more may lie: one for a known type, else one for each, in order; none for
    other jobs."""
    job = job.cast("string")
    asked = F.upper(F.coalesce(kind, F.lit("")))
    for alias, name in ALIASES.items():
        asked = F.when(asked == alias, name).otherwise(asked)
    prefix = F.substring(job, 1, 3).try_cast("int")

    def path(t: Column) -> Column:
        ranged = F.concat_ws("/", t, range_folder(prefix), job)
        return F.when(t == "AXIAL", F.concat_ws("/", t, job)).when(t == "HD-PFD", F.concat_ws("/", t, F.concat(F.substring(job, 1, 2), F.lit("XXXX")), job)).when(t.isin("GENERAL LINE", "HDX"), ranged)

    types = F.when(asked != "", F.array(asked)).otherwise(F.array(*map(F.lit, TYPES)))
    return F.when(job.rlike(r"^\d{6}"), F.filter(F.transform(types, path), F.isnotnull)).otherwise(F.array().cast("array<string>"))


def in_ranges(jobs: DataFrame, ranges: DataFrame, job: str = "job", prefix: str = "prefix") -> DataFrame:
    """jobs with the range folder (type, range: "first-last") that holds their prefix; a range of the rule's own name comes before one
    that only covers it, then the lesser name. Jobs without a range come with nulls.

    Ranges are cut into bins of WIDTH numbers, so the join is on equal bins; a range wider than its bins, or off their borders, is in
    several."""
    bin_of = lambda c: F.floor((c - 1) / WIDTH)
    first, last = F.regexp_extract("range", r"^(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract("range", r"^(\d+)-(\d+)$", 2).try_cast("int")
    cut = ranges.select("type", "range", first.alias("first"), last.alias("last")).filter("first <= last").withColumn("bin", F.explode(F.sequence(bin_of(F.col("first")), bin_of(F.col("last")))))
    hits = jobs.select(job, F.col(prefix).alias("at"), bin_of(F.col(prefix)).alias("bin")).join(cut, "bin").filter(F.col("at").between(F.col("first"), F.col("last")))
    own = F.when(F.col("range") == range_folder(F.col("at")), 0).otherwise(1)
    best = hits.groupBy(job).agg(F.min(F.struct(own.alias("o"), "range", "type")).alias("r")).select(job, "r.type", "r.range")
    return jobs.join(best, job, "left")


def locate(jobs: DataFrame, folders: DataFrame, deep: bool = True) -> DataFrame:
    """job, type, leaf, how of the jobs (distinct texts) that have a folder type/inter/leaf.

    A job lies at type/<its first three>/<job>; else there under a name that begins with it; the first type by name counts. With
    deep, jobs that are at neither place are looked for in all folders, by the whole name or its leading number. Every step is an
    equi-join; names are cut at the lengths that jobs have (few), and what a step finds leaves the next."""
    jobs = jobs.select(F.col("job").cast("string").alias("job")).distinct()
    lengths = [r[0] for r in jobs.select(F.length("job").alias("n")).distinct().orderBy("n").limit(32).collect()]
    begins = F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substr(F.col("leaf"), F.lit(1), n)))) if lengths else F.col("leaf")
    near = folders.select("type", "inter", "leaf", begins.alias("job")).filter(F.col("inter") == F.substring("job", 1, 3))
    order = F.struct("type", (F.col("leaf") != F.col("job")).alias("longer"), "leaf")
    direct = jobs.join(near, "job").groupBy("job").agg(F.min(order).alias("r")).select("job", "r.type", "r.leaf", F.when(F.col("r.longer"), "begins").otherwise("exact").alias("how"))
    if not deep:
        return direct
    left = jobs.join(direct.select("job"), "job", "left_anti")
    name = F.trim("leaf")
    swept = folders.select("type", "inter", "leaf", F.explode(F.array_distinct(F.array(name, F.regexp_extract(name, r"^(\d+)", 1)))).alias("job")).filter("job <> ''")
    found = left.join(swept, "job").groupBy("job").agg(F.min(F.struct("type", "inter", "leaf")).alias("r")).select("job", "r.type", "r.leaf", F.lit("swept").alias("how"))
    return direct.unionByName(found)
