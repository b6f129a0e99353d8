"""Queries that run as streams over files and stop when these are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderloom.sources.steps import folder
from orderloom.sources.tables import table
from orderloom.streaming import live

#: A batch takes all files.
ALL = (1 << 31) - 1


def stream_fold(spark, sf):
    """Each day's poll of the events' users as a folder of files, folded one after another; the changes that were announced."""
    root = folder(spark, "stream")
    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("status"), F.col("ts").cast("date").cast("string").alias("poll"), "event_id")
    rows = e.filter("poll is not null").groupBy("job", "poll").agg(F.max_by("status", "event_id").alias("status"))
    rows.withColumn("day", F.col("poll")).write.partitionBy("day").json(f"{root}/in")
    schema = "job long, status string, poll string"
    query = live.watch(live.poll_stream(spark, f"{root}/in", schema, max_files=ALL), f"{root}/out", "job", ["status"], "poll", schema)
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out/changes").select("job", "delta", "time")


FOLD = """
WITH p AS (SELECT DISTINCT user_id AS job, CAST(ts AS DATE) AS d FROM events),
n AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (SELECT DISTINCT d FROM p)), q AS (SELECT job, k, d FROM p JOIN n USING (d)),
j AS (SELECT DISTINCT job FROM q), g AS (SELECT j.job, n.k, n.d, q.job IS NOT NULL AS here, coalesce(lag(q.job IS NOT NULL) OVER w, false) AS before, coalesce(bool_or(q.job IS NOT NULL) OVER (PARTITION BY j.job ORDER BY n.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ever
  FROM j CROSS JOIN n LEFT JOIN q ON q.job = j.job AND q.k = n.k WINDOW w AS (PARTITION BY j.job ORDER BY n.k))
SELECT job, CASE WHEN here AND NOT ever THEN 'new' WHEN here THEN 'returning' ELSE 'removed' END AS delta, CASE WHEN here THEN CAST(d AS VARCHAR) ELSE CAST(d AS VARCHAR) END AS time FROM g WHERE k > 1 AND here <> before"""

QUERIES = {"stream_fold": (stream_fold, FOLD)}
