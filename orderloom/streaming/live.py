"""The poll loop as Structured Streaming: files of polls in, queue state and change events out.

The state is a keyed table in the shared folder, a version for each batch: a batch reads the version before it and writes its
own, so a batch that is run again after a failure gives the same rows. Polls of one batch are folded by their stamps, one after
another. An empty poll is a failed scrape and changes nothing.
The first batch is the baseline and announces nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderloom.operators.merge import record_poll

STATE = "first_seen string, last_seen string, present boolean, carried_over boolean"


def poll_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fold(spark: SparkSession, root: str, key: str, fields: list[str], stamp: str, schema: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: folds a batch into the state under root/state, its changes under root/changes."""

    def state_before(batch_id: int) -> DataFrame | None:
        for k in range(batch_id - 1, -1, -1):  # skipped batches wrote nothing
            if _exists(spark, f"{root}/state/batch={k}/_SUCCESS"):
                return spark.read.parquet(f"{root}/state/batch={k}")
        return None

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            stamps = [r[0] for r in batch.select(stamp).filter(F.col(stamp).isNotNull()).distinct().orderBy(stamp).collect()]  # one of each poll
            state = state_before(batch_id) if stamps else None
            for k, now in enumerate(stamps):
                baseline = state is None
                if state is None:
                    state = spark.createDataFrame([], schema).select(key, *fields).withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in STATE.split(", ")})
                # the latest row of a key, by all fields on ties
                rows = batch.filter(F.col(stamp) == now).groupBy(key).agg(F.max(F.struct(*fields)).alias("r")).select(key, "r.*")
                after = record_poll(state, rows, key, fields, F.lit(now), baseline).persist()
                try:
                    path = f"{root}/state/batch={batch_id}" if k == len(stamps) - 1 else f"{root}/state/part={batch_id}-{k}"
                    after.drop("delta").write.mode("overwrite").parquet(path)
                    after.filter("delta is not null").select(key, "delta", F.lit(now).alias("time")).write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}-{k}")
                    state = spark.read.parquet(path)
                finally:
                    after.unpersist()
        finally:
            batch.unpersist()

    return run


def watch(polls: DataFrame, root: str, key: str, fields: list[str], stamp: str, schema: str, interval: str | None = None) -> StreamingQuery:
    """Starts the loop; without an interval it takes what is there and stops."""
    writer = polls.writeStream.foreachBatch(fold(polls.sparkSession, root, key, fields, stamp, schema)).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def last_transition(events: DataFrame, key: str, value: str, time: str, late: str = "10 minutes") -> DataFrame:
    """A stream of each key's transitions: events whose value differs from the key's last one, with a watermark on time."""
    import pandas as pd

    fields = [f for f in events.schema if f.name in (key, value, time)]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", previous string"

    def step(group, batches, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([time, value])
        kept = []
        for row in rows[[f.name for f in fields]].itertuples(index=False):
            now = getattr(row, value)
            if now != last:
                kept.append((*row, last))
                last = now
        state.update((last,))
        yield pd.DataFrame(kept, columns=[*(f.name for f in fields), "previous"])

    return events.withWatermark(time, late).groupBy(key).applyInPandasWithState(step, out, "last string", "append", "NoTimeout")
