"""Context-triggered piecewise hashing: chunk boundaries where a rolling hash of the last bytes hits a trigger, one character
per chunk, two block sizes per text, compared by edit distance where block sizes agree.

A text of n bytes gets block size b = MIN_BLOCK * 2^k, the least with n <= b * LENGTH, halved while its signature is shorter than
LENGTH / 2. Its fingerprint is b:s:t, s of chunks at b (at most LENGTH characters; what follows goes into the last), t at 2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import map_arrow, table, text_bytes

MIN_BLOCK = 3
LENGTH = 64
WINDOW = 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
PIECE = 1 << 16
#: Signatures with no common run of this many characters (or a third of the shorter one) are unlike; chance matches do not count.
COMMON = 7


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = _powers(PIECE + 1, ODD), _powers(PIECE + 1, INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW bytes at each byte; before the text stand zeros."""
    out = np.zeros(len(data), np.uint32)
    for k in range(min(WINDOW, len(data))):
        part = data[: len(data) - k].astype(np.uint32) + np.uint32(1)
        out[k:] += part * np.uint32(pow(0x01000193, k, 1 << 32))
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


def prefix_hashes(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of (byte + 1) * ODD^place, mod 2^64, before each cut (ascending); in pieces, so memory does not grow with the text."""
    out, done = np.zeros(len(cuts), np.uint64), np.zeros(1, np.uint64)
    at = 0
    for first in range(0, max(len(data), 1), PIECE):
        part = data[first : first + PIECE]
        sums = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * POWERS[: len(part)], dtype=np.uint64)])
        to = int(np.searchsorted(cuts, first + len(part), "right"))
        shift = np.array([pow(ODD, first, 1 << 64)], np.uint64)
        out[at:to] = done + sums[cuts[at:to] - first] * shift
        done = done + sums[-1:] * shift
        at = to
    return out


def signature(data: np.ndarray, triggers: np.ndarray, limit: int) -> str:
    """One character for each chunk that ends at a trigger, and one for what is left."""
    ends = triggers[: limit - 1] + 1
    cuts = np.concatenate([[0], ends, [len(data)] if not len(ends) or ends[-1] < len(data) else []]).astype(np.int64)
    sums = prefix_hashes(data, cuts)
    starts = INVERSES[cuts[:-1] % PIECE] * np.array([pow(INVERSE, int(c) // PIECE * PIECE, 1 << 64) if c >= PIECE else 1 for c in cuts[:-1]], np.uint64)
    hashes = mixed((sums[1:] - sums[:-1]) * starts)
    return ALPHABET[(hashes >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: np.ndarray) -> str:
    n = len(data)
    if n == 0:
        return f"{MIN_BLOCK}::"
    roll = rolling(data)
    block = MIN_BLOCK
    while block * LENGTH < n:
        block *= 2
    while True:
        triggers = np.flatnonzero(roll % np.uint32(block) == block - 1)
        if block == MIN_BLOCK or len(triggers) + 1 >= LENGTH // 2:
            break
        block //= 2
    twice = triggers[roll[triggers] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{signature(data, triggers, LENGTH)}:{signature(data, twice, LENGTH // 2)}"


def common(a: str, b: str) -> int:
    """Length of a longest common subsequence, bit-parallel."""
    marks: dict[str, int] = {}
    for i, c in enumerate(a):
        marks[c] = marks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & marks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def share_run(a: str, b: str) -> bool:
    k = min(COMMON, max(1, min(len(a), len(b)) // 3))
    runs = {a[i : i + k] for i in range(len(a) - k + 1)}
    return any(b[i : i + k] in runs for i in range(len(b) - k + 1))


def alike(a: str, b: str) -> float:
    """1 - edit distance (insertions and deletions) / total length, 0 to 1."""
    if not a or not b or not share_run(a, b):
        return 0.0
    return 2 * common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1. Equal fingerprints: 1. Block sizes that differ by more than twice: 0."""
    if a == b:
        return 1.0
    (x, s, t), (y, u, v) = a.split(":"), b.split(":")
    m, n = int(x), int(y)
    if m == n:
        return max(alike(s, u), alike(t, v))
    return alike(t, u) if 2 * m == n else alike(s, v) if m == 2 * n else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint of every row; null texts as empty ones; repeated rows give a row each; other columns are left out."""
    out = T.StructType([docs.select(id_col).schema[0], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            prints = [fingerprint(data[a:b]) for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], schema=pa.schema([batch.schema.field(0), pa.field("fingerprint", pa.string())]))

    return map_arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, out)


def likeness_col(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def compared(x, y):
        import pandas as pd

        return pd.Series([likeness(p, q) for p, q in zip(x, y)], dtype="float64")

    return compared(a, b)


def beside_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 256, most_ranges: int = 1 << 16) -> DataFrame:
    """id, text, extra, range: sorted within partitions so that each row but the extra ones is followed by the next document,
    by descending id (equal ids by hash of the text; null ids last; after the last row the first).

    Rows are dealt into ranges of ids, and each range also gets, as an extra row, the first row of the range after it. The text
    is shuffled once; the driver holds a key for each range."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ids = rows.select("id").filter("id is not null")
    n = max(1, min(ids.count() // rows_per_range, most_ranges))
    bounds = np.unique(ids.approxQuantile("id", [k / n for k in range(1, n)], 1 / (4 * n))) if n > 1 else np.zeros(0)

    @F.pandas_udf("int")
    def range_of(x):
        import pandas as pd

        at = -1 - np.searchsorted(bounds, x.astype("float64").to_numpy(), "right")
        return pd.Series(np.where(x.isna(), 0, at).astype("int32"))

    rows = rows.withColumn("range", range_of(F.col("id").cast("double")))  # ascending ranges hold descending ids; null ids come after all
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), F.lit(1)).otherwise(F.col("range")))
    firsts = sorted(rows.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("first")).collect())
    moved = [(r.range, r.first.id, r.first.tie, firsts[k - 1].range) for k, r in enumerate(firsts)]
    to = spark.createDataFrame(moved, T.StructType([T.StructField("range", T.IntegerType()), rows.schema["id"], T.StructField("tie", T.LongType()), T.StructField("to", T.IntegerType())]))
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.tie") == F.col("b.tie")) & (F.col("a.range") == F.col("b.range"))
    extra = rows.alias("a").join(F.broadcast(to.alias("b")), same).select("a.id", "a.text", "a.tie", F.col("b.to").alias("range"), F.lit(True).alias("extra"))
    both = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    return both.repartition("range").sortWithinPartitions("range", "extra", F.desc_nulls_last("id"), F.desc("tie")).select("id", "text", "extra", "range")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: its fingerprint, that of its edited text (the last third of its code points replaced by the first as many,
    or all, of the next document), and how like they are. Null texts count as empty; an empty table gives an empty one."""
    kind = docs.select(id_col).schema[0].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_chars", T.LongType()), *(T.StructField(x, T.StringType()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            ids, columns = [], [[] for _ in range(6)]
            data, starts = text_bytes(batch.column(1))
            for i, (key, extra, place) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))):
                own = data[starts[i] : starts[i + 1]]
                text, mark = own.tobytes().decode(), fingerprint(own)
                if held and held[3] == place and not held[4]:
                    before, old, old_mark = held[:3]
                    cut = len(old) // 3
                    edited = (old[: len(old) - cut] + text[:cut]).encode()
                    edited_mark = fingerprint(np.frombuffer(edited, np.uint8))
                    ids.append(before)
                    for column, value in zip(columns, (len(old), hashlib.sha256(edited).hexdigest(), old_mark, edited_mark, likeness(old_mark, edited_mark), likeness(old_mark, mark))):
                        column.append(value)
                held = (key, text, mark, place, extra)
            if ids:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *map(pa.array, columns, kinds)], names=out.names)

    return map_arrow(beside_next(docs, id_col, text_col), run, out)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))
