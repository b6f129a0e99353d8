"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are n-grams of words as they stand (one and two words) and of their shapes (one to three; runs of upper, lower, digit,
each other sign: "IT!!" is "A!"), hashed into 2^BITS columns; a column's value is its count over the number of n-grams of its
kind, times SCALE. Training takes at most max_rows labelled rows (those of least hash of their id), dealt into shards by number;
every shard makes its passes in one task, over at most max_bytes / shards of text, and the weights are averaged. A score is the
logistic function of a sparse dot product; whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import fresh, held_out, map_arrow, row_chunks, table, text_bytes

BITS = 18
SCALE = 8.0
KINDS = 5
ODD = 0x9E3779B97F4A7C15
SHAPES = np.array([0 if b == 0x20 or 9 <= b <= 13 else 1 if 0x41 <= b <= 0x5A else 2 if 0x61 <= b <= 0x7A or b > 0x7F else 3 if 0x30 <= b <= 0x39 else b + 4 for b in range(256)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def columns(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: its columns, and where each row's columns start."""
    odd = np.uint64(ODD)
    shape = SHAPES[data]
    inside = shape > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | False
    row_start = starts[:-1][starts[:-1] < starts[1:]]
    opens[row_start] = inside[row_start]
    first = np.flatnonzero(opens)
    if not len(first):
        for _ in range(KINDS):
            yield np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        return
    word = np.cumsum(opens) - 1
    place = np.arange(len(data)) - first[word]
    powers = np.full(int(place[inside].max()) + 1, odd)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * powers[np.where(inside, place, 0)], np.uint64(0))
    words = mixed(np.add.reduceat(terms, first))
    changed = opens.copy()
    changed[1:] |= inside[1:] & (shape[1:] != shape[:-1])
    rank = np.cumsum(changed)
    rank -= rank[first][word]
    terms = np.where(changed, shape * powers[np.where(changed, rank, 0)], np.uint64(0))
    shapes = mixed(np.add.reduceat(terms, first))
    begin = np.searchsorted(first, starts)  # first word of each row
    yield _column(words, 1), begin
    yield _column(shapes, 2), begin
    row = np.repeat(np.arange(len(starts) - 1), np.diff(begin))
    for kind, parts, n in ((3, shapes, 2), (4, shapes, 3), (5, words, 2)):
        gram = parts[: max(0, len(parts) - n + 1)].copy()
        for k in range(1, n):
            gram = gram * odd + parts[k : len(parts) - n + 1 + k]
        whole = row[: len(gram)] == row[n - 1 :][: len(gram)]
        counts = np.bincount(row[: len(gram)][whole], minlength=len(starts) - 1)
        yield _column(gram[whole], kind), np.concatenate([[0], np.cumsum(counts)])


def _column(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)


def logits(data: np.ndarray, starts: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(starts) - 1, bias)
    for cols, begin in columns(data, starts):
        sums = np.concatenate([[0.0], np.cumsum(weights[cols], dtype=np.float64)])
        out += SCALE * (sums[begin[1:]] - sums[begin[:-1]]) / np.maximum(1, np.diff(begin))
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Follow the regularised leader, a rate for each coordinate; the last coordinate is the bias, which is not regularised."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1, l2 = (np.where(np.arange(len(self.z))[at] < 1 << BITS, x, 0.0) for x in (self.l1, self.l2))
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (logistic(w @ x) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sparse_rows(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    kinds = list(columns(data, starts))
    for i in range(len(starts) - 1):
        at = np.concatenate([*(c[b[i] : b[i + 1]] for c, b in kinds), [1 << BITS]])
        x = np.concatenate([*(np.full(b[i + 1] - b[i], SCALE / max(1, b[i + 1] - b[i])) for _, b in kinds), [1.0]])
        own, inverse = np.unique(at, return_inverse=True)
        yield own, np.bincount(inverse, x)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 16_384, max_bytes: int = 256 << 20, shards: int = 4, passes: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias, from at most max_rows labelled ids and max_bytes of text. labels may hold an id several times (its least label counts); null ids and labels are left out. With
    no labelled rows all weights are 0."""
    rank = F.xxhash64(id_col)
    sample = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label")).orderBy(rank, id_col).limit(max_rows)
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), id_col)
    rows = rows.select(F.pmod(rank, F.lit(shards)).cast("int").alias("shard"), rank.alias("rank"), "text", "label")
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("rank", "text").select("text", "label")

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, room = Ftrl(alpha, beta, l1, l2), max_bytes // shards
        held, given = [], []  # large arrays, a few for each chunk: their memory goes back to the system afterwards
        for batch in batches:
            if room < 0:
                continue
            data, starts = text_bytes(batch.column(0))
            starts = starts[: int(np.searchsorted(starts, room, "right"))]
            room -= int(starts[-1]) if len(starts) > batch.num_rows else room + 1
            for a, b in row_chunks(starts):
                at, x = zip(*sparse_rows(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]))
                held.append((np.concatenate(at).astype(np.int32), np.concatenate(x).astype(np.float32), np.cumsum([0, *map(len, at)])))
            given += batch.column(1).to_pylist()[: max(0, len(starts) - 1)]
        if not given:
            return
        for _ in range(passes):
            each = ((at[i:j], x[i:j]) for at, x, ends in held for i, j in zip(ends, ends[1:]))
            for (at, x), label in zip(each, given):
                model.learn(at, x, label)
        yield pa.RecordBatch.from_arrays([pa.array([len(given)], pa.int64()), pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])

    parts = map_arrow(dealt, learned, "n long, w binary").collect()  # one row of 1 MB for each shard
    if not parts:
        return np.zeros(1 << BITS, np.float32), 0.0
    mean = sum(p.n * np.frombuffer(p.w, np.float32).astype(np.float64) for p in parts) / sum(p.n for p in parts)
    return mean[:-1].astype(np.float32), float(mean[-1])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns of docs, and the score (0 to 1) as `into`, replacing a column of that name. Null texts score as empty ones,
    which have the bias alone; repeated rows score alike."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.drop(into)
    (text,) = fresh([*given.columns, into], "__text")
    rows = given.withColumn(text, F.col(text_col).cast("string"))
    out = T.StructType([*given.schema, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            data, starts = text_bytes(batch.column(batch.num_columns - 1))
            found = [logits(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], weights, bias) for a, b in row_chunks(starts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(logistic(np.concatenate([*found, np.zeros(0)])), pa.float64())], names=[*batch.schema.names[:-1], into])

    return map_arrow(rows, run, out)


def learners(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out("doc_id", 5, 0))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learners(table(spark, sf_dir, "labels")))
    return scored(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", accepted().cast("int").alias("predicted"))


def accepted(score: str = "score") -> Column:
    return F.col(score) >= 0.3


def good(docs: DataFrame, labels: DataFrame, all_docs: DataFrame) -> DataFrame:
    """docs that the classifier accepts; it learns from the labelled rows of all_docs."""
    (score,) = fresh(docs.columns, "__score")
    return scored(docs, train(all_docs, learners(labels)), into=score).filter(accepted(score)).drop(score)
