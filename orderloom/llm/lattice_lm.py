"""LM scoring by subword lattices.

A word's probability is the sum over all its segmentations into pieces of an existing vocabulary: a log-space forward recursion
over its bytes, a weight for each piece (apart for pieces that open a word), then a stop. The vocabulary's scores give an order
only; Zipf's law makes them weights, and passes over the training words move these to the expected piece counts, each word as
often as it occurs. A text is its words and an end: its score is the marginal probability of all ways to segment it.

Beside the score stands mixed_score, a law with whole words in it: P(w) = (max(c - D, 0) + D V P_sub(w)) / N mixes a word's
discounted count in the training texts with its lattice. The text is drawn from one of a few classes (languages of the training
texts), whose own counts are discounted towards P in the same way; a text's probability sums over the classes.

Documents are cut into blocks where they are read: a block keeps its distinct words once, and for each document their places and
counts. Words meet their totals by word, then go back by block; whole texts are never shuffled. A word of more than BLOCKS_A_ROW
blocks is dealt into several rows, so none grows with the corpus. A long word (a text without blanks) is taken in windows of bytes;
its sums take time in proportion to its length and, in training, eight bytes a byte.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import held_out, map_arrow, stored, table, text_bytes

BLOCK_BYTES = 8 << 20
WORDS_AT_ONCE = 65_536
ENTRIES_AT_ONCE = 1 << 20
BLOCKS_A_ROW = 4096
#: A word of more bytes (a text without blanks) is taken alone, in windows of so many starts.
LONG, WINDOW = 4096, 1 << 16


class Vocabulary:
    """Pieces as two byte tries in one: from node 0 pieces that open a word, from node 1 those that go on. Every single byte is a
    piece of both, so every word has a segmentation. weights: log probabilities; the last one is the stop's."""

    def __init__(self, pieces: list[tuple[bytes, bool, float]]) -> None:
        known: dict[tuple[bytes, bool], float] = {}
        for piece, opens, weight in pieces:
            if piece:
                known[piece, opens] = max(weight, known.get((piece, opens), 0.0))
        least = min(known.values(), default=1.0)
        for b in range(256):
            for opens in (True, False):
                known.setdefault((bytes([b]), opens), least)
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        self.opens, weights, nodes = [], [], 2
        for (piece, opens), weight in known.items():
            node = 0 if opens else 1
            for b in piece:
                if (node, b) not in edges:
                    edges[node, b] = nodes
                    nodes += 1
                node = edges[node, b]
            ends[node] = len(weights)
            weights.append(weight)
            self.opens.append(opens)
        order = sorted(edges)
        self.keys = np.array([n << 8 | b for n, b in order], np.int64)
        self.to = np.array([edges[k] for k in order], np.int64)
        self.piece = np.full(nodes, -1, np.int64)
        for node, i in ends.items():
            self.piece[node] = i
        self.opens = np.array([*self.opens, False])
        self.longest = max(len(piece) for piece, _ in known)
        self.weights = self.normal(np.array([*weights, 0.1 * sum(w for w, o in zip(weights, self.opens) if not o)]))

    def normal(self, counts: np.ndarray) -> np.ndarray:
        total = np.where(self.opens, counts[self.opens].sum(), counts[~self.opens].sum())
        return np.log(counts) - np.log(total)

    def moved(self, expected: np.ndarray, prior: float) -> np.ndarray:
        """Log weights from expected counts, with the present weights as a prior of that many counts."""
        return self.normal(expected + prior * np.exp(self.weights))

    def arcs(self, grid: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each start: (end, rows, pieces). grid: bytes of a word per row, then -1."""
        out = []
        for i in range(grid.shape[1]):
            own, rows = [], np.flatnonzero(grid[:, i] >= 0)
            node = np.full(len(rows), 0 if i == 0 else 1, np.int64)
            j = i
            while len(rows) and j < grid.shape[1]:
                byte = grid[rows, j]
                key = node << 8 | byte
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (byte >= 0) & (self.keys[at] == key)
                rows, node = rows[hit], self.to[at[hit]]
                j += 1
                piece = self.piece[node]
                if (done := piece >= 0).any():
                    own.append((j, rows[done], piece[done]))
            out.append(own)
        return out


    def window(self, data: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and pieces of the arcs from a to b - 1 of one long word, by start. All starts walk the tries at once."""
        starts, found = np.arange(a, min(b, len(data))), []
        node, step = np.where(starts == 0, 0, 1), 0
        while len(starts):
            inside = starts + step < len(data)
            starts, node = starts[inside], node[inside]
            key = node << 8 | data[starts + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            starts, node, step = starts[hit], self.to[at[hit]], step + 1
            done = self.piece[node] >= 0
            found.append((starts[done], starts[done] + step, self.piece[node[done]]))
        s, e, p = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(s, kind="stable")
        return s[order], e[order], p[order]


def logadd(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x)) if y > -math.inf else x


def long_forward(word: bytes, vocabulary: Vocabulary, weights: np.ndarray, keep: bool) -> tuple[float, np.ndarray | None]:
    """Natural logarithm of P_sub of one long word, and with keep the sums of all its places. Besides these a window's arcs are
    held, and the sums that arcs out of it reach."""
    data, every = np.frombuffer(word, np.uint8).astype(np.int64), np.full(len(word) + 1 if keep else 0, -np.inf)
    ahead = [0.0]
    for a in range(0, len(word), WINDOW):
        s, e, p = vocabulary.window(data, a, a + WINDOW)
        alpha = ahead + [-math.inf] * (int(e.max()) - a + 1 - len(ahead))  # every byte is a piece, so there are arcs
        for i, j, w in zip((s - a).tolist(), (e - a).tolist(), weights[p].tolist()):
            alpha[j] = logadd(alpha[j], alpha[i] + w)
        done = min(WINDOW, len(word) - a)
        if keep:
            every[a : a + done] = alpha[:done]
        ahead = alpha[done:]
    if keep:
        every[len(word)] = ahead[0]
    return ahead[0] + weights[-1], every


def long_counts(word: bytes, vocabulary: Vocabulary, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of one long word."""
    total, alpha = long_forward(word, vocabulary, weights, True)
    data, out = np.frombuffer(word, np.uint8).astype(np.int64), np.zeros(len(weights))
    after: list[float] = [float(weights[-1])]  # of the places from the window's end on
    for a in reversed(range(0, len(word), WINDOW)):
        done = min(WINDOW, len(word) - a)
        s, e, p = vocabulary.window(data, a, a + done)
        beta = [-math.inf] * done + after
        for i, j, w in zip((s - a)[::-1].tolist(), (e - a)[::-1].tolist(), weights[p][::-1].tolist()):
            beta[i] = logadd(beta[i], w + beta[j])
        out += np.bincount(p, np.exp(alpha[s] + weights[p] + np.array(beta)[e - a] - total), len(out))
        after = beta[: vocabulary.longest]
    return out


def apart(words: list[bytes]) -> tuple[list[int], list[int]]:
    """Places of the words of usual length, and of long ones."""
    sizes = np.array([len(w) for w in words], np.int64)
    return np.flatnonzero(sizes <= LONG).tolist(), np.flatnonzero(sizes > LONG).tolist()


def grids(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of like lengths: their places among words, lengths, and bytes."""
    sizes = np.array([len(w) for w in words], np.int64)
    kind = np.where(sizes <= 32, -(-sizes // 4), 8 + np.ceil(np.log2(np.maximum(sizes, 1) / 32) * 2).astype(np.int64))
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        width = int(sizes[at].max())
        for part in np.array_split(at, max(1, len(at) * width // (1 << 20))):
            grid = np.full((len(part), width), -1, np.int64)
            flat = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
            grid[np.arange(width) < sizes[part][:, None]] = flat
            yield part, sizes[part], grid


def forward(arcs: list, n_rows: int, weights: np.ndarray) -> np.ndarray:
    alpha = np.full((n_rows, len(arcs) + 1), -np.inf)
    alpha[:, 0] = 0.0
    for i, own in enumerate(arcs):
        for j, rows, piece in own:
            alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + weights[piece])
    return alpha


def word_scores(words: list[bytes], vocabulary: Vocabulary, weights: np.ndarray) -> np.ndarray:
    """Natural logarithm of P_sub of each word."""
    out = np.zeros(len(words))
    usual, long = apart(words)
    for i in long:
        out[i] = long_forward(words[i], vocabulary, weights, False)[0]
    usual = np.array(usual, np.int64)
    for own, sizes, grid in grids([words[i] for i in usual]):
        at = usual[own]
        alpha = forward(vocabulary.arcs(grid), len(at), weights)
        out[at] = alpha[np.arange(len(at)), sizes] + weights[-1]
    return out


def expected_counts(words: list[bytes], vocabulary: Vocabulary, weights: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, each so many times, and of the stop."""
    out = np.zeros(len(weights))
    usual, long = apart(words)
    for i in long:
        out += times[i] * long_counts(words[i], vocabulary, weights)
        out[-1] += times[i]
    usual = np.array(usual, np.int64)
    for own, sizes, grid in grids([words[i] for i in usual]):
        at, arcs = usual[own], vocabulary.arcs(grid)
        row = np.arange(len(at))
        alpha = forward(arcs, len(at), weights)
        beta = np.full(alpha.shape, -np.inf)
        beta[row, sizes] = weights[-1]
        total = alpha[row, sizes] + weights[-1]
        for i in reversed(range(len(arcs))):
            for j, rows, piece in arcs[i]:
                way = weights[piece] + beta[rows, j]
                beta[rows, i] = np.logaddexp(beta[rows, i], way)
                out += np.bincount(piece, np.exp(alpha[rows, i] + way - total[rows]) * times[at[rows]], len(out))
        out[-1] += times[at].sum()
    return out


def public_vocabulary(path: str) -> Vocabulary:
    """Pieces of a public model without white space inside; the mark of a word's start becomes the kind of piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece, rank = model.id_to_piece(i), max(0.0, -model.get_score(i))
        bare = piece.removeprefix("▁")
        if bare and "▁" not in bare and bare.encode().lower() == bare.encode():
            pieces.append((bare.encode(), bare != piece, 1 / (rank + 100)))
    return Vocabulary(pieces)


def blocked_schema(classes: int) -> T.StructType:
    kinds = {"block": "string", "word": "binary", "place": "int", **{f"c{k}": "long" for k in range(classes)}, "doc": "long", "kind": "int", "held_out": "boolean", "places": "binary", "counts": "binary", "n_tokens": "long"}
    return T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in kinds.items()))


def blocks(docs: DataFrame, classes: int) -> DataFrame:
    """docs (doc, text, held_out, kind) as blocks: a row for each distinct word (word, place, counts in training texts of each
    class), and a row for each document (places and counts of its words)."""
    out = blocked_schema(classes)
    kinds = [{"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in out]
    schema = pa.schema([pa.field(f.name, k) for f, k in zip(out, kinds)])
    first_doc = 3 + classes

    def flushed(place: dict, counts: np.ndarray, bags: list) -> Iterator[pa.RecordBatch]:
        name, n, words = os.urandom(12).hex(), len(place), list(place)
        for a in range(0, n, WORDS_AT_ONCE):
            m = min(n, a + WORDS_AT_ONCE) - a
            own = [pa.array(np.ascontiguousarray(counts[a : a + m, k])) for k in range(classes)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(words[a : a + m], pa.binary()), pa.array(np.arange(a, a + m, dtype=np.int32)), *own, *(pa.nulls(m, k) for k in kinds[first_doc:])], schema=schema)
        m = len(bags)
        yield pa.RecordBatch.from_arrays([pa.array([name] * m), *(pa.nulls(m, k) for k in kinds[1:first_doc]), *map(pa.array, map(list, zip(*bags)), kinds[first_doc:])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = {}
        trained, bags, size = np.zeros((1 << 16, classes), np.int64), [], 0
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            for i, (doc, held, kind) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))):
                words = data[starts[i] : starts[i + 1]].tobytes().lower().split()
                bag = Counter(words)
                places = np.array([place.setdefault(w, len(place)) for w in bag], np.int32)
                counts = np.fromiter(bag.values(), np.int32, len(bag))
                if len(place) > len(trained):
                    trained = np.concatenate([trained, np.zeros((len(place), classes), np.int64)])
                if not held:
                    trained[places, kind] += counts
                order = np.argsort(places)
                bags.append((doc, kind, held, np.diff(places[order], prepend=np.int32(0)).astype(np.int32).tobytes(), counts[order].tobytes(), len(words) + 1))
                size += int(starts[i + 1] - starts[i])
                if size >= BLOCK_BYTES:
                    yield from flushed(place, trained[: len(place)], bags)
                    place, bags, size = {}, [], 0
                    trained = np.zeros((1 << 16, classes), np.int64)
        if bags:
            yield from flushed(place, trained[: len(place)], bags)

    return map_arrow(docs.select("doc", "text", "held_out", "kind"), run, out)


def piece_counts(words: DataFrame, sent, weights: np.ndarray) -> np.ndarray:
    """Expected piece counts over the training words (word, c); the driver gets one row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, times = np.zeros(len(weights)), [], []
        for batch in batches:
            held += batch.column(0).to_pylist()
            times += batch.column(1).to_pylist()
            if len(held) >= WORDS_AT_ONCE:
                total += expected_counts(held, sent.value, weights, np.array(times, float))
                held, times = [], []
        if held:
            total += expected_counts(held, sent.value, weights, np.array(times, float))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    out = np.zeros(len(weights))
    for r in map_arrow(words.filter("c > 0").select("word", "c"), run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r.piece] = r.n
    return out


class Totals(NamedTuple):
    """Training tokens, ends among them, distinct words, discount."""

    n: int
    ends: int
    v: int
    discount: float


def totals_of(row, ends: int, k: str) -> Totals:
    one, two = row[f"one{k}"], row[f"two{k}"]
    return Totals((row[f"n{k}"] or 0) + ends, ends, row[f"v{k}"], one / (one + 2 * two) if one and two else 0.5)


def log10_of_words(counts: np.ndarray, sub: np.ndarray, whole: Totals, parts: list[Totals]) -> np.ndarray:
    """log10 P of words in each class, from counts (words x classes) and natural logarithms of P_sub."""
    c = counts.sum(1)
    with np.errstate(divide="ignore"):
        if whole.n == 0:
            base = sub + np.log(0.5)
        else:
            base = np.logaddexp(np.log(np.maximum(c - whole.discount, 0)), np.log(whole.discount * whole.v) + sub) - np.log(whole.n)
        words_only = base - np.log((whole.n - whole.ends) / whole.n if whole.n > whole.ends else 0.5 if whole.n == 0 else 1.0)
        out = np.empty(counts.shape)
        for k, part in enumerate(parts):
            if part.v == 0:
                out[:, k] = base
            else:
                out[:, k] = np.logaddexp(np.log(np.maximum(counts[:, k] - part.discount, 0)), np.log(part.discount * part.v) + words_only) - np.log(part.n)
    return out / np.log(10)


def block_scores(words: DataFrame, sent, weights: np.ndarray, whole: Totals, parts: list[Totals]) -> DataFrame:
    """For each block, its words' training counts and log10 probabilities, in each class and by the lattice alone, packed."""
    m = len(parts)

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held)
        counts = np.stack([part.column(3 + k).to_numpy() for k in range(m)], 1)
        sub = word_scores(part.column(0).to_pylist(), sent.value, weights)
        score = np.column_stack([log10_of_words(counts.astype(np.float64), sub, whole, parts), sub / np.log(10)]).astype(np.float32)
        c = counts.sum(1)
        row = np.repeat(np.arange(len(c)), pc.list_value_length(part.column(1)).to_numpy())
        code = pc.list_flatten(part.column(1)).combine_chunks().dictionary_encode()
        name, place = code.indices.to_numpy(), pc.list_flatten(part.column(2)).to_numpy()
        order = np.argsort(name, kind="stable")
        cuts = np.searchsorted(name[order], np.arange(len(code.dictionary) + 1))
        own = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        out = [[place[at].astype(np.int32).tobytes() for at in own], [c[row[at]].astype(np.int64).tobytes() for at in own], [score[row[at]].tobytes() for at in own]]
        yield pa.RecordBatch.from_arrays([code.dictionary, *(pa.array(x, pa.binary()) for x in out)], names=["block", "places", "counts", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for batch in batches:
            held.append(batch)
            entries += len(batch.column(1).flatten())
            if entries >= ENTRIES_AT_ONCE:
                yield from packed(held)
                held, entries = [], 0
        if held:
            yield from packed(held)

    return map_arrow(words.select("word", "blocks", "places", *(f"c{k}" for k in range(m))), run, "block string, places binary, counts binary, scores binary")


def scored(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, folds: int = 7, fold: int = 2, passes: int = 2, most_classes: int = 6) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score for every row of docs.

    The commonest values of class_col among training texts are classes of mixed_score, the others (and null) one more; no score
    sees the column. Null texts are empty: an end alone. Repeated rows count and score as often as they come. Null ids hash as the
    empty text. With no training texts the base of every token is 0 and words have half the lattice's probability, the end the
    other half. An empty table gives an empty one. Other columns are left out, whatever their names."""
    spark = docs.sparkSession
    held = held_out(id_col, folds, fold)
    names: list = []
    kind = F.lit(0)
    if class_col:
        names = [r[0] for r in docs.filter(~held).filter(F.col(class_col).isNotNull()).groupBy(F.col(class_col).cast("string").alias("k")).count().orderBy(F.desc("count"), "k").limit(most_classes).collect()]
        for k, name in enumerate(names, 1):
            kind = F.when(F.col(class_col).cast("string") == name, k).otherwise(kind)
    m = len(names) + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"), kind.cast("int").alias("kind"))
    cut = stored(blocks(rows, m), "blocks")
    each = [f"c{k}" for k in range(m)]
    bags = cut.filter("word is null")
    salts = -(-bags.select("block").distinct().count() // BLOCKS_A_ROW)
    by = ["word"] if salts < 2 else ["word", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")]
    spread = cut.filter("word is not null").groupBy(*by).agg(*(F.sum(c).alias(c) for c in each), F.collect_list(F.struct("block", "place")).alias("at"))
    spread = stored(spread.select("word", *each, sum(map(F.col, each), F.lit(0)).alias("c"), F.col("at.block").alias("blocks"), F.col("at.place").alias("places")), "words")
    words = spread
    if salts > 1:
        words = stored(spread.groupBy("word").agg(*(F.sum(c).alias(c) for c in [*each, "c"])), "totals")
        spread = spread.select("word", "blocks", "places").join(words, "word")
    ends = dict.fromkeys(range(m), 0) | {r.kind: r["count"] for r in bags.filter("not held_out").groupBy("kind").count().collect()}
    found = words.agg(*(f(F.col(c)).alias(f"{name}{c}") for c in ("c", *each) for name, f in (("n", F.sum), ("v", lambda c: F.count_if(c > 0)), ("one", lambda c: F.count_if(c == 1)), ("two", lambda c: F.count_if(c == 2))))).first()
    whole, parts = totals_of(found, sum(ends.values()), "c"), [totals_of(found, ends[k], f"c{k}") for k in range(m)]
    sent = spark.sparkContext.broadcast(vocabulary)
    weights = vocabulary.weights
    for _ in range(passes):
        weights = vocabulary.moved(piece_counts(words, sent, weights), 100.0)
    n = whole.n
    unit, known_end = float(np.log10(n + whole.v + (whole.ends > 0) + 1)), whole.ends > 0
    end_base = float(np.log10(whole.ends + 1.0)) - unit
    of_end = np.array([np.log10((p.ends or 0.5) / p.n) if p.n else -np.inf if n else np.log10(0.5) for p in parts])
    log_end = float(np.log10(whole.ends / n if whole.ends else 0.5))
    of_word = float(np.log10((n - whole.ends) / n)) if n > whole.ends else float(np.log10(0.5))
    share = np.array([p.ends for p in parts], float)
    prior = np.log10(np.maximum(share / share.sum(), 1e-300)) if share.any() else np.log10(np.full(m, 1 / m))

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        size = sum(len(x) // 4 for x in right.column("places").to_pylist())
        c, s = np.zeros(size, np.int64), np.zeros((size, m + 1), np.float32)
        for p, x, y in zip(*(right.column(k).to_pylist() for k in ("places", "counts", "scores"))):
            at = np.frombuffer(p, np.int32)
            c[at], s[at] = np.frombuffer(x, np.int64), np.frombuffer(y, np.float32).reshape(-1, m + 1)
        base = np.log10(c + 1.0) - unit
        out: list[list] = [[], [], [], []]
        for p, k in zip(left.column("places").to_pylist(), left.column("counts").to_pylist()):
            at, times = np.cumsum(np.frombuffer(p, np.int32)), np.frombuffer(k, np.int32).astype(np.int64)
            sums = times @ s[at].astype(np.float64)
            ways = sums[:m] + of_end + prior
            out[0].append(int(times[c[at] > 0].sum()) + known_end)
            out[1].append(float((base[at] * times).sum()) + end_base)
            out[2].append(float(sums[m]) + int(times.sum()) * of_word + log_end)
            out[3].append(float(ways.max() + np.log10((10 ** (ways - ways.max())).sum())))
        return pa.table([left.column("doc"), left.column("held_out"), left.column("n_tokens"), pa.array(out[0], pa.int64()), pa.array([n] * len(out[0]), pa.int64()), pa.array(out[1], pa.float64()), *(pa.array(x, pa.float64()) for x in out[2:])], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score"])

    per_block = block_scores(spread, sent, weights, whole, parts).groupBy("block")
    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double"
    return bags.select("block", "doc", "held_out", "n_tokens", "places", "counts").groupBy("block").cogroup(per_block).applyInArrow(joined, schema)


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scored(table(spark, sf_dir, "documents"), public_vocabulary(public_tokenizers.path("piece_bpe_32k.model")), class_col="lang")
