"""Byte-level BPE: pre-tokenisation by class arrays and a transition-function scan, cached pair merging, and decoding.

Texts are split as the public byte-level pattern does, without a regular expression. Each code point gets a symbol from a
class table and two code points of lookahead; each symbol is a function on eight states; functions compose
associatively, so a blocked prefix scan over a table of compositions gives every state, and with it every boundary.
Slices go through a bounded cache to pair merging by rank. Slice ends (in code points) are kept beside the ids.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import map_arrow, row_chunks, table, text_bytes

LETTER, DIGIT, OTHER, BLANK, SPACE, SHORT, LONG = range(7)  # BLANK: U+0020; SHORT/LONG: apostrophe before a contraction of 1 or 2 letters
IN_LETTERS, IN_DIGITS, IN_OTHER, AFTER_BLANK, AFTER_SPACE, ONE_LEFT, TWO_LEFT, DONE = range(8)
FIRST = 7  # added to the symbol of a document's first code point, which forgets what came before
# fixed values: Unicode White_Space
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CACHE_SLICES = 1 << 16
ROWS = 64


@functools.cache
def class_table() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = DIGIT
    kinds[WHITE_SPACE] = SPACE
    kinds[0x20] = BLANK
    return kinds


def _step(state: int, symbol: int) -> int:
    if symbol == LETTER:
        return {TWO_LEFT: ONE_LEFT, ONE_LEFT: DONE}.get(state, IN_LETTERS)
    if symbol in (SHORT, LONG):
        return IN_OTHER if state in (IN_OTHER, AFTER_BLANK) else ONE_LEFT if symbol == SHORT else TWO_LEFT
    return {DIGIT: IN_DIGITS, OTHER: IN_OTHER, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE}[symbol]


def _starts_token(state: int, symbol: int) -> bool:
    """Whether a token starts at a code point that is not white space."""
    if symbol == LETTER:
        return state not in (IN_LETTERS, AFTER_BLANK, ONE_LEFT, TWO_LEFT)
    if symbol == DIGIT:
        return state not in (IN_DIGITS, AFTER_BLANK)
    return state not in (IN_OTHER, AFTER_BLANK)


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the symbols' functions generate: composition table (first, then second), images of states, ids of the symbols."""
    of_symbol = [tuple(_step(s, a) for s in range(8)) for a in range(7)]
    of_symbol += [(f[IN_LETTERS] if a < SHORT else _step(DONE, a),) * 8 for a, f in enumerate(of_symbol)]
    found = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *of_symbol]))}
    queue = list(found)
    while queue:
        f = queue.pop()
        for g in of_symbol:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    functions = list(found)
    compose = np.array([[found[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8 if len(found) < 256 else np.uint16)
    return compose, np.array(functions, np.uint8), np.array([found[f] for f in of_symbol], compose.dtype)


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions, by blocks of ROWS: within blocks, over their totals, then both together."""
    compose = monoid()[0]
    n = len(functions)
    blocks = -(-n // ROWS)
    padded = np.zeros(blocks * ROWS, functions.dtype)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(blocks, ROWS).T)
    for k in range(1, ROWS):
        grid[k] = compose[grid[k - 1], grid[k]]
    if blocks > 1:
        before = np.zeros(blocks, functions.dtype)
        before[1:] = scan(grid[-1])[:-1]
        grid = compose[before[None, :], grid]
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


@functools.cache
def _start_table() -> np.ndarray:
    return np.array([[_starts_token(s, a) for a in range(7)] for s in range(8)])


def boundaries(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens start, for the code points of one or more documents; first marks each document's first code point."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, bool)
    symbols = class_table()[codes]
    ahead = np.zeros(n + 2, np.uint32)
    ahead[:n] = codes
    ends = np.ones(n + 2, bool)  # a document ends before this position
    ends[:n] = first
    marks = np.flatnonzero(codes == 0x27)
    if len(marks):
        one, two = ahead[marks + 1], ahead[marks + 2]
        inside = ~ends[marks + 1]
        short = inside & np.isin(one, [ord(x) for x in "stmd"])
        long = inside & ~ends[marks + 2] & ((np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        symbols[marks[short]] = SHORT
        symbols[marks[long]] = LONG
    _, images, ids = monoid()
    after = images[scan(ids[symbols + FIRST * first]), 0]
    before = np.empty(n, np.uint8)
    before[0] = DONE
    before[1:] = after[:-1]
    white = (symbols == BLANK) | (symbols == SPACE)
    in_white = (before == AFTER_BLANK) | (before == AFTER_SPACE)
    last_white = np.zeros(n, bool)
    last_white[:-1] = ~white[1:] & ~first[1:]
    return first | np.where(white, ~in_white | last_white, _start_table()[before, symbols])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one slice: the adjacent pair of least rank is joined, leftmost first, until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    if n <= 64:
        get, never = ranks.get, len(ranks) + (1 << 30)
        starts = list(range(n + 1))
        pairs = [get(piece[i : i + 2], never) for i in range(n - 1)]
        while pairs and (least := min(pairs)) != never:
            i = pairs.index(least)
            del starts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[starts[i] : starts[i + 2]], never)
            if i:
                pairs[i - 1] = get(piece[starts[i - 1] : starts[i + 1]], never)
        return tuple([ranks[piece[i:j]] for i, j in zip(starts, starts[1:])])
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int) -> bytes | None:
        j = after[i]
        return piece[i : end[j]] if j < n else None

    heap = [(r, i, end[after[i]]) for i in range(n - 1) if (r := ranks.get(pair(i))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != to:
            continue
        j = after[i]
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(pair(k))) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class Slices(dict):
    """Slice of text to ids. When it holds CACHE_SLICES they become the older half, of which only what is asked for again stays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (ids := self.older.get(piece)) is None:
            ids = merge(piece.encode(), self.ranks)
        if len(self) >= CACHE_SLICES:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@functools.lru_cache(2)
def _slices(path: str) -> Slices:
    return Slices(load_ranks(path))


@functools.lru_cache(2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, and where each id's bytes start."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[list[int], np.ndarray]]:
    """Ids and slice ends (in code points) of each text."""
    slices = _slices(path)
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0, *map(len, texts)])
    first = np.zeros(len(codes), bool)
    first[starts[:-1][starts[:-1] < starts[1:]]] = True
    cuts = np.append(np.flatnonzero(boundaries(codes, first)), len(codes))
    at = np.searchsorted(cuts, starts)
    bounds = cuts.tolist()
    for k in range(len(texts)):
        own = bounds[at[k] : at[k + 1] + 1]
        ids: list[int] = []
        for part in map(slices.__getitem__, [joined[a:b] for a, b in zip(own, own[1:])]):
            ids += part
        yield ids, cuts[at[k] + 1 : at[k + 1] + 1] - starts[k]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, token_ids and slice_ends (code points) of every row. Null texts and empty ones give empty arrays; each repeated
    row gives a row; other columns are left out, whatever their names. path: a rank file that every executor can open."""
    out = T.StructType([docs.select(id_col).schema[0], T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("slice_ends", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), pa.field("token_ids", pa.list_(pa.int32())), pa.field("slice_ends", pa.list_(pa.int32()))])
            _, starts = text_bytes(batch.column(1))
            for a, b in row_chunks(starts):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, ends = zip(*encode_texts(texts, path))
                lists = []
                for parts in (ids, ends):
                    flat = np.concatenate([np.asarray(p, np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], schema=schema)

    return map_arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, out)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Adds decoded (binary) to id_col and token_ids: the tokens' bytes one after another. Null ids: empty. Ids outside the
    vocabulary raise an error."""
    out = T.StructType([*encoded.select(id_col, "token_ids").schema, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, at = _vocabulary(path)
        for batch in batches:
            lists = batch.column(1)
            counts = np.nan_to_num(np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), float)).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)])
            if len(ids) and (ids.min() < 0 or ids.max() >= len(at) - 1):
                raise ValueError("token id outside the vocabulary")
            texts = []
            for a, b in row_chunks(ends, 1 << 18):
                own = ids[ends[a] : ends[b]]
                size = at[own + 1] - at[own]
                total = np.concatenate([[0], np.cumsum(size)])
                joined = blob[np.repeat(at[own] - total[:-1], size) + np.arange(total[-1])].tobytes()
                row = total[ends[a : b + 1] - ends[a]]
                texts += [joined[x:y] for x, y in zip(row, row[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.binary())], schema=pa.schema([batch.schema.field(0), batch.schema.field(1), pa.field("decoded", pa.binary())]))

    return map_arrow(encoded.select(id_col, "token_ids"), run, out)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(decode(encode(table(spark, sf_dir, "documents"), default_path()), default_path()))


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
