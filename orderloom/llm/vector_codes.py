"""Vector code compression: product codes whose codebooks come from Lloyd rounds over two trees.

Every component becomes the integer floor(scale * x), every vector is cut into `parts` equal consecutive parts, and each part
position has a codebook of at most `entries` entries, at first the parts of the smallest ids. A round gives every part its nearest
entry and moves entries to the floor of their parts' mean.

Vectors are packed once into blocks of bounded size, stored in the shared folder. In a block, the parts of one position stand in
the order of a balanced tree (median cuts along the widest side), so that a node is a slice and its sum is a difference of prefix
sums. A round is one job over the blocks: a second tree is put over the entries, pairs of nodes are refined from the roots, and a
pair goes once its least distance is above the greatest distance of another pair of the same parts. When single entries are left,
one that is farther than another at every point of the node's box goes as well. A node with one entry left is assigned as a whole;
what stays uncertain at a leaf is settled with integers. Tasks return sums and counts of entries, at most parts * entries rows each,
so no row leaves its block and no group of equal vectors meets in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import fresh, map_arrow, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of a block, and parts of a leaf.
BLOCK, LEAF = 1 << 18, 64
#: Rows of one label are dealt to so many groups before their sum is joined back.
SALTS = 64


def limit(dims: int) -> int:
    """Greatest magnitude of a component whose squared distances, summed over a vector, stay within a long."""
    return min(math.isqrt((1 << 63) - 1) // (2 * math.isqrt(dims) + 2), (1 << 31) - 1)


def usable(vec: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def integers(vec: Column, most: int, scale: int = SCALE) -> Column:
    return F.transform(vec, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(x.cast("double") * scale))).cast("int"))


def levels(n: int, leaf: int) -> int:
    """Depth at which every node of n halved again and again holds at most `leaf` and none is empty."""
    depth = 0
    while (n - 1 >> depth) + 1 > leaf and n >> depth + 1:
        depth += 1
    return depth


def cuts(n: int, depth: int) -> list[np.ndarray]:
    """Bounds of the nodes of each level, the root's first."""
    out = [np.array([0, n])]
    for _ in range(depth):
        b = out[-1]
        out.append(np.append(np.column_stack([b[:-1], (b[:-1] + b[1:]) // 2]).ravel(), n))
    return out


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in the order of a balanced tree: every node of cuts() is halved at the median of its widest side."""
    order = np.arange(len(points))
    for bounds in cuts(len(points), levels(len(points), leaf))[:-1]:
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = points[order[a:b]]
            side = part[:, np.argmax(np.ptp(part, axis=0))]
            order[a:b] = order[a:b][np.argpartition(side, (a + b) // 2 - a)]
    return order


def boxes(points: np.ndarray, bounds: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest corner of the nodes of each level, as floats."""
    low, high = np.minimum.reduceat(points, bounds[-1][:-1]), np.maximum.reduceat(points, bounds[-1][:-1])
    out = [(low.astype(float), high.astype(float))]
    for _ in bounds[1:]:
        low, high = out[0]
        out.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
    return out


class Codebook:
    """Entries of one part position, in the order of a tree with one entry a leaf."""

    def __init__(self, entries: np.ndarray):
        self.entries, n = entries, len(entries)
        self.depth = max(0, (n - 1).bit_length())
        order = tree_order(entries, 1) if n > 1 else np.arange(n)
        slots = np.concatenate([order, np.full((1 << self.depth) - n, order[-1])])  # the last entry again, up to a power of two
        if n < 1 << self.depth:
            slots = slots[tree_order(entries[slots], 1)]
        self.slots = slots
        self.first = np.zeros(len(slots), bool)
        self.first[np.unique(slots, return_index=True)[1]] = True
        self.boxes = boxes(entries[slots], cuts(len(slots), self.depth))
        self.points = entries[slots].astype(float)
        self.norms = (self.points**2).sum(1)


def settle(book: Codebook, points: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the candidate entries, ascending, and squared distance of each point, in integers."""
    entries = book.entries[candidates]
    if max(int(np.abs(points).max()), int(np.abs(entries).max())) ** 2 * 4 * points.shape[1] < 1 << 53:  # doubles hold these integers
        p, e = points.astype(float), entries.astype(float)
        dist = ((p**2).sum(1)[:, None] - 2 * (p @ e.T) + (e**2).sum(1)).astype(np.int64)
    else:
        p = points.astype(np.int64)
        dist = np.stack([((p - e) ** 2).sum(1) for e in entries.astype(np.int64)], axis=1)
    best = dist.argmin(1)
    return candidates[best], dist[np.arange(len(points)), best]


def assign(book: Codebook, points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """points: in tree_order. The entry of every point, and the slices (start, end, entry) that were assigned as whole nodes."""
    n, out, whole = len(points), np.zeros(len(points), np.int64), []
    depth = levels(n, LEAF)
    bounds = cuts(n, depth)
    data = boxes(points, bounds)
    i, j, at, down = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    slack = 1e-9 * max(1.0, max(float(np.abs(points).max()), np.abs(book.points).max()) ** 2 * points.shape[1])
    while True:
        low, high = (x[i] for x in data[at])
        if down < book.depth:
            elow, ehigh = (x[j] for x in book.boxes[down])
            least = (np.maximum(0, np.maximum(elow - high, low - ehigh)) ** 2).sum(1)
            most = (np.maximum(np.abs(ehigh - low), np.abs(high - elow)) ** 2).sum(1)
        else:
            e = book.points[j]
            least = (np.maximum(0, np.maximum(e - high, low - e)) ** 2).sum(1)
            most = (np.maximum(e - low, high - e) ** 2).sum(1)
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        sizes = np.diff(np.append(starts, len(i)))
        stay = least <= np.repeat(np.minimum.reduceat(most, starts), sizes) + slack
        if down == book.depth:
            stay &= book.first[j]
            i, j, most = i[stay], j[stay], most[stay]
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            sizes = np.diff(np.append(starts, len(i)))
            leader = np.repeat(j[np.lexsort((most, i))[starts]], sizes)
            turn = 2 * (book.points[j] - book.points[leader])  # |x-leader|^2 - |x-entry|^2 is linear in x: greatest at a corner
            worst = book.norms[leader] - book.norms[j] + np.maximum(turn * data[at][0][i], turn * data[at][1][i]).sum(1)
            stay = (worst >= -slack) | (j == leader)
            i, j = i[stay], j[stay]
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            sizes = np.diff(np.append(starts, len(i)))
            alone = sizes == 1
            for node, slot in zip(i[starts[alone]], j[starts[alone]]):
                a, b = int(bounds[at][node]), int(bounds[at][node + 1])
                out[a:b] = book.slots[slot]
                whole.append((a, b, int(book.slots[slot])))
            left = np.repeat(~alone, sizes)
            i, j = i[left], j[left]
            if at == depth or not len(i):
                break
        else:
            i, j = i[stay], j[stay]
        # The entries' tree is taken down two levels for each of the data's, so that the lower levels meet single entries.
        for _ in range(2 if at < depth else 1):
            if down < book.depth:
                i, j, down = np.repeat(i, 2), np.column_stack([2 * j, 2 * j + 1]).ravel(), down + 1
        if at < depth:
            twice = np.concatenate([2 * i, 2 * i + 1])
            by_node = np.argsort(twice, kind="stable")
            i, j, at = twice[by_node], np.concatenate([j, j])[by_node], at + 1
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for node, slots in zip(i[starts], np.split(j, starts[1:])):
        a, b = bounds[depth][node], bounds[depth][node + 1]
        out[a:b] = settle(book, points[a:b], np.sort(book.slots[slots]))[0]
    return out, whole


def sums_of(points: np.ndarray, entry: np.ndarray, whole: list[tuple[int, int, int]], entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts of every entry: whole nodes by prefix sums, the others one by one."""
    prefix = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0, dtype=np.int64)])
    sums, counts, rest = np.zeros((entries, points.shape[1]), np.int64), np.zeros(entries, np.int64), np.ones(len(points), bool)
    for a, b, e in whole:
        sums[e] += prefix[b] - prefix[a]
        counts[e] += b - a
        rest[a:b] = False
    np.add.at(sums, entry[rest], points[rest].astype(np.int64))
    counts += np.bincount(entry[rest], minlength=entries)
    return sums, counts


def blocks_of(rows: DataFrame, dims: int, parts: int) -> DataFrame:
    """rows: id, label, vec (integers). Blocks of bounded size: ids, labels, and of every part position the parts in the order of
    their tree, with the row of each."""
    size = max(1, BLOCK // dims)
    one = T.StructType([T.StructField("points", T.BinaryType()), T.StructField("place", T.BinaryType())])
    schema = T.StructType([T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in ("id", "label")] + [T.StructField("parts", T.ArrayType(one))])

    def block(held: pa.Table) -> dict:
        vec = held["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dims)
        trees = []
        for points in np.split(vec, parts, axis=1):
            order = tree_order(points, LEAF)
            trees.append({"points": np.ascontiguousarray(points[order]).tobytes(), "place": order.astype(np.int32).tobytes()})
        return {"id": held["id"].to_pylist(), "label": held["label"].to_pylist(), "parts": trees}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kind = [], 0, pa.schema([("id", pa.list_(pa.int64())), ("label", pa.list_(label)), ("parts", pa.list_(pa.struct([("points", pa.binary()), ("place", pa.binary())])))])
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                whole = pa.Table.from_batches(held)
                yield pa.RecordBatch.from_pylist([block(whole.slice(0, size))], kind)
                held, n = whole.slice(size).to_batches(), n - size
        if n:
            yield pa.RecordBatch.from_pylist([block(pa.Table.from_batches(held))], kind)

    from pyspark.sql.pandas.types import to_arrow_type

    label = to_arrow_type(rows.schema["label"].dataType)
    return map_arrow(rows, run, schema)


def points_of(one: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(one["points"], np.int32).reshape(-1, width), np.frombuffer(one["place"], np.int32)


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, position) after one round; entries without parts stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Codebook(b) for b in books]
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for trio in batch.column("parts"):
                for p, one in enumerate(trio.as_py()):
                    points, _ = points_of(one, width)
                    s, c = sums_of(points, *assign(trees[p], points), entries)
                    sums[p] += s
                    counts[p] += c
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_pydict(
            {"part": used[:, 0].astype(np.int32), "entry": used[:, 1].astype(np.int32), "n": counts[counts > 0], "total": list(sums[counts > 0])},
            pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]),
        )

    found = map_arrow(blocks.select("parts"), run, "part int, entry int, n long, total array<long>")
    added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("total"))
    new = books.copy()
    for row in added.collect():  # at most parts * entries rows
        new[row.part, row.entry] = np.array(row.total) // row.n
    return new


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code, error of every row of the blocks."""
    parts, _, width = books.shape
    label = blocks.schema["label"].dataType.elementType
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, digits = [Codebook(b) for b in books], np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            for k, trio in enumerate(batch.column("parts")):
                ids = batch.column("id")[k].values
                error, code = np.zeros(len(ids), np.int64), np.full(len(ids), "", f"<U{2 * parts}")
                for p, one in enumerate(trio.as_py()):
                    points, place = points_of(one, width)
                    entry, _ = assign(trees[p], points)
                    error[place] += ((points.astype(np.int64) - books[p][entry]) ** 2).sum(1)
                    row_entry = np.empty_like(entry)
                    row_entry[place] = entry
                    code = np.char.add(code, digits[row_entry])
                yield pa.RecordBatch.from_arrays([ids, batch.column("label")[k].values, pa.array(code), pa.array(error)], ["id", "label", "code", "error"])

    return map_arrow(blocks, run, schema)


def digest(books: np.ndarray) -> str:
    """Lowercase hex of the SHA-256 of all integers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_totals(rows: DataFrame, key: str, value: str, total: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """rows with the sum of value over equal keys, nulls together. A key with many rows is joined in up to `salts` groups."""
    (salt,) = fresh([*rows.columns, total], "__salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    groups = dealt.groupBy(key, salt).agg(F.sum(value).alias(total))
    sums = groups.groupBy(F.col(key).alias("k")).agg(F.sum(total).alias("t"))
    by_group = groups.join(sums, F.col(key).eqNullSafe(F.col("k"))).select(F.col(key).alias("k"), F.col(salt).alias("s"), F.col("t").alias(total))
    return dealt.join(by_group, F.col(key).eqNullSafe(F.col("k")) & (F.col(salt) == F.col("s"))).drop("k", "s", salt)


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of all usable vectors, and the codebooks as integers (part, entry, position).

    Null vectors and those with a null or non-finite component are dropped. The length of the smallest id's vector that is a
    positive multiple of `parts` is the length; vectors of another length, empty ones too, have null code and error and move
    nothing. Codebooks start from the `entries` first rows by id, nulls last, then by vector; fewer rows, fewer entries. Repeated
    rows count as often as they stand. Integers beyond limit(length) are set to it, so that distances fit a long. An empty table
    gives an empty one and empty codebooks. Other columns are not read, whatever their names. entries: 256 at most."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("raw")).filter(usable(F.col("raw")))
    whole = rows.filter((F.size("raw") > 0) & (F.size("raw") % parts == 0))
    first = whole.select("id", F.size("raw").alias("n")).orderBy(F.col("id").asc_nulls_last(), "n").limit(1).collect()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", rows.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    odd = lambda df: df.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not first:
        return odd(rows).to(schema), np.zeros((parts, 0, 0), np.int64)
    dims = first[0].n
    even = rows.filter(F.size("raw") == dims).select("id", "label", integers(F.col("raw"), limit(dims), scale).alias("vec"))
    seeds = even.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    books = np.stack(np.split(np.array([r.vec for r in seeds], np.int64), parts, axis=1))
    blocks = stored(blocks_of(even, dims, parts), "vector-blocks")
    for _ in range(rounds):
        books = moved(blocks, books)
    return coded(blocks, books).unionByName(odd(rows.filter(F.size("raw") != dims)).to(schema)), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE, code_col: str = "code", to: str = "vector") -> DataFrame:
    """codes with the vector that each code stands for (middles of the integers' cells); null codes give null."""
    parts, entries, width = books.shape
    entry = lambda p: F.conv(F.substring(F.col(code_col), 2 * p + 1, 2), 16, 10).cast("int")
    values = [F.lit([[(v + 0.5) / scale for v in e] for e in book.tolist()]) for book in books]
    return codes.withColumn(to, F.when(F.col(code_col).isNotNull(), F.concat(*(F.get(v, entry(p)) for p, v in enumerate(values)))))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compressed(table(spark, sf_dir, "embeddings"))
    found = stored(found.withColumnRenamed("id", "vec_id"), "vector-codes")  # read for the rows, the groups and their sums
    rows = with_totals(found, "label", "error", "label_error", F.col("vec_id"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    assigned = """a{k} AS MATERIALIZED (
  SELECT id, label, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.id, x.label, x.p, x.v, b.e, CAST(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v) AS BIGINT) AS d
    FROM x JOIN b{k} b ON b.p = x.p) GROUP BY ALL
)"""
    updated = """b{n} AS MATERIALIZED (
  SELECT o.p, o.e, coalesce(m.v, o.v) AS v FROM b{k} o LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, floor(sum(v[i]) / count(*)) AS m FROM a{k}, generate_series(1, 16) g(i) GROUP BY p, e, i) GROUP BY p, e
  ) m ON m.p = o.p AND m.e = o.e
)"""
    steps = [s.format(k=k, n=k + 1) for k in range(ROUNDS) for s in (assigned, updated)] + [assigned.format(k=ROUNDS)]
    return f"""
WITH kept AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS MATERIALIZED (
  SELECT id, label, p, v[p * 16 + 1 : p * 16 + 16] AS v FROM kept, generate_series(0, {PARTS - 1}) g(p)
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS e, v FROM x QUALIFY e < {ENTRIES}
), {", ".join(steps)}, r AS (
  SELECT id, label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id, label
), s AS (
  SELECT sha256(string_agg(array_to_string(list_transform(v, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS}
)
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s.h AS codebooks_sha256 FROM r, s
"""


ORACLE = _oracle()
