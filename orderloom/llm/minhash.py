"""MinHash near-dedup by min-max hashing.

Each of PERMUTATIONS hash functions gives two signature values, the least and the greatest shingle under it, so half as many
hashes are evaluated for a signature. Both are unbiased for Jaccard similarity. BANDS bands of ROWS values each are joined:
at similarity 0.75 a pair shares no band with probability (1 - 0.75^ROWS)^BANDS, below 1e-5. Links are confirmed on full sets.

Documents with the same shingle set are one class. Within a bucket (classes that share a band) every class is compared with
one hub, the class whose buckets hold most, so a bucket of n classes gives n - 1 comparisons, not n(n - 1) / 2. What is linked
so is one component. Then the members of different components that share a bucket are compared, save those that an exact bound
rules out: shingles that no other candidate has cannot be shared, and of the others, those in the hub's set only within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.common import map_arrow, row_chunks, stored, table, text_bytes

BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS // 2
ODD = 0x9E3779B97F4A7C15
SPACE = np.array([b == 0x20 or 9 <= b <= 13 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_RNG = np.random.default_rng(11)
FACTORS = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where each row's words start."""
    inside = ~SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = starts[:-1][starts[:-1] < starts[1:]]
    opens[heads] = inside[heads]
    first = np.flatnonzero(opens)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    place = np.where(inside, np.arange(len(data)) - first[np.maximum(np.cumsum(opens) - 1, 0)], 0)
    powers = np.full(int(place.max()) + 1, np.uint64(ODD))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = np.where(inside, (LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[place], np.uint64(0))
    return mixed(np.add.reduceat(terms, first)), np.searchsorted(first, starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each row's shingles of `width` words; of fewer words, the whole sequence; of none, empty."""
    words, begin = word_hashes(data, starts)
    odd = np.uint64(ODD)
    grams = words.copy()
    for k in range(1, min(width, len(words))):
        grams[: len(words) - k] = mixed(grams[: len(words) - k] * odd + words[k:])
    for a, b in zip(begin, begin[1:]):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            whole = words[a : a + 1]
            for k in range(a + 1, b):
                whole = mixed(whole * odd + words[k : k + 1])
            yield mixed(whole + np.uint64(b - a))
        else:
            yield words[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation: 2 * PERMUTATIONS values, in blocks so memory stays bounded."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(shingles), 1024):
        values = shingles[None, k : k + 1024] * FACTORS[:, None] + SHIFTS[:, None]
        values ^= values >> np.uint64(32)
        low, high = np.minimum(low, values.min(1)), np.maximum(high, values.max(1))
    return np.concatenate([low, high])


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band, the band's number included. Its maxima are of other permutations than its minima: in small sets, the
    minimum and the maximum of one permutation depend on each other."""
    low, high = signature(shingles).reshape(2, BANDS, ROWS // 2)
    grid = np.concatenate([low, np.roll(high, BANDS // 2, 0)], 1)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(ODD) + grid[:, k])
    return keys.view(np.int64)


def summaries(docs: DataFrame, width: int) -> DataFrame:
    """id, n (size of the shingle set), same (a 128-bit hash of the set), keys (of the bands)."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            for a, b in row_chunks(starts):
                sets = list(shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], width))
                keys = [bands(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(map(len, sets), pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(keys, schema.field(3).type)], schema=schema)

    return map_arrow(docs.select("id", "text"), run, "id long, n long, same binary, keys array<long>")


def sets_of(chosen: DataFrame, width: int) -> DataFrame:
    """id and sorted shingles of the rows of (id, text, same) whose set has that hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            wanted = batch.column(2).to_pylist()
            for a, b in row_chunks(starts):
                sets = list(shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], width))
                right = [k for k, s in enumerate(sets) if xxhash.xxh3_128_digest(s.tobytes()) == wanted[a + k]]
                ends = np.cumsum([0, *(len(sets[k]) for k in right)])
                flat = np.concatenate([np.zeros(0, np.int64), *(sets[k].view(np.int64) for k in right)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + k for k in right], pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["id", "shingles"])

    return map_arrow(chosen.select("id", "text", "same"), run, "id long, shingles array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, their set sizes and the size of their intersection."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    out = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)) for x, y in zip(batch.column(2), batch.column(3))]
            sizes = [pc.list_value_length(batch.column(k)).cast(pa.int64()) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sizes, pa.array(both, pa.int64())], names=["a", "b", "n_a", "n_b", "shared"])

    return map_arrow(out.select("a", "b", "x", "y"), run, "a long, b long, n_a long, n_b long, shared long")


def linking(tested: DataFrame, percent: int) -> DataFrame:
    return tested.filter(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, comp (least id reachable) for every node; links are (a, b). Alternates large-star and small-star steps."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small, "edges")
        seen = edges.agg(F.count("*"), F.sum("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    roots = edges.groupBy("u").agg(F.min("v").alias("comp"))
    return nodes.join(roots, nodes["id"] == roots["u"], "left").select("id", F.coalesce("comp", "id").alias("comp"))


def close(most: Column, a: str, b: str, percent: int) -> Column:
    """Whether an overlap of at most `most` allows the similarity."""
    return F.lit(100) * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


def hubs_of(buckets: DataFrame) -> DataFrame:
    """key, hub, and the hub's n, of each bucket: the class whose buckets hold most."""
    weight = buckets.groupBy("id").agg(F.sum("size").alias("weight"))
    best = F.max(F.struct("weight", (-F.col("id")).alias("order"), "id", "n")).alias("h")
    return buckets.join(weight, "id").groupBy("key").agg(best).select("key", F.col("h.id").alias("hub"), "h.n")


def hub_pairs(buckets: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(a, b): every class of a bucket with the bucket's hub."""
    near = buckets.alias("x").join(hubs.alias("h"), "key").filter((F.col("x.id") != F.col("h.hub")) & close(F.least("x.n", "h.n"), "x", "h", percent))
    return near.select(F.greatest("x.id", "h.hub").alias("a"), F.least("x.id", "h.hub").alias("b")).distinct()


def rest_pairs(buckets: DataFrame, hubs: DataFrame, tested: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): what shares a bucket across components, once, but for pairs that cannot overlap enough.

    m is how many of a set's shingles some other candidate has too, h how many the bucket's hub has. What two sets share lies
    within the hub, at most min(h, h'), or beside it, at most min(m - h, m' - h')."""
    owned = buckets.select("key", "id", "n").join(comps, "id")
    mixed_keys = owned.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    open_ = stored(owned.join(mixed_keys, "key"), "open-buckets")
    alone = sets.join(open_.select("id").distinct(), "id", "left_semi").select("id", F.explode("shingles").alias("s"))
    alone = alone.groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last").groupBy("id").agg(F.count("*").alias("unshared"))
    bound = open_.join(alone, "id", "left").withColumn("m", F.col("n") - F.coalesce("unshared", F.lit(0))).filter(100 * F.col("m") >= percent * F.col("n")).select("key", "id", "n", "m", "comp")
    with_hub = tested.select(F.col("a").alias("id"), F.col("b").alias("hub"), "shared").unionByName(tested.select(F.col("b").alias("id"), F.col("a").alias("hub"), "shared"))
    bound = bound.join(hubs.select("key", "hub"), "key").join(with_hub, ["id", "hub"], "left")
    # not compared with the hub (sizes too different): any part of m may lie within it or beside it
    inside = F.when(F.col("id") == F.col("hub"), F.col("m")).otherwise(F.coalesce("shared", "m"))
    beside = F.when(F.col("id") == F.col("hub"), F.lit(0)).otherwise(F.coalesce(F.col("m") - F.col("shared"), F.col("m")))
    keys = bound.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # at most BANDS
    bound = stored(bound.select("key", "id", "n", "m", "comp", inside.alias("inside"), beside.alias("beside")).join(keys, "id"), "bounded-buckets")
    main = bound.groupBy("key", "comp").agg(F.count("*").alias("members")).groupBy("key").agg(F.max(F.struct("members", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"))
    few = bound.join(main, "key").filter("comp <> main")
    most = F.least("x.m", "y.m", F.least("x.inside", "y.inside") + F.least("x.beside", "y.beside"))
    first = F.element_at(F.array_intersect("x.keys", "y.keys"), 1) == F.col("x.key")
    either = (F.col("y.comp") == F.col("x.main")) | (F.col("x.id") < F.col("y.id"))
    pairs = few.alias("x").join(bound.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & close(most, "x", "y", percent) & either & first)
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """id_col, n_shingles, component_id (least id reachable over links, itself included), kept (id is its component's).

    A row for each row of docs. Null and empty texts have no shingles and no links. Of an id with several texts, the set of
    least hash is linked, rows with its other texts stand alone. Null ids have no component and are kept. An empty table gives
    an empty one. Other columns are left out, whatever their names."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = stored(summaries(base, width), "summaries")
    known = found.filter("id is not null and n > 0")
    classes = known.groupBy("same").agg(F.min("id").alias("id")).groupBy("id").agg(F.min("same").alias("same"))
    heads = known.join(classes, ["id", "same"], "left_semi").select("id", "same", "n", F.explode("keys").alias("key")).dropDuplicates(["key", "id"])
    sizes = heads.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = stored(heads.join(sizes, "key"), "buckets")
    chosen = buckets.groupBy("id").agg(F.first("same").alias("same"))
    sets = stored(sets_of(base.join(chosen, "id"), width), "sets")
    hubs = stored(hubs_of(buckets), "hubs")
    tested = stored(overlaps(hub_pairs(buckets, hubs, percent), sets), "tested")
    links, nodes = linking(tested, percent), stored(chosen.select("id"), "nodes")
    rest = rest_pairs(buckets, hubs, tested, stored(components(links, nodes), "comps"), sets, percent)
    more = stored(linking(overlaps(rest, sets), percent), "links")
    comps = components(links.unionByName(more), nodes)
    of_class = classes.join(comps, "id", "left").select("same", F.coalesce("comp", "id").alias("comp"))
    with_class = known.select("id", "n", "same").join(of_class, "same", "left").select("id", "n", F.coalesce("comp", "id").alias("comp"))
    alone = found.filter("id is null or n = 0").select("id", "n", F.col("id").alias("comp"))
    return with_class.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that are linked with a document of lesser id."""
    gone = linked(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM w
), classes AS (
  SELECT s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), sh AS (
  SELECT id, n, unnest(s) AS s FROM classes
), pairs AS (
  SELECT a.id AS a, b.id AS b, a.n + b.n AS total, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2, 3
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (total - shared)
), reach(id, comp) AS (
  SELECT id, id FROM classes UNION SELECT links.b, reach.comp FROM reach JOIN links ON links.a = reach.id
), comps AS (
  SELECT id, min(comp) AS comp FROM reach GROUP BY 1
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CAST(coalesce(comp, sets.doc_id) AS BIGINT) AS component_id, coalesce(comp, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN comps ON comps.id = classes.id
"""
