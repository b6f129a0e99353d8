"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of `width` consecutive words (a shorter item is one window). A window is contained in a
document only if all its words are, so one word of it, its prefix, is enough to find candidates: the rarest in the corpus,
by counts over all documents. A document's words are joined with the prefixes; the window's place follows from the prefix
word's place (positional bound), must lie inside the document (length bound), and is then compared word by word.

The benchmark is taken in slices of at most SLICE_BYTES of text, the most that is sent to tasks at once (its windows take about
fifty times as much memory); every slice meets every document, and what it finds travels with the row. A prefix word costs one
look-up for each place that it has in windows, however many windows it stands for.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import fresh, map_arrow, row_chunks, table, text_bytes

SLICE_BYTES = 4 << 20
#: Bytes that are not part of a word become blanks, A-Z become a-z.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]
PA_FOUND = [("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def benchmark_slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """(item id as text, text) in slices by hash, each collected alone. An item's text is bounded, the benchmark is not."""
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").cast("binary").alias("body"))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = -(-total * 5 // (4 * SLICE_BYTES)) if total > SLICE_BYTES else 1
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == k) if n > 1 else rows
        yield [(r.item, bytes(r.body)) for r in own.toLocalIterator()]


def corpus_counts(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of a slice occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        known = sent.value
        for batch in batches:
            data, starts = text_bytes(batch.column(0))
            for a, b in row_chunks(starts):
                counts.update(filter(known.__contains__, words_of(b" ".join(data[starts[i] : starts[i + 1]].tobytes() for i in range(a, b)))))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.toLocalIterator()}  # at most the slice's vocabulary


def index(items: list[tuple[str, bytes]], width: int, counts: dict[bytes, int]) -> dict[bytes, dict]:
    """Prefix word to {(place in window, words of window): {window: items}}."""
    of_window: dict[tuple[bytes, ...], tuple[str, ...]] = {}
    for item, body in items:
        for window in windows_of(words_of(body), width):
            owners = of_window.get(window, ())
            if item not in owners:
                of_window[window] = (*owners, item)
    out: dict[bytes, dict] = defaultdict(dict)
    for window, owners in of_window.items():
        place = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i], i))
        out[window[place]].setdefault((place, len(window)), {})[window] = owners
    return dict(out)


def hits(words: list[bytes], prefixes: dict[bytes, dict]) -> tuple[dict[int, int], set[str]]:
    """Start of each contained window with its end (the farthest, where items of fewer words share a start), and the items."""
    spans: dict[int, int] = {}
    items: set[str] = set()
    if prefixes.keys().isdisjoint(words):
        return spans, items
    for at, word in enumerate(words):
        if (of_word := prefixes.get(word)) is None:
            continue
        for (place, size), windows in of_word.items():
            start, end = at - place, at - place + size
            if start >= 0 and end <= len(words) and (owners := windows.get(tuple(words[start:end]))):
                spans[start] = max(end, spans.get(start, 0))
                items.update(owners)
    return spans, items


def overlap(docs: DataFrame, benchmark: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", into: str = "contamination") -> DataFrame:
    """All columns of docs, and `into`, replacing a column of that name: struct of n_words, n_hit, items (sorted texts of item ids).

    Null and empty texts have no words and no hits; an empty benchmark gives no hits; items without words are left out; equal
    items count each; repeated rows give a row each. Ties in rarity go to the smaller word, then the earlier place."""
    text, *own_names = fresh([*docs.columns, into], "__text", *(f"__{f.name}" for f in FOUND))
    n_words, starts_, ends_, items_ = own_names
    rows = docs.withColumn(text, F.col(text_col).cast("string")).withColumns({name: F.lit(None).cast(f.dataType) for name, f in zip(own_names, FOUND)})
    kept = rows.columns
    for k, items in enumerate(benchmark_slices(benchmark, item_id_col, item_text_col)):
        vocabulary = {w for _, body in items for w in words_of(body)}
        sent = docs.sparkSession.sparkContext.broadcast(index(items, width, corpus_counts(docs, text_col, vocabulary) if vocabulary else {}))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=k == 0) -> Iterator[pa.RecordBatch]:
            prefixes = sent.value
            for batch in batches:
                n_rest = batch.num_columns - 5
                data, starts = text_bytes(batch.column(n_rest))
                before = [[None] * batch.num_rows] * 4 if first else [batch.column(n_rest + 1 + i).to_pylist() for i in range(4)]
                out: list[list] = [[], [], [], []]
                for i in range(batch.num_rows):
                    words = words_of(data[starts[i] : starts[i + 1]].tobytes())
                    spans, items = hits(words, prefixes)
                    for own, old, new in zip(out, (b[i] for b in before), (len(words), list(spans), list(spans.values()), sorted(items))):
                        own.append(new if isinstance(new, int) else (old or []) + new)
                arrays = [pa.array(x, kind) for x, (_, kind) in zip(out, PA_FOUND)]
                schema = pa.schema([*list(batch.schema)[: n_rest + 1], *(pa.field(n, kind) for n, (_, kind) in zip(own_names, PA_FOUND))])
                yield pa.RecordBatch.from_arrays([*batch.columns[: n_rest + 1], *arrays], schema=schema)

        rows = map_arrow(rows, run, T.StructType([*rows.select(kept).schema]))
    covered = F.aggregate(
        F.array_sort(F.arrays_zip(F.col(starts_).alias("s"), F.col(ends_).alias("e"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")),
    )["n"]
    found = F.struct(F.col(n_words).alias("n_words"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(items_)).alias("items"))
    return rows.withColumn(into, found).drop(text, *own_names)


def contaminated(found: str = "contamination") -> Column:
    """The contract's rule: at least a twentieth of the words stand in benchmark windows."""
    return (F.col(f"{found}.n_hit") > 0) & (20 * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(overlap(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    (found,) = fresh(docs.columns, "__found")
    return overlap(docs, benchmark, into=found).filter(~contaminated(found)).drop(found)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item, least(len(w), 13) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i, w FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM bw
), sizes AS (
  SELECT DISTINCT n FROM win
), dw AS (
  SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM d, sizes WHERE len(w) >= n
), dg AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM dw
), m AS (
  SELECT dg.doc_id, dg.i, dg.n, win.item FROM dg JOIN win USING (n, s)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY 1
), its AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
