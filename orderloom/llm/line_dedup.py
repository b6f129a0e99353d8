"""Line dedup by winnowing over line hashes, with DataFrame operations only.

The lines of a document that hold words are numbered. A run at a line is the fewest lines from there with `run_words` words; a
run up to a line, the fewest lines that end there. Winnowing: of every run the line of the least hash is selected, the first of
equal ones, so that equal runs, wherever they stand, have the same line selected. Selected positions are fingerprints, far fewer
than lines. They are joined on their hashes: a fingerprint that stands at one position only belongs to no repeated run, and its
runs go. From the others the match is extended both ways, over every run that holds the fingerprint, as far as it is needed to
reach `run_words` words before it, after it or around it; these runs are compared as a whole, by 128 bits, with the first place of
the same run, whatever other places the fingerprint has. A run that has an earlier place, by (doc_id, line), is deleted; what
comes first stays. A longer passage that stands earlier is made up of such runs: of its lines, each lies in the run at it, in the
run up to it, or in the one at the passage's start. So a line is deleted if, and only if, it is in `run_words` words or more that
stand earlier as well, whatever their context is there.

Joins have one row per hash or run on one side; no pairs within a group are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.functions.text import let
from orderloom.llm.common import fresh, stored, table

WORD = r"[^\x20\x09-\x0D]+"
RUN_WORDS = 40
KEY = ["id", "tie"]


def lines_of(rows: DataFrame) -> DataFrame:
    """id, tie, pos (of all lines), digest (hex of 128 bits), words, before (words before it) of lines with words; identical documents
    once. rows: id, tie, body."""
    exploded = rows.select(*KEY, F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    lines = exploded.select(*KEY, "pos", F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"), F.md5(F.col("line").cast("binary")).alias("digest")).filter("words > 0")
    own = W.partitionBy(*KEY).orderBy("pos")
    lines = lines.withColumn("previous", F.lag("pos").over(own)).filter("previous is null or previous <> pos")
    return lines.select(*KEY, "pos", "digest", "words", (F.sum("words").over(own) - F.col("words")).alias("before"))


def runs_of(lines: DataFrame, run_words: int) -> DataFrame:
    """id, tie, pos, last (of its first and last line), run (128 bits of it), mark (hash of the line selected in it) and mark_pos of
    the runs at lines, and of those up to lines that are not among these."""
    doc = W.partitionBy(*KEY)
    ahead = doc.orderBy("before").rangeBetween(0, run_words - 1)
    back = doc.orderBy("end").rangeBetween(1 - run_words, 0)
    ends = lines.withColumns({"end": F.col("before") + F.col("words"), "hash": F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")})

    def of(w) -> list[Column]:  # noqa: ANN001
        least = F.min(F.struct("hash", F.col("pos").alias("at"))).over(w)
        return [F.min("pos").over(w).alias("pos"), F.max("pos").over(w).alias("last"), F.sum("words").over(w).alias("total"), F.collect_list("digest").over(w).alias("digests"), least.alias("least")]

    both = ends.select(*KEY, "words", F.struct(*of(ahead)).alias("ahead"), F.struct(*of(back)).alias("back"))
    # A run up to a line that still has run_words words without that line is not the run at its first line.
    found = F.filter(F.array(F.when(F.col("ahead.total") >= run_words, F.col("ahead")), F.when(F.col("back.total") - F.col("words") >= run_words, F.col("back"))), F.isnotnull)
    each = both.select(*KEY, F.explode(found).alias("r"))
    return each.select(*KEY, "r.pos", "r.last", F.md5(F.array_join("r.digests", "").cast("binary")).alias("run"), F.col("r.least.hash").alias("mark"), F.col("r.least.at").alias("mark_pos"))


def repeated(lines: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """id, tie, pos, last of every run that has an earlier place; its lines with words are to be deleted."""
    runs = stored(runs_of(lines, run_words), "line-runs")
    place = F.struct(*KEY, "mark_pos")
    marks = runs.groupBy("mark").agg(F.min(place).alias("first"), F.max(place).alias("final")).filter("first <> final").select("mark")
    held = runs.join(marks, "mark", "left_semi").select(*KEY, "pos", "last", "run")
    place = F.struct(*KEY, "pos")
    firsts = held.groupBy("run").agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    return held.join(firsts, "run").filter(place > F.col("first")).select(*KEY, "pos", "last")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, removed_col: str = "removed_lines") -> DataFrame:
    """docs with deleted lines taken out of the text, and the positions of those lines (from 0) as removed_col, replacing a
    column of that name.

    Null texts stay null and lose nothing; lines without words are never deleted. Rows with the same id and text are one
    document: they keep and lose the same lines. Rows with the same id and other texts are ordered by a hash of the text; null
    ids come last. Runs of fewer than run_words words stay. An empty table gives an empty one.
    Other columns are kept, whatever their names."""
    given = docs.drop(removed_col)
    id_, tie, body, cuts, found = fresh([*given.columns, removed_col], "__id", "__tie", "__body", "__cuts", "__found")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = given.withColumns({id_: F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), tie: F.xxhash64(text), body: text})
    lines = lines_of(rows.select(F.col(id_).alias("id"), F.col(tie).alias("tie"), F.col(body).alias("body")))
    spans = repeated(lines, run_words).groupBy(F.col("id").alias(id_), F.col("tie").alias(tie)).agg(F.collect_set(F.struct("pos", "last")).alias(cuts))

    def cut(every: Column) -> Column:
        """struct(gone, left): positions of deleted lines, and the others joined again."""
        covered = F.array_distinct(F.flatten(F.transform(cuts, lambda s: F.sequence(s["pos"], s["last"]))))
        left = lambda gone: F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), gone), lambda i: F.get(every, i))
        return let(F.array_sort(F.filter(covered, lambda i: F.regexp_like(F.get(every, i), F.lit(WORD)))), lambda gone: F.struct(gone.alias("gone"), F.array_join(left(gone), "\n").alias("left")))

    both = rows.join(spans, [id_, tie], "left").withColumn(found, F.when(F.col(cuts).isNotNull(), let(F.split(body, "\n", -1), cut)))
    new = F.when(F.col(found).isNull(), F.col(text_col)).otherwise(F.col(found)["left"])
    return both.withColumns({text_col: new, removed_col: F.coalesce(F.col(found)["gone"], F.array().cast("array<int>"))}).select(*given.columns, removed_col)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = without_repeats(docs)
    return found.select(
        "doc_id",
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without repeated lines; documents of which no words are left go."""
    (gone,) = fresh(docs.columns, "__removed")
    found = without_repeats(docs, removed_col=gone)
    left = (F.size(gone) == 0) | F.regexp_like(F.coalesce("text", F.lit("")), F.lit(WORD))
    return found.filter(left).select(docs.columns)


ORACLE = r"""
WITH l AS (
  SELECT doc_id AS id, u.pos - 1 AS pos, u.line AS line
  FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos) AS u
), h AS (
  SELECT id, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) AS hash FROM l
), lines AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n, CAST(sum(words) OVER (PARTITION BY id ORDER BY pos) - words AS BIGINT) AS before FROM h WHERE words > 0
), w AS (
  SELECT id, n, before, words, max(before + words) OVER (PARTITION BY id) AS total,
         list(hash) OVER a AS ahead, max(n) OVER a AS last, list(hash) OVER b AS back, min(n) OVER b AS first
  FROM lines WINDOW a AS (PARTITION BY id ORDER BY before RANGE BETWEEN CURRENT ROW AND 39 FOLLOWING), b AS (PARTITION BY id ORDER BY before + words RANGE BETWEEN 39 PRECEDING AND CURRENT ROW)
), runs AS (
  SELECT id, n AS a, last AS b, md5(array_to_string(ahead, ',')) AS run FROM w WHERE total - before >= 40
  UNION SELECT id, first, n, md5(array_to_string(back, ',')) FROM w WHERE before + words >= 40
), firsts AS (
  SELECT run, min({'id': id, 'n': a}) AS f FROM runs GROUP BY run
), covered AS (
  SELECT DISTINCT id, unnest(generate_series(a, b)) AS n FROM runs JOIN firsts USING (run) WHERE id > f.id OR (id = f.id AND a > f.n)
), gone AS (
  SELECT id, pos FROM covered JOIN lines USING (id, n)
), removed AS (
  SELECT id, count(*) AS n_removed, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM gone GROUP BY 1
), kept AS (
  SELECT l.id, string_agg(line, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN gone ON gone.id = l.id AND gone.pos = l.pos WHERE gone.id IS NULL GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN removed r ON r.id = d.doc_id LEFT JOIN kept ON kept.id = d.doc_id
"""
