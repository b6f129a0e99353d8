"""Information-theoretic sanitisation of personal data.

Base spans (e-mail, IP, card, phone) are found by pattern. A term's disclosure of a protected value e is measured on the
corpus: PMI(t, e) / IC(e) = log(N n(t,e) / (n(t) n(e))) / log(N / n(e)), with counts of documents; n(t,e) counts documents in
which t stands within `window` words of e. 1 means that t occurs with e alone, which any word does that stands once; so a pair
counts only with support. It must have k >= `support` contexts that differ in all their quarters (an edited copy of a passage still
shares one), and these must be more than chance: n(t) documents hit those of e at least k times with a probability below
(e n(t) n(e) / (k N))^k. As very many pairs are tried, the greatest probability that is let through is the one below which at most a
share `level` of the pairs let through is expected to be chance (Benjamini and Hochberg, over all M pairs that meet), so the rule
is as strict for a large corpus as for a small one. Terms at or over `generalise_at` become a class label, at or over `remove_at`
they are removed, wherever they occur. A name that stands beside a value in one context alone is left alone.

Terms are never gathered: candidates and flagged terms meet the documents' words in joins. Before these, words are sifted by a
bitmap of BITS bits of the terms' hashes, the one thing that is sent to every task; its size does not depend on the terms, and
what it lets through by chance the joins drop.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import fresh, map_arrow, row_chunks, stored, table, text_bytes

KINDS = ("email", "ip", "card", "phone", "term")
BITS = 26
FLUSH = 100_000
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,40}")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
PA_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> list[tuple[str, int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1)
        if start < at and domain:
            found.append(("email", start, domain.end()))
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then by start."""
    found = emails(text)
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return found


def may_hold(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows with a digit or an at sign: no base span lacks both."""
    hit = ((data >= 0x30) & (data <= 0x39)) | (data == 0x40)
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[starts[1:]] > total[starts[:-1]]


def value_of(kind: str, text: str) -> str:
    return f"{kind}:{text.lower() if kind == 'email' else digits_of(text) if kind != 'ip' else text}"


def quarters(left: list[str], right: list[str], window: int) -> list[int]:
    """A hash of each quarter of a context (words from the value outwards); a quarter without words has the whole's."""
    half = -(-window // 2)
    parts = [p or left + right for p in (left[half:], left[:half], right[:half], right[half:])]
    return [int.from_bytes(hashlib.blake2b("\n".join(p).encode(), digest_size=8).digest(), "big", signed=True) for p in parts]


def contexts(text: str, spans: list[tuple[str, int, int]], window: int) -> dict[tuple[str, str], list[int]]:
    """(value, term) of one document, with hashes of the quarters of the first context in which they meet."""
    words = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
    starts = np.array([w[0] for w in words], np.int64)
    covered = sorted((a, b) for _, a, b in spans)
    cover_starts = np.array([a for a, _ in covered], np.int64)
    cover_ends = np.maximum.accumulate([b for _, b in covered])
    met: dict[tuple[str, str], list[int]] = {}
    for kind, a, b in spans:
        value = value_of(kind, text[a:b])
        left, right = np.searchsorted(starts, a), np.searchsorted(starts, b)
        sides = []
        for step, k in ((-1, left - 1), (1, right)):
            near = []
            while 0 <= k < len(words) and len(near) < window:
                c = np.searchsorted(cover_starts, words[k][0], "right") - 1
                if c < 0 or cover_ends[c] <= words[k][0]:
                    near.append(words[k][2])
                k += step
            sides.append(near)
        seen = quarters(*sides, window)
        for term in sides[0] + sides[1]:
            met.setdefault((value, term), seen)
        met.setdefault((value, ""), seen)
    return met


def pairs(docs: DataFrame, text_col: str, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.string()), ("term", pa.string()), *((f"q{i}", pa.int64()) for i in range(4))])
        for batch in batches:
            data, starts = text_bytes(batch.column(0))
            for i in np.flatnonzero(may_hold(data, starts)):
                text = data[starts[i] : starts[i + 1]].tobytes().decode()
                spans = base_spans(text)
                if spans:
                    met = contexts(text, spans, window)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([v for v, _ in met], [t for _, t in met])] + [pa.array(q, pa.int64()) for q in zip(*met.values())], schema=schema)

    return map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "value string, term string, q0 long, q1 long, q2 long, q3 long")


class Sieve:
    """A bitmap of the hashes of terms: says no to nearly all other words."""

    def __init__(self, terms: DataFrame) -> None:
        place = F.xxhash64("term").bitwiseAND(F.lit((1 << BITS) - 1))
        rows = terms.groupBy(F.shiftright(place, 15).alias("block")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits")).collect()
        bits = bytearray(max(4096, 1 << BITS >> 3))
        for r in rows:  # at most 2^(BITS - 15), of 4 KB each
            bits[r.block << 12 : (r.block + 1) << 12] = r.bits
        self.empty, self.bits, self.mask = not rows, bytes(bits), (1 << BITS) - 1
        self.known: dict[str, bool] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def passed(self, words: Iterable[str]) -> list[str]:
        known, out = self.known, []
        if len(known) > FLUSH:
            known.clear()
        for word in words:
            hit = known.get(word)
            if hit is None:
                h = xxhash.xxh64_intdigest(word.encode(), 42) & self.mask  # as Spark's xxhash64
                hit = known[word] = bool(self.bits[h >> 3] >> (h & 7) & 1)
            if hit:
                out.append(word)
        return out


def document_counts(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """In how many rows of docs each of the terms (distinct) occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(Sieve(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, counts = sent.value, Counter()
        for batch in batches:
            for text in batch.column(0):
                if (text := text.as_py()) and not sieve.empty:
                    counts.update(sieve.passed(set(WORD.findall(text.lower()))))
            if len(counts) > FLUSH:
                yield pa.RecordBatch.from_pydict({"term": list(counts), "n": list(counts.values())})
                counts.clear()
        if counts:
            yield pa.RecordBatch.from_pydict({"term": list(counts), "n": list(counts.values())})

    counted = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term")).join(terms, "term", "left_semi")


#: Steps of log probability in which pairs are counted, and the least that is told apart.
STEP, FLOOR = 0.05, -500.0


def bar(by_chance: DataFrame, tried: int, level: float) -> float:
    """The greatest log probability at which, of the pairs at or below it, at most a share `level` is expected to be chance.
    by_chance: by_chance of the pairs that have support; tried: all pairs. At most FLOOR / STEP counts come to the driver."""
    most = math.log(level) if level > 0 else FLOOR
    step = F.ceil(F.greatest(F.col("by_chance"), F.lit(FLOOR)) / STEP)
    counts = sorted(by_chance.filter(F.col("by_chance") <= most).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect())
    best, total = -math.inf, 0
    for r in counts:
        total += r.n
        if r.step * STEP <= most + math.log(total / tried):
            best = r.step * STEP
    return best


def disclosures(docs: DataFrame, text_col: str = "text", window: int = 8, level: float = 0.01, support: int = 2, generalise_at: float = 0.9) -> DataFrame:
    """term, value, disclosure of pairs at or over generalise_at. level: 1 or more lets all pairs with support pass."""
    n_docs = docs.count()
    rows = stored(pairs(docs, text_col, window), "met")
    names = [f"q{i}" for i in range(4)]
    differ = [F.min(q) != F.max(q) for q in names]
    met = stored(rows.groupBy("value", "term").agg(F.count("*").alias("n_both"), F.least(*differ).alias("differ")), "met-pairs")
    values = met.filter("term = ''").select("value", F.col("n_both").alias("n_value"))
    both = met.filter("term <> '' and differ").drop("differ").join(values, "value").filter(F.col("n_value") < n_docs)
    k = rows.join(both.select("value", "term"), ["value", "term"], "left_semi").groupBy("value", "term").agg(F.least(*map(F.count_distinct, names)).alias("k"))
    both = stored(both.join(k, ["value", "term"]).filter(F.col("k") >= support), "met-often")
    counts = document_counts(docs, text_col, both.select("term").distinct())
    n = F.lit(float(n_docs))
    share = F.log(n * F.col("n_both") / (F.col("n_term") * F.col("n_value"))) / F.log(n / F.col("n_value"))
    by_chance = F.col("k") * F.log(F.lit(np.e) * F.col("n_term") * F.col("n_value") / (F.col("k") * n))
    scored = stored(both.join(counts, "term").select("term", "value", share.alias("disclosure"), by_chance.alias("by_chance")), "disclosures")
    found = scored.filter(F.col("disclosure") >= generalise_at)
    if level < 1:
        found = found.filter(F.col("by_chance") <= bar(scored, max(1, met.filter("term <> ''").count()), level))
    return found.drop("by_chance")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, level: float = 0.01, support: int = 2, generalise_at: float = 0.9, remove_at: float = 0.97) -> DataFrame:
    """id_col, spans (kind, start, end in code points; by kind, then start) and sanitised text of every row.

    Null and empty texts have no spans and an empty sanitised text. Repeated rows give a row each. Ties in a kind keep the
    leftmost match. An empty table gives an empty one. Other columns are left out, whatever their names."""
    flagged = stored(disclosures(docs, text_col, window, level, support, generalise_at).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "flagged")
    sieve = Sieve(flagged)
    sent = docs.sparkSession.sparkContext.broadcast(sieve)
    out = T.StructType([docs.select(id_col).schema[0], T.StructField("spans", SPANS), T.StructField("sanitised", T.StringType())])
    base = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(fresh([id_col], "text")[0]))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of which no word passes the sieve."""
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            held = may_hold(data, starts)
            for a, b in row_chunks(starts):
                texts = [data[starts[i] : starts[i + 1]].tobytes().decode() for i in range(a, b)]
                rows = [i for i, t in enumerate(texts) if sent.value.empty or not sent.value.passed(set(WORD.findall(t.lower())))]
                spans = [base_spans(texts[i]) if held[a + i] else [] for i in rows]
                yield _rows(batch.column(0).take(pa.array([a + i for i in rows], pa.int64())), batch.schema.field(0), spans, [rewritten(texts[i], s, {}, remove_at) for i, s in zip(rows, spans)])

    done = map_arrow(base, alone, out)
    if sieve.empty:
        return done
    kind = out[0].dataType

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other rows, with the words that pass."""
        for batch in batches:
            found = [sent.value.passed(set(WORD.findall((t.as_py() or "").lower()))) for t in batch.column(1)]
            rows = pa.array([i for i, w in enumerate(found) if w], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([w for w in found if w], pa.list_(pa.string()))], names=["own", "text", "words"])

    rows = stored(map_arrow(base, passing, T.StructType([T.StructField("own", kind), T.StructField("text", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])), "sifted")
    rows = rows.withColumns({"key": F.xxhash64("text"), "size": F.length("text")})
    lexicon = rows.select("key", "size", F.explode("words").alias("term")).distinct().join(flagged, "term").groupBy("key", "size").agg(F.collect_list(F.struct("term", "disclosure")).alias("lexicon"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, new = batch.column(1).to_pylist(), [], []
            for text, own in zip(texts, batch.column(2).to_pylist()):
                known = {x["term"]: x["disclosure"] for x in own or ()}
                spans.append(base_spans(text) + term_spans(text, known))
                new.append(rewritten(text, spans[-1], known, remove_at))
            yield _rows(batch.column(0), pa.field(out[0].name, batch.schema.field(0).type), spans, new)

    return done.unionByName(map_arrow(rows.join(lexicon, ["key", "size"], "left").select("own", "text", "lexicon"), met, out))


def term_spans(text: str, lexicon: dict[str, float]) -> list[tuple[str, int, int]]:
    if not lexicon or lexicon.keys().isdisjoint(WORD.findall(text.lower())):
        return []
    return [("term", *m.span()) for m in WORD.finditer(text) if m.group().lower() in lexicon]


def rewritten(text: str, spans: list[tuple[str, int, int]], lexicon: dict[str, float], remove_at: float) -> str:
    """Text with base spans as labels, terms generalised or removed; of overlapping spans the first counts."""
    if not spans:
        return text
    parts, done = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start < done:
            done = max(done, end)
            continue
        parts.append(text[done:start])
        if kind != "term":
            parts.append(f"[{kind}]")
        elif lexicon.get(text[start:end].lower(), 1.0) < remove_at:
            parts.append("[name]" if text[start].isupper() else "[word]")
        done = end
    return "".join([*parts, text[done:]])


def _rows(ids: pa.Array, field: pa.Field, spans: list, texts: list[str]) -> pa.RecordBatch:
    kinds = [[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in spans]
    return pa.RecordBatch.from_arrays([ids, pa.array(kinds, PA_SPANS), pa.array(texts, pa.string())], schema=pa.schema([field, pa.field("spans", PA_SPANS), pa.field("sanitised", pa.string())]))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(sanitise(table(spark, sf_dir, "documents")))


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def digests(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
