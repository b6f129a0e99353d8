"""Removal of repeated byte strings by sampled suffix sorting, deep-shallow.

Any string of SHORT bytes holds an anchor: of its GRAM-byte substrings the one with the least hash (the first, on ties). Equal
strings have their anchors at the same offset, so only suffixes at anchors are sorted. An anchor covers the run of windows
(SHORT-byte strings) that it is the anchor of, and the LENGTH-byte strings that start where these do. Anchors are grouped by
their gram; grams seen once are done. Anchors whose whole runs, up to the end of the last LENGTH-byte string, are equal settle
each other. For the rest, two orders are made of each group: of the bytes from the anchor on, and of the bytes before it read
backwards. Multikey quicksort orders both to a shallow depth, blind tries order what still agrees there. A string of n bytes that
starts d bytes before its anchor is repeated if another member shares d bytes before and n - d from it on: if both lie in one
interval of each order, at depths d and n - d. Orders change at few depths, so few are looked at.

LENGTH is what is removed. The same orders settle strings of SHORT bytes, about forty words: passages that repeat but are too
short to be removed are counted.

Groups of more than GROUP different members (one gram in very many contexts; so many bodies take about 13 MB) are split before
they are brought into tasks, as multikey quicksort splits, by the bytes that come next on either side. A string of n bytes that
starts between x and y bytes before its anchor is shared only by members that agree in x bytes before the anchor and in n - y from
it on: these are one part. A part that is still too large is halved by distance, x to the middle and the rest, each with the bytes
that its members must agree in as well, and loses those bytes; parts of one member are done. A part of one distance holds one
string, so all of it is repeated.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.llm.common import map_arrow, stored, table, text_bytes

LENGTH, SHORT, GRAM = 400, 256, 65
SPAN = SHORT - GRAM + 1  # grams in a window
SHALLOW = 12
GROUP = 20_000
PIECE = 1 << 20
ODD = 0x9E3779B97F4A7C15
KEY = ["id", "tie"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any substring of a piece of text, from prefix sums."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int) -> None:
        known = Hashes.powers.get(base)
        if known is None or len(known[0]) <= len(data):
            size = max(len(data) + 1, 1 << 14)
            known = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                known.append(np.multiply.accumulate(p))
            Hashes.powers[base] = known = tuple(known)
        up, self.down = known
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, first and last window, hash of the gram, hash of the run, of each anchor of one text, in pieces of bounded size."""
    n, parts = len(data), []
    for first in range(0, max(n - SHORT + 1, 0), PIECE):
        part = data[first : first + PIECE + LENGTH - 1]
        windows = min(PIECE, len(part) - SHORT + 1)
        hashes = Hashes(part, ODD)
        at = np.arange(len(part) - GRAM + 1)
        grams = hashes.of(at, at + GRAM)
        least = (grams >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
        step = 1
        while 2 * step <= SPAN:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < SPAN:
            least = np.minimum(least[: step - SPAN], least[SPAN - step :])
        own = (least[:windows] & np.uint64((1 << 24) - 1)).astype(np.int64)
        change = np.flatnonzero(np.diff(own)) + 1
        a = np.concatenate([[0], change])
        b = np.concatenate([change, [len(own)]]) - 1
        p = own[a]
        run = hashes.of(a, np.minimum(b + LENGTH, len(part))) ^ mixed((p - a).astype(np.uint64) << np.uint64(20) | (b - a).astype(np.uint64))
        parts.append((p + first, a + first, b + first, grams[p].view(np.int64), run.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """id, tie, p, lo, hi (distances of the first and the last window from the anchor), size (of the text), gram, run: of each anchor."""
    kinds = [("id", pa.int64()), ("tie", pa.int64()), ("p", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16()), ("size", pa.int32()), ("gram", pa.int64()), ("run", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(2))
            found = [anchors(data[a:b]) for a, b in zip(starts, starts[1:])]
            sizes = [len(x[0]) for x in found]
            if not sum(sizes):
                continue
            p, a, b, gram, whole = (np.concatenate(x) for x in zip(*found))
            row = np.repeat(np.arange(len(sizes)), sizes)
            size, row = np.diff(starts)[row], pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(x.astype(k.to_pandas_dtype())) for x, (_, k) in zip((p, p - a, p - b, size, gram, whole), kinds[2:]))], schema=pa.schema(kinds))

    return map_arrow(docs.select(*KEY, "text"), run, "id long, tie long, p int, lo short, hi short, size int, gram long, run long")


def shared(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix, which is at least `at`."""
    end = min(len(x), len(y))
    if x[at:end] == y[at:end]:
        return end
    step = 8
    while x[at : at + step] == y[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if x[at : at + step] == y[at : at + step]:
            at += step
    return at


class Node:
    __slots__ = ("depth", "children", "member")

    def __init__(self, depth: int, member: int) -> None:
        self.depth, self.member, self.children = depth, member, {}


def blind_trie(texts: list[bytes], members: list[int], depth: int) -> Iterator[tuple[int, int]]:
    """(member, length shared with the one before) in order. Inner nodes keep a depth and a branching byte for each child only;
    a new member goes down blindly to a leaf, is compared with that leaf alone, and is put in where they part."""
    root = Node(len(texts[members[0]]), members[0])
    for member in members[1:]:
        text, node = texts[member], root
        while node.children:
            byte = text[node.depth] if node.depth < len(text) else -1
            node = node.children.get(byte) or next(iter(node.children.values()))
        common = shared(text, texts[node.member], depth)
        parent, node = None, root
        while node.depth < common:
            parent, node = (node, text[node.depth] if node.depth < len(text) else -1), node.children[text[node.depth] if node.depth < len(text) else -1]
        if node.children and node.depth == common:  # a new branch here
            byte = text[common] if common < len(text) else -1
            leaf = node.children.get(byte)
            if leaf is None:
                node.children[byte] = Node(len(text), member)
            else:  # equal to a leaf that ends here
                _twin(leaf, text, member)
            continue
        if not node.children and node.depth == common == len(text):
            _twin(node, text, member)
            continue
        inner = Node(common, node.member)
        other = texts[node.member]
        inner.children[other[common] if common < len(other) else -1] = node
        inner.children[text[common] if common < len(text) else -1] = Node(len(text), member)
        if parent is None:
            root = inner
        else:
            parent[0].children[parent[1]] = inner
    stack, common = [(root, depth)], depth
    while stack:
        node, common = stack.pop()
        if not node.children:
            yield node.member, common
            continue
        ordered = [node.children[b] for b in sorted(node.children)]
        stack += [(child, node.depth) for child in reversed(ordered[1:])]
        stack.append((ordered[0], common))


def _twin(leaf: Node, text: bytes, member: int) -> None:
    """A leaf for a member with the same text, beside the others of that text."""
    old = Node(leaf.depth, leaf.member)
    old.children = leaf.children
    leaf.children = {-1: old, -2 - len(leaf.children) - member: Node(len(text), member)}


def suffix_order(texts: list[bytes], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of texts that share `start` bytes, and what each shares with the one before it (the first: nothing)."""
    order: list[int] = []
    common: list[int] = []
    todo = [(list(range(len(texts))), start, 0)]
    while todo:
        members, depth, before = todo.pop()
        if len(members) == 1:
            order.append(members[0])
            common.append(before)
        elif depth >= start + SHALLOW:
            for k, (member, lcp) in enumerate(blind_trie(texts, members, depth)):
                order.append(member)
                common.append(lcp if k else before)
        else:  # multikey quicksort: three ways by the byte at this depth
            byte = {m: texts[m][depth] if depth < len(texts[m]) else -1 for m in members}
            pivot = byte[members[len(members) // 2]]
            less, same, more = ([m for m in members if (byte[m] > pivot) - (byte[m] < pivot) == way] for way in (-1, 0, 1))
            parts = [(less, depth), (same, depth + 1) if pivot >= 0 else (same, None), (more, depth)]
            first = True
            out = []
            for part, at in parts:
                if part:
                    out.append((part, at, before if first else depth))
                    first = False
            for part, at, lcp in reversed(out):
                if at is None:  # all end here: equal texts
                    todo += [([m], depth, depth) for m in part[1:]] + [([part[0]], depth, lcp)]
                else:
                    todo.append((part, at, lcp))
    return np.array(order), np.array(common)


def repeated_windows(both: tuple, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each member of a group, the ranges (d1, d2) of distances of its strings of that length that another member has too.
    both: the orders; size: bytes from the anchor on."""
    (by_right, lcp_right), (by_left, lcp_left) = both
    m = len(lo)
    found: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    hi = np.maximum(hi, length - size)  # a string ends within its text
    depths = np.unique(np.concatenate([hi, lo + 1, lcp_left[1:] + 1, length - lcp_right[1:]]))
    depths = depths[(depths >= hi.min()) & (depths <= lo.max())]
    rank_r, rank_l = np.empty(m, np.int64), np.empty(m, np.int64)
    for d, after in zip(depths.tolist(), [*depths[1:].tolist(), int(lo.max()) + 1]):
        valid = np.flatnonzero((hi <= d) & (d <= lo))
        if len(valid) < 2:
            continue
        rank_r[by_right] = np.cumsum(lcp_right < length - d)
        rank_l[by_left] = np.cumsum(lcp_left < d)
        pair = rank_r[valid] * (m + 1) + rank_l[valid]
        _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        for x in valid[counts[inverse] > 1].tolist():
            if found[x] and found[x][-1][1] == d - 1:
                found[x][-1] = (found[x][-1][0], after - 1)
            else:
                found[x].append((d, after - 1))
    return found


MEMBERS = "gram long, members long, id long, tie long, p int, lo short, hi short, copies long, body binary"
SPANS = "id long, tie long, length short, a int, b int"
PA_SPANS = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("length", pa.int16()), ("a", pa.int32()), ("b", pa.int32())])


def bodies(rows: DataFrame) -> DataFrame:
    """The bytes of the runs of the members listed in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(2))
            members = batch.column(3)
            flat = members.flatten()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(members).to_numpy())
            p, lo, hi = (flat.field(k).to_numpy().astype(np.int64) for k in ("p", "lo", "hi"))
            a, b = starts[row] + p - lo, np.minimum(starts[row] + p - hi + LENGTH, starts[row + 1])
            for k in range(0, len(p), 8192):
                part, own = flat.slice(k, 8192), pa.array(row[k : k + 8192])
                body = [data[x:y].tobytes() for x, y in zip(a[k : k + 8192], b[k : k + 8192])]
                yield pa.RecordBatch.from_arrays([part.field("gram"), part.field("size"), batch.column(0).take(own), batch.column(1).take(own), part.field("p"), part.field("lo"), part.field("hi"), part.field("copies"), pa.array(body, pa.binary())], names=[x.split()[0] for x in MEMBERS.split(", ")])

    return map_arrow(rows.select(*KEY, "text", "members"), run, MEMBERS)


def split(members: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Parts of at most `most` members, to be sorted, and the spans that the splitting itself settles.

    part, id, tie, p, lo, hi, copies, length (0: all lengths), x, y, left, right: left are the bytes before the anchor, but for the x
    next to it, right those from it on, but for the first length - y (none, where length is 0); a part's members agree in those left out."""
    byte, lo = lambda c, start, n: F.substring(F.col(c), start, n), F.col("lo")
    size = F.octet_length("body") - lo
    number = lambda n: F.lit(n).cast("int")
    columns = ["part", *KEY, "p", "lo", "hi", "copies", "length", "x", "y", "left", "right"]
    fitting = members.filter(F.col("members") <= most).select(F.hex("gram").alias("part"), *KEY, "p", "lo", "hi", "copies", number(0).alias("length"), number(0).alias("x"), number(SPAN - 1).alias("y"), byte("body", F.lit(1), lo).alias("left"), byte("body", lo + 1, size).alias("right"))
    large = members.filter(F.col("members") > most)
    settled = fitting.select(*KEY, F.col("length").cast("short"), "p", "p").toDF(*(x.split()[0] for x in SPANS.split(", "))).limit(0)
    if large.isEmpty():
        return fitting, settled
    n, end = F.col("length"), number(SPAN - 1)
    rows = large.withColumn("length", F.explode(F.array(*map(number, (LENGTH, SHORT))))).withColumn("hi", F.greatest(F.col("hi").cast("int"), n - size)).filter("hi <= lo")
    first = F.md5(F.concat(F.encode(n.cast("string"), "utf-8"), byte("body", lo + 1, n - end)))
    rows = rows.select(first.alias("part"), *KEY, "p", "lo", "hi", "copies", "length", number(0).alias("x"), end.alias("y"), byte("body", F.lit(1), lo).alias("left"), byte("body", lo + 1 + n - end, end).alias("right"))
    while True:
        met = stored(rows.join(rows.groupBy("part").agg(F.count("*").alias("members")).filter("members > 1"), "part"), "parts")
        fitting = fitting.unionByName(met.filter((F.col("members") <= most) & F.expr("x < y")).select(columns))
        settled = settled.unionByName(met.filter("x = y and copies = 1").select(*KEY, n.cast("short").alias("length"), (F.col("p") - F.col("x")).alias("a"), (F.col("p") - F.col("x") + n).alias("b")))
        large = met.filter((F.col("members") > most) & F.expr("x < y"))
        if large.isEmpty():
            return fitting, settled
        middle, x, y, u, v = F.expr("cast((x + y) div 2 as int)"), *map(F.col, ("x", "y", "h.u", "h.v"))
        halves = large.withColumn("h", F.explode(F.array(F.struct(x.alias("u"), middle.alias("v")), F.struct((middle + 1).alias("u"), y.alias("v"))))).filter("greatest(hi, h.u) <= least(lo, h.v)")
        far, length = F.least(lo, v), F.octet_length("left")
        more = F.md5(F.concat(F.encode(F.concat_ws(":", "part", u, v), "utf-8"), byte("left", length - (u - x) + 1, u - x), byte("right", F.lit(1), y - v)))
        rows = halves.select(more.alias("part"), *KEY, "p", "lo", "hi", "copies", "length", u.alias("x"), v.alias("y"), byte("left", length - (far - x) + 1, far - u).alias("left"), byte("right", y - v + 1, v - u).alias("right"))


def spans_of_parts(parts: DataFrame) -> DataFrame:
    """Repeated spans of members, part by part."""

    def settled(part: list[dict]) -> Iterator[tuple]:
        lo, hi = (np.array([x[k] for x in part]) for k in ("lo", "hi"))
        right, left = [x["right"] for x in part], [x["left"][::-1] for x in part]
        one, x, y = part[0]["length"], part[0]["x"], part[0]["y"]
        (by_right, lcp_right), (by_left, lcp_left) = suffix_order(right, 0 if one else min(GRAM, *map(len, right))), suffix_order(left, 0)
        both = (by_right, lcp_right + (one - y if one else 0)), (by_left, lcp_left + x)
        for length in (one,) if one else (LENGTH, SHORT):
            size = np.full(len(part), one) if one else np.array(list(map(len, right)))
            found = repeated_windows(both, size, np.minimum(lo, y), np.maximum(hi, x), length)
            for member, ranges in zip(part, found):
                if member["copies"] == 1:
                    yield from ((member["id"], member["tie"], length, member["p"] - d2, member["p"] - d1 + length) for d1, d2 in ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[dict] = []
        for batch in batches:
            out: list[tuple] = []
            for x in batch.to_pylist():
                if part and part[0]["part"] != x["part"]:
                    out += settled(part)
                    part = []
                part.append(x)
            if out:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out), PA_SPANS.types)), schema=PA_SPANS)
        if part and (out := list(settled(part))):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out), PA_SPANS.types)), schema=PA_SPANS)

    return map_arrow(parts.repartition("part").sortWithinPartitions("part"), run, SPANS)


def repeated_spans(rows: DataFrame, group: int = 0) -> DataFrame:
    """id, tie, length, a, b: byte ranges whose union is all that repeated strings of that length cover. rows: id, tie, text.

    Keys that stand in very many places are never one task's: what is joined has a row for each key, made by partial sums, and
    a large side is dealt anew by the planner."""
    found = stored(anchor_rows(rows), "anchors")
    often = stored(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "repeated-grams")
    again = stored(found.join(often, "gram"), "repeated-anchors")
    runs = stored(again.groupBy("gram", "run").agg(F.count("*").alias("copies"), F.max(F.struct(*KEY, "p", "lo", "hi", "size")).alias("rep")), "runs")
    first, last = F.col("p") - F.col("lo"), F.col("p") - F.col("hi")
    equal = again.join(runs.filter("copies > 1").select("gram", "run"), ["gram", "run"])
    whole = equal.select(*KEY, F.explode(F.array(*(F.struct(F.lit(n).cast("short").alias("length"), first.cast("int").alias("a"), F.least(last + n, "size").cast("int").alias("b")) for n in (LENGTH, SHORT)))).alias("s")).select(*KEY, "s.*").filter("b - a >= length")
    sizes = runs.groupBy("gram").agg(F.count("*").alias("size"), F.min("copies").alias("least")).filter("size > 1 and least = 1").select("gram", "size")
    reps = runs.join(sizes, "gram").select("rep.id", "rep.tie", "rep.p", "rep.lo", "rep.hi", "gram", sizes["size"], "copies")
    listed = reps.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "size", "p", "lo", "hi", "copies")).alias("members"))
    members = stored(bodies(rows.join(listed, KEY)), "members")
    parts, settled = split(members, group or GROUP)
    return whole.unionByName(settled).unionByName(spans_of_parts(parts))


def merged(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of sorted spans."""
    if not spans.is_valid or not len(spans.values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (spans.values.field(k).to_numpy().astype(np.int64) for k in ("a", "b"))
    ends = np.maximum.accumulate(b)
    first = np.concatenate([[True], a[1:] > ends[:-1]])
    return a[first], ends[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(ends) - 1]])]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = 0) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, n_repeated and kept (binary) of every row. n_repeated: bytes that repeated strings of
    SHORT bytes cover, removed or not.

    Texts are UTF-8 bytes, null ones empty; texts of fewer than LENGTH bytes lose nothing; strings never cross rows. Repeated
    rows are documents of their own, and so lose what is long enough. Null ids are kept. An empty table gives an empty one.
    Other columns are left out, whatever their names."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    of = lambda n: F.sort_array(F.collect_set(F.when(F.col("length") == n, F.struct("a", "b"))))
    spans = repeated_spans(rows, group).groupBy(*KEY).agg(of(LENGTH).alias("spans"), of(SHORT).alias("short"))
    out = T.StructType([T.StructField(id_col, T.LongType()), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans", "n_repeated")), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            sizes, gone, runs, again, kept = np.diff(starts), [], [], [], []
            for i, (cut, short) in enumerate(zip(batch.column(2), batch.column(3))):
                body = data[starts[i] : starts[i + 1]]
                a, b = merged(short)
                again.append(int((b - a).sum()))
                a, b = merged(cut)
                if not len(a):
                    gone.append(0), runs.append(0), kept.append(body.tobytes())
                    continue
                keep = np.zeros(len(body) + 1, np.int64)
                keep[a] += 1
                keep[b] -= 1
                keep = np.cumsum(keep)[:-1] == 0
                gone.append(int((b - a).sum())), runs.append(len(a)), kept.append(body[keep].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(again, pa.int64()), pa.array(kept, pa.binary())], names=out.names)

    return map_arrow(rows.join(spans, KEY, "left").select("own", "text", "spans", "short"), run, out)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", F.sha2("kept", 256).alias("kept_sha256"))
