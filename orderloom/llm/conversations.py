"""Conversation structure repair on an automaton of shared suffixes.

A row's part in the repair is one symbol: its role's initial (s, u, a or another) and its fault (none, truncated, or one that must
go). A conversation is a string of symbols, and what is cheapest from a row on depends on the symbols from there and on where the
grammar `(s?(ua)+)?` stands. So equal endings share their work: the distinct strings of all conversations are sorted by their
reverse, and each task builds the automaton from the end, one node for each distinct ending, keeping the path of the string at hand.
Cost-to-go and the first edit of the best suffix are found once for each node and grammar state. In each state only one role may
come next, so an edit's initial fixes where it leads, and ties are settled by initials alone.

Rows are shuffled twice without their texts, to find repeats and to write the strings, and once with them, for the repaired text.
Conversations pass through tasks as sorted streams: what is held of one is its string, one byte a row, and the state of a hash.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.llm.common import map_arrow, stored, table

BLANK = r"^[\x20\x09-\x0D]*\z"
UNENDED = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after s, after u, after a. What role may come next but for a first s, and where it leads.
NEXT, LEADS, ENDS = "uuau", (2, 2, 3, 2), (0, 3)
FAR = 1 << 60
#: Rows of a conversation by turn, nulls first; those of one turn by their role and text, a repeated row beside its copy.
ORDER = ["gone", "turn", "digest", "copy"]
STATS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def damaged(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. The damaged ones, with copy (0, or 1 for the row repeated) and gone (rows dropped, which stay
    as marks of their conversation). Null roles and texts become one space, in the key as well."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(lot == 1, F.lit("")).when(lot == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return rows.select(
        "conv_id", "turn", F.when(lot == 4, F.lit("user")).otherwise(spaced("role")).alias("role"), text.alias("text"), (lot == 0).alias("gone"),
        F.explode(F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """rows as they are, in the form of damaged()."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", spaced("role"), spaced("text"), F.lit(False).alias("gone"), F.lit(0).alias("copy"))


def digest() -> Column:
    return F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))


def symbols_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, gone, digest, copy, and of each row its fault (b, d, t or a point), initial (o: another) and symbol."""
    first = F.substring("role", 1, 1)
    narrow = rows.select(
        "conv_id", "turn", "gone", digest().alias("digest"), "copy",
        F.when(F.col("text").rlike(BLANK), "b").when(F.col("text").rlike(UNENDED), "t").otherwise(".").alias("fault"),
        F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"),
    )
    earlier = F.row_number().over(W.partitionBy("conv_id", "gone", "digest").orderBy("turn", "copy")) > 1
    fault = F.when((F.col("fault") != "b") & earlier, "d").otherwise(F.col("fault"))
    symbol = F.when(fault.isin("b", "d"), "x").when(fault == "t", F.upper("initial")).otherwise(F.col("initial"))
    return narrow.withColumns({"fault": fault, "symbol": symbol})


def streams(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with equal keys one after another, in the order, within one partition; sorted by spilling."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


def starts_of(ids: pa.Array) -> np.ndarray:
    """Where runs of equal ids begin; nulls are equal."""
    values, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (null[1:] != null[:-1])])) if len(ids) else np.zeros(0, int)


def signatures(symbols: DataFrame) -> DataFrame:
    """conv_id, signature and counts of every conversation, one pass over its rows in order."""

    def counts(got: dict) -> dict:
        gaps = got["last"] - got["first"] + 1 - got["turns"] if got["turns"] else 0
        return {"conv_id": got["id"], "signature": b"".join(got["text"]).decode(), "gaps": gaps, "blank": got["b"], "duplicate": got["d"], "truncated": got["t"], "illegal": got["illegal"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        legal = {b"su", b"ua", b"au"}
        for batch in batches:
            ids, gone = batch.column("conv_id"), batch.column("gone").to_numpy(zero_copy_only=False)
            one = lambda c: np.frombuffer("".join(batch.column(c).to_pylist()).encode(), np.uint8)  # noqa: E731, B023
            fault, initial, symbol = one("fault"), one("initial"), one("symbol")
            turns, no_turn = batch.column("turn").fill_null(0).to_numpy(zero_copy_only=False), batch.column("turn").is_null().to_numpy(zero_copy_only=False)
            starts = starts_of(ids)
            for a, b in zip(starts, np.append(starts[1:], len(ids))):
                who = ids[int(a)].as_py()
                if now is None or now["id"] != who:
                    if now is not None:
                        done.append(counts(now))
                    now = {"id": who, "text": [], "first": None, "last": None, "turns": 0, "b": 0, "d": 0, "t": 0, "illegal": 0, "initial": b""}
                here = ~gone[a:b]
                if not here.any():
                    continue
                f, i = fault[a:b][here], now["initial"] + initial[a:b][here].tobytes()
                now["text"].append(symbol[a:b][here].tobytes())
                for kind in "bdt":
                    now[kind] += int((f == ord(kind)).sum())
                now["illegal"] += sum(i[k : k + 2] not in legal for k in range(len(i) - 1))
                now["initial"] = i[-1:]
                t = turns[a:b][here & ~no_turn[a:b]]
                if len(t):
                    now["turns"] += int((np.diff(t) != 0).sum()) + int(now["last"] is None or t[0] != now["last"])
                    now["first"] = int(t[0]) if now["first"] is None else now["first"]
                    now["last"] = int(t[-1])
            if done:
                yield pa.RecordBatch.from_pylist(done, kind_)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([counts(now)], kind_)

    kind_ = pa.schema([("conv_id", pa.int64()), ("signature", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))])
    rows = streams(symbols, "conv_id", *ORDER).select("conv_id", "turn", "gone", "fault", "initial", "symbol")
    return map_arrow(rows, run, f"conv_id long, signature string, {STATS}")


class Automaton:
    """Nodes by what lies after them: the costs of the four grammar states above the least of them, and the initial of the first edit
    of each state's best suffix. Endings with equal futures share a node; a step is worked out once for each node and symbol."""

    def __init__(self):
        self.nodes: list[tuple[tuple[int, ...], str]] = []
        self.known: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.end = self._node([0 if q in ENDS else FAR for q in range(4)], [""] * 4)[0]

    def _node(self, costs: list[int], first: list[str]) -> tuple[int, int]:
        """Node, and the least cost taken off, once rows may be inserted before what these costs are for."""
        for state in (2, 3, 0, 1):  # inserts from u lead to a and back, from nothing and from s to u
            if (INSERT + costs[LEADS[state]], "I") < (costs[state], first[state]):
                costs[state], first[state] = INSERT + costs[LEADS[state]], "I"
        least = min(costs)
        key = tuple(c - least for c in costs), "".join(f or "." for f in first)
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
        return self.known[key], least

    def step(self, node: int, symbol: str) -> tuple[int, int]:
        """The node of an ending one symbol longer, and what its costs have above the other's."""
        if (node, symbol) not in self.steps:
            after, costs, first = self.nodes[node][0], [], []
            for state in range(4):
                choices = [(DELETE + after[state], "D")]
                if symbol != "x":
                    extra, keeps = TRUNCATED if symbol.isupper() else 0, kept(symbol, state)
                    choices += [(KEEP + extra + after[keeps], "K")] if keeps is not None else []
                    choices.append((REROLE + extra + after[LEADS[state]], "R"))
                cost, letter = min(choices)
                costs.append(cost)
                first.append(letter)
            self.steps[node, symbol] = self._node(costs, first)
        return self.steps[node, symbol]


def kept(symbol: str, state: int) -> int | None:
    """Where a row that is kept leads, if it may be kept."""
    role = symbol.lower()
    return 1 if role == "s" and state == 0 else LEADS[state] if role == NEXT[state] else None


def audits(strings: DataFrame) -> DataFrame:
    """strings: distinct signatures. signature, cost, audit. Along the path of the string at hand a task holds one node and one cost
    for each row; strings sorted by their reverse share the path of their common ending."""

    def read(back: str, path: array, nodes: list) -> str:
        """The best edits, from the whole string's node down to the end."""
        out, state, at = bytearray(), 0, len(back)
        while (letter := nodes[path[at]][1][state]) != ".":
            out += letter.encode()
            state = state if letter == "D" else kept(back[at - 1], state) if letter == "K" else LEADS[state]
            at -= letter != "I"
        return out.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, last = Automaton(), ""
        path, costs = array("q", [tree.end]), array("q", [0])
        for batch in batches:
            totals, texts = [], []
            for back in batch.column("back").to_pylist():
                shared = len(os.path.commonprefix([back, last]))
                del path[shared + 1 :], costs[shared + 1 :]
                for symbol in back[shared:]:
                    node, more = tree.step(path[-1], symbol)
                    path.append(node)
                    costs.append(costs[-1] + more)
                last = back
                totals.append(costs[-1] + tree.nodes[path[-1]][0][0])
                texts.append(read(back, path, tree.nodes))
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array(totals, pa.int64()), pa.array(texts, pa.string())], ["signature", "cost", "audit"])

    rows = strings.select("signature", F.reverse("signature").alias("back"))
    return map_arrow(rows.repartitionByRange("back").sortWithinPartitions("back"), run, "signature string, cost long, audit string")


def repaired(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """headers (conv_id, audit and more) with the hash of each conversation's repaired text. Every conversation's header comes
    before its rows in one sorted stream."""
    names = headers.columns
    empty = lambda df, *cols: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    body = rows.filter("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", digest().alias("digest"), "copy", "role", "text", *empty(headers, *(c for c in names if c != "conv_id")))
    head = headers.select("conv_id", F.lit(0).alias("kind"), *empty(body, "turn", "digest", "copy", "role", "text"), *(c for c in names if c != "conv_id"))
    both = streams(head.unionByName(body), "conv_id", "kind", "turn", "digest", "copy").select("kind", "role", "text", *names)
    schema = headers.select(*names).withColumn("repaired_sha256", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> None:
            nonlocal head
            if head is not None:
                write(None)
                heads.append(head)
                hashes.append(state.hexdigest())
            head = None

        def write(row: tuple[str, str] | None) -> None:
            """Takes edits up to the one that uses the row; with None, all that are left."""
            nonlocal grammar, at, first
            while at < len(audit):
                letter = audit[at]
                if letter != "I" and row is None:
                    return
                at += 1
                if letter != "D":
                    role, text = row if letter != "I" else ("", "")
                    if letter != "K":
                        role = "user" if NEXT[grammar] == "u" else "assistant"
                    grammar = 1 if letter == "K" and grammar == 0 and role[:1] == "s" else LEADS[grammar]
                    state.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    first = False
                if letter != "I":
                    return

        head, audit, at, grammar, first, state = None, "", 0, 0, True, hashlib.sha256()
        heads, hashes = [], []
        for batch in batches:
            kinds, roles, texts = (batch.column(c).to_pylist() for c in ("kind", "role", "text"))
            for i, kind in enumerate(kinds):
                if kind == 0:
                    close()
                    head = batch.slice(i, 1).select(names)
                    audit, at, grammar, first, state = head.column("audit")[0].as_py() or "", 0, 0, True, hashlib.sha256()
                else:
                    write((roles[i], texts[i]))
            if heads:
                whole = pa.Table.from_batches(heads).combine_chunks()
                yield from whole.append_column("repaired_sha256", pa.array(hashes)).to_batches()
                heads, hashes = [], []
        close()
        if heads:
            yield from pa.Table.from_batches(heads).combine_chunks().append_column("repaired_sha256", pa.array(hashes)).to_batches()

    return map_arrow(both, run, schema)


def repair(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    Rows go by turn, nulls first; rows of one turn by a hash of role and text, so repeated rows stand side by side and
    all but one are duplicates. Null roles and texts are one space, so such a text is blank and such a role none of the grammar's; an empty role
    is none of them either. Null ids are one conversation. Conversations without rows left have zeros, an empty audit and the hash
    of nothing. An empty table gives an empty one. Other columns are not read, whatever their names. damage: the fixed damage that
    damaged() states comes first."""
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = damaged(given) if damage else undamaged(given)
    found = stored(signatures(symbols_of(rows)), "signatures")
    costs = audits(found.select("signature").distinct()).withColumnRenamed("signature", "same")
    headers = found.join(costs, F.col("signature") == F.col("same")).drop("signature", "same")
    return repaired(rows, headers)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair(table(spark, sf_dir, "conversations"), damage=True)
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _oracle() -> str:
    edit = lambda more, letter, key: f"printf('%08d', {more} + CAST(substr({key}, 1, 8) AS INTEGER)) || '{letter}' || substr({key}, 9)"
    base = []
    for q in range(4):
        keep = "CASE " + ("WHEN i = 's' THEN " + edit("e", "K", "g.k1") + " " if q == 0 else "") + f"WHEN i = '{NEXT[q]}' THEN " + edit("e", "K", f"g.k{LEADS[q]}") + " END"
        base.append(f"least({edit('4', 'D', f'g.k{q}')}, CASE WHEN x THEN NULL ELSE {keep} END, CASE WHEN x THEN NULL ELSE {edit('3 + e', 'R', f'g.k{LEADS[q]}')} END) AS b{q}")
    insert = lambda key: edit("3", "I", key)
    return rf"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM generate_series(0, 255) s(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS tbl FROM bits WHERE k = 8
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), lots AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, tbl[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS lot
  FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, u.copy AS copy
  FROM lots, generate_series(0, CASE WHEN lot = 3 THEN 1 ELSE 0 END) u(copy) WHERE lot <> 0
), ordered AS (
  SELECT *, md5(CAST(length(role) AS VARCHAR) || ':' || role || ':' || text) AS digest FROM damaged
), faults AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, copy) AS n, substr(role, 1, 1) AS i,
         regexp_full_match(text, '[ 	-
]*') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-
]*$') AS unended
  FROM ordered
), r AS (
  SELECT *, blank OR again AS x, CASE WHEN NOT blank AND NOT again AND unended THEN 3 ELSE 0 END AS e, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM faults
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (e = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM r GROUP BY 1
), g AS (
  SELECT conv_id, n, '00000000' AS k0, '00000006II' AS k1, '00000003I' AS k2, '00000000' AS k3 FROM stats
  UNION ALL
  SELECT conv_id, n, least(b0, {insert(f"least(b2, {insert('b3')})")}), least(b1, {insert(f"least(b2, {insert('b3')})")}), least(b2, {insert('b3')}), least(b3, {insert('b2')})
  FROM (SELECT g.conv_id, g.n - 1 AS n, {", ".join(base)} FROM g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.n = g.n)
), best AS (
  SELECT conv_id, CAST(substr(k0, 1, 8) AS BIGINT) AS cost, substr(k0, 9) AS audit FROM g WHERE n = 0
), letters AS (
  SELECT conv_id, u.p AS p, substr(audit, u.p, 1) AS letter, length(replace(substr(audit, 1, u.p), 'I', '')) AS n, length(replace(substr(audit, 1, u.p), 'D', '')) AS j
  FROM best, generate_series(1, length(audit)) u(p)
), made AS (
  SELECT l.conv_id, l.p, letter, j, CASE WHEN letter = 'I' THEN '' ELSE r.text END AS text, r.role AS own,
         max(letter = 'K' AND j = 1 AND i = 's') OVER (PARTITION BY l.conv_id) AS s
  FROM letters l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.n = l.n WHERE letter <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN own WHEN (j + CAST(s AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS text FROM made GROUP BY 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(texts.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE = _oracle()
