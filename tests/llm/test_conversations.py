"""Repairs against a search over all edits, and the stated results for odd tables."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from orderloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def plain(rows):
    """(blank, duplicate, truncated), symbols, and the cheapest, then ASCII-least edits, found by a search over edits."""
    seen, faults = set(), []
    for role, text in rows:
        kind = "b" if not text.strip(WS) else "d" if (role, text) in seen else "" if text.rstrip(WS)[-1] in ".!?" else "t"
        seen.add((role, text))
        faults.append(kind)
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        roles = "".join(r[0][:1] for r in out) if out else ""
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return [faults.count(k) for k in "bdt"], cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        out = tuple(out)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", at, (*out, (role, ""))))
        if at < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, out))
            if faults[at] not in ("b", "d"):
                more, (role, text) = 3 * (faults[at] == "t"), rows[at]
                if role[:1] in tuple("sua"):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, (*out, (new, text))))


def ordered(rows):
    digest = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))


def found(spark, rows, **options):
    return {r.conv_id: r for r in C.repair(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_like_a_search_over_all_edits(spark):
    rng = random.Random(5)
    rows = []
    for c in range(150):
        for turn in range(rng.randint(1, 5)):
            text = rng.choice(["", " \n", "a.", "b", f"c{turn}.", "?", "d! \t", "e  "])
            rows.append((c, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "tool", ""]), text))
    got = found(spark, rows)
    for c in range(150):
        own = ordered([r for r in rows if r[0] == c])
        (blank, duplicate, truncated), cost, audit, text = plain([r[2:] for r in own])
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [(a[2][:1] or "-") + (b[2][:1] or "-") for a, b in zip(own, own[1:])]
        want = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, duplicate, truncated, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[c])[1:] == want, own


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)]
    got = sorted(C.damaged(spark.createDataFrame(rows, SCHEMA)).collect())
    want = []
    for c, t, role, text in rows:
        lot = zlib.crc32(f"{c}:{t}".encode()) % 20
        role, text = "user" if lot == 4 else role, "" if lot == 1 else "One Two" if lot == 2 else text
        want += [(c, t, role, text, lot == 0, k) for k in range(1 + (lot == 3))]
    assert [tuple(r) for r in got] == sorted(want)


def test_nulls_repeats_empties_and_extra_columns(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    rows = [(None, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 3, None, "So.")]
    got = found(spark, rows)
    assert tuple(got[None])[1:] == (0, 1, 0, 0, 0, 4, "D", nothing)
    assert (got[1].duplicate, got[1].illegal, got[1].cost, got[1].audit) == (1, 1, 4, "KDK")
    assert (got[2].cost, got[2].audit) == (4, "D")
    dropped = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    only = found(spark, [(*dropped, "user", "Hi.")], damage=True)[dropped[0]]
    assert tuple(only)[1:] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", 7, "x", "y")], SCHEMA + ", cost long, digest string, gone string")
    assert C.repair(wide).first().audit == "KI"


def test_long_conversation_and_long_text(spark):
    turns = [(9, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(20_000)]
    got = found(spark, [*turns, (8, 0, "user", "word " * 400_000 + "."), (8, 1, "assistant", "Well.")])
    assert (got[9].cost, got[9].audit) == (0, "K" * 20_000)
    assert got[9].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in turns).encode()).hexdigest()
    assert got[8].cost == 0


def test_a_step_is_worked_out_once():
    tree = C.Automaton()
    rng = random.Random(1)
    for _ in range(300):
        node = tree.end
        for _ in range(30):
            node, _ = tree.step(node, rng.choice("suaoSUAOx"))
    assert len(tree.nodes) < 150 and len(tree.steps) <= 9 * len(tree.nodes)


@pytest.mark.parametrize("symbols, cost, audit", [("", 0, ""), ("u", 3, "KI"), ("a", 3, "IK"), ("xx", 8, "DD"), ("ss", 6, "KIR"), ("sua", 0, "KKK")])
def test_small_cases(spark, symbols, cost, audit):
    row = C.audits(spark.createDataFrame([(symbols,)], "signature string")).first()
    assert (row.cost, row.audit) == (cost, audit)
