"""Likeness of whole orders against plain Python."""

import os
import re

import pytest
from test_catalog import SF

from orderloom.functions import rules
from orderloom.operators.search import CORE
from orderloom.plans import catalog, texts


def norm(v):
    t = re.sub("[^A-Z0-9.%+/-]+", " ", (v or "").strip().upper()).strip()
    return "" if t in ("N/A", "NA", "NONE", "UNKNOWN") else t


def values(v):
    return list(dict.fromkeys(x for x in map(norm, re.split(r"\s*(?:\||,)\s*", v or "")) if x))


def slot(c):
    n, keys = norm(c.name), [k.lower() for k in c.attrs]
    if not n or re.search(rules.IGNORED_COMPONENTS, n, re.I):
        return None
    return next((s for s, _, _, words, begins in rules.SLOTS if any(w in n for w in words) or any(k.startswith(b) for b in begins for k in keys)), "other-accessory")


def attributes(c):
    return {k: v for k, v in c.attrs.items() if k != "quantity" and not re.search(rules.IGNORED_ATTRIBUTES, k, re.I) and norm(v)}


def component(a, b):
    x, y = attributes(a), attributes(b)
    name = 1.0 if norm(a.name) == norm(b.name) else 0.5 if slot(a) and slot(a) == slot(b) else 0.0
    count = [max(1.0, float((re.findall(r"\d+(?:\.\d+)?", c.attrs.get("quantity", "")) or ["1"])[0])) for c in (a, b)]
    points, known, every = 0.0, 0, {*x, *y}
    for k in every:
        if k in x and k in y:
            p, q = values(x[k]), values(y[k])
            points += 2 * len({*p} & {*q}) / (len(p) + len(q))
            known += 1
        else:
            points += 0.5
    score = points / len(every) if every else 1.0 if name == 1 else 0.5
    return 0.3 * name + 0.2 * min(count) / max(count) + 0.5 * score, 0.5 + 0.5 * (known / len(every) if every else 1.0)


def key(c):
    return norm(c.name) + "|{" + ",".join(f'"{k}":"{v}"' for k, v in sorted(attributes(c).items())) + "}"


def collection(a, b):
    a, b = sorted((sorted(a, key=key), sorted(b, key=key)), key=lambda s: (len(s), "\n".join(map(key, s))))
    free, score, coverage = list(b), 0.0, 0.0
    for c in a:
        got = [component(c, o) for o in free]
        k = max(range(len(got)), key=lambda i: got[i][0])
        score, coverage = score + got[k][0], coverage + got[k][1]
        free.pop(k)
    return score / len(b), coverage / len(b)


def order(a, b):
    points = known = shared = 0
    for f, w in CORE.items():
        x, y = norm(a.specs.get(f)), norm(b.specs.get(f))
        p, q = norm(a.specs.get("Design")), norm(b.specs.get("Design"))
        if not x or not y or (f == "Size" and p and q and p != q and x != y):
            points += w / 2
        else:
            known += w
            points += w * (x == y)
            shared += x == y
    for s, _, w, _, _ in rules.SLOTS:
        x, y = ([c for c in o.components if slot(c) == s] for o in (a, b))
        seen = a.observed and b.observed
        got = ((1, 1) if seen else (0.5, 0)) if not x and not y else (0, 1 if seen else 0.5) if not x or not y else collection(x, y)
        points, known = points + w * got[0], known + w * got[1]
        shared += bool({norm(c.name) for c in x} & {norm(c.name) for c in y})
    points, known = min(1, points), min(1, known)
    return points * (0.5 + 0.5 * known), points, known, shared


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_whole_orders(spark):
    orders = {r.job: r.o for r in texts.whole_orders(spark, SF).collect()}
    got = catalog.queries()["order_likeness"](spark, SF).collect()
    assert len(got) == sum(j + 1 in orders for j in orders) > 1000
    for r in got:
        a, b = orders[r.job], orders[r.job + 1]
        want = order(a, b)
        assert r.shared == want[3] and all(abs(x - y) < 2e-6 for x, y in zip((r.score, r.raw, r.coverage), want)), (r, want)
        named = [c for c in b.components if a.components and norm(c.name) == norm(a.components[0].name)]
        if not named:
            assert r.focused is None
            continue
        options = [("PROMO" in values(c.attrs.get("material")), component(a.components[0], c)) for c in named]
        pins, (score, _) = max(options, key=lambda o: (10 * o[0] + o[1][0], o[1][1]))
        assert r.pins == pins and abs(r.focused - (0.25 * want[0] + 0.75 * (0.35 * score + 0.65 * pins))) < 2e-6


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pairs_read_orders_that_are_ready(spark):
    """The keys of components are not worked out again for each pair."""
    plan = catalog.queries()["order_likeness"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "components" in plan and "to_json" not in plan and "structstojson" not in plan
