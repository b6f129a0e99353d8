import math
from collections import Counter
from urllib.parse import urlsplit

from orderloom.llm import urls as U

URLS = [
    "http://a.example.com/en/8", "https://Example.COM/en/71?x=1&y=2", "http://b.net/de/1", "http://example.net/de/80#t", "http://x.example.net/de/9", "https://q.org/es/", "https://q.org/es",
    "http://notcom/en/1", "com/en/1", None, "", "http://com/en/", "http://h.com?x=/en/", "http://h.com/EN/1", "x://y://z.com/en/1", "http://q.org/en/12\n3", "http://[::1]/p", "https://a-b.c1.org/p/q.html?m",
]


def brute(url):
    rest = (url or "").partition("://")[2]
    k = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
    tail = rest[k:]
    path = tail[: min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])]
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[1:]) if fit else (host, path, None, None)


def test_rules(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(3, URLS[3], "x", "y"), (None, URLS[0], "x", "y")]
    out = U.judged(spark.createDataFrame(rows, "page_id long, url string, host string, score string"))
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id if r.page_id is not None else 0])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in (verdict,) * bool(verdict) + ("block", "allow") * (not verdict)
    assert U.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_entropy(spark):
    for t in ("abca", "aaaa", ""):
        want = -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) if t else 0.0
        assert abs(spark.range(1).select(U.entropy(U.F.lit(t)).alias("x")).first().x - want) < 1e-12


def test_held_out_accuracy(spark):
    """Trees learned from rules on half the hosts tell bad from good ones on the other half."""
    rows = [(i, f"http://{'cheap-deals-' if i % 3 == 0 else 'w'}{i}.{'com' if i % 3 == 0 else 'net'}/{'en/' + 'x' * 40 + str(i * 7919) if i % 3 == 0 else 'de/' + 'abc'[i % 2]}") for i in range(400)]
    rows += [(1000 + i, f"http://{'cheap-offers-' if i % 2 else 'v'}{i}.org/{'aa/' + 'y' * 38 + str(i * 104729) if i % 2 else 'q'}") for i in range(100)]
    got = {r.page_id: r for r in U.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    right = sum((got[1000 + i].verdict == "block") == bool(i % 2) for i in range(100))
    assert right >= 90 and all(got[i].verdict == ("block" if i % 3 == 0 else "allow") for i in range(400))


def test_suffixes_are_counted_over_all_rows_and_fitted_rows_are_distinct(spark, monkeypatch):
    """40 copies of each of 4 URLs and 60 single ones, two of every three blocked, with room for 3 rows of a verdict."""
    urls = [f"http://h{i}.com/p{i}" for i in range(4) for _ in range(40)] + [f"http://w.s{i}.org/q" for i in range(60)]
    rows = [(u, u.split("/")[2], "/" + u.split("/")[3], "allow" if k % 3 == 0 else "block") for k, u in enumerate(sorted(set(urls)))]
    verdict = {u: v for u, _, _, v in rows}
    rows = [next(r for r in rows if r[0] == u) for u in urls]
    fitted = []
    monkeypatch.setattr(U, "assemble", lambda df, own=U.assemble: (fitted.append(df), own(df))[1])
    _, suffixes, rate = U.train(spark.createDataFrame(rows, "url string, host string, path string, verdict string"), max_rows=3)
    blocked = [verdict[u] == "block" for u in urls]
    assert abs(rate - sum(blocked) / len(urls)) < 1e-12
    got = {r.suffix: (r.seen, r.blocked) for r in suffixes.collect()}
    want = Counter(".".join(u.split("/")[2].split(".")[-2:]) for u in urls)
    assert {k: n for k, (n, _) in got.items()} == want
    hits = Counter(".".join(u.split("/")[2].split(".")[-2:]) for u, b in zip(urls, blocked) if b)
    assert {k: b for k, (_, b) in got.items()} == {k: hits[k] for k in want}
    asked = spark.createDataFrame([(k,) for k in [*want, "new.suffix"]], "suffix string")
    rates = {r.k: (r.f_suffix_rate, r.f_suffix_count) for r in U.with_suffixes(asked.selectExpr("*", "suffix AS k"), suffixes, rate).collect()}
    assert all(abs(r - (hits[k] + 10 * rate) / (want[k] + 10)) < 1e-12 and abs(n - math.log1p(want[k])) < 1e-12 for k, (r, n) in rates.items()) and len(rates) == len(want) + 1
    for r in fitted[0].collect():  # no row sees its own label: all its copies are taken off
        k = ".".join(r.host.split(".")[-2:])
        left, bad = want[k] - urls.count(r.url), hits[k] - urls.count(r.url) * r.label
        assert abs(r.f_suffix_rate - (bad + 10 * rate) / (left + 10)) < 1e-12 and abs(r.f_suffix_count - math.log1p(left)) < 1e-12
    sample = [(r.url, r.label) for r in fitted[0].collect()]
    assert len(sample) == len(set(sample)) == 6 and Counter(x for _, x in sample) == {0.0: 3, 1.0: 3}
