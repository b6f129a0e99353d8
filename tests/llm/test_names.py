"""Tables whose further columns have the names that operators use inside."""

import datetime as dt

import pytest

from orderloom.llm import byte_bpe, decontaminate, fingerprint, lattice_lm, line_dedup, minhash, quality, sanitise, suffix_dedup, urls

NAMES = "__text __n_words __starts __ends __items __found __score __id __tie __body __cuts __gone __removed __spans id tie own text_ body run gram size key word block place doc kind n comp hash words lines label rank shard verdict rule suffix extra range".split()
TEXT = "some words of a text that is long enough to be cut into windows and shingles\n" * 8


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXT + f" {i}" if i % 3 else TEXT, *([dt.date(2024, 1, 1)] * len(NAMES))) for i in range(9)] + [(None, None, *([None] * len(NAMES))), (20, "", *([None] * len(NAMES)))]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` date" for n in NAMES)])).repartition(3)


def same(got, wanted, names=None):
    names = names or sorted(wanted.columns)
    key = lambda f: sorted(map(repr, (tuple(r[n] for n in names) for r in f.collect())))
    assert key(got) == key(wanted)


def test_operators_that_give_columns_of_their_own(spark, docs):
    plain = docs.select("doc_id", "text")
    vocabulary = lattice_lm.Vocabulary([(b"a", True, 1.0), (b"some", True, 2.0)])
    for run in (lambda d: lattice_lm.scored(d, vocabulary), sanitise.sanitise, suffix_dedup.without_repeats, minhash.linked, fingerprint.edits, fingerprint.fingerprints, lambda d: byte_bpe.encode(d, byte_bpe.default_path())):
        same(run(docs), run(plain))


def test_operators_that_keep_columns(spark, docs):
    plain, labels = docs.select("doc_id", "text"), spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    for run in (lambda d: line_dedup.without_repeats(d), line_dedup.deduplicated, lambda d: decontaminate.overlap(d, bench), lambda d: decontaminate.clean(d, bench), lambda d: quality.good(d, labels, d), minhash.one_of_each):
        got, wanted = run(docs), run(plain)
        assert [c for c in got.columns if c in docs.columns] == docs.columns
        same(got, wanted, sorted(wanted.columns))
        assert {r["__id"] for r in got.collect()} <= {None, dt.date(2024, 1, 1)}


def test_urls(spark):
    rows = [(i, f"https://example.{'com' if i % 2 else 'net'}/{'en' if i % 4 else 'de'}/{i}") for i in range(40)] + [(None, None)]
    plain = spark.createDataFrame(rows, "page_id long, url string")
    same(urls.judged(plain.selectExpr("*", *(f"CAST(NULL AS date) AS `{n}`" for n in [*NAMES, "host", "path", "given", "score", "features", "f_depth"]))), urls.judged(plain))


def test_very_long_texts(spark):
    """Two texts of two million characters, equal but for their ends: every operator takes them whole."""
    long = "lorem ipsum dolor sit amet consectetur " * 50_000
    docs = spark.createDataFrame([(1, long + "one"), (2, long + "two")], "doc_id long, text string")
    gone = suffix_dedup.without_repeats(docs).collect()
    assert all(r.n_bytes == len(long) + 3 and r.n_removed == len(long) for r in gone)
    assert {r.component_id for r in minhash.linked(docs).collect()} == {1}
    assert line_dedup.deduplicated(docs).count() == 2
    bench = spark.createDataFrame([(1, "amet consectetur one")], "item_id long, text string")
    assert {r.doc_id: r.contamination.n_hit for r in decontaminate.overlap(docs, bench).collect()} == {1: 3, 2: 0}
    assert {r.doc_id for r in sanitise.sanitise(docs).collect()} == {1, 2}
    assert fingerprint.fingerprints(docs).count() == 2
