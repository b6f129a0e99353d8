"""Small fixtures: the representative cases of the operators."""

import difflib
import random

from pyspark.sql import functions as F

from orderloom.functions import rules, scalars, text
from orderloom.operators import diff, merge, rollups, search, sequences
from orderloom.sources import sinks, tables
from orderloom.streaming import live


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_rare_shared_features_rank_first(spark):
    rows = [("t", "tag", "SHAFT SEAL"), ("t", "line", "SEAL"), ("t", "tag", "MOTOR"), ("a", "tag", "SHAFT SEAL"), ("a", "line", "SEAL"), ("b", "tag", "MOTOR"), ("c", "tag", "MOTOR"), ("d", "tag", "DRAIN")]
    f = spark.createDataFrame(rows, "job string, kind string, feature string")
    got = search.similar(f.filter("job <> 't'"), f.filter("job = 't'")).collect()
    assert [(r.job, r.score) for r in got] == [("a", 1.5), ("c", 0.5), ("b", 0.5)]
    only = spark.createDataFrame([("b",)], "job string")
    assert [r.job for r in search.similar(f.filter("job <> 't'"), f.filter("job = 't'"), only).collect()] == ["b"]


def test_leave_then_return(spark):
    schema = "job string, status string, first_seen string, last_seen string, present boolean, carried_over boolean"
    poll = lambda *jobs: spark.createDataFrame([(j, "s") for j in jobs], "job string, status string")
    state = spark.createDataFrame([], schema)
    seen = []
    for k, (jobs, base) in enumerate([(("a", "b"), True), (("b",), False), (("a", "b", "c"), False)]):
        after = merge.record_poll(state, poll(*jobs), "job", ["status"], F.lit(f"t{k}"), base)
        seen.append({r.job: r.delta for r in after.collect()})
        state = after.drop("delta")
    assert seen == [{"a": None, "b": None}, {"a": "removed", "b": None}, {"a": "returning", "b": None, "c": "new"}]
    assert {r.job: (r.first_seen, r.last_seen, r.carried_over) for r in state.collect()} == {"a": ("t0", "t2", True), "b": ("t0", "t2", True), "c": ("t2", "t2", False)}


def test_sparse_source_keeps_or_blanks(spark):
    cur = spark.createDataFrame([("a", "x", "y")], "k string, p string, q string")
    inc = spark.createDataFrame([("a", "", None, ["p"])], "k string, p string, q string, present_fields array<string>")
    assert merge.merge_sparse(cur, inc, "k", ["p", "q"]).first() == ("a", "", "y")
    assert merge.merge_filled(cur, inc, "k", ["p", "q"]).first() == ("a", "x", "y")


def test_persistence_bridges_missing_days(spark):
    rows = [("a", d) for d in (1, 2, 5)] + [("b", d) for d in (1, 5)] + [("c", d) for d in (1, 2)]
    got = diff.persistence(spark.createDataFrame(rows, "job string, day int"), "job", "day", 2)
    assert {r.job: r.days for r in got.collect()} == {"a": 3}


def test_repeated_transition(spark):
    rows = [(k, "j", *v) for k, v in enumerate(["AB", "AB", "BA", "AB"])]
    assert [r.seq for r in sequences.transitions(spark.createDataFrame(rows, "seq int, job string, old string, new string"), ["job"], "seq", ["old", "new"]).orderBy("seq").collect()] == [0, 2, 3]


def test_revisions_and_runs(spark):
    assert one(spark, sequences.revision_key(F.col("f")), f="run CO#2 co 11 rev B.pdf") == (11, 2)
    assert one(spark, sequences.revision_key(F.col("f")), f="plain rev 7") == (0, 7)


def test_lines_take_their_normal_form(spark):
    for raw, want in {
        "ITEM 2: Évasé w/Drain C 254.83 5.00 62.00": "EVASE WITH DRAIN",
        "(1) 316SS HSG $1,200.00 EA": "316 STAINLESS STEEL HOUSING",
        "SST304L brg. No Charge": "304L STAINLESS STEEL BEARING",
        "Size 1.5 x 2. NaN shaft-seal L STD": "SIZE 1.5 X 2 SHAFT SEAL",
        "Straße": "STRASSE",
    }.items():
        assert one(spark, text.normalize(F.col("r")), r=raw) == want, raw
    assert one(spark, text.split_price(F.col("r"))["price"], r="Motor C 254.83 5.00") == "254.83"
    assert tuple(one(spark, text.split_type(F.col("r")), r="Fan guard L INC.")) == ("Fan guard", "L", "INC")


def test_tags_and_rule_files(spark):
    assert one(spark, text.tags(F.col("r")), r="CERAMIC FELT SHAFT SEAL WITH ACTUATOR") == ["ACTUATOR", "SHAFT SEAL"]
    more = rules.merged(rules.TAGS, {"SHAFT SEAL": [r"\bpacking\b"], "NEW": ["zzz"]})
    assert one(spark, text.tags(F.col("r"), more), r="ZZZ PACKING") == ["NEW", "SHAFT SEAL"] and len(more) == len(rules.TAGS) + 1


def test_text_helpers(spark):
    assert one(spark, text.names_in(F.col("r"), {"Al": ["al"], "Bo": ["bo"]}), r="per AL-x, bob") == ["Al"]
    assert one(spark, text.label_value(F.array(F.lit("a: 1"), F.col("r")), "Size"), r=" Size : 22 in ") == "22 in"
    assert one(spark, text.missed_numbers(F.col("r"), F.array(F.lit("12 x"))), r="12 and 3.5") == ["3.5"]
    assert one(spark, text.coverage(F.col("r"), F.create_map(F.lit("temp"), F.lit("")), {"temp": "temperature", "rpm": "rpm"}), r="Temperature high") == ["temp"]
    assert one(spark, text.without_gloss(F.col("r"), F.lit("CUT")), r="CUT (cut parts) now") == "CUT now"


def test_scalars(spark):
    assert one(spark, scalars.folder_of(F.col("p")), p="a\\b/c\\d.txt") == "a\\b/c" and one(spark, scalars.folder_of(F.col("p")), p="a/b/d.txt") == "a/b"
    assert one(spark, scalars.sold_to(F.col("p")), p="ACME FANS LTD ACME FANS") == "ACME FANS LTD"
    assert one(spark, scalars.money(F.col("p")), p="$1,234.50") == 1234.5 and one(spark, scalars.money(F.col("p")), p="n/a") is None
    assert one(spark, scalars.design_number(F.col("p")), p=" 47-x") == 47
    assert one(spark, scalars.file_name([F.col("p"), F.lit("b")]), p="a:c") == "a_c_b"


def test_fuzzy_is_matching_blocks_not_edit_distance(spark):
    names = ["CERMIC FELT", "STEEL", "CERAMIC FELT RING", "", None]
    got = {r.n for r in search.fuzzy(spark.createDataFrame([(n,) for n in names], "n string"), "n", "ceramic felt").collect()}
    assert got == {"CERMIC FELT", "CERAMIC FELT RING"} and difflib.SequenceMatcher(None, "CERAMIC FELT", "CERMIC FELT").ratio() > 0.84


def test_fuzzy_loses_no_window(spark):
    """Texts made of the term's pieces, against every window's ratio; texts that cannot reach it stay out of Python."""
    r, term = random.Random(5), "CERAMIC FELT"
    piece = lambda: "".join(c for c in r.choice(["CERAMIC", "FELT", "STEEL", "RING", "CERMAIC", "FLET", "é"]) if r.random() < 0.93)
    texts = [r.choice([" ", "\u00a0", "\t ", "\u2003"]).join(piece() for _ in range(r.randint(0, 4))) for _ in range(600)] + ["CERAMIC FELT", "FELTCERAMIC", ""]

    def near(text):
        words = text.split()
        windows = [" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))]
        return any(w and difflib.SequenceMatcher(None, term, w).ratio() >= 0.84 for w in windows)

    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = {k for k, t in enumerate(texts) if near(t.upper())}
    may = {x.k for x in frame.filter(search.may_be_near(F.upper("t"), term, 0.84)).collect()}
    assert {x.k for x in search.fuzzy(frame, "t", term).collect()} == want and want <= may and 0 < len(want) < len(may) < len(texts) / 2


def test_greedy_pairing_is_symmetric(spark):
    r = random.Random(2)
    sets = [[(r.choice("AB"), "|".join(r.sample("xyz", r.randint(0, 3)))) for _ in range(r.randint(0, 4))] for _ in range(12)]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in sets for b in sets)]
    f = spark.createDataFrame(rows, "i int, a array<struct<name:string,value:string>>, b array<struct<name:string,value:string>>")
    got = {r.i: (r.x, r.y) for r in search.collection_likeness(search.collection_likeness(f, "a", "b", "x"), "b", "a", "y").collect()}
    assert all(x == y and 0 <= x <= 1 for x, y in got.values())


def test_matrix_columns_only_grow(spark):
    rows = spark.createDataFrame([("a", "Z"), ("a", "B"), ("b", "N")], "job string, f string")
    columns = rollups.append_only(["Z"], rows, "f")
    assert columns == ["Z", "B", "N"] and rollups.matrix(rows, "job", "f", columns).orderBy("job").collect()[0][1:] == ("✓", "✓", None)


def test_snapshots_shards_and_stores(spark, tmp_path):
    root = str(tmp_path / "days")
    a = spark.createDataFrame([(1, "x")], "job int, v string")
    sinks.write_snapshot(a, root, "2024-01-01")
    sinks.write_snapshot(a.withColumn("job", F.lit(2)), root, "2024-01-02")
    sinks.write_snapshot(a.withColumn("v", F.lit("late")), root, "2024-01-01", once=True)
    assert tables.snapshot(spark, root, "2024-01-01").first().v == "x"
    sinks.write_snapshot(a.withColumn("v", F.lit("new")), root, "2024-01-01")
    assert tables.snapshot(spark, root, "2024-01-01").first().v == "new" and spark.read.parquet(root).count() == 2
    assert str(tables.latest_day(spark.read.parquet(root), "2024-01-02").first()[0]) == "2024-01-01"
    manifest = sinks.write_shards(spark.range(0, 2500), "id", str(tmp_path / "shards"), 1000, 300).orderBy("low").collect()
    assert [(r.low, r.high, r.rows) for r in manifest] == [(0, 999, 1000), (1000, 1999, 1000), (2000, 2999, 500)]
    (tmp_path / "s.json").write_text('{"job": 1}\nnot json\n{"job": 2, "v": "x"}\n')
    assert tables.json_store(spark, str(tmp_path / "s.json"), "job int, v string").count() == 2
    (tmp_path / "f").mkdir()
    for n in ("421100-07.dwg", "421100-07.pdf", "421100-51.DWG", "notes.txt"):
        (tmp_path / "f" / n).write_text("x")
    got = tables.drawing_files(tables.listing(spark, str(tmp_path / "f"))).collect()
    assert {r.suffix: list(r.kinds) for r in got} == {"07": ["DWG", "PDF"], "51": ["DWG"]}


def test_stream_equals_replay(spark, tmp_path):
    r = random.Random(1)
    polls = [sorted(r.sample("abcdefgh", r.randint(1, 6))) for _ in range(5)]
    polls[2] = []
    schema = "job string, status string, poll string"
    folder, root = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k, jobs in enumerate(polls):
        (folder / f"{k}.json").write_text("".join(f'{{"job": "{j}", "status": "s{k}", "poll": "t{k}"}}\n' for j in jobs))
        live.watch(live.poll_stream(spark, str(folder), schema), root, "job", ["status"], "poll", schema).awaitTermination()
    got = {(r.job, r.delta, r.time) for r in spark.read.parquet(f"{root}/changes").collect()}
    want, ever, last = set(), set(polls[0]), set(polls[0])
    for k, jobs in list(enumerate(polls))[1:]:
        if jobs:
            want |= {(j, "returning" if j in ever else "new", f"t{k}") for j in set(jobs) - last} | {(j, "removed", f"t{k}") for j in last - set(jobs)}
            ever, last = ever | set(jobs), set(jobs)
    assert got == want
