"""Every stage of the pipeline against brute force on what its predecessor kept."""

import datetime as dt
import random

import corpus_pipeline as P
import tiktoken
from test_decontaminate import WORD, lower
from test_line_dedup import brute as runs_of_lines

from orderloom.llm.byte_bpe import default_path

R = random.Random(12)
WORDS = [f"w{i}" for i in range(900)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __text date, __found string, n_removed int"


def prose(n, width=12):
    words = [R.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, n, width)) + "."


def corpus():
    texts = {i: prose(60 + i % 70) if i % 3 else " ".join(R.choice(WORDS).upper() + "!!" for _ in range(40)) for i in range(300)}
    texts |= {400: texts[1], 401: texts[2], 402: texts[2] + " more", 403: texts[4].replace("\n", " "), 404: texts[4].replace("\n", " ") + " tail", 405: texts[4].replace("\n", " ") + " end of it"}
    items = [(k, prose(30).replace("\n", " ")) for k in range(5)] + [(9, None), (10, "")]
    texts |= {410: prose(20) + "\n" + items[0][1], 411: prose(900) + " " + items[1][1][: len(items[1][1]) // 2], 412: "", 413: None, 414: "x" * 5000}
    rows = [(i, t, "en", "s", len(t or ""), dt.date(2024, 1, 1), "x", 1) for i, t in texts.items()]
    return rows + [rows[1]], items


def similar_groups(rows):
    sets = {}
    for r in rows:
        w = lower(r.text).split()
        sets.setdefault(r.doc_id, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if least[b] < least[a] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a], changed = least[b], True
    return least


def contaminated(text, items):
    w, hit = WORD.findall(lower(text)), set()
    for _, t in items:
        v = WORD.findall(lower(t))
        n = min(13, len(v))
        known = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for p in range(len(w) - n + 1 if v else 0):
            if tuple(w[p : p + n]) in known:
                hit |= set(range(p, p + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = docs, {}
    for name, stage in P.STAGES:
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, kept = kept.collect(), spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, kept.collect())
        assert name == "byte_bpe" or kept.columns == docs.columns
    before, after = seen["quality"]
    ids = {r.doc_id for r in after}
    assert len({i for i in range(300) if i % 3} - ids) < 4 and len({i for i in range(300) if i % 3 == 0} & ids) < 4
    before, after = seen["line_dedup"]
    gone = runs_of_lines([(r.doc_id, r.text or "") for r in {r.doc_id: r for r in before}.values()])
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if gone[i] else t for i, t in {r.doc_id: r.text for r in before}.items()}
    wanted = [(r.doc_id, cut[r.doc_id], None if r.text is None else len(cut[r.doc_id])) for r in before if not gone[r.doc_id] or cut[r.doc_id].split()]
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_chars) for r in after))) == sorted(map(repr, wanted)) and len(after) < len(before)
    before, after = seen["near_dedup"]
    least = similar_groups(before)
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if least[r.doc_id] == r.doc_id) and len(after) < len(before)
    before, after = seen["decontamination"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not contaminated(r.text, items)) and 410 not in {r.doc_id for r in after} and 411 in {r.doc_id for r in after}
    before, after = seen["byte_bpe"]
    import public_tokenizers
    from tiktoken.load import load_tiktoken_bpe

    model = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(default_path()), special_tokens={})
    assert sorted((r.doc_id, r.n_tokens) for r in after) == sorted((r.doc_id, len(model.encode_ordinary(r.text or ""))) for r in before)
    assert {(r.doc_id, r.n_tokens) for r in P.run(spark, str(tmp_path)).collect()} == {(r.doc_id, r.n_tokens) for r in after}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
