import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from orderloom.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CASES = ["", "a", "don't 'tis ''t x's's  they'll\n\n we've \t'd 'r 'l", " ", "  \n x", "x  ", "é 　 漢字123 ½ ²", "'", "a'", "a'r", "'s't're", "\x1c\x85!", "x" * 5000, "ab " * 2000, "🙂🙂 <|endoftext|>", "́a​ b", "A'S 'S"]


def ids(texts):
    return [list(i) for i, _ in byte_bpe.encode_texts(texts, PATH)]


def test_same_as_library():
    assert ids(CASES) == [TRUE.encode_ordinary(t) for t in CASES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("'stmdrevl aZé1½ \n\t .,!漢🙂")), max_size=4))
def test_random_texts(texts):
    assert ids(texts) == [TRUE.encode_ordinary(t) for t in texts]


def test_classes_of_all_code_points():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join("a" + c + "1" + c + "." for c in chars[k : k + 4096]) for k in range(0, len(chars), 4096)]
    bad = sum(x != TRUE.encode_ordinary(t) for x, t in zip(ids(texts), texts))
    assert bad == 0


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(90, None, "y"), (None, "z z", None), (1, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH)).collect()
    want = []
    for i, t, _ in rows:
        x = TRUE.encode_ordinary(t or "")
        want.append((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    ends = byte_bpe.encode(docs, PATH).filter("doc_id = 2").first().slice_ends
    assert ends[-1] == len(CASES[2]) and list(ends) == sorted(ends)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), PATH), PATH).count() == 0
    bad = spark.createDataFrame([(1, [999999])], "doc_id long, token_ids array<int>")
    with pytest.raises(Exception):
        byte_bpe.decode(bad, PATH).collect()


def test_scan_is_a_fold():
    rng = np.random.default_rng(1)
    compose, _, symbol_ids = byte_bpe.monoid()
    f = symbol_ids[rng.integers(0, 14, 10_000)]
    acc, want = 0, []
    for x in f:
        acc = compose[acc, x]
        want.append(acc)
    assert (byte_bpe.scan(f) == want).all()
