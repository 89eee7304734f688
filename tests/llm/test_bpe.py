import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as some

from sparsemill.llm import bpe

PARAMS = bpe.multilingual()
TOKENIZER = bpe.tokenizer(**PARAMS)
ENCODING = tiktoken.Encoding("own", pat_str=PARAMS["pattern"], mergeable_ranks=TOKENIZER.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=60, deadline=None)
@given(some.lists(some.one_of(some.text(max_size=60), some.text("ab \n", max_size=400), some.text("théaé'", max_size=300)), max_size=8))
def test_like_tiktoken(texts):
    packed = TOKENIZER.encode_batch(texts)
    assert [ids(p) for p in packed] == [ENCODING.encode_ordinary(t) for t in texts]
    assert TOKENIZER.decode_batch(packed) == [t.encode() for t in texts]


def test_long_pieces():
    rng = random.Random(3)
    texts = ["a" * n for n in (255, 256, 257, 3001)] + ["".join(rng.choice(s) for _ in range(2000)) for s in ("ab", "etaoin", "éàü", "$%^", "日本")]
    assert [ids(p) for p in TOKENIZER.encode_batch(texts)] == [ENCODING.encode_ordinary(t) for t in texts]


def test_only_short_pieces_are_remembered():
    texts = ["b" * 5000 + " some words " + "c" * 65, "some words " + "c" * 65, "b" * 5000]
    assert [ids(p) for p in TOKENIZER.encode_batch(texts)] == [ENCODING.encode_ordinary(t) for t in texts]
    assert [ids(p) for p in TOKENIZER.encode_batch(texts)] == [ENCODING.encode_ordinary(t) for t in texts]
    assert TOKENIZER.known and max(map(len, TOKENIZER.known)) <= bpe.SHORT


def test_table(spark, make, odd):
    got = bpe.digest(make(odd).select("doc_id", "text"), **PARAMS).collect()
    want = []
    for doc_id, text, *_ in odd:
        e = ENCODING.encode_ordinary(text or "")
        want.append((doc_id, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.digest(make([]).select("doc_id", "text"), **PARAMS).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, "hello there", 7, "kept")], "doc_id long, text string, IDS int, extra string")
    r = bpe.encode(df, **PARAMS).first()
    assert (r["n_tokens"], r["extra"], ids(r["ids"])) == (len(ENCODING.encode_ordinary("hello there")), "kept", ENCODING.encode_ordinary("hello there"))
    with pytest.raises(KeyError):
        TOKENIZER.decode_batch([np.array([10**6], "<u4").tobytes()])
