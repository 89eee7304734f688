"""Groups at a similarity of 0.8 against all pairs."""

import random

import numpy as np
import pytest

from sparsemill.llm import similar as sm
from sparsemill.llm import simhash


def similar_groups(texts):
    """The least index of each group that a similarity of 0.8, or simhash's 4 bits, connects, by all pairs."""
    fps = [simhash.fingerprint(t.encode()) for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common) or (fps[a] ^ fps[b]).bit_count() <= simhash.MOST:
                x, y = top[a], top[b]
                top = [min(x, y) if t in (x, y) else t for t in top]
    return top


def edited(rng, words, edits):
    """words with `edits` single words replaced, each too far from the others to share a shingle."""
    w = list(words)
    for k in range(edits):
        w[10 * k + 5] = f"new{rng.randrange(1 << 40)}"
    return w


def test_similarity_of_four_fifths_decides(spark):
    """Pairs on both sides of 0.8: 200 words and 4 to 5 replaced are 176 of 216 (0.81) and 171 of 221 (0.77) shingles."""
    rng = random.Random(5)
    texts = []
    for g in range(100):
        base = [f"w{rng.randrange(1 << 40)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(edited(rng, base, 4 + g % 2))]
    want = similar_groups(texts)
    assert all(want[k] == k - 1 for k in range(1, 200, 4)) and sum(want[k] == k for k in range(3, 200, 4)) >= 40
    docs = spark.createDataFrame([(k, 1000 + k, t) for k, t in enumerate(texts)], "_id long, _hash long, text string")
    assert sorted(r["_id"] for r in sm.first_of_groups(docs).collect()) == sorted(set(want))


def test_short_and_repeating_texts_take_part(spark):
    """Near copies of few distinct shingles: 5 to 27 words with one appended, and long texts of a repeated phrase."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(1 << 40)}"
    texts = []
    for n in [8, 9, 12, 16, 20, 24, 27] * 8:
        base = " ".join(word() for _ in range(n))
        texts += [base, f"{base} {word()}"]
    for _ in range(8):
        phrase = " ".join(word() for _ in range(15))
        texts += [" ".join([phrase] * 6), f"{' '.join([phrase] * 7)} {word()}"]
    texts += [f"{word()} same words here every time {word()}" for _ in range(60)] + ["one", "ONE", "two", "", " "]
    want = similar_groups(texts)
    assert all(want[k] == k - 1 for k in range(1, 128, 2)) and len(set(want)) == 64 + 60 + 3
    docs = spark.createDataFrame([(k, 1000 + k, t) for k, t in enumerate(texts)], "_id long, _hash long, text string")
    assert sorted(r["_id"] for r in sm.first_of_groups(docs).collect()) == sorted(set(want))


def family(rng, base, members, most):
    """base with up to `most` words replaced, over and over: similarities to one another on both sides of 0.8."""
    return [" ".join(f"e{rng.randrange(1 << 40)}" if rng.random() < most * k / members / len(base) else w for w in base) for k in range(members)]


def grouped(spark, texts, **kw):
    """The least index of what similar_in connects in one group of all texts."""
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    groups = spark.createDataFrame([(k, 0, len(sm.shingles(t.encode()))) for k, t in enumerate(texts)], "node long, root long, _n long")
    top = list(range(len(texts)))
    for r in sm.similar_in(groups, docs, **kw).collect():
        x, y = top[r["a"]], top[r["b"]]
        top = [min(x, y) if t in (x, y) else t for t in top]
    return top


def by_similarity(texts):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common) and top[a] != top[b]:
                x, y = top[a], top[b]
                top = [min(x, y) if t in (x, y) else t for t in top]
    return top


@pytest.mark.parametrize("set_bytes", [1 << 24, 20_000, 3_000])
def test_large_groups_are_decided_exactly(spark, set_bytes):
    """One group of alike texts, one of a chain, and unlike texts: in one task, after pivots, and by pairs of blocks."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(1 << 40)}" for _ in range(120)]
    texts = family(rng, base, 90, 6) + [" ".join(f"x{k}" for k in range(6 * i, 6 * i + 100)) for i in range(40)]
    texts += [" ".join(f"y{rng.randrange(1 << 40)}" for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    rng.shuffle(texts)
    want = by_similarity(texts)
    assert 60 < len(set(want)) < 140
    assert grouped(spark, texts, set_bytes=set_bytes) == want


def test_pivots_alone_finish_a_dense_group(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randrange(1 << 40)}" for _ in range(200)]
    texts = [" ".join(edited(rng, base, 1)) for _ in range(150)]
    monkeypatch.setattr(sm, "_decide", None)  # nothing is left to decide
    docs = spark.createDataFrame([(k, 0, sm.shingles(t.encode()).tobytes()) for k, t in enumerate(texts)], "node long, root long, set binary")
    links, rest = sm.reduced(docs, 0)
    assert rest.count() == 0 and {r["a"] for r in links.collect()} | {r["b"] for r in links.collect()} == set(range(150))


def test_forest_of_alike_sets():
    rng = random.Random(13)
    for _ in range(30):
        sets = [np.unique(np.array([rng.randrange(25) for _ in range(rng.randrange(1, 14))], dtype=np.uint64)) for _ in range(40)]
        top = list(range(40))
        for a in range(40):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if 9 * common >= 4 * (len(sets[a]) + len(sets[b])):
                    x, y = top[a], top[b]
                    top = [min(x, y) if t in (x, y) else t for t in top]
        links = sm.alike(sets)
        got = list(range(40))
        for a, b in links:
            x, y = got[a], got[b]
            got = [min(x, y) if t in (x, y) else t for t in got]
        assert got == top and len(links) == 40 - len(set(top))


def test_common_shingles_bring_texts_together(spark):
    """Texts that consist of what many texts have are found through common shingles, and decided like others."""
    rng = random.Random(14)
    lines = [" ".join(f"l{k}x{j}" for j in range(8)) for k in range(12)]
    texts = [" ".join(rng.sample(lines, rng.randrange(2, 12))) for _ in range(150)] + family(rng, lines[0].split() * 3, 30, 3)
    want = similar_groups(texts)
    docs = spark.createDataFrame([(k, 1000 + k, t) for k, t in enumerate(texts)], "_id long, _hash long, text string")
    assert len(sm.common_shingles(docs)) > 50
    assert sorted(r["_id"] for r in sm.first_of_groups(docs).collect()) == sorted(set(want))


def test_recall_between_080_and_085(spark):
    """No pair of that band is lost, and none below is linked (by all pairs)."""
    rng = random.Random(15)
    texts, band = [], 0
    for _ in range(120):
        base = [f"w{rng.randrange(1 << 40)}" for _ in range(rng.randrange(60, 200))]
        copy = [f"e{rng.randrange(1 << 40)}" if rng.random() < 0.022 else w for w in base]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, copy))
        band += 0.8 <= len(x & y) / len(x | y) < 0.85
        texts += [" ".join(base), " ".join(copy)]
    assert band >= 10
    docs = spark.createDataFrame([(k, 1000 + k, t) for k, t in enumerate(texts)], "_id long, _hash long, text string")
    assert sorted(r["_id"] for r in sm.first_of_groups(docs).collect()) == sorted(set(similar_groups(texts)))
