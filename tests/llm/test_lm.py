import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsemill.llm import lm
from sparsemill.llm.common import doc_hash


def learn():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2


def words(text):
    return (text or "").encode().lower().split() + ["END"]


def test_base_and_normalised(spark, make, odd):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choice(vocab[: 3 + i % 27]) for _ in range(rng.randrange(40)))) for i in range(100)] + [r[:2] for r in odd]
    got = lm.score(make(rows).select("doc_id", "text"), learn()).collect()
    trained = Counter(t for i, x in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for t in words(x))
    n, v = sum(trained.values()), len(trained)
    for r in got:
        t = words(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(trained[x] > 0 for x in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((trained[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
        assert -12 * len(t) < r["score"] < 0
    assert len(got) == len(rows)


def test_probabilities_add_up(spark, make):
    """All one-word texts, with their end, and every unknown word together have probability 1 at most."""
    rows = [(i, "a b c a b") for i in range(40)] + [(100 + k, w) for k, w in enumerate("abc")] + [(200, ""), (201, "zzz")]
    one = {r["doc_id"]: 10 ** r["score"] for r in lm.score(make(rows).select("doc_id", "text"), F.col("doc_id") < 100).collect() if r["doc_id"] >= 100}
    assert 0 < sum(one.values()) <= 1 + 1e-9


def test_em_finds_the_mixture():
    """Weights learned from counts that a known mixture made come back."""
    span = lm._SPAN
    lv = lambda p: int(round(math.log2(p) * lm.LEVELS)) + lm.LOWEST * lm.LEVELS + 1
    pairs = [(0.5, 0.125), (0.0, 0.25), (0.25, 0.5), (0.0, 0.0625)]
    cells = np.array([(3 * span + (lv(a) if a else 0)) * span + lv(b) for a, b in pairs])
    w = lm.learn_weights(cells, np.array([700.0, 100, 150, 50]), 1000)
    assert np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0 and w[3, 0] > 0.5


def test_em_of_triples_finds_the_mixture():
    """A context whose triples explain three quarters of what follows; one never seen says nothing."""
    span = lm._SPAN
    lv = lambda p: int(round(math.log2(p) * lm.LEVELS)) + lm.LOWEST * lm.LEVELS + 1 if p else 0
    cells = np.array([(4 * span + lv(a)) * span + lv(b) for a, b in [(1.0, 2.0**-20), (0.0, 2.0**-10)]] + [lv(0.5)])
    w = lm.learn_triples(cells, np.array([750.0, 250, 10]))
    assert np.allclose(w[4], [0.75, 0.25], atol=1e-3) and w[0].tolist() == [0, 1]


def test_triples_tell_what_pairs_cannot(spark, make):
    """What follows m depends on the word before it: scored near certainty, where pairs give one half a chance."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"{a} m {a}x" for a in (rng.choice("ab") for _ in range(10)))) for i in range(300)]
    got = [r for r in lm.score(make(rows).select("doc_id", "text"), learn()).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert all(r["n_tokens"] == 31 for r in got)
    # ten free choices of a, and after each turn the text goes on in ten of eleven cases
    ideal = len(got) * (10 * math.log10(1 / 2) + 9 * math.log10(10 / 11) + math.log10(1 / 11))
    assert sum(r["score"] for r in got) == pytest.approx(ideal, rel=0.03)


def test_held_out_is_better_than_base(spark, make):
    rng = random.Random(2)
    rows = [(i, " ".join(f"{a} {a}x" for a in (rng.choice("abcdefghij") for _ in range(20)))) for i in range(300)]
    got = [r for r in lm.score(make(rows).select("doc_id", "text"), learn()).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in got) > 0.8 * sum(r["base_score"] for r in got)


def test_nothing_to_learn_and_empty(make):
    r = lm.score(make([(1, "a b")]), F.lit(False)).first()
    assert (r["n_known"], r["train_tokens"]) == (0, 0) and r["base_score"] == 0
    assert lm.score(make([]), F.lit(True)).count() == 0
    assert "lang" in lm.score(make([(1, "a")]), F.lit(True)).columns


def plain_scores(texts, learned, deleted, rounded):
    """Scores by dictionaries: ratios as they are, or rounded to the cells' levels."""
    said = [words(t) for t in texts]
    before = [["BEGIN", *t[:-1]] for t in said]
    longer = [list(zip(["BEGIN", *b[:-1]], b)) for b in before]

    def counted(of):
        c, two, three = Counter(), Counter(), Counter()
        for k in of:
            c.update(["BEGIN", *said[k]])
            two.update(zip(["BEGIN", *before[k]], ["BEGIN", *said[k]]))
            three.update(zip(longer[k], said[k]))
        return c, two, three

    every, kept = (counted([k for k in range(len(texts)) if learned[k] and not (without and deleted[k])]) for without in (False, True))
    total = lambda c: sum(n for w, n in c.items() if w != "BEGIN")
    v = sum(w != "BEGIN" for w in every[0])
    near = lambda r: 2.0 ** (max(-lm.LOWEST * lm.LEVELS, min(0, round(math.log2(r) * lm.LEVELS))) / lm.LEVELS) if rounded and r else r
    bucket = lambda n: min(lm.CONTEXTS - 1, n.bit_length())
    told = [k for k in range(len(texts)) if learned[k] and deleted[k]]

    def em(rows):
        parts = np.array(rows)
        w = np.full(parts.shape[1], 1 / parts.shape[1])
        for _ in range(lm.STEPS):
            share = parts * w
            w = np.maximum((share / share.sum(axis=1)[:, None]).sum(axis=0) / len(rows), 1e-7)
            w /= w.sum()
        return w

    def by_bucket(rows):
        """rows: (context count, parts)."""
        seen = [[parts for n, parts in rows if bucket(n) == b] for b in range(lm.CONTEXTS)]
        pooled = em(sum(seen, []))
        weights = [em(x) if x else pooled for x in seen]
        weights[0] = np.array([0, *(weights[0][1:] / weights[0][1:].sum())])
        return weights

    def pair_parts(counts, a, b):
        return counts[1][a, b] / max(1, counts[0][a]), counts[0][b] / total(counts[0]), 1 / (v + 1)

    def pair_p(counts, a, b):
        return weights[bucket(counts[0][a])] @ pair_parts(counts, a, b)

    def triple_part(counts, ua, b):
        return counts[2][ua, b] / max(1, counts[1][ua])

    rows = []
    for k in told:
        for a, b in zip(before[k], said[k]):
            two, one, none = pair_parts(kept, a, b)
            rows.append((kept[0][a], (near(two), near(one), none)))
    weights = by_bucket(rows)
    rows = [(kept[1][ua], (near(triple_part(kept, ua, b)), near(pair_p(kept, ua[1], b)))) for k in told for ua, b in zip(longer[k], said[k])]
    of_triples = by_bucket(rows)
    out = []
    for k, t in enumerate(said):
        p = [of_triples[bucket(every[1][ua])] @ [triple_part(every, ua, x), pair_p(every, ua[1], x)] for ua, x in zip(longer[k], t)]
        out.append(sum(map(math.log10, p)))
    return out


def test_score_against_dictionaries(spark, make):
    """The score is that of the cells to the last digits; that of EM with ratios as they are is within 3 %, and 0.01 a token over all."""
    rng = random.Random(8)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(x for _ in range(rng.randrange(1, 12)) for x in rng.choice([vocab[i % 7 : i % 7 + 3], [rng.choice(vocab)]]))) for i in range(300)] + [(400, None), (401, "unseen words only"), (3, rng.choice(vocab))]
    df = make(rows).select("doc_id", "text")
    flags = df.select("doc_id", "text", learn().alias("l"), (F.pmod(F.xxhash64(doc_hash("doc_id", "text"), F.lit("fold")), F.lit(lm.FOLD)) == 0).alias("d")).collect()
    got = {(r["doc_id"], r["text"]): r["score"] for r in lm.score(df, learn(), chunk_bytes=3000, bucket_bytes=9000).collect()}
    args = [r["text"] for r in flags], [r["l"] for r in flags], [r["d"] for r in flags]
    assert 10 < sum(a and b for a, b in zip(*args[1:])) < 100
    apart, tokens = 0.0, 0
    for r, near, exact in zip(flags, plain_scores(*args, True), plain_scores(*args, False)):
        assert got[r["doc_id"], r["text"]] == pytest.approx(near, rel=1e-9)
        assert got[r["doc_id"], r["text"]] == pytest.approx(exact, rel=0.03)
        apart, tokens = apart + abs(exact - near), tokens + len(words(r["text"]))
    assert apart < 0.01 * tokens


def test_counts_beyond_32_bits():
    """Four chunks that have a word 3 * 10^9 times each; one of them is deleted."""
    keys, rows = np.sort(np.array([5, 9, 1 << 60], dtype=np.uint64)), []
    counts = np.array([3_000_000_000, 1, 7], dtype=np.uint32)
    for chunk in (0, 3, 6, 1, 2):  # three to learn from, one deleted, one scored
        rows.append((0, lm.WORDS, chunk, lm._pack(keys, 8) + (b"" if chunk == 2 else counts.tobytes())))
    table = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), lm._ROWS)], schema=lm._ROWS)
    done = lm._add_up(table)
    stats = done.filter(pa.compute.equal(done["chunk"], -1))["data"][0].as_py().decode().split(",")
    assert [int(x) for x in stats] == [4 * 3_000_000_008, 3, 3 * 3_000_000_008]
    for chunk in (0, 1, 2):
        total, gone = lm._counts(done.filter(pa.compute.equal(done["chunk"], chunk)), lm.WORDS, 3, chunk == 1)
        assert total.tolist() == [12_000_000_000, 4, 28] and gone.tolist() == ([3_000_000_000, 1, 7] if chunk == 1 else [0, 0, 0])
