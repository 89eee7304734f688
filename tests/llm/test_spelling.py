"""Spelling variants against comparing every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from sparsemill.llm import spelling
from sparsemill.llm.common import load

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs):
    n = Counter()
    for d, text in docs:
        for run in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{d}:{run}".encode()) if d is not None else 1
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if distance_one(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= 2 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    letters = "abÀÿé"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 6, 7]))) for _ in range(900)]
    chain = ["horse", "horses", "horsess", "horsesss", "horsessss", "horsesssss"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 60])))) for k in range(150)]
    rows += [(1000 + k, " ".join([w.upper()] * (3 * 2 ** (len(chain) - k)))) for k, w in enumerate(chain)]  # a form of a form of a form
    rows += [(2000, None), (2001, ""), (2002, "aaaaa" * 9), (2002, "aaaaa" * 9), (2002, "aaaaa" * 9), (None, "nullid nullid nullid nullix nullix nullix"), (2003, "x" * 30_000), (2004, "x" * 30_000), (2005, "x" * 30_000)]
    rows += [(3000 + k, "Straße STRASSE ÀÉÎõü×÷ naıve Ωmega abc" + "d" * 40 + " ab" + "c" * 100) for k in range(30)]
    return rows


def test_plain(spark, docs):
    got, want = found(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))), plain(docs)
    assert got == want


def test_roots_of_long_chains(spark):
    pairs = [(k, k + 1) for k in range(21)] + [(100, 5), (200, 201)]
    got = {r["id"]: r["last"] for r in spelling.last_of(spark.createDataFrame(pairs, "id long, to long")).collect()}
    assert got == {**{k: 21 for k in range(21)}, 100: 21, 200: 201}


def test_checksums_and_runs():
    texts = ["Été of LONG" + "g" * 70 + " x", "", "a1b2c İ café̀s"]
    for ids in ([7, 8, 9], [-1, 0, 10**18]):
        words, n = spelling.count_runs(ids, [t.encode() for t in texts], 1, every=1)
        want = Counter()
        for d, t in zip(ids, texts):
            for run in map(lower, RUN.findall(t)):
                h = zlib.crc32(f"{d}:{run}".encode()) % len(run)
                want[run[:h] + run[h + 1 :]] += 1
        want.pop("", None)
        got = Counter()
        for w, k in zip(words.to_pylist(), n.to_pylist()):
            got[w] += k
        assert got == want


def test_distinct_deletions_meet_once():
    k = spelling.word_keys(["aabb", "abb", "aab", "abab"])
    keys = list(zip(k["word"].tolist(), k["k1"].tolist(), k["k2"].tolist()))
    assert len(set(keys)) == len(keys) == 4 + 2 + 2 + 2 + 4
    of = lambda w: {x[1:] for x in keys if x[0] == w}
    assert len(of(0) & of(1)) == 1 and len(of(0) & of(2)) == 1 and len(of(1) & of(2)) == 1


def test_empty_and_clashes(spark, make, odd):
    assert spelling.variants(make([])).count() == 0
    clash = make(odd).selectExpr("*", "1 as word", "2 as n", "3 as id", "4 as form", "'x' as root", "5 as part")
    assert found(spelling.variants(clash)) == plain([(r[0], r[1]) for r in odd])


def test_query(spark):
    want = plain([tuple(r) for r in load(spark, SF, "documents").select("doc_id", "text").collect()])
    got = found(spelling.op13_spelling_variants(spark, SF))
    assert got == want and any(v[0] for v in want.values())
