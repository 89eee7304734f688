import random

import numpy as np
import xxhash

from sparsemill.llm import simhash as sh


def plain_fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), seed=42) for k in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps, ids, most=4):
    f, top = np.array(fps, dtype=np.uint64), list(range(len(fps)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(f)):
        for b in np.flatnonzero(np.bitwise_count(f[a + 1 :] ^ f[a]) <= most).tolist():
            x, y = root(a), root(a + 1 + b)
            top[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(f)):
        groups.setdefault(root(k), []).append(ids[k])
    return [min((i for i in groups[root(k)] if i is not None), default=None) for k in range(len(f))]


def test_golay_keys_meet():
    """Every pair at distance 4 or less shares a compound key."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    y = x.copy()
    for k in range(len(x)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    keys = [set(zip(*map(np.ndarray.tolist, sh.compound_keys(v)))) for v in (x, y)]
    assert {o for _, o in keys[0] & keys[1]} == set(range(len(x)))
    assert len(sh.compound_keys(x)[0]) == len(keys[0])


def test_code():
    g = sh.Golay()
    assert sorted(set(g.number.tolist())) == [1, 6]
    keys, n = g.keys(np.arange(1 << 11, dtype=np.int64))
    assert keys.max() < 4096 and (n[0], keys[0, 0]) == (1, 0)


def test_table(spark, make, odd):
    rng = random.Random(4)
    base = [rng.choice(["to", "be", "or", "not", "that", "is", "the", "question"]) + str(rng.randrange(50)) for _ in range(300)]
    rows = list(odd)
    for k in range(60):
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(300)] = "edit"
        rows.append((100 + k, " ".join(w)))
    got = sh.near_duplicates(make(rows)).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    comp = plain_components(fps, [r[0] for r in rows])
    assert sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == sorted(repr((r[0], "%016x" % f, c)) for r, f, c in zip(rows, fps, comp))
    assert "text" not in got[0].asDict() and "lang" in got[0].asDict()
    assert sh.near_duplicates(make([])).count() == 0


def test_chain_of_links(spark):
    """A long chain comes out as one component, whatever the order."""
    edges = [(k, k + 1) for k in range(70)] + [(200, 201), (201, 202), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in sh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, 0) == 0 for k in range(71)) and got[201] == got[202] == 200


def test_dense_group_needs_few_links():
    rng = np.random.default_rng(2)
    center = np.uint64(rng.integers(0, 1 << 62))
    near = np.unique(np.array([center ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(60) for b in range(60)], dtype=np.uint64))
    links = sh.group_links(near)
    assert len(links) == len(near) - 1
