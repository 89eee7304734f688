import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparsemill.llm import sharding
from sparsemill.llm.common import load


def check(rows, got, shards):
    assert len(got) == len(rows)
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(repr((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t, *_ in rows)
    slots = {}
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = {s: 0 for s in range(shards)}
    for r in got:
        total[r["shard"]] += r["size"]
    return total


@pytest.mark.parametrize("shards", [1, 2, 5, 24])
def test_near_equal(make, shards):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(1, 200) + str(i), rng.choice(["en", "de"]), rng.choice(["a", "b", None])) for i in range(2000)]
    total = check(rows, sharding.shard(make(rows), shards=shards).collect(), shards)
    mean = sum(total.values()) / shards
    assert max(abs(t - mean) for t in total.values()) < 0.12 * mean


def test_hot_group_is_split_and_small_groups_are_not(make):
    rng = random.Random(2)
    rows = [(i, "the same text again", "en", "a") for i in range(1000)] + [(1000 + i, f"pair {i // 2} " + "y" * (i // 2 % 40), "en", rng.choice("ab")) for i in range(2000)]
    got = sharding.shard(make(rows), shards=8).collect()
    total = check(rows, got, 8)
    assert max(total.values()) < 1.1 * sum(total.values()) / 8
    places = {}
    for r in got:
        places.setdefault(r["text_crc32"], set()).add(r["shard"])
    whole = [len(places[zlib.crc32(rows[k][1].encode())]) == 1 for k in range(1000, 3000, 2)]
    assert sum(whole) >= len(whole) - 8


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_groups_up_to_the_largest_document_stay_whole(spark, table):
    got = sharding.op10_kd_tree_shards(spark, f"/root/testdata/{table}").collect()
    texts = {r["doc_id"]: r["text"] for r in load(spark, f"/root/testdata/{table}", "documents").select("doc_id", "text").collect()}
    groups, largest = {}, max(r["size"] for r in got)
    for r in got:
        groups.setdefault(texts[r["doc_id"]], []).append(r)
    small = [g for g in groups.values() if len(g) > 1 and sum(r["size"] for r in g) <= largest]
    assert small and all(len({r["shard"] for r in g}) == 1 for g in small)
    total = check([(r["doc_id"], texts[r["doc_id"]]) for r in got], got, 24)
    assert max(abs(t - sum(total.values()) / 24) for t in total.values()) <= 2 * largest


def test_odd_rows(make, odd):
    check(odd, sharding.shard(make(odd)).collect(), 24)
    assert sharding.shard(make([])).count() == 0
    check([(1, None)], sharding.shard(make([(1, None)])).collect(), 24)
    got = sharding.shard(make([(None, "a"), (None, "a"), (None, None)]), shards=3).collect()
    check([(None, "a"), (None, "a"), (None, None)], got, 3)


def test_reruns_agree(make):
    rows = [(i, f"t{i}", "en", "s") for i in range(300)]
    one, two = ({r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(make(x)).collect()} for x in (rows, rows[::-1]))
    assert one == two


def plain_tree(spark, rows, shards):
    """{row number: shard} by sorting whole lists."""
    md5 = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    crc = lambda t: zlib.crc32((t or "").encode()) // 2
    size = [len((t or "").encode()) + 8 for _, t, *_ in rows]
    logs = {r["s"]: r["x"] for r in spark.createDataFrame([(s,) for s in set(size)], "s long").select("s", F.floor(F.log2(F.col("s").cast("double")) * 1e6).alias("x")).collect()}
    ids = [r[0] for r in rows if r[0] is not None]
    coordinate = lambda v, lo, hi: math.floor((v - lo) / float(max(1, hi - lo)) * float((1 << 31) - 1))
    groups = {}
    for (i, t, lang, source), s in zip(rows, size):
        groups.setdefault(t or "", []).append((s, crc(source), crc(lang), i))
    keys = []
    for (i, t, *_), s in zip(rows, size):
        own = groups[t or ""]
        known = [g[3] for g in own if g[3] is not None]
        x = [coordinate(min(logs[g[0]] for g in own), logs[min(size)], logs[max(size)]), min(g[1] for g in own), min(g[2] for g in own), coordinate(min(known, default=min(ids)), min(ids), max(ids))]
        tie = (md5(t or "") & (1 << 20) - 1) << 12 | md5(("" if i is None else f"{i}:") + (t or "")) & (1 << 12) - 1
        keys.append([(v << 32) + tie for v in x])
    out = {}

    def split(at, first, n, total):
        if n == 1:
            out.update(dict.fromkeys(at, first))
            return
        d = max(range(4), key=lambda d: (max(keys[k][d] for k in at) >> 32) - (min(keys[k][d] for k in at) >> 32) if at else 0)
        want, done, cut, left = total * (n // 2) / n, 0, 0, 0
        if at:
            for key in sorted({keys[k][d] for k in at}):
                here = sum(size[k] for k in at if keys[k][d] == key)
                if done + here >= want:
                    break
                done += here
            mine = lambda low, high: sum(size[k] for k in at if keys[k][d] >> 12 == key >> 12 and low <= keys[k][d] < high)
            off = lambda x: abs(x[0] - want)
            left, cut = min([(done - mine(0, key), key >> 12 << 12), (done + here + mine(key + 1, 1 << 80), ((key >> 12) + 1) << 12)], key=off)
            if off((left, cut)) > sharding.SNAP * total / n and mine(0, 1 << 80) > max(size):
                left, cut = min([(done, key), (done + here, key + 1)], key=off)
        split([k for k in at if keys[k][d] < cut], first, n // 2, left)
        split([k for k in at if keys[k][d] >= cut], first + n // 2, n - n // 2, total - left)

    split(list(range(len(rows))), 0, shards, sum(size))
    return out


@pytest.mark.parametrize("shards", [7, 24])
def test_against_a_tree_by_sorting(spark, make, shards):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot text here", f"text {rng.randrange(150)} " + "z" * rng.randrange(90)]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(500)]
    rows += [(None, "no id", None, None), (None, None, "en", "a"), (600, "", "en", "a")]
    want = plain_tree(spark, rows, shards)
    got = {(r["doc_id"], r["text"]): r["shard"] for r in sharding.shard(make(rows), shards=shards).collect()}
    assert got == {rows[k][:2]: s for k, s in want.items()}
