"""The prefix trie against a plain tree of tuples."""

import hashlib
import random
import zlib

import pytest

from sparsemill.llm import trie
from sparsemill.llm.common import load

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(rows):
    """{conversation: its turns in order}; turns of equal number must not be there."""
    out = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def plain(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        ends.setdefault(tuple(turns), []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below = [sums[x] for x in children.get(node, [])]
        sums[node] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children.get(node, [])), *sums[node], digest(ends.get(node, []))) for node, m in members.items()
    )


def found(df):
    return sorted(tuple(-1 if c == "parent_conv_id" and r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(2), []
    for c in [*range(0, 40), *range(100, 130), *range(250, 262)]:  # 200 is not there
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            out.append((c, t * 3 if t else None, rng.choice(["user", None, ""]), rng.choice(["a", "bb", None, "日本", ""])))
    out += [(500 + k, t, "user", "same") for k in range(60) for t in range(8)]  # a chain that many end on
    out += [(700, t, "x", f"w{t % 7}") for t in range(1500)] + [(701, t, "x", f"w{t % 7}" if t < 1400 else "y") for t in range(1500)]  # long ones
    return out


def test_as_they_are(spark, rows):
    rng = random.Random(1)
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA)
    assert found(trie.conversation_trie(df)) == plain(ordered(rows))


def test_rebuilt(spark, rows, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(trie.prefix_trie(*trie.share_first_turns(trie.number_turns(df))))
    assert got == plain(rebuilt(ordered(rows)))


def test_turnless(spark):
    # conversation 101 has no base, and loses its only turn if its h is above 0
    rows = [(c, 0, "user", f"t{c}") for c in range(101, 112)]
    got = found(trie.prefix_trie(*trie.share_first_turns(trie.number_turns(spark.createDataFrame(rows, SCHEMA)))))
    assert got == plain(rebuilt(ordered(rows))) and any(not t for t in rebuilt(ordered(rows)).values())


def test_odd_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.conversation_trie(none).count() == 0
    assert trie.prefix_trie(*trie.share_first_turns(trie.number_turns(none))).count() == 0
    rows = [(None, 1, "user", "left out"), (1, 1, "user", "x" * 100_000), (1, 1, "user", "x" * 100_000), (2, 1, "user", "x" * 100_000), (-3, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as k", "2 as a", "3 as node", "4 as part", "5 as n_convs")
    assert found(trie.conversation_trie(df)) == plain(ordered(rows))
    ties = [(1, 5, "a", "one"), (1, 5, "b", "two"), (2, 5, "b", "two"), (2, 5, "a", "one")]
    got = found(trie.conversation_trie(spark.createDataFrame(ties, SCHEMA)))
    assert [r[3] for r in got] == [2, 2, 2]  # the order of ties depends on role and text alone


def test_rounds_are_logarithmic(spark):
    n = 300
    nodes = spark.createDataFrame([(str(k), str(k - 1) if k else None, k, int(k == n - 1), 1) for k in range(n)], "node string, up string, depth long, leaves long, saved long")
    got = {r["node"]: (r["leaves"], r["saved"]) for r in trie.rollup(nodes).collect()}
    assert got == {str(k): (1, n - k) for k in range(n)}


def test_query(spark):
    rows = [tuple(r) for r in load(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(trie.op12_prefix_trie(spark, SF)) == plain(rebuilt(ordered(rows)))
