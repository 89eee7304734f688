import hashlib
import random

from sparsemill.llm import chat

ROWS = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    nodes = chat.conversation_nodes(spark.createDataFrame(rows, ROWS)).persist()
    return chat.format_paths(nodes, chat.best_paths(nodes))


def test_round_trip(spark):
    odd = ["### a: ", "</turn>\n### assistant: x", "\\", "\\\\#<", "", None, "日本 é", r"\### Assistant: </turn> ok", "a\nb"]
    rows = [(k, t, role, text) for k, text in enumerate(odd) for t, role in enumerate(["user", "assistant", "as:#sistant\\"])]
    rows += [(100, None, None, "last"), (100, 1, "user", "first"), (None, 1, "user", "no id"), (100, 1, "user", "first")]
    got = {r["tree"]: chat.parse(r["formatted"]) for r in formatted(spark, rows).collect()}
    for k, text in enumerate(odd):
        assert [(a, b) for a, b, _ in got[str(k)]] == [(role, text or "") for role in ("user", "assistant", "as:#sistant\\")]
    assert [(a, b) for a, b, _ in got["100"]] == [("user", "first"), ("user", "first"), ("", "last")]
    assert [(a, b) for a, b, _ in got[""]] == [("user", "no id")]
    back = {r["tree"]: r for r in chat.read_back(formatted(spark, rows)).collect()}
    r = back["7"]
    assert r["loss_chars"] == len(odd[7]) and r["loss_sha256"] == hashlib.sha256(odd[7].encode()).hexdigest() and r["n_turns"] == 3


def test_empty(spark):
    assert formatted(spark, []).count() == 0


def test_long_chain(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(300)]
    assert [t for _, t, _ in chat.parse(formatted(spark, rows).first()["formatted"])] == [f"t{k}" for k in range(300)]


def test_best_paths(spark):
    rng = random.Random(3)
    rows = [("t", 0, None, 1.0)] + [("t", k, rng.randrange(k), float(rng.randrange(-3, 5))) for k in range(1, 60)] + [("o", 5, 99, 2.0), ("o", 6, 5, -1.0), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    got = {}
    for r in chat.best_paths(df, per_tree=3).orderBy("tree", "path", "depth").collect():
        got.setdefault((r["tree"], r["path"]), []).append(r["node"])
    parent = {n: p for t, n, p, _ in rows if t == "t"}
    score = {n: s for t, n, _, s in rows if t == "t"}

    def path(n):
        return ([] if parent[n] is None else path(parent[n])) + [n]

    leaves = sorted((n for n in parent if n not in parent.values()), key=lambda n: (-sum(score[k] for k in path(n)), -len(path(n)), n))
    assert [got["t", k + 1] for k in range(3)] == [path(n) for n in leaves[:3]]
    assert got["o", 1] == [5, 6] and not any(t == "c" for t, _ in got)
