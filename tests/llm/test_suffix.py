"""Decontamination by suffix arrays against a plain search of windows."""

import hashlib
import random
import re

import pytest

from sparsemill.llm import suffix
from sparsemill.llm.common import load

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=suffix.WINDOW):
    """{(doc, text): (n_words, hit positions, items, longest)} by comparing windows one by one."""
    wanted = {}
    for name, text in items:
        w = words(text)
        k = min(len(w), window)
        for s in range(len(w) - k + 1) if k else ():
            wanted.setdefault(tuple(w[s : s + k]), set()).add(name)
    sizes, out = {len(g) for g in wanted}, {}
    runs = {tuple(words(t)[a:b]) for _, t in items for a in range(len(words(t))) for b in range(a + 1, len(words(t)) + 1)}
    for d, text in docs:
        w, hit, names, longest = words(text), set(), set(), 0
        for k in sizes:
            for s in range(len(w) - k + 1):
                if found := wanted.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    names |= found
                    longest = max(longest, k)
                    while tuple(w[s : s + longest + 1]) in runs and s + longest < len(w):
                        longest += 1
        out[d, text] = (len(w), sorted(hit), sorted(str(n) for n in names if n is not None), longest)
    return out


def found(rows):
    return {(r["doc_id"], r["text"]): (r["found"]["n_words"], [k for a, b in zip(r["found"]["begins"], r["found"]["ends"]) for k in range(a, b)], r["found"]["items"], r["found"]["longest"]) for r in rows}


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)] + ["É1", "ß"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([4, 5, 7, 9]))) for k in range(25)] + [(30, "W3-W4"), (31, ""), (32, None), (33, text(30)), (None, "no name here"), (34, "alone"), (34, "alone"), (35, "w1 w1 w1 w1 w1 w1 w1")]
    docs = [(k, text(rng.choice([0, 1, 3, 40, 300]))) for k in range(120)]
    docs += [(200, items[33 - 33 + 28][1]), (201, f"{items[28][1]}, {items[28][1].upper()}!"), (202, None), (203, "W3 w4 alone. NO name\nHere"), (204, "w1 " * 50), (204, "w1 " * 50), (None, "w1 " * 9), (205, "x" * 70_000)]
    return docs, items


@pytest.mark.parametrize("size", [{}, {"shard_bytes": 600}, {"block_bytes": 150, "shard_bytes": 5000}])
def test_plain(spark, case, size):
    docs, items = case
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = suffix.find_matches(df, table, window=6, **size).collect()
    assert len(got) == len(docs)
    assert found(got) == plain(docs, items, 6)


def test_longest_places(spark):
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten eleven twelve end")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "A one TWO three four five six seven eight nine ten eleven twelve! stop")], "item_id long, text string")
    f = suffix.find_matches(docs, items).first()["found"]
    assert (f["longest"], f["longest_at"], f["longest_item"], f["longest_item_at"]) == (12, 1, "7", 1)
    assert (f["begins"], f["ends"]) == ([1], [13])


def test_empty_and_clashes(spark, make, odd):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert suffix.find_matches(make([]), items).count() == 0
    none = suffix.find_matches(make(odd), spark.createDataFrame([], items.schema)).collect()
    assert len(none) == len(odd) and not any(r["found"]["begins"] for r in none)
    clash = make(odd).selectExpr("*", "1 as found", "2 as _found", "3 as _rest", "4 as _key", "5 as items", "6 as _text", "7 as _hash", "8 as _id")
    rows = suffix.find_matches(clash, items).collect()
    assert {(r["_found"], r["_rest"], r["_key"], r["items"], r["_text"], r["_hash"], r["_id"]) for r in rows} == {(2, 3, 4, 5, 6, 7, 8)}
    left = suffix.decontaminate(clash, items)
    assert left.columns == clash.columns and {r["doc_id"] for r in left.collect()} == {r[0] for r in odd} - {4}


def test_query(spark):
    docs = [tuple(r) for r in load(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in load(spark, SF, "benchmark").select("item_id", "text").collect()]
    want = {d: (n, len(h), len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), bool(h)) for (d, _), (n, h, i, _) in plain(docs, items).items()}
    got = suffix.op11_suffix_decontamination(spark, SF).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == want
    assert any(r["contaminated"] for r in got) and len(got) == len(docs)
