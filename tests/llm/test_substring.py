import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from sparsemill.llm.substring_dedup import _answer, _step, levels, op2_substring_dedup, remove_repeats


def brute(rows, window):
    """{(doc_id, text): (words, removed, kept)} by the definition."""
    docs = [((1 << 63) - 1 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or ""), (i, t)) for i, t in rows]
    first = {}
    for i, w, _ in docs:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = {}
    for i, w, key in docs:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        out[key] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def check(make, rows, window, **kw):
    got = remove_repeats(make(rows), window=window, **kw).collect()
    want = brute([r[:2] for r in rows], window)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"], r["text"]]


def test_levels():
    assert levels(20) == [5, 10, 20] and levels(50) == [5, 10, 20, 40, 50] and levels(3) == [3]


def test_odd_rows(make, odd):
    check(make, [r for r in odd if r[1] is None or len(r[1]) < 1e5], 20)
    assert remove_repeats(make([])).count() == 0


@pytest.mark.parametrize("window", [3, 5, 7, 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_random(make, window, seed):
    rng = random.Random(seed)
    phrase = [rng.choice("abcdefg") for _ in range(40)]
    rows = []
    for i in range(40):
        w = [rng.choice("abcdefgh") for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            a = rng.randrange(20)
            w[5:5] = phrase[a : a + rng.randrange(5, 40)]
        rows.append((i - 5, rng.choice([" ", "\n"]).join(w)))
    rows += rows[:4] + [(3, "a b c d e f g h i j"), (3, "b c d e f g h i j k")]
    check(make, rows, window, chunk_bytes=200, bucket_bytes=2000)


def test_planted_passage(make):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join([word() for _ in range(50)] + passage + [word() for _ in range(50)])) for k in range(12)]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(make(rows)).collect()}
    assert got == {0: 0, **{k: 60 for k in range(1, 12)}}


def test_many_documents_in_small_chunks(make):
    """Thousands of documents over many chunks and buckets, with passages that some, many and very many share."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(20, 90))] for _ in range(30)]
    rows = []
    for i in range(2500):
        w = [rng.choice(words) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = shared[min(29, int(rng.paretovariate(0.6)) - 1)][rng.randrange(10) :]
        rows.append((rng.randrange(-5000, 5000), " ".join(w)))
    rows += rng.sample(rows, 100)
    check(make, rows, 20, chunk_bytes=12_000, bucket_bytes=60_000)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_arrive_in_another_order_at_each_level(seed):
    """Executors fetch the rows of a chunk in any order; local ones always in the same."""
    rng = random.Random(seed)
    phrase = [rng.choice("abcdefg") for _ in range(60)]
    rows = [(i if i % 7 else None, " ".join([rng.choice("abcdefgh") for _ in range(rng.randrange(30))] + phrase[rng.randrange(20) :])) for i in range(40)]
    rows += [(1, None), (2, ""), rows[3], rows[4]]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("_chunk", pa.int64())])
    table = lambda some: pa.table([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
    steps, chunks, got = levels(20), [0, 1, 2], {}
    dealt = {c: [(*r, c) for k, r in enumerate(rows) if k % 3 == c] for c in chunks}
    answers = {c: None for c in chunks}
    ends = lambda docs, c, starts: got.update({(docs["doc_id"][k].as_py(), docs["text"][k].as_py()): set((starts[c.words.doc[starts] == k] - c.words.first[k]).tolist()) for k in range(docs.num_rows)})
    for level in range(len(steps) + 1):
        work, asked = _step(level, steps, "doc_id", "text", "_chunk", 4, ends if level == len(steps) else None), []
        for c in chunks:
            some = table(rng.sample(dealt[c], len(dealt[c])))
            asked.append(work(some, answers[c]) if level else work(some))
        if level < len(steps):
            asked = pa.concat_tables(asked)
            told = pa.concat_tables([_answer(level == len(steps) - 1)(asked.filter(pc.equal(asked["bucket"], b))) for b in set(asked["bucket"].to_pylist())])
            answers = {c: told.filter(pc.equal(told["chunk"], c)) for c in chunks}
    for key, (_, gone, _) in brute(rows, 20).items():
        assert len({at + k for at in got[key] for k in range(20)}) == gone


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, _chunk int, N_Words int")
    r = remove_repeats(df).first()
    assert (r["_chunk"], r["n_words"], r["kept_text"]) == (5, 2, "a b")


def test_query(spark):
    from tests.conftest import SF

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs, 20)
    for r, (key, w) in zip(op2_substring_dedup(spark, SF).orderBy("doc_id").collect(), sorted(want.items())):
        assert (r["doc_id"], r["n_words"], r["n_removed"]) == (key[0], *w[:2])
