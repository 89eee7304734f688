import random

import corpus_pipeline
import __spark_entry__
from sparsemill.llm import langid, stages
from sparsemill.llm.substring_dedup import remove_repeats
from tests.conftest import SF
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_substring import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["th", "ing", "er", "an", "on", "st"]) for _ in range(rng.randrange(1, 4)))
    passage = " ".join(word() for _ in range(60))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(30, 120))), "en", f"s{k % 4}") for k in range(60)]
    rows += [(100 + k, rows[k][1], "en", "s1") for k in range(10)]
    rows += [(200 + k, f"{' '.join(word() for _ in range(30))} {passage} {' '.join(word() for _ in range(30))}", "en", "s2") for k in range(5)]
    return rows + [(300, "12 34 ??", "en", "s0"), (301, None, "en", "s0"), (302, "  two  spaces\nkept ", "en", "s3")]


def test_stages(spark, make):
    rows = corpus()
    docs = make(rows)
    kept = stages.language(spark, docs, SF).persist()
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r[0] for r in rows if langid.has_letter(r[1])} and kept.columns == COLUMNS

    one = stages.near_copies(spark, kept, SF).persist()
    left = [r for r in rows if r[0] in ids]
    comp = plain_components([plain_fingerprint(r[1]) for r in left], [r[0] for r in left])
    assert {r["doc_id"] for r in one.collect()} == set(comp) and one.count() == len(set(comp)) and one.columns == COLUMNS

    cut = stages.repeats(spark, one, SF).persist()
    left = [(r["doc_id"], r["text"]) for r in one.collect()]
    want = brute(left, 20)
    for r in cut.collect():
        n, gone, text = next(v for k, v in want.items() if k[0] == r["doc_id"])
        assert r["text"] == (text if gone else dict(left)[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert sum(v[1] for v in want.values()) == 4 * 60 and cut.columns == COLUMNS

    mixed = stages.mixture(spark, cut, SF).persist()
    assert mixed.columns == COLUMNS and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in cut.collect()}
    size = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert abs(size(mixed) - 1.5 * size(cut)) < 300

    done = stages.tokens(spark, mixed, SF).collect()
    assert len(done) == mixed.count() and all(r["n_tokens"] * 4 == len(r["ids"]) for r in done)


def test_edited_copies_go_and_others_stay(spark, make):
    """Copies with a similarity of 0.8 or more go; clean documents and those far below stay."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    rows, must = [], set()
    for g in range(40):
        base = [word() for _ in range(rng.randrange(120, 300))]
        rows.append((g * 10, " ".join(base)))
        for k, share in ((1, 0.0), (2, 0.012), (3, 0.2)):
            w = list(base)
            for at in rng.sample(range(len(w)), int(share * len(w))):
                w[at] = word()
            rows.append((g * 10 + k, " ".join(w)))
        must.add(g * 10 + 2)
    kept = {r["doc_id"] for r in stages.near_copies(spark, make(rows), SF).collect()}
    assert {g * 10 for g in range(40)} | {g * 10 + 3 for g in range(40)} <= kept
    assert not kept & {g * 10 + 1 for g in range(40)}
    assert len(kept & must) <= 3


def test_large_group_is_one(spark, make):
    rng = random.Random(6)
    base = [f"w{rng.randrange(1000)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        w = list(base)
        w[rng.randrange(400)] = f"new{k}"
        rows.append((k, " ".join(w)))
    assert [r["doc_id"] for r in stages.near_copies(spark, make(rows), SF).collect()] == [0]


def test_repeated_rows_and_empty(spark, make):
    two = make([(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (None, None, None, None), (None, None, None, None)])
    assert stages.near_copies(spark, two, SF).count() == 2
    empty = make([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0
    every = __spark_entry__.queries()
    assert "pipeline" in every and [sum(q.startswith(f"op{n}_") for q in every) for n in range(1, 11)] == [1] * 10


def test_queries_with_sql(spark):
    """op2, op5 and op8 against their SQL (op9 has its own test)."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op2_substring_dedup", "op5_exact_top_k", "op8_reply_trees"):
        got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(repr, got[sorted(got)].astype(object).values.tolist())) == sorted(map(repr, want[sorted(want)].astype(object).values.tolist()))


def test_remove_repeats_keeps_clean_texts(make):
    assert remove_repeats(make([(1, " a  b ")])).first()["n_removed"] == 0
