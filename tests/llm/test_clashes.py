"""Columns that an operator uses itself, or names like its helpers', come through every operator unchanged."""

import pytest
from pyspark.sql import functions as F

from sparsemill.llm import bpe, langid, lm, mixing, ogg, sharding, simhash, stages, substring_dedup

NAMES = ["_rest", "_id", "_text", "_row", "_node", "_fp", "_first", "_root", "_key", "_order", "_before", "_turn", "_passes", "_chunk", "_part", "_base", "_one", "_k0", "_dim", "_hash", "_lang", "_doc_text", "_doc_source",
         "node", "root", "bucket", "chunk", "data", "part", "kind", "position", "n", "Extra Name"]
OPERATORS = {
    "op1": lambda df: bpe.encode(df, **bpe.multilingual()),
    "op2": substring_dedup.remove_repeats,
    "op3": lambda df: lm.score(df, F.lit(True)),
    "op4": simhash.near_duplicates,
    "op6": lambda df: langid.identify(df, langid.train(df)),
    "op7": lambda df: ogg.demultiplex(ogg.store(df)),
    "op9": mixing.mix,
    "op10": sharding.shard,
}


@pytest.fixture(scope="module")
def wide(make):
    df = make([(1, "one two three", "en", "a"), (2, "one two four", "en", "b"), (3, None, None, None)])
    return df.select("*", *((F.col("doc_id") * 100 + k).alias(n) for k, n in enumerate(NAMES)))


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(wide, name):
    got = OPERATORS[name](wide).collect()
    assert len(got) == 3
    for r in got:
        assert [r[n] for n in ("source", *NAMES)] == [{1: "a", 2: "b", 3: None}[r["doc_id"]], *(r["doc_id"] * 100 + k for k in range(len(NAMES)))]


def test_stages(spark, wide):
    extra = wide.withColumns({"size": F.lit(-1), "target": F.lit(-2), "n_words": F.lit(-3), "_lang_pred": F.lit("x")})
    for stage in (stages.language, stages.near_copies, stages.repeats, stages.mixture):
        got = stage(spark, extra, "")
        assert got.columns == extra.columns
        for r in got.collect():
            assert [r[n] for n in ("size", "target", "n_words", "_lang_pred", *NAMES)] == [-1, -2, -3, "x", *(r["doc_id"] * 100 + k for k in range(len(NAMES)))]
