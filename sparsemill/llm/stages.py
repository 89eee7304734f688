"""The pipeline's stages: each takes (spark, docs, sf_dir) and applies one operator to all of docs.

docs has the columns of documents, and may have others, of any names. All stages but the last return the same
columns. Rows are never changed where an operator finds nothing to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsemill.llm.bpe import decode, encode, multilingual
from sparsemill.llm.common import NULL_ID, doc_hash, materialise, packed, unpacked
from sparsemill.llm.langid import UNDETERMINED, identify, train, train_split
from sparsemill.llm.mixing import in_training_order, mix
from sparsemill.llm.similar import first_of_groups
from sparsemill.llm.substring_dedup import remove_repeats

#: A document whose language is less likely than this is rejected; an even guess among four has 0.25.
LEAST_LIKELY = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose language stays open (score under LEAST_LIKELY)."""
    found = identify(packed(docs, "text"), train(train_split(docs)), lang_out="_lang_pred", score_out="_lang_score")
    kept = (F.col("_lang_pred") != UNDETERMINED) & (F.col("_lang_score") >= LEAST_LIKELY)
    return found.where(kept).select(*unpacked(found, docs.columns, ("text",)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the least id (of rows equal in that, the least hash).

    Documents link by SimHash (4 words, 4 of 64 bits) and by a Jaccard similarity of 0.8 of their distinct five-word shingles.
    """
    keyed = packed(docs, "doc_id", "text").withColumns({"_id": F.coalesce("doc_id", F.lit(NULL_ID)), "_hash": doc_hash("doc_id", "text")})
    keys = materialise(first_of_groups(keyed.select("_id", "_hash", "text")), "kept")
    kept = keyed.join(keys, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return kept.select(*unpacked(kept, docs.columns, ("doc_id", "text")))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated 20-word passages out of texts; a text without any stays as it is, to the byte."""
    done = remove_repeats(packed(docs, "doc_id", "text", "n_chars"), kept_col="_kept_text")
    hit = F.col("n_removed") > 0
    changed = {"text": F.when(hit, F.col("_kept_text")).otherwise(F.col("text")), "n_chars": F.when(hit, F.length("_kept_text").cast("long")).otherwise(F.col("n_chars").cast("long"))}
    done = done.withColumns(changed)
    return done.select(*unpacked(done, docs.columns, ("doc_id", "text", "n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that the mix takes a document, in training order."""
    inputs = ("doc_id", "text", "source")
    taken = in_training_order(mix(packed(docs, *inputs)))
    return taken.select(*unpacked(taken, docs.columns, inputs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    back = decode(encode(docs.select("doc_id", "lang", "source", "text"), **multilingual()).drop("text"), **multilingual())
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
