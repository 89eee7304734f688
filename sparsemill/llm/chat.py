r"""Chat formatting of reply trees.

Messages are nodes with a parent. Pointer-doubling self-joins enumerate root-to-leaf paths: after
round k a node knows its 2^k-th ancestor and the score and length of the path to it, so a chain of n
messages takes log2(n) joins, and keys of a join are unique. The leaves of a tree are ranked by their
path's score; the chosen leaves are handed down the same pointers in reverse, which marks every node
of their paths. Each chosen path becomes one conversation.

Template. A turn is `### ` role `: ` text `</turn>\n`. Backslash, `#` and `<` inside texts, and also
`:` inside roles, get a backslash in front, so no control string can stand in a text, and taking the
backslashes out again gives the text back. The loss mask is the spans of assistant texts.

Defined results: null text or role is empty; a conversation's rows are ordered by turn (null last), then
role, text; repeated rows are turns of their own; rows of null conversation ids form one conversation; a message
whose parent does not exist is a root; messages on a cycle belong to no path; an empty table gives an
empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsemill.llm.common import load, materialise

ASSISTANT = "assistant"
#: The conversation that the query adds: control strings and escapes inside texts.
EXTRA_ID, EXTRA_TEXT = -7, r"\### Assistant: </turn> ok"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


# ---------------------------------------------------------------- reply trees


def best_paths(nodes: DataFrame, *, per_tree: int = 1) -> DataFrame:
    """(tree, path, depth, node) of the per_tree best root-to-leaf paths of each tree.

    nodes has tree, node (unique within its tree), parent (null for roots) and score. A path's score is
    the sum of its nodes' scores; ties go to the longer path, then to the smaller leaf.
    """
    spark = nodes.sparkSession
    known = nodes.select(F.col("tree"), F.col("node").alias("parent"))
    # a parent that is not there makes a root
    rooted = nodes.join(known.withColumn("_there", F.lit(True)), ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_there"), F.col("parent")).alias("up"), F.col("score").cast("double").alias("sum"))
    # nodes that have reached a root leave the joins: each round joins only those that have not
    every = materialise(rooted.withColumn("length", F.lit(1).cast("long")), "jumps")
    done, active = every.where("up is null"), every.where("up is not null")
    rounds, left, most = [], active.count(), max(1, every.count())
    while left and 2 ** len(rounds) <= most:  # beyond that, what is left goes round in circles
        rounds.append(active.select("tree", "node", "up"))
        far = done.unionByName(active).select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("length").alias("_length"))
        joined = active.join(far, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("length") + F.col("_length")).alias("length"))
        moved = materialise(joined, "jumps")
        done, active = done.unionByName(moved.where("up is null")), moved.where("up is not null")
        left = active.count()
    now = done
    parents = rooted.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = now.join(parents, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("sum").desc(), F.col("length").desc(), "node")
    chosen = leaves.withColumn("path", F.row_number().over(order)).where(F.col("path") <= per_tree)
    # depth of a node is its length: the number of nodes from its root
    marked = materialise(chosen.select("tree", "path", "node"), "marks")
    for jump in reversed(rounds):
        marked = marked.union(marked.join(jump, ["tree", "node"]).select("tree", "path", F.col("up").alias("node")))
        marked = materialise(marked, "marks")
    return marked.join(now.select("tree", "node", F.col("length").alias("depth")), ["tree", "node"]).select("tree", "path", "depth", "node")


# ---------------------------------------------------------------- the template


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"([\\#<:])" if role else r"([\\#<])", r"\\$1")


def turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), escape(role, True), F.lit(": "), escape(text), F.lit("</turn>\n"))


def parse(formatted: str) -> list[tuple[str, str, tuple[int, int]]]:
    """(role, text, span of the escaped text in code points) of each turn; the whole string must be turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((_ESCAPE.sub(r"\1", m[1]), _ESCAPE.sub(r"\1", m[2]), m.span(2)))
        at = m.end()
    return out


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, path, formatted, mask): the turns of each path in order, and the spans to learn from.

    messages has tree, node, role and text. A conversation is one value and so is put together in one task.
    """
    said = messages.select("tree", "node", turn(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("said"))
    joined = paths.join(said, ["tree", "node"])
    whole = joined.groupBy("tree", "path").agg(F.array_sort(F.collect_list(F.struct("depth", "said"))).alias("turns"))
    formatted = whole.select("tree", "path", F.array_join(F.col("turns.said"), "").alias("formatted"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"begin": s, "end": e} for role, _, (s, e) in parse(x) if role == ASSISTANT] for x in b.column("formatted").to_pylist()]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], names=[*b.schema.names, "mask"])

    types = dict(formatted.dtypes)
    return formatted.mapInArrow(work, f"tree {types['tree']}, path int, formatted string, mask array<struct<begin: long, end: long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, path) with what the formatted strings and their masks hold: turns, and the text under the mask."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, mask in zip(b.column("formatted").to_pylist(), b.column("mask").to_pylist()):
                turns = parse(x)
                loss = "".join(_ESCAPE.sub(r"\1", x[m["begin"] : m["end"]]) for m in mask)
                said = "".join(f"{role}\n{text}\n" for role, text, _ in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(x)))
            cols = zip(*rows) if rows else [[]] * 5
            new = [pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("path"), *new], names=["tree", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(formatted.dtypes)["tree"]
    return formatted.mapInArrow(work, f"tree {kind}, path int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text as reply trees: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return numbered.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text"
    )


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, ASSISTANT, EXTRA_TEXT)], rows.schema)
    nodes = materialise(conversation_nodes(rows.unionByName(extra)), "nodes")
    done = read_back(format_paths(nodes, best_paths(nodes)))
    return done.select(F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok', r, '' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 14 AS n FROM c),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, r0 NULLS FIRST, t0 NULLS FIRST) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
  sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
