"""Sharding by a k-d tree over document metadata, in DataFrame operations alone.

Method. Equal texts form a group, and a group's metadata are those of its members taken together:
size in bytes (on a log scale), least source and least language (hashed), and least id. A node of
the tree is cut along its widest dimension, relative to the whole table, at the weighted median of
bytes (or another fraction, where its number of shards is odd), until every leaf is one shard.
Medians are exact and found for all nodes of a level at once: bytes are summed over 2^12 bins of the
sort key between the node's bounds, and the bin that holds the median is cut again, until it holds
one key. The sums stay in Spark; one row a node reaches the driver, and a level's cuts go back as one
small table (32 bytes a node), which is broadcast. A row finds its leaf with one such join a level.

The sort key is the coordinate, then a hash of the text, then a hash of the row. A group is therefore
contiguous. A cut within a group moves to the group's nearer edge, unless that moves more than SNAP of a
shard and what the node has of the group is larger than the largest row of the table. So a group no larger than a row stays
whole (a shard's size is no finer than that anyway), and one with a third of all rows is split evenly.
The law is `bytes`: shards' sizes are near equal.

Rows meet their group's metadata in a join on the text. Of the texts that have more than one in HOT of all
rows there are fewer than HOT, so these are broadcast and no task gets a hot text's rows.

Defined results: null text has no bytes (size 8, CRC of the empty string); null ids, sources and
languages count as the least; repeated rows are placed each on its own; an empty table gives an
empty result; columns named like the results are replaced, others are carried along.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsemill.llm.common import drop, in_struct, load, materialise
from sparsemill.llm.native import md5_number, running_sum

SHARDS, OVERHEAD, BINS, SNAP = 24, 8, 1 << 12, 0.02
#: A text is hot with more than one in HOT of all rows, and more than FEW rows.
HOT, FEW = 4096, 64
#: Sort keys by dimension: 31 bits of coordinate, 20 of the text's hash, 12 of the row's.
KEYS = ("_k0", "_k1", "_k2", "_k3")
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass
class Node:
    """Some shards in a row, and the bytes that lie in them."""

    first: int
    shards: int
    bytes: int


def _coordinate(value: Column, low: int, high: int) -> Column:
    """31 bits for a value between low and high."""
    return F.floor((value - F.lit(low)) / F.lit(float(max(1, high - low))) * F.lit(float((1 << 31) - 1))).cast("long")


def small_table(spark: SparkSession, rows: list[tuple], **kinds: str) -> DataFrame:
    """The driver's rows as a table made in the JVM; createDataFrame would start Python workers."""
    fields = ", ".join(f"{n}: {kind}" for n, kind in kinds.items())
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(kinds, r)) for r in rows])), f"array<struct<{fields}>>")))


def descend(points: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """points with _node, the first shard of the lowest node that a row is in. levels: _node, _dim, _cut and _step of the nodes cut at each."""
    out = points.withColumn("_node", F.lit(0).cast("long"))
    for cuts in levels:
        key = F.element_at(F.array(*KEYS), F.col("_dim") + 1)
        out = out.join(F.broadcast(cuts), "_node", "left").withColumn("_node", F.when(key >= F.col("_cut"), F.col("_node") + F.col("_step")).otherwise(F.col("_node"))).drop("_dim", "_cut", "_step")
    return out


def _split_level(points: DataFrame, levels: list[DataFrame], nodes: list[Node], largest: int) -> tuple[DataFrame, list[Node]]:
    """The cuts of all these nodes, and the nodes below them. largest: the size of the largest row."""
    spark = points.sparkSession
    placed = descend(points.select(*KEYS, "size"), levels)
    ends = placed.groupBy("_node").agg(*(f(k).alias(f"{n}{d}") for d, k in enumerate(KEYS) for n, f in (("a", F.min), ("b", F.max)))).collect()
    dim, bound = {n.first: 0 for n in nodes}, {}
    for r in ends:
        if r["_node"] in dim:
            width = [(r[f"b{d}"] >> 32) - (r[f"a{d}"] >> 32) for d in range(len(KEYS))]
            d = dim[r["_node"]] = width.index(max(width))
            bound[r["_node"]] = (r[f"a{d}"], r[f"b{d}"], 0)
    want = {n.first: n.bytes * (n.shards // 2) / n.shards for n in nodes}
    dims = small_table(spark, sorted(dim.items()), _node="long", _dim="int")
    keyed = placed.join(F.broadcast(dims), "_node").select("_node", F.element_at(F.array(*KEYS), F.col("_dim") + 1).alias("key"), "size")
    while open_nodes := [(f, a, b, (b - a) // BINS + 1, want[f] - done) for f, (a, b, done) in bound.items() if a < b]:
        limits = small_table(spark, open_nodes, _node="long", lo="long", hi="long", width="long", need="double")
        inside = keyed.join(F.broadcast(limits), "_node").where("key >= lo and key <= hi").withColumn("bin", F.expr("(key - lo) div width"))
        sums = inside.groupBy("_node", "bin").agg(F.sum("size").alias("w"), F.min("key").alias("a"), F.max("key").alias("b"), F.first("need").alias("need"), F.first("hi").alias("hi"))
        upto = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("_node").orderBy("bin")))
        held = upto.where("upto >= need or b = hi").groupBy("_node").agg(F.min(F.struct("bin", "a", "b", (F.col("upto") - F.col("w")).alias("before"))).alias("x"))
        for r in held.select("_node", "x.*").collect():
            bound[r["_node"]] = (r["a"], r["b"], bound[r["_node"]][2] + r["before"])
    # the key that holds the median: cut before or after it, or at an edge of its group
    medians = small_table(spark, [(f, a) for f, (a, _, _) in bound.items()], _node="long", mine="long")
    group = keyed.join(F.broadcast(medians), "_node").where(F.shiftright("key", 12) == F.shiftright("mine", 12))
    part = {"before": F.col("key") < F.col("mine"), "at": F.col("key") == F.col("mine"), "after": F.col("key") > F.col("mine")}
    seen = {r["_node"]: r for r in group.groupBy("_node").agg(*(F.sum(F.when(c, F.col("size")).otherwise(0)).alias(n) for n, c in part.items())).collect()}
    cuts, below = [], []
    for n in nodes:
        cut = left = 0  # of a node without rows
        if n.first in bound:
            k, _, done = bound[n.first]
            r = seen[n.first]
            off = lambda x: abs(x[0] - want[n.first])
            cut = min([(done - r["before"], k >> 12 << 12), (done + r["at"] + r["after"], ((k >> 12) + 1) << 12)], key=off)
            if off(cut) > SNAP * n.bytes / n.shards and r["before"] + r["at"] + r["after"] > largest:
                cut = min([(done, k), (done + r["at"], k + 1)], key=off)
            left, cut = cut[0], min(cut[1], (1 << 63) - 1)
        step = n.shards // 2
        cuts.append((n.first, dim[n.first], cut, step))
        below += [Node(n.first, step, left), Node(n.first + step, n.shards - step, n.bytes - left)]
    return small_table(spark, cuts, _node="long", _dim="int", _cut="long", _step="long"), below


def with_groups(sized: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """sized with its text's row of groups (_text, _n and metadata); hot texts by broadcast."""
    hot = materialise(groups.where(F.col("_n") > max(FEW, rows // HOT)), "hot")  # fewer than HOT rows
    few = F.broadcast(hot.select("_text"))
    return sized.join(F.broadcast(hot), "_text").unionByName(sized.join(few, "_text", "left_anti").join(groups.join(few, "_text", "left_anti"), "_text"))


def shard(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", shards: int = SHARDS, keep_text: bool = True) -> DataFrame:
    """df with size, text_crc32, law, shard, slot (gapless from 0 within a shard) and grown_shard (null)."""
    carried = [c for c in df.columns if (c.lower() not in RESULTS or c in (id_col, text_col, source_col, lang_col)) and (keep_text or c != text_col)]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    number = lambda c: (F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary")) / 2).cast("long")
    sized = df.select(
        in_struct(carried), F.col(id_col).alias("_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), md5_number(F.col(text_col)).alias("_text"),
        md5_number(F.concat_ws(":", F.col(id_col).cast("string"), F.coalesce(text_col, F.lit("")))).alias("_row"), number(source_col).alias("_source"), number(lang_col).alias("_lang"),
    )
    sized = materialise(sized, "sized")
    every = sized.agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.min("size").alias("s0"), F.max("size").alias("s1"), F.min("_id").alias("i0"), F.max("_id").alias("i1")).first()
    log = lambda c: F.floor(F.log2(c.cast("double")) * 1e6)
    bounds = sized.sparkSession.range(1).select(*(log(F.lit(every[k] or 1)) for k in ("s0", "s1"))).first()
    i0, i1 = every["i0"] or 0, every["i1"] or 0
    groups = sized.groupBy("_text").agg(
        F.count("*").alias("_n"), _coordinate(log(F.min("size")), *bounds).alias("_x0"), F.min("_source").alias("_x1"), F.min("_lang").alias("_x2"), _coordinate(F.coalesce(F.min("_id"), F.lit(i0)), i0, i1).alias("_x3")
    )
    tie = F.col("_text").bitwiseAND((1 << 20) - 1) * (1 << 12) + F.col("_row").bitwiseAND((1 << 12) - 1)
    keyed = with_groups(sized, groups, every["n"]).withColumn("_tie", tie)
    points = materialise(keyed.select("_rest", "_id", "_row", "size", "text_crc32", *((F.col(f"_x{d}") * F.lit(1 << 32) + F.col("_tie")).alias(k) for d, k in enumerate(KEYS))), "points")
    drop(sized)
    levels, nodes = [], [Node(0, shards, every["w"] or 0)] if shards > 1 and every["n"] else []
    while nodes:
        cuts, below = _split_level(points, levels, nodes, every["s1"])
        levels.append(cuts)
        nodes = [n for n in below if n.shards > 1]
    placed = descend(points, levels).withColumn("shard", F.col("_node").cast("int")).withColumn("_one", F.lit(1).cast("long"))
    slotted = running_sum(placed, "shard", "_row", "_one", "slot", every["n"], ["_id"])
    return slotted.select(
        *(F.col("_rest").getField(c).alias(c) for c in carried), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return shard(docs, keep_text=False).select("doc_id", *RESULTS)
