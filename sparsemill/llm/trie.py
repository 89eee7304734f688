r"""The prefix trie of conversations, and what sharing their prefixes saves.

A node is a distinct sequence of the first d turns (role, text) of some conversation; the root has no turn.
Members of a node are the conversations that begin with it; a conversation ends at the node of all its turns. A node
saves its last text's code points for each member but one; its subtree's savings and childless nodes are summed up.

Method. A turn's 128-bit digest depends on its place, role and text, and a prefix's digest is the exclusive-or
of its turns' digests, so digests of all prefixes are running sums, and a parent's digest is the node's own without its last
turn. Equal digests are one node: edges are keyed by digests, and no sequence of turns is put together.
Subtree sums come from pointer jumping: in round k every node holds the sums of its descendants less than 2^k
below it and a pointer to its ancestor 2^k above; sums are added up at that ancestor, and the pointer is replaced by
the ancestor's own. That takes log2(depth) + 1 rounds, whatever the depth.

Distribution. Texts stay behind: rows travel with digests and lengths. Turns are numbered by a range sort over (conversation, turn,
...), so a conversation with a third of all rows lies in many ranges; digests run within stretches of STRETCH
turns, after the stretches' own. Common prefixes and pointers to common ancestors are summed before the shuffle; a pointer is only
looked up while its ancestor has one itself, and adaptive execution splits the join where many share it. A node's ending
members are sorted across tasks and joined to strings piece by piece; the digest of a node's pieces is a stream, which by the nature of
SHA-256 is one task's, in bounded memory.

Defined results: null roles and texts are empty; rows without a conversation id belong to no conversation; null turns
come first, and turns of equal number follow one another by a hash of role and text; repeated rows are turns of their own; an empty table
has no root and gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsemill.llm.common import drop, load, materialise

#: Turns whose digests one group runs through, and conversation ids in one piece of a string.
STRETCH, PIECE = 512, 4096
#: Conversations of one hundred share the first turns of the hundred's first: fewer than MOST_SHARED.
HUNDRED, MOST_SHARED = 100, 6

_earlier = Window.unboundedPreceding, -1


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def node_name(depth: Column, a: Column, b: Column) -> Column:
    """A node's key: the digest of its depth and its prefix's two halves."""
    return F.md5(F.concat_ws(":", depth, a, b).cast("binary"))


# ---------------------------------------------------------------- turns in order


def number_turns(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, k, a, b, chars) of each turn: its place from 0, the digest of role and text, and the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    half = lambda seed: F.xxhash64(F.lit(seed), role, text)
    slim = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), half(1).alias("a"), half(2).alias("b"), F.char_length(text).cast("long").alias("chars")).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), "a", "b"]
    dealt = materialise(slim.repartitionByRange(_parts(rows.sparkSession), "conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(*_earlier))
    bases = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("rows")).select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    return dealt.join(bases, ["conv_id", "part"]).select("conv_id", (F.col("base") + inside).alias("k"), "a", "b", "chars")


def share_first_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, k, a, b, chars, length), and (conv_id, length) of all of them.

    Conversation c begins with the first h turns of c - c % 100, where h is a checksum of c modulo 6, and goes on with its own after its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("h")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    convs = sizes.select("conv_id", "n", base.alias("base"), h)
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    shared = F.least("h", F.coalesce("there", F.lit(0))).cast("long")
    convs = materialise(convs.select("conv_id", "base", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    # at most HUNDRED conversations ask for at most MOST_SHARED - 1 turns of one
    heads = turns.where((F.col("k") < MOST_SHARED - 1) & (F.col("conv_id") % HUNDRED == 0)).withColumnRenamed("conv_id", "base")
    head = convs.join(heads, "base").where("k < shared").select("conv_id", "k", "a", "b", "chars", "length")
    own = turns.join(convs, "conv_id").where("k >= h").select("conv_id", (F.col("k") - F.col("h") + F.col("shared")).alias("k"), "a", "b", "chars", "length")
    return materialise(head.unionByName(own), "rebuilt"), convs.select("conv_id", "length")


# ---------------------------------------------------------------- nodes


def prefix_rows(turns: DataFrame) -> DataFrame:
    """One row a conversation and prefix: conv_id, depth (from 1), node, up (the parent's node), chars, and whether the conversation ends there."""
    placed = turns.select("conv_id", "k", "length", "chars", *(F.xxhash64(F.lit(seed), "k", "a", "b").alias(c) for c, seed in (("a", 3), ("b", 4)))).withColumn("stretch", F.expr(f"k div {STRETCH}"))
    xor = lambda c, w: F.coalesce(F.bit_xor(c).over(w), F.lit(0).cast("long"))
    outer = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(*_earlier)
    bases = placed.groupBy("conv_id", "stretch").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb")).select("conv_id", "stretch", xor("sa", outer).alias("ba"), xor("sb", outer).alias("bb"))
    inner = Window.partitionBy("conv_id", "stretch").orderBy("k").rowsBetween(*_earlier)
    run = placed.join(bases, ["conv_id", "stretch"]).select("conv_id", "k", "length", "chars", "a", "b", F.col("ba").bitwiseXOR(xor("a", inner)).alias("ua"), F.col("bb").bitwiseXOR(xor("b", inner)).alias("ub"))
    depth = F.col("k") + 1
    node = node_name(depth, F.col("ua").bitwiseXOR(F.col("a")), F.col("ub").bitwiseXOR(F.col("b")))
    return run.select("conv_id", depth.alias("depth"), node.alias("node"), node_name(F.col("k"), F.col("ua"), F.col("ub")).alias("up"), "chars", (depth == F.col("length")).alias("ends"))


def rollup(nodes: DataFrame) -> DataFrame:
    """(node, up, depth, leaves, saved) with leaves and saved summed over each node's subtree, by pointer jumping."""
    now, step = materialise(nodes.select("node", F.col("up").alias("jump"), "depth", "leaves", "saved"), "jumps"), 1
    while not now.where("jump is not null").isEmpty():
        # the sums of nodes `step` above: fewer rows than nodes before they are sent, one a node behind
        more = now.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        # an ancestor has a pointer itself only from a depth of `step` on
        on = now.where(F.col("jump").isNotNull()).select(F.col("node").alias("jump"), F.col("jump").alias("_next"))
        far = now.where(F.col("depth") >= 2 * step).join(on, "jump").select("node", F.col("_next").alias("jump"), "depth", "leaves", "saved")
        near = now.where(F.col("depth") < 2 * step).withColumn("jump", F.lit(None).cast("string"))
        added = far.unionByName(near).join(more, "node", "left")
        last, now = now, materialise(added.select("node", "jump", "depth", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved"))), "jumps")
        drop(last)
        step *= 2
    return now.select("node", "leaves", "saved")


def ending_digests(ends: DataFrame) -> DataFrame:
    """(node, conv_id) to (node, ends_sha256): of each node's ids, ascending, joined by commas."""
    parts = _parts(ends.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for node, own in groupby(zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist()), key=lambda r: r[0]):
                ids = [c for _, c in own]
                rows += [(node, ids[at], ",".join(map(str, ids[at : at + PIECE]))) for at in range(0, len(ids), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["node", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, h = None, None
        for b in batches:
            done = []
            for node, piece in zip(b.column("node").to_pylist(), b.column("piece").to_pylist()):
                if node == held:
                    h.update(b",")
                else:
                    if held is not None:
                        done.append((held, h.hexdigest()))
                    held, h = node, hashlib.sha256()
                h.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["node", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([h.hexdigest()])], names=["node", "ends_sha256"])

    cut = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node string, first long, piece string")
    return cut.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(digests, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of turns (conv_id, k, a, b, chars, length); convs has conv_id and length of all conversations, also of those without turns."""
    rows = materialise(prefix_rows(turns), "prefixes")
    zero = F.lit(0).cast("long")
    root = node_name(zero, zero, zero)
    every = rows.groupBy("node").agg(F.min("depth").alias("depth"), F.min("up").alias("up"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(root.alias("node"), zero.alias("depth"), F.lit(None).cast("string").alias("up"), "conv_id", "n_convs", zero.alias("chars"))
    nodes = every.unionByName(top)
    children = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero))
    counted = materialise(counted.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "nodes")
    ends = rows.where("ends").select("node", "conv_id").unionByName(convs.where("length = 0").select(root.alias("node"), "conv_id"))
    summed = counted.drop("leaves", "saved", "chars").join(rollup(counted), "node").join(ending_digests(ends), "node", "left")
    parents = counted.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    below = summed.where("up is not null").join(parents, "up")
    whole = below.unionByName(summed.where("up is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )


def conversation_trie(rows: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they are: rows of conv_id, turn, role and text."""
    turns = materialise(number_turns(rows, **columns), "numbered")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    return prefix_trie(turns.join(convs, "conv_id"), convs)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that those of a hundred share first turns."""
    turns = materialise(number_turns(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "numbered")
    return prefix_trie(*share_first_turns(turns))


OP12_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT conv_id, count(*) AS n, hex(encode(conv_id::VARCHAR)) AS bytes FROM o GROUP BY 1),
h AS (SELECT conv_id, n, xor(4294967295::BIGINT, list_reduce(list_transform(generate_series(1, length(bytes), 2), lambda k: ('0x' || substr(bytes, k::BIGINT, 2))::BIGINT),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END), 4294967295::BIGINT)) % 6 AS h FROM z),
r AS (SELECT h.conv_id, o.k, 0 AS own, role, text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100 AND o.k < h.h UNION ALL SELECT h.conv_id, o.k, 1, role, text FROM h JOIN o ON o.conv_id = h.conv_id AND o.k >= h.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, md5(string_agg(md5(role) || md5(text), '') OVER w) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, k)),
a AS (SELECT conv_id, 0 AS depth, 0 AS chars, '' AS node FROM h UNION ALL SELECT * FROM p),
e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(node, depth) AS node FROM a GROUP BY 1) GROUP BY 1),
n AS (SELECT node, min(depth)::BIGINT AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM a GROUP BY 1),
u AS (SELECT n.*, q.node AS up FROM n LEFT JOIN a q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
c AS (SELECT up AS node, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT q.node, sum(CASE WHEN c.node IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM n JOIN a q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN c ON c.node = n.node GROUP BY 1)
SELECT u.conv_id, u.depth, t.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u JOIN s ON s.node = u.node LEFT JOIN c ON c.node = u.node LEFT JOIN e ON e.node = u.node LEFT JOIN n t ON t.node = u.up"""
