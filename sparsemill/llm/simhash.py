"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprint. 64 bits over a text's word shingles: a bit is set if it is set in over half the
shingles' XXH64 values (repeats count). Two fingerprints link at `MOST` = 4 or fewer differing bits.

Method. Equal fingerprints are one class. A fingerprint is cut into three segments (22, 21, 21
bits), each read as a word of the perfect [23,12,7] Golay code. All codewords within distance 4 of
a segment (one, or six when the nearest is 3 away) are its keys; two segments at distance 2 or less
share a key, as the code covers the space at radius 3. Pigeonhole over 4 errors in three segments
a <= b <= c: either c <= 2, and all three segments share a key; or a = 0 and b <= 1, and one segment
is equal while another shares a key. So every pair that links meets under a compound key of 3
Golay indices, or of an exact segment and a Golay index. Members of a key are then verified by
their true distance.

Within a key no list of pairs is made: a search takes one member, finds all unvisited ones within
distance, and goes on from those, so that a dense group costs about a row a member, and at most
n - 1 links leave it. A bucket of keys reduces its links to stars around the least member. Components
of the links between classes come from large-star/small-star rounds over a table in the shared
folder. No fingerprint, link or component is collected to the driver.

Defined results: null or wordless texts have fingerprint zero and link like any other; null ids are
kept, and count as larger than all others when a component is named (a component with no other
id is named null); repeated rows get equal results; an empty table gives an empty result; columns
named like the results are replaced, all others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparsemill.llm.common import NULL_ID, as_bytes, bounded_batches, cores, drop, in_struct, lean, load, materialise, parts_for, slices

SHINGLE, SEED, MOST = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits)
#: Entries of one bucket of keys; keys a fingerprint has on average, for sizing only.
BUCKET_ENTRIES, KEYS_EACH = 1 << 19, 190
#: Members of a key that are compared at once, in a block.
BLOCK = 1 << 22


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text (UTF-8)."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    h = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())])
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = np.frombuffer(h[8 * at : 8 * (at + (1 << 16))], np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def add_fingerprint(df: DataFrame, *, text_col: str = "text", shingle: int = SHINGLE, out_col: str = "_fp") -> DataFrame:
    """df without text_col, with its fingerprint as a signed 64-bit integer."""
    bounded_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [c for c in batch.schema.names if c != text_col]
            for part in slices(batch, text_col):
                fps = np.array([fingerprint(t, shingle) for t in as_bytes(part.column(text_col))], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fps)], names=[*keep, out_col])

    return df.mapInArrow(work, T.StructType([*(f for f in df.schema.fields if f.name != text_col), T.StructField(out_col, T.LongType())]))


# ---------------------------------------------------------------- Golay keys


class Golay:
    """The [23,12,7] code by its generator polynomial; keys are all codewords within distance 4."""

    POLY = 0b101011100011

    def __init__(self):
        remainder = np.arange(1 << 11, dtype=np.int64)

        def rest(x: int) -> int:
            for k in range(22, 10, -1):
                if x >> k & 1:
                    x ^= self.POLY << (k - 11)
            return x

        unit = [rest(1 << k) for k in range(23)]
        self.syndromes = []  # of each byte of a word
        for low in (0, 8, 16):
            t = np.zeros(256, dtype=np.int64)
            for k in range(min(8, 23 - low)):
                t ^= np.where(np.arange(256) >> k & 1, unit[low + k], 0)
            self.syndromes.append(t)
        #: Error patterns of weight 4 or less by syndrome: six at most; the first is repeated to fill.
        found: list[list[int]] = [[] for _ in remainder]

        def grow(pattern: int, syndrome: int, begin: int, weight: int) -> None:
            found[syndrome].append(pattern)
            if weight < 4:
                for k in range(begin, 23):
                    grow(pattern | 1 << k, syndrome ^ unit[k], k + 1, weight + 1)

        grow(0, 0, 0, 0)
        assert max(map(len, found)) == 6
        self.number = np.array([len(f) for f in found])
        self.patterns = np.array([f + f[:1] * (6 - len(f)) for f in found], dtype=np.int64)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword indices near each word, n x 6, and how many of the six count."""
        s = self.syndromes[0][words & 255] ^ self.syndromes[1][words >> 8 & 255] ^ self.syndromes[2][words >> 16]
        return (words[:, None] ^ self.patterns[s]) >> 11, self.number[s]


_golay: list[Golay] = []


def compound_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of its fingerprint) for unsigned 64-bit fingerprints; no key twice for one of them."""
    if not _golay:
        _golay.append(Golay())
    words = [((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    near = [_golay[0].keys(w) for w in words]
    keys, owner = [], []

    def put(kind: int, parts: list[tuple[np.ndarray, int]], valid: np.ndarray) -> None:
        key = np.full(valid.shape, kind, dtype=np.uint64)
        for values, bits in parts:
            key = (key << np.uint64(bits)) | values.astype(np.uint64)
        at = np.nonzero(valid)
        keys.append(key[at])
        owner.append(at[0])

    six = np.arange(6)
    use = [six < n[:, None] for _, n in near]
    (a, _), (b, _), (c, _) = near
    put(1, [(a[:, :, None, None], 12), (b[:, None, :, None], 12), (c[:, None, None, :], 12)], use[0][:, :, None, None] & use[1][:, None, :, None] & use[2][:, None, None, :])
    for kind, (i, j) in enumerate(permutations(range(3), 2), start=2):
        put(kind, [(words[i][:, None], 23), (near[j][0], 12)], use[j])
    return np.concatenate(keys), np.concatenate(owner)


# ---------------------------------------------------------------- links within a key and a bucket


def _count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def group_links(fps: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """Links (indices) that connect what is connected within distance `most`; a forest."""
    rest, out = np.arange(len(fps)), []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            k = front.pop()
            near = _count_bits(fps[rest] ^ fps[k]) <= most
            if near.any():
                hit = rest[near].tolist()
                out += [(k, x) for x in hit]
                front += hit
                rest = rest[~near]
    return out


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What these links connect, as (member, least member) of each component."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(names)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([top(x) for x in range(len(names))], dtype=np.int64)
    member = np.flatnonzero(root != np.arange(len(names)))
    return names[member], names[root[member]]


def bucket_links(keys: np.ndarray, fps: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """What links connect under some key, as stars: (member, least member). Buckets that see one group alike say the same."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(edges)
    one, two = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    pair = edges[:-1][size == 2]
    ok = _count_bits(fps[pair] ^ fps[pair + 1]) <= most
    one.append(fps[pair[ok]])
    two.append(fps[pair[ok] + 1])
    for k in np.flatnonzero(size > 2).tolist():
        members = fps[edges[k] : edges[k + 1]]
        if links := group_links(members, most):
            a, b = np.array(links).T
            one.append(members[a])
            two.append(members[b])
    a, b = np.concatenate(one), np.concatenate(two)
    return stars(a, b)


def links(classes: DataFrame, fp_col: str, n: int, *, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints of classes that verified links connect; together they connect all that links do."""
    buckets = parts_for(n * KEYS_EACH, BUCKET_ENTRIES, cores(classes.sparkSession))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                keys, owner = compound_keys(fps)
                bucket = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                keys, owner, bucket = keys[order], owner[order], bucket[order]
                names, cuts = np.unique(bucket, return_index=True)
                cuts = [*cuts.tolist(), len(keys)]
                blobs = [keys[a:b].tobytes() + fps[owner[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "data"])

    def meet(rows: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint64) for x in rows["data"].to_pylist()]
        a, b = bucket_links(np.concatenate([x[: len(x) // 2] for x in blobs]), np.concatenate([x[len(x) // 2 :] for x in blobs]), most)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    asked = classes.select(F.col(fp_col)).mapInArrow(spread, "bucket long, data binary")
    return asked.groupBy("bucket").applyInArrow(lean(meet), "a long, b long").distinct()


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b): root is the least node reachable.

    Large-star and small-star rounds in turn; each round is a table in the shared folder, and the
    rounds stop when one leaves the set of links as it was.
    """
    spark = edges.sparkSession
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = materialise(edges.where("a != b").select(most.alias("u"), least.alias("v")).distinct(), "links")
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = digest(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        last, now = now, materialise(small, "links")
        drop(last)
        before, seen = seen, digest(now)
        if seen == before:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def near_duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = MOST,
    fingerprint_col: str = "fingerprint", component_col: str = "component_id",
) -> DataFrame:
    """df without text_col, with each row's fingerprint (16 hex digits) and component (least id in it)."""
    taken = {fingerprint_col.lower(), component_col.lower()}
    carried = [c for c in df.columns if c != text_col and (c.lower() not in taken or c == id_col)]
    slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), in_struct(carried))
    marked = materialise(add_fingerprint(slim, text_col="_text", shingle=shingle), "fingerprints")
    least = F.min(F.coalesce(F.col("_id"), F.lit(NULL_ID)))
    classes = materialise(marked.groupBy("_fp").agg(least.alias("_least")), "classes")
    found = components(links(classes, "_fp", classes.count(), most=most))
    named = classes.join(found, classes["_fp"] == found["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    ids = named.groupBy("_root").agg(F.min("_least").alias("_first"))
    # most classes are alone: only linked ones need another id than their own
    out = marked.join(named.join(ids, "_root").select("_fp", "_first"), "_fp")
    return out.select(*(F.col("_rest").getField(c).alias(c) for c in carried), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias(fingerprint_col), F.nullif(F.col("_first"), F.lit(NULL_ID)).alias(component_col))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
