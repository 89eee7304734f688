"""Documents whose distinct five-word shingles have a Jaccard similarity of at least 0.8, decided exactly.

`simhash` links fingerprints at few differing bits, which texts of a few edits may exceed. Here the similarity itself
decides. Its search has three steps.

Keys. A text's shingles are put in one order for all texts (common ones last, so that they are rarely asked for, then
by hash). Two sets of similarity 0.8 or more have their first common shingle among the first n - ceil(0.8 n) + 1 of
both, so texts meet under these shingles, and no such pair is missed, whatever is taken for common: the shingles that
COMMON documents of a sample have, which grows with the corpus so that a key that is not common has about KEY_DOCS documents at most.

Groups. Under a key, texts whose sizes allow 0.8 and whose 256-bit SimHashes differ in at most LOOSE bits (LOOSE_FEW
if one has fewer than FEW shingles) are put in one group. At 0.8 40 bits differ on average, with a deviation of 6
(48 for the smallest sets), so a pair at 0.8 is past the limit about once in 10^10 times. The limit only keeps groups small.
All texts that ask for one common shingle are put in one group without a look at their pairs: four fifths of such a text is common
shingles.

Decision. |x & y| / |x | y| >= 0.8 in whole numbers, by prefixes again, among the shingle sets of a group. Small groups are
packed into tasks of about SET_BYTES. A larger group is first reduced: all its sets are compared with a few pivots of its own,
wherever they are. 1 - similarity is a metric, so a set at distance d from a pivot that it links to has links
only to sets that also link to that pivot, if all others are farther from it than d + 0.2; such sets leave with their link to the pivot.
What is still too large after that is cut into blocks, and each pair of blocks is one task. So no task holds a large
group, and a group of alike texts costs a few passes. Short texts and texts that repeat themselves are searched like all others;
only texts without a word take no part.

Distribution. Keys go to buckets by hash, packed. Keys with up to SMALL members are compared pairwise, larger ones
searched member by member; a bucket gives stars around the least member, never pairs, and no join has pairs.
Null ids must not occur (the caller names nodes).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparsemill.llm import simhash
from sparsemill.llm.common import U64, as_bytes, bounded_batches, cores, drop, free_shuffles, lean, materialise, mix, parts_for, slices

SHINGLE, WORDS, SMALL = 5, 4, 24
_COLUMNS = [f"_w{k}" for k in range(WORDS)]
LOOSE, LOOSE_FEW, FEW = 80, 96, 32
KEY_ENTRIES, SET_BYTES = 1 << 19, 6 << 20
#: Documents of the sample at least, those of it that make a shingle common, most documents of other keys, most common shingles held by a task.
SAMPLE, COMMON, KEY_DOCS, HUBS = 4096, 8, 1 << 14, 1 << 21
#: Of a large group: sets that pivots are chosen from, pivots a round, rounds at most, distance of a link.
PROBES, PIVOTS, ROUNDS, NEAR = 32, 4, 6, 0.2
#: What is broadcast, at most.
BROADCAST_BYTES = 32 << 20
_SIZED = np.dtype([("node", "<i8"), ("n", "<i8"), ("bits", "<u8", (WORDS,))])

def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (lower-case; the whole text if it has fewer words)."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=U64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(words) - n + 1)
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(starts[:k].tolist(), ends[min(n, len(words)) - 1 :].tolist())]), U64))


def fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _loose(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    least, most = np.minimum(x["n"], y["n"]), np.maximum(x["n"], y["n"])
    return (5 * least >= 4 * most) & (np.bitwise_count(x["bits"] ^ y["bits"]).sum(axis=1, dtype=np.int64) <= np.where(least < FEW, LOOSE_FEW, LOOSE))


def _meet(keys: np.ndarray, at: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (rows of docs) among those that share a key; they connect all that links under a key do."""
    order = np.lexsort((docs["node"][at], keys))  # a search begins with the least node, whatever the key
    keys, at = keys[order], at[order]
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(edges)
    found, held = np.zeros(0, np.int64), []
    reach = np.flatnonzero(np.repeat(size <= SMALL, size))
    for d in range(1, SMALL):
        reach = reach[reach + d < len(keys)]
        reach = reach[keys[reach + d] == keys[reach]]
        if not len(reach):
            break
        for lo in range(0, len(reach), 1 << 18):
            one, two = at[reach[lo : lo + (1 << 18)]], at[reach[lo : lo + (1 << 18)] + d]
            near = _loose(docs[one], docs[two])
            held.append(np.unique(one[near] * len(docs) + two[near]))
        found, held = np.unique(np.concatenate([found, *held])), []
    for k in np.flatnonzero(size > SMALL).tolist():
        own = at[edges[k] : edges[k + 1]]
        x, rest = docs[own], np.arange(size[k])
        while len(rest) > 1:
            front, rest = [int(rest[0])], rest[1:]
            while front and len(rest):
                f = front.pop()
                near = _loose(x[rest], x[f : f + 1])
                hit = rest[near]
                if len(hit):
                    held.append(own[f] * len(docs) + own[hit])
                    front += hit.tolist()
                    rest = rest[~near]
        if len(held) > 4096:
            found, held = np.unique(np.concatenate([found, *held])), []
    found = np.unique(np.concatenate([found, *held]))
    return found // max(1, len(docs)), found % max(1, len(docs))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that at least COMMON documents of the sample have; of more than HUBS, the most frequent. docs: _hash, text."""
    n = docs.count()
    step = max(1, n // max(SAMPLE, n * COMMON // KEY_DOCS))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t) for t in as_bytes(part.column("text"))]).view(np.int64))], names=["shingle"])

    some = docs.where(F.pmod(F.xxhash64("_hash"), F.lit(step)) == 0).select("text")
    counted = materialise(some.mapInArrow(take, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON), "common")
    least = COMMON
    while counted.where(F.col("count") >= least).count() > HUBS:
        least *= 2
    return np.sort(counted.where(F.col("count") >= least).select("shingle").toArrow()["shingle"].to_numpy().view(U64))


def asked_for(n):
    """How many of the first shingles of a set of n are its keys."""
    return n - (4 * n + 4) // 5 + 1


def add_keys(df: DataFrame, text_col: str, common: np.ndarray) -> DataFrame:
    """df without text_col, with _fp as in simhash, _set (a hash of all shingles), _n (how many), _w0 to _w3, _keys and _hubs (the first shingles that are not common, or are); null but _fp for texts without a word."""
    bounded_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            keep = [c for c in batch.schema.names if c != text_col]
            for part in slices(batch, text_col):
                marks = []
                for text in as_bytes(part.column(text_col)):
                    own = shingles(text)
                    n, mark = len(own), [None] * (4 + WORDS)
                    if n:
                        late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own if len(common) else np.zeros(n, dtype=bool)
                        keys, k = own[~late], asked_for(n)
                        mark = [signed(xxhash.xxh64_intdigest(own.tobytes())), n, *(signed(fingerprint(mix(own ^ U64(w)))) for w in range(WORDS)), keys[:k].tobytes(), own[late][: max(0, k - len(keys))].tobytes()]
                    marks.append((signed(simhash.fingerprint(text)), *mark))
                columns = list(zip(*marks))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *(pa.array(list(x), pa.int64()) for x in columns[:-2]), *(pa.array(list(x), pa.binary()) for x in columns[-2:])], names=[*keep, "_fp", "_set", "_n", *_COLUMNS, "_keys", "_hubs"]
                )

    fields = [f for f in df.schema.fields if f.name != text_col]
    return df.mapInArrow(work, T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in ("_fp", "_set", "_n", *_COLUMNS)), *(T.StructField(n, T.BinaryType()) for n in ("_keys", "_hubs"))]))


def hub_links(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all that ask for a common shingle. keyed: node, _hubs.

    A batch sends its own stars, and each shingle once with the least node that it is connected to there.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, blobs = batch.column("node").to_numpy(), batch.column("_hubs").to_pylist()
            hubs, at = np.frombuffer(b"".join(blobs), np.int64), np.repeat(np.arange(len(blobs)), [len(x) // 8 for x in blobs])
            names, hub = np.unique(hubs, return_inverse=True)
            member, least = simhash.stars(hub + len(node), at)
            top = np.arange(len(node) + len(names))
            top[member] = least
            first = np.full(len(top), np.iinfo(np.int64).max)
            np.minimum.at(first, top[: len(node)], node)
            mine, used = first[top], np.unique(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * len(used) + names.tolist(), pa.int64()), pa.array(np.concatenate((node[used], mine[len(node) :]))), pa.array(mine[np.concatenate((used, np.arange(len(node), len(top))))])], names=["hub", "a", "b"]
            )

    sent = materialise(keyed.where("octet_length(_hubs) > 0").select("node", "_hubs").mapInArrow(work, "hub long, a long, b long"), "hubs")
    named = sent.where("hub is not null")
    over = named.join(named.groupBy("hub").agg(F.min("b").alias("least")), "hub").select("a", F.col("least").alias("b"))
    return sent.where("hub is null").select("a", "b").unionByName(over).where("a != b").distinct()


def candidates(keyed: DataFrame, entries: int) -> DataFrame:
    """Pairs (a, b) of nodes that connect all that may be similar by other than common shingles. keyed: node, _n, _w0 to _w3, _keys (about `entries` in all)."""
    buckets = parts_for(entries, KEY_ENTRIES, cores(keyed.sparkSession))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                docs = np.empty(part.num_rows, dtype=_SIZED)
                docs["node"], docs["n"] = part.column("node").to_numpy(), part.column("_n").to_numpy()
                for k, c in enumerate(_COLUMNS):
                    docs["bits"][:, k] = part.column(c).to_numpy().view(U64)
                blobs = part.column("_keys").to_pylist()
                keys, at = np.frombuffer(b"".join(blobs), U64), np.repeat(np.arange(len(blobs)), [len(x) // 8 for x in blobs])
                bucket = (mix(keys) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                keys, at, bucket = keys[order], at[order], bucket[order]
                names, cuts = np.unique(bucket, return_index=True)
                cuts = [*cuts.tolist(), len(keys)]
                rows = []
                for x, y in zip(cuts, cuts[1:]):
                    used, local = np.unique(at[x:y], return_inverse=True)
                    rows.append((docs[used].tobytes(), keys[x:y].tobytes(), local.astype(np.uint16).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], names=["bucket", "docs", "keys", "at"])

    def meet(rows: pa.Table) -> pa.Table:
        docs = [np.frombuffer(x, _SIZED) for x in rows["docs"].to_pylist()]
        base = np.cumsum([0, *map(len, docs)])
        keys = np.concatenate([np.frombuffer(x, U64) for x in rows["keys"].to_pylist()])
        at = np.concatenate([np.frombuffer(x, np.uint16).astype(np.int64) + k for x, k in zip(rows["at"].to_pylist(), base.tolist())])
        every = np.concatenate(docs)
        one, two = _meet(keys, at, every)
        a, b = simhash.stars(every["node"][one], every["node"][two])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    asked = keyed.where("octet_length(_keys) > 0").select("node", "_n", *_COLUMNS, "_keys").mapInArrow(spread, "bucket long, docs binary, keys binary, at binary")
    return asked.groupBy("bucket").applyInArrow(lean(meet), "a long, b long").distinct()


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (indices) that connect all sets with a Jaccard similarity of 0.8 or more; a forest. The sets are not empty.

    A search goes on from each set that it finds; who may be similar to it shares one of its first shingles, rare ones first.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    names, flat, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), dtype=np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(names))
    owner, first = np.repeat(np.arange(len(sets)), size), np.concatenate(([0], np.cumsum(size)))
    flat = rank[flat]
    flat = flat[np.lexsort((flat, owner))]
    keep = asked_for(size)
    early = np.arange(len(flat)) - first[owner] < keep[owner]
    order = np.argsort(flat[early], kind="stable")
    members = owner[early][order]
    begin = np.searchsorted(flat[early][order], np.arange(len(names) + 1))
    begin, end = begin[:-1].tolist(), begin[1:].tolist()
    mark, alive, left, out = np.zeros(len(names), dtype=np.uint8), np.ones(len(sets), dtype=bool), len(sets), []
    for start in range(len(sets)):
        if not alive[start]:
            continue
        alive[start], left, front = False, left - 1, [start]
        while front and left:
            f = front.pop()
            met = []
            for t in flat[first[f] : first[f] + keep[f]].tolist():
                if end[t] > begin[t]:
                    seen = members[begin[t] : end[t]]
                    live = seen[alive[seen]]
                    members[begin[t] : begin[t] + len(live)] = live  # those that are found need not be met again
                    end[t] = begin[t] + len(live)
                    met.append(live)
            who = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
            who = who[5 * np.minimum(size[who], size[f]) >= 4 * np.maximum(size[who], size[f])]
            if not len(who):
                continue
            mark[flat[first[f] : first[f + 1]]] = 1
            ends = np.cumsum(size[who])
            at = np.repeat(first[who] - (ends - size[who]), size[who]) + np.arange(ends[-1])
            common = np.add.reduceat(mark[flat[at]], ends - size[who], dtype=np.int64)
            mark[flat[first[f] : first[f + 1]]] = 0
            hit = who[9 * common >= 4 * (size[f] + size[who])].tolist()
            out += [(f, x) for x in hit]
            front += hit
            alive[hit] = False
            left -= len(hit)
    return out


def _decide(rows: pa.Table) -> pa.Table:
    """Stars of the similar ones of each group among the rows root, node, set."""
    root, node, sets = rows["root"].to_numpy(), rows["node"].to_numpy(), rows["set"].combine_chunks()
    order = np.lexsort((node, root))
    cuts = [*np.flatnonzero(np.concatenate(([True], np.diff(root[order]) != 0))).tolist(), len(order)]
    one, two = [], []
    for x, y in zip(cuts, cuts[1:]):
        own = order[x:y]
        links = alike([np.frombuffer(sets[k].as_buffer(), U64) for k in own.tolist()])
        one += [node[own[a]] for a, _ in links]
        two += [node[own[b]] for _, b in links]
    a, b = simhash.stars(np.array(one, dtype=np.int64), np.array(two, dtype=np.int64))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def pivots(sets: DataFrame, turn: int) -> DataFrame:
    """root, pivots, psets: up to PIVOTS of PROBES sets of each group, first the one that most of them link to, then of the rest."""
    place = Window.partitionBy("root").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    probes = sets.select("root", "node").withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= PROBES).select("node")

    def pick(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        own = [np.frombuffer(x, U64) for x in rows["set"].to_pylist()]
        near = np.array([[9 * _common(x, y) >= 4 * (len(x) + len(y)) for y in own] for x in own])
        rest, picked = np.ones(len(own), dtype=bool), []
        while rest.any() and len(picked) < PIVOTS:
            picked.append(int(np.argmax((near & rest).sum(axis=1) * rest)))
            rest &= ~near[picked[-1]]
            rest[picked[-1]] = False
        at = rows.take(picked)
        return pa.table({"root": at["root"][:1], "pivots": pa.array([at["node"].to_pylist()], pa.list_(pa.int64())), "psets": pa.array([at["set"].to_pylist()], pa.list_(pa.binary()))})

    return sets.join(probes, "node", "left_semi").groupBy("root").applyInArrow(lean(pick), "root long, pivots array<long>, psets array<binary>")


def compared(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """root, node, bytes, pivots, near and d: whether each set links to each pivot of its group, and its distance."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            near, far = [], []
            for root, blob, psets in zip(batch.column("root").to_pylist(), batch.column("set").to_pylist(), batch.column("psets")):
                if root not in held:
                    held = {} if len(held) >= PROBES else held
                    held[root] = [np.frombuffer(x, U64) for x in psets.as_py()]
                x = np.frombuffer(blob, U64)
                common = [_common(x, p) for p in held[root]]
                near.append([9 * c >= 4 * (len(x) + len(p)) for c, p in zip(common, held[root])])
                far.append([1 - c / (len(x) + len(p) - c) for c, p in zip(common, held[root])])
            size = pa.array([len(x) for x in batch.column("set").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), size, batch.column("pivots"), pa.array(near, pa.list_(pa.bool_())), pa.array(far, pa.list_(pa.float64()))], names=["root", "node", "bytes", "pivots", "near", "d"])

    small = (chosen.select(F.sum(F.expr("aggregate(psets, 0L, (s, x) -> s + octet_length(x))"))).first()[0] or 0) <= BROADCAST_BYTES
    return sets.join(F.broadcast(chosen) if small else chosen, "root").select("root", "node", "set", "pivots", "psets").mapInArrow(work, "root long, node long, bytes long, pivots array<long>, near array<boolean>, d array<double>")


def reduced(sets: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links of all sets to pivots of their group, and the sets that may have other links."""
    seen = materialise(compared(sets, materialise(pivots(sets, turn), "pivots")), "compared")
    at = lambda c, k: F.get(c, F.lit(k))
    least = seen.groupBy("root").agg(*(F.min(F.when(~at("near", k), at("d", k))).alias(f"m{k}") for k in range(PIVOTS)))
    over = lambda k: at("near", k) & (F.col(f"m{k}").isNull() | (at("d", k) + NEAR + 1e-9 < F.col(f"m{k}")))
    done = reduce(lambda x, y: x | y, (F.coalesce(over(k), F.lit(False)) for k in range(PIVOTS)))
    rest = materialise(sets.join(seen.join(least, "root").where(~done).select("node"), "node", "left_semi"), "sets")
    links = seen.select(F.col("node").alias("a"), F.explode(F.arrays_zip("pivots", "near")).alias("x")).where("x.near and x.pivots != a").select("a", F.col("x.pivots").alias("b"))
    return links, rest


def similar_in(groups: DataFrame, texts: DataFrame, *, set_bytes: int = SET_BYTES) -> DataFrame:
    """Pairs (a, b) of nodes that connect all similar ones of each group. groups: node, root, _n (shingles); texts: node, text (rows of equal node are equal)."""
    spark = texts.sparkSession

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t).tobytes() for t in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("root"), part.column("node"), pa.array(sets, pa.binary())], names=["root", "node", "set"])

    def decided(sets: DataFrame, total: int) -> DataFrame:
        buckets = parts_for(total, set_bytes, cores(spark))
        return sets.groupBy(F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("bucket")).applyInArrow(lean(_decide), "a long, b long")

    bytes_of = lambda sets, n: sets.groupBy("root").agg(F.sum(n + 16).alias("bytes"))
    total = lambda sizes: sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    sizes = materialise(bytes_of(groups, 8 * F.col("_n")), "sizes")
    big, left = sizes.where(F.col("bytes") > set_bytes), F.col("bytes") <= set_bytes
    held, number = total(big)
    in_groups = lambda g: texts.join(g.select("node", "root"), "node").dropDuplicates(["node"]).select("root", "node", "text").mapInArrow(take, "root long, node long, set binary")
    if not number:
        return decided(in_groups(groups), total(sizes)[0])
    out = [decided(in_groups(groups.join(big, "root", "left_anti")), total(sizes.where(left))[0])]
    sets = materialise(in_groups(groups.join(big, "root", "left_semi")), "sets")
    for turn in range(ROUNDS):
        links, rest = reduced(sets, turn)
        sizes = materialise(bytes_of(rest, F.octet_length("set")), "sizes")
        out += [links, decided(rest.join(sizes.where(left), "root", "left_semi"), total(sizes.where(left))[0])]
        big, before = sizes.where(~left), held
        sets, (held, number) = rest.join(big, "root", "left_semi"), total(big)
        if not number or 10 * held > 9 * before:
            break
    if number:
        own, other = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        cut = sets.join(big.select("root", F.ceil(2 * F.col("bytes") / set_bytes).alias("blocks")), "root").select("root", "node", "set", own.alias("own"), other)
        pairs = cut.select("root", "node", "set", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        out.append(pairs.groupBy("root", "lo", "hi").applyInArrow(lean(_decide), "a long, b long"))
    return reduce(DataFrame.unionByName, out)


def first_of_groups(docs: DataFrame) -> DataFrame:
    """(_id, _hash) of the first row of each group of near copies. docs: _id, _hash (one for each different row), text.

    Rows link by equal fingerprints, by simhash's links, and by a similarity of 0.8. Only classes of equal
    fingerprints and shingles, each named by its first row, take part in the search.
    """
    spark = docs.sparkSession
    marks = materialise(add_keys(docs.select("_id", "_hash", "text"), "text", common_shingles(docs)), "marks")
    classes = materialise(marks.groupBy("_fp", "_set", "_n").agg(F.min(F.struct("_id", "_hash")).alias("_first")).withColumn("node", F.col("_first._hash")), "classes")
    n, entries = classes.agg(F.count("*"), F.coalesce(F.sum(F.expr("_n div 5 + 1")), F.lit(0))).first()
    named = lambda key: classes.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("node").alias("b"))
    narrow, wide = (materialise(named(key), "names") for key in ("_fp", "_set"))
    same = [classes.join(names, key).select(F.col("node").alias("a"), "b") for key, names in (("_fp", narrow), ("_set", wide))]
    found = simhash.links(narrow, "_fp", n)
    found = materialise(found.join(narrow.select(F.col("_fp").alias("a"), F.col("b").alias("x")), "a").join(narrow.select(F.col("_fp").alias("b"), F.col("b").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    free_shuffles(spark)
    keyed = marks.withColumnRenamed("_hash", "node").dropDuplicates(["node"]).join(wide.select(F.col("b").alias("node")), "node", "left_semi")
    near = materialise(candidates(keyed, entries).unionByName(hub_links(keyed)), "candidates")
    groups = simhash.components(near)
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    groups = materialise(groups.join(classes.select("node", "_n"), "node"), "groups")
    free_shuffles(spark)
    similar = materialise(similar_in(groups, docs.select(F.col("_hash").alias("node"), "text")), "similar")
    free_shuffles(spark)
    drop(marks, near, groups)
    edges = same[0].unionByName(same[1]).unionByName(found).unionByName(similar)
    rooted = classes.join(simhash.components(edges), "node", "left").withColumn("_root", F.coalesce("root", "node"))
    return rooted.groupBy("_root").agg(F.min("_first").alias("_first")).select("_first.*")
