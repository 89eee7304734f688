"""Queries over the whole of small tables, against plain Python."""

import random
from collections import Counter, defaultdict

import pytest

from sparsemill.operators import analysis as an
from sparsemill.operators import partition as pt
from sparsemill.plans import registry


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables, and their rows."""
    rng, n = random.Random(2), 130
    d = str(tmp_path_factory.mktemp("tables"))
    lineitem = [(rng.randrange(n), (rng.randrange(n) + k) % n, float(rng.randrange(1, 50))) for k in range(150)]
    lineitem += [(r + k, r + off + k, 2.0) for r, off in ((3, 47), (20, 31), (66, -58), (100, -41), (40, 3)) for k in range(3)]
    spark.createDataFrame([(k, k % 50 + 1) for k in range(n)], "p_partkey long, p_size int").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(lineitem, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return d, n, lineitem


def test_ranges_owners_sizes_and_offsets_cover_every_needed_column(spark, small):
    d, n, lineitem = small
    each, cells = n // registry.PARTS, {(r, c) for r, c, _ in lineitem}
    need, groups = defaultdict(set), Counter()
    for r, c in cells:
        part = min(r // each, registry.PARTS - 1)
        need[part].add(c)
        groups[part, (r - part * each) // registry.SHARD_WIDTH, c - r] += 1
    end = lambda part: n if part == registry.PARTS - 1 else (part + 1) * each
    kept = [g for g, k in groups.items() if k >= registry.DENSE]
    for part, block, off in kept:
        first = part * each + block * registry.SHARD_WIDTH
        need[part] |= {c for c in range(first + off, min(first + registry.SHARD_WIDTH, end(part)) + off) if 0 <= c < n}
    owner = lambda c: min(c // each, registry.PARTS - 1)

    got = defaultdict(list)
    for r in registry.data_ranges(spark, d).collect():
        got[r["part"]] += range(r["range_start"], r["range_end"])
    assert {p: sorted(c) for p, c in got.items()} == {p: sorted(c) for p, c in need.items()}
    got = sorted((r["part"], r["owner"], c) for r in registry.owner_ranges(spark, d).collect() for c in range(r["range_start"], r["range_end"]))
    assert got == sorted((p, owner(c), c) for p, cs in need.items() for c in cs)
    left = {p: sum(owner(c) < p for c in need[p]) for p in range(registry.PARTS)}
    got = {r["part"]: (r["left_size"], r["right_size"], r["total_buffer_size"]) for r in registry.halo_sizes(spark, d).collect()}
    assert got == {p: (left[p], sum(owner(c) > p for c in need[p]), len(need[p])) for p in range(registry.PARTS)}

    def position(part, block, off):
        i = part * each + block * registry.SHARD_WIDTH + off
        if i < 0:
            return i
        if owner(i) == part:
            return left[part] + i - part * each
        before = sum(c < i and owner(c) != part for c in need[part])
        return before + (end(part) - part * each if owner(i) > part else 0)

    got = {(r["part"], r["block"], r["offset"]): r["position"] for r in registry.vector_offsets(spark, d).collect()}
    assert got == {g: position(*g) for g in kept} and pt.NOT_FOUND not in got.values()


def test_sums_take_every_part(spark, small):
    d, n, lineitem = small
    want = {k: k % 50 + 1.0 for k in range(n)}
    for _, c, v in lineitem:
        want[c] += v
    one_sided = set(range(n)) - {c for _, c, _ in lineitem}
    got = {r["idx"]: r["x"] for r in registry.vector_add(spark, d).collect()}
    assert got == want and {k % 3 == 0 for k in one_sided} == {True, False}


def test_comparison_has_every_noise_level(spark, tmp_path):
    """Levels 0 to 0.2 have both methods, 0.3 the baseline only, 0.4 the hybrid only."""
    rows = [(10 * u + k, u, kind, value + k) for u, kind, value in
            ((0, "click", 8.0), (0, "view", 2.0), (1, "click", 6.0), (1, "view", 3.0), (2, "click", 4.0), (2, "view", 7.0), (3, "click", 5.0), (4, "view", 9.0)) for k in (0, 2)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {round(r["noise_level"], 1): (r["baseline_mean_ms"], r["hybrid_mean_ms"], r["speedup"]) for r in registry.runtime_comparison(spark, str(tmp_path)).collect()}
    assert got == {0.0: (9.0, 3.0, 3.0), 0.1: (7.0, 4.0, 1.75), 0.2: (5.0, 8.0, 0.625), 0.3: (6.0, None, None), 0.4: (None, 10.0, None)}
    assert tuple(registry.speedup_extremes(spark, str(tmp_path)).first()) == (round((3 + 1.75 + 0.625) / 3, 6), 3.0, 0.625)


def test_bootstraps_take_ten_thousand_resamples(spark, tmp_path, monkeypatch):
    rows = [(100 * k + u, u, kind, 1.0 + (7 * k + u) % 11) for k in range(12) for u, kind in ((0, "click"), (5, "view"))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    m, d = registry.measurements(spark, str(tmp_path)), str(tmp_path)
    # the queries round to six digits, as all statistics that SQL repeats
    whole = registry._rounded(an.bootstrap_ci(m, "noise_level", "method", resamples=10_000), "median", "ci_low", "ci_high")
    assert sorted(map(tuple, registry.bootstrap_ci(spark, d).collect())) == sorted(map(tuple, whole.collect()))
    whole = registry._rounded(an.bootstrap_speedup_ci(m, "baseline", "hybrid", "noise_level", resamples=10_000), "speedup", "ci_low", "ci_high")
    assert registry.bootstrap_speedup_ci(spark, d).collect() == whole.collect()


def test_last_writer_keeps_tied_cells(spark, tmp_path):
    rows = [(1, 1, 5, 7, 3.0), (1, 1, 5, 7, 4.0), (2, 1, 5, 7, 1.0), (3, 1, 5, 8, 9.0), (3, 1, 5, 8, 2.0), (1, 2, 6, 7, 6.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, registry.coo_dedup_last(spark, str(tmp_path)).select("row", "col", "val").collect()))
    assert got == [(5, 7, 1.0), (5, 8, 9.0), (6, 7, 6.0)]


def test_diagonals_reach_every_user(spark, tmp_path):
    rows = [(u, f"2024-01-01 {(5 * u + k) % 24:02d}:00:00") for u in range(40) for k in range(3)]
    events = spark.createDataFrame(rows, "user_id long, t string").selectExpr("user_id", "cast(t as timestamp) as ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    cells = [(u, int(t[11:13])) for u, t in rows]
    got = registry.dia_round_trip(spark, str(tmp_path)).select("row", "col", "val").collect()
    assert sorted(map(tuple, got)) == sorted((r, c, 1.0) for r, c in cells)
    got = registry.block_offset_counts(spark, str(tmp_path)).select("block", "offset", "n").collect()
    assert {(r["block"], r["offset"]): r["n"] for r in got} == Counter((r // 8, c - r) for r, c in cells)
