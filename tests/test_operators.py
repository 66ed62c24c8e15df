"""Operators against brute force on small made-up tables."""

import datetime
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import reads as R
from strandloom.functions import scores
from strandloom.operators import cnv, depth, evidence, intervals, nodes, ranks, twin, variants
from strandloom.operators.graph import connected_components


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "path": [(i, i + 1) for i in range(200)],
        "star": [(7, i) for i in range(400)],
        "none": [],
    }[shape]
    df = spark.createDataFrame([(a, b) for a, b in edges], "src long, dst long")
    rows = connected_components(df).collect()
    assert {r.node: r.component for r in rows} == components(edges) and len(rows) == len(components(edges))


def test_components_of_nulls_and_loops(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3), (None, None), (4, 5)], "src long, dst long")
    assert sorted(map(tuple, connected_components(df).collect())) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4)]


def boxes(rng, n):
    out = []
    for i in range(n):
        s = rng.randrange(100_000)
        out.append((i, rng.randrange(3), s, s + rng.choice([0, 1, 50, 5000, 30_000])))
    return out


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(2)
    a, b = boxes(rng, 120), boxes(rng, 100)
    schema = "id long, tid int, start int, end int"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3]}
    got = [(r.id, r.b_id) for r in intervals.overlap_join(da, db).collect()]
    assert set(got) == want and len(got) == len(want)
    inside = {(x, y) for x, y in want if b[y][2] >= a[x][2] and b[y][3] <= a[x][3]}
    assert {(r.id, r.b_id) for r in intervals.overlap_join(da, db, how="contain").collect()} == inside


def test_twin_windows_equal_counting(spark):
    rng = random.Random(3)
    rows = [(0, p := rng.randrange(6000), p + 50, 60, f"b{rng.randrange(6)}", 0) for _ in range(60)]
    reads = spark.createDataFrame(rows, "tid int, start int, end int, mapq int, bcd string, flag int")
    got = {r.idx: (r.n1, r.n2, r.n0) for r in twin.twin_windows(reads, spark.createDataFrame([(0, 7000)], "tid int, length int"), window=500, shift=100).collect()}
    for idx in range(71):
        left = {r[4] for r in rows if idx - 5 <= r[1] // 100 <= idx - 1}
        right = {r[4] for r in rows if idx <= r[1] // 100 <= idx + 4}
        want = (len(left), len(right), len(left & right))
        assert got.get(idx, (0, 0, 0)) == want


def test_model_recovers_its_law(spark):
    rng = np.random.default_rng(4)
    n1, n2, d = rng.integers(50, 200, 500), rng.integers(50, 200, 500), rng.uniform(5000, 15_000, 500)
    n0 = np.exp(-1.0 + 0.6 * np.log(n1) + 0.3 * np.log(n2) - 2e-5 * d)
    rows = [(int(a), int(b), float(c), 0.0, float(x)) for a, b, c, x in zip(n1, n2, n0, d)]
    df = spark.createDataFrame(rows, "n1 long, n2 long, n0 double, c1 double, c2 double")
    coef = twin.fit_model(df.where("n0 >= 1"), {"n1": (0, 1e9), "n2": (0, 1e9)})
    assert np.allclose(coef, (-1.0, 0.6, 0.3, -2e-5), rtol=1e-4)


def test_dense_nodes_equal_all_pairs(spark):
    rng = random.Random(5)
    pts = [(i, "33", 0, rng.randrange(3000), 1, rng.randrange(3000)) for i in range(150)]
    df = spark.createDataFrame(pts, "key long, end_type string, x_tid int, x_pos int, y_tid int, y_pos int")
    near = defaultdict(set)
    for p in pts:
        for q in pts:
            if abs(p[3] - q[3]) < 250 and abs(p[5] - q[5]) < 250:
                near[p[0]].add(q[0])
    core = {k for k, v in near.items() if len(v) >= 3}
    comps = components([(a, b) for a in core for b in near[a] & core])
    sizes = defaultdict(int)
    for c in comps.values():
        sizes[c] += 1
    want = {(k, c) for k, c in comps.items() if sizes[c] >= 3}
    assert {(r.key, r.component_id) for r in nodes.cluster(df, "key", 250, 3).collect()} == want


def greedy_segments(rows, alpha, sigma):
    rows = [list(r) for r in rows]
    while len(rows) > 1:
        z = [abs(a[3] / a[2] - b[3] / b[2]) / sigma * math.sqrt(a[2] * b[2] / (a[2] + b[2])) for a, b in zip(rows, rows[1:])]
        k = min(range(len(z)), key=lambda i: z[i])
        if z[k] > alpha:
            break
        a, b = rows[k], rows.pop(k + 1)
        rows[k] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
    return [tuple(r) for r in rows]


def test_segments_of_clear_levels_equal_the_strict_order(spark):
    rng = random.Random(6)
    levels = [2.0] * 80 + [8.0] * 60 + [2.0] * 70 + [0.2] * 50
    segs = [(0, i, i, 1, v + rng.uniform(-0.3, 0.3)) for i, v in enumerate(levels)]
    df = spark.createDataFrame(segs, "tid int, start int, end int, n long, s double")
    got = sorted((r.start, r.end, r.n) for r in cnv.merge_segments(df, 4.0, 2.0).collect())
    assert got == [r[:3] for r in greedy_segments([s[1:] for s in segs], 4.0, 2.0)]


@pytest.mark.parametrize(("shape", "alpha"), [("ramp", 1.5), ("ramp", 40.0), ("ties", 2.0), ("noise", 3.0)])
def test_strict_order_of_ramps_and_ties(spark, shape, alpha):
    rng = random.Random(8)
    value = {"ramp": lambda i: 0.37 * i, "ties": lambda i: float(i % 3), "noise": lambda i: rng.gauss(5, 3)}[shape]
    segs = [(t, 10 * i, 10 * i + 9, 10, 10 * value(i)) for t in (0, 1) for i in range(150)]
    got = cnv.merge_segments(spark.createDataFrame(segs, "tid int, start int, end int, n long, s double").repartition(3), alpha, 1.0).collect()
    for t in (0, 1):
        mine = sorted((r.start, r.end, r.n) for r in got if r.tid == t)
        assert mine == [r[:3] for r in greedy_segments([s[1:] for s in segs if s[0] == t], alpha, 1.0)]


def plain_scan(rows, width):
    out = []
    for b, d in rows:
        if out and b == out[-1][1] + 1 and abs(out[-1][3] / out[-1][2] - d) <= width:
            out[-1][1:] = [b, out[-1][2] + 1, out[-1][3] + d]
        else:
            out.append([b, b, 1, d])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("tile", [10, 64, 50_000])
def test_running_means_are_handed_from_tile_to_tile(spark, tile):
    rng = random.Random(tile)
    contigs = {
        0: [(i, 2.0 + rng.choice([0, 0, 0, 0.25, 0.5, 3.0])) for i in range(500)],
        1: [(i, 1.0) for i in range(130)],
        2: [(i, i * 0.125) for i in range(200) if i % 37 and not 60 < i < 95],
    }
    df = spark.createDataFrame([(t, b, d) for t, rows in contigs.items() for b, d in rows], "tid int, bin long, depth double").repartition(5)
    got = cnv.running_mean_segments(df, 0.5, tile).collect()
    for t, rows in contigs.items():
        assert sorted((r.start, r.end, r.n, r.s) for r in got if r.tid == t) == plain_scan(rows, 0.5)
    assert cnv.running_mean_segments(df.limit(0)).count() == 0


def test_a_planted_loss_is_called(spark):
    rng = random.Random(2)
    # two means must differ by 40 medians over the root of their bins, so that a lost copy shows from about 1 Mb on
    rows = [(t, b, max(0.0, rng.gauss(15 if t == 0 and 20_000 <= b < 33_000 else 30, 4))) for t in (0, 1) for b in range(60_000)]
    df = spark.createDataFrame(rows, "tid int, bin long, depth double")
    segments = cnv.merge_segments(cnv.running_mean_segments(df, tile=9_000), 40.0, 30.0).withColumn("ploidy", F.lit(2))
    (call,) = cnv.large_calls(variants.copy_number_genotype(segments, 30.0, 30.0)).collect()
    assert (call.tid, call.sv_type, call.genotype) == (0, "DEL", 1)
    assert abs(call.pos1 - 2_000_000) <= 2_000 and abs(call.pos2 - 3_300_000) <= 2_000


def test_flags_pairs_and_barcodes(spark):
    row = spark.sql("select 0 as t1, 100 as s1, 150 as e1, 65 as f1, 0 as t2, 5000 as s2, 5050 as e2, 145 as f2")
    a, b = ({"tid": F.col(f"t{k}"), "start": F.col(f"s{k}"), "end": F.col(f"e{k}"), "flag": F.col(f"f{k}")} for k in (1, 2))
    r = row.select(R.inner_size(a, b).alias("i"), R.discordance_mask(a, b, 1000).alias("m"), R.discordance_mask(a, b, 10_000).alias("n")).first()
    assert (r.i, r.m, r.n) == (4850, 8, 0)
    far = row.withColumn("t2", F.lit(3)).withColumn("s2", F.lit(120)).withColumn("e2", F.lit(170))
    # contigs are compared by default; without, nearby offsets hide that they differ
    r = far.select(R.discordance_mask(a, b, 1000).alias("m"), R.discordance_mask(a, b, 1000, compare_contigs=False).alias("n")).first()
    assert (r.m, r.n) == (1, 0)
    code = spark.sql("select 'ACGTACGTACGTACGT' as b, 'ACGTNCGTACGTACGT' as c").select(R.barcode_pack(F.col("b")).alias("p"), R.barcode_pack(F.col("c")).alias("q"), R.barcode_unpack(R.barcode_pack(F.col("b"))).alias("u")).first()
    assert code.p == int("00011011" * 4, 2) and code.q == R.BAD_BARCODE and code.u == "ACGTACGTACGTACGT-1"


def test_tails(spark):
    one = spark.range(1)
    z, n = 7.3, 5
    want = -z + math.log(sum(z**k / math.factorial(k) for k in range(n)))
    got = one.select(scores.erlang_log_sf(F.lit(z), F.lit(n)).alias("a"), scores.poisson_log_pmf(F.lit(4), 2.5).alias("b"), variants.fisher_two_sided(*map(F.lit, (3, 1, 1, 3))).alias("c")).first()
    assert got.a == pytest.approx(want) and got.b == pytest.approx(math.log(math.exp(-2.5) * 2.5**4 / 24)) and got.c == pytest.approx(0.4857, abs=1e-4)
    tail = one.select(twin.normal_sf(F.lit(1.96)).alias("p")).first()
    assert tail.p == pytest.approx(0.0249979, abs=1e-6)


def test_deoverlap_keeps_the_better(spark):
    rows = [("c", 10, "AAAA", 5, 1, 1), ("c", 12, "A", 9, 1, 2), ("c", 13, "AA", 9, 1, 3), ("c", 50, "A", 1, 1, 4)]
    df = spark.createDataFrame(rows, "chrom string, pos int, ref string, qual int, line int, ok long")
    assert sorted(r.ok for r in variants.deoverlap(df).collect()) == [2, 3, 4]


def test_quantiles_equal_the_percentile_of_one_task(spark):
    rng = random.Random(8)
    levels = [0.5, 0.8413, 0.1587, *[1 - 1.05**-i for i in range(1, 120)], 0.0, 1.0]
    for values in ([rng.gauss(0, 3) for _ in range(3001)], [float(rng.randrange(4)) for _ in range(500)] + [None] * 50, [2.5]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
        assert ranks.quantiles(df, "v", levels) == pytest.approx(df.agg(F.percentile("v", levels).alias("q")).first()["q"], rel=1e-12, abs=1e-12)
    assert ranks.quantiles(df.where("v is null"), "v", levels) == []


def deoverlapped(rows):
    """Row by row, as one would on paper."""
    kept, last = [], None
    for r in sorted(rows, key=lambda r: (r[1], r[1] + len(r[2]), r[3] if r[3] is not None else -math.inf, r[4], r[5])):
        if last is not None and r[1] >= last[1] + len(last[2]):
            kept.append(last)
            last = r
        elif last is None or (r[3] if r[3] is not None else -math.inf) > (last[3] if last[3] is not None else -math.inf):
            last = r
    return kept + [last] * (last is not None)


def test_deoverlap_equals_a_plain_walk(spark):
    rng = random.Random(3)
    for tile in (7, 64, 1 << 20):
        rows = [(f"c{k % 2}", rng.randrange(400), "A" * rng.choice([1, 1, 2, 5, 30]), rng.choice([None, 1, 2, 3, 4]), rng.randrange(3), k) for k in range(400)]
        rows += [("c0", 77, "AC", 5, 1, 1000 + k) for k in range(300)]  # many at one place
        odd = [("c0", None, "A", 1, 1, -1), ("c1", 5, "", 1, 1, -2), ("c1", 5, None, 9, 1, -3)]
        df = spark.createDataFrame(rows + odd, "chrom string, pos int, ref string, qual int, line int, ok long").repartition(5)
        want = [r[5] for c in ("c0", "c1") for r in deoverlapped([r for r in rows if r[0] == c])]
        assert sorted(r.ok for r in variants.deoverlap(df, tile).collect()) == sorted(want + [-1, -2, -3])
    assert variants.deoverlap(df.limit(0)).count() == 0


def test_pairs_and_split_reads_are_grouped_by_their_own_rules(spark):
    ev = [(1, f"B{k}", f"p{k}", "PE", 1000 + 300 * k, 9000 + 300 * k, 1, -1) for k in range(4)]  # each 300 on: one chain
    ev += [(1, "B9", f"q{k}", "PE", 1000, 9000, -1, -1) for k in range(3)]  # other strands
    ev += [(1, "B", f"s{k}", "SR", 1200 + 49 * k, 8000, 1, 1) for k in range(3)] + [(1, "B", "far", "SR", 1200 + 98 + 50, 8000, 1, 1)]
    ev += [(2, "B", "tie1", "SR", 500, 700, 1, 1), (2, "B", "tie2", "SR", 100, 900, 1, 1)]
    df = spark.createDataFrame(ev, "call_id int, bcd string, read_id string, kind string, pos1 int, pos2 int, strand1 int, strand2 int")
    pe = [tuple(r) for r in evidence.group_pe_support(df, 300.5, 80.0).collect()]
    assert pe == [(1, 4, 1450.0 + 40, 9450.0 - 40)]
    assert [r.n for r in evidence.group_pe_support(df, 300.0, -5.0).collect()] == [3]  # the chain falls apart
    assert sorted(tuple(r) for r in evidence.group_sr_support(df).collect()) == [(1, 3, 1249.0, 8000.0), (2, 1, 100.0, 900.0)]
    assert evidence.group_sr_support(df.limit(0)).count() == 0


def test_stream_counters_drop_what_comes_again(spark, tmp_path):
    from strandloom.streaming import events

    schema = "bcd string, read_id string, flag int, tid int, start int, line int, mapq int, hptype int, at timestamp"
    at = datetime.datetime(2024, 1, 1)
    rows = [("B", f"r{k}", 1024 if k % 5 == 0 else 256 if k % 7 == 0 else 64, 0, k, 1, k % 40, k % 3, at + datetime.timedelta(seconds=k)) for k in range(60)]
    for part in (rows[:40], rows[20:], rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = depth.alignment_stats(spark.createDataFrame(rows, schema)).first()
    assert events.run_to_table(events.stream_stats(stream()), "complete", "once").first() == want
    assert events.run_to_table(events.stream_stats(stream(), "at"), "complete", "timed").first() == want


@pytest.mark.parametrize(("cutoff", "least", "spread"), [(50, 3, 400), (50, 6, 150), (7, 2, 90), (200, 4, 1000)])
def test_dense_clusters_equal_all_pairs(spark, cutoff, least, spread):
    rng = random.Random(cutoff * least)
    rows = [(f"n{i:04}", "33", rng.randrange(2), rng.randrange(spread) + 3 * spread * rng.randrange(3), 0, rng.randrange(spread) if rng.random() < 0.8 else 17) for i in range(500)]
    near = defaultdict(list)
    for a in rows:
        near[a[0]] = [b[0] for b in rows if a[2] == b[2] and abs(a[3] - b[3]) < cutoff and abs(a[5] - b[5]) < cutoff]
    core = {k for k, v in near.items() if len(v) >= least}
    comps = components([(a, b) for a in core for b in near[a] if b in core])
    sizes = defaultdict(int)
    for c in comps.values():
        sizes[c] += 1
    df = spark.createDataFrame(rows, "key string, end_type string, x_tid int, x_pos int, y_tid int, y_pos int")
    got = {r.key: r.component_id for r in nodes.cluster(df, "key", cutoff, least).collect()}
    assert got == {k: c for k, c in comps.items() if sizes[c] >= least}


def plain_score(gap, longest, paired):
    top, ramp = (5.0, 100.0) if paired else (1.0, 200.0)
    longest = max(200.0, min(600.0, longest)) if paired else longest
    return (longest - gap) / longest * top if 0 <= gap <= longest else gap * top / ramp + top if -ramp <= gap < 0 else 0.0


@pytest.mark.parametrize("rate", [1 / 2000, 1 / 60, 1 / 300])
def test_breakpoints_equal_the_best_of_all_positions(spark, rate):
    rng = random.Random(4)
    rows = [(c, rng.randrange(3000) + 10_000 * c, rng.choice("RL") if c % 3 else "R", rng.random() < 0.3) for c in range(12) for _ in range(rng.randrange(1, 25))]
    got = {r.component_id: r for r in nodes.predict_breakpoint(spark.createDataFrame(rows, "component_id int, position int, side string, with_pair boolean"), rate).collect()}
    longest = math.log(0.01) / math.log(1 - rate)
    for c in range(12):
        mine = [r for r in rows if r[0] == c]
        tries = range(min(r[1] for r in mine) - 1000, max(r[1] for r in mine) + 1000, 50)
        each = {pos: [plain_score(pos - p if side == "R" else p - pos, longest, pair) for _, p, side, pair in mine] for pos in tries}
        best = max(round(sum(s), 6) for s in each.values())
        at = next(pos for pos in tries if abs(sum(each[pos]) - best) < 2e-6)
        assert abs(got[c].score - best) < 2e-6 and abs(sum(each[got[c].pos]) - best) < 2e-6 and got[c].pos >= at
        assert got[c].n_support == sum(x > 0 for x in each[got[c].pos])


def test_small_tiles_change_nothing(spark, monkeypatch):
    rng = random.Random(12)
    bins = spark.createDataFrame([(t, b, float(rng.randrange(4))) for t in (0, 1) for b in range(400) if t or b % 50], "tid int, bin int, hq double")
    want = sorted(map(tuple, depth.weighted_centroid(bins, 10).collect()))
    monkeypatch.setattr(depth, "CENTROID_TILE", 16)
    assert sorted(map(tuple, depth.weighted_centroid(bins, 10).collect())) == want and len(want) == 792
    per_base = spark.createDataFrame([(t, p, rng.randrange(2)) for t in (0, 1) for p in range(300) if p % 41], "tid int, pos int, d int")
    runs = [sorted(map(tuple, variants.run_length_depth(per_base, tile=tile).collect())) for tile in (1 << 20, 7, 64)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 100
    flat = spark.createDataFrame([(0, p, 5) for p in range(100)], "tid int, pos int, d int")
    assert list(map(tuple, variants.run_length_depth(flat, tile=9).collect())) == [(0, 0, 100, 5)]
    rows = [(t, s, s + rng.choice([5, 20, 300]), f"r{k}", 0, 1) for k in range(400) for t, s in [(k % 2, rng.randrange(9000))]]
    reads = spark.createDataFrame(rows, "tid int, start int, end int, read_id string, flag int, line int")
    chunks = [sorted(map(tuple, variants.chunk_regions(reads, 500, 40, tile=tile).collect())) for tile in (1 << 20, 64, 1000)]
    assert chunks[0] == chunks[1] == chunks[2] and len(chunks[0]) > 20
