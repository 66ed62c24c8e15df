"""What the findings of round 3 were about, on small tables."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strandloom.operators import calls as C
from strandloom.operators import cnv, depth, evidence, nodes, sequences
from strandloom.plans import variant_queries


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bins_of_contigs_and_gaps_are_not_broadcast(spark):
    """A few rows that are spread over all bins are no small table."""
    seen = spark.createDataFrame([(0, 3, 1.0, 2.0)], "tid int, bin int, hq double, total double")
    dense = depth.densify(seen, spark.createDataFrame([(0, 1000)], "tid int, length int"))
    assert "BroadcastExchange" not in plan(dense) and dense.count() == 12
    gaps = spark.createDataFrame([(0, 150, 420)], "tid int, start int, end int")
    rows = cnv.prepare_depth(dense, gaps, 1.0)
    assert "BroadcastExchange" not in plan(rows)
    assert [r["depth"] for r in rows.orderBy("bin").collect()] == [0.0, 1.0, 1.0, 1.0, 1.0] + [0.0] * 7


def test_bases_far_along_a_contig(spark, tmp_path):
    """Places times 31 pass the range of int."""
    pq.write_table(pa.table({"l_orderkey": [1], "l_partkey": [1_200_000], "l_suppkey": [1], "l_linenumber": pa.array([1], pa.int32()), "l_quantity": [30.0], "l_discount": [0.0], "l_returnflag": ["N"], "l_linestatus": ["O"]}), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"o_orderkey": [1], "o_custkey": [1]}), tmp_path / "orders.parquet")
    rows = [(r["pos"], r["base"]) for r in variant_queries.bases(spark, str(tmp_path)).collect()]
    assert rows == [(p, "ACGT"[(p + (1 if (p * 31 + 30) % 11 == 0 else 0)) % 4]) for p in range(600_000_001, 600_000_081)]


def test_profile_joins_steps_and_shuffles_no_pairs(spark):
    bins = [(0, b, b % 7 / 10, b % 11 / 10) for b in range(40) if b not in (8, 21, 22, 23)]
    calls = [(1, 0, 0, 730), (2, 0, 830, 1190), (3, 0, 1990, 2110), (4, 0, 805, 870), (5, 1, 0, 900)]
    values = spark.createDataFrame(bins, "tid int, bin int, hq double, total double")
    df = evidence.profile(spark.createDataFrame(calls, "call_id long, tid int, start int, end int"), values)
    top = plan(df)
    assert top.index("Join") < top.index("Aggregate")
    want = {}
    for call, tid, start, end in calls:
        for t, b, hq, total in bins:
            if t == tid and max(start - (end - start), 0) <= b * 100 < end + (end - start):
                want.setdefault((call, b * 100 // 500 * 500), []).append((hq, total))
    mean = lambda v: tuple(round(sum(x) / len(v), 9) for x in zip(*v))
    assert {(r["call_id"], r["pos"]): (round(r["hq"], 9), round(r["total"], 9)) for r in df.collect()} == {k: mean(v) for k, v in want.items()}


def test_region_depth_ranks_tiles_and_keeps_no_pairs(spark):
    import numpy as np

    bins = [(0, b, float(b * 37 % 101)) for b in range(5000) if b % 9]
    regions = [(k, 0, k * 997 % 400_000, k * 997 % 400_000 + w) for k, w in enumerate((100, 950, 102_399, 102_401, 250_000, 30, 480_000))]
    depth_ = spark.createDataFrame(bins, "tid int, bin int, total double")
    df = cnv.region_depth(spark.createDataFrame(regions, "call_id long, tid int, start int, end int"), depth_)
    assert "percentile(" not in plan(df)
    got = {r["call_id"]: tuple(round(r[c], 9) for c in ("low", "mid", "high")) for r in df.collect()}
    want = {}
    for call, _, start, end in regions:
        v = [t for _, b, t in bins if start <= b * 100 < end]
        if v:
            want[call] = tuple(round(float(x), 9) for x in np.quantile(v, (0.25, 0.5, 0.75)))
    assert got == want


def test_filter_2d_counts_points_only_where_cells_do_not_tell(spark):
    import random

    r = random.Random(3)
    points = [("a", "b", r.randrange(0, 90), r.randrange(0, 90)) for _ in range(300)] + [("a", "b", r.randrange(1000, 1500), r.randrange(0, 500)) for _ in range(120)]
    calls = [(k, "a", r.randrange(0, 1500), "b", r.randrange(0, 500), "PASS") for k in range(400)] + [(900 + k, "b", 40, "a", 40 + k, "PASS") for k in range(60)]
    for box in (40, 43, 3):
        df = C.filter_2d(spark.createDataFrame(calls, "call_id long, chrom1 string, start1 int, chrom2 string, start2 int, filter string"), spark.createDataFrame(points, "chrom1 string, chrom2 string, pos1 int, pos2 int"), box, 4)
        assert box < 4 or "LeftAnti" in plan(df)
        both = points + [(b, a, q, p) for a, b, p, q in points]
        want = {c[0]: sum(p[0] == c[1] and p[1] == c[3] and abs(p[2] - c[2]) <= box // 2 and abs(p[3] - c[4]) <= box // 2 for p in both) >= 4 for c in calls}
        assert {x["call_id"]: x["filter"] == "2D_BLACKLIST" for x in df.collect()} == want


def test_uncovered_beyond_the_length(spark):
    iv = spark.createDataFrame([("a", 300, 900), ("a", 1100, 1500), ("b", 0, 990)], "name string, start int, end int")
    lengths = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000)], "name string, length int")
    got = sorted((r["name"], r["start"], r["end"]) for r in sequences.uncovered(iv, lengths, 5).collect())
    assert got == [("a", 0, 300), ("a", 900, 1100), ("b", 990, 1000), ("c", 0, 1000)]


def _random_calls(n, seed):
    import random

    r = random.Random(seed)
    rows = []
    for k in range(n):
        a = r.choice((r.randrange(0, 200_000), r.randrange(0, 15_000)))
        b = r.choice((a + r.randrange(-30_000, 30_000), a + r.randrange(-90, 90), r.randrange(0, 200_000)))
        rows.append((k, r.choice(("DEL", "DUP")), "a", r.choice(("a", "a", "b")), a, b))
    return rows


def _same(x, y):
    if x[1:4] != y[1:4] or abs(x[4] - y[4]) > 10_000 or abs(x[5] - y[5]) > 10_000:
        return False
    (lo, hi), (lo2, hi2) = sorted(x[4:]), sorted(y[4:])
    return x[2] != x[3] or min(hi, hi2) - max(lo, lo2) >= 0.5 * max(hi - lo, hi2 - lo2)


KIND = "call_id long, sv_type string, chrom1 string, chrom2 string, start1 int, start2 int"


def test_dedupe_of_crowded_and_sparse_calls(spark):
    for n, seed in ((60, 1), (250, 2), (900, 3)):
        rows = _random_calls(n, seed)
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x in rows:
            for y in rows:
                if x[0] < y[0] and _same(x, y):
                    a, b = sorted((find(x[0]), find(y[0])))
                    parent[b] = a
        got = {r["call_id"] for r in C.dedupe(spark.createDataFrame(rows, KIND)).collect()}
        assert got == {find(k) for k in range(n)}


def test_calls_of_one_place_are_not_paired(spark, monkeypatch):
    """A crowd of same calls is told by its cell: none of them meets another one by one."""
    crowd = [(k, "DEL", "a", "a", 100_000 + k % 50, 180_000 + k % 70) for k in range(500)]
    met = []
    real = C._met
    monkeypatch.setattr(C, "_met", lambda a, b, *rest: met.append(a.count()) or real(a, b, *rest))
    rows = spark.createDataFrame(crowd, KIND)
    assert [r["call_id"] for r in C.dedupe(rows).collect()] == [0]
    assert C.merge_callsets(rows.where("call_id < 250"), rows.where("call_id >= 250")).count() == 250
    assert met == [0, 0]


def test_merge_callsets_by_brute_force(spark):
    rows = _random_calls(500, 5)
    df = spark.createDataFrame(rows, KIND)
    got = {r["call_id"] for r in C.merge_callsets(df.where("call_id % 3 = 0"), df.where("call_id % 3 > 0")).collect()}
    assert got == {x[0] for x in rows if x[0] % 3 == 0 or not any(y[0] % 3 == 0 and _same(x, y) for y in rows)}


def test_best_stretch_is_exact_and_runs_once_over_a_text(spark):
    rows = [(1, [0, 30, 30, 2, 40]), (2, []), (3, [0, 0]), (4, [20, None, 40]), (5, None), (6, [13, 14, 9, 20] * 5)]
    df = spark.createDataFrame(rows, "name long, quals array<int>").select("name", sequences.best_stretch("quals").alias("t"))
    assert "aggregate(" not in plan(df)
    got = {r["name"]: r["t"] for r in df.collect()}
    for name, quals in rows:
        if quals is None:
            assert got[name] is None or got[name]["start"] is None
            continue
        best, now, at = (0, 0, 0), 0, 0
        for i, q in enumerate(quals):
            if q is None:
                break
            if now <= 0:
                now, at = 0, i
            now = round(now + round(0.05 - 10 ** (-q / 10), 9), 9)
            if now > best[2]:
                best = (at, i + 1, now)
        assert tuple(got[name]) == best


def test_spread_calls_are_not_broadcast(spark):
    rows = spark.createDataFrame(_random_calls(50, 7), KIND)
    assert "BroadcastExchange" not in plan(C.same_call(rows, rows))


def test_runs_are_joined_over_tiles(spark):
    from strandloom.operators.variants import join_runs

    rows = [(0, 1, 3, 2), (0, 4, 9, 2), (0, 10, 41, 2), (0, 42, 45, 1), (0, 47, 50, 1), (0, 51, 60, 1), (1, 61, 70, 1)]
    got = {(r["tid"], r["idx"]): r["run"] for r in join_runs(spark.createDataFrame(rows, "tid int, idx long, to long, d int"), 8).collect()}
    assert got == {(0, 1): 1, (0, 4): 1, (0, 10): 1, (0, 42): 42, (0, 47): 47, (0, 51): 47, (1, 61): 61}


def test_places_on_a_contig_are_counted_by_ranges(spark, sf):
    from strandloom.plans.evidence_queries import o1_position_sort

    # the only window over rows themselves goes by range, not by contig
    text = o1_position_sort(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" not in text and "_range" in text


def test_stream_of_fragments_keeps_states_of_buckets(spark, tmp_path):
    """Barcodes of one state are cut and given out each at its own time, and a call of Python is one for a bucket."""
    import datetime as dt

    from strandloom.operators import fragments
    from strandloom.streaming import events

    schema = "bcd string, tid int, start int, end int, mapq int, hptype int, read_id string, flag int, line int, time timestamp"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    read = lambda b, p, h: (f"b{b}", b % 2, p, p + 100, 60, 0, f"r{b}-{p}", 64, 1, at(h))
    parts = [[read(b, p, 0) for b in range(12) for p in (900, 5000)], [read(b, 1200, 1) for b in range(12)], *[p for h in (10, 20) for p in ([read(99, 0, h - 5)], [read(99, 0, h - 4)], [read(b, 9000, h) for b in range(0, 12, 3)])], [read(99, 0, 200)], [read(99, 0, 300)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    cols = ["bcd", "tid", "frag", "start", "end", "num_reads", "num_good_reads"]
    # barcodes that go on for a while are kept, so that their later reads are counted with the first ones or stand alone
    for idle, alone in (("1 hour", True), ("30 hours", False)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        made = events.stream_fragments(stream, "time", 600, 200, idle, "1 hour", min_good=0, buckets=2)
        assert "_bucket" in made._jdf.queryExecution().analyzed().toString()
        got = sorted(map(tuple, events.run_to_table(made, "append", "fragments").where("bcd <> 'b99'").select(*cols).collect()))
        first = [r for p in parts[:2] for r in p]
        sets = [first, parts[4], parts[7]] if alone else [first + parts[4] + parts[7]]
        want = sorted(tuple(r) for rows in sets for r in fragments.cluster_fragments(spark.createDataFrame(rows, schema), 600, 200, min_good=0).select(*cols).collect())
        assert got == want, idle


def test_heat_map_deals_no_reads_to_regions(spark):
    """Of many regions around a read none holds a copy of it; a barcode counts once in a cell, nulls and empty regions never."""
    reads, regions = [], []
    for k in range(240):
        start = k * 7919 % 30_000
        reads.append((k % 2, start, start + k % 3 * 40, f"b{k % 5}" if k % 11 else None))
    reads += reads[:20]
    for k in range(60):
        a, b = k * 331 % 24_000, k * 577 % 24_000
        regions.append((k, k % 2, a, a + 6000 if k % 9 else a, k % 3 % 2, b, b + 5500))
    df = nodes.heatmap_counts(spark.createDataFrame(reads, "tid int, start int, end int, bcd string"), spark.createDataFrame(regions, "pair_id int, tid1 int, start1 int, end1 int, tid2 int, start2 int, end2 int"), cell=1000, cap=3, group=9000)
    text = plan(df)
    assert "BroadcastExchange" not in text
    keys = [line for line in text.splitlines() if "hashpartitioning(" in line]
    assert keys and not any("pair_id" in k and "bcd" in k for k in keys)
    want = {}
    for pair, t1, s1, e1, t2, s2, e2 in regions:
        seen = set()
        for ta, sa, ea, ba in reads:
            ma = (sa + ea) // 2
            if ba is None or ta != t1 or not s1 <= ma < e1:
                continue
            for tb, sb, eb, bb in reads:
                mb = (sb + eb) // 2
                if bb == ba and tb == t2 and s2 <= mb < e2:
                    seen.add(((ma - s1) // 1000, (mb - s2) // 1000, ba))
        for x, y, _ in seen:
            want[pair, x, y] = min(want.get((pair, x, y), 0) + 1, 3)
    got = {(r["pair_id"], r["x"], r["y"]): r["n"] for r in df.collect()}
    assert got == want and len(want) > 100


def test_quantiles_order_only_the_stretches_asked_for(spark, monkeypatch):
    """Of many values few are put in order; values that crowd, tie or are no numbers give the same places."""
    from strandloom.operators import ranks

    ordered = []
    real = ranks.running_before
    monkeypatch.setattr(ranks, "running_before", lambda df, *a: ordered.append(df.count()) or real(df, *a))
    levels = [0.0, 0.1, 0.5, 0.8413, 0.999, 1.0]
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000 / 3).alias("v"))
    want = df.agg(F.percentile("v", levels).alias("q")).first()["q"]
    assert max(abs(a - b) for a, b in zip(ranks.quantiles(df, "v", levels), want, strict=True)) < 1e-9
    assert ordered and max(ordered) < 100
    crowded = df.select((F.col("v") / 1e9).alias("v")).unionAll(spark.createDataFrame([(1e12,), (-1e12,), (None,)], "v double"))
    for rows in (crowded, df.selectExpr("cast(v as int) % 5 as v"), df.selectExpr("7L as v")):
        want = rows.agg(F.percentile("v", levels).alias("q")).first()["q"]
        assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip(ranks.quantiles(rows, "v", levels), want, strict=True))
    odd = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    assert ranks.quantiles(odd, "v", [0.0, 0.5]) == [1.0, 2.0]


def test_centroids_sum_each_bin_once(spark):
    rows = spark.createDataFrame([(t, b, float(b * 31 % 7) + 0.5) for t in (0, 1) for b in range(300) if b % 50 > 9], "tid int, bin int, hq double")
    df = depth.weighted_centroid(rows, 20)
    text = plan(df)
    assert "unboundedpreceding" in text and all("unboundedpreceding" in f for f in text.split("specifiedwindowframe(RangeFrame, ")[1:])
    value = {(r["tid"], r["bin"]): int(r["hq"]) for r in rows.collect()}
    for r in df.collect():
        for c, span in (("c1", range(r["bin"] - 20, r["bin"])), ("c2", range(r["bin"], r["bin"] + 20))):
            w = [(value.get((r["tid"], b), 0), b) for b in span]
            d = sum(v for v, _ in w)
            assert r[c] == (sum(v * b for v, b in w) * 100 / d if d else None)


def test_twin_windows_make_no_map_of_events(spark):
    """Events go to tiles as they are; islands, single bins, gaps and contig ends count as before."""
    from strandloom.operators import twin

    at = {b: sorted({k * (b + 3) * 37 % 90 for k in range(9)}) for b in range(6)} | {6: [0], 7: [89], 8: [10, 19, 20, 29, 40, 49]}
    reads = spark.createDataFrame([(0, b * 100 + 7, b * 100 + 60, 60, f"b{n}", 64) for n, bins in at.items() for b in bins], "tid int, start int, end int, mapq int, bcd string, flag int")
    df = twin.twin_windows(reads, spark.createDataFrame([(0, 9000)], "tid int, length int"), window=1000, shift=100)
    # the contig's tiles are aggregated, no places of it
    assert not any("Aggregate" in line and "idx" in line.split("functions=")[0] for line in plan(df).splitlines())
    want = {}
    for i in range(91):
        left, right = ({n for n, bins in at.items() if any(lo <= b < lo + 10 for b in bins)} for lo in (i - 10, i))
        if left or right:
            want[i] = (len(left), len(right), len(left & right))
    assert {r["idx"]: (r["n1"], r["n2"], r["n0"]) for r in df.collect()} == want


def test_samples_are_merged_by_tasks_that_follow_the_rows(spark, monkeypatch):
    from strandloom.operators import variants

    monkeypatch.setattr(variants, "SITES_OF_A_TASK", 100)
    part = lambda k: spark.createDataFrame([("chr1", p, "A", "G", None if p % 7 == 0 else p % 50 + k) for p in range(0, 900, k + 1)] * 2, "chrom string, pos int, ref string, alt string, qual int")
    df = variants.merge_samples({n: part(k) for k, n in enumerate("abc")})
    text = plan(df).split("Initial Plan")[0]
    assert text.index("Aggregate") < text.index("REPARTITION_BY_NUM") and "Expand" not in text and "Aggregate" not in text[text.index("REPARTITION_BY_NUM") :]
    want = {p: tuple((None if p % 7 == 0 else p % 50 + k) if p % (k + 1) == 0 else None for k in range(3)) + (sum(p % (k + 1) == 0 for k in range(3)),) for p in range(900)}
    assert {r["pos"]: tuple(r)[4:] for r in df.collect()} == want


def test_pairs_of_fragments_are_not_shuffled(spark):
    reads = spark.createDataFrame([("b", "b:0:1", "r", 16), ("b", "b:0:2", "r", 64), ("b", "b:1:1", "r", 16), ("b", "b:0:2", "q", 0), ("c", "c:0:2", "r", 0)], "bcd string, frag_id string, read_id string, flag int")
    frags = spark.createDataFrame([(n[0], n, int(n[2]) * 10 + int(n[4])) for n in ("b:0:1", "b:0:2", "b:1:1", "b:1:2", "c:0:2", "c:1:1")], "bcd string, frag_id string, at int")
    df = evidence.all_pairs_support(frags, reads)
    keys = [line for line in plan(df).splitlines() if "hashpartitioning(" in line]
    assert not any("frag1" in k.split("hashpartitioning(")[1] and "frag2" in k.split("hashpartitioning(")[1] for k in keys)
    pairs = df.select("frag1", "frag2")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, evidence.read_pair_support(pairs, reads).collect())) and pairs.count() == 7
    assert [(r["frag1"], r["frag2"]) for r in df.where("supported").collect()] == [("b:0:2", "b:1:1")]


def test_sequences_are_joined_as_texts(spark):
    from strandloom.plans import sequence_queries

    rows = spark.createDataFrame([(1, "ACGT"), (2, "ACCTGG"), (3, ""), (4, "A"), (5, None), (6, "G"), (7, "GT")], "name long, seq string")
    df = sequence_queries._merged(rows)
    text = plan(df).split("Initial Plan")[0]
    assert "split(" not in text[text.index("Join [") :]
    assert sorted(map(tuple, df.collect())) == [(1, 3, 1, "ACNT"), (6, 1, 0, "G")]


def test_grid_overlap_counts_bounded_tasks(spark):
    """Pairs of cells go out as lists, and as many tasks count them as there are pairs for; no map of pairs in the step that makes them."""
    import collections
    import itertools

    rows = [(f"B{k % 7}", k % 3, k * 7919 % 90_000 - 5000, k * 7919 % 90_000 - 5000 + k % 5 * 900) for k in range(150)]
    rows += [("many", 1, k * 2000, k * 2000 + 10) for k in range(1500)] + [(None, 0, 0, 50_000), ("one", 2, 100, 200)]
    df = nodes.grid_overlap(spark.createDataFrame(rows, "bcd string, tid int, start int, end int"), cell=2000, apart=15_000, cap=3)
    text = plan(df)
    assert "Join" not in text and df.rdd.getNumPartitions() == 1
    cells = collections.defaultdict(set)
    for bcd, tid, start, end in rows:
        cells[bcd] |= {(tid, c) for c in range(start // 2000, end // 2000 + 1)}
    want = collections.Counter()
    for bcd in set(cells) - {None}:
        for (t, c), (u, d) in itertools.combinations(sorted(cells[bcd]), 2):
            want[t, c, u, d] += t < u or (d - c) * 2000 >= 15_000
    want = {k: min(n, 3) for k, n in want.items() if n}
    assert {tuple(r[:4]): r["n"] for r in df.collect()} == want
    small = nodes.grid_overlap(spark.createDataFrame(rows, "bcd string, tid int, start int, end int"), cell=2000, apart=15_000, cap=3, task=100_000)
    assert small.rdd.getNumPartitions() > 10 and small.count() == len(want)


def test_clips_are_cast_only_where_there_are_any(spark):
    """A cast of an empty text fails inside, at many times the cost of a null."""
    reads = spark.createDataFrame([(0, 10, 60, "B", "R", 64, "50M"), (1, 20, 70, "B", "R", 128, "99999999999S50M"), (0, 12, 62, "B", "S", 64, "7S43M"), (1, 25, 75, "B", "S", 64, "43M7H"), (1, 26, 76, "B", "S", 64, None)], "tid int, start int, end int, bcd string, read_id string, flag int, cigar string")
    pairs = spark.createDataFrame([(1, 0, 0, 100, 1, 0, 100)], "pair_id int, tid1 int, start1 int, end1 int, tid2 int, start2 int, end2 int")
    df = evidence.breakpoint_evidence(reads, pairs)
    assert "try_cast(regexp_extract" not in plan(df).replace("null else try_cast(regexp_extract", "")
    assert sorted((r["read_id"], r["kind"], r["pos1"], r["pos2"]) for r in df.collect()) == [("R", "PE", 60, 70), ("S", "SR", 12, 75)]


def test_insert_sizes_are_ranked_without_a_map_of_them(spark):
    import numpy as np

    sizes = [k * 7919 % 100_003 - 500 for k in range(3001)]
    reads = spark.createDataFrame([(0, 50, 64), (10, 90, 128), (5, 75, 128)], "start int, end int, flag int")
    df = evidence.insert_size_stats(spark.createDataFrame([(s,) for s in sizes], "inner_size int"), reads)
    assert "percentile(inner_size" not in plan(df)
    q1, q2, q3 = np.percentile([s for s in sizes if s > 0], [25, 50, 75])
    assert tuple(df.first()) == (q1, q2, q3, q3 + 1.5 * (q3 - q1), 50.0, 75.0)
    none = evidence.insert_size_stats(spark.createDataFrame([], "inner_size int"), reads).first()
    assert tuple(none) == (None, None, None, None, 50.0, 75.0)


def test_inner_sizes_pair_only_facing_strands_of_a_contig(spark):
    from strandloom.functions import reads as R
    from strandloom.operators import fragments

    rows = [("B", f"R{k // 12}", k // 6 % 2, k * 37 % 50 * 10, k * 37 % 50 * 10 + 20 + k % 3, (64, 80, 128, 144, 400, 0)[k * 5 % 6], 8 + k % 9, k) for k in range(240)]
    rows += [(None, "N", 0, 10, 20, 64, 60, 1), (None, "N", 0, 50, 60, 144, 60, 2), ("B", "T", None, 10, 20, 64, 60, 1), ("B", "T", None, 50, 60, 144, 60, 2)]
    reads = spark.createDataFrame(rows, "bcd string, read_id string, tid int, start int, end int, flag int, mapq int, line int")
    df = fragments.inner_sizes(reads)
    assert "tid#" in plan(df).split("Join [")[1].split("]")[0]
    side = lambda p: {c: F.col(f"{p}_{c}") for c in ("tid", "start", "end", "flag")}
    every = fragments.mate_pairs(reads).select("bcd", "read_id", R.inner_size(side("a"), side("b")).alias("inner_size")).where("inner_size is not null")
    assert df.count() > 10 and sorted(map(tuple, df.collect())) == sorted(map(tuple, every.collect()))


def test_same_calls_go_out_packed_and_a_crowd_to_several_tasks(spark, monkeypatch):
    """No call is shuffled once for each of nine cells, and no task makes all pairs of a crowded cell."""
    kept, real = [], C.stash
    monkeypatch.setattr(C, "stash", lambda df, label: kept.append((label, df.count())) or real(df, label))
    crowd = spark.createDataFrame([(k, "DEL", "a", "a", 100_000 + k % 50, 180_000 + k % 70) for k in range(500)], KIND)
    assert C.same_call(crowd, crowd).count() == 500 * 500
    assert kept == [("packed-calls", 1)]
    monkeypatch.setattr(C, "PACK", 20, raising=False)
    monkeypatch.setattr(C, "PART", 2, raising=False)
    df = C.same_call(crowd, crowd)
    assert df.distinct().count() == df.count() == 500 * 500
    assert df.groupBy(F.spark_partition_id()).count().count() > 1


def test_same_calls_by_brute_force(spark, monkeypatch):
    rows = [*_random_calls(400, 11), (400, "DEL", "a", "a", -9_999, 12), (401, "DEL", "a", "a", -1, 9_999), (402, "DEL", "a", "b", 40_000, 0), (403, "DEL", "a", "b", 50_000, -10_000)]
    none = [(404, None, "a", "a", 5, 5), (405, "DEL", "a", "a", None, 5), (406, "DEL", "a", "a", 5, None), (407, "DEL", None, "a", 5, 5)]
    df = spark.createDataFrame(rows + none, KIND)
    want = sorted((x[0], y[0]) for x in rows for y in rows if _same(x, y))
    assert (402, 403) in want
    for pack, part in ((4096, 8), (3, 2), (1, 1)):
        monkeypatch.setattr(C, "PACK", pack, raising=False)
        monkeypatch.setattr(C, "PART", part, raising=False)
        assert sorted(map(tuple, C.same_call(df, df).collect())) == want
    some = C.same_call(df.where("call_id % 3 = 0"), df.where("call_id % 3 > 0")).collect()
    assert sorted(map(tuple, some)) == [(x, y) for x, y in want if x % 3 == 0 and y % 3 > 0]
