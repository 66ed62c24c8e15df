"""What the findings of round 4 were about, on small tables."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from strandloom.operators import calls as C
from strandloom.operators import cnv, depth, evidence, nodes
from strandloom.operators import variants as V
from strandloom.plans import file_queries, late_queries
from strandloom.sources.views import view, view_sql

FAR = 3_600_000_001


def lineitem(tmp_path, rows):
    """``rows``: order, part, supplier, line, quantity, return flag; orders and suppliers go with them."""
    cols = list(zip(*rows, strict=True))
    n = len(rows)
    pq.write_table(pa.table({
        "l_orderkey": pa.array(cols[0], pa.int64()), "l_partkey": pa.array(cols[1], pa.int64()), "l_suppkey": pa.array(cols[2], pa.int64()), "l_linenumber": pa.array(cols[3], pa.int32()),
        "l_quantity": pa.array(cols[4], pa.float64()), "l_discount": [0.0] * n, "l_returnflag": list(cols[5]), "l_linestatus": ["O"] * n,
    }), tmp_path / "lineitem.parquet")
    keys = sorted(set(cols[0]))
    pq.write_table(pa.table({"o_orderkey": pa.array(keys, pa.int64()), "o_custkey": pa.array([1] * len(keys), pa.int64())}), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array(sorted(set(cols[2])), pa.int64())}), tmp_path / "supplier.parquet")
    return str(tmp_path)


def test_places_above_two_to_the_31(spark, tmp_path):
    """At 6 GB the keys put reads and gaps beyond the range of int; the SQL of the views stays as it was."""
    sf = lineitem(tmp_path, [(1, 7_200_000, 360_000, 1, 30.0, "N"), (1, 7_200_000, 360_000, 4, 20.0, "R")])
    reads = view(spark, sf, "reads")
    assert [(r["start"], r["end"]) for r in reads.orderBy("line").collect()] == [(FAR, FAR + 80), (FAR, FAR + 70)]
    assert [r["start"] for r in view(spark, sf, "gaps").collect()] == [360_000 * 7919]
    assert view(spark, sf, "variants").first()["pos"] == FAR
    assert "as bigint) as start" not in view_sql("reads")
    assert sorted(r["bin"] for r in depth.hap_read_depth(reads).collect()) == [FAR // 100]
    call = spark.createDataFrame([(1, 0, FAR - 1, FAR + 199)], "call_id long, tid int, start long, end long")
    assert [(r["pos"], r["total"]) for r in evidence.profile(call, depth.read_depth(reads)).collect()] == [(3_600_000_000, 1.5)]
    dense = depth.densify(depth.read_depth(reads), spark.createDataFrame([(0, 300)], "tid int, length long"))
    assert dict(dense.dtypes)["bin"] == "bigint"
    assert file_queries.p26_indel_to_deletion(spark, sf).first()["start"] == 7_200_000 * 500 + 1


def test_operators_keep_far_places(spark):
    ends = spark.createDataFrame([(f"k{i}", 0, FAR + i, FAR + 2_000 + i, 0) for i in range(3)], "key string, tid int, end1 long, start2 long, hap int")
    assert [(r["start"], r["end"]) for r in evidence.cluster_discordant(ends).collect()] == [(FAR + 1, FAR + 2_001)]
    members = spark.createDataFrame([(1, FAR + i, "R", False) for i in range(5)], "component_id int, position long, side string, with_pair boolean")
    assert abs(nodes.predict_breakpoint(members, 1e-3).first()["pos"] - FAR) < 100
    deletion = spark.createDataFrame([(1, 0, FAR, FAR + 1_000, 9, 9, 9, 9)], "call_id int, tid int, start long, end long, hp0 int, hp1 int, hp2 int, n int")
    bins = [FAR // 100 + k for k in range(10)]
    empty = spark.createDataFrame([], "tid int, bin long, total0 double, total1 double, total2 double, total double")
    frags = spark.createDataFrame([(0, b, 5, 0, 0, 5) for b in bins], "tid int, bin long, d0 int, d1 int, d2 int, d3 int")
    cut = spark.createDataFrame([(h, 1.0, 1.0) for h in range(4)], "hap int, lower double, mean_frag double")
    assert [(r["hap"], r["score"]) for r in cnv.validate_deletions(deletion, empty, frags, cut).collect()] == [(0, 28)]


def test_all_contigs_but_alternative_ones_take_part(spark, monkeypatch):
    """The pipeline's query left the whole of chr5 out."""
    named = spark.createDataFrame([(k, 1000, f"chr{k + 1}") for k in range(5)] + [(5, 1000, "chr1_gl000191_random")], "tid int, length int, chrom string")
    gaps = spark.createDataFrame([(0, 10, 20)], "tid int, start int, end int")
    monkeypatch.setattr(late_queries, "contigs", lambda *_: named)
    monkeypatch.setattr(late_queries, "reads", lambda *_: None)
    monkeypatch.setattr(late_queries, "view", lambda *_: gaps)
    monkeypatch.setattr(late_queries.twin, "barcode_overlap", lambda *_: None)
    monkeypatch.setattr(late_queries.molecule_calls, "detect", lambda reads, contigs, windows, alt, *_, **__: alt)
    assert [r["tid"] for r in late_queries.called(spark, "").collect()] == [5]


def test_pileups_shuffle_reads_and_not_bases(spark):
    """Over tiles shorter than the reads, against counting base by base."""
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(300), "".join(rng.choice("AACGTn") for _ in range(rng.randrange(1, 60))), rng.random() < 0.3) for _ in range(60)]
    reads = spark.createDataFrame([*rows, (0, 5, None, False), (None, 5, "ACGT", False), (0, 7, "", True)], "tid int, start int, seq string, reverse boolean").repartition(3)
    counts, back = {}, Counter()
    for tid, start, seq, reverse in rows:
        for i, c in enumerate(seq.upper()):
            counts.setdefault((tid, start + i), Counter())[c] += 1
            back[tid, start + i, c] += reverse
    piles = {}
    for (tid, pos), n in counts.items():
        top = sorted((-k, c) for c, k in n.items() if k >= 2)
        if top:
            (k, best), (k2, second) = top[0], (top[1:] or [(0, None)])[0]
            piles[tid, pos] = (sum(n.values()), best, -k, back[tid, pos, best], second, -k2)
    df = V.pileup(reads, tile=16)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text
    assert {(r[0], r[1]): tuple(r)[2:] for r in df.collect()} == piles
    want, run = {}, None
    for tid, pos in sorted(piles):
        run = run if (tid, pos - 1) in piles else (tid, pos)
        _, best, k, _, _, k2 = piles[tid, pos]
        want[run] = want.get(run, "") + (best.lower() if 2 * k2 >= k else best)
    for tile in (16, 1 << 16):
        assert {(r["tid"], r["start"]): r["consensus"] for r in V.consensus(reads, tile=tile).collect()} == want
    errors = Counter()
    for (_, pos), n in counts.items():
        ref = "ACGT"[pos % 4]
        if 1 - n[ref] / sum(n.values()) <= 0.7:
            for c, k in n.items():
                errors[ref, c] += k
    got = V.error_profile(reads, lambda tid, pos: np.frombuffer(b"ACGT", np.uint8)[pos % 4], 0.7, 16).collect()
    assert {(r["ref"], r["base"]): r["n"] for r in got} == errors


def test_short_calls_do_not_meet_a_crowd(spark, monkeypatch):
    """Few pairs are looked at beside a crowd, and the groups are those of all pairs."""
    rng = random.Random(9)
    calls = [(k, "DEL", "chr1", rng.randrange(4_000), "chr1", 20_000 + rng.randrange(4_000)) for k in range(150)]
    for k in range(150, 330):
        a = rng.randrange(12_000)
        calls.append((k, "DEL", "chr1", a, "chr1", a + rng.choice((-1, 1)) * int(2 ** rng.uniform(0, 10)) * rng.randrange(2)))
    calls += [(k, "TRA", "chr1", rng.randrange(60_000), "chr2", rng.randrange(60_000)) for k in range(330, 400)]

    def same(x, y):
        (_, t, c1, a1, c2, a2), (_, u, d1, b1, d2, b2) = x, y
        if (t, c1, c2) != (u, d1, d2) or abs(a1 - b1) > 10_000 or abs(a2 - b2) > 10_000:
            return False
        return c1 != c2 or min(max(a1, a2), max(b1, b2)) - max(min(a1, a2), min(b1, b2)) >= 0.5 * max(abs(a2 - a1), abs(b2 - b1))

    first = {c[0]: c[0] for c in calls}
    root = lambda k: k if first[k] == k else root(first[k])
    for x in calls:
        for y in calls[: calls.index(x)]:
            if same(x, y):
                i, j = sorted((root(x[0]), root(y[0])))
                first[j] = i
    looked = []
    alike = C._alike
    monkeypatch.setattr(C, "_met", lambda *_: (_ for _ in ()).throw(AssertionError("all calls of cells of 10,000 bases met")))
    monkeypatch.setattr(C, "_alike", lambda *a: looked.append(a) or alike(*a))
    df = spark.createDataFrame(calls, "call_id long, sv_type string, chrom1 string, start1 int, chrom2 string, start2 int")
    assert sorted(r["call_id"] for r in C.dedupe(df).collect()) == sorted({root(c[0]) for c in calls})
    assert len(looked) == 2
