"""Queries that once took a part of their input: they take all of it."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import evidence, segmentation
from strandloom.plans import evidence_queries as Q
from strandloom.plans import file_queries, sequence_queries
from strandloom.plans.read_queries import frags
from strandloom.sources.views import view


def test_every_read_has_a_breakpoint_row(spark, sf):
    rows = view(spark, sf, "reads")
    assert Q.g9_assembly_breakpoints(spark, sf).count() == rows.count() - rows.select("read_id").distinct().count()


def test_tied_alignments_have_one_order(spark):
    rows = [("q", 200, 300, 0, 10, 60 + k % 3, k % 2 == 0, 5 * k) for k in range(12)]
    found = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "qname string, qbeg int, qend int, tid int, start int, end int, reverse boolean, mapq int")
        found.add(tuple(sorted(map(tuple, evidence.assembly_breakpoints(df.repartition(3)).collect()), key=str)))
    assert len(found) == 1 and len(found.pop()) == 11


def test_every_two_fragments_are_paired(spark, sf):
    n = [r["count"] for r in frags(spark, sf).groupBy("bcd").count().collect()]
    assert Q.j9_read_pair_support(spark, sf).count() == sum(k * (k - 1) // 2 for k in n)


def test_support_of_later_fragments(spark):
    reads = spark.createDataFrame([("b", "b:0:1", "r", 16), ("b", "b:0:2", "r", 64), ("b", "b:1:1", "r", 16), ("c", "c:0:2", "r", 0)], "bcd string, frag_id string, read_id string, flag int")
    pairs = spark.createDataFrame([("b:0:1", "b:0:2"), ("b:0:1", "b:1:1"), ("b:0:2", "b:1:1"), ("c:0:2", "c:1:1")], "frag1 string, frag2 string")
    assert {(r.frag1, r.frag2) for r in evidence.read_pair_support(pairs, reads).where("supported").collect()} == {("b:0:2", "b:1:1")}


@pytest.fixture(scope="module")
def lengths(spark, sf):
    rows = {r.name: r.n for r in view(spark, sf, "seqs").select("name", F.length("seq").alias("n")).collect()}
    assert max(rows.values()) > 300
    return rows


def test_whole_texts(spark, sf, lengths):
    for f in (Q.j22_mask_sequence, Q.j22_apply_point_mutations, file_queries.s14_explode_alternative_hits):
        got = f(spark, sf).select("name", F.length("seq").alias("n")).collect()
        assert got and all(r.n == lengths[r.name] for r in got)
    for r in sequence_queries.j21_merge_sequences(spark, sf).collect():
        assert len(r.merged) == r.n_same + r.n_different == min(lengths[r.name], lengths[r.name + 1])
    for r in sequence_queries.p27_quality_bin(spark, sf).collect():
        assert len(r.binned.split(",")) == max(lengths[r.name], 1)
    total = sequence_queries.a26_base_quality_profile(spark, sf).where("pos is null").first()
    assert total.n == sum(lengths.values())


def test_whole_trims(spark, sf, lengths):
    got = {r.name: r.best_score for r in sequence_queries.p28_trim_by_quality(spark, sf).collect()}
    for name, n in sorted(lengths.items())[:30]:
        sums, least, best = [0.0], 0.0, 0.0
        for i in range(1, n + 1):
            sums.append(sums[-1] + round(0.05 - 10 ** (-((i * 7 + name * 3) % 41) / 10), 9))
            best, least = max(best, sums[-1] - least), min(least, sums[-1])
        assert got.get(name, 0.0) == pytest.approx(best, abs=1e-6)


def cut_again(values, window=200):
    """The reference's loop over one contig: (start, end) of its segments."""
    out, queue = [], [(0, len(values))]
    while queue:
        b, e = queue.pop()
        v, n = values[b:e], e - b
        order, counts = sorted(v), {x: v.count(x) for x in v}
        rank = {x: order.index(x) + 1 + (c - 1) / 2 for x, c in counts.items()}
        unit = (n + 1 - sum(c * (c * c - 1) for c in counts.values()) / n / max(n - 1, 1)) / 12
        sums, best = [0.0], (0.0, 0, 0)
        for x in v:
            sums.append(sums[-1] + rank[x])
        for j in range(1, n + 1):
            for i in range(max(0, j - window), j):
                m = j - i
                if m < n and unit > 0 and (z := abs(sums[j] - sums[i] - m * (n + 1) / 2) / (m * (n - m) * unit) ** 0.5) > best[0] + 1e-12:
                    best = (z, i, j)
        parts = [(b, b + best[1]), (b + best[1], b + best[2]), (b + best[2], e)] if best[0] > 3.891 else []
        for p in parts:
            (queue if p[1] - p[0] >= 4 else out).append(p)
        out += [] if parts else [(b, e)]
    return sorted((b, e - 1) for b, e in out if e > b)


def test_short_aberration_is_cut_out(spark):
    rng = random.Random(5)
    values = [rng.randrange(90) + (1000 if 200 <= i < 220 else 0) for i in range(400)]
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "tid int, pos int, value double")
    got = sorted((r.start, r.end) for r in segmentation.rank_segments(df).collect())
    assert (200, 219) in got and got == cut_again(values)


def test_deletions_of_pairs_and_assembly(spark):
    """Reads of haplotype 1 are missing from 20,000 to 25,000 under whole fragments; the pairs there tell it, and those at 40,000 do not."""
    from strandloom.operators import cnv

    bins = [(0, b, 1.0, 0.0 if 200 <= b < 250 else 1.0, 1.0, 2.0 if 200 <= b < 250 else 3.0) for b in range(600)]
    # bins without any read are absent, as where depth is counted
    depth = spark.createDataFrame([x for x in bins if x[1] != 210], "tid int, bin int, total0 double, total1 double, total2 double, total double")
    frags_over = spark.createDataFrame([(0, b, 2, 2, 2, 6) for b in range(600)], "tid int, bin long, d0 int, d1 int, d2 int, d3 int")
    clusters = spark.createDataFrame([(1, 0, 20_030, 25_010, 0, 3, 0, 3), (2, 0, 40_000, 45_000, 1, 2, 0, 3), (3, 0, 20_000, 25_000, 1, 1, 1, 3)], "call_id long, tid int, start int, end int, hp0 long, hp1 long, hp2 long, n long")
    cut = {r.hap: (r.lower, r.mean_frag) for r in cnv.haplotype_cutoffs(depth, frags_over).collect()}
    assert cut == {0: (0.1, 2.0), 1: (0.1, 2.0), 2: (0.1, 2.0), 3: (0.3, 6.0)}
    names = spark.createDataFrame([(0, "chr1")], "tid int, chrom string")
    schema = "chrom string, start int, end int, length int, score int"
    none = spark.createDataFrame([], schema)
    got = cnv.small_deletions(clusters, depth, frags_over, none, names).collect()
    assert [(r.start1, r.start2, r.hap, r.score, r.source) for r in got] == [(20_030, 25_010, 1, 2 * 3 + 50, "pairs")]
    # an assembled deletion stands for the one that pairs tell, and for its own copies
    text = spark.createDataFrame([("chr1", 20_000, 25_000, 5000, 30), ("chr1", 20_000, 25_000, 5000, 30), ("chr1", 20_010, 25_000, 4990, 30), ("chr2", 5, 905, 900, 30)], schema)
    both = cnv.small_deletions(clusters, depth, frags_over, text, names).collect()
    assert sorted((r.chrom1, r.start1, r.start2, r.source) for r in both) == [("chr1", 20_000, 25_000, "assembly"), ("chr2", 5, 905, "assembly")]
    assert cnv.small_deletions(clusters.limit(0), depth.limit(0), frags_over.limit(0), none, names).count() == 0


def test_stream_of_fragments_equals_the_batch_rule(spark, tmp_path):
    """Shuffled deliveries, ties, repeated reads and nulls; a read later than the watermark is dropped."""
    import datetime as dt

    from strandloom.operators import fragments
    from strandloom.streaming import events

    rng = random.Random(5)
    day = dt.datetime(2024, 1, 1)
    schema = "bcd string, tid int, start int, end int, mapq int, hptype int, read_id string, flag int, line int, time timestamp"
    rows = []
    for k in range(400):
        start = rng.randrange(0, 30_000, 50)
        flag = rng.choice([64, 128]) | rng.choice([0, 16]) | rng.choice([0, 0, 0, 1024])
        rows.append((rng.choice(["a", "b", None]), rng.choice([0, 1]), start, start + 100, rng.choice([5, 30, 60]), 0, f"r{k // 3}", flag, k % 4, day + dt.timedelta(seconds=rng.randrange(3600))))
    rows += rows[:5] + [("a", None, 5, 105, 60, 0, "n", 64, 0, day), ("c", 0, 5, 105, 60, 0, None, 64, 0, day), ("c", 0, 900, 1000, 60, 0, None, 144, 0, day)]
    rng.shuffle(rows)
    close = [[("z", 0, 1, 2, 60, 0, "z", 64, 0, day + dt.timedelta(days=d))] for d in (9, 10, 11)]
    late = [("a", 0, 1, 2, 60, 0, "late", 64, 0, day)]
    for k, part in enumerate([rows[:150], rows[150:300], rows[300:], close[0], close[1], late, close[2]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cols = ["bcd", "tid", "frag", "start", "end", "num_reads", "num_good_reads"]
    got = events.run_to_table(events.stream_fragments(stream, "time", 600, 200, "1 minute", "2 hours", min_good=0), "append", "fragments")
    want = fragments.cluster_fragments(spark.createDataFrame(rows, schema).where("tid is not null"), 600, 200, min_good=0).select(*cols)
    got, want = (sorted(map(tuple, x.select(*cols).collect())) for x in (got, want))
    assert (set(got) - set(want), set(want) - set(got)) == (set(), set()) and len(got) == len(want)
    assert len(want) > 20


def test_a_section_goes_on_in_the_next_files(spark, tmp_path):
    from strandloom.sources import files

    texts = ["#bin_size=10\n9\t9\n>chr1,chr2\n1\t5,6\n\n2\t7", "3\t8,\n#note\n4\t9", "5\t1\n>bad\n6\t6\n>chr2, chr3\n7\t7\n>chr4,chr5\n", "8\t8\nx\t1"]
    for k, t in enumerate(texts):
        (tmp_path / f"part-{k}.txt").write_text(t)
    want = {("chr1", "chr2", 1, 5), ("chr1", "chr2", 1, 6), ("chr1", "chr2", 2, 7), ("chr1", "chr2", 3, 8), ("chr1", "chr2", 4, 9), ("chr1", "chr2", 5, 1), ("chr2", "chr3", 7, 7), ("chr4", "chr5", 8, 8), ("chr4", "chr5", None, 1)}
    for tile in (1, 2, 100):
        got = [tuple(r) for r in files.read_2d_blacklist(spark, str(tmp_path), tile=tile).collect()]
        assert set(got) == want and len(got) == len(want), tile
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("")
    assert files.read_2d_blacklist(spark, str(tmp_path / "none")).count() == 0
