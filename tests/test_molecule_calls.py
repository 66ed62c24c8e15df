"""Planted structural variants are found again; the fitted parameters are those of the data."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators import molecule_calls, twin

LENGTH = 2_000_000
#: Haplotype 1 as pieces (contig, start, end, reversed): a deletion, an inversion, a tandem duplication and swapped ends.
HAP1 = [
    [(0, 0, 400_000, False), (0, 460_000, 800_000, False), (0, 800_000, 900_000, True), (0, 900_000, 1_280_000, False), (0, 1_200_000, 1_700_000, False), (1, 1_500_000, LENGTH, False)],
    [(1, 0, 1_500_000, False), (0, 1_700_000, LENGTH, False)],
]
HAP2 = [[(0, 0, LENGTH, False)], [(1, 0, LENGTH, False)]]
READS = T.StructType(
    [T.StructField("tid", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("mapq", T.IntegerType()), T.StructField("bcd", T.StringType())]
    + [T.StructField("hptype", T.IntegerType()), T.StructField("read_id", T.StringType()), T.StructField("flag", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("cigar", T.StringType())]
)


def place(contig, at):
    """The piece and reference position of a base of a haplotype's contig."""
    for piece in contig:
        size = piece[2] - piece[1]
        if at < size:
            return piece[0], (piece[2] - 1 - at if piece[3] else piece[1] + at), piece[3]
        at -= size


def simulated(seed=7, barcodes=400, molecules=7):
    rng = random.Random(seed)
    rows = []
    for b in range(barcodes):
        for k in range(molecules):
            hap = rng.choice([1, 2])
            contig = rng.choice(HAP1 if hap == 1 else HAP2)
            total = sum(p[2] - p[1] for p in contig)
            size = rng.randrange(40_000, 80_000)
            first = rng.randrange(0, total - size)
            for n in range(size // 1_500):
                at = first + rng.randrange(0, size - 500)
                for mate, shift in ((64, 0), (128, 300)):
                    tid, pos, turned = place(contig, at + shift)
                    reverse = (mate == 128) != turned
                    start = pos - 99 if turned else pos
                    rows.append((tid, max(0, start), max(0, start) + 100, 60 if rng.random() < 0.97 else 3, f"B{b}", hap, f"m{b}.{k}.{n}", mate | (16 if reverse else 0), mate // 64, "100M"))
    return rows


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(simulated(), READS).repartition(4)


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame([(0, "chr1", LENGTH), (1, "chr2", LENGTH)], "tid int, chrom string, length int")


def test_planted_variants_are_found(spark, reads, contigs):
    windows = twin.barcode_overlap(reads, contigs)
    rows = molecule_calls.detect(reads, contigs, windows).collect()
    passed = [r for r in rows if r["filter"] == "PASS"]
    want = {("DEL", "chr1", 400_000, "chr1", 460_000), ("DUP", "chr1", 1_200_000, "chr1", 1_280_000), ("INV", "chr1", 800_000, "chr1", 900_000), ("TRA", "chr1", 1_700_000, "chr2", 1_500_000)}
    for kind, c1, p1, c2, p2 in want:
        # at this coverage a duplication on one haplotype does not show in the lower quartile of its bins' depth
        among = [r for r in rows if r["filter"] in ("PASS", "DEPTH_FILTER")] if kind == "DUP" else passed
        assert any(r.sv_type == kind and (r.chrom1, r.chrom2) == (c1, c2) and abs(r.start1 - p1) <= 1_000 and abs(r.start2 - p2) <= 1_000 for r in among), kind
    for r in rows:
        assert any(r.sv_type == kind and abs(r.start1 - p1) <= 5_000 and abs(r.start2 - p2) <= 5_000 for kind, _, p1, _, p2 in want), r


def test_parameters_are_those_of_the_data(spark, reads, contigs):
    m = molecule_calls.molecules(reads, contigs)
    p, frags = m.fitted, m.frags.collect()
    assert m.params.count() == 1
    long = [f for f in frags if f.length >= p["min_length"]]
    gaps = sorted(b.end - a.start for f in long for a, b in zip(f.map_pos, f.map_pos[1:]))
    assert (p["n_fragments"], p["n_reads"], p["n_barcodes"]) == (len(long), sum(f.num_reads for f in long), len({f.bcd for f in long}))
    for name, level in (("gap_p500", 0.5), ("gap_p750", 0.75), ("gap_p990", 0.99)):
        at = level * (len(gaps) - 1)
        lo = gaps[int(at)]
        assert abs(p[name] - (lo + (at - int(at)) * (gaps[min(int(at) + 1, len(gaps) - 1)] - lo))) < 1e-6
    assert p["cluster_cutoff"] >= 5_000 and 0 < p["read_rate"] < 0.01 and 0 < p["length_rate"] < 1e-3


def test_nothing_in_nothing_out(spark, reads, contigs):
    none = reads.limit(0)
    windows = spark.createDataFrame([], "tid int, idx long, mlog_p double")
    assert molecule_calls.detect(none, contigs, windows).count() == 0
