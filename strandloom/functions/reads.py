"""Expressions over one alignment or one pair of alignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SAM flag bits.
UNMAPPED, REVERSE, READ1, READ2, SECONDARY, DUPLICATE, SUPPLEMENTARY, QC_FAIL = 4, 16, 64, 128, 256, 1024, 2048, 512
NOT_PRIMARY = SECONDARY + QC_FAIL + DUPLICATE + SUPPLEMENTARY
#: Flags that depth, first-round and second-round clustering leave out.
NOT_FOR_DEPTH = SECONDARY + DUPLICATE + SUPPLEMENTARY
NOT_FOR_ROUND1 = UNMAPPED + NOT_FOR_DEPTH
NOT_FOR_ROUND2 = UNMAPPED + DUPLICATE
#: Discordance bits.
OTHER_CONTIG, SAME_STRAND, EVERTED, FAR_APART = 1, 2, 4, 8
#: Genome keys put contigs this far apart.
CONTIG_STRIDE = 10_000_000_000
#: Packed barcodes that hold anything but A, C, G, T.
BAD_BARCODE = 4294967295


def has_flag(flag: Column | str, bits: int) -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(F.lit(bits)) != 0


def usable(flag: Column | str = "flag", mask: int = NOT_FOR_DEPTH) -> Column:
    return ~has_flag(flag, mask)


def sv_support_type(mask: Column) -> Column:
    """The first that holds of: other contig, same strand, everted, far apart."""
    return (
        F.when(has_flag(mask, OTHER_CONTIG), "TRA").when(has_flag(mask, SAME_STRAND), "INV").when(has_flag(mask, EVERTED), "DUP").when(has_flag(mask, FAR_APART), "DEL")
    )


def cigar_parse(cigar: Column) -> Column:
    """array<struct<len, op>>; null and ``*`` give an empty array."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.coalesce(F.zip_with(n, op, lambda a, b: F.struct(a.cast("int").alias("len"), b.alias("op"))), F.expr("cast(array() as array<struct<len:int,op:string>>)"))


def consumed(ops: Column, kinds: str) -> Column:
    """Bases that operations of the kinds cover."""
    return F.aggregate(ops, F.lit(0), lambda t, x: t + F.when(F.instr(F.lit(kinds), x["op"]) > 0, x["len"]).otherwise(0))


def reference_end(start: Column, ops: Column, inclusive: bool = False) -> Column:
    return start + consumed(ops, "MDN=X") - (1 if inclusive else 0)


def clip_sides(ops: Column) -> Column:
    """struct(left, right, side): clipped bases at both ends and the end with more of them, ``left`` on ties, null without clips."""
    first, last = F.get(ops, 0), F.get(ops, F.size(ops) - 1)
    is_clip = lambda x: F.coalesce(x["op"].isin("S", "H"), F.lit(False))
    left = F.when(is_clip(first), first["len"]).otherwise(0)
    right = F.when(is_clip(last) & (F.size(ops) > 1), last["len"]).otherwise(0)
    return F.struct(left.alias("left"), right.alias("right"), F.when((left > 0) & (left >= right), "left").when(right > 0, "right").alias("side"))


def read_end_pos(start: Column, end: Column, flag: Column) -> Column:
    """Where the read's 3' end lies: its start if it is reversed, else its last base."""
    return F.when(has_flag(flag, REVERSE), start).otherwise(end - 1)


def genome_key(tid: Column, pos: Column) -> Column:
    return tid.cast("long") * CONTIG_STRIDE + pos


def split_key(key: Column) -> Column:
    return F.struct(F.floor(key / CONTIG_STRIDE).cast("int").alias("tid"), F.pmod(key, F.lit(CONTIG_STRIDE)).cast("int").alias("pos"))


def barcode_pack(bcd: Column, length: int = 16) -> Column:
    """Two bits a base, first base highest; anything after ``-`` is left out."""
    bases = F.substring_index(F.upper(bcd), "-", 1)
    digits = F.translate(bases, "ACGT", "0123")
    packed = F.conv(digits, 4, 10).cast("long")
    return F.when(bases.rlike(f"^[ACGT]{{1,{length}}}$"), packed).otherwise(F.lit(BAD_BARCODE))


def barcode_unpack(packed: Column, length: int = 16) -> Column:
    return F.concat(F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), length, "0"), "0123", "ACGT"), F.lit("-1"))


def _same_mate(f1: Column, f2: Column) -> Column:
    return (has_flag(f1, READ1) == has_flag(f2, READ1)) | (has_flag(f1, READ2) == has_flag(f2, READ2))


def inner_size(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The gap between two mates that face each other on one contig; null otherwise. a, b: tid, start, end, flag."""
    ra, rb = has_flag(a["flag"], REVERSE), has_flag(b["flag"], REVERSE)
    facing = ~_same_mate(a["flag"], b["flag"]) & (ra != rb) & (a["tid"] == b["tid"])
    ahead = F.when(~ra & (a["start"] <= b["start"]), b["start"] - a["end"]).when(~rb & (b["start"] <= a["start"]), a["start"] - b["end"])
    return F.when(facing, ahead)


def discordance_mask(a: dict[str, Column], b: dict[str, Column], cutoff: int | Column, compare_contigs: bool = True) -> Column:
    """Bits of what sets two mates apart; 0 for one mate, and for pairs nearer than the cutoff.

    ``compare_contigs=False`` also calls pairs on different contigs near if their offsets are.
    """
    near = (F.abs(a["start"] - b["end"]) < cutoff) & (F.abs(b["start"] - a["end"]) < cutoff)
    same = a["tid"] == b["tid"]
    near = near & same if compare_contigs else near
    ra, rb = has_flag(a["flag"], REVERSE), has_flag(b["flag"], REVERSE)
    everted = (~ra & rb & (a["start"] > b["start"])) | (~rb & ra & (b["start"] > a["start"]))
    far = F.coalesce(inner_size(a, b) > cutoff, F.lit(False))
    bit = lambda on, k: F.when(on, F.lit(k)).otherwise(0)
    bits = bit(ra == rb, SAME_STRAND) + bit(everted, EVERTED) + bit(far, FAR_APART)
    return F.when(_same_mate(a["flag"], b["flag"]) | near, 0).when(~same, OTHER_CONTIG).otherwise(bits)


def frag_gap_distances(map_pos: str) -> Column:
    """Each read's end less the start of the read before it."""
    p = F.col(map_pos)
    return F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: x["end"] - F.get(p, i)["start"])


def fragment_hap_type(hp0: Column, hp1: Column, hp2: Column) -> Column:
    """The haplotype of more than half of the reads; 0 if there is none."""
    n = hp0 + hp1 + hp2
    return F.when(2 * hp1 > n, 1).when(2 * hp2 > n, 2).otherwise(0)


def high_qual_read_count(map_qual: Column) -> Column:
    return F.size(F.filter(map_qual, lambda x: x))


def special_contig_class(chrom: Column) -> Column:
    """2: X, 1: Y, 3: mitochondrial, 0: unplaced or decoy, null: an autosome."""
    name = F.regexp_replace(F.upper(chrom), "^CHR", "")
    return F.when(name == "X", 2).when(name == "Y", 1).when(name.isin("M", "MT"), 3).when(name.rlike(r"_|^(GL|NC|KI|JH|HLA|HS|UN|EBV)"), 0)
