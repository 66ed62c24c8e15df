"""Text sources and sinks: alignments, SAM, BED, BEDPE, sequence records, blacklists, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import reads as R

#: The column order of an alignment table as text.
ALIGNMENTS = "tid int, start int, `end` int, mapq int, bcd string, hptype int, read_id string, flag int, n_left_clip int, n_right_clip int, insert_size int, mate_tid int, mate_pos int, cigar string"
BED = "chrom string, start int, `end` int"
BEDPE = "chrom1 string, start1 int, end1 int, chrom2 string, start2 int, end2 int, sv_type string, sv_id string, sv_length string, score double, filter string, info string"


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignment text, plain or gzipped; lines that start with ``#`` are left out."""
    return _tsv(spark, path, ALIGNMENTS)


def write_alignments(reads: DataFrame, path: str) -> None:
    names = [c.strip().split(" ")[0].strip("`") for c in ALIGNMENTS.split(",")]
    have = set(reads.columns)
    reads.select(*[F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names]).write.option("sep", "\t").csv(path)


def alignments_from_sam(lines: DataFrame, contigs: DataFrame) -> DataFrame:
    """Alignments of SAM lines (``value``): mapped ones with a ``BX`` barcode; haplotype ``HP``, 0 without; 0-based half-open."""
    rows = lines.where(~F.col("value").startswith("@")).withColumn("f", F.split("value", "\t"))
    tag = lambda t: F.regexp_extract("value", rf"\t{t}:[AifZ]:([^\t]+)", 1)
    f = lambda i: F.get("f", i)
    rows = rows.select(
        f(0).alias("read_id"), f(1).try_cast("int").alias("flag"), f(2).alias("chrom"), (f(3).try_cast("int") - 1).alias("start"), f(4).try_cast("int").alias("mapq"), f(5).alias("cigar"), f(6).alias("mate_chrom"),
        (f(7).try_cast("int") - 1).alias("mate_pos"), f(8).try_cast("int").alias("insert_size"), tag("BX").alias("bcd"), F.when(tag("HP") == "", 0).otherwise(tag("HP").try_cast("int")).alias("hptype"),
    ).where(~R.has_flag("flag", R.UNMAPPED) & (F.col("bcd") != ""))
    ops = R.cigar_parse(F.col("cigar"))
    rows = rows.withColumn("end", R.reference_end(F.col("start"), ops)).withColumn("_c", R.clip_sides(ops))
    rows = rows.withColumn("mate_chrom", F.when(F.col("mate_chrom") == "=", F.col("chrom")).otherwise(F.col("mate_chrom")))
    rows = rows.join(contigs.select("chrom", "tid"), "chrom").join(contigs.select(F.col("chrom").alias("mate_chrom"), F.col("tid").alias("mate_tid")), "mate_chrom", "left")
    return rows.select("tid", "start", "end", "mapq", "bcd", "hptype", "read_id", "flag", F.col("_c.left").alias("n_left_clip"), F.col("_c.right").alias("n_right_clip"), "insert_size", "mate_tid", "mate_pos", "cigar")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """A FASTA index as ``tid, chrom, length``, numbered in file order."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("tid", "line")).where("line <> ''")
    part = F.split("line", "\t")
    return rows.select("tid", F.get(part, 0).alias("chrom"), F.get(part, 1).try_cast("long").alias("length"))


def read_bed(spark: SparkSession, path: str, label: bool = False) -> DataFrame:
    return _tsv(spark, path, BED + (", label string" if label else ""))


def write_bed(intervals: DataFrame, path: str, extra: list[str] | None = None) -> None:
    intervals.select("chrom", "start", "end", *(extra or [])).write.option("sep", "\t").csv(path)


def name_to_tid(bed: DataFrame, contigs: DataFrame) -> DataFrame:
    """Intervals of known contigs with ``tid`` for the name."""
    return bed.join(contigs.select("chrom", "tid"), "chrom").drop("chrom")


def read_bedpe(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    """Twelve-column calls; ``method`` keeps those whose info names it."""
    rows = _tsv(spark, path, BEDPE)
    return rows.where(F.col("info").contains(f"SVMETHOD={method}")) if method else rows


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line."""
    return spark.read.text(path).select(F.trim("value").alias("chrom")).where("chrom <> '' and not startswith(chrom, '#')").distinct()


def read_2d_blacklist(spark: SparkSession, path: str, chr_prefix: bool = True, tile: int = 100_000) -> DataFrame:
    """Sections ``>chrom1,chrom2`` of lines ``pos1<TAB>pos2,pos2,...`` as ``chrom1, chrom2, pos1, pos2``.

    A section may have any length, and go on in the next file by name: each tile of lines finds its own
    headers, and what is open before it comes from the last header of an earlier tile, of which there is
    one row a tile. Sections whose header is not of this form, lines before any header, blank ones and
    those that begin with ``#`` are left out.
    """
    lines = numbered_lines(spark, path).where("value <> '' and not startswith(value, '#')").withColumn("tile", F.expr(f"n div {tile}"))
    parts = F.split(F.regexp_extract("value", r"^>([^,]+,.+)$", 1), ",")
    head = F.struct(F.trim(F.get(parts, 0)).alias("chrom1"), F.trim(F.get(parts, 1)).alias("chrom2"))
    lines = lines.withColumn("head", F.when(F.col("value").startswith(">"), head))
    last = lines.groupBy("file", "tile").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("n"))).alias("last"))
    earlier = Window.orderBy("file", "tile").rowsBetween(Window.unboundedPreceding, -1)  # one row a tile
    open_ = last.select("file", "tile", F.last("last", ignorenulls=True).over(earlier).alias("open"))
    within = Window.partitionBy("file", "tile").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("own", F.last("head", ignorenulls=True).over(within)).where("head is null").join(F.broadcast(open_), ["file", "tile"])
    rows = rows.select(F.coalesce("own", "open").alias("h"), "value").where("h.chrom2 is not null")
    out = rows.select("h.*", F.substring_index("value", "\t", 1).try_cast("int").alias("pos1"), F.explode(F.split(F.trim(F.substring_index("value", "\t", -1)), ",")).alias("pos2"))
    out = out.where("pos2 <> ''").withColumn("pos2", F.col("pos2").try_cast("int"))
    if chr_prefix:
        return out
    return out.withColumn("chrom1", F.regexp_replace("chrom1", "^chr", "")).withColumn("chrom2", F.regexp_replace("chrom2", "^chr", ""))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, comment, seq``: records split at line-starting ``>``, so that a record is one row of the scan."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where("v <> ''")
    head = F.substring_index("v", "\n", 1)
    seq = F.regexp_replace(F.expr("substr(v, instr(v, '\\n') + 1)"), r"\s", "")
    return rows.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("comment"), F.when(F.instr("v", "\n") > 0, seq).otherwise("").alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, value``: the lines of each file with their number from 0.

    A line's place within its block of the file, plus the lines of the blocks before it: no line
    passes through one task, and a file may be split anywhere.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("id0"), F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy("file").orderBy("block")) - F.col("k")
    return rows.join(blocks.withColumn("before", before), ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("id0")).alias("n"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Four-line records: ``name, comment, seq, qual``."""
    rows = numbered_lines(spark, path)
    line = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    recs = rows.groupBy("file", F.floor(F.col("n") / 4).alias("r")).agg(line(0).alias("h"), line(1).alias("seq"), line(3).alias("qual")).where("seq is not null and qual is not null")
    return recs.select(F.regexp_extract("h", r"^@(\S+)", 1).alias("name"), F.trim(F.regexp_replace("h", r"^\S+", "")).alias("comment"), "seq", "qual")


def write_fastq(records: DataFrame, path: str) -> None:
    records.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("name").cast("string")), "seq", F.lit("+"), "qual")).write.text(path)


def explode_alternative_hits(sam: DataFrame) -> DataFrame:
    """Each record (``name, chrom, pos, reverse, seq, xa``) and one secondary row for each hit of ``xa`` (``chrom,±pos,cigar,nm;...``)."""
    from strandloom.operators.sequences import reverse_complement

    hits = F.regexp_extract_all("xa", F.lit(r"([^;]+);"), F.lit(1))
    rows = sam.select("name", F.col("reverse").alias("was"), F.col("seq").alias("old"), F.explode(hits).alias("h"))
    part = F.split("h", ",")
    pos = F.get(part, 1)
    rev = pos.startswith("-")
    seq = F.when(rev != F.col("was"), reverse_complement(F.col("old"))).otherwise(F.col("old"))
    second = rows.select("name", F.get(part, 0).alias("chrom"), F.abs(pos.try_cast("int")).alias("pos"), rev.alias("reverse"), seq.alias("seq"), F.get(part, 2).alias("cigar"), F.lit(True).alias("secondary"))
    first = sam.select("name", "chrom", "pos", "reverse", "seq", "cigar", F.lit(False).alias("secondary"))
    return first.unionByName(second)


def stats_rows(one: DataFrame) -> DataFrame:
    """A one-row table as ``key, value`` text rows."""
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in one.columns]
    return one.select(F.inline(F.array(*pairs)))


def stats_row(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy().pivot("key", keys).agg(F.first("value"))


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage's table unless it is there already, and read it."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by_barcode_batch(reads: DataFrame, path: str, buckets: int) -> None:
    """One folder for each bucket of barcodes; a barcode is in one bucket."""
    bucket_of(reads, buckets).write.partitionBy("bucket").parquet(path)


def bucket_of(reads: DataFrame, buckets: int) -> DataFrame:
    return reads.withColumn("bucket", F.pmod(F.conv(F.substring(F.md5("bcd"), 1, 8), 16, 10).try_cast("long"), F.lit(buckets)).try_cast("int"))


def expand_region(calls: DataFrame, contigs: DataFrame, flank: int, pos: Column | str = "start1", chrom: str = "chrom1") -> DataFrame:
    """``lo, hi``: a breakpoint and its flanks, within the contig."""
    p = F.col(pos) if isinstance(pos, str) else pos
    c = contigs.select(F.col("chrom").alias("_c"), "length")
    return calls.join(F.broadcast(c), F.col(chrom) == F.col("_c")).withColumn("lo", F.greatest(p - flank, F.lit(0))).withColumn("hi", F.least(p + flank, "length")).drop("_c", "length")


def tile_contigs(contigs: DataFrame, size: int = 200_000) -> DataFrame:
    """Windows of ``size`` that overlap by a tenth; the last, partial one is left out."""
    starts = F.sequence(F.lit(0).try_cast("long"), F.col("length").try_cast("long"), F.lit(size - size // 10).try_cast("long"))
    return contigs.select("tid", "length", F.explode(starts).alias("start")).where(F.col("start") + size <= F.col("length")).select("tid", "start", (F.col("start") + size).alias("end"))


def indel_to_deletion(vcf: DataFrame, least: int = 50) -> DataFrame:
    """Assembled variants (``contig`` = ``chrom:start-end``, ``pos, ref, alt, info``) as deletions: ``chrom, start, end, length, score``.

    A row counts if the reference is more than ``least`` bases longer, or if its info says DEL of such a
    length; breakends do not. Places are shifted by the region's start.
    """
    at = F.regexp_extract("contig", r":(\d+)-", 1).try_cast("long")
    info = F.str_to_map("info", F.lit(";"), F.lit("="))
    rows = vcf.where(~F.col("alt").rlike(r"[\[\]]")).withColumn("_at", at).withColumn("_i", info)
    by_text = F.when(F.length("ref") - F.length("alt") > least, F.length("ref") - F.length("alt"))
    by_info = F.when((F.element_at("_i", "SVTYPE") == "DEL") & (F.abs(F.element_at("_i", "SVLEN").try_cast("int")) > least), F.abs(F.element_at("_i", "SVLEN").try_cast("int")))
    rows = rows.withColumn("length", F.coalesce(by_info, F.when(F.col("alt").rlike("^[ACGTN]+$"), by_text))).where("length is not null")
    return rows.select(F.regexp_extract("contig", r"^([^:]+):", 1).alias("chrom"), (F.col("_at") + F.col("pos")).alias("start"), (F.col("_at") + F.col("pos") + F.col("length")).alias("end"), "length", F.lit(30).alias("score"))


def deletion_calls_to_bed(calls: DataFrame, shortest: int = 50, longest: int = 1_000_000) -> DataFrame:
    """Deletions of several dialects (``chrom, pos, ref, alt, filter, info, gt``) as intervals: symbolic, by END or SVLEN, or spelled out."""
    end = F.regexp_extract("info", r"(?:^|;)END=(\d+)", 1).try_cast("long")
    size = F.abs(F.regexp_extract("info", r"(?:^|;)SVLEN=(-?\d+)", 1).try_cast("int"))
    stop = F.when(F.col("alt") == "<DEL>", F.coalesce(end, F.col("pos") + size)).when(F.col("alt").rlike("^[ACGTN]+$") & (F.length("ref") > F.length("alt")), F.col("pos") + F.length("ref") - F.length("alt"))
    ok = F.col("filter").isin("PASS", ".") & ~F.coalesce(F.col("gt"), F.lit("")).rlike(r"^0[/|]0")
    rows = calls.where(ok).select("chrom", F.col("pos").alias("start"), stop.alias("end"))
    return rows.where((F.col("end") - F.col("start")).between(shortest, longest))
