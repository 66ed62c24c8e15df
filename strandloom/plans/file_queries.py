"""Queries that write tables as text or Parquet and read them again, and streams over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import reads as R
from strandloom.operators import fragments
from strandloom.plans.call_queries import CALLS, calls
from strandloom.plans.read_queries import W2, contigs, reads
from strandloom.plans.registry import query
from strandloom.plans.sequence_queries import seqs
from strandloom.session import new_path
from strandloom.sources import files
from strandloom.sources.views import view, widened
from strandloom.streaming import events


@query('select tid, start, "end", mapq, bcd, hptype, read_id, flag, cigar from reads', "reads")
def s1_read_alignments(spark, sf):
    path = new_path(spark, "alignments")
    files.write_alignments(reads(spark, sf), path)
    return files.read_alignments(spark, path).select("tid", "start", "end", "mapq", "bcd", "hptype", "read_id", "flag", "cigar")


@query(
    r"""with s as (select *, list_transform(regexp_extract_all(cigar, '\d+[MIDNSHP=X]'), lambda x: x[:-2]::int) as lens, list_transform(regexp_extract_all(cigar, '\d+[MIDNSHP=X]'), lambda x: x[-1]) as ops from reads where line % 5 <> 0 and (flag & 4) = 0)
    select tid, start, (start + list_sum(list_transform(range(1, len(ops) + 1), lambda i: case when contains('MDN=X', ops[i]) then lens[i] else 0 end)))::int as "end", mapq, bcd, hptype, read_id, flag,
    case when ops[1] in ('S', 'H') then lens[1] else 0 end as n_left_clip, case when len(ops) > 1 and ops[-1] in ('S', 'H') then lens[-1] else 0 end as n_right_clip from s""",
    "reads",
)
def s2_alignments_from_sam(spark, sf):
    col = lambda c: F.col(c).cast("string")
    tags = F.concat_ws("\t", F.when(F.col("line") % 5 != 0, F.concat(F.lit("BX:Z:"), "bcd")), F.concat(F.lit("HP:i:"), col("hptype")))
    sam = reads(spark, sf).select(F.concat_ws("\t", "read_id", col("flag"), F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string")), (F.col("start") + 1).cast("string"), col("mapq"), "cigar", F.lit("="), (F.col("start") + 301).cast("string"), F.lit("300"), F.lit("*"), F.lit("*"), tags).alias("value"))
    path = new_path(spark, "sam")
    sam.write.text(path)
    return files.alignments_from_sam(spark.read.text(path), contigs(spark, sf)).select("tid", "start", "end", "mapq", "bcd", "hptype", "read_id", "flag", "n_left_clip", "n_right_clip")


@query('select tid, start, "end", label from regions', "regions")
def s7_read_bed(spark, sf):
    path = new_path(spark, "bed")
    named = view(spark, sf, "regions").withColumn("chrom", F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string")))
    files.write_bed(named, path, ["label"])
    return files.name_to_tid(files.read_bed(spark, path, label=True), contigs(spark, sf)).select("tid", "start", "end", "label")


@query("""select 'chr' || (tid + 1) as chrom, start, "end" from gaps""", "gaps")
def k2_write_bed(spark, sf):
    path = new_path(spark, "bed")
    files.write_bed(view(spark, sf, "gaps").withColumn("chrom", F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string"))), path)
    return files.read_bed(spark, path)


@query(f"with {CALLS} select chrom1, start1, chrom2, start2, sv_type, score::double as score from calls")
def s9_read_bedpe(spark, sf):
    from strandloom.operators.calls import bedpe_rows

    path = new_path(spark, "bedpe")
    bedpe_rows(calls(spark, sf)).write.option("sep", "\t").csv(path)
    return files.read_bedpe(spark, path, "LINKED_READS").select("chrom1", "start1", "chrom2", "start2", "sv_type", "score")


@query("select distinct 'chr' || (tid + 1) as chrom from reads where tid >= 3", "reads")
def s10_read_alt_contigs(spark, sf):
    path = new_path(spark, "names")
    contigs(spark, sf).where("tid >= 3").select(F.col("chrom").alias("value")).write.text(path)
    return files.read_names(spark, path)


@query("select 'chr' || (l_suppkey % 3 + 1) as chrom1, 'chr' || (l_linenumber % 3 + 1) as chrom2, l_partkey::int as pos1, (l_orderkey % 1000)::int as pos2 from lineitem group by all")
def s11_read_2d_blacklist(spark, sf):
    pts = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("concat('chr', l_suppkey % 3 + 1) as chrom1", "concat('chr', l_linenumber % 3 + 1) as chrom2", "cast(l_partkey as int) as pos1", "cast(l_orderkey % 1000 as int) as pos2").distinct()
    lines = pts.groupBy("chrom1", "chrom2", "pos1").agg(F.array_join(F.array_sort(F.collect_list("pos2")).cast("array<string>"), ",").alias("p"))
    # header and lines of a section follow each other over all files, whose cuts fall anywhere
    lines = lines.select("chrom1", "chrom2", "pos1", F.concat_ws("\t", F.col("pos1").cast("string"), "p").alias("line"))
    heads = lines.select("chrom1", "chrom2").distinct().select("*", F.lit(-1).alias("pos1"), F.concat(F.lit(">"), "chrom1", F.lit(","), "chrom2").alias("line"))
    path = new_path(spark, "points")
    lines.unionByName(heads).repartitionByRange("chrom1", "chrom2", "pos1").sortWithinPartitions("chrom1", "chrom2", "pos1").select(F.col("line").alias("value")).write.text(path)
    return files.read_2d_blacklist(spark, path)


@query("select name::varchar as name, 'doc' as comment, seq, length(seq) as n from seqs where seq <> ''", "seqs")
def s13_read_fastx(spark, sf):
    path = new_path(spark, "fastq")
    rows = seqs(spark, sf).where("seq <> ''").select(F.concat(F.col("name").cast("string"), F.lit(" doc")).alias("name"), "seq", F.translate("seq", "ACGTN", "@I5+!").alias("qual"))
    files.write_fastq(rows, path)
    return files.read_fastq(spark, path).where(F.translate("qual", "@I5+!", "ACGTN") == F.col("seq")).select("name", "comment", "seq", F.length("seq").cast("long").alias("n"))


@query("select name::varchar as name, 'doc' as comment, seq from seqs where seq <> ''", "seqs")
def s13_read_fasta(spark, sf):
    path = new_path(spark, "fasta")
    folded = F.regexp_replace("seq", "(.{60})", "$1\n")
    seqs(spark, sf).where("seq <> ''").select(F.concat(F.lit(">"), F.col("name").cast("string"), F.lit(" doc\n"), folded).alias("value")).write.text(path)
    return files.read_fasta(spark, path)


@query(
    """with b as (select name, 'chr' || (name % 5) as chrom, (name * 7)::int as pos, name % 2 = 1 as reverse, seq, length(seq) as n from seqs) select name, chrom, pos, reverse, seq, n || 'M' as cigar, false as secondary from b
    union all select name, 'chrA', pos + 5, false, case when reverse then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end, greatest(n - 1, 0) || 'M1S', true from b union all select name, 'chrB', pos + 9, true, case when reverse then seq else reverse(translate(seq, 'ACGT', 'TGCA')) end, greatest(n - 2, 0) || 'M2S', true from b where name % 3 = 0""",
    "seqs",
)
def s14_explode_alternative_hits(spark, sf):
    pos, n = (F.col("name") * 7).cast("int"), F.length("seq")
    clip = lambda k: F.concat(F.greatest(n - k, F.lit(0)).cast("string"), F.lit(f"M{k}S,{k};"))
    xa = F.concat(F.lit("chrA,+"), (pos + 5).cast("string"), F.lit(","), clip(1), F.when(F.col("name") % 3 == 0, F.concat(F.lit("chrB,-"), (pos + 9).cast("string"), F.lit(","), clip(2))).otherwise(""))
    sam = seqs(spark, sf).select("name", F.concat(F.lit("chr"), (F.col("name") % 5).cast("string")).alias("chrom"), pos.alias("pos"), (F.col("name") % 2 == 1).alias("reverse"), "seq", F.concat(n.cast("string"), F.lit("M")).alias("cigar"), xa.alias("xa"))
    return files.explode_alternative_hits(sam)


@query("select bcd, count(*) as n from reads group by bcd", "reads")
def k3_write_stage_table(spark, sf):
    path = new_path(spark, "stage")
    rows = reads(spark, sf).groupBy("bcd").agg(F.count(F.lit(1)).alias("n"))
    files.write_stage(rows, path)
    return files.write_stage(rows.limit(0), path)  # there already: the first table stays


@query("with b as (select ('0x' || substr(md5(bcd), 1, 8))::bigint % 16 as bucket, bcd from reads) select bucket::int as bucket, count(*) as n, count(distinct bcd) as n_barcodes from b group by 1", "reads")
def k4_partition_by_barcode_batch(spark, sf):
    path = new_path(spark, "buckets")
    files.write_by_barcode_batch(reads(spark, sf), path, 16)
    return spark.read.parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bcd").alias("n_barcodes"))


@query("select unnest(['n', 'n_duplicate', 'max_end']) as key, unnest([count(*)::varchar, (count(*) filter ((flag & 1024) <> 0))::varchar, max(\"end\")::varchar]) as value from reads", "reads")
def k5_stats_sink(spark, sf):
    one = reads(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(R.has_flag("flag", 1024)).alias("n_duplicate"), F.max("end").alias("max_end"))
    path = new_path(spark, "stats")
    files.stats_rows(one).write.option("sep", "\t").csv(path)
    return spark.read.schema("key string, value string").option("sep", "\t").csv(path)


@query("""with c as (select tid, max("end") + 1000 as length from reads group by tid), t as (select tid, length, unnest(range(0, length + 1, 9000)) as start from c) select tid, start, start + 10000 as "end" from t where start + 10000 <= length""", "reads")
def p25_tile_contigs(spark, sf):
    return files.tile_contigs(contigs(spark, sf), 10_000)


@query(f"""with {CALLS}, c as (select 'chr' || (tid + 1) as chrom, max("end") + 1000 as length from reads group by tid) select call_id, greatest(start1 - 50000, 0) as lo, least(start1 + 50000, length) as hi from calls join c on chrom = chrom1""", "reads")
def p24_expand_region(spark, sf):
    return files.expand_region(calls(spark, sf), contigs(spark, sf), 50_000).select("call_id", "lo", "hi")


_VCF = """v as (select 'chr' || (l_suppkey % 5 + 1) || ':' || (l_partkey * 500) || '-' || (l_partkey * 500 + 20000) as contig, (l_orderkey % 20000)::int as pos, case when l_linenumber % 3 = 0 then repeat('A', 10 + l_quantity::int * 2) else 'A' end as ref,
  case l_linenumber % 4 when 0 then '<DEL>' when 1 then 'A' when 2 then 'N[chr1:5[' else 'A' end as alt, case when l_linenumber % 4 = 0 then 'SVTYPE=DEL;SVLEN=-' || (l_quantity::int * 3) else 'DP=5' end as info, l_partkey from lineitem)"""


P26 = f"""{_VCF},
dl as (select *, case when alt like '%[%' then null when alt = '<DEL>' and ('x' || info) like '%SVTYPE=DEL%' then case when abs(regexp_extract(info, 'SVLEN=(-?[0-9]+)', 1)::int) > 50 then abs(regexp_extract(info, 'SVLEN=(-?[0-9]+)', 1)::int) end when alt <> '<DEL>' and length(ref) - length(alt) > 50 then length(ref) - length(alt) end as length from v),
p26 as (select split_part(contig, ':', 1) as chrom, (l_partkey * 500 + pos)::int as start, (l_partkey * 500 + pos + length)::int as "end", length::int as length, 30 as score from dl where length is not null)"""


@query(f"with {P26} select * from p26")
def p26_indel_to_deletion(spark, sf):
    v = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "concat('chr', l_suppkey % 5 + 1, ':', l_partkey * 500, '-', l_partkey * 500 + 20000) as contig", "cast(l_orderkey % 20000 as int) as pos",
        "case when l_linenumber % 3 = 0 then repeat('A', 10 + cast(l_quantity as int) * 2) else 'A' end as ref", "case l_linenumber % 4 when 0 then '<DEL>' when 1 then 'A' when 2 then 'N[chr1:5[' else 'A' end as alt",
        "case when l_linenumber % 4 = 0 then concat('SVTYPE=DEL;SVLEN=-', cast(l_quantity as int) * 3) else 'DP=5' end as info",
    )
    return files.indel_to_deletion(v)


_DELS = [
    "concat('chr', l_suppkey % 5 + 1) as chrom", "cast(l_partkey * 500 as int) as pos", "case when l_linenumber % 3 = 0 then repeat('A', 10 + cast(l_quantity as int) * 2) else 'A' end as ref", "case when l_linenumber % 3 = 1 then '<DEL>' else 'A' end as alt",
    "case when l_linenumber % 5 = 0 then 'q10' when l_linenumber % 5 = 1 then '.' else 'PASS' end as filter", "case when l_linenumber % 2 = 1 then concat('SVTYPE=DEL;END=', l_partkey * 500 + cast(l_quantity as int) * 5) else concat('SVLEN=-', cast(l_quantity as int) * 4, ';X=1') end as info",
    "case when l_linenumber % 7 = 0 then '0/0:9' else '0/1' end as gt",
]


@query(
    f"""with d as (select {", ".join(_DELS)} from lineitem), e as (select chrom, pos as start, case when alt = '<DEL>' then case when info like '%END=%' then regexp_extract(info, 'END=([0-9]+)', 1)::int else pos + abs(regexp_extract(info, 'SVLEN=(-?[0-9]+)', 1)::int) end when length(ref) > length(alt) then pos + length(ref) - length(alt) end as "end"
    from d where filter in ('PASS', '.') and gt not like '0/0%') select chrom, start, ("end")::int as "end" from e where "end" - start between 50 and 1000000"""
)
def p36_deletion_calls_to_bed(spark, sf):
    return files.deletion_calls_to_bed(spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*widened(_DELS)))


# streams


def _stream(spark, df, label: str):
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query('select tid, ((start + "end") // 200)::int as bin, sum(case when mapq >= 20 then "end" - start else 0 end) / 100 as hq, sum("end" - start) / 100 as total from reads where (flag & 3328) = 0 group by 1, 2', "reads")
def r1_stream_depth(spark, sf):
    return events.run_to_table(events.stream_depth(_stream(spark, reads(spark, sf), "reads")), "complete", "depth")


@query(
    """with o as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hours then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from o),
    g as (select user_id, k, count(*) as n, epoch_us(min(ts)) as first, epoch_us(max(ts)) as last from s group by user_id, k) select user_id, n, first, last from g where last + 6 * 3600 * 1000000::bigint <= (select epoch_us(max(ts)) from events) - 3600 * 1000000::bigint"""
)
def r2_stream_gap_sessions(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("time"))
    out = events.run_to_table(events.stream_gap_sessions(_stream(spark, rows, "events"), "user_id", "time", "6 hours", "1 hour"), "append", "sessions")
    return out.select("user_id", "n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


@query(W2, "reads")
def r2_stream_fragments(spark, sf):
    """Reads come in an order of no meaning, in two batches over a day; one far later closes what is open."""
    place = F.pmod(F.hash("read_id", "line", "start"), F.lit(86_400))
    rows = reads(spark, sf).withColumn("time", F.timestamp_seconds(F.lit(1_700_000_000) + place))
    path = new_path(spark, "deliveries")
    rows.repartition(2).write.parquet(path)
    last = rows.limit(1).withColumn("bcd", F.lit("closing")).withColumn("flag", F.lit(0)).withColumn("time", F.timestamp_seconds(F.lit(1_900_000_000)))
    last.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return events.run_to_table(events.stream_fragments(stream, "time", 20_000, 500, "1 hour", "2 days", min_good=1), "append", "fragments")


@query(
    """with once as (select distinct on (bcd, read_id, flag, tid, start, line) * from reads) select count(*) filter ((flag & 2304) = 0) as n_primary, count(*) filter ((flag & 4) <> 0) as n_unmapped, count(*) filter ((flag & 2048) <> 0) as n_supplementary, count(*) filter ((flag & 256) <> 0) as n_secondary,
    count(*) filter ((flag & 1024) <> 0) as n_duplicate, count(*) filter (mapq >= 30) as n_mapq30, count(*) filter (mapq between 20 and 29) as n_mapq20, count(*) filter (mapq between 10 and 19) as n_mapq10, count(*) filter (bcd is null) as n_no_barcode, count(*) filter (hptype = 0) as n_no_haplotype,
    count(*) - count(*) filter ((flag & 1024) <> 0) - count(*) filter ((flag & 256) <> 0) - count(*) filter ((flag & 2048) <> 0) as n_effective from once""",
    "reads",
)
def r3_stream_stats(spark, sf):
    """Every record is delivered twice."""
    rows = reads(spark, sf)
    return events.run_to_table(events.stream_stats(_stream(spark, rows.unionAll(rows), "reads")), "complete", "stats")


__all__ = ["fragments"]
