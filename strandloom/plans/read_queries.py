"""Queries over alignments, fragments, depth and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import reads as R
from strandloom.operators import depth, fragments, intervals
from strandloom.plans.registry import query
from strandloom.sources.views import view

GAP, PAIR = 50_000, 1_000
ORDER = 'start, "end", read_id, flag, line'

_W1 = f"""marked as (select *, case when start - lag("end") over (partition by bcd, tid order by {ORDER}) < 50000 then 0 else 1 end as new from reads where (flag & 3332) = 0),
sessions as (select *, sum(new) over (partition by bcd, tid order by {ORDER} rows unbounded preceding) as frag from marked)"""
FRAGS = f"""{_W1},
frags as (select bcd, tid, frag::bigint as frag, bcd || ':' || tid || ':' || frag as frag_id, min(start) as start, last("end" order by {ORDER}) as "end", count(*) as num_reads, count(*) filter (mapq >= 20) as num_good_reads,
  count(*) filter (hptype = 0) as hp0, count(*) filter (hptype = 1) as hp1, count(*) filter (hptype = 2) as hp2, last("end" order by {ORDER}) - min(start) as length,
  list(start order by {ORDER}) as starts, list("end" order by {ORDER}) as ends from sessions group by bcd, tid, frag)"""


def reads(spark, sf):
    return view(spark, sf, "reads")


def frags(spark, sf) -> DataFrame:
    """First-round fragments with all their columns, named by barcode, contig and number."""
    rows = fragments.assemble(fragments.gap_sessions(reads(spark, sf), GAP))
    return rows.withColumn("frag_id", F.concat_ws(":", "bcd", "tid", "frag"))


def contigs(spark, sf) -> DataFrame:
    return contigs_of(reads(spark, sf))


def contigs_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tid").agg((F.max("end") + 1000).alias("length")).withColumn("chrom", F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string")))


# scans and single-alignment expressions


@query(
    """select count(*) filter ((flag & 2304) = 0) as n_primary, count(*) filter ((flag & 4) <> 0) as n_unmapped, count(*) filter ((flag & 2048) <> 0) as n_supplementary, count(*) filter ((flag & 256) <> 0) as n_secondary,
    count(*) filter ((flag & 1024) <> 0) as n_duplicate, count(*) filter (mapq >= 30) as n_mapq30, count(*) filter (mapq between 20 and 29) as n_mapq20, count(*) filter (mapq between 10 and 19) as n_mapq10,
    count(*) filter (bcd is null) as n_no_barcode, count(*) filter (hptype = 0) as n_no_haplotype, count(*) - count(*) filter ((flag & 1024) <> 0) - count(*) filter ((flag & 256) <> 0) - count(*) filter ((flag & 2048) <> 0) as n_effective from reads""",
    "reads",
)
def s3_alignment_stats(spark, sf):
    return depth.alignment_stats(reads(spark, sf))


@query(f"select bcd, tid, start, \"end\", read_id, flag, line, row_number() over (partition by bcd order by tid, {ORDER}) as place from reads", "reads")
def s4_sort_by_barcode(spark, sf):
    from pyspark.sql import Window

    rows = reads(spark, sf).repartition("bcd").sortWithinPartitions("bcd", "tid", *fragments.ORDER)
    return rows.select("bcd", "tid", *fragments.ORDER, F.row_number().over(Window.partitionBy("bcd").orderBy("tid", *fragments.ORDER)).cast("long").alias("place"))


@query('select tid, chrom, length, (sum(length) over ())::bigint as genome_length from (select tid, \'chr\' || (tid + 1) as chrom, max("end") + 1000 as length from reads group by tid)', "reads")
def s6_read_contigs(spark, sf):
    from pyspark.sql import Window

    return contigs(spark, sf).select("tid", "chrom", "length", F.sum("length").over(Window.partitionBy()).alias("genome_length"))


@query('select r.tid, r.start, r."end", r.label from regions r join (select distinct tid from reads where tid < 4) c on r.tid = c.tid', "regions", "reads")
def s8_bed_to_tid_bed(spark, sf):
    known = contigs(spark, sf).where("tid < 4").select("chrom", F.col("tid").alias("t"))
    named = view(spark, sf, "regions").withColumn("chrom", F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string"))).drop("tid")
    return named.join(known, "chrom").select(F.col("t").alias("tid"), "start", "end", "label")


@query("select read_id, line, (flag & 3840) <> 0 as not_primary, (flag & 16) <> 0 as is_reverse, (flag & 64) <> 0 as is_read1, (flag & 128) <> 0 as is_read2 from reads", "reads")
def p1_flag_bits(spark, sf):
    f = lambda k: R.has_flag("flag", k)
    return reads(spark, sf).select("read_id", "line", f(R.NOT_PRIMARY).alias("not_primary"), f(R.REVERSE).alias("is_reverse"), f(R.READ1).alias("is_read1"), f(R.READ2).alias("is_read2"))


_CIG = r"""o as (select *, list_transform(regexp_extract_all(cigar, '\d+[MIDNSHP=X]'), lambda x: x[:-2]::int) as lens, list_transform(regexp_extract_all(cigar, '\d+[MIDNSHP=X]'), lambda x: x[-1]) as ops from reads)"""


@query(f"with {_CIG} select read_id, line, array_to_string(lens, ',') as lens, array_to_string(ops, ',') as ops from o", "reads")
def p3_cigar_parse(spark, sf):
    rows = reads(spark, sf).withColumn("c", R.cigar_parse(F.col("cigar")))
    return rows.select("read_id", "line", F.array_join(F.col("c.len").cast("array<string>"), ",").alias("lens"), F.array_join("c.op", ",").alias("ops"))


@query(
    f"""with {_CIG} select read_id, line, (start + list_sum(list_transform(range(1, len(ops) + 1), lambda i: case when contains('MDN=X', ops[i]) then lens[i] else 0 end)))::int as ref_end,
    (start + list_sum(list_transform(range(1, len(ops) + 1), lambda i: case when contains('MDN=X', ops[i]) then lens[i] else 0 end)) - 1)::int as ref_last from o""",
    "reads",
)
def p4_reference_end(spark, sf):
    rows = reads(spark, sf).withColumn("c", R.cigar_parse(F.col("cigar")))
    return rows.select("read_id", "line", R.reference_end(F.col("start"), F.col("c")).alias("ref_end"), R.reference_end(F.col("start"), F.col("c"), True).alias("ref_last"))


@query(
    f"""with {_CIG}, s as (select read_id, line, case when ops[1] in ('S', 'H') then lens[1] else 0 end as l, case when len(ops) > 1 and ops[-1] in ('S', 'H') then lens[-1] else 0 end as r from o)
    select read_id, line, l as n_left, r as n_right, case when l > 0 and l >= r then 'left' when r > 0 then 'right' end as side from s""",
    "reads",
)
def p5_clip_sides(spark, sf):
    rows = reads(spark, sf).withColumn("s", R.clip_sides(R.cigar_parse(F.col("cigar"))))
    return rows.select("read_id", "line", F.col("s.left").alias("n_left"), F.col("s.right").alias("n_right"), "s.side")


@query('select read_id, line, case when (flag & 16) <> 0 then start else "end" - 1 end as end_pos from reads', "reads")
def p6_read_end_pos(spark, sf):
    return reads(spark, sf).select("read_id", "line", R.read_end_pos(F.col("start"), F.col("end"), F.col("flag")).alias("end_pos"))


@query("select read_id, line, tid::bigint * 10000000000 + start as key, tid, start as pos from reads", "reads")
def p7_genome_key(spark, sf):
    rows = reads(spark, sf).withColumn("key", R.genome_key(F.col("tid"), F.col("start"))).withColumn("s", R.split_key(F.col("key")))
    return rows.select("read_id", "line", "key", "s.tid", "s.pos")


_PACKABLE = "translate(right('0000000' || substr(bcd, 2), 8), '0123456789', 'ACGTACGTNA')"


@query(
    f"""with b as (select distinct bcd, {_PACKABLE} as bases from reads), d as (select *, translate(bases, 'ACGT', '0123') as digits from b)
    select bcd, bases, case when bases similar to '[ACGT]+' then list_sum(list_transform(range(1, 9), lambda i: digits[i]::bigint * (4 ** (8 - i))::bigint))::bigint else 4294967295 end as packed,
    case when bases similar to '[ACGT]+' then bases || '-1' end as unpacked from d""",
    "reads",
)
def p8_barcode_pack(spark, sf):
    rows = reads(spark, sf).select("bcd").distinct().withColumn("bases", F.translate(F.lpad(F.expr("substr(bcd, 2)"), 8, "0"), "0123456789", "ACGTACGTNA"))
    packed = R.barcode_pack(F.col("bases"))
    return rows.select("bcd", "bases", packed.alias("packed"), F.when(packed != R.BAD_BARCODE, R.barcode_unpack(packed, 8)).alias("unpacked"))


@query(
    """with c as (select tid, max("end") + 1000 as length from reads group by tid), o as (select tid, (sum(length) over (order by tid) - length)::bigint as before from c)
    select read_id, line, before + start as linear, r.tid, start as pos from reads r join o on r.tid = o.tid""",
    "reads",
)
def p9_linear_position(spark, sf):
    from pyspark.sql import Window

    c = contigs(spark, sf).withColumn("before", F.sum("length").over(Window.orderBy("tid")) - F.col("length"))
    lin = reads(spark, sf).join(F.broadcast(c.select("tid", "before")), "tid").select("read_id", "line", (F.col("before") + F.col("start")).alias("linear"))
    # back: one contig holds each linear position
    spans = F.broadcast(c.select(F.col("tid").alias("t"), "before", (F.col("before") + F.col("length")).alias("after")))
    return lin.join(spans, (F.col("linear") >= F.col("before")) & (F.col("linear") < F.col("after"))).select("read_id", "line", "linear", F.col("t").alias("tid"), (F.col("linear") - F.col("before")).cast("int").alias("pos"))


_PAIRS = """g as (select * from reads where (flag & 3840) = 0 and mapq >= 10),
pairs as (select a.bcd, a.read_id, a.tid as a_tid, a.start as a_start, a."end" as a_end, a.flag as a_flag, a.line as a_line, b.tid as b_tid, b.start as b_start, b."end" as b_end, b.flag as b_flag, b.line as b_line
  from g a join g b on a.bcd = b.bcd and a.read_id = b.read_id and (a.tid, a.start, a."end", a.flag, a.line) < (b.tid, b.start, b."end", b.flag, b.line)),
q as (select *, (a_flag & 16) <> 0 as ra, (b_flag & 16) <> 0 as rb, ((a_flag & 64) <> 0) = ((b_flag & 64) <> 0) or ((a_flag & 128) <> 0) = ((b_flag & 128) <> 0) as same_mate from pairs),
i as (select *, case when not same_mate and ra <> rb and a_tid = b_tid then case when not ra and a_start <= b_start then b_start - a_end when not rb and b_start <= a_start then a_start - b_end end end as inner_size from q),
m as (select *, case when same_mate or (a_tid = b_tid and abs(a_start - b_end) < 1000 and abs(b_start - a_end) < 1000) then 0 when a_tid <> b_tid then 1
  else (case when ra = rb then 2 else 0 end) + (case when (not ra and rb and a_start > b_start) or (not rb and ra and b_start > a_start) then 4 else 0 end) + (case when inner_size > 1000 then 8 else 0 end) end as mask from i)"""


@query(f"with {_PAIRS} select bcd, read_id, a_line, b_line, inner_size from m where inner_size is not null", "reads")
def p10_inner_size(spark, sf):
    side = lambda p: {c: F.col(f"{p}_{c}") for c in ("tid", "start", "end", "flag")}
    return fragments.mate_pairs(reads(spark, sf)).select("bcd", "read_id", "a_line", "b_line", R.inner_size(side("a"), side("b")).alias("inner_size")).where("inner_size is not null")


@query(f"with {_PAIRS} select bcd, read_id, a_line, b_line, mask from m", "reads")
def p11_discordance_mask(spark, sf):
    side = lambda p: {c: F.col(f"{p}_{c}") for c in ("tid", "start", "end", "flag")}
    return fragments.mate_pairs(reads(spark, sf)).select("bcd", "read_id", "a_line", "b_line", R.discordance_mask(side("a"), side("b"), PAIR).alias("mask"))


@query(f"with {_PAIRS} select mask, case when mask & 1 <> 0 then 'TRA' when mask & 2 <> 0 then 'INV' when mask & 4 <> 0 then 'DUP' when mask & 8 <> 0 then 'DEL' end as sv_type, count(*) as n from m group by 1, 2", "reads")
def p2_sv_support_type(spark, sf):
    side = lambda p: {c: F.col(f"{p}_{c}") for c in ("tid", "start", "end", "flag")}
    rows = fragments.mate_pairs(reads(spark, sf)).withColumn("mask", R.discordance_mask(side("a"), side("b"), PAIR))
    return rows.groupBy("mask", R.sv_support_type(F.col("mask")).alias("sv_type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {_PAIRS}, s as (select bcd, read_id, mask, a_tid as tid, a_start as start, a_end as "end", a_flag as flag, a_line as line from m union all select bcd, read_id, mask, b_tid, b_start, b_end, b_flag, b_line from m)
    select bcd, read_id, tid, start, "end", flag, line, bit_or(mask) as mask from s where mask <> 0 group by all""",
    "reads",
)
def j1_mate_pair_join(spark, sf):
    return fragments.discordant_reads(reads(spark, sf), PAIR)


@query(
    f"""with {_PAIRS}, s as (select bcd, read_id, mask, inner_size, a_tid as tid, a_start as start, a_end as "end", a_flag as flag, a_line as line from m union all select bcd, read_id, mask, inner_size, b_tid, b_start, b_end, b_flag, b_line from m),
    d as (select bcd, read_id, tid, start, "end", flag, line, bit_or(mask) as mask from s where mask <> 0 group by all) select bcd, read_id, tid, start, "end", flag, line from d where mask = 8""",
    "reads",
)
def c8_emit_deletion_reads(spark, sf):
    return fragments.discordant_reads(reads(spark, sf), PAIR).where("mask = 8").drop("mask")


@query("select read_id, line, mapq from reads where mapq < 20", "reads")
def f1_low_mapq_reads(spark, sf):
    return reads(spark, sf).where("mapq < 20").select("read_id", "line", "mapq")


@query("select count(*) filter ((flag & 3328) = 0) as n_depth, count(*) filter ((flag & 3332) = 0) as n_round1, count(*) filter ((flag & 1028) = 0) as n_round2 from reads", "reads")
def f2_usable_reads(spark, sf):
    return reads(spark, sf).agg(F.count_if(R.usable("flag", R.NOT_FOR_DEPTH)).alias("n_depth"), F.count_if(R.usable("flag", R.NOT_FOR_ROUND1)).alias("n_round1"), F.count_if(R.usable("flag", R.NOT_FOR_ROUND2)).alias("n_round2"))


@query("select count(*) as n_effective from reads where (flag & 3840) = 0 and mapq >= 20", "reads")
def f3_effective_read_count(spark, sf):
    return reads(spark, sf).where(R.usable("flag", R.NOT_PRIMARY)).where("mapq >= 20").agg(F.count(F.lit(1)).alias("n_effective"))


# fragments


@query(f'with {FRAGS} select bcd, tid, frag, start, "end", num_reads, num_good_reads from frags where num_good_reads >= 1', "reads")
def w1_gap_sessionize_reads(spark, sf):
    return fragments.gap_fragments(reads(spark, sf), GAP, min_good=1)


W2 = f"""with r as (select *, lag("end") over w as p_end, lag(start) over w as p_start, lag(flag) over w as p_flag, lag(read_id) over w as p_read from reads where (flag & 1028) = 0 window w as (partition by bcd, tid order by {ORDER})),
    n as (select *, case when p_end is null or start - p_end > 20000 or (p_read = read_id and ((p_flag & 64) <> 0) <> ((flag & 64) <> 0) and ((p_flag & 128) <> 0) <> ((flag & 128) <> 0) and ((p_flag & 16) <> 0) <> ((flag & 16) <> 0)
      and coalesce(case when (p_flag & 16) = 0 and p_start <= start then start - p_end when (flag & 16) = 0 and start <= p_start then p_start - "end" end, 0) > 500) then 1 else 0 end as new from r),
    s as (select *, sum(new) over (partition by bcd, tid order by {ORDER} rows unbounded preceding) as frag from n)
    select bcd, tid, frag::bigint as frag, min(start) as start, last("end" order by {ORDER}) as "end", count(*)::int as num_reads, (count(*) filter (mapq >= 20))::int as num_good_reads from s group by bcd, tid, frag having count(*) filter (mapq >= 20) > 1"""


@query(W2, "reads")
def w2_cluster_fragments(spark, sf):
    return fragments.cluster_fragments(reads(spark, sf), 20_000, 500, min_good=1).select("bcd", "tid", "frag", "start", "end", "num_reads", "num_good_reads")


@query(f"with {FRAGS} select frag_id, tid, start, \"end\", length, hp0::int as hp0, hp1::int as hp1, hp2::int as hp2, array_to_string(starts, ',') as starts, array_to_string(ends, ',') as ends from frags", "reads")
def w3_assemble_fragment(spark, sf):
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return frags(spark, sf).select("frag_id", "tid", "start", "end", "length", "hp0", "hp1", "hp2", join("map_pos.start").alias("starts"), join("map_pos.end").alias("ends"))


@query(f'with {FRAGS} select frag_id, row_number() over (order by tid, start, "end", bcd, frag) - 1 as dense_id from frags', "reads")
def w4_renumber_fragments(spark, sf):
    return fragments.renumber(frags(spark, sf)).select("frag_id", "dense_id")


@query(
    f"""with {FRAGS}, g as (select *, list_transform(range(1, len(starts)), lambda i: starts[i + 1] - starts[i]) as gaps from frags), t as (select *, list_max(gaps) as top, list_position(gaps, list_max(gaps)) as cut_at from g),
    p as (select *, len(starts) >= 3 and top > 5000 as cut from t)
    select frag_id, 0 as piece, starts[1] as start, ends[-1] as "end", len(starts)::int as num_reads from p where not coalesce(cut, false) union all
    select frag_id, 1, starts[1], ends[cut_at], cut_at::int from p where cut union all select frag_id, 2, starts[cut_at + 1], ends[-1], (len(starts) - cut_at)::int from p where cut""",
    "reads",
)
def w5_split_fragment_at_max_gap(spark, sf):
    return fragments.split_at_max_gap(frags(spark, sf), 5000)


@query(
    f"""with {FRAGS}, g as (select unnest(list_transform(range(2, len(starts) + 1), lambda i: ends[i] - starts[i - 1])) as gap from frags)
    select quantile_cont(gap, 0.5) as p50, quantile_cont(gap, 0.75) as p75, quantile_cont(gap, 0.9) as p90, quantile_cont(gap, 0.95) as p95, quantile_cont(gap, 0.99) as p99, quantile_cont(gap, 0.999) as p999 from g""",
    "reads",
)
def a15_gap_quantiles(spark, sf):
    return fragments.gap_quantiles(frags(spark, sf))


@query(f"with {FRAGS} select frag_id, array_to_string(list_transform(range(2, len(starts) + 1), lambda i: ends[i] - starts[i - 1]), ',') as gaps from frags", "reads")
def p12_frag_gap_distances(spark, sf):
    return frags(spark, sf).select("frag_id", F.array_join(R.frag_gap_distances("map_pos").cast("array<string>"), ",").alias("gaps"))


@query(f"with {FRAGS}, p as (select bcd, count(*) as n, sum(num_reads) as r from frags group by bcd) select count(*) as n_barcodes, sum(n)::bigint as n_fragments, sum(r)::bigint as n_reads, avg(n) as mean, median(n) as median from p", "reads")
def a16_fragments_per_barcode(spark, sf):
    return fragments.fragments_per_barcode(frags(spark, sf))


_NX = """h as (select length, sum(length) as bases from frags group by length), c as (select *, sum(bases) over (order by length desc rows unbounded preceding) as cum, sum(bases) over () as total from h),
nx as (select max(length) filter (cum > 0.5 * total) as n50, max(length) filter (cum > 0.95 * total) as n95, max(length) filter (cum > 0.98 * total) as n98, max(length) filter (cum > 0.99 * total) as n99 from c)"""


@query(f"with {FRAGS}, {_NX} select * from nx", "reads")
def a12_fragment_length_stats(spark, sf):
    return fragments.length_stats(frags(spark, sf))


@query(f"with {FRAGS}, {_NX} select greatest(n95, 5000) as min_fragment_length from nx", "reads")
def a13_min_fragment_length(spark, sf):
    return fragments.min_length(fragments.length_stats(frags(spark, sf)))


_FIT = """q as (select quantile_cont(gap, [0.9, 0.92, 0.94, 0.96, 0.98]) as q from g), f as (select list_sort(list_transform(range(1, 6), lambda i: 1 - (1 - ([0.9, 0.92, 0.94, 0.96, 0.98]::double[])[i]) ** (1 / (q[i] + 1)))) as ps from q)"""


@query(f"with {FRAGS}, g as (select unnest(list_transform(range(2, len(starts) + 1), lambda i: ends[i] - starts[i - 1])) as gap from frags), {_FIT} select round(ps[3], 12) as p from f", "reads")
def a14_geometric_fit(spark, sf):
    gaps = frags(spark, sf).select(F.explode(R.frag_gap_distances("map_pos")).alias("gap"))
    return fragments.geometric_fit(gaps, "gap").select(F.round("p", 12).alias("p"))


@query(
    f"""with {FRAGS}, g as (select unnest(list_transform(range(2, len(starts) + 1), lambda i: ends[i] - starts[i - 1])) as gap from frags), {_FIT} select round(ps[3], 12) as read_per_bp, (select sum(num_reads) from frags)::bigint as n_reads, round((select sum(num_reads) from frags) * ps[3], 6) as reads_times_rate from f""",
    "reads",
)
def a17_reads_per_bp(spark, sf):
    rows = frags(spark, sf)
    p = fragments.geometric_fit(rows.select(F.explode(R.frag_gap_distances("map_pos")).alias("gap")), "gap")
    n = rows.agg(F.sum("num_reads").alias("n_reads"))
    return p.join(F.broadcast(n)).select(F.round("p", 12).alias("read_per_bp"), "n_reads", F.round(F.col("n_reads") * F.col("p"), 6).alias("reads_times_rate"))


_HQ = """hist as (select v, count(*) as n from vals group by v), cum as (select v, n, sum(n) over (order by v rows unbounded preceding) as cum, sum(n) over () as total from hist),
ks as (select unnest(range(0, 1001)) as k) select k::bigint as k, (select min(v) from cum where cum * 1000 >= k * total) as value from ks"""


@query(f"with vals as (select mapq as v from reads), {_HQ}", "reads")
def a9_histogram_quantiles(spark, sf):
    return depth.histogram_quantiles(reads(spark, sf), "mapq")


@query(f"with {_PAIRS}, vals as (select least(greatest(inner_size + 1000, 0), 100000) as v from m where inner_size is not null), {_HQ}", "reads")
def a11_inner_size_gap_distribution(spark, sf):
    sizes = fragments.inner_sizes(reads(spark, sf)).select(F.least(F.greatest(F.col("inner_size") + 1000, F.lit(0)), F.lit(100_000)).alias("v"))
    return depth.histogram_quantiles(sizes, "v")


@query(f"with {FRAGS} select frag_id, case when 2 * hp1 > hp0 + hp1 + hp2 then 1 when 2 * hp2 > hp0 + hp1 + hp2 then 2 else 0 end as hap from frags", "reads")
def p20_fragment_hap_type(spark, sf):
    return frags(spark, sf).select("frag_id", R.fragment_hap_type(F.col("hp0"), F.col("hp1"), F.col("hp2")).alias("hap"))


@query(f"with {FRAGS} select frag_id, num_good_reads::int as n_good from frags", "reads")
def p21_high_qual_read_count(spark, sf):
    return frags(spark, sf).select("frag_id", R.high_qual_read_count(F.col("map_qual")).alias("n_good"))


@query(f"with {FRAGS} select frag_id, length from frags where length >= 2000 and num_good_reads >= 2 and 2 * num_good_reads >= num_reads", "reads")
def f9_frag_quality_filter(spark, sf):
    return fragments.quality_filter(frags(spark, sf), 2000, 2).select("frag_id", "length")


@query(f"with {FRAGS} select frag_id, bcd, tid, start, \"end\", num_reads::int as num_reads from frags where length >= 2000 and bcd in (select bcd from reads where mapq >= 50)", "reads")
def s5_read_fragments(spark, sf):
    wanted = reads(spark, sf).where("mapq >= 50").select("bcd").distinct()
    return frags(spark, sf).where("length >= 2000").join(wanted, "bcd", "left_semi").select("frag_id", "bcd", "tid", "start", "end", "num_reads")


J2 = """pr as (select a.bcd, a.tid as a_t, a.start as a_s, a."end" as a_e, a.frag_id as a_i, b.tid as b_t, b.start as b_s, b."end" as b_e, b.frag_id as b_i from frags a join frags b on a.bcd = b.bcd and (a.tid, a.start, a."end", a.frag_id) < (b.tid, b.start, b."end", b.frag_id)
  where a."end" - a.start + b."end" - b.start >= 5000),
nodes as (select bcd, '33' as end_type, a_t as x_tid, a_e as x_pos, b_t as y_tid, b_e as y_pos, a_i as frag1, b_i as frag2 from pr union all select bcd, '55', a_t, a_s, b_t, b_s, a_i, b_i from pr
  union all select bcd, '53', a_t, a_s, b_t, b_e, a_i, b_i from pr union all select bcd, '35', a_t, a_e, b_t, b_s, a_i, b_i from pr)"""


@query(f"with {FRAGS}, {J2} select * from nodes", "reads")
def j2_fragment_pair_join(spark, sf):
    return fragments.pair_nodes(frags(spark, sf), 5000)


# depth


_MID = '((start + "end") // 200)::int'


@query(f"select tid, {_MID} as bin, sum(case when mapq >= 20 then \"end\" - start else 0 end) / 100 as hq, sum(\"end\" - start) / 100 as total from reads where (flag & 3328) = 0 group by 1, 2", "reads")
def a1_read_depth_midpoint(spark, sf):
    return depth.read_depth(reads(spark, sf))


_HAP = """e as (select *, unnest(range(start // 100, ("end" - 1) // 100 + 1))::int as bin from reads where (flag & 3328) = 0 and start < "end"), l as (select *, least("end", (bin + 1) * 100) - greatest(start, bin * 100) as part from e),
hap as (select tid, bin, """ + ", ".join(f"sum(case when hptype = {h} and mapq >= 20 then part else 0 end) / 100 as hq{h}, sum(case when hptype = {h} then part else 0 end) / 100 as total{h}" for h in (0, 1, 2)) + """,
  sum(case when mapq >= 20 then part else 0 end) / 100 as hq, sum(part) / 100 as total from l group by tid, bin)"""


@query(f"with {_HAP} select * from hap", "reads")
def a2_hap_read_depth(spark, sf):
    return depth.hap_read_depth(reads(spark, sf))


@query(f"select tid, {_MID} as bin, (count(distinct bcd) filter (mapq >= 20))::double as hq, count(distinct bcd)::double as total from reads where (flag & 3328) = 0 group by 1, 2", "reads")
def a3_barcode_depth(spark, sf):
    return depth.barcode_depth(reads(spark, sf))


_COV = """cov as (select tid, bin, count(*) as n from (select tid, unnest(range(start // 100, "end" // 100 + 1)) as bin from frags) group by tid, bin)"""


@query(f"with {FRAGS}, {_COV} select * from cov", "reads")
def a5_fragment_coverage(spark, sf):
    return depth.fragment_coverage(frags(spark, sf))


_MERGE = """o as (select *, max("end") over (partition by tid order by start, "end" rows between unbounded preceding and 1 preceding) as reach from iv),
isl as (select *, sum(case when start <= reach then 0 else 1 end) over (partition by tid order by start, "end" rows unbounded preceding) as k from o),
merged as (select tid, min(start) as start, max("end") as "end", count(*) as n from isl group by tid, k)"""


@query(
    f"""with {FRAGS}, {_COV}, q as (select tid, quantile_cont(n, 0.5) as mid, quantile_cont(n, 0.8413) as up from cov group by tid), lo as (select tid, 4 * quantile_cont(n, 0.5) as lim from cov join q using (tid) where n < mid + 3 * (up - mid) group by tid),
    iv as (select tid, bin * 100 as start, (bin + 1) * 100 as "end" from cov join lo using (tid) where n > lim), {_MERGE} select * from merged""",
    "reads",
)
def a6_high_coverage_regions(spark, sf):
    return depth.high_coverage_regions(depth.fragment_coverage(frags(spark, sf)))


_FD = f"""fd as (select tid, bin, """ + ", ".join(f"least(count(*) filter (hap = {h}), 10000) as d{h}" for h in (0, 1, 2)) + """, least(count(*) filter (hap = 0), 10000) + least(count(*) filter (hap = 1), 10000) + least(count(*) filter (hap = 2), 10000) as d3
  from (select tid, unnest(range(start // 100, "end" // 100)) as bin, case when 2 * hp1 > hp0 + hp1 + hp2 then 1 when 2 * hp2 > hp0 + hp1 + hp2 then 2 else 0 end as hap from frags where length >= 2000 and num_good_reads >= 2 and 2 * num_good_reads >= num_reads) group by tid, bin)"""


def hap_frags(spark, sf):
    rows = fragments.quality_filter(frags(spark, sf), 2000, 2)
    return rows.withColumn("hap", R.fragment_hap_type(F.col("hp0"), F.col("hp1"), F.col("hp2")))


@query(f"with {FRAGS}, {_FD} select * from fd", "reads")
def a7_hap_fragment_depth(spark, sf):
    return depth.hap_fragment_depth(hap_frags(spark, sf))


@query(
    f"""with {FRAGS}, {_FD}, {_HAP}, r as (select total / d3 as rate, row_number() over (order by total / d3, tid, bin) - 1 as i, count(*) over () as n from hap join fd using (tid, bin) where total > 0 and d3 > 0),
    ks as (select unnest(range(0, 1001)) as k) select k::bigint as k, round(rate, 9) as rate from ks join r on i = least(floor(n * k / 1000.0 + 0.5), n - 1)""",
    "reads",
)
def a8_depth_rate(spark, sf):
    rows = depth.depth_rate(depth.hap_read_depth(reads(spark, sf)), depth.hap_fragment_depth(hap_frags(spark, sf)))
    return rows.select("k", F.round("rate", 9).alias("rate"))


@query(f"with {_HAP}, vals as (select least(floor(total * 100 + 0.5), 1000000)::bigint as v from hap where total >= 0.001), {_HQ}", "reads")
def a10_depth_distribution(spark, sf):
    return depth.depth_distribution(depth.hap_read_depth(reads(spark, sf)))


_DENSE = f"""d as (select tid, {_MID} as bin, sum(case when mapq >= 20 then "end" - start else 0 end) / 100 as hq, sum("end" - start) / 100 as total from reads where (flag & 3328) = 0 group by 1, 2),
c as (select tid, max("end") + 1000 as length from reads group by tid), b as (select tid, unnest(range(0, length // 100 + 2))::int as bin from c), dense as (select b.tid, b.bin, coalesce(hq, 0) as hq, coalesce(total, 0) as total from b left join d using (tid, bin))"""


@query(f"with {_DENSE} select * from dense", "reads")
def d4_densify_bins(spark, sf):
    return depth.densify(depth.read_depth(reads(spark, sf)), contigs(spark, sf))


@query(f"with {_DENSE} select round(avg(total), 9) as mean, round(stddev_pop(total), 9) as std, round(avg(hq), 9) as mean_hq from dense", "reads")
def a22_genome_mean_std(spark, sf):
    out = depth.genome_mean_std(depth.densify(depth.read_depth(reads(spark, sf)), contigs(spark, sf)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query('with s as (select start - lag(start) over (partition by tid order by start) as step from (select distinct tid, start from reads)) select median(step) as bin_size from s where step > 0', "reads")
def w12_bin_size_inference(spark, sf):
    return depth.bin_size(reads(spark, sf))


_CENTROIDS = """t as (select tid, bin, hq::bigint as d0, floor(hq)::bigint as d from dense), cs as (select tid, bin, sum(d * bin) over l as n1, sum(d) over l as s1, sum(d * bin) over r as n2, sum(d) over r as s2 from t
  window l as (partition by tid order by bin range between 100 preceding and 1 preceding), r as (partition by tid order by bin range between current row and 99 following)),
cen as (select tid, bin, case when s1 > 0 then n1 * 100 / s1 end as c1, case when s2 > 0 then n2 * 100 / s2 end as c2 from cs)"""


@query(f"with {_DENSE}, {_CENTROIDS} select tid, bin, round(c1, 6) as c1, round(c2, 6) as c2 from cen", "reads")
def w6_weighted_centroid(spark, sf):
    rows = depth.weighted_centroid(depth.densify(depth.read_depth(reads(spark, sf)), contigs(spark, sf)))
    return rows.select("tid", "bin", F.round("c1", 6).alias("c1"), F.round("c2", 6).alias("c2"))


# intervals


@query('select r.region_id, g.gap_id, greatest(r.start, g.start) as lo, least(r."end", g."end") as hi from regions r join gaps g on r.tid = g.tid and r.start < g."end" and g.start < r."end"', "regions", "gaps")
def j4_interval_overlap_join(spark, sf):
    rows = intervals.overlap_join(view(spark, sf, "regions"), view(spark, sf, "gaps"))
    return rows.select("region_id", F.col("b_gap_id").alias("gap_id"), F.greatest("start", "b_start").alias("lo"), F.least("end", "b_end").alias("hi"))


@query('select g.gap_id, r.region_id from gaps g join regions r on r.tid = g.tid and r.start >= g.start and r."end" <= g."end"', "regions", "gaps")
def j5_interval_contain_join(spark, sf):
    return intervals.overlap_join(view(spark, sf, "gaps"), view(spark, sf, "regions"), how="contain").select("gap_id", F.col("b_region_id").alias("region_id"))


@query('select read_id, line from reads r where exists (select 1 from gaps g where g.tid = r.tid and r.start < g."end" and g.start < r."end")', "reads", "gaps")
def j3_target_reads(spark, sf):
    return intervals.overlapping(reads(spark, sf), view(spark, sf, "gaps"), ["read_id", "line", "tid", "start", "end"]).select("read_id", "line")


@query(
    f"""with {FRAGS} select frag_id, start, "end" from frags f where length >= 2000 and (exists (select 1 from gaps g where g.tid = f.tid and f.start >= g.start and f.start < g."end") or exists (select 1 from regions g where g.tid = f.tid and f."end" >= g.start and f."end" < g."end"))""",
    "reads", "gaps", "regions",
)
def j6_point_in_region(spark, sf):
    rows = frags(spark, sf).where("length >= 2000").select("frag_id", "tid", "start", "end")
    left = intervals.points_in_regions(rows, view(spark, sf, "gaps"), "start", ["frag_id"])
    right = intervals.points_in_regions(rows, view(spark, sf, "regions"), "end", ["frag_id"])
    return left.unionByName(right).dropDuplicates(["frag_id"]).select("frag_id", "start", "end")


@query(f"""with {FRAGS} select gap_id, frag_id, f.start as pos from frags f join gaps g on f.tid = g.tid and f.start between g.start - 2000 and g."end" + 2000""", "reads", "gaps")
def j7_endpoint_range_fetch(spark, sf):
    ranges = view(spark, sf, "gaps").select("tid", (F.col("start") - 2000).alias("lo"), (F.col("end") + 2000).alias("hi"), "gap_id")
    return intervals.band_join(frags(spark, sf).select("tid", "start", "frag_id"), ranges, "start").select(F.col("r_gap_id").alias("gap_id"), "frag_id", F.col("start").alias("pos"))


@query('select g.gap_id, coalesce(sum(least(r."end", g."end") - greatest(r.start, g.start)), 0)::bigint as covered from gaps g left join regions r on r.tid = g.tid and r.start < g."end" and g.start < r."end" group by g.gap_id', "regions", "gaps")
def j10_ontarget_overlap_length(spark, sf):
    return intervals.overlap_length(view(spark, sf, "gaps"), view(spark, sf, "regions"), ["gap_id"])


@query(
    """select count(*) filter (not exists (select 1 from gaps g where g.tid = r.tid)) as n_other_contig, count(*) filter (exists (select 1 from gaps g where g.tid = r.tid and r.start < g."end" and g.start < r."end")) as n_overlap,
    count(*) filter (exists (select 1 from gaps g where g.tid = r.tid) and not exists (select 1 from gaps g where g.tid = r.tid and r.start < g."end" and g.start < r."end")) as n_apart from regions r""",
    "regions", "gaps",
)
def j18_bed_overlap_count(spark, sf):
    a, b = view(spark, sf, "regions"), view(spark, sf, "gaps")
    hit = intervals.overlapping(a, b, ["region_id"]).select("region_id", F.lit(True).alias("hit"))
    known = b.select(F.col("tid").alias("t")).distinct()
    rows = a.join(hit, "region_id", "left").join(known, F.col("tid") == F.col("t"), "left")
    return rows.agg(F.count_if(F.col("t").isNull()).alias("n_other_contig"), F.count_if(F.coalesce("hit", F.lit(False))).alias("n_overlap"), F.count_if(F.col("t").isNotNull() & F.col("hit").isNull()).alias("n_apart"))


@query(f'with iv as (select tid, start, "end" from reads), {_MERGE} select * from merged', "reads")
def g3_merge_intervals(spark, sf):
    return intervals.merge_intervals(reads(spark, sf))


@query(
    f"""with src as (select tid, start - 100 as start, "end" + 100 as "end", 1 as bit from regions union all select tid, start - 100, "end" + 100, 2 from gaps union all select tid, start - 100, "end" + 100, 4 from reads where mapq >= 45),
    o as (select *, max("end") over (partition by tid order by start, "end" rows between unbounded preceding and 1 preceding) as reach from src), isl as (select *, sum(case when start <= reach then 0 else 1 end) over (partition by tid order by start, "end" rows unbounded preceding) as k from o),
    m as (select tid, min(start) as s, max("end") as e, bit_or(bit) as label from isl group by tid, k) select label, count(*) as n, sum(e - s)::bigint as bases from m group by label""",
    "reads", "regions", "gaps",
)
def a36_multi_bed_venn(spark, sf):
    return intervals.venn([view(spark, sf, "regions"), view(spark, sf, "gaps"), reads(spark, sf).where("mapq >= 45")], 100)
