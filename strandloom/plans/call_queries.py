"""Queries over barcode overlap, endpoint nodes, calls and copy number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import reads as R
from strandloom.functions import scores
from strandloom.operators import calls as C
from strandloom.operators import depth, fragments, nodes, twin
from strandloom.operators.graph import connected_components
from strandloom.operators.intervals import overlap_join
from strandloom.plans.read_queries import _CENTROIDS, _DENSE, FRAGS, J2, contigs, contigs_of, frags, hap_frags, reads
from strandloom.plans.registry import query
from strandloom.session import stash
from strandloom.sources.views import view

#: Calls made of each order and the next one of its customer: select lists that Spark and the check share.
_CALL_COLS = [
    "o_orderkey as call_id",
    "concat('chr', cast(o_custkey % 3 + 1 as varchar(9))) as chrom1",
    "cast(o_orderkey * 97 % 300000 as int) as start1",
    "concat('chr', cast((case when o_orderkey % 7 = 0 then o_custkey + 1 else o_custkey end) % 3 + 1 as varchar(9))) as chrom2",
    "cast(next_key * 97 % 300000 as int) as start2",
    "case when o_orderkey % 7 = 0 then 'TRA' when o_orderpriority like '1%' then 'INV' when o_orderpriority like '2%' then 'DUP' else 'DEL' end as sv_type",
    "case when o_orderkey % 2 = 0 then 'L_end' else 'R_end' end as endtype1",
    "case when o_orderkey % 3 = 0 then 'L_end' else 'R_end' end as endtype2",
    "cast(floor(o_totalprice / 1000) as int) as score",
    "cast(o_orderkey % 5 as int) as type_score",
    "cast(o_custkey % 4 as int) as dbo1",
    "cast(o_orderkey % 4 as int) as dbo2",
    "'PASS' as filter",
]
CALLS = f"""calls as (select {", ".join(_CALL_COLS)} from (select *, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as next_key from orders) where next_key is not null)"""


def calls(spark, sf) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    o = o.withColumn("next_key", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("next_key is not null")
    return o.selectExpr(*_CALL_COLS)


# barcode overlap


_TWIN = """tb as (select distinct tid, bcd, start // 100 as b from reads where (flag & 3328) = 0 and mapq >= 20), e as (select tid, bcd, b, unnest(range(0, 100)) as k from tb),
w1 as (select distinct tid, bcd, b + 1 + k as idx from e), w2 as (select distinct tid, bcd, b - k as idx from e), n as (select tid, idx, count(*) as n1, 0 as n2, 0 as n0 from w1 group by all union all select tid, idx, 0, count(*), 0 from w2 group by all
  union all select tid, idx, 0, 0, count(*) from w1 join w2 using (tid, bcd, idx) group by all), lc as (select tid, (max("end") + 1000) // 100 as last from reads group by tid),
twin as (select tid, idx, sum(n1)::bigint as n1, sum(n2)::bigint as n2, sum(n0)::bigint as n0 from n join lc using (tid) where idx between 0 and last group by tid, idx)"""


@query(f"with {_TWIN} select * from twin", "reads")
def a4_twin_window_counts(spark, sf):
    return twin.twin_windows(reads(spark, sf), contigs(spark, sf))


def windows(spark, sf) -> DataFrame:
    """Windows with their centroids, as a written table: the model reads it several times."""
    r = stash(reads(spark, sf).select("tid", "start", "end", "mapq", "bcd", "flag"), "reads")[0]  # read three times
    c = contigs_of(r)
    centroids = depth.weighted_centroid(depth.densify(depth.read_depth(r), c)).withColumnRenamed("bin", "idx")
    return stash(twin.twin_windows(r, c).join(centroids, ["tid", "idx"]), "windows")[0]


def _model(rows):
    limits = {"n1": twin.bounds(rows, "n1"), "n2": twin.bounds(rows, "n2")}
    return limits, twin.fit_model(rows, limits)


# limits by robust spreads; slopes by Cramer's rule over covariances
_FIT = f"""{_TWIN}, {_DENSE}, {_CENTROIDS}, wn as (select twin.tid, idx, n1, n2, n0, c1, c2 from twin join cen on twin.tid = cen.tid and twin.idx = cen.bin),
l1 as (select quantile_cont(n1, [0.5, 0.8413, 0.1587]) as v from wn where n1 > 0), l2 as (select quantile_cont(n2, [0.5, 0.8413, 0.1587]) as v from wn where n2 > 0),
lim as (select greatest(l1.v[1] - 3 * (l1.v[1] - l1.v[3]), l1.v[1] / 3) as lo1, least(l1.v[1] + 3 * (l1.v[2] - l1.v[1]), l1.v[1] * 3) as hi1, greatest(l2.v[1] - 3 * (l2.v[1] - l2.v[3]), l2.v[1] / 3) as lo2, least(l2.v[1] + 3 * (l2.v[2] - l2.v[1]), l2.v[1] * 3) as hi2 from l1, l2),
us as (select n0, ln(n1) as x1, ln(n2) as x2, c2 - c1 as x3, ln(n0) as y from wn, lim where c1 is not null and c2 is not null and n1 > 0 and n2 > 0 and n1 between lo1 and hi1 and n2 between lo2 and hi2 and n0 >= 1),
cv as (select count(*) as n_windows, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, avg(y) as my, covar_pop(x1, x1) as a, covar_pop(x1, x2) as b, covar_pop(x1, x3) as c, covar_pop(x2, x2) as d, covar_pop(x2, x3) as e, covar_pop(x3, x3) as f, covar_pop(x1, y) as p, covar_pop(x2, y) as q, covar_pop(x3, y) as r from us),
dt as (select *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) as det from cv),
sl as (select *, (p * (d * f - e * e) - b * (q * f - r * e) + c * (q * e - r * d)) / det as t1, (a * (q * f - r * e) - p * (b * f - c * e) + c * (b * r - c * q)) / det as t2, (a * (d * r - e * q) - b * (b * r - c * q) + p * (b * e - c * d)) / det as t3 from dt),
fit as (select n_windows, my - t1 * m1 - t2 * m2 - t3 * m3 as t0, t1, t2, t3 from sl)"""


@query(f"with {_FIT} select n_windows, round(t0, 6) as intercept, round(t1, 6) as slope1, round(t2, 6) as slope2, round(t3, 6) as slope_d from fit", "reads")
def m1_twin_window_model(spark, sf):
    rows = windows(spark, sf)
    limits, coef = _model(rows)
    return twin.in_limits(rows, limits).where("n0 >= 1").agg(F.count(F.lit(1)).alias("n_windows"), *[F.max(F.lit(round(c, 6))).alias(n) for c, n in zip(coef, ("intercept", "slope1", "slope2", "slope_d"), strict=True)])


@query(
    f"""with {_FIT}, rs as (select log2((exp(t0 + t1 * x1 + t2 * x2 + t3 * x3) + 0.001) / n0) as y from us, fit), rq as (select quantile_cont(y, [0.5, 0.8413, 0.1587]) as v, count(*) as n from rs)
    select round(v[1], 6) as mid, round(v[2] - v[1], 6) as right, round(v[1] - v[3], 6) as left, greatest(floor(ln(greatest(n, 2)) / ln(1.05))::int - 1, 0) as n_steps from rq""",
    "reads",
)
def m2_residual_distribution(spark, sf):
    rows = windows(spark, sf)
    limits, coef = _model(rows)
    (mid, right, left), ladder = twin.residual_ladder(rows, coef, limits)
    return rows.agg(*[F.max(F.lit(round(v, 6))).alias(c) for c, v in (("mid", mid), ("right", right), ("left", left))], F.max(F.lit(len(ladder))).alias("n_steps"))


@query()
def m3_twin_window_pvalue(spark, sf):
    rows = windows(spark, sf)
    limits, coef = _model(rows)
    spread, ladder = twin.residual_ladder(rows, coef, limits)
    return twin.p_values(rows, coef, limits, spread, ladder)


@query()
def c2_detect_barcode_overlap_drop(spark, sf):
    return m3_twin_window_pvalue(spark, sf).where("mlog_p >= 2")


# nodes and graphs


@query(
    """with iv as (select tid, start, "end", 'r' || region_id as id from regions union all select tid, start, "end", 'g' || gap_id from gaps), o as (select *, max("end") over (partition by tid order by start, "end", id rows between unbounded preceding and 1 preceding) as reach from iv),
    isl as (select *, sum(case when start < reach then 0 else 1 end) over (partition by tid order by start, "end", id rows unbounded preceding) as k from o) select id as node, min(id) over (partition by tid, k) as component from isl""",
    "regions", "gaps",
)
def g1_connected_components(spark, sf):
    iv = view(spark, sf, "regions").select("tid", "start", "end", F.concat(F.lit("r"), F.col("region_id").cast("string")).alias("id"))
    iv = iv.unionAll(view(spark, sf, "gaps").select("tid", "start", "end", F.concat(F.lit("g"), F.col("gap_id").cast("string")).alias("id")))
    return connected_components(overlap_join(iv, iv).select(F.col("id").alias("src"), F.col("b_id").alias("dst")))


_SPARSE = f"""{FRAGS}, {J2}, cell as (select *, floor(x_pos / 20001.0) as i, floor(y_pos / 20001.0) as j from nodes), cnt as (select end_type, x_tid, y_tid, i, j, count(*) as n from cell group by all),
dense as (select a.end_type, a.x_tid, a.y_tid, a.i, a.j, (select sum(n) from cnt b where b.end_type = a.end_type and b.x_tid = a.x_tid and b.y_tid = a.y_tid and abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1) as near from cnt a),
kept as (select c.* exclude (i, j) from cell c join dense d on c.end_type = d.end_type and c.x_tid = d.x_tid and c.y_tid = d.y_tid and c.i = d.i and c.j = d.j where near > 4)"""


@query(f"with {_SPARSE} select * from kept", "reads")
def g2_remove_sparse_nodes(spark, sf):
    return nodes.remove_sparse(fragments.pair_nodes(frags(spark, sf), 5000), 20_000, 4).select("bcd", "end_type", "x_tid", "x_pos", "y_tid", "y_pos", "frag1", "frag2")


@query(
    f"""with {_SPARSE}, bad as (select distinct tid, unnest(range(start // 100, ("end" - 1) // 100 + 1)) as bin from gaps)
    select * from kept k where not exists (select 1 from bad where tid = x_tid and bin = x_pos // 100) and not exists (select 1 from bad where tid = y_tid and bin = y_pos // 100)""",
    "reads", "gaps",
)
def f5_blacklist_1d_nodes(spark, sf):
    bad = view(spark, sf, "gaps").select("tid", F.explode(F.sequence(F.floor(F.col("start") / 100), F.floor((F.col("end") - 1) / 100))).alias("bin")).distinct()
    rows = g2_remove_sparse_nodes(spark, sf)
    for s in "xy":
        rows = rows.withColumn("_b", F.floor(F.col(f"{s}_pos") / 100)).join(bad.select(F.col("tid").alias(f"{s}_tid"), F.col("bin").alias("_b")), [f"{s}_tid", "_b"], "left_anti").drop("_b")
    return rows.select("bcd", "end_type", "x_tid", "x_pos", "y_tid", "y_pos", "frag1", "frag2")


@query(f"with {FRAGS}, {J2} select * from nodes where x_tid not in (2, 4) and y_tid not in (2, 4)", "reads")
def f4_alt_contig_filter(spark, sf):
    alt = contigs(spark, sf).where("chrom in ('chr3', 'chr5')").select("tid")
    rows = fragments.pair_nodes(frags(spark, sf), 5000)
    for s in "xy":
        rows = rows.join(F.broadcast(alt.withColumnRenamed("tid", f"{s}_tid")), f"{s}_tid", "left_anti")
    return rows.select("bcd", "end_type", "x_tid", "x_pos", "y_tid", "y_pos", "frag1", "frag2")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.concat_ws("/", "end_type", "frag1", "frag2"))


_G4 = f"""{_SPARSE}, keyed as (select *, concat_ws('/', end_type, frag1, frag2) as key, x_pos // 1000 as gi, y_pos // 1000 as gj from kept),
near as (select a.key as a, b.key as b from (select *, gi + unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) as ni, gj + unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) as nj from keyed) a join keyed b
  on a.end_type = b.end_type and a.x_tid = b.x_tid and a.y_tid = b.y_tid and a.ni = b.gi and a.nj = b.gj where abs(a.x_pos - b.x_pos) < 1000 and abs(a.y_pos - b.y_pos) < 1000),
core as (select a from near group by a having count(*) >= 3), links as (select a, b from near where a in (select a from core) and b in (select a from core)),
reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
comp as (select a as key, min(b) as component_id from reach group by a having count(*) >= 3), members as (select * from keyed join comp using (key))"""


@query(f"with recursive {_G4} select component_id, end_type, x_tid, x_pos, y_tid, y_pos, frag1, frag2 from members", "reads")
def g4_cluster_endpoint_nodes(spark, sf):
    dense = nodes.remove_sparse(fragments.pair_nodes(frags(spark, sf), 5000), 20_000, 4)
    return nodes.cluster(_keyed(dense), "key", 1_000, 3).select("component_id", "end_type", "x_tid", "x_pos", "y_tid", "y_pos", "frag1", "frag2")


_LONGEST = "(ln(0.01) / ln(1 - 1 / 2000.0))"


def _tries(axis: str, at: int) -> str:
    """SQL for the scores of all positions of an axis."""
    gap = f"case when substr(end_type, {at}, 1) = '3' then pos - {axis}_pos else {axis}_pos - pos end"
    return f"""{axis}_tries as (select component_id, unnest(range(min({axis}_pos) - 1000, max({axis}_pos) + 1000, 50)) as pos from members group by component_id),
{axis}_gaps as (select component_id, pos, {gap} as gap from {axis}_tries join members using (component_id)),
{axis}_each as (select component_id, pos, case when gap between 0 and {_LONGEST} then ({_LONGEST} - gap) / {_LONGEST} when gap between -200 and -1 then gap / 200.0 + 1 else 0 end as s from {axis}_gaps),
{axis}_best as (select component_id, pos, round(sum(s), 6) as score, count(*) filter (s > 0) as n_support from {axis}_each group by component_id, pos qualify row_number() over (partition by component_id order by round(sum(s), 6) desc, pos) = 1)"""


@query(
    f"""with recursive {_G4}, {_tries("x", 1)}, {_tries("y", 2)} select x.component_id, x.pos::int as x_break, x.score as x_score, x.n_support as x_support, y.pos::int as y_break, y.score as y_score, y.n_support as y_support from x_best x join y_best y using (component_id)""",
    "reads",
)
def m4_predict_breakpoint(spark, sf):
    rows, _ = stash(g4_cluster_endpoint_nodes(spark, sf), "clusters")
    out = None
    for s, at in (("x", 1), ("y", 2)):
        side = F.when(F.substring("end_type", at, 1) == "3", "R").otherwise("L")
        best = nodes.predict_breakpoint(rows.select("component_id", F.col(f"{s}_pos").alias("position"), side.alias("side"), F.lit(False).alias("with_pair")), 1 / 2000)
        best = best.select("component_id", F.col("pos").alias(f"{s}_break"), F.col("score").alias(f"{s}_score"), F.col("n_support").alias(f"{s}_support"))
        out = best if out is None else out.join(best, "component_id")
    return out


@query(
    f"""with {FRAGS}, c as (select distinct bcd, tid, unnest(range(start // 20000, "end" // 20000 + 1)) as c from frags) select a.tid as tid1, a.c as i, b.tid as tid2, b.c as j, least(count(*), 254) as n from c a join c b on a.bcd = b.bcd and (a.tid < b.tid or (a.tid = b.tid and (b.c - a.c) * 20000 >= 150000)) group by all having count(*) >= 3""",
    "reads",
)
def a21_grid_overlap(spark, sf):
    return nodes.grid_overlap(frags(spark, sf), cell=20_000, least=3)


@query(
    """with box as (select region_id as pair_id, tid as tid1, start as start1, start + 20000 as end1, (tid + 1) % 5 as tid2, start + 3000 as start2, start + 23000 as end2 from regions), m as (select tid, bcd, (start + "end") // 2 as mid from reads),
    x as (select distinct pair_id, bcd, (mid - start1) // 1000 as x from box join m on tid = tid1 and mid >= start1 and mid < end1), y as (select distinct pair_id, bcd, (mid - start2) // 1000 as y from box join m on tid = tid2 and mid >= start2 and mid < end2)
    select pair_id, x, y, least(count(*), 100) as n from x join y using (pair_id, bcd) group by all""",
    "reads", "regions",
)
def a20_heatmap_counts(spark, sf):
    box = view(spark, sf, "regions").select(F.col("region_id").alias("pair_id"), F.col("tid").alias("tid1"), F.col("start").alias("start1"), (F.col("start") + 20_000).alias("end1"), ((F.col("tid") + 1) % 5).alias("tid2"), (F.col("start") + 3000).alias("start2"), (F.col("start") + 23_000).alias("end2"))
    return nodes.heatmap_counts(reads(spark, sf), box)


# call filters


@query(f"with {CALLS} select call_id, chrom1, start1, chrom2, start2, case when chrom1 = chrom2 then abs(start2 - start1) end as sv_length from calls")
def p18_sv_length(spark, sf):
    return calls(spark, sf).select("call_id", "chrom1", "start1", "chrom2", "start2", C.sv_length(F.col("chrom1"), F.col("start1"), F.col("chrom2"), F.col("start2")).alias("sv_length"))


_SWAP = "(chrom1, start1) > (chrom2, start2)"


@query(
    f"""with {CALLS} select call_id, case when {_SWAP} then chrom2 else chrom1 end as chrom1, case when {_SWAP} then start2 else start1 end as start1, case when {_SWAP} then chrom1 else chrom2 end as chrom2,
    case when {_SWAP} then start1 else start2 end as start2, case when {_SWAP} then endtype2 else endtype1 end as endtype1, case when {_SWAP} then endtype1 else endtype2 end as endtype2 from calls"""
)
def p17_normalize_pair_order(spark, sf):
    return C.normalize_pair_order(calls(spark, sf)).select("call_id", "chrom1", "start1", "chrom2", "start2", "endtype1", "endtype2")


@query(f"with {CALLS} select call_id, case when chrom1 = chrom2 and abs(start2 - start1) < 5000 then 'LENGTH_FILTER' else 'PASS' end as filter from calls")
def f6_filter_sv_length(spark, sf):
    return C.filter_length(calls(spark, sf)).select("call_id", "filter")


@query(f"with {CALLS} select call_id, case when (sv_type = 'INV' and least(dbo1, dbo2) < 1) or (sv_type = 'TRA' and least(dbo1, dbo2) < 0.5) then 'BARCODE_OVERLAP_FILTER' else 'PASS' end as filter from calls")
def f7_filter_dbo_score(spark, sf):
    return C.filter_barcode_overlap(calls(spark, sf)).select("call_id", "filter")


@query(f"with {CALLS} select call_id, score from calls where score >= 20")
def f8_min_score(spark, sf):
    return calls(spark, sf).where("score >= 20").select("call_id", "score")


_NAMED_GAPS = """g as (select 'chr' || (tid + 1) as chrom, start, "end" from gaps)"""


def named_gaps(spark, sf):
    return view(spark, sf, "gaps").select(F.concat(F.lit("chr"), (F.col("tid") + 1).cast("string")).alias("chrom"), "start", "end")


@query(
    f"""with {CALLS}, {_NAMED_GAPS} select call_id, case when exists (select 1 from g where chrom = chrom1 and start // 100 <= start1 // 100 and start1 // 100 <= ("end" - 1) // 100) or exists (select 1 from g where chrom = chrom2 and start // 100 <= start2 // 100 and start2 // 100 <= ("end" - 1) // 100)
    then '1D_BLACKLIST' else 'PASS' end as filter from calls""",
    "gaps",
)
def j12_blacklist_1d_calls(spark, sf):
    return C.filter_blacklist_1d(calls(spark, sf), named_gaps(spark, sf)).select("call_id", "filter")


@query(
    f"""with {CALLS}, {_NAMED_GAPS}, n as (select chrom, 'R_end' as kind, start - 5000 as lo, start + 1000 as hi from g union all select chrom, 'L_end', "end" - 1000, "end" + 5000 from g)
    select call_id, case when chrom1 = chrom2 and abs(start2 - start1) < 200000 and (exists (select 1 from n where chrom = chrom1 and kind = endtype1 and start1 >= lo and start1 < hi) or exists (select 1 from n where chrom = chrom2 and kind = endtype2 and start2 >= lo and start2 < hi)) then 'GAP_REGION' else 'PASS' end as filter from calls""",
    "gaps",
)
def j12_gap_region_calls(spark, sf):
    return C.gap_region_calls(calls(spark, sf), named_gaps(spark, sf)).select("call_id", "filter")


_POINTS = """pts as (select 'chr' || (l_suppkey % 3 + 1) as chrom1, 'chr' || (l_linenumber % 3 + 1) as chrom2, (l_partkey * 331 % 300000)::int as pos1, (l_orderkey * 173 % 300000)::int as pos2 from lineitem),
both_ as (select * from pts union all select chrom2, chrom1, pos2, pos1 from pts where chrom1 <> chrom2 or pos1 <> pos2)"""


@query(
    f"""with {CALLS}, {_POINTS}, c as (select call_id, count(*) as n from calls a join both_ b on a.chrom1 = b.chrom1 and a.chrom2 = b.chrom2 and abs(pos1 - start1) <= 10000 and abs(pos2 - start2) <= 10000 group by call_id)
    select call_id, case when n >= 5 then '2D_BLACKLIST' else 'PASS' end as filter from calls left join c using (call_id)"""
)
def j13_filter_calls_2d(spark, sf):
    pts = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "concat('chr', l_suppkey % 3 + 1) as chrom1", "concat('chr', l_linenumber % 3 + 1) as chrom2", "cast(l_partkey * 331 % 300000 as int) as pos1", "cast(l_orderkey * 173 % 300000 as int) as pos2"
    )
    return C.filter_2d(calls(spark, sf), pts, least=5).select("call_id", "filter")


_SAME = """same as (select a.call_id as a_id, b.call_id as b_id from calls a join calls b on a.sv_type = b.sv_type and a.chrom1 = b.chrom1 and a.chrom2 = b.chrom2 and abs(a.start1 - b.start1) <= 10000 and abs(a.start2 - b.start2) <= 10000
  and (a.chrom1 <> a.chrom2 or least(greatest(a.start1, a.start2), greatest(b.start1, b.start2)) - greatest(least(a.start1, a.start2), least(b.start1, b.start2)) >= 0.5 * greatest(abs(a.start1 - a.start2), abs(b.start1 - b.start2))))"""


@query(f"with {CALLS}, {_SAME} select * from same")
def j16_same_sv_join(spark, sf):
    rows = calls(spark, sf)
    return C.same_call(rows, rows)


@query(f"with recursive {CALLS}, {_SAME}, walk(a, b) as (select a_id, b_id from same union select walk.a, same.b_id from walk join same on walk.b = same.a_id), least_ as (select a, min(b) as c from walk group by a) select call_id, sv_type, chrom1, start1, chrom2, start2 from calls where call_id in (select c from least_)")
def g7_dedupe_callset(spark, sf):
    return C.dedupe(calls(spark, sf)).select("call_id", "sv_type", "chrom1", "start1", "chrom2", "start2")


@query(f"with {CALLS}, {_SAME} select call_id, sv_type, chrom1, start1, chrom2, start2 from calls where call_id % 2 = 0 or call_id not in (select a_id from same where a_id % 2 = 1 and b_id % 2 = 0)")
def u3_merge_two_callsets(spark, sf):
    rows = calls(spark, sf).select("call_id", "sv_type", "chrom1", "start1", "chrom2", "start2")
    return C.merge_callsets(rows.where("call_id % 2 = 0"), rows.where("call_id % 2 = 1"))


@query(
    f"""with {CALLS}, f as (select *, case when chrom1 = chrom2 and abs(start2 - start1) < 5000 then 'LENGTH_FILTER' else 'PASS' end as ft from calls), n as (select *, row_number() over (order by chrom1, start1, chrom2, start2, sv_type, call_id) as rn, floor(log10(count(*) over ())) + 2 as w from f)
    select chrom1, start1, start1 + 1 as end1, chrom2, start2, start2 + 1 as end2, sv_type, 'ID' || lpad(rn::varchar, w::int, '0') as sv_id, case when chrom1 = chrom2 then abs(start2 - start1)::varchar else 'N.A.' end as sv_length, score, ft as filter, 'SVMETHOD=LINKED_READS;CALL=' || call_id as info from n where ft = 'PASS'"""
)
def k1_write_bedpe_calls(spark, sf):
    return C.bedpe_rows(C.filter_length(calls(spark, sf)))


@query(
    f"""with {CALLS}, i as (select call_id, unnest([call_id // 3, call_id // 3 + 1, call_id // 4]) as f from calls), d as (select distinct call_id, f from i), n as (select call_id, count(*) as n from d group by call_id),
    sh as (select a.call_id as a, b.call_id as b, count(*) as k from d a join d b on a.f = b.f group by all), e as (select a, b from sh join n x on x.call_id = a join n y on y.call_id = b where 2 * k >= least(x.n, y.n))
    select count(*) as n_links, count(distinct a) as n_calls from e where a < b"""
)
def g6_fragment_links(spark, sf):
    rows = calls(spark, sf).select("call_id", F.explode(F.array_distinct(F.array(F.expr("call_id div 3"), F.expr("call_id div 3 + 1"), F.expr("call_id div 4")))).alias("f"))
    n = rows.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"))
    b = rows.select(F.col("call_id").alias("b"), "f")
    k = rows.join(b, "f").where("call_id < b").groupBy("call_id", "b").agg(F.count(F.lit(1)).alias("k"))
    e = k.join(n, "call_id").join(n.select(F.col("call_id").alias("b"), F.col("n").alias("nb")), "b").where(2 * F.col("k") >= F.least("n", "nb"))
    return e.agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("call_id").alias("n_calls"))


@query()
def g6_merge_quantified_calls(spark, sf):
    rows = calls(spark, sf).withColumn("frag_ids", F.array_distinct(F.array(F.expr("call_id div 3"), F.expr("call_id div 3 + 1"), F.expr("call_id div 4"))))
    return C.merge_by_fragments(rows, 20).select("call_id", "score", "n_merged")


# scores


_GAPS = "g as (select call_id, (start2 - start1 - 100) as gap, least(greatest(score, 1), 30) as n from calls)"


@query(f"with {CALLS}, {_GAPS} select call_id, round(case when gap between 0 and 9209 then (9209.0 - gap) / 9209.0 when gap >= -200 and gap < 0 then gap / 200.0 + 1 else 0 end, 9) as score from g")
def p13_gap_score(spark, sf):
    return calls(spark, sf).select("call_id", F.round(scores.gap_score(F.col("start2") - F.col("start1") - 100, F.lit(9209.0)), 9).alias("score"))


@query(f"with {CALLS}, {_GAPS} select call_id, round(case when gap between 0 and 600 then (600.0 - gap) / 600.0 * 5 when gap >= -100 and gap < 0 then gap * 0.05 + 5 else 0 end, 9) as score from g")
def p14_pe_gap_score(spark, sf):
    return calls(spark, sf).select("call_id", F.round(scores.pe_gap_score(F.col("start2") - F.col("start1") - 100, 9209.0), 9).alias("score"))


@query(f"with {CALLS} select call_id, round(ln(0.01) / ln(1 - 1.0 / (score + 2)), 6) as max_gap from calls")
def p15_max_gap_from_rate(spark, sf):
    return calls(spark, sf).select("call_id", F.round(scores.max_gap_from_rate(1.0 / (F.col("score") + 2)), 6).alias("max_gap"))


@query(
    f"""with {CALLS}, {_GAPS}, z as (select *, greatest(abs(gap), 1) * 1e-4 as z from g) select call_id, round(-((-z + ln(list_sum(list_transform(range(0, n), lambda k: exp(k * ln(z) - lgamma(k + 1.0)))))) / ln(10) + log10(1000000.0 / n)), 6) as score from z"""
)
def m5_score_one_molecule(spark, sf):
    rows = calls(spark, sf).select("call_id", F.greatest(F.abs(F.col("start2") - F.col("start1") - 100), F.lit(1)).alias("len"), F.least(F.greatest("score", F.lit(1)), F.lit(30)).alias("n"))
    return rows.select("call_id", F.round(scores.one_molecule_score(F.col("len"), F.col("n"), 1e-4, 1e6), 6).alias("score"))


_AREA = "((1000000.0 / 20000.0) ** 2)"


@query(f"with {CALLS}, {_GAPS} select call_id, round(-((n * ln(5000 / {_AREA}) - 5000 / {_AREA} - lgamma(n + 1.0)) / ln(10) + log10({_AREA})), 6) as score from g")
def m6_score_two_molecule(spark, sf):
    rows = calls(spark, sf).select("call_id", F.least(F.greatest("score", F.lit(1)), F.lit(30)).alias("n"))
    return rows.select("call_id", F.round(scores.two_molecule_score(F.col("n"), 5000.0, 1e6, 2e4), 6).alias("score"))


@query(f"with {CALLS} select call_id, round(least(greatest(score, type_score * 20) / 1.5, start1 / 1000.0) + 3 * (call_id % 3) + dbo1 + dbo2, 6) as combined from calls")
def m7_combined_score(spark, sf):
    c = F.col
    return calls(spark, sf).select("call_id", F.round(scores.combined_score(c("score"), c("type_score") * 20, c("start1") / 1000.0, c("call_id") % 3, c("dbo1"), c("dbo2")), 6).alias("combined"))


@query(
    f"""with {FRAGS}, m as (select bcd, median(start) as mid, count(*) as n from frags group by bcd), k as (select bcd, m.n, count(*) filter (abs(start - mid) <= 10000) as near from frags join m using (bcd) group by bcd, m.n)
    select bcd, round(near * (log10(0.75) - log10(0.2)) + (n - near) * (log10(0.25) - log10(0.8)), 9) as log_ratio from k""",
    "reads",
)
def m8_endpoint_type_score(spark, sf):
    rows = frags(spark, sf).select("bcd", "start")
    mid = rows.groupBy("bcd").agg(F.percentile("start", 0.5).alias("mid"))
    k = rows.join(mid, "bcd").groupBy("bcd").agg(F.count_if(F.abs(F.col("start") - F.col("mid")) <= 10_000).alias("near"), F.count(F.lit(1)).alias("n"))
    return k.select("bcd", F.round(scores.endpoint_log_ratio(F.col("near"), F.col("n"), 0.2), 9).alias("log_ratio"))


@query(f"with {CALLS}, {_GAPS}, k as (select call_id, n, (call_id % (n + 1))::int as k from g) select call_id, round(ln(list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.3) + (n - i) * ln(0.7))))) / ln(10), 6) as score from k")
def m16_refine_score(spark, sf):
    rows = calls(spark, sf).select("call_id", F.least(F.greatest("score", F.lit(1)), F.lit(30)).alias("n"))
    return rows.select("call_id", F.round(scores.binomial_log10_cdf(F.col("call_id") % (F.col("n") + 1), F.col("n"), 0.3), 6).alias("score"))


@query(
    f"""with {FRAGS}, s as (select a.bcd, a.frag_id as f1, b.frag_id as f2, case when a.tid <> b.tid then 10000000000 else greatest(a.start, b.start) - least(a."end", b."end") end as distance from frags a join frags b on a.bcd = b.bcd and a.frag_id < b.frag_id) select f1, f2, distance::bigint as distance from s""",
    "reads",
)
def p19_frag_min_distance(spark, sf):
    cols = ["tid", "start", "end", "frag_id"]
    a, b = (frags(spark, sf).select("bcd", *[F.col(c).alias(f"{p}_{c}") for c in cols]) for p in "ab")
    far = F.when(F.col("a_tid") != F.col("b_tid"), F.lit(R.CONTIG_STRIDE)).otherwise(F.greatest("a_start", "b_start") - F.least("a_end", "b_end"))
    return a.join(b, "bcd").where("a_frag_id < b_frag_id").select(F.col("a_frag_id").alias("f1"), F.col("b_frag_id").alias("f2"), far.cast("long").alias("distance"))


@query(f"with {FRAGS}, p as (select bcd, list(distinct tid) as t from frags group by bcd) select a.bcd, len(list_intersect(a.t, b.t))::int as n_common from p a join p b on b.bcd = 'B' || (substr(a.bcd, 2)::int + 3)", "reads")
def u4_barcode_set_intersection(spark, sf):
    p = frags(spark, sf).groupBy("bcd").agg(F.collect_set("tid").alias("t"))
    b = p.select(F.col("bcd").alias("other"), F.col("t").alias("u"))
    return p.join(b, F.col("other") == F.concat(F.lit("B"), (F.substr("bcd", F.lit(2)).cast("int") + 3).cast("string"))).select("bcd", F.size(F.array_intersect("t", "u")).alias("n_common"))


@query("with c as (select *, \"end\" - start as len from reads) select tid, case when tid = 2 then 2 when tid = 3 then 1 when tid = 4 then 3 else null end as class, count(*) as n from c group by all", "reads")
def p22_special_contig_class(spark, sf):
    named = F.when(F.col("tid") == 2, "chrX").when(F.col("tid") == 3, "chrY").when(F.col("tid") == 4, "chrM").otherwise(F.concat(F.lit("chr"), F.col("tid").cast("string")))
    return reads(spark, sf).groupBy("tid", R.special_contig_class(named).alias("class")).agg(F.count(F.lit(1)).alias("n"))


__all__ = ["calls", "hap_frags"]
