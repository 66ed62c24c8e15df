"""Queries over sequence records and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import sequences as S
from strandloom.operators.ranks import numbered
from strandloom.plans.registry import query
from strandloom.sources.views import view


def seqs(spark, sf):
    return view(spark, sf, "seqs")


@query(
    "select name, length(seq) as length, "
    + ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) as n_{b.lower()}" for b in "ACGTN")
    + ", (length(seq) - length(replace(seq, 'CG', ''))) // 2 as n_cpg from seqs",
    "seqs",
)
def a25_sequence_composition(spark, sf):
    return S.composition(seqs(spark, sf))


_KMERS = """k as (select name, substr(seq, i, 11) as w from (select name, seq, unnest(range(1, length(seq) - 9)) as i from seqs)), c as (select name, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as kmer from k where w not like '%N%')"""


@query(f"with {_KMERS} select kmer, count(*) as n from c group by kmer having count(*) >= 2", "seqs")
def a27_kmer_count(spark, sf):
    return S.kmer_count(seqs(spark, sf), 11)


@query(f"with {_KMERS}, n as (select kmer, count(*) as n from c group by kmer having count(*) >= 2) select n, count(*) as n_kmers from n group by n", "seqs")
def a39_kmer_histogram(spark, sf):
    return S.kmer_histogram(S.kmer_count(seqs(spark, sf), 11))


@query(f"with {_KMERS}, q as (select kmer from c where name % 2 = 0 group by kmer having count(*) >= 2), r as (select kmer from c where name % 2 = 1) select distinct name from c where name % 2 = 0 and kmer in (select kmer from q) and kmer not in (select kmer from r)", "seqs")
def u5_kmer_contrast(spark, sf):
    rows = seqs(spark, sf)
    return S.kmer_contrast(rows.where("name % 2 = 0"), rows.where("name % 2 = 1"), 11)


@query(
    """with k as (select name, substr(seq, i, 6) as w from (select name, seq, unnest(range(1, length(seq) - 4)) as i from seqs)), d as (select name, w, list_sum(list_transform(range(1, 7), lambda j: (w[j] <> ('ACGTAC')[j])::int)) as f, list_sum(list_transform(range(1, 7), lambda j: (w[j] <> ('GTACGT')[j])::int)) as r from k where w not like '%N%')
    select name, 0 as strand, count(*) filter (f = 0) as n_exact, count(*) filter (f = 1) as n_near from d where f <= 1 group by name union all select name, 1, count(*) filter (r = 0), count(*) filter (r = 1) from d where r <= 1 group by name""",
    "seqs",
)
def a28_kmer_neighbour_freq(spark, sf):
    return S.kmer_neighbours(seqs(spark, sf), "ACGTAC")


_RUNS = """b as (select name, i, substr(seq, i, 1) as base from (select name, seq, unnest(range(1, length(seq) + 1)) as i from seqs)), g as (select *, i - row_number() over (partition by name, base order by i) as isl from b),
r as (select name, base, (min(i) - 1)::bigint as start, (max(i))::bigint as "end" from g group by name, base, isl)"""


@query(f"with {_RUNS} select name, start, \"end\", base from r where base <> 'N' and \"end\" - start >= 3", "seqs")
def w9_homopolymer_runs(spark, sf):
    return S.homopolymers(seqs(spark, sf), 3)


@query(f"with {_RUNS} select name, start, \"end\" from r where base = 'N' and \"end\" - start >= 2", "seqs")
def w9_n_gaps(spark, sf):
    return S.runs(seqs(spark, sf), "N{2,}").drop("run")


@query(
    """with b as (select name, i, substr(seq, i * 50 + 1, 50) as part from (select name, seq, unnest(range(0, length(seq) // 50)) as i from seqs)), h as (select name, i from b where length(part) - length(replace(replace(part, 'G', ''), 'C', '')) >= 0.5 * 50), g as (select *, i - row_number() over (partition by name order by i) as k from h)
    select name, (min(i) * 50)::int as start, ((max(i) + 1) * 50)::int as "end" from g group by name, k having (max(i) + 1 - min(i)) * 50 >= 100""",
    "seqs",
)
def w8_gc_rich_regions(spark, sf):
    return S.gc_regions(seqs(spark, sf), 50, 0.5, 100)


@query(
    """with b as (select name, i, substr(seq, i * 100 + 1, 100) as part from (select name, seq, unnest(range(0, (length(seq) + 99) // 100)) as i from seqs)), c as (select name, i, length(part) - length(replace(part, 'N', '')) as n_n, length(part) as l, length(part) - length(replace(replace(part, 'G', ''), 'C', '')) as gc from b)
    select name, i::int as "window", (l - n_n)::int as n_called, round(case when l > n_n then gc / (l - n_n) end, 9) as rate from c""",
    "seqs",
)
def w7_windowed_heterozygosity(spark, sf):
    return S.windowed_rate(seqs(spark, sf), 100).withColumn("rate", F.round("rate", 9))


@query("select name, reverse(translate(seq, 'ACGT', 'TGCA')) as seq from seqs where length(seq) >= 500 and seq not like '%NNNN%'", "seqs")
def p29_seq_transform(spark, sf):
    return seqs(spark, sf).where((F.length("seq") >= 500) & ~F.col("seq").contains("NNNN")).select("name", S.reverse_complement(F.col("seq")).alias("seq"))


@query("select name from (select name, row_number() over (order by md5('11|' || name), name) as k from seqs) where k <= 100", "seqs")
def o3_sample_records(spark, sf):
    return S.sample_exact(seqs(spark, sf), 100).select("name")


@query("select conv_id, turn, dense_rank() over (order by conv_id) as record from conversations")
def o6_rename_records(spark, sf):
    # mates share a number: distinct names are numbered once, then looked up
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn")
    names = numbered(rows.select("conv_id").distinct(), ["conv_id"], "record")
    return rows.join(names, "conv_id").select("conv_id", "turn", F.col("record").cast("long").alias("record"))


@query("select conv_id, turn, role from conversations where conv_id in (select conv_id from conversations group by conv_id having count(*) = 2)")
def f12_drop_singletons(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role")
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).where("n = 2").drop("n")


@query("select name, substr(seq, (name % 50)::int + 1, 60) as part from seqs where name in (select doc_id from labels where quality = 1)", "seqs")
def f13_subset_by_region(spark, sf):
    wanted = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("name"))
    return seqs(spark, sf).join(wanted, "name", "left_semi").select("name", F.substr("seq", (F.col("name") % 50 + 1).cast("int"), F.lit(60)).alias("part"))


def _merged(rows: DataFrame) -> DataFrame:
    """Each sequence with that of the next name: N where they differ."""
    # texts meet as texts, and are split into bases only then
    both = rows.select("name", "seq").join(rows.select((F.col("name") - 1).alias("name"), F.col("seq").alias("other")), "name").where("seq <> '' and other <> ''")
    n = F.least(F.length("seq"), F.length("other"))
    rows = both.select("name", n.alias("n"), F.split(F.substr("seq", F.lit(1), n), "").alias("s"), F.split(F.substr("other", F.lit(1), n), "").alias("t"))
    n = F.col("n")
    rows = rows.withColumn("z", F.zip_with("s", "t", lambda x, y: F.when(x == y, x).otherwise("N")))
    same = F.aggregate(F.zip_with("s", "t", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, v: t + v)
    return rows.select("name", same.cast("long").alias("n_same"), (n - same).cast("long").alias("n_different"), F.array_join("z", "").alias("merged"))


@query(
    """with a as (select name, seq as s from seqs), p as (select x.name, x.s as s, y.s as t, unnest(range(1, least(length(x.s), length(y.s)) + 1)) as i from a x join a y on y.name = x.name + 1)
    select name, count(*) filter (s[i] = t[i]) as n_same, count(*) filter (s[i] <> t[i]) as n_different, string_agg(case when s[i] = t[i] then s[i] else 'N' end, '' order by i) as merged from p group by name""",
    "seqs",
)
def j21_merge_sequences(spark, sf):
    return _merged(seqs(spark, sf))


_QUALS = "q as (select name, list_transform(range(1, length(seq) + 1), lambda i: ((i * 7 + name * 3) % 41)::int) as quals from seqs)"


def quals(spark, sf) -> DataFrame:
    """A quality for each base."""
    n = F.length("seq")
    return seqs(spark, sf).select("name", F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: ((i * 7 + F.col("name") * 3) % 41).cast("int"))).otherwise(F.expr("cast(array() as array<int>)")).alias("quals"))


@query(f"with {_QUALS} select name, array_to_string(list_transform(quals, lambda x: case when x >= 30 then 30 when x >= 20 then 20 when x >= 10 then 10 when x >= 3 then 3 else 0 end), ',') as binned from q", "seqs")
def p27_quality_bin(spark, sf):
    return _binned(quals(spark, sf))


def _binned(rows: DataFrame) -> DataFrame:
    return rows.select("name", F.array_join(S.quality_bin("quals").cast("array<string>"), ",").alias("binned"))


@query(
    f"""with {_QUALS}, s as (select name, i, round(0.05 - 10 ** (-quals[i] / 10.0), 9) as s from (select name, quals, unnest(range(1, len(quals) + 1)) as i from q)), c as (select name, i, round(sum(s) over (partition by name order by i rows unbounded preceding), 9) as cum from s),
    m as (select name, cum, least(0, coalesce(min(cum) over (partition by name order by i rows between unbounded preceding and 1 preceding), 0)) as low from c) select name, max(round(cum - low, 9)) as best_score from m group by name having max(round(cum - low, 9)) > 0""",
    "seqs",
)
def p28_trim_by_quality(spark, sf):
    return _trimmed(quals(spark, sf))


def _trimmed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("t", S.best_stretch("quals"))
    return rows.where("t.end > t.start").select("name", F.round("t.score", 9).alias("best_score"))


@query(
    f"""with {_QUALS}, e as (select unnest(range(1, len(quals) + 1)) as pos, unnest(quals) as q from q) select pos::int as pos, count(*) as n, round(avg(q), 9) as mean_q, count(*) filter (q < 20) as n_low from e group by rollup (pos)""",
    "seqs",
)
def a26_base_quality_profile(spark, sf):
    return _profile(quals(spark, sf))


def _profile(quals: DataFrame) -> DataFrame:
    """By position and in all; the total is drawn from the positions, so that a base is one row."""
    rows = quals.select(F.posexplode("quals").alias("i", "q")).groupBy((F.col("i") + 1).alias("pos"))
    by_pos = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("s"), F.count_if(F.col("q") < 20).alias("n_low"))
    total = by_pos.agg(F.lit(None).cast("int").alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("s").alias("s"), F.coalesce(F.sum("n_low"), F.lit(0)).alias("n_low"))
    return by_pos.unionByName(total).select("pos", "n", F.round(F.col("s") / F.col("n"), 9).alias("mean_q"), "n_low")


@query(
    """with iv as (select 'chr' || tid as name, start, "end" from regions), l as (select name, 1000000 as length from (select distinct name from iv)), o as (select *, max("end") over (partition by name order by start, "end") as reach, lead(start) over (partition by name order by start, "end") as nxt from iv),
    u as (select name, reach as start, nxt as "end" from o where nxt - reach >= 200 union all select name, 0, min(start) from iv group by name having min(start) >= 200 union all select iv.name, max("end"), max(length) from iv join l on iv.name = l.name group by iv.name having max(length) - max("end") >= 200) select * from u""",
    "regions",
)
def a40_uncovered_regions(spark, sf):
    iv = view(spark, sf, "regions").select(F.concat(F.lit("chr"), F.col("tid").cast("string")).alias("name"), "start", "end")
    return S.uncovered(iv, iv.select("name").distinct().withColumn("length", F.lit(1_000_000)), 200)
