"""Small variants: alleles, genotypes, filters, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.scores import log_factorial
from strandloom.operators.intervals import TILE, tiled, with_halo
from strandloom.session import stash

#: Allele classes.
TRANSITION, TRANSVERSION, MNP, INSERTION, DELETION = range(5)


def allele_class(ref: Column, alt: Column) -> Column:
    same = F.length(ref) == F.length(alt)
    pair = F.array_join(F.array_sort(F.array(F.upper(ref), F.upper(alt))), "")
    return (
        F.when(same & (F.length(ref) == 1), F.when(pair.isin("AG", "CT"), TRANSITION).otherwise(TRANSVERSION))
        .when(same, MNP).when(F.length(alt) > F.length(ref), INSERTION).otherwise(DELETION)
    )


def explode_alleles(sites: DataFrame) -> DataFrame:
    """One row for each alternative allele: ``allele, class, indel_length``; ``alt`` is comma-separated."""
    rows = sites.withColumn("allele", F.explode(F.split("alt", ",")))
    return rows.withColumn("class", allele_class(F.col("ref"), F.col("allele"))).withColumn("indel_length", F.length("allele") - F.length("ref"))


def genotype_recall(likelihoods: str, het_prior: float = 30.0) -> Column:
    """struct(genotype, quality) from phred-scaled likelihoods (0/0, 0/1, 1/1); the heterozygote pays the prior."""
    pl = F.transform(F.col(likelihoods), lambda x, i: x + F.when(i == 1, het_prior).otherwise(0.0))
    order = F.array_sort(pl)
    best = F.array_position(pl, F.get(order, 0)) - 1
    return F.struct(F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), (best + 1).cast("int")).alias("genotype"), (F.get(order, 1) - F.get(order, 0)).alias("quality"))


def genotype_normalize(gt: Column) -> Column:
    """Unphased ``b/a`` with b > a as ``a/b``; anything else as it is."""
    a, b = F.regexp_extract(gt, r"^(\d+)/(\d+)", 1).cast("int"), F.regexp_extract(gt, r"^(\d+)/(\d+)", 2).cast("int")
    rest = F.regexp_extract(gt, r"^\d+/\d+(.*)$", 1)
    return F.when(gt.rlike(r"^\d+/\d+") & (a > b), F.concat(b.cast("string"), F.lit("/"), a.cast("string"), rest)).otherwise(gt)


def variant_to_bed(sites: DataFrame) -> DataFrame:
    return sites.select("chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end"), "ref", "alt", F.size(F.split("alt", ",")).alias("n_alts"))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The chance of a 2 x 2 table no likelier than this one, its margins being given."""
    n1, n2, k = a + b, c + d, a + c
    start = F.greatest(F.lit(0), k - n2)
    stop = F.least(n1, k)
    lp = lambda x: -(log_factorial(x) + log_factorial(n1 - x) + log_factorial(k - x) + log_factorial(n2 - k + x))
    all_ = F.transform(F.sequence(start.cast("long"), stop.cast("long")), lp)
    own = lp(a.cast("long"))
    top = F.array_max(all_)
    weight = F.aggregate(all_, F.lit(0.0), lambda t, v: t + F.exp(v - top))
    tail = F.aggregate(all_, F.lit(0.0), lambda t, v: t + F.when(v <= own + 1e-7, F.exp(v - top)).otherwise(0.0))
    return F.least(tail / weight, F.lit(1.0))


def strand_bias_phred(a: Column, b: Column, c: Column, d: Column) -> Column:
    return -4.343 * F.log(fisher_two_sided(a, b, c, d))


def mean_depth(sites: DataFrame, min_qual: float) -> DataFrame:
    return sites.where(F.col("qual") >= min_qual).agg(F.avg("depth").alias("mean_depth"))


def hard_filter(sites: DataFrame, min_qual: float = 30, min_depth: int = 3, coef: float = 4.0, max_fs: float = 30, min_ab: int = 30, min_ds: int = 1) -> DataFrame:
    """``sites`` (``qual, depth, fs, ab, ds, ref, alt``) of enough quality with ``filter``: ``.`` or the labels that apply.

    Depth is high above the mean plus ``coef`` times its root; the mean is over the sites of enough quality.
    """
    mean = F.broadcast(mean_depth(sites, min_qual))
    gap = F.exists(F.split("alt", ","), lambda x: F.length(x) != F.length("ref"))
    flag = lambda on, name: F.when(on, F.lit(name))
    high = F.col("depth") > F.col("mean_depth") + coef * F.sqrt("mean_depth")
    labels = F.concat_ws(";", F.coalesce(flag(high, "DPhigh"), flag(F.col("depth") < min_depth, "DPlow")), flag(F.col("fs") > max_fs, "FShigh"), flag(~gap & (F.col("ds") < min_ds), "DSlow"), flag(F.col("ab") < min_ab, "ABlow"))
    rows = sites.where(F.col("qual") >= min_qual).join(mean)
    return rows.withColumn("filter", F.when(labels == "", ".").otherwise(labels)).drop("mean_depth")


def quality_strata(alleles: DataFrame, fraction: float = 0.02) -> DataFrame:
    """Counts of allele classes by quality stratum, best first, and cumulative; a stratum has about ``fraction`` of all alleles."""
    hist = alleles.groupBy("qual").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("class") == k).alias(f"n{k}") for k in range(5)])
    w = Window.orderBy(F.desc("qual")).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    strata = cum.withColumn("stratum", F.floor(F.col("before") / (fraction * F.col("total")))).groupBy("stratum").agg(F.min("qual").alias("qual"), *[F.sum(c).alias(c) for c in ("n", *[f"n{k}" for k in range(5)])])
    over = Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, 0)
    return strata.select("stratum", "qual", "n", *[f"n{k}" for k in range(5)], *[F.sum(c).over(over).alias(f"cum_{c}") for c in ("n", *[f"n{k}" for k in range(5)])])


def site_summary(calls: DataFrame) -> DataFrame:
    """Long genotypes (``chrom, pos, sample, a1, a2, ad``; alleles -1: missing) by site: allele and genotype counts, depths, labels."""
    alleles = F.array("a1", "a2")
    count = lambda k: F.sum(F.size(F.filter(alleles, lambda x: x == F.lit(k)))).alias(f"n_allele{k}")
    out = calls.groupBy("chrom", "pos").agg(
        count(0), count(1), F.count_if((F.col("a1") == 0) & (F.col("a2") == 0)).alias("n_hom_ref"), F.count_if(F.col("a1") != F.col("a2")).alias("n_het"),
        F.count_if((F.col("a1") == F.col("a2")) & (F.col("a1") > 0)).alias("n_hom_alt"), F.count_if(F.col("a1") < 0).alias("n_missing"), F.sum("ad").alias("sum_ad"), F.max("ad").alias("best_ad"), F.count(F.lit(1)).alias("n"),
    )
    label = F.concat_ws(";", F.when(F.col("n_allele1") == 0, "NONVAR"), F.when(F.col("best_ad") < 5, "LOWAD"), F.when(2 * F.col("n_missing") > F.col("n"), "HIGHNC"))
    return out.withColumn("label", F.when(label == "", ".").otherwise(label)).drop("n")


def trim_unused_alleles(calls: DataFrame) -> DataFrame:
    """Alternatives that no sample carries go, and the genotypes of the others are renumbered. ``alts`` is an array, alleles count from 1 there."""
    used = calls.groupBy("chrom", "pos").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("a1", "a2"))))).alias("_used"))
    rows = calls.join(used, ["chrom", "pos"]).withColumn("_used", F.filter("_used", lambda x: x > 0))
    new = lambda c: F.when(F.col(c) > 0, F.array_position("_used", F.col(c)).cast("int")).otherwise(F.col(c))
    return rows.select("chrom", "pos", "sample", new("a1").alias("a1"), new("a2").alias("a2"), F.transform("_used", lambda k: F.get("alts", k - 1)).alias("alts"))


def distance_eval(truth: DataFrame, called: DataFrame, near: int = 10) -> DataFrame:
    """By kind (``SNP``, ``INDEL``): truth found and missed, calls without a truth, and the rates; sites match within ``near`` bases."""
    kinds = lambda d: d.select("chrom", "pos", F.when(F.length("ref") == F.length("alt"), "SNP").otherwise("INDEL").alias("kind")).distinct()
    t, c = kinds(truth), kinds(called)
    cell = near + 1

    def found(a: DataFrame, b: DataFrame) -> DataFrame:
        x = a.withColumn("k", F.floor(F.col("pos") / cell))
        y = b.select("chrom", "kind", F.col("pos").alias("p"), F.explode(F.array(*[F.floor(F.col("pos") / cell) + d for d in (-1, 0, 1)])).alias("k"))
        hit = x.join(y, ["chrom", "kind", "k"]).where(F.abs(F.col("pos") - F.col("p")) <= near).select("chrom", "kind", "pos").distinct().withColumn("hit", F.lit(1))
        return a.join(hit, ["chrom", "kind", "pos"], "left").groupBy("kind").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n"))

    tt = found(t, c).select("kind", F.col("hits").alias("tp"), (F.col("n") - F.col("hits")).alias("fn"))
    cc = found(c, t).select("kind", (F.col("n") - F.col("hits")).alias("fp"), F.col("n").alias("n_calls"))
    rows = tt.join(cc, "kind", "full").na.fill(0, ["tp", "fn", "fp", "n_calls"])
    return rows.select("kind", "tp", "fn", "fp", (F.col("fn") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("fnr"), (F.col("fp") / F.nullif(F.col("n_calls"), F.lit(0))).alias("fdr"))


#: Rows of samples that one task merges.
SITES_OF_A_TASK = 1 << 19


def merge_samples(samples: dict[str, DataFrame]) -> DataFrame:
    """One row for each (chrom, pos, ref, alt) of any sample, with each sample's best quality; one shuffle however many samples.

    Sites are dealt to tasks by their place before they are counted: most are seen once or twice, and a map of them
    would be as large as the rows that a task reads. The number of tasks follows the rows.
    """
    rows = None
    for name, df in samples.items():
        part = df.select("chrom", "pos", "ref", "alt", "qual", F.lit(name).alias("sample"))
        rows = part if rows is None else rows.unionAll(part)
    rows = rows.repartition(1 + rows.count() // SITES_OF_A_TASK, "chrom", "pos")
    seen = sum((F.coalesce(F.max(F.when(F.col("sample") == n, 1)), F.lit(0)) for n in samples), F.lit(0))
    return rows.groupBy("chrom", "pos", "ref", "alt").agg(*[F.max(F.when(F.col("sample") == n, F.col("qual"))).alias(f"qual_{n}") for n in samples], seen.cast("long").alias("n_samples"))


def deoverlap(sites: DataFrame, tile: int = TILE) -> DataFrame:
    """Among overlapping variants (``chrom, pos, ref, qual, line, ok``) the better; in order, a later one wins only if strictly better.

    Of variants with the same place and length only the best can win, so the others go first, in a
    partial aggregate; what is left of an island of overlapping variants follows its stretch of the genome and
    not the rows, and is folded in the JVM. Islands are named along tiles. A null quality is the lowest; variants without a
    place or with a null or empty reference overlap nothing and stay. Of rows that tie in every order column any
    one, the same in each run, stays.
    """
    cols = [F.col(f"`{c}`") for c in sites.columns]
    q = F.coalesce(F.col("qual").cast("double"), F.lit(float("-inf")))
    rows = sites.withColumn("_v", F.struct(*cols)).withColumn("_end", F.col("pos") + F.length("ref")).withColumn("_q", q)
    solid = F.coalesce(F.length("ref") > 0, F.lit(False)) & F.col("pos").isNotNull()
    best = rows.where(solid).groupBy("chrom", "pos", "_end").agg(F.min_by(F.struct("_v", "_q"), F.struct(-F.col("_q"), "line", "ok", F.xxhash64("_v"))).alias("_b"))
    best = best.select("chrom", "pos", "_end", "_b._v", "_b._q")
    before = Window.partitionBy("chrom").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    w = Window.partitionBy("chrom", "_tile").orderBy("pos", "_end")
    best = tiled(best, ["chrom"], "pos", [F.max("_end").alias("_m")], [F.max("_m").over(before).alias("_reach")], tile)
    reach = F.greatest(F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_reach")
    best = best.withColumn("_head", F.when(F.col("pos") < reach, None).otherwise(F.col("pos"))).drop("_tile", "_reach")
    best = tiled(best, ["chrom"], "pos", [F.max("_head").alias("_m")], [F.max("_m").over(before).alias("_earlier")], tile)
    best = best.withColumn("_island", F.coalesce(F.max("_head").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_earlier"))
    islands = best.groupBy("chrom", "_island").agg(F.array_sort(F.collect_list(F.struct("pos", "_end", "_q", "_v"))).alias("_all"))
    islands = islands.withColumn("_one", F.get("_all", 0)).withColumn("_start", F.struct(F.filter("_all", lambda x: F.lit(False)).alias("kept"), F.col("_one").alias("last")))

    def step(acc, x):
        kept = F.when(x["pos"] >= acc["last"]["_end"], F.concat(acc["kept"], F.array(acc["last"]))).otherwise(acc["kept"])
        wins = (x["pos"] >= acc["last"]["_end"]) | (x["_q"] > acc["last"]["_q"])
        return F.struct(kept.alias("kept"), F.when(wins, x).otherwise(acc["last"]).alias("last"))

    many = F.aggregate(F.slice("_all", 2, F.size("_all")), F.col("_start"), step, lambda acc: F.concat(acc["kept"], F.array(acc["last"])))
    won = islands.select(F.explode(F.when(F.size("_all") == 1, F.col("_all")).otherwise(many)).alias("_w")).select("_w._v.*")
    return won.unionByName(rows.where(~solid).select("_v.*")).withColumn("end", F.col("pos") + F.length("ref"))


#: Letters that are told apart, in order; any other counts as N. Places of a tile.
LETTERS = np.frombuffer(b"ACGNT", np.uint8)
PILE_TILE = 1 << 16
_CODE = np.full(256, 3, np.uint8)
for _k, _letter in enumerate(LETTERS):
    _CODE[_letter] = _CODE[_letter + 32] = _k


def _piles(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``tid``, the tile's first place, and by place and letter the aligned bases and those of reversed reads, from rows in order of (tid, tile)."""
    k, now = len(LETTERS), None
    for batch in batches:
        tid, number, start, reverse = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tid", "_tile", "start", "reverse"))
        seq = batch.column("seq").cast(pa.large_string())
        _, offsets, letters = seq.buffers()
        offsets = np.frombuffer(offsets, np.int64)[seq.offset : seq.offset + len(seq) + 1]
        codes = _CODE[np.frombuffer(letters, np.uint8)[offsets[0] : offsets[-1]]] if len(seq) else None
        cuts = [0, *(np.flatnonzero((tid[1:] != tid[:-1]) | (number[1:] != number[:-1])) + 1).tolist(), len(tid)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if (tid[a], number[a]) != now:
                if now is not None:
                    yield now[0], now[1] * tile, counts.reshape(tile, k), reversed_.reshape(tile, k)
                now, counts, reversed_ = (int(tid[a]), int(number[a])), np.zeros(tile * k, np.int64), np.zeros(tile * k, np.int64)
            first, length = offsets[a:b] - offsets[a], np.diff(offsets[a : b + 1])
            place = np.repeat(start[a:b] - now[1] * tile - first, length) + np.arange(offsets[b] - offsets[a])
            inside = (place >= 0) & (place < tile)
            at = place[inside] * k + codes[offsets[a] - offsets[0] : offsets[b] - offsets[0]][inside]
            counts += np.bincount(at, minlength=tile * k)
            reversed_ += np.bincount(at[np.repeat(reverse[a:b], length)[inside]], minlength=tile * k)
    if now is not None:
        yield now[0], now[1] * tile, counts.reshape(tile, k), reversed_.reshape(tile, k)


def _letters(codes: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    return pa.array([chr(x) for x in LETTERS]).take(pa.array(codes, pa.int64(), mask=None if known is None else ~known))


def _piled(reads: DataFrame, make: Callable[..., list[pa.Array]], kind: str, tile: int) -> DataFrame:
    """The columns that ``make`` gives for each tile of the piled up reads (``tid, start, seq, reverse``).

    Reads go to the tiles that they lie in and are counted there: their bases are neither shuffled nor kept.
    """
    rows = reads.select("tid", F.col("start").cast("long").alias("start"), "seq", F.col("reverse").cast("boolean").alias("reverse")).where("tid is not null and start is not null and length(seq) > 0").fillna(False, ["reverse"])
    rows = rows.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("start") + F.length("seq") - 1) / tile))))
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pile in _piles(batches, tile):
            yield pa.RecordBatch.from_arrays(make(*pile), names=names)

    return rows.repartition("tid", "_tile").sortWithinPartitions("tid", "_tile").mapInArrow(run, kind)


def _best_two(n: np.ndarray, min_support: int) -> tuple[np.ndarray, ...]:
    """``at``, the places at which a letter has enough support, and there the best letter, its count, the second one and its count, or 0."""
    at = np.flatnonzero(n.max(1) >= min_support)
    enough = np.where(n[at] >= min_support, n[at], 0)
    row, best = np.arange(len(at)), enough.argmax(1)
    n_best = enough[row, best]
    enough[row, best] = 0
    second = enough.argmax(1)
    return at, best, n_best, second, enough[row, second]


def pileup(reads: DataFrame, min_support: int = 2, tile: int = PILE_TILE) -> DataFrame:
    """Reads (``tid, start, seq, reverse``; a letter of ``seq`` for each place) by position: depth, the two best alleles with enough support, their counts."""

    def make(tid: int, lo: int, n: np.ndarray, n_reverse: np.ndarray) -> list[pa.Array]:
        at, best, n_best, second, n_second = _best_two(n, min_support)
        return [pa.array(np.full(len(at), tid, np.int32)), pa.array(at + lo), pa.array(n[at].sum(1)), _letters(best), pa.array(n_best), pa.array(n_reverse[at, best]), _letters(second, n_second > 0), pa.array(n_second)]

    return _piled(reads, make, "tid int, pos long, depth long, best string, n_best long, n_best_reverse long, second string, n_second long", tile)


def consensus(reads: DataFrame, min_support: int = 2, tile: int = PILE_TILE) -> DataFrame:
    """The consensus of each contig's stretches of adjacent positions of the pileup: lower case where a second allele has half the best one's support.

    Stretches are made within tiles; only those that reach a tile's edge, two a tile at most, are put together along a contig.
    """

    def make(tid: int, lo: int, n: np.ndarray, _: np.ndarray) -> list[pa.Array]:
        at, best, n_best, _, n_second = _best_two(n, min_support)
        text = (LETTERS[best] + 32 * (2 * n_second >= n_best)).astype(np.uint8).tobytes().decode()
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        first, last = np.concatenate([[0], cuts])[: len(at)], np.append(cuts, len(at))[: len(at)]
        return [pa.array(np.full(len(first), tid, np.int32)), pa.array(at[first] + lo), pa.array(at[last - 1] + lo + 1), pa.array([text[a:b] for a, b in zip(first, last, strict=True)], pa.string())]

    parts, _ = stash(_piled(reads, make, "tid int, start long, end long, consensus string", tile), "stretches")
    edge = (F.col("start") % tile == 0) | (F.col("end") % tile == 0)
    w = Window.partitionBy("tid").orderBy("start")
    rows = parts.where(edge).withColumn("_new", F.when(F.col("start") == F.lag("end").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.groupBy("tid", "_run").agg(F.min("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "consensus"))), lambda s: s["consensus"]), "").alias("consensus"))
    return parts.where(~edge).select("tid", "start", "consensus").unionByName(joined.drop("_run"))


def error_profile(reads: DataFrame, expected: Callable[[int, np.ndarray], np.ndarray], most: float = 0.35, tile: int = PILE_TILE) -> DataFrame:
    """``ref, base, n``: aligned bases by the reference's letter, at places where at most the share ``most`` of the bases differ from it.

    ``expected`` gives the letters (as bytes) of the reference at places of a contig. A tile gives one row for each two letters.
    """

    def make(tid: int, lo: int, n: np.ndarray, _: np.ndarray) -> list[pa.Array]:
        at = np.flatnonzero(n.any(1))
        ref, depth = _CODE[expected(tid, at + lo)], n[at].sum(1)
        fits = (depth - n[at, ref]) / depth <= most
        sums = np.zeros((len(LETTERS), len(LETTERS)), np.int64)
        np.add.at(sums, ref[fits], n[at[fits]])
        i, j = np.nonzero(sums)
        return [_letters(i), _letters(j), pa.array(sums[i, j])]

    return _piled(reads, make, "ref string, base string, n long", tile).groupBy("ref", "base").agg(F.sum("n").alias("n"))


def run_length_depth(depth: DataFrame, p: float = 0.0, tile: int = TILE) -> DataFrame:
    """Per-base depth (``tid, pos, d``) as runs of equal depth, or for p > 0 of equal log class: ``tid, start, end, d`` (the first).

    A run is named by its first position. It is told within tiles that see the position before them;
    tiles in which a run only goes on take its name from the tiles before.
    """
    level = F.col("d") if p == 0 else F.floor(F.log(F.col("d").cast("double")) / F.log(F.lit(1 + p)))
    w = Window.partitionBy("tid", "_tile").orderBy("pos")
    rows = with_halo(depth.withColumn("level", level), "pos", 1, 0, tile)
    goes_on = (F.col("level") == F.lag("level").over(w)) & (F.col("pos") == F.lag("pos").over(w) + 1)
    rows = rows.withColumn("_first", F.when(goes_on, None).otherwise(F.col("pos"))).where("_own").drop("_own", "_tile")
    before = Window.partitionBy("tid").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    rows = tiled(rows, ["tid"], "pos", [F.max("_first").alias("_m")], [F.max("_m").over(before).alias("_earlier")], tile)
    run = F.coalesce(F.max("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_earlier")
    return rows.withColumn("run", run).groupBy("tid", "run").agg(F.col("run").alias("start"), (F.max("pos") + 1).alias("end"), F.min_by("d", "pos").alias("d")).drop("run")


def join_runs(runs: DataFrame, tile: int = TILE) -> DataFrame:
    """Runs (``tid, idx, to, d``) with ``run``, the first place of the longer run of equal ``d`` that they make with those that touch them.

    What a tile's last run is, and where the run that it ends in began, are carried from tile to tile.
    """
    along = Window.partitionBy("tid").orderBy("_tile")
    w = Window.partitionBy("tid", "_tile").orderBy("idx")
    rows = tiled(runs, ["tid"], "idx", [F.max(F.struct("idx", "to", "d")).alias("_l")], [F.lag("_l").over(along).alias("_p")], tile)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.col(f"_p.{c}"))
    goes_on = (F.col("d") == before("d")) & (F.col("idx") == before("to") + 1)
    rows = rows.withColumn("_first", F.when(goes_on, None).otherwise(F.col("idx"))).drop("_tile", "_p")
    rows = tiled(rows, ["tid"], "idx", [F.max("_first").alias("_m")], [F.max("_m").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier")], tile)
    return rows.withColumn("run", F.coalesce(F.max("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_earlier")).drop("_first", "_earlier", "_tile")


def chunk_regions(reads: DataFrame, bases: int, gap: int, tile: int = TILE) -> DataFrame:
    """Contigs cut at gaps above ``gap`` and where the aligned bases so far pass a multiple of ``bases``: ``tid, start, end, bases``.

    How far the reads before reach, and their bases and gaps so far, are carried from tile to tile.
    """
    before = Window.partitionBy("tid").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    w = Window.partitionBy("tid", "_tile").orderBy("start", "end", "read_id", "flag", "line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = reads.select("tid", "start", "end", "read_id", "flag", "line", (F.col("end") - F.col("start")).alias("len"))
    carried = [F.max("_m").over(before).alias("_reach"), F.coalesce(F.sum("_l").over(before), F.lit(0)).alias("_bases")]
    rows = tiled(rows, ["tid"], "start", [F.max("end").alias("_m"), F.sum("len").alias("_l")], carried, tile)
    reach = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_reach")
    rows = rows.withColumn("_cut", F.when(F.col("start") - reach > gap, 1).otherwise(0)).withColumn("chunk", F.floor((F.col("_bases") + F.sum("len").over(upto) - F.col("len")) / bases))
    rows = tiled(rows.drop("_tile", "_reach", "_bases"), ["tid"], "start", [F.sum("_cut").alias("_m")], [F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_cuts")], tile)
    rows = rows.withColumn("part", F.col("_cuts") + F.sum("_cut").over(upto))
    return rows.groupBy("tid", "part", "chunk").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("len").alias("bases")).drop("part", "chunk")


#: Priors of the copy numbers 0 to 4 for each ploidy.
def copy_number_genotype(segments: DataFrame, mean: float, sd: float) -> DataFrame:
    """``genotype, score, cnv_type`` of segments (``n, mean_depth, ploidy``): the copy number 0 to 4 of the best log likelihood ratio."""
    priors = F.when(F.col("ploidy") == 1, F.array(*map(F.lit, (1e-2, 0.98, 1e-2, 1e-4, 1e-5)))).when(F.col("ploidy") == 0, F.array(*map(F.lit, (0.98, 1e-2, 1e-4, 1e-5, 1e-6)))).otherwise(F.array(*map(F.lit, (1e-4, 1e-2, 0.98, 1e-2, 1e-4))))
    z = lambda level: (F.col("mean_depth") - level) * F.sqrt("n") / sd
    llr = F.transform(priors, lambda q, i: ((z(F.lit(mean)) * z(F.lit(mean)) - z(i * mean / 2) * z(i * mean / 2)) / 2 + F.log(q) * F.log("n") * 2) / F.log(F.lit(10.0)))
    rows = segments.withColumn("_llr", llr).withColumn("score", F.array_max("_llr"))
    rows = rows.withColumn("genotype", (F.array_position("_llr", F.col("score")) - 1).cast("int")).drop("_llr")
    return rows.withColumn("cnv_type", F.col("genotype") - F.col("ploidy"))
