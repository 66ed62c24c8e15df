"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source is cut into blocks by a hash of its ids, which also permutes it. Its target says how many
words the mix takes: whole passes over all blocks, then blocks from the first on, the last one in
part. These block quotas are exact. They are dealt out to the output shards by a binary tree: each
node gives its left half of the shards a multivariate-hypergeometric share of its quotas, which is
how a random deal of all blocks would fall, without any block being looked at. A shard then draws
the next blocks of each permuted source, disjoint from all other shards', and shuffles locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import WORD
from strandloom.session import stash

WEIGHTS = (5, 2, 1)
FACTOR, CAP = 1.5, 2.0
SHARDS, SEED = 16, "mix"
#: Rows that a block should have about; the number of blocks of a source follows from it.
BLOCK_ROWS = 500


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, cap: float = CAP) -> DataFrame:
    """``sources`` (``skey, source, source_size``; one row each) with ``idx`` and ``target`` words.

    Sources by code point, null last, weigh ``weights`` in turn and share ``factor`` times all words;
    none gets more than ``cap`` times its own. A target is the less of its cap and a level times its
    weight, the level being such that all is shared: resharing what is above the caps until nothing is.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("idx", F.row_number().over(order) - 1).withColumn("w", w).withColumn("most", F.lit(cap) * F.col("source_size"))
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("most") / F.col("w"), "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.lit(factor) * F.sum("source_size").over(every) - F.sum("most").over(filled)
    over = F.sum("w").over(every) - F.sum("w").over(filled)
    # the level if exactly the sources up to this one were full
    rows = rows.withColumn("left", left).withColumn("over", over).withColumn("level", F.when(F.col("over") > 0.5, F.col("left") / F.col("over")))
    first = F.lit(factor) * F.sum("source_size").over(every) / F.sum("w").over(every)
    full = F.when(F.col("level") >= F.col("most") / F.col("w"), F.col("level"))
    rows = rows.withColumn("level", F.greatest(first, F.coalesce(F.max(full).over(every), F.lit(0.0))))
    return rows.select("skey", "source", "idx", "source_size", F.round(F.least("most", F.col("level") * F.col("w")), 6).alias("target"))


def _draw() -> str:
    """SQL: the state (places left, blocks left, counts drawn) after one source e = (idx, K) more."""

    def log_fact(x: str) -> str:
        y = f"({x} + 1D)"
        return f"(({y} - 0.5) * ln({y}) - {y} + 0.9189385332046727 + 1 / (12 * {y}) - 1 / (360 * {y} * {y} * {y}))"

    def log_p(v: str) -> str:
        return "-(" + " + ".join(map(log_fact, (v, f"(q.K - {v})", f"(q.room - {v})", f"(q.total - q.K - q.room + {v})"))) + ")"

    mean = "if(z.total > 0, z.room * e.K / z.total, 0D)"
    spread = "if(z.total > 1, 8 * sqrt(z.room * 1D * e.K / z.total * (z.total - e.K) / z.total * (z.total - z.room) / (z.total - 1)) + 2, 2D)"
    lo = f"greatest(0L, z.room - (z.total - e.K), cast(floor({mean} - {spread}) as bigint))"
    hi = f"least(z.room, e.K, cast(ceil({mean} + {spread}) as bigint))"
    chance = "exp(" + log_p("v") + " - q.top)"
    let = f"array(named_struct('total', z.total, 'room', z.room, 'K', e.K, 'lo', {lo}, 'hi', {hi}, 'mid', least({hi}, greatest({lo}, cast(round({mean}) as bigint))), 'u', (pmod(xxhash64(seed, lo_shard, n_shards, e.idx), 1048576) + 0.5) / 1048576))"
    let_top = f"transform({let}, q -> named_struct('total', q.total, 'room', q.room, 'K', q.K, 'lo', q.lo, 'hi', q.hi, 'u', q.u, 'top', {log_p('q.mid')}))"
    let_sum = f"transform({let_top}, q -> named_struct('q', q, 'sum', aggregate(sequence(q.lo, q.hi), 0D, (t, v) -> t + {chance})))"
    picked = f"aggregate(sequence(q.lo, q.hi), named_struct('c', 0D, 'x', q.lo), (t, v) -> if(t.c >= r.u * r.sum, t, named_struct('c', t.c + {chance}, 'x', v)), t -> t.x)"
    drawn = picked.replace("r.u", "q.u").replace("r.sum", "q.sum")
    flat = f"transform({let_sum}, s -> named_struct('total', s.q.total, 'room', s.q.room, 'K', s.q.K, 'lo', s.q.lo, 'hi', s.q.hi, 'u', s.q.u, 'top', s.q.top, 'sum', s.sum))"
    return f"aggregate(transform({flat}, q -> {drawn}), z, (y, x) -> named_struct('room', z.room - x, 'total', z.total - e.K, 'out', concat(z.out, array(x))))"


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``shard, idx, blocks``: how many of each source's blocks (``idx, quota``) each shard gets.

    ``shards`` is a power of two. Shards get equally many blocks, one more or less; a source's
    blocks add up to its quota. The quotas of all sources, one number each, are one row here.
    """
    if shards < 1 or shards & shards - 1:
        raise ValueError("shards must be a power of two")
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("quota").cast("long").alias("K")))).alias("counts"))
    node = node.select("counts", F.lit(0).alias("lo_shard"), F.lit(shards).alias("n_shards"), F.lit(seed).alias("seed"))
    n = shards
    while n > 1:
        total = "aggregate(counts, 0L, (t, e) -> t + e.K)"
        start = f"named_struct('room', {total} div 2 + if({total} % 2 = 1, pmod(xxhash64(seed, lo_shard, n_shards), 2), 0), 'total', {total}, 'out', cast(array() as array<bigint>))"
        node = node.withColumn("left", F.expr(f"aggregate(counts, {start}, (z, e) -> {_draw()}, z -> z.out)"))
        halves = F.expr(
            "inline(array(named_struct('counts', transform(counts, (e, i) -> named_struct('idx', e.idx, 'K', left[i])), 'lo_shard', lo_shard),"
            " named_struct('counts', transform(counts, (e, i) -> named_struct('idx', e.idx, 'K', e.K - left[i])), 'lo_shard', lo_shard + n_shards div 2)))"
        )
        n //= 2
        node = node.select(F.col("n_shards").alias("was"), "seed", halves).select("counts", "lo_shard", F.lit(n).alias("n_shards"), "seed")
    return node.select(F.col("lo_shard").alias("shard"), F.inline("counts")).select("shard", "idx", F.col("K").alias("blocks"))


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, cap: float = CAP, shards: int = SHARDS, seed: str = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies`` and ``shards``, the shard of each copy.

    A document's size is its number of words (null: 0). ``copies`` is 0 to 2. The words taken from a
    source differ from its target by half the size of one document at most. Which documents are
    taken follows from their ids, so reruns agree; rows that repeat an id and size are alike.
    Sources may be null; rows without an id are told apart by their texts. The largest source is cut
    into blocks of about ``block_rows`` rows, so that more documents make more blocks and not larger
    ones. Repeated rows of one id are one place of the order and are alike. An empty table gives no
    rows. Columns called like the results give way to them; all others pass, whatever their names.
    """
    results = ("size", "source_size", "target", "copies", "shards")
    given = docs.drop(*results)
    named = F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.concat(F.lit("~"), F.xxhash64(text).cast("string")))
    key = F.md5(F.concat_ws("|", F.lit(seed), named))
    sized = given.select(F.struct(*[F.col(f"`{c}`") for c in given.columns]).alias("given"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_skey"), key.alias("_key"))
    largest = docs.groupBy(source).count().agg(F.max("count")).first()[0] or 1
    digits = next(d for d in range(1, 16) if 16**d * block_rows >= largest)
    sized = sized.withColumn("_block", F.substring("_key", 1, digits))
    blocks, _ = stash(sized.groupBy("_skey", "_block").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "blocks")
    own = targets(blocks.groupBy(F.col("_skey").alias("skey")).agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), weights, factor, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    own = own.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    # places and words before each block in two steps: over the parts of a source, then within a part
    placed = blocks.drop("source").withColumn("_part", F.substring("_block", 1, (digits + 1) // 2))
    parts = placed.groupBy("_skey", "_part").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    by_part = Window.partitionBy("_skey").orderBy("_part")
    parts = parts.select("_skey", "_part", (F.sum("w").over(by_part) - F.col("w")).alias("w0"), (F.sum("n").over(by_part) - F.col("n")).alias("n0"))
    by_block = Window.partitionBy("_skey", "_part").orderBy("_block")
    placed = placed.withColumn("start", F.sum("words").over(by_block) - F.col("words")).withColumn("rank", F.row_number().over(by_block) - 1)
    placed = placed.join(parts, ["_skey", "_part"]).join(own.withColumnRenamed("skey", "_skey"), "_skey")
    placed = placed.withColumn("start", F.col("start") + F.col("w0")).withColumn("rank", F.col("rank") + F.col("n0")).drop("w0", "n0", "_part")
    in_rest = (F.col("start") < F.col("rest")).cast("long")
    placed, _ = stash(placed.withColumn("drawn", F.col("passes") + in_rest), "placed")
    quotas = placed.groupBy("idx").agg(F.sum("drawn").alias("quota"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("drawn") > 0, 1).otherwise(0)).alias("first_pass"))
    dealt = split_quotas(quotas.select("idx", "quota"), shards, seed)
    upto = F.sum("blocks").over(Window.partitionBy("idx").orderBy("shard"))
    draws = dealt.withColumn("upto", upto).where("blocks > 0").select("idx", "shard", F.explode(F.expr("sequence(upto - blocks, upto - 1)")).alias("turn"))
    turns = placed.join(quotas.select("idx", "first_pass"), "idx").where("drawn > 0")
    turns = turns.select("idx", "_skey", "_block", F.posexplode(F.expr("if(drawn = 1, array(rank), array(rank, first_pass + rank))")).alias("copy", "turn"))
    homes = turns.withColumn("idx", F.col("idx").cast("long")).withColumn("turn", F.col("turn").cast("long")).join(draws.hint("merge"), ["idx", "turn"])
    homes = homes.groupBy("_skey", "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda s: s["shard"]).alias("homes"))
    facts = placed.select("_skey", "_block", "source_size", "target", "passes", "rest", "start").join(homes.hint("merge"), ["_skey", "_block"], "left")
    within = Window.partitionBy("_skey", "_block").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sized.withColumn("_upto", F.sum("size").over(within)).join(facts.hint("merge"), ["_skey", "_block"])
    before = F.col("start") + F.col("_upto") - F.col("size")
    extra = (F.col("start") < F.col("rest")) & (2 * before + F.col("size") <= 2 * F.col("rest"))
    copies = (F.col("passes") + extra.cast("long")).cast("int")
    none = F.expr("cast(array() as array<int>)")
    rows = rows.withColumn("copies", copies).withColumn("shards", F.when(F.col("copies") > 0, F.slice("homes", 1, F.col("copies"))).otherwise(none))
    return rows.select("given.*", *results)


def mixed(planned: DataFrame, doc_id: str = "doc_id", seed: str = SEED, parts: int = 16) -> DataFrame:
    """The mix: each row of ``plan_mix`` once for each copy, with its ``shard``, shuffled within the shard.

    A given column called ``shard`` gives way to it; the others pass, whatever their names.
    """
    results = {"size", "source_size", "target", "copies", "shards", "shard"}
    names = [c for c in planned.columns if c.lower() not in results]
    rows = planned.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("given"), F.col(doc_id).alias("_id"), F.posexplode("shards").alias("_copy", "shard"))
    order = F.xxhash64(F.lit(seed), F.col("_id"), "_copy")
    # a shard's rows are spread over several tasks, each of which sorts a range of the random order
    rows = rows.withColumn("_order", order).withColumn("_part", F.pmod(F.shiftrightunsigned("_order", 32), F.lit(parts)))
    return rows.repartition("shard", "_part").sortWithinPartitions("shard", "_order").select("given.*", "shard")
