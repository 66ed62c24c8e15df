"""URL filters: listed host and path rules first, mined token rules for the rest.

Spark's FP-growth finds the sets of URL tokens that come with the label of bad pages. Rules below
the support, confidence and lift asked for go, and so do those that chance explains, and a rule
that a shorter one makes needless. A URL is matched through an inverted index: a rule is listed under its rarest token only,
so a URL meets the rules of its own tokens and no others.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import lower_ascii
from strandloom.session import stash

#: Marks a bad page among the items of a transaction; no URL token holds a space.
BAD = "label bad"


@dataclass(frozen=True)
class ListedRule:
    """``host`` and its subdomains, with paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: list[ListedRule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. For short lists."""
    out: Column | None = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        hit = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: host labels, path words and query keys, without numbers."""
    words = F.split(lower_ascii(F.regexp_replace(F.coalesce(url, F.lit("")), r"=[^&#]*", "")), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 0) & ~w.rlike(r"^\p{N}+$")))


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_lift: float = 1.5, min_bad: int = 5, level: float = 0.05) -> DataFrame:
    """``items, confidence, lift, support, anchor``: token sets that mark bad pages.

    ``pages`` has ``page_id, url``; ``labels`` has ``page_id, bad``; pages and labels belong together by
    equal id. Pages without a label or URL teach nothing, equal rows teach once. A rule needs
    ``min_support`` of all labelled pages, ``min_bad`` bad pages whatever their share, more than ``min_confidence``
    (it blocks more bad pages than good ones) and ``min_lift`` over the share of bad pages among all. It
    must also be no chance find: the lower bound (Wilson) of its confidence lies above the share of bad
    pages, at an error of ``level`` divided by the number of token sets tried.

    All tokens of a URL take part. Tokens in fewer than ``min_bad`` pages can be in no rule and go
    first; tokens that are in exactly the same labelled pages have the same support in any set, so
    they are mined as one item and a rule asks for all of them. No labelled page: no rules.
    """
    known = pages.where("url is not null").select("page_id", "url").join(labels.where("bad is not null").select("page_id", "bad"), "page_id")
    known, _ = stash(known.distinct().withColumn("t", F.xxhash64("page_id", "url", "bad")), "labelled-urls")
    n, n_bad = known.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    held = known.select("t", F.explode(tokens(F.col("url"))).alias("w"))
    marks = [F.count(F.lit(1)).alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("t", F.lit(1))).alias("x")]
    words = held.groupBy("w").agg(*marks).where(F.col("n") >= min_bad)
    classes = words.groupBy("n", "s", "x").agg(F.array_sort(F.collect_list("w")).alias("members"))  # no more of them than one URL has
    classes = classes.select(F.element_at("members", 1).alias("item"), "members")
    # the items of a page are the classes whose first member it has
    own = held.join(classes.select(F.col("item").alias("w")), "w").groupBy("t").agg(F.collect_set("w").alias("own"))
    baskets = known.join(own, "t", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    baskets = baskets.select(F.when(F.col("bad"), F.array_union("own", F.array(F.lit(BAD)))).otherwise(F.col("own")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_bad / max(n, 1)))).fit(baskets)
    sets, _ = stash(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-token-sets")
    marked = F.array_contains("items", BAD)
    plain = sets.where(~marked)
    bad = sets.where(marked & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("bad"))
    z = NormalDist().inv_cdf(1 - level / max(plain.count(), 1))
    c, met, base = F.col("confidence"), F.col("freq"), n_bad / max(n, 1)
    lower = (c + z * z / (2 * met) - z * F.sqrt(c * (1 - c) / met + z * z / (4 * met * met))) / (1 + z * z / met)
    rules = plain.join(bad, "items").where(F.col("bad") >= min_bad).withColumn("confidence", F.col("bad") / met).withColumn("lift", c / max(base, 1 / max(n, 1)))
    rules = rules.where((c > min_confidence) & (F.col("lift") >= min_lift) & (lower > base))
    rules, _ = stash(rules.select("items", "confidence", "lift", (F.col("bad") / max(n, 1)).alias("support"), met.alias("met"), "bad"), "url-rules")
    # a longer rule is met with the shorter ones that it holds all items of; such pairs share the shorter one's first item
    short = rules.select(F.col("items").alias("s_items"), F.col("confidence").alias("s_conf"), F.col("met").alias("s_met"), F.col("bad").alias("s_bad"), F.element_at("items", 1).alias("first"))
    long = rules.where(F.size("items") > 1).select("items", "confidence", "met", "bad", F.explode("items").alias("first"))
    nested, _ = stash(long.join(short, "first").where((F.size("s_items") < F.size("items")) & (F.size(F.array_except("s_items", "items")) == 0)), "url-nested-rules")
    # the shorter one goes if its other pages are not mostly bad, then the longer one if a surer shorter one is left
    rest = (F.col("s_bad") - F.col("bad")) <= min_confidence * (F.col("s_met") - F.col("met"))
    loose = nested.where((F.col("confidence") > F.col("s_conf")) & rest).select("s_items").distinct()
    needless = nested.join(loose, "s_items", "left_anti").where(F.col("s_conf") >= F.col("confidence")).select("items").distinct()
    rules = rules.join(loose.withColumnRenamed("s_items", "items").unionAll(needless), "items", "left_anti").drop("met", "bad")
    single = plain.where(F.size("items") == 1).select(F.element_at("items", 1).alias("item"), "freq")
    rarest = rules.select("items", F.explode("items").alias("item")).join(single, "item").groupBy("items").agg(F.min_by("item", F.struct("freq", "item")).alias("anchor"))
    rules = rules.join(rarest, "items")
    whole = rules.select("items", F.explode("items").alias("item")).join(classes, "item").groupBy("items").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("all_items"))
    return rules.join(whole, "items").select(F.col("all_items").alias("items"), "confidence", "lift", "support", "anchor")


def held_out(pages: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """One row, ``n_rules, n_pages, n_bad, n_blocked, n_bad_blocked``: rules mined without one page in ``folds``, by a hash of its id, and judged on those pages."""
    away = F.crc32(F.col("page_id").cast("string")) % folds == 0
    rules, _ = stash(mine_rules(pages, labels.where(~away)), "held-out-rules")
    rows = pages.where("url is not null").select("page_id", "url").join(labels.where(away & F.col("bad").isNotNull()).select("page_id", "bad"), "page_id").distinct()
    rows = rows.join(match_rules(rows, rules), "url", "left")
    hit = F.col("mined").isNotNull()
    return rows.agg(F.lit(rules.count()).alias("n_rules"), F.count(F.lit(1)).alias("n_pages"), F.count_if("bad").alias("n_bad"), F.count_if(hit).alias("n_blocked"), F.count_if(hit & F.col("bad")).alias("n_bad_blocked"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, mined`` for each distinct URL that a rule fits; ``mined`` is struct(confidence, items) of the surest."""
    probes = urls.where("url is not null").select("url").distinct().withColumn("words", tokens(F.col("url")))
    index = rules.select("items", "confidence", "anchor")
    met = probes.select("url", "words", F.explode("words").alias("anchor")).join(index, "anchor")
    met = met.where(F.size(F.array_except("items", "words")) == 0)
    return met.groupBy("url").agg(F.max(F.struct("confidence", "items")).alias("mined"))


def judge(pages: DataFrame, rules: list[ListedRule], mined: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence, items`` for each row of ``pages``.

    A listed rule decides where one fits; else a page is blocked if a mined rule fits, else allowed.
    Null URLs, and those without ``://``, have an empty host and path and no listed rule. Equal URLs are
    judged alike, repeated rows each by itself; URLs of any length are read whole. An empty table
    gives no rows. Other columns of ``pages`` are left out, whatever their names.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).withColumn("hit", listed(F.col("host"), F.col("path"), rules))
    hits = match_rules(pages, mined)
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return own.join(hits, "url", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.col("mined.confidence").alias("confidence"), F.col("mined.items").alias("items"))
