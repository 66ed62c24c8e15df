"""Mined URL rules through the query itself, against all token sets tried one by one, and on held-out pages."""

import itertools
import math
import random
import re
import zlib
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from strandloom.llm import queries, url_filter


def planted(n=600, seed=5):
    """Pages of which those with both ``cheap`` and ``pills`` are mostly bad, and one in ten of the others."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["news", "blog", "shop"]), rng.choice(["cheap", "dear"]), rng.choice(["pills", "shoes", "books"])]
        bad = rng.random() < (0.9 if words[1:] == ["cheap", "pills"] else 0.1)
        rows.append((i, f"https://h{i % 3}.example.edu/{'/'.join(words)}/{i}", bad))
    return rows


def tokens(url):
    return {w for w in re.split(r"[^a-z0-9]+", re.sub(r"=[^&#]*", "", url.lower())) if w and not w.isdigit()}


def by_hand(rows, min_support=0.002, min_confidence=0.5, min_lift=1.5, min_bad=5, level=0.05):
    """Token sets that pass, by counting every set of token classes of every page."""
    n, base = len(rows), sum(r[2] for r in rows) / len(rows)
    where = {}
    for i, url, _ in rows:
        for w in tokens(url):
            where.setdefault(w, set()).add(i)
    classes = {}
    for w, at in where.items():
        if len(at) >= min_bad:
            classes.setdefault(frozenset(at), []).append(w)
    lead = {min(ws): frozenset(ws) for ws in classes.values()}
    met, spoilt = {}, {}
    for _, url, bad in rows:
        own = sorted(tokens(url) & set(lead))
        for k in range(1, len(own) + 1):
            for s in itertools.combinations(own, k):
                met[s] = met.get(s, 0) + 1
                spoilt[s] = spoilt.get(s, 0) + bad
    least = max(min_support * n, min_bad)
    tried = {s for s, m in met.items() if m >= least}
    z = NormalDist().inv_cdf(1 - level / len(tried))
    out = []
    for s in tried:
        m, b = met[s], spoilt[s]
        c = b / m
        low = (c + z * z / (2 * m) - z * math.sqrt(c * (1 - c) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        if b >= least and c > min_confidence and c / base >= min_lift and low > base:
            out.append((frozenset(s), m, b))
    loose = [x for x, m, b in out if any(x < y and b2 / m2 > b / m and b - b2 <= min_confidence * (m - m2) for y, m2, b2 in out)]
    return [frozenset().union(*(lead[w] for w in x)) for x, _, _ in out if x not in loose]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("urls"))
    rows = planted()
    pages = rows + [(i + 10_000, url, None) for i, url, _ in planted(200, 6)] + [(-1, None, None), (-2, "", None), (-3, rows[0][1], None), (-3, rows[0][1], None)]
    spark.createDataFrame([(i, u, "<p>") for i, u, _ in pages], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, 0 if bad else 1, 0) for i, _, bad in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, pages


def test_the_query_blocks_by_mined_rules(spark, folder):
    path, rows, pages = folder
    rules = by_hand(rows)
    assert frozenset({"cheap", "pills"}) in rules
    got = sorted((r.page_id, r.rule, r.verdict) for r in queries.op1_url_filter(spark, path).select("page_id", "rule", "verdict").collect())
    want = sorted((i, None, "block" if any(s <= tokens(u or "") for s in rules) else "allow") for i, u, _ in pages)
    assert got == want
    assert 50 < sum(v == "block" for _, _, v in got) < 250


def test_rules_on_held_out_pages(spark, folder):
    path, rows, _ = folder
    pages = spark.read.parquet(f"{path}/pages.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    r = url_filter.held_out(pages, labels).first()
    away = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    rules = by_hand([x for x in rows if x not in away])
    hit = [x[2] for x in away if any(s <= tokens(x[1]) for s in rules)]
    assert r.n_rules >= 1 and (r.n_pages, r.n_bad, r.n_blocked, r.n_bad_blocked) == (len(away), sum(x[2] for x in away), len(hit), sum(hit))
    assert r.n_blocked > 0 and r.n_bad_blocked / r.n_blocked > 3 * r.n_bad / r.n_pages  # against the share of bad pages among all


def test_labels_that_urls_do_not_tell_give_no_rule(spark):
    rng = random.Random(9)
    rows = [(i, u, rng.random() < 0.15) for i, u, _ in planted(1000, 7)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, bad boolean")
    assert by_hand(rows) == []
    assert url_filter.mine_rules(pages, labels).count() == 0


def test_all_pages_bad_and_null_labels(spark):
    pages = spark.createDataFrame([(i, f"http://a.edu/x{i % 2}") for i in range(50)] + [(60, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, True) for i in range(50)] + [(60, True), (1, None)], "page_id long, bad boolean")
    assert url_filter.mine_rules(pages, labels).count() == 0  # nothing is worse than the rest
    assert url_filter.mine_rules(pages, labels.where("bad is null")).count() == 0
