"""Cases that caps, switches or column names used to get wrong, and the pipeline stage by stage."""

import base64
import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandloom.llm import bpe, licences, line_dedup, mixing, pseudonyms, quality_rules, queries, simhash, sketches, toxicity, url_filter
from test_text_operators import BLANK, by_id, plain_line_dedup, plain_measures, plain_targets


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_bpe_memory_changes_no_ids():
    with open(queries.RANKS, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["one two three onetwothree", None, "", "zzxqj " * 9 + "x" * 99, "three zzxqj İ 一丁", "one"] * 3
    v = bpe.Vocabulary(raw, public_tokenizers.PATTERN, remembered=3)
    for k in range(0, len(texts), 2):
        got = [np.frombuffer(x, "<u4").tolist() for x in v.encode(texts[k : k + 2])]
        assert got == [known.encode_ordinary(t or "") for t in texts[k : k + 2]]
    assert len(v.young) <= 3 + 10


def test_all_tokens_of_a_long_url_teach(spark):
    path = "/".join(f"part{chr(97 + i)}" for i in range(18))
    rows = [(i, f"http://h.org/{path}/{'wicked' if i % 4 == 0 else 'fine'}/x{i}", i % 4 == 0) for i in range(200)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    rules = url_filter.mine_rules(pages, spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, bad boolean"), min_support=0.05)
    assert [r["items"] for r in rules.collect()] == [["wicked"]]
    few = url_filter.mine_rules(pages.where("page_id < 13"), spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, bad boolean"), min_support=0.05)
    assert few.count() == 0  # four bad pages are too few
    extra = pages.withColumn("mined", F.lit(1)).withColumn("WORDS", F.lit(1)).withColumn("hit", F.lit(2))
    assert url_filter.judge(extra, [], rules).where("verdict = 'block'").count() == 50
    assert url_filter.judge(pages.limit(0), queries.URL_RULES, rules).count() == 0
    assert url_filter.judge(pages.selectExpr("page_id", "concat(url, repeat('/wicked', 5000)) as url"), [], rules).where("verdict = 'block'").count() == 200


def test_short_texts_have_pure_sketches(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 5]), " ".join(words)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string").withColumn("sa", sketches.sketch(F.col("a"))).withColumn("sb", sketches.sketch(F.col("b")))
    got = df.select("sa", sketches.containment("sa", "sb").alias("c")).collect()
    assert {r.c for r in got} == {None, 1.0} and all((r.c is None) == (len(r.sa) == 0) for r in got)
    union = sketches.merge_sketches(df.select(F.lit(1).alias("g"), F.col("sa").alias("sketch")), ["g"]).first()["sketch"]
    assert set(union) == {h for r in got for h in r.sa}


def test_neighbours_equal_brute_force(spark, documents, odd):
    docs = documents.limit(60).unionByName(odd).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.withColumn("doc_id", F.lit(4).cast("long")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie), reverse=True)
    texts = [r.text for r in rows]
    got = sketches.compare_with_edits(docs, buckets=9).collect()
    want = []
    for r, after in zip(rows, texts[1:] + texts[:1]):
        k = len(r.text) // 3
        want.append((r.doc_id, r.text[: len(r.text) - k] + after[:k], after))
    assert by_id((r.doc_id, r.edited) for r in got) == by_id(w[:2] for w in want)
    texts = sorted({t for w in want for t in w[1:]} | set(texts))
    own = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("s", sketches.sketch_and_digest(F.col("text"))).collect()
    of = {r.text: (set(r.s.sketch), r.s.digest) for r in own}

    def likeness(a, b):
        (x, dx), (y, dy) = of[a], of[b]
        return 1.0 if dx == dy else len(x & y) / len(x | y) if x | y else 0.0

    near = by_id((r.doc_id, r.n_chars, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    assert near == by_id((w[0], len(r.text), round(likeness(r.text, w[1]), 9), round(likeness(r.text, w[2]), 9)) for r, w in zip(rows, want))


def test_a_letter_that_grows_changes_no_score(spark):
    model = toxicity.Model(-6.0, {"=vile": 12.0})
    rows = toxicity.score(spark.createDataFrame([(1, "VILE thing here"), (2, "VILE thing here İ"), (3, ""), (4, None)], "doc_id long, text string"), model).collect()
    scores = {r.doc_id: r.score for r in rows}
    assert scores[1] == pytest.approx(scores[2]) and scores[1] > 0.9 and scores[3] == scores[4] == 0
    assert all(r.text[s.begin : s.end].startswith("VILE") for r in rows for s in r.toxic_spans)


def test_toxicity_catches_and_spares(spark, sf):
    rows = queries.op5_toxicity(spark, sf.replace("sf0.001", "sf0.1")).join(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    caught = [r.predicted for r in rows if r.toxic]
    spared = [r.predicted for r in rows if not r.toxic]
    assert sum(caught) >= 0.7 * len(caught) and sum(spared) <= 0.03 * len(spared)


def test_training_texts_are_bounded_before_they_move(spark):
    rows = [(i, "bad word" if i % 2 else "good word", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.fit(df, max_chars=0).weights == {}
    a, b = toxicity.fit(df), toxicity.fit(df.unionAll(df))
    assert a.weights == b.weights and "=bad" in a.weights


def test_long_secrets_names_and_odd_addresses(spark):
    secret, name = hashlib.sha512(b"x").hexdigest(), "n" * 90
    text = f"key {secret} KEY {secret.upper()} mail {name}@example.org ip 192.168.001.001 and 192.168.1.1 and {'a' * 40}"
    r = pseudonyms.pseudonymise(one(spark, text).withColumn("_hits", F.lit(1)).withColumn("Found", F.lit(1)), "k").first()
    assert secret not in r.safe_text and secret.upper() not in r.safe_text and name not in r.safe_text
    new = r.safe_text.split()
    assert len(new[1]) == 128 and new[1].upper() == new[3] and new[1][:64] != new[1][64:]
    assert "192.168.001.001" in r.safe_text and " 192.168.1.1 " not in r.safe_text and "a" * 40 in r.safe_text


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """ * Redistributions of source code must retain the above copyright
 * notice, this list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright
 * notice, this list of conditions and the following disclaimer in the
 * documentation and/or other materials provided with the distribution."""
ENDORSE = """
 * Neither the name of the copyright holder nor the names of its
 * contributors may be used to endorse or promote products derived from
 * this software without specific prior written permission."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under" + " " * 2000 + "the MIT License.", ["MIT"]),
        ("The above copyright notice and this permission notice" + " " * 2000 + "shall be included in all copies or substantial portions of the Software.", ["MIT"]),
        (MIT, ["MIT"]),
        (BSD, ["BSD-2-Clause"]),
        ("Copyright (c) X.\nAll rights reserved.\n\n" + BSD + ENDORSE, ["BSD-3-Clause"]),
        ("All rights reserved.", ["Proprietary"]),
        ("Redistributions of source code " * 5000, []),
    ],
)
def test_licence_layouts(spark, text, want):
    rows = one(spark, text).withColumn("HITS", F.lit(1)).withColumn("licences", F.lit("x"))
    assert licences.scan(rows).first()["licences"] == want


NAMES = ("start rest passes homes rank drawn idx words source_size given stay n fp print id _id shard _copy _order _part _skey _key _block _doc _drop _spread kept component_id "
         "fingerprint own part block c d a b src dst sig node component u v m h1 h2 last_doc n_docs seen most held0").split()  # fmt: skip


@pytest.mark.parametrize("case", [str.lower, str.upper])
def test_any_column_name_passes(odd, case):
    extra = odd
    for name in NAMES:
        extra = extra.withColumn(case(name), F.lit("x"))
    planned = mixing.plan_mix(extra)
    assert planned.count() == odd.count() and {case(n) for n in ("start", "rest", "given", "homes")} <= set(planned.columns)
    assert mixing.mixed(planned).count() == planned.agg(F.sum("copies")).first()[0]
    assert simhash.one_of_each(extra).columns == extra.columns and simhash.one_of_each(extra).count() == simhash.one_of_each(odd).count()
    assert simhash.near_duplicates(extra).count() == odd.count()
    lines = line_dedup.dedup_lines(extra)
    assert lines.count() == odd.count() and case("_drop") in lines.columns
    assert quality_rules.ledger(extra).count() == odd.count()
    assert toxicity.score(extra, toxicity.Model(-6.0, {})).count() == odd.count()
    assert bpe.encode(extra, queries.RANKS, public_tokenizers.PATTERN).count() == odd.count()
    assert sketches.compare_with_edits(extra).count() == odd.count() and licences.scan(extra).count() == odd.count()
    assert pseudonyms.pseudonymise(extra, "k").count() == odd.count()


def shingled(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in BLANK.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_wide(text):
    return simhash.prints_of((text or "").encode(), corpus_pipeline.NEAR_SHINGLE, simhash.WIDE)


def test_near_copies_of_the_stage(spark):
    rng = np.random.default_rng(8)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 300)) for _ in range(40)]

    def changed(text, k):
        words = text.split()
        for at in rng.choice(len(words), k, replace=False):
            words[at] = "other"
        return " ".join(words)

    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, changed(t, 3)) for i, t in enumerate(base)]  # about 0.9 of the shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert set(range(40)) <= kept and len(kept) <= 43


def test_pipeline_equals_plain_python(spark, sf, odd):
    """Each stage, on all that its predecessor kept and on odd rows, against the same rules in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10**6))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf)
    rows = [r for r in docs.collect()]
    keep = []
    for r in rows:
        n, chars, symbols, dup, again = plain_measures(r.text)
        t = r.text or ""
        up, low = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
        n_lines = sum(bool(BLANK.search(x)) for x in t.split("\n"))
        bad = n < 50 or 100 * again > 50 * n or 100 * symbols > 30 * n or (n_lines >= 4 and 100 * dup > 50 * n_lines)
        bad = bad or (up + low >= 100 and up > low) or 100 * t.count("!") > 30 * n or (n and not 2 * n <= chars <= 20 * n)
        keep += [] if bad else [r]
    assert by_id(good.collect()) == by_id(keep)
    assert good.columns == docs.columns
    lined = stages["line dedup"](spark, good, sf)
    plain = plain_line_dedup([(r.doc_id, r.text) for r in keep])
    assert by_id((r.doc_id, r.text) for r in lined.collect()) == by_id(p[:2] for p in plain)
    near = stages["near duplicates"](spark, lined, sf)
    own = lined.collect()
    ids = [r.doc_id for r in own]
    of = {r.doc_id: np.array(plain_wide(r.text), np.uint64) for r in own}
    loose = corpus_pipeline.NEAR_SIMILARITY - simhash.SLACK
    limit = int(256 * np.arccos(2 * loose / (1 + loose)) / np.pi)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            apart = np.bitwise_count(of[i] ^ of[j])
            if apart[: corpus_pipeline.NEAR_WORDS64].min() <= corpus_pipeline.NEAR_RADIUS and apart.sum() <= limit or apart[0] == 0:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    # the candidates' groups, held to the similarity of their sets
    group, sets = {i: find(i) for i in ids}, {r.doc_id: shingled(r.text) for r in own}
    root = {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if group[i] == group[j] and len(sets[i] & sets[j]) >= corpus_pipeline.NEAR_SIMILARITY * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in near.collect()}
    assert kept == {find(i) for i in ids} and near.columns == docs.columns
    twins = Counter(r.text for r in own)
    assert all(sum(1 for r in near.collect() if r.text == t) == 1 for t in list({t for t, n in twins.items() if n > 1})[:3])
    mix = stages["source mixing"](spark, near, sf)
    sizes, taken = Counter(), Counter()
    for r in near.collect():
        sizes[r.source] += len(BLANK.findall(r.text or ""))
    for r in mix.collect():
        taken[r.source] += len(BLANK.findall(r.text or ""))
    want, most = plain_targets(sizes), max(len(BLANK.findall(r.text or "")) for r in near.collect())
    assert all(abs(taken[s] - want[s]) <= most / 2 + 1 for s in sizes)
    out = stages["tokens"](spark, mix, sf)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in mix.collect())
    digest = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in mix.collect()}
    assert all(r.decoded_sha256 == digest[r.doc_id] for r in out.collect())
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        whole = stage(spark, whole, sf)
    assert by_id(corpus_pipeline.run(spark, sf).collect()) == by_id(whole.collect())


def test_stages_of_odd_and_no_rows(spark, odd, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0
        assert stage(spark, odd, "").count() <= 2 * odd.count()
