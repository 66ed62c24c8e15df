"""Operators against brute force, and on odd rows."""

import datetime
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import bpe, licences, line_dedup, mixing, pseudonyms, quality_rules, queries, simhash, sketches, toxicity, url_filter
from strandloom.llm.common import Step, with_arrow

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(rows):
    return sorted(map(tuple, rows), key=str)


# quality rules


def plain_measures(text):
    text = text or ""
    words = BLANK.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_ledger_measures(documents, odd):
    docs = documents.unionByName(odd)
    rows = quality_rules.ledger(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(r.text)
        assert bool(r.fail_bits & 1) == (r.n_words < 50)
        assert bool(r.fail_bits & 2) == (100 * r.n_repeat_words > 50 * r.n_words)


def test_ledger_extra_columns_and_empty_table(nothing, odd):
    clash = odd.withColumn("n_words", F.lit("x")).withColumn("FAIL_BITS", F.lit("y"))
    rows = quality_rules.ledger(clash.drop("FAIL_BITS"))
    assert dict(rows.dtypes)["n_words"] == "bigint" and rows.count() == odd.count()
    assert quality_rules.ledger(nothing).count() == 0
    assert quality_rules.ablations(quality_rules.ledger(nothing)).count() == 0


def test_clean_prose_is_kept_and_junk_is_not(spark):
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()
    rng = random.Random(1)
    prose = ". ".join(" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(9)).capitalize() for _ in range(12))
    texts = [prose, prose.upper(), " | ".join(prose.split()), " ".join(w + "!!" for w in prose.split()), "same line of words here\n" * 30]
    rows = quality_rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kept = {r.doc_id for r in rows.where(~quality_rules.fails(quality_rules.POLICIES[-1])).collect()}
    assert kept == {0}


# near-duplicates


def plain_print(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in BLANK.findall(text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    prints_of = sorted(set(prints))
    root = {p: p for p in prints_of}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(prints_of, np.uint64)
    for i, p in enumerate(prints_of):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4):
            a, b = find(p), find(prints_of[i + 1 + j])
            root[max(a, b)] = min(a, b)
    least = {}
    for d, p in zip(ids, prints):
        r = find(p)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(p)) for p in prints]


@pytest.mark.parametrize(("max_bucket", "broadcast_rows"), [(4096, 200_000), (3, 200_000), (3, 0)])
def test_near_duplicates_equal_brute_force(documents, odd, monkeypatch, max_bucket, broadcast_rows):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast_rows)
    docs = documents.unionByName(odd)
    got = by_id(simhash.near_duplicates(docs, max_bucket=max_bucket).collect())
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in rows]
    comps = plain_components([r.doc_id for r in rows], prints)
    assert got == by_id((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, comps))


def test_links_of_a_dense_group(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(200)} | {rng.getrandbits(64) for _ in range(300)} | {0}
    signed = [(i, p - (p >> 63 << 64)) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = dict((r.fp & (1 << 64) - 1, r.component_id) for r in simhash.classes(df, max_bucket=50).collect())
    ids, ps = [i for i, _ in signed], sorted(prints)
    assert got == dict(zip(ps, plain_components(ids, ps)))


@pytest.mark.parametrize("m_cost", [0.0, 200.0, 1e9])
def test_plan_covers_every_pair(m_cost):
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    plan = simhash.choose_plan(sample, 10**6, probe_cost=m_cost)
    assert sorted(b for p in plan.parts for b in p) == list(range(64))
    assert sum(plan.limits) == 4 - len(plan.parts) + 1


def test_one_of_each(odd, nothing):
    kept = simhash.one_of_each(odd).collect()
    assert Counter(r.doc_id for r in kept) == {1: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 1}
    assert simhash.one_of_each(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


# line dedup


def plain_line_dedup(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 40:
                held[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (d is not None and len(held.get(key(x), ())) >= 5 and d != max(held[key(x)]))]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return by_id(out)


def test_line_dedup_equals_brute_force(spark, documents, odd, nothing):
    line = "a line of more than forty code points that several documents share"
    more = [(100 + i, f"own line {i}\n  {line.upper() if i % 2 else line}\t\n{line}\nend", "en", "z", None) for i in range(9)] + [(None, line, None, None, None)]
    docs = documents.unionByName(odd).unionByName(spark.createDataFrame(more, odd.schema))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = line_dedup.dedup_lines(docs, batches=5, fanout=2).select("doc_id", "kept", "n_lines", "n_dropped").collect()
    assert by_id(got) == plain_line_dedup(rows)
    assert sum(r.n_dropped for r in got) >= 16
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_runs_stay_few_and_disjoint(spark):
    keys = spark.range(2000).selectExpr("id % 300 as doc_id", "id % 90 as h1", "id % 7 as h2").distinct()
    runs = line_dedup.build_runs(keys, batches=7, fanout=2)
    assert all(len(level) <= 2 for level in runs.levels) and len(runs.levels) > 1
    held = [tuple(r) for run in runs.runs() for r in run.select("h1", "h2").collect()]
    assert len(held) == len(set(held)) == keys.select("h1", "h2").distinct().count()
    want = keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    assert by_id(runs.totals().collect()) == by_id(want.select("h1", "h2", "n_docs", "last_doc").collect())
    runs.close()


def test_a_batch_adds_its_new_keys_only(spark):
    runs = line_dedup.Runs(spark, 4)
    first = runs.add(spark.createDataFrame([(2, 1, 1), (2, 2, 2)], "doc_id long, h1 long, h2 long"))
    second = runs.add(spark.createDataFrame([(1, 2, 2), (1, 3, 3)], "doc_id long, h1 long, h2 long"))
    assert first.count() == 2 and [r.h1 for r in second.collect()] == [3]
    assert [tuple(r) for r in runs.repeats().collect()] == [(2, 2, 1, 1)]
    runs.close()


def test_runs_are_not_shuffled_again(spark):
    runs = line_dedup.Runs(spark, 4)
    runs.add(spark.range(100).selectExpr("id + 100 as doc_id", "id as h1", "id as h2"))
    run = runs.runs()[0]
    plan = spark.range(50).selectExpr("id as h1", "id as h2", "1 as n").groupBy("h1", "h2").count().join(run.hint("merge"), ["h1", "h2"], "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    runs.close()


def test_settled_keys_are_not_written_again(spark):
    runs = line_dedup.Runs(spark, 4, settled_at=2)
    runs.add(spark.createDataFrame([(8, 1, 1), (9, 1, 1), (9, 2, 2)], "doc_id long, h1 long, h2 long"))
    runs.add(spark.createDataFrame([(5, 1, 1), (5, 2, 2), (5, 3, 3), (5, 4, 4)], "doc_id long, h1 long, h2 long"))
    assert [r.h1 for r in runs.repeats().collect()] == [2] and sorted(r.h1 for r in runs.runs()[1].collect()) == [3, 4]
    assert sorted((r.h1, r.last_doc) for r in runs.totals(2).collect()) == [(1, 9), (2, 9)]
    runs.close()


# byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(documents, odd, nothing, reference):
    docs = documents.unionByName(odd)
    for r in bpe.decode(bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN), queries.RANKS, public_tokenizers.PATTERN).collect():
        assert r.ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(nothing, queries.RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_long_and_random_pieces(reference):
    v = bpe.Vocabulary(bpe.read_ranks(queries.RANKS), public_tokenizers.PATTERN)
    rng = random.Random(4)
    pieces = ["a" * 5000, "ab" * 3000, "é" * 400, "".join(rng.choice("aetionshé") for _ in range(20_000)), "\u4e00\u4e01" * 50]
    pieces += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for p in pieces:
        assert bpe.merge(p.encode(), v.ranks) == reference.encode_ordinary(p)


# mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.remove(s)
            left -= target[s]
    return target


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_mix_meets_its_targets(request, which):
    docs = request.getfixturevalue(which)
    planned = mixing.plan_mix(docs)
    rows = planned.collect()
    assert len(rows) == docs.count()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        assert r.size == len(BLANK.findall(r.text or "")) and 0 <= r.copies <= 2 and len(r.shards) == r.copies
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-5)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-5
    assert by_id((r.doc_id, r.copies, tuple(r.shards)) for r in rows) == by_id((r.doc_id, r.copies, tuple(r.shards)) for r in mixing.plan_mix(docs.repartition(3)).collect())
    assert Counter(r.doc_id for r in mixing.mixed(planned).collect()) == Counter(r.doc_id for r in rows for _ in range(r.copies))


def test_quotas_split_exactly(spark):
    quotas = {0: 1000, 1: 0, 2: 37, 3: 1, 4: 250_000}
    rows = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "idx long, quota long"), 8).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        assert r.blocks >= 0
        by_source[r.idx] += r.blocks
        by_shard[r.shard] += r.blocks
    assert by_source == quotas and len(by_shard) == 8 and max(by_shard.values()) - min(by_shard.values()) <= 3
    share = [r.blocks for r in rows if r.idx == 0]
    assert max(share) < 200 and len(set(share)) > 1


def test_splits_follow_the_hypergeometric_law(spark):
    from math import comb

    draws = [mixing.split_quotas(spark.createDataFrame([(0, 4), (1, 8)], "idx long, quota long"), 2, f"s{k}") for k in range(60)]
    df = draws[0]
    for d in draws[1:]:
        df = df.unionAll(d)
    seen = Counter(r.blocks for r in df.where("shard = 0 and idx = 0").collect())
    mean = sum(k * n for k, n in seen.items()) / 60
    assert abs(mean - 2) < 0.5 and set(seen) <= set(range(5)) and seen[2] > 60 * comb(4, 2) * comb(8, 4) / comb(12, 6) / 2


def test_mix_of_nothing(nothing):
    assert mixing.plan_mix(nothing).count() == 0


# sketches


def test_neighbours_and_edits(documents, odd):
    docs = documents.unionByName(odd.where("doc_id is null or doc_id > 4").withColumn("doc_id", F.col("doc_id") + 10**6))
    rows = [(r.doc_id, r.text or "") for r in docs.where("doc_id is not null").select("doc_id", "text").collect()]
    rows.sort(reverse=True)
    got = {r.doc_id: r for r in sketches.compare_with_edits(docs.where("doc_id is not null"), buckets=7).collect()}
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        assert got[d].edited == edited and got[d].n_chars == len(t)
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        if t == after:
            assert got[d].near_next == 1 and got[d].near_edited >= 0
        if k == 0:
            assert got[d].near_edited == 1


def test_sketch_estimates(spark):
    rng = random.Random(5)
    a = [f"w{rng.randint(0, 10**9)}" for _ in range(4000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(a[:2000] + ["zz"] + a[3000:]), " ".join(a[:400]))], "a string, b string, c string")
    for x in "abc":
        df = df.withColumn(f"s{x}", sketches.sketch(F.col(x)))
    r = df.select(sketches.likeness("sa", "sb").alias("j"), sketches.containment("sc", "sa").alias("c"), F.size("sa").alias("n")).first()
    assert abs(r.j - 0.75) < 0.06 and r.c == 1 and abs(r.n - 1000) < 120


def test_sketches_of_odd_rows(odd, nothing):
    rows = sketches.compare_with_edits(odd, buckets=3).collect()
    assert len(rows) == odd.count()
    assert sketches.compare_with_edits(nothing).count() == 0
    merged = sketches.merge_sketches(odd.select("source", sketches.sketch(F.col("text")).alias("sketch")), ["source"])
    assert merged.where("source = 'c'").count() == 1


# pseudonyms


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


CASES = {
    "card": ["4111111111111111", "5500-0000-0000-0004", "3400 0000 0000 009", "378282246310005"],
    "date": ["1985-02-28", "2000-02-29", "1900-01-01", "2024-12-31"],
    "ssn": ["123-45-6789", "665-01-0001", "667-99-9999"],
    "ip": ["192.168.0.1", "8.8.8.8"],
    "phone": ["+1 (212) 555-7713", "(017) 555-3436", "212-555-0199"],
}


def test_pseudonyms_keep_their_format(spark):
    values = [(k, v) for k, vs in CASES.items() for v in vs]
    text = "start " + " and ".join(v for _, v in values) + ", 4111111111111112 1985-02-30 999.1.1.1 000-12-3456 end mail joe.bloggs@mail1.example.com."
    df = spark.createDataFrame([(1, text), (2, "again 4111111111111111"), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(df, "k").collect()}
    found = [(f.kind, f.value, f.pseudonym) for f in out[1].found if f.kind]
    assert [(k, v) for k, v, _ in found if k != "email"] == values
    for kind, old, new in found:
        if kind == "email":
            assert new.endswith("@mail1.example.com") and "joe" not in new
            continue
        assert new != old and re.sub(r"\d+", "", new) == re.sub(r"\d+", "", old)
        assert kind == "ip" or len(new) == len(old)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new)) and new[0] == old[0]
        if kind == "date":
            assert datetime.date.fromisoformat(new).year // 1 and (int(new[:4]) - 1) // 100 == (int(old[:4]) - 1) // 100
        if kind == "ip":
            assert all(0 <= int(o) < 256 for o in new.split("."))
        if kind == "ssn":
            assert new[:3] not in ("000", "666") and new[0] != "9" and new[4:6] != "00" and new[7:] != "0000"
    assert "4111111111111112 1985-02-30 999.1.1.1 000-12-3456 end" in out[1].safe_text
    assert out[2].found[0].pseudonym == found[0][2] and out[2].safe_text == "again " + found[0][2]
    assert out[3].safe_text is None and out[3].n_replaced == 0 and out[4].safe_text == ""
    back = pseudonyms.pseudonymise(spark.createDataFrame([(1, out[1].safe_text)], "doc_id long, text string"), "k", back=True).first()
    assert back.safe_text[: text.index(" end mail")] == text[: text.index(" end mail")]


def test_dates_of_a_century_are_permuted(spark):
    df = spark.sql("select date_format(date_add(date'1901-01-01', cast(id as int)), 'yyyy-MM-dd') as text, id as doc_id from range(36525)")
    out = pseudonyms.pseudonymise(df, "k").agg(F.countDistinct("safe_text").alias("n"), F.min("safe_text").alias("a"), F.max("safe_text").alias("b")).first()
    assert tuple(out) == (36525, "1901-01-01", "2000-12-31")


def test_pseudonyms_of_odd_rows(odd, nothing, documents):
    assert by_id(pseudonyms.pseudonymise(odd, "k").select("doc_id", "safe_text").collect()) == by_id(odd.select("doc_id", "text").collect())
    assert pseudonyms.pseudonymise(nothing, "k").count() == 0
    rows = pseudonyms.pseudonymise(documents, "k").collect()
    for r in rows:
        for f in r.found:
            if f.kind and f.kind not in ("date",):
                assert f.value not in re.split(r"[\s,]+", r.safe_text)


# toxicity


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(6)
    bad = ["vile", "rotten"]

    def doc(toxic):
        lines = [" ".join(f"w{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 9))}" for _ in range(8)) for _ in range(6)]
        if toxic:
            k = rng.randrange(6)
            lines[k] += " " + rng.choice(bad)
        return ". ".join(lines)

    rows = [(i, doc(i % 4 == 0), int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 600"))
    out = toxicity.score(df.where("doc_id >= 600"), model).collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in out) >= 0.98 * len(out)
    for r in out:
        for s in r.toxic_spans:
            assert any(b in r.text[s.begin : s.end] for b in bad)


def test_toxicity_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.9 * len(rows)


def test_toxicity_of_odd_rows(odd, nothing, spark):
    model = toxicity.fit(nothing.withColumn("toxic", F.lit(1)))
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(nothing, model).count() == 0


# URL filters


def test_urls_and_listed_rules(spark, nothing):
    cases = [
        (1, "http://A.Example.COM/en/825?x", "a.example.com", "/en/825", "com/en/", "block"),
        (2, "http://example.com/en/7", "example.com", "/en/7", "example.com/en/7", "allow"),
        (3, "https://m.example.net/de/8#t", "m.example.net", "/de/8", "example.net/de/8", "block"),
        (4, "https://other.net/de/8", "other.net", "/de/8", "net/de/", "allow"),
        (5, "example.com/en/7", "", "", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "x://", "", "", None, "allow"),
        (8, "a://b://c/d", "b:", "//c/d", None, "allow"),
        (9, "http://xcom/en/", "xcom", "/en/", None, "allow"),
        (9, "http://xcom/en/", "xcom", "/en/", None, "allow"),
    ]
    pages = spark.createDataFrame([c[:2] for c in cases], "page_id long, url string")
    none = url_filter.mine_rules(pages.limit(0), pages.limit(0).select("page_id", F.lit(True).alias("bad")))
    got = url_filter.judge(pages, queries.URL_RULES, none)
    assert by_id(got.select("page_id", "host", "path", "rule", "verdict").collect()) == by_id((c[0], *c[2:]) for c in cases)


def test_mined_rules_block(spark):
    rows = [(i, f"http://h{i % 7}.example.org/{'cheap/pills' if i % 5 == 0 else 'cheap/shoes' if i % 5 == 1 else 'news'}/{i}", i % 5 == 0) for i in range(300)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 200], "page_id long, bad boolean")
    rules = url_filter.mine_rules(pages, labels, min_support=0.05)
    assert [r["items"] for r in rules.collect()] == [["pills"]]
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, [], rules).collect()}
    assert got == {r[0]: "block" if r[2] else "allow" for r in rows}


# licences


def test_licences(spark, nothing, odd):
    bsd = "Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.\n\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    swapped = "\n\n".join(reversed(bsd.split("\n\n")))
    texts = ["Prose. Released under the MIT License. More", "x\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", bsd, swapped, "the license of the mit"]
    rows = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0].licences == ["MIT"] and texts[0][rows[0].hits[0].begin : rows[0].hits[0].end] == "Released under the MIT License."
    assert rows[1].licences == ["CC-BY-NC-4.0"] and len(rows[1].hits) == 2
    assert rows[2].licences == ["BSD-2-Clause"] and rows[3].licences == [] and rows[4].licences == []
    assert licences.scan(nothing).count() == 0
    assert licences.scan(odd).where("size(licences) > 0").count() == 0


def test_every_licence_rule_matches_its_text(spark):
    import textwrap

    wrap = lambda text, sign: "\n".join(sign + x for p in text.split("\n") for x in textwrap.wrap(p, 50, break_on_hyphens=False))
    texts = []
    for name, ids in licences.RULES:
        whole = "\n".join(licences.SENTENCES[i] + "." for i in ids)
        texts += [(name, whole), *((name, wrap(whole, sign)) for sign in ("", " * ", "# ", "// "))]
    gpl = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope"
    mpl = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/."
    apache = "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by law"
    texts += [("GPL-3.0", gpl), ("MPL-2.0", mpl), ("Apache-2.0", apache)]
    near = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "This program is free software: use it. Either version 3 of the License"]
    rows = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate([t for _, t in texts] + near)), "doc_id long, text string")).collect()}
    assert [(n, t) for k, (n, t) in enumerate(texts) if n not in rows[k].licences] == []
    assert all(rows[len(texts) + k].licences == [] for k in range(len(near)))


# columns


def test_made_columns_replace_given_ones(odd):
    rows = with_arrow(odd.withColumn("Fp", F.lit("x")), Step(("text",), (T.StructField("fp", T.LongType()),), lambda x: [pa.nulls(len(x), pa.int64())]))
    assert rows.columns == [*odd.columns, "fp"]


def test_digest_of_ids(documents, reference):
    for r in queries.bpe_digests(documents.select("doc_id", "text"), ["doc_id", "text"]).collect():
        ids = np.array(reference.encode_ordinary(r.text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
