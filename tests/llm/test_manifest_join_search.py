"""The Merkle manifest, the n-gram join and ranked search against plain Python, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import merkle, ngram_join, queries, ranked_search

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row."""
    by = {}
    for r in rows:
        leaf = h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))
        bad = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        by.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf, h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars + 1, r.text))) if bad else leaf))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([leaf for *_, leaf, _ in sorted(by[x])]) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for t, x in enumerate(langs):
        for i, (known, doc, leaf, now) in enumerate(sorted(by[x])):
            proof = []
            for at, tree in ((i, trees[x]), (t, top)):
                for nodes in tree[:-1]:
                    other = nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
                    now, at = (h(other, now) if at & 1 else h(now, other)), at >> 1
                    proof.append(other)
            out.append((doc if known else None, leaf, trees[x][-1][0], top[-1][0], h(*proof), now, now == top[-1][0]))
    return sorted(out, key=str)


def as_query(docs, step):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = fields[:3] + [F.col("n_chars") + 1] + fields[4:]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_of(*more))
    made = merkle.build(docs.select("doc_id", "lang", merkle.leaf_of(*fields).alias("leaf"), tampered.alias("tampered")), step=step)
    rows = merkle.proofs(made).withColumn("folded", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return made, rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded", F.col("folded") == F.col("root"))


@pytest.mark.parametrize("step", [1, 2, 6])
def test_proofs_of_all_steps_equal_a_plain_tree(spark, documents, odd, step):
    docs = documents.unionByName(odd)
    made, rows = as_query(docs, step)
    assert sorted(map(tuple, rows.collect()), key=str) == plain_manifest(docs.collect())
    leaves = made.leaves.count()
    assert sum(x.count() for x in made.levels[1:]) <= leaves / (2**step - 1) + 8 * len(made.levels)


def test_manifest_of_one_row_and_of_none(spark, nothing):
    made, rows = as_query(nothing, 6)
    assert rows.count() == 0 and made.root.count() == 0
    one = spark.createDataFrame([(7, "x", "en", None, 1)], nothing.schema)
    made, rows = as_query(one, 6)
    assert sorted(map(tuple, rows.collect()), key=str) == plain_manifest(one.collect())


def test_manifest_replaces_columns_of_its_own_names(spark, odd):
    docs = odd.select("doc_id", "lang", merkle.leaf_of(F.col("text")).alias("leaf"), F.lit("x").alias("tree"), F.lit("y").alias("pos"), F.lit("z").alias("other"))
    rows = merkle.proofs(merkle.build(docs))
    assert dict(rows.dtypes)["pos"] == "bigint" and rows.where("other = 'z'").count() == odd.count()


# n-gram join


def shingles(text):
    words = [w.translate(LOWER) for w in BLANK.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(k)] = min(r.doc_id, least.get(find(k), r.doc_id))
    return sorted(((r.doc_id, len(s), least.get(find(k)) if s else r.doc_id) for k, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(rng, n_groups=6, copies=8):
    """Groups of copies with a few edits each, all round the threshold, that share a passage with other documents."""
    passage, out = [f"p{k}" for k in range(60)], []
    for g in range(n_groups):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(5, 220))] + passage * (g % 2)
        for _ in range(copies):
            new = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 30)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(new if rng.random() < 0.9 else [w.upper() for w in new]))
    return out + [" ".join(passage + [f"u{k}z{i}" for i in range(rng.randrange(3, 90))]) for k in range(12)]


@pytest.mark.parametrize("chunk", [500_000, 300])
def test_components_of_the_join(spark, odd, chunk):
    texts = edited(random.Random(5))
    extra = spark.createDataFrame([(100 + i, t, "en", "a", len(t)) for i, t in enumerate(texts)], odd.schema)
    docs = odd.unionByName(extra)
    got = ngram_join.jaccard_components(docs.withColumn("n", F.lit("x")).withColumn("NODE", F.lit("y")), chunk=chunk)
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(docs.collect())


def test_components_of_documents_and_of_nothing(spark, documents, nothing):
    got = ngram_join.jaccard_components(documents)
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(documents.collect())
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_links_given_are_links(spark, odd):
    docs = spark.createDataFrame(list(enumerate(edited(random.Random(9)))), "doc_id long, text string")
    members, _, links = ngram_join.similar_classes(docs, chunk=400)
    sets = {r.node: shingles(r.text) for r in members.join(docs, "doc_id").collect()}
    rows = links.collect()
    assert rows and all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in rows)


def test_search_of_the_index_finds_every_link():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 5000, n).astype(np.uint64)) for n in rng.integers(1, 120, 40)]
    sets = base + [np.unique(np.concatenate([s[rng.random(len(s)) < 0.93], rng.integers(0, 5000, 3).astype(np.uint64)])) for s in base for _ in range(4)]
    index = ngram_join.Index(sets)
    for s in sets:
        want = {k for k, x in enumerate(sets) if 9 * len(np.intersect1d(s, x)) >= 4 * (len(s) + len(x))}
        assert set(index.search(s)) == want


def test_shingle_sets_of_slices_and_blanks():
    texts = pa.array([None, "", " \t\n", "one", "A b C d", "a b c d e f a b c d e", "x y \x0b z " * 9])
    for at in range(len(texts)):
        sets = ngram_join.shingle_sets(texts.slice(at))
        assert [len(s) for s in sets] == [len(shingles(t)) for t in texts.slice(at).to_pylist()]
    assert np.array_equal(*ngram_join.shingle_sets(pa.array(["A b C d", " a\tB c d\n"])))


# ranked search


def terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_rank(docs, items, k=20):
    counts = [(r.doc_id, Counter(terms(r.text))) for r in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item in items:
        scored = []
        for doc, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(item.text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item.item_id, n + 1, None if unknown else doc, -score) for n, (score, unknown, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("docs_a_shard", "whole"), [(4096, 256), (7, 2)])
def test_ranks_equal_plain_scores(spark, sf, documents, odd, monkeypatch, docs_a_shard, whole):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(ranked_search.search, "__defaults__", (whole,))
    docs = documents.unionByName(odd)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").limit(9).select("item_id", "text")
    items = items.unionByName(spark.createDataFrame([(900, None), (901, "!?"), (902, "FOX fox dog été"), (None, "quick brown word3 word4"), (903, "nosuchterm")], items.schema))
    index = ranked_search.build_index(docs.withColumn("ids", F.lit("x")))
    got = ranked_search.rank(index, items.withColumn("rank", F.lit("x")), round_bytes=600)
    assert sorted(map(tuple, got.collect()), key=str) == plain_rank(docs.collect(), items.collect())


def test_search_of_no_documents_and_of_no_items(spark, nothing, odd):
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert ranked_search.rank(ranked_search.build_index(nothing), items).count() == 0
    assert ranked_search.rank(ranked_search.build_index(odd), items.limit(0)).count() == 0
    assert ranked_search.rank(ranked_search.build_index(odd.where("text is null or text = ''")), items).count() == 0


def test_treap_holds_every_point_under_larger_ones():
    rng = np.random.default_rng(1)
    cells = rng.choice(300 * 70, 2000, replace=False)
    row, col, value = cells // 70, cells % 70, rng.integers(0, 50, 2000)
    treap = ranked_search.build_treap(row, col, value)
    made = [(int(r), int(c), int(v)) for level in zip(treap.row, treap.col, treap.value, strict=True) for r, c, v in zip(*level, strict=True)]
    assert sorted(made) == sorted(zip(row.tolist(), col.tolist(), value.tolist(), strict=True))
    for level in range(len(treap.row) - 1):
        for node, mask in enumerate(treap.mask[level].tolist()):
            for q in range(4):
                if mask >> q & 1:
                    child = treap.first[level][node] + bin(mask & (1 << q) - 1).count("1")
                    assert treap.value[level + 1][child] <= treap.value[level][node]


@pytest.mark.parametrize("name", ["op11_merkle", "op12_ngram_join", "op13_ranked_search"])
def test_queries_have_their_columns(spark, sf, name):
    want = {
        "op11_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
        "op12_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
        "op13_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    }[name]
    rows = queries.queries()[name](spark, sf)
    assert ", ".join(f"{c} {k}" for c, k in rows.dtypes) == want and rows.count() > 0
