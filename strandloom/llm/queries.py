"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import bpe, licences, line_dedup, merkle, mixing, ngram_join, pseudonyms, quality_rules, ranked_search, simhash, sketches, toxicity, url_filter
from strandloom.llm.common import Step, table, with_arrow

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pseudonyms are linked by it; a deployment sets its own.
PSEUDONYM_KEY = "strandloom-example-key"
URL_RULES = [
    url_filter.ListedRule("block", "com", "/en/"),
    url_filter.ListedRule("allow", "example.com", "/en/7"),
    url_filter.ListedRule("allow", "net", "/de/"),
    url_filter.ListedRule("block", "example.net", "/de/8"),
    url_filter.ListedRule("block", "org", "/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    judged = url_filter.judge(pages, URL_RULES, url_filter.mine_rules(pages, labels))
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    failed = quality_rules.fails(quality_rules.BASE)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~quality_rules.fails(quality_rules.POLICIES[-1])).alias("kept"), "fail_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return out.select("doc_id", F.col("safe_text").alias("text"), "n_replaced")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = table(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", "toxic").where(fold != 0).distinct()
    # the sample is chosen by id, so that only its texts are moved
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(toxicity.MAX_TRAIN_DOCS)
    model = toxicity.fit(docs.join(F.broadcast(drawn), "doc_id"))
    rows = toxicity.score(docs, model, keep=["doc_id"])
    held_out = F.coalesce(fold == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_toxic_sentences"))


def _sha256_of_ids(lists: pa.Array) -> list[pa.Array]:
    flat = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
    ends = (4 * np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).tolist()
    return [pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip([0, *ends], ends, strict=False)], pa.string())]


def bpe_digests(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Encode and decode whole texts, and digest both ways, in one pass."""
    spark = docs.sparkSession
    digest = Step(("ids",), (T.StructField("ids_sha256", T.StringType()),), _sha256_of_ids)
    count = Step(("ids",), (T.StructField("n_tokens", T.LongType()),), lambda x: [pc.fill_null(pc.list_value_length(x), 0).cast(pa.int64())])
    steps = [bpe.encode_step(spark, RANKS, public_tokenizers.PATTERN), bpe.decode_step(spark, RANKS, public_tokenizers.PATTERN), count, digest]
    rows = with_arrow(docs, *steps, keep=[*keep, "n_tokens", "ids_sha256", "decoded"])
    return rows.select(*keep, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "shards")


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketches.compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketches.as_string("sketch", "digest").alias("fingerprint"), sketches.as_string("edited_sketch", "edited_digest").alias("edited_fingerprint"),
        "near_edited", "near_next", "contained_edited",
    )


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return rows.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("hits").cast("long").alias("n_sentences"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = fields[:3] + [F.col("n_chars").cast("decimal(20,0)") + 1] + fields[4:]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_of(*more))
    made = merkle.build(docs.select("doc_id", "lang", merkle.leaf_of(*fields).alias("leaf"), tampered.alias("tampered")))
    rows = merkle.proofs(made).withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ranked_search.rank(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_DUCK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, {_DUCK_WORDS} as w from documents),
grams as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
tri as (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from grams),
again as (select doc_id, i from tri qualify count(*) over (partition by doc_id, a, b, c) > 1),
hit as (select doc_id, count(distinct i + k) as n_repeat_words from again, (values (0), (1), (2)) o(k) group by doc_id),
m as (
  select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_distinct,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) as n_lower, length(t) - length(replace(t, '!', '')) as n_exclaims
  from d left join hit on d.doc_id = hit.doc_id),
b as (
  select *, n_lines - n_distinct as n_dup_lines,
    case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when 100 * n_symbols > 30 * n_words then 4 else 0 end
    + case when n_lines >= 4 and 100 * (n_lines - n_distinct) > 50 * n_lines then 8 else 0 end + case when n_upper + n_lower >= 100 and n_upper > n_lower then 16 else 0 end
    + case when 100 * n_exclaims > 30 * n_words then 32 else 0 end + case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words) then 64 else 0 end as fail_bits
  from m)
"""
_OP2_ROWS = """
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits::bigint as fail_bits from b
"""
_ABLATIONS = """,
r(version, rule, mask, bit) as (values ('base', 'too_short', 3, 1), ('base', 'repeated_words', 3, 2), ('v1', 'too_short', 127, 1), ('v1', 'repeated_words', 127, 2), ('v1', 'symbols', 127, 4),
  ('v1', 'repeated_lines', 127, 8), ('v1', 'shouting', 127, 16), ('v1', 'exclaiming', 127, 32), ('v1', 'word_length', 127, 64))
select version, rule, count(*) as n_docs, count(*) filter ((fail_bits & mask) <> 0) as n_rejected, count(*) filter ((fail_bits & bit) <> 0) as n_failed,
  count(*) filter ((fail_bits & mask) = bit) as n_only, count(*) filter ((fail_bits & mask & ~bit) <> 0) as n_rejected_without
from b cross join r group by version, rule
"""

OP7_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
bad as (select key, max(doc_id) as last_doc from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
f as (select k.doc_id, k.i, k.line, bad.key is not null and k.doc_id <> last_doc as gone from k left join bad on k.key = bad.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from f group by doc_id
"""


def _duck_field(x: str) -> str:
    return f"coalesce(strlen(({x})::varchar)::varchar || ':' || ({x})::varchar, '-')"


def _duck_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_duck_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


OP11_SQL = f"""
with recursive d as (
  select doc_id, lang, {_duck_leaf("n_chars")} as leaf, {_duck_leaf("n_chars::hugeint + 1")} as more,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as crc
  from documents),
p as (select *, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from d),
up as (
  select tree, 0 as lvl, pos, leaf as digest, n from p
  union all
  select tree, lvl + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), (n + 1) // 2 from up where n > 1 group by tree, lvl, pos // 2, n),
s as (select tree, lvl as height, digest as subroot from up where n = 1),
top as (
  select 0 as lvl, tree as pos, subroot as digest, (select count(*) from s) as n from s
  union all
  select lvl + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), (n + 1) // 2 from top where n > 1 group by lvl, pos // 2, n),
r as (select lvl as height, digest as root from top where n = 1),
steps as (
  select tree, pos, unnest(range(height)) as lvl, 0 as part from p join s using (tree)
  union all
  select tree, pos, unnest(range(r.height)), 1 from p, r),
sib as (
  select x.tree, x.pos, x.part, x.lvl, case when part = 0 then (x.pos >> x.lvl) & 1 else (x.tree >> x.lvl) & 1 end as odd, coalesce(u.digest, t.digest, '') as digest
  from steps x left join up u on part = 0 and u.tree = x.tree and u.lvl = x.lvl and u.pos = xor(x.pos >> x.lvl, 1)
    left join top t on part = 1 and t.lvl = x.lvl and t.pos = xor(x.tree >> x.lvl, 1)),
proof as (select tree, pos, list(case when odd = 1 then '<' else '>' end || digest order by part, lvl) as steps, string_agg(digest, '' order by part, lvl) as joined from sib group by tree, pos),
f as (
  select doc_id, leaf, subroot, root, sha256(coalesce(joined, '')) as proof_sha256,
    list_reduce(list_prepend(case when crc is not null and xor(crc, 4294967295) % 7 = 0 then more else leaf end, coalesce(steps, [])),
      lambda a, x: sha256(case when x[1] = '<' then x[2:] || a else a || x[2:] end)) as folded_root
  from p join s using (tree) cross join r left join proof using (tree, pos))
select *, folded_root = root as verified from f
"""


OP12_SQL = rf"""
with recursive d as (select doc_id, list_transform({_DUCK_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
g as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w] else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as g from d),
n as (select d.doc_id, count(g.doc_id) as n from d left join g on d.doc_id = g.doc_id group by d.doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
reach as (select doc_id as x, doc_id as y from d union select x, y from (select reach.x as x, links.y as y from reach join links on reach.y = links.x))
select doc_id, n as n_shingles, least as component_id from n join (select x, min(y) as least from reach group by x) on x = doc_id
"""


_DUCK_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP13_SQL = f"""
with t as (select doc_id, {_DUCK_TERMS} as term from documents),
tf as (select doc_id, term, count(*) as tf from t group by all),
n as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
total as (select count(*) as n_docs, sum(n)::bigint as n_terms from n),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf cross join total group by term, n_docs),
q as (select item_id, {_DUCK_TERMS} as term from benchmark),
s as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::bigint as score
  from q join w using (term) join tf using (term) join n using (doc_id) cross join total group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0 qualify rank <= 20
"""


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_url_filter, op2_quality_ledger, quality_ablations, op3_pseudonyms, op4_simhash, op5_toxicity, op6_bpe, op7_line_dedup, op8_mixing, op9_sketches, op10_licences, op11_merkle, op12_ngram_join, op13_ranked_search)
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_ledger": OP2_SQL + _OP2_ROWS, "quality_ablations": OP2_SQL + _ABLATIONS, "op7_line_dedup": OP7_SQL, "op11_merkle": OP11_SQL, "op12_ngram_join": OP12_SQL, "op13_ranked_search": OP13_SQL}
