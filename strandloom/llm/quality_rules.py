"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps its measurements and one long of
failure bits, so that any policy (a versioned mask of rules) is a bitwise AND over a column, and so
that what each rule does alone, together or if it were left out is counted from the few distinct
bit patterns, without a text being read again.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import Step, raw_texts, with_arrow

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_exclaims")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` never changes once it has been stored."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "shouting", "n_upper + n_lower >= 100 and n_upper > n_lower"),
    Rule(5, "exclaiming", "100 * n_exclaims > 30 * n_words"),
    Rule(6, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
)
BASE = Policy("base", ("too_short", "repeated_words"))
POLICIES = (BASE, Policy("v1", tuple(r.name for r in RULES)))


def _repeats(words: list[bytes]) -> int:
    grams = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    again = np.fromiter((counts[g] > 1 for g in grams), bool, len(grams))
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(grams)] |= again
    return int(hit.sum())


def _measure(text: pa.Array) -> list[pa.Array]:
    rows = []
    for raw in raw_texts(text):
        words = raw.split()
        tight = b"".join(words)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        chars = len(tight.decode("utf-8", "replace"))
        n_upper, n_lower = (len(raw) - len(raw.translate(None, x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
        rows.append((len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeats(words), len(lines), n_upper, n_lower, raw.count(b"!")))
    return [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[] for _ in MEASURES])]


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the measurements of each text and ``fail_bits`` (long): bit b is set if rule b fails.

    Null and empty texts have no words: every count is 0, and of the given rules only ``too_short``
    fails. Repeated rows are measured each by itself. Columns of ``docs`` that have the name of a
    measurement give way to it.
    """
    out = with_arrow(docs, Step((text,), tuple(T.StructField(m, T.LongType()) for m in MEASURES), _measure), keep=None if keep is None else [*keep, *MEASURES])
    bits: Column = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return out.withColumn("fail_bits", bits)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    by_name = {r.name: r.bit for r in rules}
    return sum(1 << by_name[n] for n in policy.rules)


def fails(policy: Policy, bits: str = "fail_bits", rules: tuple[Rule, ...] = RULES) -> Column:
    """True where a document breaks a rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy, rules)).cast("long")) != 0


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule of each policy does: ``version, rule, n_docs, n_rejected, n_failed, n_only, n_rejected_without``.

    ``n_failed`` documents break the rule, ``n_only`` break no other rule of the policy;
    ``n_rejected_without`` would go if the rule were left out. The ledger is first counted by bit
    pattern, of which there are at most 2 to the number of rules.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    listed = [(p.version, r.name, mask(p, rules), 1 << r.bit) for p in policies for r in rules if r.name in p.rules]
    spec = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(n).alias("rule"), F.lit(m).cast("long").alias("m"), F.lit(b).cast("long").alias("b")) for v, n, m, b in listed])
    hit = F.col("fail_bits").bitwiseAND(F.col("m"))
    return (
        patterns.select("fail_bits", "n", F.inline(spec))
        .groupBy("version", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("b")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("b"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(hit.bitwiseAND(F.bitwise_not("b")) != 0, F.col("n")).otherwise(0)).alias("n_rejected_without"),
        )
    )
