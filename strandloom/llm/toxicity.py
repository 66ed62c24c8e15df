"""Toxicity by multiple-instance learning.

Only documents have labels; sentences are the instances. A sentence scores the sigmoid of the
summed weights of its distinct words and their stems, a document the noisy-or of its sentences: it is toxic unless every
sentence is clean. The likelihood of the document labels trains the word weights, so that the
sentences that make a document toxic can be pointed at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import Step, with_arrow

SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")
#: Bounds of the training sample, and of what it may teach.
MAX_TRAIN_DOCS, MAX_TRAIN_CHARS, MIN_DOCS = 6000, 40_000_000, 10
SHORTEST_STEM, LONGEST_STEM = 4, 8
EPOCHS, RATE, SHRINK, BIAS = 80, 0.15, 1e-4, -6.0
#: Words whose weight a worker keeps.
REMEMBERED = 200_000
_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]


def lowered(text: str) -> str:
    """In lower case, code point by code point: only one letter becomes two, and is one here."""
    return text.replace("\u0130", "i").lower()


def features(word: str) -> list[str]:
    """The word itself and its beginnings: insults are built on stems, in any language."""
    return ["=" + word, *("^" + word[:k] for k in range(SHORTEST_STEM, min(len(word), LONGEST_STEM) + 1))]


def _bags(texts: list[str]) -> list[list[list[str]]]:
    docs = []
    for t in texts:
        bags = [sorted(set(TOKEN.findall(s))) for s in SENTENCE.findall(lowered(t))]
        docs.append([b for b in bags if b] or [[]])
    return docs


def fit_arrays(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Full-batch Adam on the documents' noisy-or log likelihood with a small L2 penalty.

    A word weighs the sum of its features' weights, so an epoch touches each word of a sentence once.
    """
    docs = _bags(texts)
    vocabulary: dict[str, int] = {}
    words = np.array([vocabulary.setdefault(w, len(vocabulary)) for d in docs for s in d for w in s], np.int64)
    of = [features(w) for w in vocabulary]
    at = {w: k for k, w in enumerate(vocabulary)}
    df: Counter = Counter()
    for d in docs:
        df.update({f for w in {w for s in d for w in s} for f in of[at[w]]})
    # bounded by the sample: a feature has MIN_DOCS of its documents at least
    common = [f for f, n in df.items() if MIN_DOCS <= n <= max(MIN_DOCS, 0.5 * len(docs))]
    index = {f: i for i, f in enumerate(sorted(common))}
    pairs = [(k, index[f]) for k, fs in enumerate(of) for f in fs if f in index]
    of_word, of_feature = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    row = np.repeat(np.arange(sum(map(len, docs))), [len(s) for d in docs for s in d])
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]]).astype(np.int64)
    size = np.array([len(d) for d in docs])
    n_rows = int(size.sum())
    w, b = np.zeros(len(index)), BIAS
    m, v, mb, vb = np.zeros(len(index)), np.zeros(len(index)), 0.0, 0.0
    y = labels.astype(bool)
    for k in range(1, epochs + 1):
        weight = np.bincount(of_word, w[of_feature], len(vocabulary))
        z = b + np.bincount(row, weight[words], n_rows)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        total = np.add.reduceat(np.logaddexp(0, z), starts)
        pull = np.where(y, -1 / np.expm1(np.clip(total, 1e-6, 60)), 1.0)
        g = np.repeat(pull, size) * p / len(docs)
        gw = np.bincount(of_feature, np.bincount(words, g[row], len(vocabulary))[of_word], len(index)) + SHRINK * w
        gb = float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c, d = 1 - 0.9**k, 1 - 0.999**k
        w = w - RATE * (m / c) / (np.sqrt(v / d) + 1e-8)
        b = b - RATE * (mb / c) / (math.sqrt(vb / d) + 1e-8)
    return Model(float(b), {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3})


def fit(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Train on at most ``max_docs`` rows of ``labelled`` (``doc_id, text, toxic``), those of the lowest id hashes.

    From the first row on that would take the texts beyond ``max_chars`` no more are taken; which rows
    these are is found from ids and lengths, before any text is moved. Rows without a label or text
    teach nothing, rows that repeat teach once; without any row the model calls everything clean. One
    executor trains; the driver gets the weights, whose number the sample bounds.
    """

    def train(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(parts)
        if not got:
            return
        rows = pd.concat(got, ignore_index=True)
        rows = rows.sort_values(["h", "doc_id", "th", "toxic"], kind="stable").drop_duplicates()
        model = fit_arrays(rows["text"].tolist(), rows["toxic"].to_numpy())
        yield pd.DataFrame({"word": ["", *model.weights], "weight": [model.bias, *model.weights.values()]})

    rows = labelled.where("toxic is not null and text is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("th"))
    order = ["h", "th", "toxic"]
    sizes = rows.select(*order, F.length("text").alias("n")).distinct().orderBy(*order).limit(max_docs)
    upto = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # of max_docs rows at most
    last = sizes.withColumn("upto", upto).where(F.col("upto") <= max_chars).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    if last is None:
        return Model(BIAS, {})
    taken = rows.where(F.struct(*order) <= F.struct(*[F.lit(x).cast(t) for x, t in zip(last, ("long", "long", "int"), strict=True)]))
    got = taken.dropDuplicates(["doc_id", *order]).coalesce(1).mapInPandas(train, "word string, weight double").collect()
    weights = {r["word"]: r["weight"] for r in got}
    return Model(weights.pop("", BIAS), weights)


def score_step(model: Model, text: str = "text") -> Step:
    bias, weights = model.bias, model.weights
    rest = math.log1p(math.exp(bias))
    seen: dict[str, float] = {}

    def fn(texts: pa.Array) -> list[pa.Array]:
        scores, spans = [], []

        def weigh(word: str) -> float:
            known = [x for x in map(weights.get, features(word)) if x is not None]
            if len(seen) >= REMEMBERED:
                seen.clear()
            total = seen[word] = math.fsum(known) if known else 0.0
            return total

        for t in texts.to_pylist():
            t = t or ""
            low = lowered(t)
            total, found = 0.0, []
            for s in SENTENCE.finditer(low):
                hit = [x for x in [seen[w] if w in seen else weigh(w) for w in set(TOKEN.findall(s.group()))] if x]
                if not hit:
                    total += rest
                    continue
                z = bias + math.fsum(hit)
                total += z if z > 30 else math.log1p(math.exp(z))
                if z >= 0:
                    found.append({"begin": s.start(), "end": s.end(), "score": 1 / (1 + math.exp(-z))})
            scores.append(-math.expm1(-total))
            spans.append(found)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return [pa.array(scores, pa.float64()), pa.array(spans, kind)]

    return Step((text,), (T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", _SPANS)), fn)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``toxic_spans``: code point ranges of the sentences that score 0.5 or more.

    Null and empty texts have no sentence and score 0. The score depends on the text alone, so repeated
    rows score alike; texts of any length are scored whole. Columns called like the results give way
    to them.
    """
    return with_arrow(docs, score_step(model, text), keep=None if keep is None else [*keep, "score", "toxic_spans"])
