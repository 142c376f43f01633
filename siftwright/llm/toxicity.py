"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A document is a bag of sentences. A sentence offends with probability sigmoid(bias + sum of its
words' weights); a document is toxic unless none of its sentences offends and no leak occurs
(noisy-or with a leak that takes up wrong labels). Weights are fitted to the documents' labels
through that combination, so sentences need none, and the fitted sentence scores then point to
the offending places.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ship import ship

MAX_DOCS = 6000
THRESHOLD = 0.7
OFFENDING = 0.5
_SENTENCE = re.compile(r"[^.!?\n]+")
_TRIM = ".,;:!?\"'()[]{}<>*#$%&|-_"


def features(word: str) -> tuple[str, ...]:
    """What a word is known by: itself and, for stems with changing ends, its first 4, 5 and 6 letters."""
    return (word, *("^" + word[:k] for k in (4, 5, 6) if len(word) >= k))


@dataclass(frozen=True)
class Model:
    """Sentence score: bias plus weights of its distinct features; ``leak`` is the score of a text that says nothing."""
    weights: dict[str, float]
    bias: float
    leak: float

    def sentences(self, text: str, known: dict[str, tuple[str, ...]] | None = None) -> list[tuple[int, int, float]]:
        """(start, end, log-odds) of the sentences that hold a weighted feature; ``known`` keeps looked-up words."""
        weights, out = self.weights, []
        known = {} if known is None else known
        if len(known) > _KNOWN_WORDS:
            known.clear()
        low = text.lower()
        if len(low) != len(text):  # places must hold in the given text
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        for m in _SENTENCE.finditer(low):
            found: set[str] = set()
            for x in m.group().split():
                hit = known.get(x)
                if hit is None:
                    hit = known[x] = tuple(f for f in features(x.strip(_TRIM)) if f in weights)
                if hit:
                    found.update(hit)
            if found:
                out.append((m.start(), m.end(), self.bias + sum(weights[f] for f in sorted(found))))
        return out

    def score(self, found: list[tuple[int, int, float]]) -> float:
        """Noisy-or of the sentences' probabilities and the leak; plain sentences add nothing."""
        log_none = np.log1p(-self.leak) - sum(np.logaddexp(0.0, z) for _, _, z in found)
        return float(min(1.0, max(0.0, -np.expm1(log_none))))


# words that a task keeps looked up
_KNOWN_WORDS = 300_000


def bag(text: str | None) -> list[set[str]]:
    """Distinct features of each sentence's words, lower-cased, without punctuation at their ends."""
    return [s for m in _SENTENCE.finditer((text or "").lower()) if (s := {f for x in m.group().split() if (w := x.strip(_TRIM)) for f in features(w)})]


def fit(texts: list[str | None], labels: list[int], *, min_docs: int = 3, penalty: float = 0.3, rounds: int = 200, bias: float = -9.0) -> Model:
    """Fit word weights (none below 0) and leak by adaptive gradient steps on the documents' log-likelihood.

    Features of fewer than ``min_docs`` documents are left out; ``penalty`` pulls each weight to
    0, so a feature needs several toxic documents that nothing else explains. The bias ends low:
    a sentence without a weighted word adds nothing, however many there are. Without a toxic
    label the model knows no word.
    """
    y = np.asarray(labels, float)
    if not len(y) or not y.sum():
        return Model({}, bias, 1e-3)
    # bags are made three times rather than held: only counts and places of likely features are kept
    positive = Counter(f for t, v in zip(texts, labels) if v for f in set().union(*bag(t)))
    positive = {f: n for f, n in positive.items() if n > 1}
    seen = Counter(f for t in texts for f in set().union(*bag(t)) if f in positive)
    # what is not clearly more frequent in toxic documents than in all can hardly win
    lift = min(0.5, 2 * y.mean())
    names = sorted(f for f, n in seen.items() if n >= min_docs and positive[f] > lift * n)
    index = {f: i for i, f in enumerate(names)}
    at_sentence, at_word, doc_of = array("q"), array("q"), array("q")
    for d, t in enumerate(texts):
        for s in bag(t):
            found = [index[f] for f in s if f in index]
            if found:
                at_sentence.extend([len(doc_of)] * len(found))
                at_word.extend(found)
                doc_of.append(d)
    at_sentence, at_word, doc_of = (np.asarray(x, np.int64) for x in (at_sentence, at_word, doc_of))
    n, s, k = len(y), len(doc_of), len(names)
    w, gw = np.zeros(k), np.full(k, 1e-8)
    leak, gl = float(np.log(0.02 / 0.98)), 1e-8
    for step in range(rounds):
        # a high bias at first lets sentences, not the leak, take the blame
        now = bias + (-3.0 - bias) * max(0.0, 1 - 2 * step / rounds)
        z = now + np.bincount(at_sentence, w[at_word], s)
        p = 1 / (1 + np.exp(-z))
        log_none = -np.bincount(doc_of, np.logaddexp(0.0, z), n) - np.logaddexp(0.0, leak)
        none = np.exp(log_none)
        # derivative of the loss by -log_none: 1 for clean documents, minus the odds for toxic ones
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-12), 1.0)
        grad = np.bincount(at_word, (pull[doc_of] * p)[at_sentence], k)
        slope = (pull / (1 + np.exp(-leak))).sum()
        gw += grad**2
        gl += slope**2
        w = np.maximum(0.0, w - (grad + penalty) / np.sqrt(gw))
        if step > rounds // 2:
            leak = float(np.clip(leak - 0.5 * slope / np.sqrt(gl), -8.0, np.log(0.3 / 0.7)))
    keep = w > 0.05
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(keep)}, bias, float(1 / (1 + np.exp(-leak))))


def sample_labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, where: Column | None = None,
                    *, max_docs: int = MAX_DOCS, seed: int = 7) -> tuple[list, list]:
    """At most ``max_docs`` labelled texts, picked by a seeded hash of the key; the bound is what may reach the driver."""
    usable = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).na.drop()
    usable = usable.groupBy("_key").agg(F.max("_label").alias("_label"))
    if where is not None:
        usable = usable.where(where)
    n = usable.count()
    share = F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, 0.9 * max_docs / max(1, n))) + (n <= 0.9 * max_docs))
    # at most max_docs rows
    picked = F.broadcast(usable.where(share).limit(max_docs))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(picked, "_key").limit(max_docs).collect()
    rows.sort(key=lambda r: (r["_key"], r["_text"] or ""))
    return [r["_text"] for r in rows], [int(r["_label"] > 0) for r in rows]


def score_toxicity(df: DataFrame, text: str, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``offending``.

    ``offending`` lists start, end (in characters) and score of the sentences of at least
    OFFENDING. Null and empty texts get the leak. Every row comes back; columns of ``df`` named
    like results are replaced.
    """
    ship(df.sparkSession)
    made = ["score", "predicted", "offending"]
    rest = [c for c in df.columns if c not in made]

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str, ...]] = {}
        for texts in parts:
            scores, places = [], []
            for t in texts:
                found = model.sentences(t, known) if t else []
                scores.append(model.score(found))
                places.append([{"start": a, "end": b, "score": p} for a, b, z in found if (p := float(1 / (1 + np.exp(-z)))) >= OFFENDING])
            yield pd.DataFrame({"score": scores, "offending": places})

    return (
        df.select(*rest, judge(F.col(text)).alias("_j"))
        .select(*rest, F.col("_j.score").alias("score"), (F.col("_j.score") >= threshold).cast("int").alias("predicted"),
                F.col("_j.offending").alias("offending"))
    )
