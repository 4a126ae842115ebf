"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score of its distinct words and their beginnings; a
document is toxic unless all its sentences are clean (noisy-or): p = 1 - prod(1 - p_s). Weights are trained
from the documents' labels alone; afterwards the sentence scores say where the offence stands.

The classifier is fitted on at most MAX_TRAIN labelled rows, half of each label, chosen by a hash of doc_id, whose
texts have at most MAX_TRAIN_CHARS characters. Every document is scored, whole. Null and empty texts have no
sentence and score 0. Repeated rows give repeated results. Without both labels every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.common import annotated

MAX_TRAIN = 5_000
MAX_TRAIN_CHARS = 200_000
#: Features kept, of those in at least MIN_SUPPORT sentences of the sample.
MAX_FEATURES = 3_000
MIN_SUPPORT = 4
PREFIXES = (4, 5, 6)
MEMO = 300_000

sentences = re.compile(r"[^.!?\n]+").finditer
words = re.compile(r"\w+").findall


def lowered(text: str) -> str:
    """Lower case, but for the few capitals that would grow: offsets must stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    """Weights by feature; bias of a sentence."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """Maps a word to its weight, remembered up to MEMO words."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        get = self.model.weights.get
        w = get(word, 0.0)
        for k in PREFIXES:
            if len(word) > k:
                w += get(f"{word[:k]}*", 0.0)
        if len(self) >= MEMO:
            self.clear()
        self[word] = w
        return w

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and score of each sentence that has a word with a weight above zero."""
        out, bias = [], self.model.bias
        for m in sentences(lowered(text)):
            z = bias + sum(map(self.__getitem__, dict.fromkeys(words(m.group()))))
            if z > bias:
                out.append((m.start(), m.end(), float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))))
        return out

    def document(self, spans: list[tuple[int, int, float]]) -> float:
        """Noisy-or over the sentences; those with no weighted word add nothing."""
        left = 0.0
        for _, _, p in spans:
            left += np.log1p(-min(p, 1 - 1e-12))
        return float(min(max(0.0, -np.expm1(left)), 1.0)) + 0.0


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_TRAIN) -> list[tuple[str, int]]:
    """At most limit (text, label) rows: half of each label, by a hash of doc_id; of rows that share a doc_id, the smallest text. The ids are bounded, so they are broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    half = limit // 2
    picked = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", "text").where(F.length("text").between(1, MAX_TRAIN_CHARS)).join(F.broadcast(picked), "doc_id")
    got = [(r["doc_id"], r["text"], int(r["_y"])) for r in found.groupBy("doc_id", "_y").agg(F.min("text").alias("text")).collect()]  # at most limit rows
    return [(t, y) for _, t, y in sorted(got)]


def fit(rows: list[tuple[str, int]], rounds: int = 250, rate: float = 0.15, l1: float = 2e-5, l2: float = 2e-5) -> Model:
    """Noisy-or maximum likelihood by Adam; features chosen by how unevenly their distinct sentences fall on the labels."""
    if len({y for _, y in rows}) < 2:
        return Model()
    support = [Counter(), Counter()]
    totals = [0, 0]
    seen: set[int] = set()
    for text, y in sorted(rows, key=lambda r: -r[1]):  # toxic ones first: only what they hold is counted in the others
        for m in sentences(lowered(text)):
            s = m.group()
            if (h := hash(s)) not in seen:  # copies must not vote twice
                seen.add(h)
                totals[y] += 1
                found = {f for w in words(s) for f in features(w)}
                support[y].update(found if y else found & support[1].keys())
    seen.clear()
    scored = []
    for f, k in support[1].items():
        n = k + support[0][f]
        if n >= MIN_SUPPORT:
            p1, p0 = (k + 0.5) / (totals[1] + 1), (support[0][f] + 0.5) / (totals[0] + 1)
            if p1 > 1.5 * p0:
                scored.append((k * np.log(p1 / p0), f))
    names = [f for _, f in sorted(scored, key=lambda x: (-x[0], x[1]))[:MAX_FEATURES]]
    index = {f: i for i, f in enumerate(names)}
    if not index:
        return Model()
    at_doc, at_row, at_col, val, n_rows = [], [], [], [], 0
    support.clear()
    for d, (text, _) in enumerate(rows):
        for m in sentences(lowered(text)):
            hit = Counter(index[f] for w in dict.fromkeys(words(m.group())) for f in features(w) if f in index)
            if hit:
                at_doc.append(d)
                for i, n in hit.items():
                    at_row.append(n_rows)
                    at_col.append(i)
                    val.append(n)
                n_rows += 1
    doc, row, col, val = np.array(at_doc), np.array(at_row), np.array(at_col), np.array(val, dtype=float)
    y = np.array([y for _, y in rows], dtype=float)
    x = np.zeros(len(index) + 1)
    x[-1] = -3.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        z = x[-1] + np.bincount(row, weights=val * x[col], minlength=n_rows)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        left = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        whole = np.clip(-np.expm1(left), 1e-9, 1.0)
        slope = np.where(y[doc] > 0, -(1 - whole[doc]) / whole[doc], 1.0) * p / len(y)
        g = np.empty_like(x)
        g[:-1] = np.bincount(col, weights=val * slope[row], minlength=len(index)) + l2 * x[:-1] + l1  # weights are never below zero
        g[-1] = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        x[:-1] = np.maximum(x[:-1], 0)  # a word only ever speaks for toxicity: one clean sentence does not excuse another
    return Model({f: float(w) for f, w in zip(names, x[:-1], strict=True) if w > 0.05}, float(x[-1]))


def score(docs: DataFrame, model: Model, at: float = 0.5, names: tuple[str, str] = ("toxic_score", "toxic_spans")) -> DataFrame:
    """docs with toxic_score (double) and toxic_spans (start, end, score of each sentence at or above `at`, in code points); columns of these names are replaced."""

    def worker():
        scorer = model.scorer()

        def judged(data: bytes | None) -> tuple:
            got = scorer.sentences((data or b"").decode("utf-8", "replace"))
            return scorer.document(got), [{"start": a, "end": b, "score": p} for a, b, p in got if p >= at]

        return judged

    return annotated(docs, "text", f"`{names[0]}` double, `{names[1]}` array<struct<start:int,end:int,score:double>>", worker)
