"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Sentence s is offensive with p_s = sigmoid(b + sum of the weights of its features), and
the document is toxic with 1 - (1 - leak) * product of (1 - p_s), a noisy-or over the sentences that have any feature;
the leak stands for labels that the text doesn't explain, and is held at 0.45 at most, so that it alone never predicts
toxic. Only document labels train it. Features are words and their
first and last 3 to 5 letters, selected by how they part the training labels. After training each sentence has its own
score, and those of at least 0.5 are located.

Training uses rows whose crc32(doc_id as text) mod 5 isn't 0, at most `train_rows` of them, those with the smallest
hashes. What reaches the driver is bounded by that parameter: counts of the features that at least `least` training
documents marked toxic hold, and the selected features of the training sentences. Every document is scored whole.

Edge cases: a null or empty text has no sentences and scores the leak; a null label is no label; a null doc_id is never
held out and never joined to a label; repeated rows score alike; without toxic training rows all score 0; an empty table
gives an empty table; of other columns only the labels table's toxic is read, so none can clash.

Scale: one pass over the texts to take the training rows (a broadcast of counted, bounded ids), one to score; no shuffle
of texts. A worker's memory holds one Arrow batch and a bounded memory of words.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, release

TRAIN_ROWS, LEAST, MOST_FEATURES = 40_000, 4, 4000
MEMORY = 500_000
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[str]:
    out = [word]
    for n in (3, 4, 5):
        if len(word) > n:
            out += [word[:n] + "-", "-" + word[-n:]]
    return out


def text_features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of at most train_rows labelled rows."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return keep(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-training")


def _counter(toxic: int, only: frozenset | None):
    def count(batches):
        counts: Counter = Counter()
        rows = 0
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                if label == toxic:
                    rows += 1
                    found = text_features(text)
                    counts.update(found if only is None else found & only)
        counts[""] = rows
        yield pa.record_batch([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

    return count


def _counts(rows: DataFrame, toxic: int, only: frozenset | None, least: int) -> dict[str, int]:
    found = rows.mapInArrow(_counter(toxic, only), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return {f: n for f, n in found.where((F.col("n") >= least) | (F.col("feature") == "")).collect()}


def select_features(pos: dict[str, int], neg: dict[str, int], least: int, most: int) -> list[str]:
    """Features that raise the odds of toxic at least fivefold, by the likelihood ratio of their counts."""
    n1, n0 = pos.get("", 0), neg.get("", 0)
    scored = []
    for f, a in pos.items():
        b = neg.get(f, 0)
        if not f or a < least or (a + 0.5) * (n0 + 1) < 5 * (b + 0.5) * (n1 + 1):
            continue
        rate = (a + b) / (n1 + n0)
        g = a * math.log(a / (n1 * rate)) + (b * math.log(b / (n0 * rate)) if b else 0)
        scored.append((-g, f))
    return [f for g, f in sorted(scored)[:most] if g < -6]


def _bags(index: dict[str, int]):
    def take(batches):
        memory: dict = {}
        for batch in batches:
            out = [sentences(t, index, memory)[1] for t in batch.column("text").to_pylist()]
            flat = [[x for s in bag for x in [*s, -1]] for bag in out]
            yield pa.record_batch([batch.column("toxic"), pa.array(flat, pa.list_(pa.int32()))], names=["toxic", "bag"])

    return take


def sentences(text: str | None, index: dict[str, int], memory: dict) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Spans (code points) and features of the sentences that have any."""
    if not text:
        return [], []
    lowered = text.lower()
    words = set(_WORD.findall(lowered))
    if len(memory) > MEMORY:
        memory.clear()
    for w in [w for w in words if w not in memory]:
        memory[w] = tuple(index[f] for f in word_features(w) if f in index)
    marked = {w for w in words if memory[w]}
    if not marked:
        return [], []
    spans, bags = [], []
    for m in _SENTENCE.finditer(text):
        found = sorted({f for w in _WORD.findall(m[0].lower()) for f in (memory[w] if w in memory else ())})
        if found:
            spans.append(m.span())
            bags.append(found)
    return spans, bags


class Model:
    def __init__(self, features: list[str], weights: np.ndarray, bias: float, leak: float):
        self.index = {f: i for i, f in enumerate(features)}
        self.weights, self.bias, self.leak = weights.tolist(), bias, leak

    def score(self, bags: list[list[int]]) -> tuple[float, list[float]]:
        each = [1 / (1 + math.exp(-min(30.0, max(-30.0, self.bias + sum([self.weights[f] for f in b]))))) for b in bags]
        return 1 - (1 - self.leak) * math.prod(1 - p for p in each), each


def fit(bags: list[list[list[int]]], toxic: np.ndarray, size: int, steps: int = 300, rate: float = 0.1, ridge: float = 2e-3) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak that maximise the noisy-or likelihood of the document labels (Adam, full batch)."""
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    sent = np.array([i for i, s in enumerate(s for bag in bags for s in bag) for _ in s], np.int64)
    feat = np.array([f for bag in bags for s in bag for f in s], np.int64)
    n, y = len(bags), toxic.astype(float)
    theta = np.concatenate([np.full(size, 1.0), [-2.0, -4.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[size] + np.bincount(sent, theta[feat], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = 1 / (1 + math.exp(-theta[size + 1]))
        log_clean = math.log(1 - leak) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n)
        clean = np.minimum(np.exp(log_clean), 1 - 1e-9)
        # Derivative of the log likelihood by log_clean: -clean / (1 - clean) for toxic documents, 1 for clean ones.
        slope = np.where(y > 0, -clean / (1 - clean), 1.0)
        dz = slope[doc] * -p
        grad = np.concatenate([np.bincount(feat, dz[sent], size), [dz.sum(), (slope * -leak).sum()]]) / n
        grad[:size] -= ridge * theta[:size] / max(1, size) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:size], float(theta[size]), 1 / (1 + math.exp(-float(theta[size + 1])))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, least: int = LEAST, most: int = MOST_FEATURES) -> Model:
    rows = training_rows(docs, labels, train_rows)
    pos = _counts(rows, 1, None, least)
    neg = _counts(rows, 0, frozenset(pos), 1)
    features = select_features(pos, neg, least, most)
    if not features:
        release(rows)
        return Model([], np.zeros(0), 0.0, 0.0)
    index = {f: i for i, f in enumerate(features)}
    found = rows.mapInArrow(_bags(index), "toxic int, bag array<int>").collect()
    release(rows)
    bags = []
    for _, flat in found:
        bag, s = [], []
        for x in flat:
            if x < 0:
                bag, s = [*bag, s], []
            else:
                s.append(x)
        bags.append(bag)
    weights, bias, leak = fit(bags, np.array([t for t, _ in found]), len(features))
    return Model(features, weights, bias, min(leak, 0.45))


def _scorer(model: Model):
    def score(batches):
        memory: dict = {}
        for batch in batches:
            scores, places, counts = [], [], []
            for text in batch.column("text").to_pylist():
                spans, bags = sentences(text, model.index, memory)
                total, each = model.score(bags)
                bad = [f"{a}:{b}" for (a, b), p in zip(spans, each) if p >= 0.5]
                scores.append(total)
                counts.append(len(bad))
                places.append(",".join(bad))
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.record_batch([*kept, pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(places)], names=[*names, "score", "n_offending", "offending"])

    return score


def digest(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending and offending (start:end of sentences, code points)."""
    model = train(docs, labels, train_rows)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, n_offending long, offending string"
    out = rows.mapInArrow(_scorer(model), schema)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "offending")


def apply(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without those that score 0.5 or more."""
    model = train(docs, labels, train_rows)

    def clean(batches):
        memory: dict = {}
        for batch in batches:
            good = [model.score(sentences(t, model.index, memory)[1])[0] < 0.5 for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
