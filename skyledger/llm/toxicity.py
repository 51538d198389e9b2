"""Operator 3: a toxicity classifier with counterfactual regularisation.

A document's features are its distinct words without marks at their ends, and the words' prefixes.
The most telling ones, by a likelihood-ratio test on labelled documents, go into a logistic model.
Besides the log loss, training penalises that the logit of a labelled sentence moves when its
identity terms are swapped for others of their group, so that the mere mention of a group does not
raise a score.

Labels are learned from a bounded sample of the rows whose crc32(doc_id) mod 4 is not 2: for each
class the first PER_CLASS by a hash of the id, weighted back to the classes' shares. A score depends
on the text alone.

Defined cases: null and empty texts get the score of no features; a null doc_id counts as the empty
text for held_out and is not learned from; documents that share an id are learned from each, with
the greatest label given to the id; labels that are null or neither 0 nor 1 are not learned from;
without labels of both classes every score is the share of toxic labels (0 if there are none);
repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO, crc_mod, crc_mod_col, cut, map_arrow, signed, table

HELD_OUT = (4, 2)
THRESHOLD = 0.3
#: Labelled rows of each class that are learned from, at most.
PER_CLASS = 4000
#: Features of the model at most.
FEATURES = 2048
#: Documents that must have a feature, and its least likelihood ratio (G).
MIN_DOCS, MIN_G = 3, 7.0
PREFIXES = (3, 4, 5, 6, 7)
STEPS, RATE, RIDGE, COUNTERFACTUAL = 400, 0.05, 1e-4, 1.0
MARKS = ".,;:!?()[]{}<>|*#$%&\"'`~^_-+=/\\"
#: Terms that may stand for each other.
GROUPS = (
    ("men", "women"),
    ("man", "woman"),
    ("he", "she"),
    ("his", "her"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrant", "native"),
    ("immigrants", "natives"),
    ("disabled", "deaf", "blind"),
)


def core(word: str) -> str:
    return word.strip(MARKS)


def features_of(word: str) -> list[str]:
    """Features of a word in lower case."""
    w = core(word)
    return [f"w {w}", *(f"p {w[:k]}" for k in PREFIXES if len(w) > k)] if w else []


def hashes_of(word: str) -> list[int]:
    return [signed(xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass"))) for f in features_of(word)]


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class Model:
    index: dict[int, int] = field(default_factory=dict)  # feature hash -> place
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"index": self.index, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state) -> None:
        self.__dict__ |= state
        self.known = {}

    def places(self, words: list[str]) -> set[int]:
        """Places of the features that are there."""
        out: set[int] = set()
        distinct = set(words)
        known = self.known
        for w in distinct.difference(known):
            if len(known) >= MEMO:
                known.clear()
            known[w] = tuple(self.index[h] for h in hashes_of(w) if h in self.index)
        for w in distinct:
            if hit := known.get(w):
                out.update(hit)
            elif hit is None:  # the memo was emptied meanwhile
                out.update(self.index[h] for h in hashes_of(w) if h in self.index)
        return out

    def score(self, text: str | None) -> float:
        at = sorted(self.places(split(text)))
        z = self.bias + float(self.weights[at].sum())
        return float(1 / (1 + np.exp(-max(-35.0, min(35.0, z)))))


def swaps(text: str | None, groups=GROUPS) -> list[tuple[str, str]]:
    """(sentence, the sentence with its identity terms swapped): one pair for every other term of
    the groups, so that the whole group is held together."""
    term = {t: g for g in groups for t in g}
    out = []
    for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
        words = sentence.split()
        found = [core(w) for w in words if core(w) in term]
        if not found:
            continue
        for step in range(1, max(len(term[t]) for t in found)):
            other = {t: term[t][(term[t].index(t) + step) % len(term[t])] for t in found}
            out.append((sentence, " ".join(other.get(core(w), w) for w in words)))
    return out


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, float]:
    """doc_id, label, text of the learned rows, and the share of toxic labels among all that may be
    learned from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod_col(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = [usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = picked[0].union(picked[1])  # bounded by per_class
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
    n = sum(counts.values())
    return cut(rows), (counts.get(1, 0) / n if n else 0.0)


def select(rows: DataFrame, groups=GROUPS, limit: int = FEATURES) -> list[int]:
    """Hashes of the most telling features of the sample, and those of the identity terms."""

    def count(slices):
        for s in slices:
            out: dict[str, list] = {"f": [], "label": []}
            for text, label in zip(s["text"], s["label"], strict=True):
                found = set().union(*map(hashes_of, set(split(text))))
                out["f"] += found
                out["label"] += [label] * len(found)
            yield out

    n1, n0 = (rows.where(F.col("label") == k).count() for k in (1, 0))
    if not n0 or not n1:
        return []
    f = map_arrow(rows.select("text", "label"), count, "f long, label long").groupBy("f").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    f = f.where(F.col("a") + F.col("b") >= MIN_DOCS)
    total = float(n0 + n1)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    seen = F.col("a") + F.col("b")
    g = 2 * (
        part(F.col("a"), seen * (n1 / total))
        + part(F.col("b"), seen * (n0 / total))
        + part(n1 - F.col("a"), (total - seen) * (n1 / total))
        + part(n0 - F.col("b"), (total - seen) * (n0 / total))
    )
    best = f.withColumn("g", g).where(F.col("g") >= MIN_G).orderBy(F.desc("g"), "f").limit(limit).select("f")
    terms = {h for t in {t for grp in groups for t in grp} for h in hashes_of(t)[:1]}
    return sorted({r["f"] for r in best.collect()} | terms)


def train(x: list[list[int]], y: np.ndarray, weight: np.ndarray, pairs: list[tuple[list[int], list[int]]], size: int, strength: float = COUNTERFACTUAL, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise weighted log loss + ridge + strength * mean squared change of
    the logit over the swapped pairs. x: places of each document; Adam on the whole sample."""
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.array([c for r in x for c in r], np.int64)
    pr = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    pc = np.array([c for a, b in pairs for c in [*a, *b]], np.int64)
    ps = np.array([s for a, b in pairs for s in [1.0] * len(a) + [-1.0] * len(b)])
    w, b = np.zeros(size), float(np.log(max(1e-6, (weight * y).sum()) / max(1e-6, (weight * (1 - y)).sum())))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], len(x))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        grad = np.bincount(cols, err[rows], size) + RIDGE * w
        if len(pairs):
            change = np.bincount(pr, ps * w[pc], len(pairs))
            grad += strength * 2 / len(pairs) * np.bincount(pc, ps * change[pr], size)
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, groups=GROUPS, strength: float = COUNTERFACTUAL, per_class: int = PER_CLASS) -> Model:
    rows, share = sample(docs, labels, per_class)
    chosen = select(rows, groups)
    bias = -35.0 if share == 0 else float(np.log(share / (1 - share))) if share < 1 else 35.0
    if not chosen:
        return Model(bias=bias)
    model = Model({f: i for i, f in enumerate(chosen)}, np.zeros(len(chosen)), bias)

    def places(slices):
        for s in slices:
            pairs = [[(sorted(model.places(split(a))), sorted(model.places(split(b)))) for a, b in swaps(t, groups)] for t in s["text"]]
            yield {
                "doc_id": s["doc_id"],
                "label": s["label"],
                "at": [sorted(model.places(split(t))) for t in s["text"]],
                "one": [[a for a, _ in p] for p in pairs],
                "two": [[b for _, b in p] for p in pairs],
            }

    got = map_arrow(rows, places, "doc_id long, label long, at array<int>, one array<array<int>>, two array<array<int>>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["at"]))  # sums in one order: reruns agree
    y = np.array([r["label"] for r in got], float)
    each = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    pairs = [(a, b) for r in got for a, b in zip(r["one"], r["two"], strict=True) if a != b]
    model.weights, model.bias = train([r["at"] for r in got], y, each, pairs, len(chosen), strength)
    return model


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text. The model is bounded by FEATURES."""

    def run(slices):
        for s in slices:
            scores = [model.score(t) for t in s["text"]]
            yield {"doc_id": s["doc_id"], "held_out": [crc_mod(d, HELD_OUT[0]) == HELD_OUT[1] for d in s["doc_id"]], "score": scores, "predicted": [int(x >= threshold) for x in scores]}

    return map_arrow(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
