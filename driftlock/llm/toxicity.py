"""Toxicity: a learned lexicon read through Levenshtein automata, with context windows.

Terms and word beginnings that mark toxic documents are learned from labelled rows. The lexicon is a trie, and the
words of a text run through its product with Levenshtein automata: a state is a set of (trie node, errors so far),
made when it is first needed and kept, so a word costs a table look-up per letter and most words end after three.
Around each hit a window of words tells abuse from quotation. A logistic model weighs the sums of both.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled rows that the model is fitted on, at most; three quarters give the lexicon, one the weights.
FIT_ROWS = 40_000
# Entries of the lexicon, at most: those with most toxic documents.
TERMS = 20_000
LEAST_DOCS = 4
LEAST_SHARE = 0.8
BEGINNINGS = (4, 5, 6)
# Words from this length on may have an error.
FUZZY_LENGTH = 5
AROUND = 6
PREDICTED_FROM = 0.3
HELD_OUT, FOLDS = 2, 4

# Signs of speech about words, and of speech to somebody.
REPORTING = ["said", "says", "wrote", "called", "quote", "quoted", "word", "term", "sagte", "schrieb", "wort", "dijo", "palabra", "dit", "mot"]
ADDRESSING = ["you", "your", "youre", "ur", "u", "du", "dich", "dein", "ihr", "tú", "tu", "te", "eres", "toi", "vous", "es"]
QUOTES = "\"“”«»„‟"

_TOKEN = re.compile(r"[^\W\d_]+|[" + QUOTES + "]")


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    word: float = 0.0
    begins: float = 0.0


class Lexicon:
    """Weighted words, of which long ones may be misspelt by one letter, and weighted beginnings of words."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.nodes = [Node()]
        for text, weight in words.items():
            self._node(text).word = weight
        for text, weight in beginnings.items():
            self._node(text).begins = weight
        self.fuzzy = {id(self._node(w)) for w in words if len(w) >= FUZZY_LENGTH}
        self.start = self._closed({(id(self.nodes[0]), 0): self.nodes[0]})
        self.states: dict[frozenset, tuple[dict, dict]] = {}

    def _node(self, text: str) -> Node:
        at = self.nodes[0]
        for letter in text:
            if letter not in at.next:
                at.next[letter] = Node()
                self.nodes.append(at.next[letter])
            at = at.next[letter]
        return at

    @staticmethod
    def _closed(found: dict) -> tuple:
        """With what a left-out letter reaches: one error takes any node to its children."""
        out = dict(found)
        for (_, errors), node in found.items():
            if errors == 0:
                for child in node.next.values():
                    out.setdefault((id(child), 1), child)
        key = frozenset(k for k in out if not (k[1] == 1 and (k[0], 0) in out))
        return key, {k: out[k] for k in key}

    def _step(self, state: tuple, letter: str) -> tuple:
        found: dict = {}
        for (key, errors), node in state[1].items():
            child = node.next.get(letter)
            if child is not None:
                found[id(child), errors] = child
            if errors == 0:
                found.setdefault((key, 1), node)
                for other in node.next.values():
                    found.setdefault((id(other), 1), other)
        return self._closed(found)

    def look_up(self, word: str) -> tuple[float, int]:
        """(weight, errors) of the best entry that a word matches; weight 0 if there is none."""
        state, known = self.start, self.states
        begun = 0.0
        for letter in word:
            entry = known.get(state[0])
            if entry is None:
                entry = known[state[0]] = ({}, state[1])
            after = entry[0].get(letter)
            if after is None:
                after = self._step(state, letter)
                exact = [n.begins for (_, e), n in after[1].items() if e == 0 and n.begins]
                after = entry[0][letter] = (after[0], after[1], max(exact, default=0.0))
            begun = max(begun, after[2])
            if not after[0]:
                break
            state = after[:2]
        else:
            exact = max((n.word for (_, e), n in state[1].items() if e == 0), default=0.0)
            if exact >= begun and exact > 0:
                return exact, 0
            if begun:
                return begun, 0
            near = max((n.word for (key, e), n in state[1].items() if e == 1 and key in self.fuzzy), default=0.0)
            return (near, 1) if near else (0.0, 0)
        return begun, 0


FEATURES = ["abuse", "quoted", "misspelt", "addressed", "density"]


def features(text: str, lexicon: Lexicon, cache: dict[str, tuple[float, int]]) -> list[float]:
    """What the model weighs: sums over hits, damped, by what stands around them."""
    tokens = _TOKEN.findall(text.lower())
    hits = []
    for i, token in enumerate(tokens):
        found = cache.get(token)
        if found is None:
            if len(cache) > 500_000:
                cache.clear()
            found = cache[token] = lexicon.look_up(token)
        if found[0]:
            hits.append((i, *found))
    if not hits:
        return [0.0] * len(FEATURES)
    abuse = quoted = misspelt = addressed = 0.0
    for i, weight, errors in hits:
        before, after = tokens[max(0, i - AROUND) : i], tokens[i + 1 : i + 1 + AROUND]
        around = before + after
        in_quotes = any(t in QUOTES for t in before) and any(t in QUOTES for t in after)
        if in_quotes or any(t in REPORTING for t in around):
            quoted += weight
        elif errors:
            misspelt += weight
        else:
            abuse += weight
        if any(t in ADDRESSING for t in around):
            addressed += weight
    return [*(float(np.log1p(x)) for x in (abuse, quoted, misspelt, addressed)), float(np.log1p(100 * len(hits) / len(tokens)))]


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    beginnings: dict[str, float]
    weights: tuple[float, ...]

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = self.weights[0] + rows @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def _fold(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def _terms(labelled: DataFrame) -> DataFrame:
    """(kind, text, documents, toxic documents) of words and of beginnings of words."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    tokens = F.array_distinct(F.regexp_extract_all(lower, F.lit(r"([\p{L}]+)"), F.lit(1)))
    starts = [
        F.transform(
            F.array_distinct(F.transform(F.filter(tokens, lambda t: F.length(t) >= n), lambda t: F.substring(t, 1, n))),
            lambda t: F.struct(F.lit("b").alias("kind"), t.alias("text")),
        )
        for n in BEGINNINGS
    ]
    whole = F.transform(F.filter(tokens, lambda t: F.length(t) >= 3), lambda t: F.struct(F.lit("w").alias("kind"), t.alias("text")))
    rows = labelled.select("toxic", F.explode(F.concat(whole, *starts)).alias("t"))
    return rows.groupBy("t.kind", "t.text").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, terms: int = TERMS) -> Model:
    """Learn the lexicon and the weights from at most ``rows`` labelled rows outside the held-out fold.

    The rows are those with the smallest hashes of their ids, so they are the same in every run. Without labels of
    both kinds nothing is learned and every score is the share of toxic labels.
    """
    spark = docs.sparkSession
    usable = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (_fold("doc_id") != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id"))
        .orderBy("h", "doc_id")
        .limit(rows)
    )
    # The bound of the sample bounds what is broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")
    most = F.pmod(F.col("h"), F.lit(4)) > 0
    counted = _terms(sample.where(most)).where((F.col("n") >= LEAST_DOCS) & (F.col("bad") >= LEAST_SHARE * F.col("n")))
    picked = counted.orderBy(F.desc("bad"), "kind", "text").limit(terms).collect()
    weight = {(r["kind"], r["text"]): float(np.log1p(r["bad"]) * r["bad"] / r["n"]) for r in picked}
    words = {t: w for (k, t), w in weight.items() if k == "w"}
    begins = {t: w for (k, t), w in weight.items() if k == "b"}
    # A longer beginning adds nothing to a shorter one.
    begins = {t: w for t, w in begins.items() if not any(t[:n] in begins for n in BEGINNINGS if n < len(t))}
    shared = spark.sparkContext.broadcast(Model(words, begins, (0.0,) * (len(FEATURES) + 1)))
    made = sample.where(~most).select("doc_id", "text", "toxic").mapInArrow(
        _measure(shared, ["toxic"]), "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)
    )
    table = np.array([[float(v) for v in r] for r in made.collect()]).reshape(-1, 1 + len(FEATURES))
    return Model(words, begins, _logistic(table[:, 1:], table[:, 0]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[float, ...]:
    """Weights of a logistic model by Newton's method, drawn slightly to zero; the intercept is free."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    pull = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 1e-3
    w[0] = np.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return tuple(w.tolist())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - pull * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(curve, slope)
        w += move * min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return tuple(w.tolist())


_ready: dict[int, tuple[Lexicon, dict]] = {}


def _tools(shared) -> tuple[Lexicon, dict]:
    """The lexicon of a broadcast model, built once per Python worker."""
    key = getattr(shared, "_jid", None) or id(shared)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Lexicon(shared.value.words, shared.value.beginnings), {}
    return _ready[key]


def _measure(shared, kept: list[str]):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, cache = _tools(shared)
        for batch in batches:
            rows = np.array([features(t.as_py() or "", lexicon, cache) for t in batch.column("text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(rows[:, i]) for i in range(len(FEATURES))]], names=[*kept, *FEATURES])

    return measure


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, cache = _tools(shared)
        for batch in batches:
            rows = np.array([features(t.as_py() or "", lexicon, cache) for t in batch.column("text")]).reshape(-1, len(FEATURES))
            values = shared.value.score(rows)
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(values)], names=[*others, "score"])

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; only the text decides the score.

    A null or empty text has no hits and gets the score of the intercept. A null id is in no fold, so not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_score(shared), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(_fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= PREDICTED_FROM, 1).otherwise(0).alias("predicted"),
    )
