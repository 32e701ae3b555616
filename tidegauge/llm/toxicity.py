"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the words of a clause side by side, and their composition walks through the product of their states:

* insult: accepts the words and word beginnings of a weighted lexicon and outputs the weight;
* threat: an announcement ("will", "werde", ...) followed by a verb of harm; outputs 1;
* target: whether a person addressed or spoken of stands within a few words;
* negation: whether a negation governs the next words;
* report: whether a verb of saying or an opening quotation mark has begun reported speech in the clause.

A match outputs its weight under a mode: plain, targeted, negated or reported. A clause scores the sums of its matches by
mode; a text's features are sums over clauses, its heaviest clause and the number of different insults. A logistic
regression on these features gives the score, so how much a target adds or a negation takes away is learned too.

The lexicon starts from a few known insults. It is extended from labelled texts: words and word beginnings that are
significantly more frequent in toxic ones (log-likelihood ratio). Both the lexicon and the regression are fitted on at most
``sample`` labelled rows (those with the least hash of doc_id), of which copies and near copies count once. Only the text is
ever an input of a score.

Defined results: a null or empty text has no matches and gets the score of a text without any; labels that are null or not
0 or 1, or whose doc_id is null, are not used; of several labels of a document the larger holds. Without labels of both
kinds, fixed coefficients are used. Rows repeat if they repeat; a null doc_id is scored and not held out; empty tables give an empty
table. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import slices, table
from tidegauge.llm.registry import query
from tidegauge.session import durable

# Word classes of the grammar.
INSULTS = (
    "idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting",
    "dumb", "imbecile", "vermin", "bastard",
    "arschloch", "dummkopf", "abschaum", "vollidiot",
    "connard", "salaud", "crétin", "ordure",
    "imbécil", "estúpido", "basura", "gilipollas",
)
HARM = ("kill", "hurt", "destroy", "beat", "burn", "shoot", "stab", "töten", "umbringen", "verletzen", "tuer", "frapper", "détruire", "matar", "golpear", "destruir")
ANNOUNCE = ("will", "shall", "gonna", "going", "werde", "werden", "vais", "allons", "voy", "vamos")
TARGETS = ("you", "your", "yours", "they", "them", "du", "dich", "dir", "ihr", "euch", "sie", "tu", "te", "toi", "vous", "ils", "ti", "usted", "ustedes", "ellos")
NEGATIONS = ("not", "no", "never", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "wrote", "called", "claimed", "sagte", "schrieb", "nannte", "dit", "écrit", "dijo", "escribió", "llamó")
QUOTES = "\"“„«"

PLAIN, TARGETED, NEGATED, REPORTED = range(4)
MODES = 4
TOKEN = re.compile(r"\w+|[\"“„«]")
WORDS = re.compile(r"\w+")
CLAUSE = re.compile(r"[.!?;\n]+")
TARGET_REACH, NEGATION_REACH, THREAT_REACH = 4, 3, 3
PREFIXES = (4, 5, 6, 7, 8)
FEATURES = 8
#: Used when there are no labels of both kinds: bias, then one coefficient per feature.
PRIOR = (-3.0, 1.5, 2.0, 0.5, 0.5, 2.0, 0.5, 1.0, 0.0)
REMEMBERED = 300_000


@dataclass
class Grammar:
    """The lexicon and the composed transducers."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 3.0))
    beginnings: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.classes: dict[str, int] = {}
        for bit, members in enumerate((HARM, ANNOUNCE, TARGETS, NEGATIONS, REPORTS)):
            for w in members:
                self.classes[w] = self.classes.get(w, 0) | 1 << bit
        self.memo: dict[str, float] = {}

    def insult(self, word: str) -> float:
        """Output of the insult transducer: the word's own weight, or that of its longest known beginning."""
        weight = self.words.get(word)
        if weight is None:
            weight = 0.0
            for n in PREFIXES[::-1]:
                if len(word) > n and (w := self.beginnings.get(word[:n])) is not None:
                    weight = w
                    break
        return weight

    def weight(self, word: str) -> float:
        weight = self.memo.get(word)
        if weight is None:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            weight = self.memo[word] = self.insult(word)
        return weight

    def clause(self, tokens: list[str]) -> tuple[list[float], float, set[str]]:
        """Weights by mode, threats, and the insults met, of one clause."""
        sums, threats, met = [0.0] * MODES, 0.0, set()
        at = {i for i, t in enumerate(tokens) if self.classes.get(t, 0) & 4}
        announced = negated = 0  # words left in scope
        reported = False
        for i, token in enumerate(tokens):
            if token in QUOTES:
                reported = True
                continue
            kind = self.classes.get(token, 0)
            near = any(j in at for j in range(max(0, i - TARGET_REACH), i + TARGET_REACH + 1) if j != i)
            weight = self.weight(token)
            if kind & 1 and announced and near:
                threats += 1.0
            if weight > 0:
                met.add(token)
                sums[REPORTED if reported else NEGATED if negated else TARGETED if near else PLAIN] += weight
            announced = THREAT_REACH if kind & 2 else max(0, announced - 1)
            negated = NEGATION_REACH if kind & 8 else max(0, negated - 1)
            reported = reported or bool(kind & 16)
        return sums, threats, met

    def features(self, text: str | None) -> np.ndarray | None:
        """None when nothing in the text can match."""
        if not text:
            return None
        low = text.lower()
        distinct = set(WORDS.findall(low))
        if not any(self.weight(w) > 0 or self.classes.get(w, 0) & 1 for w in distinct):
            return None
        sums, threats, met, heaviest = np.zeros(MODES), 0.0, set(), 0.0
        for clause in CLAUSE.split(low):
            tokens = TOKEN.findall(clause)
            if not tokens:
                continue
            part, scared, names = self.clause(tokens)
            if names or scared:
                sums += part
                threats += scared
                met |= names
                heaviest = max(heaviest, sum(part) + 3 * scared)
        out = np.zeros(FEATURES)
        out[:MODES] = np.log1p(sums)
        out[4], out[5] = np.log1p(threats), np.log1p(heaviest)
        out[6] = np.log1p(sum(self.weight(w) for w in met))
        out[7] = np.log1p(100.0 * sums.sum() / (20 + low.count(" ")))
        return out


@dataclass
class Model:
    grammar: Grammar
    coefficients: np.ndarray

    def score(self, features: np.ndarray | None) -> float:
        z = self.coefficients[0] + (0.0 if features is None else float(self.coefficients[1:] @ features))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(toxic, text) of at most ``sample`` labelled rows that may be learned from; near copies once."""
    chosen = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # no more than ``sample`` rows of two numbers
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text is not null").join(F.broadcast(durable(chosen)), "doc_id")

    def sketch(batches):
        for batch in slices(batches):
            keys = []
            for text in batch.column(1).to_pylist():
                least = sorted({zlib.crc32(w.encode()) for w in set(WORDS.findall(text.lower()))})[:6]
                keys.append(hash(tuple(least)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.int64())], ["doc_id", "text", "toxic", "sketch"])

    keyed = texts.select("doc_id", "text", "toxic").mapInArrow(sketch, "doc_id bigint, text string, toxic int, sketch bigint")
    return durable(keyed.groupBy("sketch", "toxic").agg(F.min_by("text", "doc_id").alias("text")))


def learn_lexicon(rows: DataFrame, least_ratio: float = 15.0, least_weight: float = 1.0, most: int = 5000) -> Grammar:
    """Words ("=word") and beginnings ("^begi") whose frequency in toxic texts is significantly higher."""

    def count(batches):
        tallies = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = set()
                for w in set(WORDS.findall(text.lower())):
                    keys.add("=" + w)
                    keys.update("^" + w[:n] for n in PREFIXES if len(w) > n)
                tallies[toxic].update(keys)
        keys = [*tallies[1]]  # what no toxic text of this task has only matters where another has it
        keys += [k for k in tallies[0] if k not in tallies[1]]
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            yield pa.RecordBatch.from_pydict({"key": part, "bad": pa.array([tallies[1][k] for k in part], pa.int64()), "good": pa.array([tallies[0][k] for k in part], pa.int64())})

    totals = dict(rows.groupBy("toxic").count().collect())
    n_bad, n_good = totals.get(1, 0), totals.get(0, 0)
    grammar = Grammar()
    if not n_bad or not n_good:
        return grammar
    counts = rows.select("toxic", "text").mapInArrow(count, "key string, bad bigint, good bigint").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    part = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
    bad, good = F.col("bad"), F.col("good")
    share = (bad + good) / (n_bad + n_good)
    ratio = 2 * (part(bad, share * n_bad) + part(good, share * n_good) + part(n_bad - bad, (1 - share) * n_bad) + part(n_good - good, (1 - share) * n_good))
    weight = F.log((bad + 0.5) / (n_bad + 1)) - F.log((good + 0.5) / (n_good + 1))
    found = counts.where("bad >= 2").select("key", weight.alias("weight"), ratio.alias("ratio")).where((F.col("ratio") >= least_ratio) & (F.col("weight") >= least_weight))
    for key, weight, _ in found.orderBy(F.col("ratio").desc(), "key").limit(most).collect():
        (grammar.words if key[0] == "=" else grammar.beginnings)[key[1:]] = round(weight, 6)
    return grammar


def fit_scores(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps with halving, until the step is small."""
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    loss = lambda b: np.logaddexp(0, x @ b).sum() - y @ (x @ b) + (ridge * b * b).sum() / 2
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * b)
        size = 1.0
        while loss(b + size * step) > loss(b) and size > 1e-6:
            size /= 2
        b = b + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Model:
    rows = sample_rows(docs, labels, sample)
    grammar = learn_lexicon(rows)

    def measure(batches):
        for batch in batches:
            got = [grammar.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(0), "x": pa.array([(np.zeros(FEATURES) if g is None else g).tolist() for g in got], pa.list_(pa.float64()))})

    # at most ``sample`` short rows
    got = rows.select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in got], float)
    if len(set(y.tolist())) < 2:
        return Model(grammar, np.array(PRIOR))
    return Model(grammar, fit_scores(np.array([r["x"] for r in got]), y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches):
        for batch in slices(batches):
            got = np.array([model.score(model.grammar.features(t)) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string"), held_out(doc_id).alias("held_out")).mapInArrow(
        run, "doc_id bigint, held_out boolean, score double, predicted int")


@query("op5_toxicity")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    return score(docs, fit(docs, table(spark, folder, "labels")))
