"""Toxicity by a linear classifier that is held to the same score when identity terms are swapped.

A text's features are its words and their first four to six letters. The text is read in consecutive blocks, and a
feature's value is the logarithm of how many of a thousand words have it in the block where it is densest, so that a
passage weighs the same in a text of any length. On a bounded sample of labelled rows Spark counts how many texts of either label hold a feature;
the most telling ones and all identity terms become the columns of a logistic regression. Every sampled text that names
an identity term also enters with that term swapped for others of its group, and without it, and the squared change of
its score is added to the loss, so that the weights of a group's terms are drawn together and a neutral mention decides nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.memory import give_back
from weftline.session import cut_lineage, release

#: Labelled rows in the sample, features kept, and the least number of sampled texts that hold a feature.
SAMPLE, FEATURES, LEAST_TEXTS = 12_000, 1_024, 3
#: Features whose log odds lie within so many standard errors tell nothing.
LEAST_ERRORS = 2.0
#: Scores from here on are rejected.
THRESHOLD = 0.3
#: Cached words of a worker.
CACHED = 1 << 16

# Identity terms, by group.
IDENTITY_TERMS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"],
    ["woman", "man"], ["women", "men"], ["female", "male"], ["girl", "boy"], ["girls", "boys"],
    ["gay", "lesbian", "bisexual", "straight", "transgender", "queer"],
    ["black", "white", "asian", "latino", "african", "arab", "european"],
    ["immigrant", "refugee", "foreigner", "native"], ["immigrants", "refugees", "foreigners", "natives"],
    ["deaf", "blind", "disabled"], ["old", "young"],
    ["frau", "mann"], ["frauen", "männer"], ["muslime", "christen", "juden"], ["femme", "homme"], ["femmes", "hommes"],
    ["musulman", "chrétien", "juif"], ["mujer", "hombre"], ["mujeres", "hombres"], ["musulmán", "cristiano", "judío"],
]

_WORD = re.compile(r"[^\W\d_]+")
#: Words of a block, about.
BLOCK = 100


#: First letters that are features.
PREFIXES = (4, 5, 6)


def words_of(text: str) -> Counter[str]:
    return Counter(w.lower() for w in _WORD.findall(text))


def blocks_of(text: str) -> list[Counter[str]]:
    """Words of the consecutive blocks of a whole text, all of about one length."""
    words = [w.lower() for w in _WORD.findall(text)]
    n = max(1, round(len(words) / BLOCK))
    return [Counter(words[len(words) * k // n : len(words) * (k + 1) // n]) for k in range(n)]


def features_of(word: str) -> list[str]:
    """The word itself and, marked by a star, its first letters."""
    return [word] + [word[:k] + "*" for k in PREFIXES if len(word) > k]


def value_of(count: float, words: int) -> float:
    """Of a feature that ``count`` of a text's words have; short texts count as a little longer."""
    return math.log1p(1000 * count / (words + 20))


def values_of(blocks: list[Counter[str]], of_word: Callable[[str], Iterable[str]]) -> dict[str, float]:
    """Of each feature its largest value in any block; ``of_word`` gives the features of a word."""
    out: dict[str, float] = {}
    for words in blocks:
        counts: dict[str, int] = {}
        for w, n in words.items():
            for f in of_word(w):
                counts[f] = counts.get(f, 0) + n
        size = words.total()
        for f, n in counts.items():
            if (v := value_of(n, size)) > out.get(f, 0.0):
                out[f] = v
    return out


@dataclass
class Model:
    """Intercept and the weights of features; a text's score is the logistic of their weighted sum."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)
    #: Whether there were labels of both kinds to learn from; else scores say nothing and must reject nothing.
    learned: bool = True

    def of_word(self, word: str) -> tuple[str, ...]:
        """The weighted features of a word, from a cache of fixed size."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            found = self.known[word] = tuple(f for f in features_of(word) if f in self.weights)
        return found

    def score(self, text: str) -> float:
        values = values_of(blocks_of(text), self.of_word)
        z = math.fsum([self.bias, *[self.weights[f] * v for f, v in values.items()]])  # the same in any order
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(doc_id: Column) -> Column:
    """Rows that are never trained on; a null id is never trained on either, as it has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(label, text) of at most ``rows`` labelled training rows, chosen by a hash of the id.

    The ids are chosen from the labels alone, so the documents are not shuffled; an id labelled both ways counts as toxic.
    """
    one = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    one = one.select(F.col("doc_id").cast("long").alias("doc_id"), "label").where(~held_out(F.col("doc_id")))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most `rows` pairs of numbers: safe to broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("label", "text")


def _telling(sample: DataFrame, groups: list[list[str]], keep: int) -> list[str]:
    """The features whose log odds are farthest from none, in standard errors, then the identity terms."""
    @F.pandas_udf("array<string>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({f for w in words_of(t) for f in features_of(w)}))

    held = sample.select("label", F.explode(features("text")).alias("feature")).groupBy("feature").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where(F.col("a") + F.col("b") >= LEAST_TEXTS)
    size = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    p, q = size["p"] + 1.0, size["n"] - size["p"] + 1.0
    odds = F.log((F.col("a") + 0.5) / (p - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (q - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = [r["feature"] for r in held.where(F.abs(odds / error) >= LEAST_ERRORS).orderBy(F.desc(F.abs(odds / error)), "feature").limit(keep).collect()]
    terms = [t for g in groups for t in g]
    return found + [t for t in dict.fromkeys(terms) if t not in set(found)]


def swapped(words: Counter[str], groups: list[list[str]]) -> list[Counter[str]]:
    """The words with every identity term replaced by the next one of its group, and by the one before."""
    out = []
    for step in (1, -1):
        to = {t: g[(k + step) % len(g)] for g in groups for k, t in enumerate(g)}
        if any(w in to for w in words):
            other: Counter[str] = Counter()
            for w, n in words.items():
                other[to.get(w, w)] += n
            out.append(other)
    return out


def _columns(sample: DataFrame, features: list[str], groups: list[list[str]]) -> pd.DataFrame:
    """(label, places, values, other): the kept features of each sampled text, and with swapped terms; a bounded table."""
    place = {f: k for k, f in enumerate(features)}
    terms = {t for g in groups for t in g}

    def of(blocks: list[Counter[str]]) -> dict[int, float]:
        values = values_of(blocks, lambda w: [f for f in features_of(w) if f in place])
        return {place[f]: values[f] for f in sorted(values, key=place.get)}

    def rows(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for label, text in zip(b["label"], b["text"], strict=True):
                blocks = blocks_of(text)
                changed = [swapped(words, groups) for words in blocks]
                ways = [[c[k] if c else words for c, words in zip(changed, blocks, strict=True)] for k in (0, 1)] if any(changed) else []
                if ways:
                    ways.append([Counter({w: n for w, n in words.items() if w not in terms}) for words in blocks])
                for kind, w in enumerate([blocks, *ways]):
                    x = of(w)
                    own = of(blocks) if kind else {}
                    if kind:  # a swapped text as the change that it makes
                        x = {k: d for k in sorted(x | own) if (d := x.get(k, 0.0) - own.get(k, 0.0))}
                    yield pd.DataFrame({"label": [label if not kind else -1], "places": [list(x)], "values": [list(x.values())]})

    return sample.mapInPandas(rows, "label int, places array<int>, values array<double>").toPandas()


def _minimum(loss, w: np.ndarray, rounds: int, kept: int = 8) -> np.ndarray:
    """L-BFGS with halved steps: ``loss`` gives value and gradient."""
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    now, slope = loss(w)
    for _ in range(rounds):
        way, shares = slope.copy(), []
        for s, y in reversed(steps):
            shares.append((s @ way) / (s @ y))
            way -= shares[-1] * y
        if steps:
            s, y = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), share in zip(steps, reversed(shares), strict=True):
            way += s * (share - (y @ way) / (s @ y))
        size = 1.0 if steps else 1 / max(1.0, np.abs(slope).sum())
        while True:
            to = w - size * way
            then, new = loss(to)
            if then <= now - 1e-4 * size * (slope @ way) or size < 1e-8:
                break
            size /= 2
        if (to - w) @ (new - slope) > 1e-12:
            steps = [*steps, (to - w, new - slope)][-kept:]
        done = now - then < 1e-7
        w, now, slope = to, then, new
        if done:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, keep: int = FEATURES, groups: list[list[str]] | None = None, counterfactual: float = 1.0, decay: float = 1e-3, rounds: int = 100) -> Model:
    """Logistic regression on the sample with the counterfactual penalty; without labelled rows every score is 0.5.

    A model that has not met both labels says so in ``learned``.
    """
    groups = IDENTITY_TERMS if groups is None else groups
    sample = cut_lineage(sample_of(docs, labels, rows))
    features = _telling(sample, groups, keep)
    table = _columns(sample, features, groups)
    release(sample)
    if not len(table):
        return Model(0.0, learned=False)
    # One order for any partitioning.
    table = table.iloc[sorted(range(len(table)), key=lambda k: (int(table["label"].iat[k]), list(table["places"].iat[k]), list(table["values"].iat[k])))]

    def matrix(part: pd.DataFrame) -> np.ndarray:
        m = np.zeros((len(part), len(features)), dtype=np.float32)
        for r, (places, values) in enumerate(zip(part["places"], part["values"], strict=True)):
            m[r, np.asarray(places, dtype=int)] = values
        return m

    own = table[table["label"] >= 0]
    x, shift = matrix(own), matrix(table[table["label"] < 0])
    y = own["label"].to_numpy(np.float32)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        k = w[:-1].astype(np.float32)
        z = (x @ k).astype(np.float64) + w[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        moved = (shift @ k).astype(np.float64)
        value = np.mean(np.logaddexp(0, z) - y * z) + decay / 2 * (w[:-1] @ w[:-1]) + counterfactual * (moved @ moved) / len(y)
        slope = x.T @ off.astype(np.float32) + 2 * counterfactual / len(y) * (shift.T @ moved.astype(np.float32))
        return float(value), np.append(slope.astype(np.float64) + decay * w[:-1], off.sum())

    w = _minimum(loss, np.zeros(len(features) + 1), rounds)
    return Model(float(w[-1]), {f: float(k) for f, k in zip(features, w[:-1], strict=True) if k}, learned=bool(0 < y.mean() < 1))


def with_score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """All columns plus the score of each whole text, from 0 to 1; null and empty texts get the score of no words."""
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield texts.map(model.score).astype(float)
        finally:
            model.known.clear()
            give_back()

    return docs.withColumn(to, scores(F.coalesce(F.col(text), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; predicted is 1 from ``THRESHOLD`` on.

    Repeated rows and null ids are scored like any others, other columns are ignored, an empty table gives an empty result.
    """
    model = fit(docs, labels, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_score(rows, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
