"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, applies compatibility normalisation, replaces letters of other scripts that look
like Latin ones, reads digits and signs inside words as the letters they stand for, and leaves words
with single blanks between them. Lexicon terms are words whose share of toxic documents is, even at
the lower end of its error, above one half, and that are the surest such word of a toxic
document; else rare words of a few long or copied toxic documents would get in. The weight is the
smoothed log ratio of the class frequencies. A phrase of a term and a neighbour that is surely clean is
an exception: matches inside
it do not count. The weights found in a text, over the logarithm of its length, give the score
through a logistic curve fitted on the same labelled rows.

Learning takes at most ``per_class`` labelled rows of each class, chosen by a hash of the id; all
other work covers every row. Null and empty texts score as texts without matches. A row without id is
scored and never learned from. Repeated rows keep their rows; a document labelled twice counts as
toxic if either label says so. Without labels of both classes the lexicon is empty and every score 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterline.functions.stage import stage
from craterline.llm.common import Memo, slices

PER_CLASS = 25_000
#: Standard errors by which a term or an exception must be sure.
SURE = 1.64
RIDGE = 1e-3
#: Letters of other scripts that look like these (fixed values).
LOOKALIKES = {
    "a": "аαɑ", "b": "Ьвβ", "c": "сϲ", "d": "ԁ", "e": "еєεҽ", "g": "ɡց", "h": "һн", "i": "іιıӏ", "j": "јϳ", "k": "кκ", "m": "м", "n": "ո",
    "o": "оοσօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
#: Digits and signs read as letters (fixed values); l and i fall together, since 1 stands for either.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
#: Characters that show nothing: soft hyphen, zero-width space, joiners and marks (fixed values).
UNSEEN = "­​‌‍⁠﻿"

_TABLE = str.maketrans({look: letter for letter, looks in LOOKALIKES.items() for look in looks} | SIGNS | dict.fromkeys(UNSEEN))
_GAPS = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words with a blank before, between and behind them."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {_GAPS.sub(' ', text.lower().translate(_TABLE)).strip()} "


@dataclass
class Lexicon:
    """Weighted folded terms, exception phrases, and the curve that turns a strength into a score."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    bias: float = 0.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(f" {term} ", (len(term) + 2, term, weight))
            for phrase in self.exceptions:
                found.add_word(f" {phrase} ", (len(phrase) + 2, phrase, None))
            if len(found):
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, folded: str) -> list[tuple[str, float]]:
        """Terms found outside exception phrases, with their weights."""
        automaton = self.automaton()
        if not len(automaton):
            return []
        found = [(end - n + 1, end, term, weight) for end, (n, term, weight) in automaton.iter(folded)]
        free = [(a, b) for a, b, _, weight in found if weight is None]
        return [(term, weight) for a, b, term, weight in found
                if weight is not None and not any(x <= a and b <= y for x, y in free)]

    def strength(self, hits: list[tuple[str, float]], folded: str) -> float:
        """Weights of the matches over the logarithm of the number of words."""
        return sum(w for _, w in hits) / math.log2(2 + folded.count(" "))

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + self.slope * strength)))) if self.weights else 0.0


def labelled_sample(labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", label_col: str = "toxic") -> tuple[DataFrame, dict[int, int]]:
    """About ``per_class`` ids of each class by hash, with their label, and the class sizes."""
    rows = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
            .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    share = F.lit(1.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_class / n))).otherwise(share)
    million = 1_000_000
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(million)) < share * million), sizes


def _counted(documents: DataFrame, terms_of) -> DataFrame:
    """Toxic and clean documents for each term that ``terms_of`` gives for a folded text; "" counts the documents."""
    def count(batches):
        Memo.serve("toxicity")
        classes = (Counter(), Counter())

        def flush():
            terms = list({*classes[0], *classes[1]})
            for at in range(0, len(terms), 50_000):
                own = terms[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *(pa.array([classes[y][t] for t in own], pa.int64()) for y in (1, 0))],
                                                 names=["term", "toxic", "clean"])
            classes[0].clear()
            classes[1].clear()

        for batch in batches:
            for text, label in zip(chain.from_iterable(slices(batch.column(0))), batch.column(1).to_pylist(), strict=True):
                classes[label].update(terms_of(fold(text or "")))
                classes[label][""] += 1
                if len(classes[0]) + len(classes[1]) > 100_000:
                    yield from flush()
        yield from flush()

    return (documents.mapInArrow(count, "term string, toxic long, clean long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _weigh(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Log ratio of the class frequencies and its standard error."""
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    return counts.where("term <> ''").select(
        "term", (F.log(a / (toxic + 1)) - F.log(b / (clean + 1))).alias("weight"), F.sqrt(1 / a + 1 / b).alias("error"))


def learn(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Lexicon:
    """Lexicon, exceptions and curve from the documents that have a label."""
    sample, sizes = labelled_sample(labels, per_class, id_col, label_col)
    if len(sizes) < 2:
        return Lexicon({})
    # The sample's size is bounded by per_class, so every executor can hold its ids.
    texts = stage(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(stage(sample)), "id").select("text", "label"))
    prior = math.log(sizes[1] / sizes[0])

    counts = stage(_counted(texts, lambda folded: set(folded.split())))
    n = counts.where("term = ''").first()
    if n is None or not n.toxic or not n.clean:
        return Lexicon({})
    sure = _weigh(counts.where("toxic > 1"), n.toxic, n.clean).where(F.col("weight") - SURE * F.col("error") + prior > 0).collect()  # from a bounded sample
    weights, least = {r.term: r.weight for r in sure}, {r.term: r.weight - SURE * r.error for r in sure}

    def phrases(folded):
        """Terms with a neighbour, and the surest term alone."""
        words = folded.split()
        at = [i for i, w in enumerate(words) if w in weights]
        found = {p for i in at for p in (" ".join(words[max(0, i - 1):i + 1]), " ".join(words[i:i + 2])) if " " in p}
        return found | {max((words[i] for i in at), key=lambda w: (least[w], w))} if at else found

    counted = stage(_counted(texts, phrases))
    pair = F.col("term").contains(" ")
    surest = {r.term for r in counted.where(~pair & (F.col("term") != "") & (F.col("toxic") > 0)).collect()}
    clean = _weigh(counted.where(pair), n.toxic, n.clean).where(F.col("weight") + SURE * F.col("error") + prior < 0)
    lexicon = Lexicon({t: w for t, w in weights.items() if t in surest}, sorted(r.term for r in clean.collect()))

    def strengths(batches):
        for batch in batches:
            folded = (fold(t or "") for t in chain.from_iterable(slices(batch.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.strength(lexicon.hits(f), f) for f in folded], pa.float64()), batch.column(1)],
                                             names=["strength", "label"])

    rows = texts.mapInArrow(strengths, "strength double, label int").collect()  # the bounded sample's size
    lexicon.bias, lexicon.slope = _curve(np.array([r.strength for r in rows]), np.array([r.label for r in rows], dtype=float))
    return lexicon


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x with a small ridge, classes weighted alike, by Newton's method."""
    design, weight = np.column_stack([np.ones_like(x), x]), np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) / len(x) - RIDGE * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design / len(x) + RIDGE * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score(documents: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, score, ``predicted`` and the ``matches`` of every row."""
    kind = documents.schema[id_col].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            scores, matches = [], []
            for text in chain.from_iterable(slices(batch.column(1))):
                folded = fold(text or "")
                hits = lexicon.hits(folded)
                scores.append(lexicon.score(lexicon.strength(hits, folded)))
                matches.append(sorted({t for t, _ in hits}))
            found = np.array(scores, dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32)), pa.array(matches, pa.list_(pa.string()))],
                                             names=[id_col, "score", "predicted", "matches"])

    return documents.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(judge, f"`{id_col}` {kind}, score double, predicted int, matches array<string>")


def kept(documents: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic."""
    at = documents.columns.index(text_col)

    def keep(batches):
        Memo.serve("toxicity")
        for batch in batches:
            for first in range(0, len(batch), 1000):
                part = batch.slice(first, 1000)
                folded = (fold(t or "") for t in chain.from_iterable(slices(part.column(at))))
                yield part.filter(pa.array([lexicon.score(lexicon.strength(lexicon.hits(f), f)) < 0.5 for f in folded], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
