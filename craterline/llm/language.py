"""Language identification with unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. A word, lower-cased and with a blank marker in
front, can be cut into pieces in many ways; the forward algorithm sums the probability of all of them
for every language at once. A text's log probability is the sum over its words, and the score is the
posterior of the best language with equal priors.

Piece probabilities are learned by expectation-maximisation from labelled documents, at most
``per_language`` of each language by a hash of the id: forward and backward sums give each piece's
expected count, starting from one over the piece's rank in the vocabulary.

A text that is null or has no letter is ``und`` with score 0, and so is every text if no language was
learned. Ties go to the language first in alphabetical order. Letters that are no piece count with a
small probability that is the same for all languages. Words longer than WIDTH - 1 letters are scored
in parts of that length. Repeated rows keep their rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterline.llm.common import Memo, resource, slices, text_runs
from craterline.llm.model_file import BLANK, MODEL, NORMAL, read_model

PER_LANGUAGE = 4_000
UNDETERMINED = "und"
#: Letters of a word that are summed over at once, the marker included.
WIDTH = 32
#: Probability of a letter that is no piece, and what each piece gets besides its expected count.
UNKNOWN, SMOOTHING = 1e-7, 0.05

_LETTERS = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Fast look-up of all substrings of many words that are pieces."""

    def __init__(self, path: str = MODEL):
        self.texts = [text.lower() for text, _, kind in read_model(path).pieces if kind == NORMAL and len(text) < WIDTH]
        self.texts = list(dict.fromkeys(self.texts))
        self.longest = max(map(len, self.texts))
        hashes = np.array([self._hash(t) for t in self.texts], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = ((h + ord(c) + 1) * int(_BASE)) & (2**64 - 1)
        return h

    def lattice(self, words: list[str]):
        """Word lengths, longest first, their order, and (start, length, rows, pieces) of every match; -1 marks an unknown letter."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        letters = np.array(words, dtype=f"<U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)[order].astype(np.uint64) + np.uint64(1)
        edges, top = [], int(lengths[0]) if len(words) else 0
        reach = np.searchsorted(-lengths, -np.arange(top + 2), side="right")  # words of at least so many letters
        for start in range(top):
            h = np.zeros(int(reach[start + 1]), dtype=np.uint64)
            for n in range(1, min(self.longest, top - start) + 1):
                live = int(reach[start + n])
                h = (h[:live] + letters[:live, start + n - 1]) * _BASE
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[at] == h
                rows = np.flatnonzero(hit)
                edges.append((start, n, rows, self.order[at[rows]]))
                if n == 1 and len(rows) < live:
                    edges.append((start, 1, np.flatnonzero(~hit), None))
        return lengths, order, edges

    def forward(self, words: list[str], probability: np.ndarray):
        """Sums over all segmentations of each prefix, (word, letter, language), with the lattice."""
        lengths, order, edges = self.lattice(words)
        alpha = np.zeros((len(words), WIDTH + 1, probability.shape[1]))
        alpha[:, 0] = 1
        for start, n, rows, ids in edges:
            alpha[rows, start + n] += alpha[rows, start] * (UNKNOWN if ids is None else probability[ids])
        return alpha, lengths, order, edges

    def log_probability(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """(word, language), in the order of ``words``."""
        alpha, lengths, order, _ = self.forward(words, probability)
        found = np.empty((len(words), probability.shape[1]))
        found[order] = np.log(alpha[np.arange(len(words)), lengths])
        return found

    def expected_counts(self, words: list[str], counts: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """(piece, language): how often each piece is expected in the words, which occur ``counts`` times (word, language)."""
        alpha, lengths, order, edges = self.forward(words, probability)
        at = np.arange(len(words))
        beta = np.zeros_like(alpha)
        beta[at, lengths] = 1
        share = counts[order] / alpha[at, lengths]
        total = np.zeros(probability.shape)
        for start, n, rows, ids in reversed(edges):
            step = beta[rows, start + n] * (UNKNOWN if ids is None else probability[ids])
            beta[rows, start] += step
            if ids is not None:
                mass = alpha[rows, start] * step * share[rows]
                for k in range(total.shape[1]):
                    total[:, k] += np.bincount(ids, mass[:, k], len(total))
        return total


def pieces(path: str) -> Pieces:
    """One look-up for each worker."""
    return resource("language", path, lambda: Pieces(path))


def clean_words(word: bytes) -> list[str]:
    """The letter runs of a word, marked and cut to the width that is summed over."""
    text = word.decode("utf-8", "replace").lower()
    if text.isalpha() and len(text) < WIDTH:
        return [BLANK + text]
    found = []
    for run in _LETTERS.findall(text):
        run = BLANK + run
        found += [run[i:i + WIDTH - 1] for i in range(0, len(run), WIDTH - 1)]
    return found


@dataclass
class LanguageModel:
    """Piece probabilities (piece, language) over the vocabulary at ``path``."""

    languages: list[str]
    probability: np.ndarray
    path: str = MODEL
    _memo: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_memo": None}

    def column_sums(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The same of an Arrow column of texts, as strings or bytes."""
        found = [self.sums([t.encode() if isinstance(t, str) else t for t in texts]) for texts in slices(column)]
        if not found:
            return self.sums([])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def sums(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """For each text the log probability in each language, and how many letter runs it has."""
        if self._memo is None:
            self._memo = _WordTable(self)
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        for run in text_runs(texts):
            words = [w for _, own in run for w in own]
            if not words:
                continue
            at = np.fromiter(self._memo.look_up(words), np.int64, len(words))
            rows = np.repeat([row for row, _ in run], [len(own) for _, own in run])
            found = self._memo.table[at]
            edge = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            np.add.at(total, rows[edge], np.add.reduceat(found[:, :-1], edge, axis=0))
            np.add.at(n, rows[edge], np.add.reduceat(found[:, -1], edge).astype(np.int64))
        return total, n


class _WordTable(Memo):
    """Row numbers of words in a table of log probabilities and letter runs."""

    def __init__(self, model: LanguageModel):
        super().__init__("language", self.rows, words=150_000)
        self.model = model
        self.table = np.zeros((0, len(model.languages) + 1))
        self.used = 0

    def rows(self, words: list[bytes]):
        if not self.known:
            self.used = 0
        cleaned = [clean_words(w) for w in words]
        runs = list({r for own in cleaned for r in own})
        place = {r: i for i, r in enumerate(runs)}
        logs = np.concatenate([pieces(self.model.path).log_probability(runs[i:i + 20_000], self.model.probability)
                               for i in range(0, len(runs), 20_000)] or [np.zeros((0, len(self.model.languages)))])
        sizes = np.fromiter(map(len, cleaned), np.int64, len(cleaned))
        new = np.zeros((len(words), self.table.shape[1]))
        np.add.at(new[:, :-1], np.repeat(np.arange(len(words)), sizes), logs[[place[r] for own in cleaned for r in own]])
        new[:, -1] = sizes
        first, self.used = self.used, self.used + len(words)
        if self.used > len(self.table):
            self.table = np.concatenate([self.table[:first], np.zeros((max(self.used, 2 * len(self.table)) - first, self.table.shape[1]))])
        self.table[first:self.used] = new
        return range(first, self.used)


def labelled_sample(documents: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", lang_col: str = "lang") -> tuple[DataFrame, list[str]]:
    """About ``per_language`` rows of each language by a hash of the id, and the languages. The set of languages is small."""
    rows = documents.where(F.col(lang_col).isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows, []
    million = 1_000_000
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, per_language / n) * million))))
    return rows.where(F.pmod(F.xxhash64(id_col), F.lit(million)) < share[F.col(lang_col)]), sorted(sizes)


def learn(documents: DataFrame, per_language: int = PER_LANGUAGE, rounds: int = 1, path: str = MODEL, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Piece probabilities of every language that ``documents`` name."""
    sample, languages = labelled_sample(documents, per_language, id_col, lang_col)
    size = len(pieces(path).texts)
    start = 1 / (np.arange(size) + 10.0)
    model = LanguageModel(languages, np.repeat((start / start.sum())[:, None], len(languages), axis=1), path)
    if not languages:
        return model
    number = {lang: k for k, lang in enumerate(languages)}
    rows = sample.select(F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"))
    for _ in range(rounds):
        rows_of = _expected(rows, model, number).collect()  # languages x vocabulary at most
        total = np.zeros((size, len(languages)))
        for r in rows_of:
            total[:, r.k] = np.frombuffer(r.counts, dtype=np.float64)
        total = total + SMOOTHING * total.sum(axis=0) / max(size, 1) / 10 + 1e-12
        model = LanguageModel(languages, total / total.sum(axis=0), path)
    return model


def _expected(rows: DataFrame, model: LanguageModel, number: dict[str, int]) -> DataFrame:
    def expect(batches):
        own, total = pieces(model.path), np.zeros(model.probability.shape)
        held: dict[bytes, Counter] = defaultdict(Counter)

        def settle():
            counts: dict[str, np.ndarray] = {}
            for lang, words in held.items():
                for word, n in words.items():
                    for r in clean_words(word):
                        counts.setdefault(r, np.zeros(total.shape[1]))[number[lang]] += n
            held.clear()
            listed = list(counts)
            for at in range(0, len(listed), 20_000):
                part = listed[at:at + 20_000]
                total[:] += own.expected_counts(part, np.array([counts[r] for r in part]), model.probability)

        for batch in batches:
            for texts, languages in zip(slices(batch.column(0)), slices(batch.column(1)), strict=True):
                for run in text_runs(texts):
                    for row, words in run:
                        held[languages[row]].update(words)
                    if sum(map(len, held.values())) > 150_000:
                        settle()
        settle()
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, k])],
                                         names=["k", "piece", "n"])

    size = len(model.probability)
    summed = rows.mapInArrow(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n"))

    def gather(key, table):
        counts = np.zeros(size)
        counts[table["piece"].to_numpy()] = table["n"].to_numpy()
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    return summed.groupBy("k").applyInArrow(gather, "k int, counts binary")


def identify(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``lang_pred`` and ``score`` of every row."""
    kind = documents.schema[id_col].dataType.simpleString()

    def predict(batches):
        for batch in batches:
            total, letters = model.column_sums(batch.column(1))
            if model.languages and len(batch):
                best = total.argmax(axis=1)
                score = np.where(letters > 0, 1 / np.exp(total - total[np.arange(len(batch)), best][:, None]).sum(axis=1), 0.0)
                names = [model.languages[b] if n else UNDETERMINED for b, n in zip(best, letters, strict=True)]
            else:
                names, score = [UNDETERMINED] * len(batch), np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return documents.select(F.col(id_col), F.col(text_col).cast("binary").alias("text")).mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double")


def kept(documents: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that have letters and a language at least so sure; without a learned language, all rows with letters."""
    at = documents.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            for first in range(0, len(batch), 1000):
                part = batch.slice(first, 1000)
                total, letters = model.column_sums(part.column(at))
                sure = letters > 0
                if model.languages:
                    sure &= 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) >= least
                yield part.filter(pa.array(sure))

    return documents.mapInArrow(keep, documents.schema)
