"""Token counts of a unigram tokenizer, without building the tokens.

Aho-Corasick enumerates every piece of the vocabulary in a word; dynamic programming over the places
where pieces end keeps the best score and the number of pieces that gives it. The rules are those of
the tokenizers library: every entry of the vocabulary is a piece with its score; a letter that is no
piece scores ten less than the worst and, with byte fallback, counts one token for each of its UTF-8
bytes; without it, neighbouring unknown letters are one token. Of equally good ways to reach a place
the one whose last piece starts first is kept; an unknown letter never displaces a piece.

Words are cut at blanks where no piece crosses one. The scores of the given vocabulary are whole
numbers, so sums are exact in any order. A word's count is worked out once and kept.

A null text has a null count, an empty text 0. Repeated rows keep their rows.
"""

from __future__ import annotations

import re
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterline.llm.common import RUN, Memo, slices, text_runs
from craterline.llm.model_file import BLANK, MODEL, Model, read_model

#: How far an unknown letter stays behind the worst piece (fixed value).
UNKNOWN_PENALTY = 10.0

_counters: dict[str, "Counter"] = {}


class Counter:
    """Counts the tokens of normalised texts under a unigram vocabulary."""

    def __init__(self, model: Model):
        if model.charsmap:
            raise ValueError("a character map is not supported; the given vocabulary has none")
        self.model = model
        self.unknown = min(score for _, score, _ in model.pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for text, score, _ in model.pieces:
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        # A word is a run of blank markers and the letters up to the next run.
        self.whole = model.crosses_words()
        self.words = re.compile("(?s:.+)" if self.whole else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.memo = Memo("token_count", lambda words: [self.viterbi(w) for w in words], words=400_000)

    def normal(self, text: str) -> str:
        if self.model.remove_extra_whitespaces:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return text
        text = " " + text if self.model.add_dummy_prefix else text
        return text.replace(" ", BLANK) if self.model.escape_whitespaces else text

    def viterbi(self, word: str) -> int:
        """Number of pieces on the best path.

        The automaton reports the pieces that end at a place longest first, which is the order of their starts.
        """
        n, at, alone = len(word), 1, False
        score, count, unknown = [-np.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0

        def settle(place: int) -> None:
            """A letter that is no piece may be the better way to a place."""
            if score[place - 1] + self.unknown > score[place]:
                score[place], unknown[place] = score[place - 1] + self.unknown, True
                if self.model.byte_fallback:
                    count[place] = count[place - 1] + len(word[place - 1].encode("utf-8", "replace"))
                else:
                    count[place] = count[place - 1] + (not unknown[place - 1])

        for end, (size, value) in self.automaton.iter(word):
            while at <= end:  # no further piece ends there
                if not alone:
                    settle(at)
                at, alone = at + 1, False
            reached = score[at - size] + value
            if reached > score[at]:
                score[at], count[at] = reached, count[at - size] + 1
            alone |= size == 1
        while at <= n:
            if not alone:
                settle(at)
            at, alone = at + 1, False
        return count[n]

    def parts(self, text: str, size: int = RUN):
        """The words of a text in order, in lists of about ``size`` letters."""
        normal, at = self.normal(text), 0
        while at < len(normal):
            stop = -1 if self.whole else normal.find(BLANK, at + size)
            while stop > 0 and normal[stop - 1] == BLANK:
                stop = normal.find(BLANK, stop + 1)
            stop = len(normal) if stop < 0 else stop
            yield self.words.findall(normal[at:stop])
            at = stop

    def counts(self, texts) -> list[int | None]:
        found = [None if text is None else 0 for text in texts]
        for run in text_runs(texts, parts=self.parts):
            counts = self.memo.look_up([w for _, words in run for w in words])
            for row, words in run:
                if words:
                    found[row] += sum(islice(counts, len(words)))
        return found


def counter(path: str) -> Counter:
    """One counter for each worker."""
    if path not in _counters:
        _counters[path] = Counter(read_model(path))
    return _counters[path]


def count_tokens(documents: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``n_tokens`` of every row."""
    kind = documents.schema[id_col].dataType.simpleString()

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for texts in slices(batch.column(1)) for n in counter(path).counts(texts)], pa.int64())],
                                             names=[id_col, "n_tokens"])

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(count, f"`{id_col}` {kind}, n_tokens long")
