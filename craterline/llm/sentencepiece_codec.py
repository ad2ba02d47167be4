"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read by hand and rebuilt as a tokenizer: its normaliser, the blank
marker, its pieces with their scores, and byte fallback. A unigram model keeps its scores; for a
model trained with byte-pair merges the order of merges follows from the scores, since the merge that
makes a better piece goes first.

Words (a run of blank markers and what follows it) that a worker has not met are encoded in one batch,
decoded again, encoded with the sentencepiece library too and compared. All of it runs in one thread, since
a task has one core: threads that wait for each other cost CPU. No piece crosses from one word to the next, so a
text's ids are those of its words. A vocabulary in which pieces do cross is encoded text by text.
The given model is of the second kind; parity with sentencepiece holds for both.

A null text has null results, an empty text no ids. ``parity`` is null where nothing was compared (a text
of one blank). Repeated rows keep their rows, an empty table gives none, and other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

from craterline.llm.common import RUN, Memo, slices, text_runs
from craterline.llm.model_file import BLANK, BYTE, CONTROL, MODEL, UNIGRAM, UNKNOWN, USER_DEFINED, Model, read_model

_codecs: dict[str, "Codec"] = {}
#: A word that others are put behind where blanks at the start would be lost.
LEAD = "a"


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces whose union is a piece, best union first; of one union's pairs the one whose parts rank higher first."""
    rank = {text: i for i, (text, _, kind) in enumerate(model.pieces) if kind not in (UNKNOWN, CONTROL, BYTE)}
    found = []
    for text in rank:
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in rank and right in rank:
                found.append((-model.pieces[rank[text]][1], rank[text], rank[left], rank[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build_tokenizer(model: Model) -> Tokenizer:
    """A tokenizer for words whose blanks are already marked."""
    unknown = model.pieces[model.unknown_id][0]
    if model.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(text, score) for text, score, _ in model.pieces], model.unknown_id, model.byte_fallback))
    else:
        tokenizer = Tokenizer(models.BPE({text: i for i, (text, _, _) in enumerate(model.pieces)}, merges(model),
                                         unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(BLANK, " "), decoders.ByteFallback(), decoders.Fuse()])
    added = [AddedToken(text, normalized=False) for text, _, kind in model.pieces if kind == USER_DEFINED]
    if added:
        tokenizer.add_tokens(added)
    return tokenizer


class Codec:
    """Encodes and decodes texts; every new word is checked against the sentencepiece library."""

    def __init__(self, path: str):
        self.model = read_model(path)
        self.tokenizer = build_tokenizer(self.model)
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.words = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+") if not self.model.crosses_words() else None
        self.lead = self.peer.encode(LEAD)
        self.empty = self.peer.encode("") == []
        self.memo = Memo("sentencepiece", self._brief)

    def normal(self, text: str) -> str:
        """The text with its blanks marked, before the character map."""
        if self.model.remove_extra_whitespaces:
            text = (re.sub(" +", " ", text) if "  " in text else text).strip(" ")
        if not text:
            return text
        text = " " + text if self.model.add_dummy_prefix else text
        return text.replace(" ", BLANK) if self.model.escape_whitespaces else text

    def peer_ids(self, words: list[str]) -> list[list[int] | None]:
        """The peer's ids of each word; None of a word that it cannot be given alone."""
        asked, lead = [], []
        for word in words:
            first = word.startswith(BLANK)
            if self.model.add_dummy_prefix:  # the peer adds the marker of the word's first blank itself
                asked.append(word[1:] if first else "")
                lead.append(0)
            else:  # blanks in front that the peer would strip stay behind another word
                behind = first and self.model.remove_extra_whitespaces and self.words is not None
                asked.append(LEAD * behind + word)
                lead.append(len(self.lead) if behind else 0)
        if self.model.escape_whitespaces:
            asked = [w.replace(BLANK, " ") for w in asked]
        found = self.peer.encode(asked, num_threads=1)
        return [ids[n:] if text else None for text, n, ids in zip(asked, lead, found, strict=True)]

    def encode_words(self, words: list[str]) -> list[tuple[bytes, int, bool, bool | None]]:
        """Ids, how many, whether decoding gives the word back, and whether the peer gives the same ids (None: not compared)."""
        return [self._four(r) for r in self._brief(words)]

    def _brief(self, words: list[str]) -> list[bytes | tuple[bytes, int, bool, bool | None]]:
        """Only the ids of a word that passes both comparisons, which nearly all do; else the four results."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        plain = [w.replace(BLANK, " ") for w in words]
        ends = np.cumsum([0, *map(len, ids)]) * 4
        flat, ends = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1] // 4).tobytes(), ends.tolist()
        data = [flat[a:b] for a, b in pairwise(ends)]
        return [own if peer == found and text == word else (own, len(found), text == word, None if peer is None else peer == found)
                for own, found, text, word, peer in zip(data, ids, back, plain, self.peer_ids(words), strict=True)]

    @staticmethod
    def _four(result: bytes | tuple[bytes, int, bool, bool | None]) -> tuple[bytes, int, bool, bool | None]:
        return (result, len(result) // 4, True, True) if isinstance(result, bytes) else result

    def parts(self, text: str, size: int = RUN):
        """The words of a text in order, in lists of about ``size`` letters."""
        normal, at = self.normal(text), 0
        while at < len(normal):
            stop = normal.find(BLANK, at + size) if self.words else -1
            while stop > 0 and normal[stop - 1] == BLANK:
                stop = normal.find(BLANK, stop + 1)
            stop = len(normal) if stop < 0 else stop
            yield self.words.findall(normal[at:stop]) if self.words else [normal]
            at = stop

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, int, bool, bool | None] | None]:
        """The same four of whole texts; nothing of a null. Words that were not compared leave the verdict to the others."""
        found = [None if t is None else [] for t in texts]
        for run in text_runs(texts, parts=self.parts):
            results = self.memo.look_up([w for _, words in run for w in words])
            for row, words in run:
                if found[row] is not None:
                    found[row].extend(islice(results, len(words)))
        return [f and self._whole(f) if f != [] else (b"", 0, True, self.empty) for f in found]

    @classmethod
    def _whole(cls, results: list) -> tuple[bytes, int, bool, bool | None]:
        if tuple not in set(map(type, results)):
            whole = b"".join(results)
            return whole, len(whole) // 4, True, True
        ids, n, back, same = zip(*map(cls._four, results), strict=True)
        return b"".join(ids), sum(n), all(back), False if False in same else True if True in same else None

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the blank that encoding put in front."""
        text = self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.model.add_dummy_prefix and text.startswith(" ") else text


def codec(path: str) -> Codec:
    """One codec for each worker; its libraries start no threads there unless the environment says so."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(documents: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Id, ``n_ids``, ``ids_crc32`` (of little-endian unsigned 32-bit ids), ``round_trip``, ``parity`` and, if wanted, the ids."""
    kind = documents.schema[id_col].dataType.simpleString()
    names = [id_col, "n_ids", "ids_crc32", "round_trip", "parity"] + ["ids"] * with_ids

    def run(batches):
        own = codec(path)
        for batch in batches:
            rows = [row for texts in slices(batch.column(1)) for row in own.encode(texts)]
            columns = [pa.array([r and r[1] for r in rows], pa.int64()), pa.array([r and zlib.crc32(r[0]) for r in rows], pa.int64()),
                       pa.array([r and r[2] for r in rows], pa.bool_()), pa.array([r and r[3] for r in rows], pa.bool_())]
            if with_ids:
                columns.append(pa.array([r and np.frombuffer(r[0], dtype="<i4") for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = f"`{id_col}` {kind}, n_ids long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * with_ids
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and ``text`` of every row; null ids give a null text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else codec(path).decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")
