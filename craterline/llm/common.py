"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the words ``[^\x20\x09-\x0D]+``; bytes.split() cuts at exactly these.
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Texts are worked through in runs of about so many bytes.
RUN = 1 << 20


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def is_rest(doc_id: str, modulus: int, rest: int) -> Column:
    """Whether the remainder is ``rest``; false for a null id."""
    return F.coalesce(remainder(doc_id, modulus) == rest, F.lit(False))


def word_runs(data: bytes, size: int = RUN) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``size`` bytes; no word is cut."""
    start = 0
    while start < len(data):
        cut = SPACE.search(data, start + size) if start + size < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[start:end].split()
        start = end


def text_runs(texts: Iterable, size: int = RUN, parts: Callable = word_runs) -> Iterator[list[tuple[int, list]]]:
    """Lists of (row, words) of about ``size`` bytes. A long text comes in several parts, in order; null and empty ones have no words."""
    held, weight = [], 0
    for row, text in enumerate(texts):
        for words in parts(text, size) if text else ([],):
            held.append((row, words))
            weight += 1 + min(len(text or b""), size)
            if weight >= size:
                yield held
                held, weight = [], 0
    if held:
        yield held


def slices(column, rows: int = 512) -> Iterator[list]:
    """The values of an Arrow column, a few at a time, so that a batch is never held twice."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()
    pa.default_memory_pool().release_unused()  # what earlier batches have left


#: Large objects of each owner in this worker.
_resources: dict[str, dict] = {}


def resource(owner: str, key, build: Callable):
    """The owner's object under a key, built once in a worker and kept until another owner is served there."""
    Memo.serve(owner)
    own = _resources.setdefault(owner, {})
    if key not in own:
        own[key] = build()
        give_back()  # what reading a file has left
    return own[key]


def give_back() -> None:
    """Return freed memory to the system; a worker that idles would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Memo:
    """Results of a function of words, worked out for many new words at a time.

    It is emptied when it holds too many words or bytes, so its memory is bounded. A worker serves many
    operators one after the other; only the memos of the one at work, its ``owner``, are kept.
    """

    _all: weakref.WeakSet = weakref.WeakSet()
    _owner: str | None = None

    def __init__(self, owner: str, fill: Callable[[list[bytes]], Iterable], words: int = 300_000, size: int = 20_000_000):
        self.owner, self.fill, self.words, self.size = owner, fill, words, size
        self.known: dict = {}
        self.held = 0
        Memo._all.add(self)

    @classmethod
    def serve(cls, owner: str) -> None:
        """Empty the memos of other owners, and let go of all that is theirs."""
        if cls._owner != owner:
            for memo in cls._all:
                if memo.owner != owner:
                    memo.known.clear()
                    memo.held = 0
            others = [o for o in _resources if o != owner]
            for other in others:
                del _resources[other]
            idle, cls._owner = cls._owner is None, owner
            if not idle:  # an owner without large objects leaves freed memory too
                give_back()

    def look_up(self, words: list) -> Iterator:
        Memo.serve(self.owner)
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.words or self.held > self.size:
                self.known.clear()
                self.held, new = 0, set(words)
            listed = list(new)
            self.held += sum(map(len, listed))
            self.known.update(zip(listed, self.fill(listed), strict=True))
        return map(self.known.__getitem__, words)
