"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over the last seven bytes of a text. Wherever its lowest bits are all ones a piece ends,
so the ends depend on the text around them alone and an edit moves only those close to it. Every piece
becomes one of 64 characters, from a check sum of its bytes. The block size 4 * 2^k is the smallest
at which no more than 64 pieces arise, so it depends on the whole text; a fingerprint holds the
characters at that size and at twice that size: ``size:characters:characters``.

Two fingerprints are compared at sizes they have in common, which is so if their sizes are equal or one
is twice the other. Their likeness is one minus the edit distance over the longer length, the larger one
of both sizes, and 0 if no run of seven characters (of all, in a shorter one) occurs in both: pieces of
unrelated texts agree by chance, one in 64, but runs of them do not. Equal fingerprints have likeness 1.

``neighbours`` gives each document the next one by id, with one shuffle of the texts: rows are
range-partitioned by id, neighbours lie side by side, and only the last row of each partition is
paired in a second, small step.

A null text is empty and has the fingerprint of an empty text. Rows with the same id follow each other in the order of a
hash of their texts; a null id comes first. The row after the last is the first, which a single row is to itself.
Columns other than id and text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterline.functions.stage import stage
from craterline.llm.common import slices

WINDOW, SMALLEST, PIECES, COMMON = 7, 4, 64, 7
#: Exponents of the block size, from the bits that the rolling hash has left.
LEVELS = 22
#: Bytes of short texts whose rolling hashes are worked out in one go.
TOGETHER = 1 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CHARACTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
#: Odd factors of the bytes in the window, and of the sum.
_FACTORS = np.array([pow(0x01000193, j + 1, 1 << 32) for j in range(WINDOW)], np.uint32)
_MIX = np.uint32(0x9E3779B1)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of each byte and the six before it; bytes before the first are zero."""
    padded = np.zeros(len(data) + WINDOW - 1, np.uint32)
    padded[WINDOW - 1:] = data
    total = padded[WINDOW - 1:] * _FACTORS[0]
    for j in range(1, WINDOW):
        total += padded[WINDOW - 1 - j:len(padded) - j] * _FACTORS[j]
    total ^= total >> np.uint32(15)
    total *= _MIX
    return total >> np.uint32(8)


def possible_ends(data: bytes, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places behind which a piece may end, and the exponent of the largest block size at which it does."""
    places, exponents = [], []
    for at in range(0, len(data), block):
        before = min(at, WINDOW - 1)
        h = rolling(np.frombuffer(data, np.uint8, count=min(block, len(data) - at) + before, offset=at - before))[before:]
        own = np.flatnonzero((h & np.uint32(SMALLEST - 1)) == SMALLEST - 1)
        ones = h[own] + np.uint32(1)
        lowest = (ones & (~ones + np.uint32(1))).astype(np.float64)
        places.append(own + (at + 1))
        exponents.append((np.log2(lowest) - np.log2(SMALLEST)).astype(np.int8))
    return (np.concatenate(places), np.concatenate(exponents)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int8))


def _characters(text: memoryview, ends: np.ndarray) -> str:
    """One character for each piece; what is left after the last end is a piece too, and of too many the last takes in the rest."""
    stops = ends[:PIECES - 1].tolist()
    if not stops or stops[-1] != len(text):
        stops.append(len(text))
    elif len(ends) > len(stops):
        stops[-1] = len(text)
    start, sums = 0, []
    for stop in stops:
        sums.append(zlib.crc32(text[start:stop]) >> 26)
        start = stop
    return _CHARACTERS[sums].tobytes().decode()


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of texts, a few of them at a time."""
    found, at = [], 0
    while at < len(texts):
        stop, weight = at, 0
        while stop < len(texts) and (stop == at or weight + len(texts[stop]) < TOGETHER):
            weight += len(texts[stop])
            stop += 1
        found += _fingerprints(texts[at:stop])
        at = stop
    return found


def _fingerprints(texts: list[bytes]) -> list[str]:
    gap = bytes(WINDOW - 1)  # as before the first byte of a text
    places, exponents = possible_ends(gap.join(texts))
    starts = np.cumsum([0, *(len(t) + len(gap) for t in texts)])[:-1]
    low = np.searchsorted(places, starts, side="right").tolist()
    high = np.searchsorted(places, starts + [len(t) for t in texts], side="right").tolist()
    found = []
    for text, start, a, b in zip(texts, starts.tolist(), low, high, strict=True):
        own = exponents[a:b]
        # How many ends there are at each size or a larger one.
        ends_at = np.bincount(own, minlength=LEVELS + 1)[::-1].cumsum()[::-1]
        level = min(int(np.argmax(ends_at < PIECES)) if (ends_at < PIECES).any() else LEVELS, LEVELS - 1)
        ends, view = places[a:b] - start, memoryview(text)
        found.append(f"{SMALLEST << level}:{_characters(view, ends[own >= level])}:{_characters(view, ends[own > level])}")
    return found


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the one that follows."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints, null if one is null."""
    (size_a, one_a, two_a), (size_b, one_b, two_b) = ([F.split_part(f, F.lit(":"), F.lit(k)) for k in (1, 2, 3)] for f in (a, b))
    size_a, size_b = size_a.cast("long"), size_b.cast("long")
    return (F.when(a == b, 1.0).when(size_a == size_b, F.greatest(_alike(one_a, one_b), _alike(two_a, two_b)))
            .when(size_a == 2 * size_b, _alike(one_a, two_b)).when(2 * size_a == size_b, _alike(two_a, one_b))
            .when(a.isNotNull() & b.isNotNull(), 0.0))


def _alike(x: Column, y: Column) -> Column:
    run = F.least(F.lit(COMMON), F.length(x), F.length(y))
    runs = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - run + 1), lambda i: F.substring(s, i, run))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(F.arrays_overlap(runs(x), runs(y)), 1.0 - F.levenshtein(x, y).cast("double") / longest).otherwise(0.0)


_ROW = "id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, part int, place string, text string"


def _describe(rows: list[tuple], following: list[str], prints: list[str], next_prints: list[str]) -> list[list]:
    """Columns n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint of texts with the texts behind them."""
    changed = [edited(t, f).encode() for t, f in zip(rows, following, strict=True)]
    return [[len(t) for t in rows], [hashlib.sha256(c).hexdigest() for c in changed], prints, fingerprints(changed), next_prints]


def neighbours(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint of every document."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sort = ["id", "hash", "row"]
    near = (rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
            .repartitionByRange(*sort).sortWithinPartitions(*sort).select("id", "text"))

    def pair(batches):
        part, last = TaskContext.get().partitionId(), None

        def out(ids, columns, place=None, texts=None):
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]], pa.array([part] * n, pa.int32()),
                 pa.array([place] * n, pa.string()), pa.array(texts or [None] * n, pa.string())],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "part", "place", "text"])

        for batch in batches:
            for at, texts in enumerate(slices(batch.column(1), 256)):
                ids = batch.column(0).slice(256 * at, 256)
                prints = fingerprints([t.encode() for t in texts])
                none = [[len(texts[0])], [None], prints[:1], [None], [None]]
                if last is None:
                    yield out(ids.slice(0, 1), none, "first", texts[:1])
                else:
                    ids, texts, prints = pa.concat_arrays([last[0], ids]), [last[1], *texts], [last[2], *prints]
                if len(texts) > 1:
                    yield out(ids.slice(0, len(ids) - 1), _describe(texts[:-1], texts[1:], prints[:-1], prints[1:]))
                last = ids.slice(len(ids) - 1), texts[-1], prints[-1]
        if last is not None:
            yield out(last[0], [[len(last[1])], [None], [last[2]], [None], [None]], "last", [last[1]])

    found = stage(near.mapInArrow(pair, _ROW.format(kind=kind)))
    kept = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    # One row a partition: where the last text of a partition finds the text behind it.
    parts = sorted(r.part for r in found.where("place = 'first'").select("part").collect())
    spark = documents.sparkSession
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    first = found.where("place = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("behind"))
    ends = found.where("place = 'last'").select("id", "text", "fingerprint", "part").join(follows, "part").join(first, "next").select(
        "id", "text", "fingerprint", "following", "behind")

    def close(batches):
        for batch in batches:
            if len(batch):
                texts, prints, following, behind = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
                columns = _describe(texts, following, prints, behind)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], names=kept)

    closed = ends.mapInArrow(close, ", ".join(_ROW.format(kind=kind).split(", ")[:6]))
    return found.where("place is null").select(*kept).union(closed).withColumnRenamed("id", id_col)


def compare_neighbours(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``neighbours`` with near_edited and near_next, the likeness to the edited text and to the next document."""
    found = neighbours(documents, id_col, text_col)
    own = F.col("fingerprint")
    return found.select(F.col(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        likeness(own, F.col("edited_fingerprint")).alias("near_edited"), likeness(own, F.col("next_fingerprint")).alias("near_next"))
