"""Spelling variants: words that differ by one edit, found by dense prefix-suffix tiling.

Two words of at most M letters are one edit apart exactly if their common prefix and their common
suffix together reach M - 1. A tile is a padded matrix of code points and its mirror image; rows are
compared along its diagonals, so prefix and suffix lengths of all pairs of a tile come from a few
array operations.

Only words that can be near are put into one tile. For words of M and M - 1 letters, M letters are cut
into stretches of at most two (six stretches at most); one edit falls into one stretch, and all before
it and all behind it is equal. So every word gets one key for each stretch, the text before and the text
behind, in the class of its own length and in that of one letter more. Words under one key differ
within a stretch alone, which bounds how many there are whatever the size of the vocabulary. A pair that
meets under several keys counts under the first of them, so nothing has to be made distinct.

A key with more words than a block is cut into blocks that meet two by two, each pair of blocks in a
group of its own. A tile hands on one row for each word with a near word in it: how many there are and
the best of them. Pairs are never listed.

Null texts have no words, null words and those with fewer than ``shortest`` letters are left out, and
so are those that occur fewer than ``least`` times. Repeated rows count as often as they occur; a null
id is an empty text in the check sum. Columns other than id and text, or word and n, are not looked at.
An empty table has no words. Ties go to the word first in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterline.functions.stage import stage
from craterline.llm.common import RUN, slices

SHORTEST, LEAST = 7, 2
#: Letters of a stretch, and how many stretches a word has at most.
STRETCH, MOST = 2, 6
#: Words of a block at most, and its letters at most.
BLOCK, LETTERS = 1024, 1 << 20
#: Words that a task counts before it hands them on.
HELD = 200_000
#: n grows tenfold from a word to its form, so 19 steps exceed 64 bits and five doublings reach the end.
ROUNDS = 5


def count_words(documents: DataFrame, shortest: int = SHORTEST, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Partial counts (word, n) of maximal runs of Latin letters, A-Z in lower case; a word may have several rows.

    With ``every``, a run whose crc32 of ``<id>:<run>`` is a multiple of it loses the letter at that crc32
    modulo its length: a fixed way to plant misspellings.
    """
    # Fixed value: the letters of a run.
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{max(1, shortest)},}}")

    def count(batches):
        held: Counter[str] = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for at, texts in enumerate(slices(batch.column(1), 256)):
                ids = batch.column(0).slice(256 * at, 256).to_pylist()
                for doc, text in zip(ids, texts, strict=True):
                    found = Counter(_runs(runs, text.lower().decode("utf-8", "replace"))) if text else {}
                    if every:
                        seed = zlib.crc32(b"%s:" % (doc or "").encode())
                        for run, n in found.items():
                            h = zlib.crc32(run.encode(), seed)
                            if h % every:
                                held[run] += n
                            elif len(run) > shortest:
                                cut = h % len(run)
                                held[run[:cut] + run[cut + 1:]] += n
                    else:
                        held.update(found)
                    if len(held) > HELD:
                        yield out()
        yield out()

    return documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "word string, n long")


def _runs(pattern: re.Pattern, text: str):
    """All matches; those of a long text are never held at once."""
    return pattern.findall(text) if len(text) < RUN else (m.group() for m in pattern.finditer(text))


def _bounds(m: int) -> np.ndarray:
    """Where the stretches of M letters begin and end."""
    parts = min(MOST, -(-m // STRETCH))
    return np.arange(parts + 1) * m // parts


def _keyed(words: DataFrame) -> DataFrame:
    """Each word under its keys: class ``m``, stretch ``k``, ``key`` of the text around the stretch."""
    m, k, parts = F.col("m"), F.col("k"), F.col("parts")
    start, stop = F.floor(m * k / parts).cast("int"), F.floor(m * (k + 1) / parts).cast("int")
    return (words.withColumn("size", F.length("word")).withColumn("m", F.explode(F.array(F.col("size"), F.col("size") + 1)))
            .withColumn("parts", F.least(F.lit(MOST), F.ceil(m / STRETCH)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), parts - 1)))
            .select("word", "n", "size", "m", "k", F.xxhash64("m", "k", F.left("word", start), F.right("word", m - stop)).alias("key")))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of each word of a table (word, n) of distinct words that has a near one."""
    keyed = _keyed(words)
    room = F.greatest(F.lit(2), F.least(F.lit(block), F.floor(F.lit(LETTERS) / F.col("m"))))
    crowded = stage(keyed.groupBy("key", "m").agg(F.count("*").alias("rows")).where(F.col("rows") > room)
                    .select("key", "m", F.ceil(F.col("rows") / room).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    met = (keyed.join(crowded, ["key", "m"], "left").withColumn("own", F.pmod(F.xxhash64("word"), blocks).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
           .select("m", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "k", "own", "size", "word", "n"))
    tiles = met.repartition("key", "i", "j").sortWithinPartitions("m", "key", "i", "j", F.desc("size"))
    found = tiles.mapInArrow(_tiles, "word string, links long, best_n long, best string")
    return (found.groupBy("word").agg(F.sum("links").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("top"))
            .select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.w").alias("best")))


def _tiles(batches):
    """Groups of the sorted rows, whole ones only, as tiles of one class and a bounded number of letters."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        starts = _starts(table)
        whole = int(starts[-1]) if len(starts) else 0  # the last group may go on in the next batch
        rest = table.slice(whole)
        if whole:
            yield from _cut(table.slice(0, whole))
    if rest is not None and len(rest):
        yield from _cut(rest)


def _starts(table: pa.Table) -> np.ndarray:
    """The first row of each group."""
    if not len(table):
        return np.zeros(0, np.int64)
    new = np.zeros(len(table), dtype=bool)
    new[0] = True
    for name in ("m", "key", "i", "j"):
        c = table[name].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _cut(table: pa.Table):
    starts = _starts(table)
    sizes = np.diff(np.r_[starts, len(table)])
    keep = np.repeat(sizes > 1, sizes)
    if not keep.any():
        return
    table = table.filter(pa.array(keep)).combine_chunks()
    starts = _starts(table)
    stops = np.r_[starts[1:], len(table)]
    m = table["m"].to_numpy()
    at = 0
    while at < len(starts):
        width = int(m[starts[at]])
        # Groups of this class while their letters fit, one at least.
        end = int(np.searchsorted(stops, starts[at] + max(1, 4 * LETTERS // width), side="right"))
        end = max(at + 1, min(end, int(np.searchsorted(m[starts], width, side="right"))))
        lo, hi = int(starts[at]), int(stops[end - 1])
        yield from _compare(table.slice(lo, hi - lo), width, np.repeat(stops[at:end] - lo, stops[at:end] - starts[at:end]))
        at = end


def code_points(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Padded matrix of code points, one row a word of ``width`` or ``width`` - 1 letters, and that of the mirrored words."""
    matrix = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    mirror = matrix[:, ::-1].copy()
    short = np.fromiter(map(len, words), np.int64, len(words)) < width
    mirror[short, :-1] = mirror[short, 1:]
    mirror[short, -1] = 0
    return matrix, mirror


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns two matrices have in common, row by row."""
    differs = a != b
    first = differs.argmax(axis=1)
    return np.where(differs[np.arange(len(a)), first], first, a.shape[1])


def _compare(tile: pa.Table, width: int, stops: np.ndarray):
    """Near words of each row among the later rows of its group, diagonal by diagonal."""
    words = tile["word"].to_pylist()
    size, n, k, own = (tile[c].to_numpy() for c in ("size", "n", "k", "own"))
    meet = tile["i"].to_numpy() != tile["j"].to_numpy()
    matrix, mirror = code_points(words, width)
    ends = _bounds(width)[1:]
    left, right = [], []
    # Rows of full length come first in their group; two shorter ones meet in their own class.
    active, step = np.flatnonzero(size == width), 1
    while (active := active[active + step < stops[active]]).size:
        a, b = active, active + step
        step += 1
        new = ~meet[a] | (own[a] != own[b])
        a, b = a[new], b[new]
        for at in range(0, len(a), rows := max(1, LETTERS // width)):
            x, y = a[at:at + rows], b[at:at + rows]
            prefix = np.minimum(common(matrix[x], matrix[y]), size[y])
            suffix = np.minimum(common(mirror[x], mirror[y]), size[y])
            near = (prefix + suffix >= width - 1) & (np.searchsorted(ends, width - suffix) == k[x])
            left.append(x[near])
            right.append(y[near])
    left, right = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
    if not left.size:
        return
    source, target = np.r_[left, right], np.r_[right, left]
    seen, place = np.unique(target, return_inverse=True)
    order = np.empty(len(seen), np.int64)
    order[np.array(sorted(range(len(seen)), key=lambda s: words[seen[s]]), dtype=np.int64)] = np.arange(len(seen))
    best = np.lexsort((order[place], -n[target], source))
    rows, first, links = np.unique(source[best], return_index=True, return_counts=True)
    top = target[best][first]
    yield pa.RecordBatch.from_arrays(
        [pa.array([words[r] for r in rows], pa.string()), pa.array(links, pa.int64()), pa.array(n[top], pa.int64()), pa.array([words[t] for t in top], pa.string())],
        names=["word", "links", "best_n", "best"])


def group_variants(counts: DataFrame, shortest: int = SHORTEST, least: int = LEAST, factor: int = 10, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a table (word, n), whose repeated words are added up.

    A word's form is its most frequent near word, if that is at least ``factor`` times as frequent
    (``factor`` is 2 or more); its root is where its chain of forms ends.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, so that forms lead to ever more frequent words")
    words = stage(counts.groupBy("word").agg(F.sum("n").cast("long").alias("n")).where((F.length("word") >= shortest) & (F.col("n") >= least)))
    form = F.when(F.col("best_n") >= factor * F.col("n"), F.col("best"))
    near = stage(words.join(near_words(words, block), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), F.col("best_n")).alias("form_n")))
    up = stage(near.where("form is not null").select("word", F.col("form").alias("root")))
    rounds = ROUNDS if factor >= 10 else 6  # at twofold growth 63 steps exceed 64 bits
    for _ in range(rounds):
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        further = stage(up.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        up = further.drop("moved")
        if not further.where("moved").limit(1).count():
            break
    return near.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
