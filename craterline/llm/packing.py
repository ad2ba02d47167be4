"""Best-fit packing (best-two-fit) of tokenised documents into sequences of a fixed size.

Texts are tokenised once, into pieces of at most ``capacity`` ids. The packing itself needs only how
many pieces there are of each length: a table of at most ``capacity`` rows, whatever the corpus. On
it the driver fills one sequence greedily with the longest pieces that fit, then tries to replace its
smallest piece by two unpacked ones that fill the widened gap more tightly, and uses that filling for
as many sequences as the counts allow. Every step uses up a length, so the plan has a bounded number
of fillings too. Pieces then find their places by their rank among pieces of their length.

Null texts are empty; an empty text is the end mark alone. Repeated rows are packed as often as they
occur, an empty table gives no rows, columns other than id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from craterline.functions.stage import stage
from craterline.llm.common import resource

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048
#: Letters of words of which the tokenizer's own normalisation is no more than lower-casing; all others, and marks of special tokens, are odd.
ODD = re.compile("[^ !-~¡-ɏ]+|<\\|")
#: How the tokenizer file cuts words (fixed value: it must equal the file's pattern).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Marks that are a part of their own behind a word of letters.
STOPS = frozenset('.,;:!?")')
#: Bytes of short texts that are tokenised together.
RUN = 1 << 21
#: Ids that a task holds before it hands them on.
HELD = 1 << 18
#: Ranks of a length stay below this.
RANKS = 1 << 44


class Known:
    """Results for words, worked out for many new ones at a time; emptied when it holds too many words or bytes of words and results."""

    def __init__(self, fill, words: int, size: int):
        self.fill, self.words, self.size = fill, words, size
        self.known, self.held = {}, 0

    def look_up(self, words: list) -> list[bytes]:
        """Results of words, each of which should occur once."""
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = [words[i] for i in missing]
            results = self.fill(new)
            for i, ids in zip(missing, results, strict=True):
                found[i] = ids
            if len(self.known) > self.words or self.held > self.size:
                self.known.clear()
                self.held = 0
            self.known.update(zip(new, results, strict=True))
            self.held += sum(map(len, new)) + sum(map(len, results))
        return found


class WordEncoder:
    """Ids of words as little-endian unsigned 32-bit bytes, equal to encoding the whole text.

    White space only separates words for this tokenizer, so a text's ids are those of its words in
    order. Plain words are cut and lower-cased here and their parts are encoded in one call; the last
    token of a part is known by its end-of-word mark. All other words go through the file as it is.
    """

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        # The same model, not a copy of it. Parts hold no marks of special tokens, which it does not know.
        self.parts = Tokenizer(self.full.model)
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known_parts = Known(self.encode_parts, words=200_000, size=5_000_000)
        self.words = Known(self.encode_words, words=300_000, size=8_000_000)

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        ids = np.array(self.parts.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(parts):
            raise ValueError("the tokenizer does not mark the end of each word")
        data, start, found = ids.tobytes(), 0, []
        for stop in stops.tolist():
            found.append(data[start:stop])
            start = stop
        return found

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        text = b" ".join(words).decode("utf-8", "replace")
        odd = {text[text.rfind(" ", 0, m.start()) + 1:stop if (stop := text.find(" ", m.end())) >= 0 else len(text)] for m in ODD.finditer(text)}
        parts, sizes, aside = [], [], []
        own = text.split(" ") if odd else None
        for i, word in enumerate(text.lower().split(" ") if not odd else map(str.lower, own)):
            if odd and own[i] in odd:
                aside.append(i)
                sizes.append(0)
            elif word.isalpha():
                parts.append(word)
                sizes.append(1)
            elif word[-1:] in STOPS and word[:-1].isalpha():
                parts.append(word[:-1])
                parts.append(word[-1])
                sizes.append(2)
            else:
                cut = WORD.findall(word)
                parts += cut
                sizes.append(len(cut))
        once = list(dict.fromkeys(parts))
        ids = dict(zip(once, self.known_parts.look_up(once), strict=True)) if once else {}
        at, found = 0, []
        for n in sizes:
            found.append(ids[parts[at]] if n == 1 else b"".join([ids[p] for p in parts[at:at + n]]))
            at += n
        if aside:
            encoded = self.full.encode_batch([own[i] for i in aside], add_special_tokens=False)
            for i, one in zip(aside, encoded, strict=True):
                found[i] = np.asarray(one.ids, dtype="<u4").tobytes()
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, each with the end mark, id 0, behind it, in one array, and where those of each text end.

        Every word is worked out once, whatever the number of its places; a null text is empty.
        """
        split = pc.ascii_split_whitespace(texts.cast(pa.large_binary()).view(pa.large_string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        results = self.words.look_up(words.dictionary.view(pa.large_binary()).to_pylist()) + [b"\0\0\0\0"]
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        # The end mark is one more word, behind the last of each text.
        at = np.insert(words.indices.to_numpy(), ends, len(results) - 1)
        sizes = np.fromiter(map(len, results), np.int64, len(results)) // 4
        n = sizes[at]
        stops = np.cumsum(n)
        first = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(results), "<u4")[np.arange(stops[-1] if len(stops) else 0) + np.repeat(first[at] - stops + n, n)]
        return ids, stops[ends + np.arange(len(ends))]

    def runs(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The texts of a column in runs of about ``RUN`` bytes: first row, ids and ends."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + RUN, side="right")))
            yield at, *self.encode(column.slice(at, stop - at))
            at = stop
        pa.default_memory_pool().release_unused()

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of whole texts as bytes, each with the end mark behind it."""
        found = []
        for _, ids, ends in self.runs(pa.array(texts, pa.binary())):
            found += [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return found


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker."""
    return resource("packing", path, lambda: WordEncoder(path))


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, piece, start, length, ids_crc32 and, if wanted, the ids.

    ``part`` and ``nth`` number the pieces of each length within a task.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        held = rows, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []

        def out(batch):
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(rows), part, np.int32)), pa.array(nth, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                ends = np.r_[0, np.cumsum(length)].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).view("<i4") if ids else np.zeros(0, np.int32))))
                names.append("ids")
            for column in held:
                column.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            weight = 0
            for first, own, ends in encoder(tokenizer).runs(batch.column(1)):
                begin = 0
                for row, end in enumerate(ends.tolist(), first):
                    for k, at in enumerate(range(begin, end, capacity)):
                        piece_ids = own[at:min(at + capacity, end)]
                        n = len(piece_ids)
                        rows.append(row)
                        piece.append(k)
                        start.append(at - begin)
                        length.append(n)
                        crc.append(zlib.crc32(piece_ids))
                        nth.append(int(seen[n]))
                        seen[n] += 1
                        if with_ids:
                            ids.append(piece_ids)
                            weight += n
                        if weight >= HELD:
                            yield out(batch)
                            weight = 0
                    begin = end
            yield out(batch)

    return documents.select(F.col(id_col), F.col(text_col).cast("binary").alias("text")).mapInArrow(cut, schema)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Fillings ((length, how often), ...) and how many sequences are filled so.

    The longest piece left opens a sequence; the longest that fits follows, until none does. If two
    pieces left fill the gap and the place of the sequence's smallest piece better than that piece,
    they replace it.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        rest, taken, gap = left.copy(), {}, capacity
        while gap and (fit := np.flatnonzero(rest[:gap + 1])).size:
            n = int(fit[-1])
            k = int(min(gap // n, rest[n]))
            taken[n] = taken.get(n, 0) + k
            rest[n] -= k
            gap -= k * n
        smallest = min(taken)
        wide = gap + smallest
        if (pair := _tightest_pair(rest, wide)) and sum(pair) > smallest:
            taken[smallest] -= 1
            for n in pair:
                taken[n] = taken.get(n, 0) + 1
            taken = {n: k for n, k in taken.items() if k}
        bins = min(int(left[n]) // k for n, k in taken.items())
        for n, k in taken.items():
            left[n] -= k * bins
        plan.append((sorted(taken.items(), reverse=True), bins))
    return plan


def _tightest_pair(rest: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is as large as ``room`` allows."""
    lengths = np.flatnonzero(rest[:room])
    if not lengths.size:
        return None
    at = np.searchsorted(lengths, room - lengths, side="right") - 1
    same = (at >= 0) & (lengths[at] == lengths) & (rest[lengths] < 2)
    at = np.where(same, at - 1, at)
    total = np.where(at >= 0, lengths + lengths[at], 0)
    best = int(total.argmax())
    return (int(lengths[best]), int(lengths[at[best]])) if total[best] else None


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = True) -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` there; with ``with_ids`` also its token ids."""
    pieces = stage(token_pieces(documents, capacity, tokenizer, id_col, text_col, with_ids))
    counts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    # At most `capacity` rows come to the driver.
    plan = best_two_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)

    keys, each, first, offsets, used, sequences = [], [], [], [], {}, 0
    for filling, bins in plan:
        offset = 0
        for length, k in filling:
            keys.append(length * RANKS + used.get(length, 0))
            each.append(k)
            first.append(sequences)
            offsets.append(offset)
            used[length] = used.get(length, 0) + k * bins
            offset += k * length
        sequences += bins
    order = np.argsort(np.array(keys, dtype=np.int64))
    keys, each, first, offsets = (np.array(x, dtype=np.int64)[order] for x in (keys, each, first, offsets))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = (pieces.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("earlier")), ["part", "length"])
              .withColumn("nth", F.col("nth") + F.col("earlier")))
    kept = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "nth"))
            at = np.searchsorted(keys, length * RANKS + nth, side="right") - 1
            within = nth - keys[at] % RANKS
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept]
                + [pa.array(first[at] + within // each[at]), pa.array(offsets[at] + within % each[at] * length)],
                names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "nth").mapInArrow(place, schema)
