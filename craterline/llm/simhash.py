"""Near-duplicates by SimHash, with Golay-code fuzzy hashing to find close fingerprints.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits, words of the binary Golay code
(23, 12). Every word lies within three bits of one code word and within four of one or six; those
code words are its keys. Two words two bits apart share a key: the word between them lies within
three bits of a code word, and so both lie within four. If two fingerprints differ in five bits or
fewer, two of the three segments differ in two bits or fewer, so a pair of segments gives a common
pair of keys. Fingerprints with a common pair of keys meet and are compared bit by bit; of the links
found, each task keeps a spanning forest, which loses no component.

``near_duplicates`` links 64-bit fingerprints at five bits or fewer, where nothing is missed.
``similar_documents`` links texts by the exact similarity of their sets of shingles (``similar.py``).

Equal fingerprints are one node, however many documents have them. A pair of keys under which very
many fingerprints meet is cut into blocks that are compared two by two, so no task holds it whole.

Null and empty texts have fingerprint zero, which is linked like any other. A row without id keeps its
row; it never names a component. Repeated rows keep their rows. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterline.functions.stage import stage
from craterline.llm.common import Memo, slices
from craterline.llm.components import Forest, components
from craterline.llm.similar import grouped, marked, text_digest

SEED = 42
#: The Golay code's generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: The keys find every pair of fingerprints that differ in so many bits or fewer.
REACH = 5
#: Fingerprints under one pair of keys that are compared in one block; one in SAMPLED of them is counted to find such keys.
BLOCK, SAMPLED = 4096, 64


def _syndrome(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the one or six lightest error patterns, and how many there are."""
    one = [_syndrome(1 << bit) for bit in range(23)]
    near, n = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    layer = {0: 0}  # pattern -> syndrome, by weight
    n[0] = 1
    for weight in range(1, 5):
        layer = {p | 1 << bit: s ^ one[bit] for p, s in layer.items() for bit in range(p.bit_length(), 23)}
        for pattern, s in layer.items():
            if weight <= 3 or int(near[s, 0]).bit_count() == 3:
                near[s, n[s]] = pattern
                n[s] += 1
    return near, n


NEAR, COUNT = _error_patterns()
_BYTE_SYNDROMES = np.array([[_syndrome(b << shift & 0x7FFFFF) for b in range(256)] for shift in (0, 8, 16)], dtype=np.int64)


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the code words within four bits of each 23-bit word, six columns, and how many count."""
    s = _BYTE_SYNDROMES[0][words & 255] ^ _BYTE_SYNDROMES[1][words >> 8 & 255] ^ _BYTE_SYNDROMES[2][words >> 16]
    return (words[:, None] ^ NEAR[s]) >> 11, COUNT[s]


def shared_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every pair of segments and every pair of their code words."""
    parts = [nearby((fingerprints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)) for at, width in SEGMENTS]
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, n), (b, m) = parts[i], parts[j]
        used = (np.arange(6)[None, :, None] < n[:, None, None]) & (np.arange(6)[None, None, :] < m[:, None, None])
        both = (np.int64(pair) << 24) | (a[:, :, None] << 12) | b[:, None, :]
        rows.append(np.nonzero(used)[0])
        keys.append(both[used])
    return np.concatenate(rows), np.concatenate(keys)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xD1B54A32D192ED03)
    return h ^ h >> np.uint64(32)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; none without words."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(islice(found, k, None) for k in range(words))))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(found) - words + 1)


def simhash(hashes: np.ndarray, run: int = 1 << 16) -> int:
    """The bits set in over half of the hashes; zero of none."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), run):
        total += np.unpackbits(hashes[at:at + run].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 4, parts: int = 1, repeats: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and fingerprint of every row, as ``parts`` longs f0, f1, ...; without ``repeats`` of the set of shingles."""
    kind, names = documents.schema[id_col].dataType.simpleString(), _names(parts)

    def digest(batches):
        Memo.serve("simhash")
        for batch in batches:
            bits = np.zeros((parts, len(batch)), dtype=np.uint64)
            for row, text in enumerate(chain.from_iterable(slices(batch.column(1)))):
                h = shingle_hashes(text, words)
                h = h if repeats else np.unique(h)
                for part in range(parts):
                    bits[part, row] = simhash(h)
                    h = _mixed(h)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(b.view(np.int64)) for b in bits)], names=[id_col, *names])

    return documents.select(F.col(id_col), F.col(text_col).cast("binary").alias("text")).mapInArrow(digest, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names))


def _names(parts: int) -> list[str]:
    return [f"f{i}" for i in range(parts)]


def _keyed(nodes: DataFrame, parts: int) -> DataFrame:
    """A row for each key of each node, with the node's number and fingerprint."""
    names = _names(parts)

    def spread(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                own = [batch.column(i).slice(at, 2000).to_numpy() for i in range(parts)]
                for part in range(parts):
                    rows, keys = shared_keys(own[part].view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys | part << 26), *(pa.array(f[rows]) for f in own)], names=["k", *names])

    return nodes.select(*names).mapInArrow(spread, "k long, " + ", ".join(f"{n} long" for n in names))


def node_number(fingerprint: list[np.ndarray]) -> np.ndarray:
    """A number for each fingerprint: itself, or 64 bits of a hash of several parts."""
    number = fingerprint[0]
    for more in fingerprint[1:]:
        number = (_mixed(number.view(np.uint64)) ^ more.view(np.uint64)).view(np.int64)
    return number


def _compared(max_bits: int, parts: int):
    """Compare the fingerprints that stand under one key; rows come sorted by key."""
    def settle(k, f, forest):
        number = node_number(f)
        distinct, own = np.unique(number, return_inverse=True)
        top = np.arange(len(distinct))  # the set each distinct fingerprint is in so far
        at, lag = np.arange(len(k) - 1), 1
        while (at := at[at + lag < len(k)]).size and (at := at[k[at + lag] == k[at]]).size:
            new = at[top[own[at]] != top[own[at + lag]]]
            differing = sum(np.bitwise_count((x[new] ^ x[new + lag]).view(np.uint64)).astype(np.int64) for x in f)
            new = new[differing <= max_bits]
            for x, y in zip(own[new].tolist(), own[new + lag].tolist(), strict=True):
                while top[x] != x:
                    x = top[x]
                while top[y] != y:
                    y = top[y]
                top[max(x, y)] = min(x, y)
            while new.size and (flat := top[top]).tobytes() != top.tobytes():
                top = flat
            lag += 1
        moved = np.flatnonzero(top != np.arange(len(top)))
        for x, y in zip(distinct[moved].tolist(), distinct[top[moved]].tolist(), strict=True):
            forest.link(x, y)

    def compare(batches):
        forest, held = Forest(), [np.zeros(0, np.int64)] * (parts + 1)
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last key may go on
            if done:
                settle(held[0][:done], [h[:done] for h in held[1:]], forest)
                held = [h[done:] for h in held]
        settle(held[0], held[1:], forest)
        yield from forest.batches()

    return compare


def close_links(nodes: DataFrame, max_bits: int, parts: int = 1) -> DataFrame:
    """Links (a, b) between node numbers, with the components of all links of ``max_bits`` or fewer that meet under a key."""
    names = _names(parts)
    counted = _keyed(nodes.where(F.pmod(F.xxhash64(*names), F.lit(SAMPLED)) == 0), parts).groupBy("k").count()
    crowded = stage(counted.where(F.col("count") * SAMPLED > BLOCK)
                    .select("k", F.least(F.ceil(F.col("count") * SAMPLED / BLOCK), F.lit(4095)).cast("long").alias("parts")))
    own = F.pmod(F.xxhash64(*names), F.col("parts"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = (_keyed(nodes, parts).join(crowded, "k", "left").select("k", *names, own.alias("own"), other.alias("other"))
              .select((F.shiftleft("k", 24) + F.coalesce(F.shiftleft(F.least("own", "other"), 12) + F.greatest("own", "other"), F.lit(0))).alias("k"), *names))
    return blocks.repartition("k").sortWithinPartitions("k").mapInArrow(_compared(max_bits, parts), "a long, b long")


def _grouped(rows: DataFrame, id_col: str, max_bits: int, parts: int) -> DataFrame:
    """Rows of fingerprints with ``component_id``, the smallest id reachable over links."""
    names = _names(parts)
    rows = stage(rows)
    nodes = stage(_numbered(rows.groupBy(*names).agg(F.min(id_col).alias("first")), parts))
    linked = components(close_links(nodes, max_bits, parts))
    named = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "component").select(*names, "component_id"), names)


def _numbered(nodes: DataFrame, parts: int) -> DataFrame:
    if parts == 1:
        return nodes.withColumn("node", F.col("f0"))

    def number(batches):
        for batch in batches:
            yield batch.append_column("node", pa.array(node_number([batch.column(i).to_numpy() for i in range(parts)])))

    return nodes.mapInArrow(number, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", node long")


def near_duplicates(documents: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest id reachable over links, of every row."""
    if max_bits > REACH:
        raise ValueError(f"these keys find fingerprints that differ in {REACH} bits or fewer")
    found = _grouped(fingerprints(documents, words, id_col=id_col, text_col=text_col), id_col, max_bits, 1)
    return found.select(id_col, F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def differing_bits(similarity: float, parts: int) -> int:
    """How many of the bits differ on average between sets of equal size with this Jaccard similarity."""
    return math.floor(64 * parts * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def similar_documents(documents: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``component_id`` of every row, where texts whose sets of shingles are ``least`` alike are linked."""
    rows = stage(grouped(documents, words, least, id_col, text_col))
    named = rows.groupBy("component").agg(F.min("id").alias("component_id"))
    return rows.join(named, "component").select(F.col("id").alias(id_col), "component_id")


def representatives(documents: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of similar documents: of the smallest id, then of the smallest digest of the text.

    Of repeated rows with that id and text one stays. Rows without id stay, since nothing names them apart.
    """
    known = documents.where(F.col(id_col).isNotNull())
    rows = stage(grouped(known, words, least, id_col, text_col))
    groups = stage(rows.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("first"), F.count("*").alias("n")))
    first = groups.select(F.col("first.id").alias("__id"), F.col("first.digest").alias("__digest"))
    # A text alone in its group stays without a shuffle; the others need one, since the digest that they are joined by tells repeats too.
    crowded = rows.join(groups.where("n > 1"), "component").select(F.col("digest").alias("__text"))
    known = marked(known.withColumn("__text", text_digest(text_col)), crowded, "__text", "__crowded")
    named = (known.where("__crowded").join(first, (F.col(id_col) == F.col("__id")) & (F.col("__text") == F.col("__digest")), "left_semi")
             .dropDuplicates([id_col, "__text"]).union(known.where("not __crowded")))
    return named.select(documents.columns).union(documents.where(F.col(id_col).isNull()))
