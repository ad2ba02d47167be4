"""Spelling variants, importance resampling and document fingerprints against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from craterline.llm import fingerprints, queries, resampling, sample_sort, spelling


# -- spelling variants -----------------------------------------------------------------------------

def one_edit(a, b):
    """Whether one inserted, deleted or replaced character makes the words equal."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(words, factor=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    rows = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return rows


def grouped(spark, words, **options):
    rows = [(w, n) for w, n in words.items()]
    got = spelling.group_variants(spark.createDataFrame(rows, "word string, n long"), **options).collect()
    assert len(got) == len(words)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def variants_of(word, rng, alphabet):
    i, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    letter = rng.choice(alphabet)
    return word[:i] + letter + word[i:] if kind == 0 else word[:i] + word[i + 1:] if kind == 1 else word[:i] + letter + word[i + 1:]


@pytest.mark.parametrize("block", [1024, 3])
def test_variants_equal_brute_force(spark, block):
    rng = random.Random(5)
    alphabet = "abñÿ\U0001F600"  # few letters, so that words meet under several keys
    words = {}
    for _ in range(40):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(7, 16)))
        for _ in range(12):
            words[word] = rng.choice([2, 3, 20, 30, 200, 2500, 30_000])
            word = variants_of(word, rng, alphabet)
            if len(word) < 7:
                break
    words = {w: n for w, n in words.items() if len(w) >= 7}
    assert grouped(spark, words, block=block) == brute_variants(words)


def test_variants_of_runs_of_one_letter_and_long_words(spark):
    """Insertions in runs have no single place; a long word has few keys."""
    words = {"a" * k: 2 * 11 ** (k - 7) for k in range(7, 15)}
    long = "xyz" * 5_000
    words |= {long: 50, long[:7_000] + long[7_001:]: 3, long + "x": 5, "q" + long[1:]: 2}
    got = grouped(spark, words)
    assert got == brute_variants(words)
    assert got["aaaaaaa"][1] == "a" * 14


def test_crowded_key_is_cut_into_blocks(spark):
    """A thousand words that differ in one place only: pairs are counted, not listed."""
    words = {f"gemeinsam{chr(0x4E00 + i)}es": 2 + i % 3 for i in range(1000)}
    got = grouped(spark, words, block=64)
    assert all(r[3] == 999 and r[0] is None for r in got.values())


def test_ties_repeated_rows_nulls_and_empty_table(spark):
    rows = [("variant", 1), ("variant", 1), (None, 5), ("shorts", 90), ("variantz", 30), ("variants", 30), ("single_", 1), ("variant", 0)]
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert set(got) == {"variant", "variants", "variantz"}
    assert (got["variant"].form, got["variant"].n, got["variant"].n_near) == ("variants", 2, 2)
    assert got["variants"].root == "variants" and got["variants"].form_n is None
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError, match="factor"):
        spelling.group_variants(spark.createDataFrame([], "word string, n long"), factor=1)


def test_counted_words_with_planted_damage(odd_documents, no_documents):
    rows = odd_documents.collect()
    want = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 3 == 0 else run
            if len(word) >= 3:
                want[word] += 1
    got = spelling.count_words(odd_documents, shortest=3, every=3).groupBy("word").agg(F.sum("n").alias("n")).collect()
    assert {r.word: r.n for r in got} == want
    assert spelling.count_words(no_documents, every=31).count() == 0


# -- importance resampling -------------------------------------------------------------------------

def brute_draw(documents, target, percent, longest, buckets, fewest):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in documents for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in documents:
        n, found = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append((doc, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    some = sorted((r for r in rows if r[1] >= fewest), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = percent * len(some) // 100
    return Counter([(*r, k + 1) for k, r in enumerate(some[:drawn])] + [(*r, None) for r in some[drawn:]] + [(*r, None) for r in rows if r[1] < fewest])


@pytest.mark.parametrize("longest", [1, 3])
def test_draw_equals_brute_force(spark, odd_documents, longest):
    target = spark.createDataFrame([("w1 w2 w3 w4 W1",), (None,), ("w299 日本語",)], "text string")
    documents = [(r.doc_id, r.text) for r in odd_documents.collect()]
    want = brute_draw(documents, [r.text for r in target.collect()], 40, longest, 97, 5)
    got = resampling.resample(odd_documents, target, 40, longest=longest, buckets=97, fewest=5, segment=4).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got) == want


def test_draw_of_empty_tables(spark, odd_documents, no_documents):
    assert resampling.resample(no_documents, odd_documents, 10).count() == 0
    assert resampling.resample(odd_documents, no_documents, 10).count() == odd_documents.count()


def test_ranks_with_a_third_of_the_rows_alike(spark):
    """Equal keys spread over segments, negative and extreme scores, a null id last among ties."""
    rng = random.Random(11)
    rows = [(7, 100)] * 900 + [(rng.randrange(500), rng.choice([-5, 0, 100, 2 ** 62, -2 ** 63])) for _ in range(1800)] + [(None, 100)]
    frame = spark.createDataFrame(rows, "id long, score long").repartition(7).withColumn("take", F.lit(True))
    keys = frame.withColumn("row", F.monotonically_increasing_id())
    cuts = sample_sort.splitters(keys, len(rows), segment=100, step=8)
    own = sample_sort._segment(np.array([r[1] for r in rows]), np.array([sample_sort.LAST if r[0] is None else r[0] for r in rows]),
                               np.arange(len(rows)) * 0 + np.arange(len(rows)), cuts)
    assert len(cuts[0]) == len(rows) // 100 and own.max() == len(cuts[0])
    sizes = [r["count"] for r in sample_sort.ranked(frame, "score", "id", segment=100, step=8).groupBy((F.col("rank") / 100).cast("int")).count().collect()]
    assert sum(sizes) == len(rows)
    got = sorted((r["rank"], r.score, r.id) for r in sample_sort.ranked(frame, "score", "id", segment=100, step=8).collect())
    want = sorted(((i, s) for i, s in rows), key=lambda r: (-r[1], r[0] is None, r[0]))
    assert [(s, i) for _, s, i in got] == [(s, i) for i, s in want] and [g[0] for g in got] == list(range(1, len(rows) + 1))


def test_samples_are_sampled_until_few(spark, monkeypatch):
    monkeypatch.setattr(sample_sort, "ON_DRIVER", 200)
    keys = spark.range(0, 20_000, numPartitions=5).select(F.xxhash64("id").alias("score"), "id", F.col("id").alias("row"))
    cuts = sample_sort.splitters(keys, 20_000, segment=2_000, step=16)
    assert len(cuts[0]) == 9 and sorted(cuts[0], reverse=True) == cuts[0].tolist()
    scores = np.sort(np.array([r.score for r in keys.collect()]))[::-1]
    sizes = np.diff(np.searchsorted(-scores, -cuts[0]))
    assert sizes.max() < 2 * 2_000


# -- fingerprints ----------------------------------------------------------------------------------

def plain_fingerprint(text):
    """One byte after the other."""
    def pieces(size):
        out, start, window = [], 0, [0] * 7
        for i, byte in enumerate(text):
            window = [byte, *window[:6]]
            total = sum(b * pow(0x01000193, j + 1, 1 << 32) for j, b in enumerate(window)) % (1 << 32)
            total = (total ^ total >> 15) * 0x9E3779B1 % (1 << 32) >> 8
            if total % size == size - 1:
                out.append(text[start:i + 1])
                start = i + 1
        return out + [text[start:]] * (start < len(text) or not out), len(out)
    size = 4
    while pieces(size)[1] > 63:
        size *= 2
    return ":".join([str(size), *("".join(fingerprints.ALPHABET[zlib.crc32(p) >> 26] for p in pieces(s)[0]) for s in (size, 2 * size))])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=1500), max_size=4))
def test_fingerprints_equal_plain_ones(texts):
    assert fingerprints.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_fingerprint_of_long_and_uniform_texts():
    rng = random.Random(2)
    long = " ".join(str(rng.random()) for _ in range(3_000)).encode()
    assert fingerprints.fingerprints([b"x", long, b""])[1] == plain_fingerprint(long)
    pos, exp = fingerprints.possible_ends(long, block=1000)
    assert (pos == fingerprints.possible_ends(long)[0]).all() and (exp == fingerprints.possible_ends(long)[1]).all()
    size, one, two = fingerprints.fingerprints([b"z" * 3_000_000])[0].split(":")
    assert len(one) <= 64 and len(two) <= 64


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_likeness(f, g):
    if f == g:
        return 1.0
    (a, a1, a2), (b, b1, b2) = f.split(":"), g.split(":")
    pairs = [(a1, b1), (a2, b2)] if a == b else [(a1, b2)] if int(a) == 2 * int(b) else [(a2, b1)] if 2 * int(a) == int(b) else []
    best = 0.0
    for x, y in pairs:
        run = min(7, len(x), len(y))
        if any(x[i:i + run] in y for i in range(len(x) - run + 1)):
            best = max(best, 1 - distance(x, y) / max(len(x), len(y)))
    return best


def test_neighbours_equal_brute_force(spark, odd_documents, no_documents):
    from pyspark.sql import functions as G
    rows = odd_documents.select("doc_id", "text", G.xxhash64(G.coalesce("text", G.lit(""))).alias("h")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    texts = [r.text or "" for r in rows]
    want = Counter()
    for k, (r, text) in enumerate(zip(rows, texts, strict=True)):
        following = texts[(k + 1) % len(rows)]
        cut = len(text) // 4
        new = (text[:len(text) - cut] + following[:cut]).encode()
        own, changed, behind = fingerprints.fingerprints([text.encode(), new, following.encode()])
        want[(r.doc_id, len(text), hashlib.sha256(new).hexdigest(), own, changed, round(plain_likeness(own, changed), 12), round(plain_likeness(own, behind), 12))] += 1
    for frame in (odd_documents, odd_documents.coalesce(1)):
        got = fingerprints.compare_neighbours(frame).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in got) == want
    assert fingerprints.compare_neighbours(no_documents).count() == 0


def test_one_document_is_its_own_neighbour(spark):
    r = fingerprints.compare_neighbours(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r[0].near_next == 1.0


def test_edits_stay_near_and_strangers_do_not(spark):
    rows = queries.op13_document_fingerprints(spark, "/root/testdata/sf0.01").collect()
    long = [r for r in rows if r.n_chars >= 500]
    assert np.mean([r.near_edited >= 0.5 for r in long]) > 0.95 and np.mean([r.near_next == 0 for r in long]) > 0.95
    same = defaultdict(set)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect():
        same[r.text].add(r.doc_id)
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert all(len({prints[i] for i in ids}) == 1 for ids in same.values())
