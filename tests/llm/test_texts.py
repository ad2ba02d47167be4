"""Packing, tokenizers, fingerprints, languages, toxicity and language-model scores against brute force."""

import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from craterline.llm import common, language, packing, pitman_yor, sentencepiece_codec, simhash, token_count, toxicity
from craterline.llm.common import is_rest, word_runs
from craterline.llm.model_file import MODEL, read_model


def by_row(df):
    return [r.asDict() for r in df.collect()]


# -- memory of a worker ----------------------------------------------------------------------------

def test_a_worker_gives_memory_back_at_each_change_of_operator(monkeypatch):
    given_back = []
    monkeypatch.setattr(common, "give_back", lambda: given_back.append(common.Memo._owner))
    common.Memo.serve("similar")  # has no large objects
    given_back.clear()
    common.Memo.serve("some other")
    assert given_back == ["some other"]
    common.Memo.serve("some other")
    assert len(given_back) == 1


def test_the_packing_encoder_holds_its_model_once(monkeypatch):
    read = []
    monkeypatch.setattr(packing, "Tokenizer", type("Counting", (), {
        "__new__": lambda cls, model: Tokenizer(model), "from_file": staticmethod(lambda path: (read.append(path), Tokenizer.from_file(path))[1])}))
    encoder = packing.WordEncoder(packing.TOKENIZER)
    assert read == [packing.TOKENIZER]
    want = encoder.full.encode("It's <|endoftext|> here, 42 times!", add_special_tokens=False).ids + [0]
    assert np.frombuffer(encoder.texts([b"It's <|endoftext|> here, 42 times!"])[0], "<u4").tolist() == want


# -- packing ---------------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=60))
def test_word_ids_equal_whole_text(text):
    want = packing.encoder(packing.TOKENIZER).full.encode(text, add_special_tokens=False).ids + [0]
    got = packing.encoder(packing.TOKENIZER).texts([text.encode()])[0]
    assert np.frombuffer(got, "<u4").tolist() == want


def test_packed_pieces_equal_whole_text_encoding(odd_documents):
    rows = by_row(packing.pack(odd_documents, capacity=512))
    full = Tokenizer.from_file(packing.TOKENIZER)
    want = Counter()
    for r in odd_documents.collect():
        ids = full.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 512)):
            own = ids[at:at + 512]
            want[(r.doc_id, k, at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 512
    assert len(sequences) <= math.ceil(sum(r["length"] for r in rows) / 512) + 1


def test_pack_empty_table(no_documents):
    assert packing.pack(no_documents).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=20))
def test_best_two_fit_packs_every_piece_once(counts):
    plan = packing.best_two_fit(counts, 60)
    used = Counter()
    for filling, bins in plan:
        assert sum(n * k for n, k in filling) <= 60 and bins > 0
        for n, k in filling:
            used[n] += k * bins
    assert used == Counter(counts)
    first_fit = []
    for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        for i, gap in enumerate(first_fit):
            if gap >= n:
                first_fit[i] -= n
                break
        else:
            first_fit.append(60 - n)
    assert sum(bins for _, bins in plan) <= len(first_fit) + 1


def test_best_two_fit_replaces_the_smallest():
    # Greedy takes 6 and 3; two pieces of 2 fill the widened gap of 4 exactly.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0][0] == [(6, 1), (2, 2)]


# -- tokenizers ------------------------------------------------------------------------------------

def test_token_counts_equal_the_library(odd_documents):
    model = read_model()
    library = Tokenizer(models.Unigram([(t, s) for t, s, _ in model.pieces], model.unknown_id, model.byte_fallback))
    own = token_count.counter(MODEL)
    for r, n in [(r, own.counts([r.text])[0]) for r in odd_documents.collect()]:
        assert n == (None if r.text is None else len(library.encode(own.normal(r.text)).ids) if r.text else 0)
    got = Counter((r["doc_id"], r["n_tokens"]) for r in by_row(token_count.count_tokens(odd_documents)))
    assert got == Counter((r.doc_id, own.counts([r.text])[0]) for r in odd_documents.collect())


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc ▁é日", max_size=14), st.booleans())
def test_viterbi_equals_all_segmentations(text, fallback):
    model = read_model()
    pieces = [("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -2.0, 1), ("ab", -3.0, 1), ("▁", -2.0, 1), ("▁a", -3.0, 1), ("ba", -2.5, 1), ("abc", -4.5, 1), ("bb", -4.0, 1)]
    pieces += [(f"<0x{i:02X}>", -50.0, 6) for i in range(256)]
    model.pieces, model.byte_fallback = pieces, fallback
    library = Tokenizer(models.Unigram([(t, s) for t, s, _ in pieces], 0, fallback))
    own = token_count.Counter(model)
    assert own.counts([text])[0] == (len(library.encode(own.normal(text)).ids) if text else 0)


def test_codec_parity_and_round_trip(odd_documents):
    encoded = sentencepiece_codec.encode(odd_documents)
    peer = sentencepiece_codec.codec(MODEL).peer
    rows = by_row(encoded)
    texts = {r.doc_id: r.text for r in odd_documents.collect() if r.doc_id is not None}
    for r in rows:
        if r["n_ids"] is None:
            assert r["ids"] is None
            continue
        assert r["round_trip"] and r["parity"]
        if r["doc_id"] is not None:
            assert r["ids"] == peer.encode(texts[r["doc_id"]])
    assert len(rows) == odd_documents.count()
    back = {r["doc_id"]: r["text"] for r in by_row(sentencepiece_codec.decode(encoded))}
    assert all(back[i] == (t and t.replace("▁", " ")) for i, t in texts.items())


def test_parity_is_a_comparison(monkeypatch):
    own = sentencepiece_codec.Codec(MODEL)
    assert own.peer_ids(["▁new", "▁", "bare"]) == [own.peer.encode("new"), None, None]
    assert [r and r[3] for r in own.encode(["new words", "", None])] == [True, True, None]
    # A tokenizer that differs is found out, with the blank in front given by the peer or not.
    words = ["▁new", "▁words"]
    ids = [[1, 2, 3], [4]]
    monkeypatch.setattr(own, "peer_ids", lambda asked: [None if w == "▁" else ids[words.index(w)] for w in asked])
    assert [r[3] for r in own.encode_words(words)] == [False, False]
    assert own._whole([(b"", 1, True, None), (b"", 1, True, True)])[3] is True
    assert own._whole([(b"", 1, True, None)])[3] is None


def test_words_that_pass_are_kept_as_their_ids(monkeypatch):
    """A worker keeps plain bytes for them, and all four results for the others."""
    own = sentencepiece_codec.Codec(MODEL)
    (ids, n, back, same), = own.encode(["some plain words"])
    assert np.frombuffer(ids, "<u4").tolist() == own.peer.encode("some plain words") and (n, back, same) == (len(ids) // 4, True, True)
    assert own.memo.known and all(type(r) is bytes for r in own.memo.known.values())
    own.memo.known.clear()
    monkeypatch.setattr(own, "peer_ids", lambda asked: [None if "plain" in w else [] for w in asked])
    assert own.encode(["some plain words"]) == [(ids, n, True, False)]
    assert own.encode(["plain"])[0][3] is None


def test_words_without_blank_in_front_are_compared():
    own = sentencepiece_codec.Codec(MODEL)
    own.model.add_dummy_prefix, own.model.remove_extra_whitespaces = False, True  # the peer adds its own blank to LEAD only
    assert own.peer_ids(["▁new", "▁words"]) == [own.peer.encode("new"), own.peer.encode("words")]


# -- fingerprints ----------------------------------------------------------------------------------

def test_golay_code_is_perfect():
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    found, n = simhash.nearby(words)
    codewords = {i: next(w for w in range(i << 11, (i + 1) << 11) if simhash._syndrome(w) == 0) for i in range(0, 4096, 37)}
    for word, keys, k in zip(words.tolist(), found.tolist(), n.tolist(), strict=True):
        assert k in (1, 6) and len(set(keys[:k])) == k
        for i, c in codewords.items():
            assert (i in keys[:k]) == ((c ^ word).bit_count() <= (4 if k == 6 else 3))


def test_keys_find_every_pair_within_five_bits():
    rng = random.Random(5)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            b ^= 1 << bit
        rows, keys = simhash.shared_keys(np.array([a, b], dtype=np.uint64))
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def brute_components(fingerprints, bits):
    parent = list(range(len(fingerprints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(fingerprints)), 2):
        if (fingerprints[a] ^ fingerprints[b]).bit_count() <= bits:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(fingerprints))]


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(odd_documents, monkeypatch):
    rows = odd_documents.collect()
    fingerprints = [brute_fingerprint(r.text, 4) for r in rows]
    names = {}
    for row, root in zip(rows, brute_components(fingerprints, 4), strict=True):
        if row.doc_id is not None:
            names[root] = min(names.get(root, row.doc_id), row.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", names.get(root)) for r, f, root in zip(rows, fingerprints, brute_components(fingerprints, 4), strict=True))
    monkeypatch.setattr(simhash, "BLOCK", 2)  # every crowded key is cut into blocks
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in by_row(simhash.near_duplicates(odd_documents)))
    assert got == want


def test_long_chain_of_close_fingerprints_is_one_component(spark):
    chain = [(1 << i) - 1 for i in range(0, 63, 3)]
    nodes = spark.createDataFrame([(x,) for x in chain], "f0 long")
    from craterline.llm.components import components
    found = components(simhash.close_links(nodes, 3)).collect()
    assert len(found) == len(chain) and {r.component for r in found} == {0}


def test_similar_documents_find_copies_and_leave_others(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows, edited = [], {}
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(80, 600))]
        rows.append((i, " ".join(text)))
        for j, share in enumerate((0.0, 0.005, 0.01, 0.2)):  # words replaced
            copy = [rng.choice(words) if rng.random() < share else w for w in text]
            a, b = ({tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in (text, copy))
            rows.append((1000 * (j + 1) + i, " ".join(copy)))
            edited[1000 * (j + 1) + i] = len(a & b) / len(a | b)
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    merged = {i: found[i] == found[i % 1000] for i in edited}
    assert all(merged[i] for i, j in edited.items() if j == 1)
    assert np.mean([merged[i] for i, j in edited.items() if 0.9 <= j < 1]) > 0.95
    assert not any(merged[i] for i, j in edited.items() if j < 0.5)
    assert all(found[i] % 1000 == i % 1000 for i in found)


def test_recall_of_keys_against_brute_force():
    rng = np.random.default_rng(12)
    reach, met, total = simhash.differing_bits(0.8, 2), 0, 0
    for _ in range(1500):  # sets 0.8 to 0.95 alike
        alike = rng.uniform(0.8, 0.95)
        flips = rng.random(128) < math.acos(2 * alike / (1 + alike)) / math.pi
        if flips.sum() > reach:
            continue
        a = rng.integers(0, 2, 128)
        pair = np.packbits(np.stack([a, a ^ flips]), axis=1).view(">u8").astype(np.uint64)
        total += 1
        met += any(set(k[r == 0].tolist()) & set(k[r == 1].tolist()) for r, k in (simhash.shared_keys(pair[:, part].copy()) for part in range(2)))
    assert met / total >= 0.9


def test_representatives(odd_documents, no_documents):
    kept = simhash.representatives(odd_documents)
    assert kept.columns == odd_documents.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {5, 8} <= set(ids) and 6 not in ids and 1 not in ids and 0 in ids
    assert sum(r.doc_id is None for r in rows) == 2
    assert simhash.representatives(no_documents).count() == 0 and simhash.near_duplicates(no_documents).count() == 0


# -- languages -------------------------------------------------------------------------------------

def test_forward_sum_equals_all_segmentations():
    own = language.pieces(MODEL)
    rng = np.random.default_rng(2)
    probability = rng.random((len(own.texts), 2)) * 0.01
    number = {t: i for i, t in enumerate(own.texts)}

    def total(word, k):
        if not word:
            return 1.0
        found = sum(probability[number[word[:n]], k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in number)
        return found + (0 if word[0] in number else language.UNKNOWN * total(word[1:], k))

    words = ["▁the", "▁einheit", "▁q", "▁東", "▁añ東o"]
    logs = own.log_probability(words, probability)
    for row, word in enumerate(words):
        for k in range(2):
            assert math.isclose(logs[row, k], math.log(total(word, k)), rel_tol=1e-9)
    counts = np.array([[2.0, 1.0], [1.0, 0.0], [0.0, 3.0], [1.0, 1.0], [1.0, 1.0]])
    expected = own.expected_counts(words, counts, probability)
    step = 1e-6  # expected counts are the derivative of the log probability by the log of a piece's probability
    for piece in ("▁the", "▁", "heit", "t"):
        i = number[piece]
        moved = probability.copy()
        moved[i] *= math.exp(step)
        slope = (counts * (own.log_probability(words, moved) - logs)).sum(axis=0) / step
        assert np.allclose(expected[i], slope, rtol=1e-3, atol=1e-6)


def test_language_accuracy_and_cases(spark, odd_documents, no_documents):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = is_rest("doc_id", 4, 2)
    model = language.learn(documents.where(~held_out))
    found = language.identify(documents.where(held_out), model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)
    rows = by_row(language.identify(odd_documents, model))
    assert len(rows) == odd_documents.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert language.identify(no_documents, model).count() == 0
    nothing = language.learn(no_documents)
    assert {r["lang_pred"] for r in by_row(language.identify(odd_documents, nothing))} == {"und"}
    assert language.kept(odd_documents, nothing).columns == odd_documents.columns


# -- toxicity --------------------------------------------------------------------------------------

def test_folding():
    assert toxicity.fold("ST​UР1D, 1dіot! ｉｄｉｏｔ") == f" {toxicity.fold('stupid').strip()} {toxicity.fold('idiot').strip()} {toxicity.fold('idiot').strip()} "


def test_exceptions_cover_their_matches():
    lexicon = toxicity.Lexicon({"trash": 4.0}, ["trash can"], 1.0, 0.0)
    assert lexicon.hits(toxicity.fold("a trash can")) == []
    assert [t for t, _ in lexicon.hits(toxicity.fold("trash, a trash can and tra5h"))] == ["trash", "trash"]


def test_toxicity_learns_terms_and_exceptions(spark, odd_documents, no_documents):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if i % 6 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(["nasty", "vile"]))
        elif i % 6 == 1:
            text += ["nasty", "weather"]
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    documents = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(documents, documents.select("doc_id", "toxic"))
    assert toxicity.fold("vile").strip() in lexicon.weights
    found = toxicity.score(documents, lexicon).join(documents, "doc_id").collect()
    assert all(r.predicted == 1 for r in found if "vile" in r.text)
    assert not any(r.predicted for r in found if "weather" in r.text)
    assert len(by_row(toxicity.score(odd_documents, lexicon))) == odd_documents.count()
    assert toxicity.score(no_documents, lexicon).count() == 0
    empty = toxicity.learn(odd_documents, documents.where("false"))
    assert {r["score"] for r in by_row(toxicity.score(odd_documents, empty))} == {0.0}
    assert toxicity.kept(odd_documents, empty).columns == odd_documents.columns


def test_toxicity_held_out(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    held_out = is_rest("doc_id", 5, 0)
    lexicon = toxicity.learn(documents, labels.where(~held_out))
    rows = toxicity.score(documents.where(held_out), lexicon).join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.85 and np.mean([r.predicted for r in clean]) < 0.01


# -- language model --------------------------------------------------------------------------------

def test_scores_and_base(spark, odd_documents, no_documents):
    train = ~is_rest("doc_id", 7, 2)
    rows = by_row(pitman_yor.score(odd_documents, train))
    counts = Counter()
    tokens = [(r, (r.text or "").encode().lower().split() + [None]) for r in odd_documents.collect()]
    for r, own in tokens:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((-1 if r.doc_id is None else r.doc_id), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6))
                  for r, own in tokens)
    assert want == sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert sorted(r["score"] for r in rows) == sorted(r["score"] for r in by_row(pitman_yor.score(odd_documents, train)))
    assert pitman_yor.score(no_documents, train).count() == 0
    untrained = by_row(pitman_yor.score(odd_documents, F.lit(False)))
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in untrained)


def test_counts_beyond_32_bits():
    for counts in ([], [0, 7], [2**32 - 1], [2**32, 1], [3, 2**40, 0]):
        assert pitman_yor.read_counts(pitman_yor.count_bytes(np.array(counts, dtype=np.int64)), len(counts)).tolist() == counts


def test_probabilities_of_a_context_add_up_to_one():
    rng = np.random.default_rng(8)
    words = np.sort(np.array([pitman_yor.word_key(f"w{i}".encode()) for i in range(40)], dtype=np.uint64))
    pairs = np.unique(rng.integers(0, 40 * pitman_yor.FINE, 500))
    counts = rng.geometric(0.3, len(pairs))
    words_used, at = np.unique(pairs // pitman_yor.FINE, return_inverse=True)
    bucket = pitman_yor.Bucket(words[words_used], at * pitman_yor.FINE + pairs % pitman_yor.FINE, counts)
    first = bucket.first()
    sums = pitman_yor.Sums(np.r_[np.bincount(bucket.fine, counts, pitman_yor.FINE), bucket.tables(first), len(words_used),
                                 [(c == n).sum() for c in (counts, first.c1, first.c0) for n in (1, 2)]].astype(float))
    for _ in range(3):
        *_, (_, last) = sums.seatings(bucket, 0, len(sums.history))
        assert (last.t2 <= counts).all() and (last.t1 <= last.c1).all() and (last.t2 >= 1).all()
        sums.history.append(bucket.tables(last))
    asked = np.append(bucket.words, np.uint64(12345))  # and one unknown word
    for fine in (0, 17, 100, pitman_yor.START):
        p, _ = pitman_yor.Predictive(bucket, 0, sums).of(asked, np.ones(len(asked), np.uint16), np.full(len(asked), fine, np.uint16))
        assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def test_tables_follow_the_restaurant():
    rng = np.random.default_rng(1)
    got = pitman_yor.seat(np.full(4000, 60), np.full(4000, 2.0), 0.5, rng)
    plain = []
    for _ in range(4000):
        tables = 1
        for k in range(1, 60):
            tables += rng.random() < 2.0 / (2.0 + k - 0.5 * tables)
        plain.append(tables)
    assert abs(got.mean() - np.mean(plain)) < 0.15 and abs(got.std() - np.std(plain)) < 0.15


def test_word_runs_cut_no_word():
    data = b"ab cde\tf  ghij\nk"
    for size in range(1, 20):
        assert [w for run in word_runs(data, size) for w in run] == data.split()


@pytest.mark.parametrize("name", ["op2_token_counts", "op5_best_fit_packing", "op8_sentencepiece"])
def test_queries_keep_every_document(spark, name):
    import __spark_entry__ as entry
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.select("doc_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_a_codec_starts_no_threads():
    """A task has one core; threads of the library would cost CPU beside it."""
    code = ("import os; from craterline.llm import sentencepiece_codec as s; c = s.codec(s.MODEL); n = len(os.listdir('/proc/self/task'));"
            "c.encode([' '.join(f'word{i}' for i in range(20000))]); print(len(os.listdir('/proc/self/task')) - n)")
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout.split() == ["0"]
