"""Groups of similar documents against the exact similarity of their sets of shingles."""

import os
import random
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from craterline.functions.stage import shared_folder
from craterline.llm import packing, similar, simhash, topk, vectors

SHIFT = 100_000


def planted(spark, low, high, pairs=400, words=(40, 700)):
    """Documents i and i + SHIFT of unrelated pairs, and the exact similarity of each pair, from low to high."""
    rng = random.Random(17)
    fresh = (f"w{i}" for i in range(10**9))
    rows, alike = [], {}
    while len(alike) < pairs:
        i = len(alike)
        text = [next(fresh) for _ in range(rng.randint(*words))]
        wanted = rng.uniform(low, high)
        copy = list(text)
        for at in rng.sample(range(len(text)), max(1, round(len(text) * (1 - wanted) / (1 + wanted) / 4.7))):
            copy[at] = next(fresh)
        a, b = ({tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in (text, copy))
        if low <= (j := len(a & b) / len(a | b)) < high:
            alike[i] = j
            rows += [(i, " ".join(text)), (i + SHIFT, " ".join(copy))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), alike


def test_pairs_over_the_threshold_are_found(spark):
    documents, alike = planted(spark, 0.8, 0.9)
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(documents).collect()}
    assert np.mean([found[i + SHIFT] == i for i in alike]) >= 0.995


def test_pairs_under_the_threshold_both_stay(spark):
    documents, alike = planted(spark, 0.5, 0.8)
    kept = {r.doc_id for r in simhash.representatives(documents).collect()}
    assert kept == {x for i in alike for x in (i, i + SHIFT)}


def test_sets_that_only_share_keys_in_blocks(spark, monkeypatch):
    """A chain of texts, each alike its neighbours only, and strangers that share a third of their text."""
    monkeypatch.setattr(similar, "BLOCK", 2)
    base = [f"w{i}" for i in range(1200)]
    rows = [(i, " ".join(base[20 * i:20 * i + 300])) for i in range(40)]
    rows += [(100 + i, " ".join([*base[:100], *(f"x{i}y{j}" for j in range(200))])) for i in range(40)]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == 0 for i in range(40)) and all(found[100 + i] == 100 + i for i in range(40))


def test_keys_and_marks_at_the_threshold():
    rng = np.random.default_rng(3)
    met, draws = 0, 1500
    for draw in range(draws):
        n = int(rng.choice([1, 2, 10, 60]))  # 8 n shared of 10 n, the rest dealt out at random
        h = rng.integers(0, 1 << 64, 10 * n, dtype=np.uint64)
        cut = int(rng.integers(8 * n, 10 * n + 1))
        least = [similar.minima(h[:cut]), similar.minima(np.r_[h[:8 * n], h[cut:]])]
        keys = [set(similar.band_keys(x)) for x in least]
        m = [similar.marks(x) for x in least]
        met += bool(keys[0] & keys[1]) and sum(int(x).bit_count() for x in (m[0] ^ m[1]).view(np.uint64)) <= similar.MARKS
    assert met / draws >= 0.997


def test_texts_under_one_id_stay_apart(spark):
    texts = [" ".join(f"{name}{i}" for i in range(50)) for name in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (2, texts[2]), (3, None), (3, ""), (None, texts[0])]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id in (1, 2)) == [(1, texts[0]), (1, texts[1]), (2, texts[2])]
    assert len(kept) == 5  # one row without text, one without id


def test_last_stage_delivers_token_ids(spark, odd_documents, monkeypatch):
    monkeypatch.setattr(packing, "HELD", 500)  # a task hands its ids on in parts
    rows = corpus_pipeline.pack(spark, odd_documents, "").collect()
    assert {"ids", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<i4").tobytes()) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in rows) == packing.token_pieces(odd_documents, with_ids=False).agg({"length": "sum"}).first()[0]


def test_links_across_cells_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FILLED", 20)
    rng = np.random.default_rng(4)
    rows = []
    for width in (6, 3):
        x = rng.normal(size=(400, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(x)]
    found = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for at in (0, 400):
        x = np.array([v for _, v in rows[at:at + 400]])
        assert [found[at + i] for i in range(400)] == ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()


def test_copies_of_an_id_spread_over_shards(spark):
    rows = spark.createDataFrame([(7, [1, 2])] * 4000, "id long, v array<long>").withColumn("number", F.monotonically_increasing_id())
    blocks = [len(r.shard_ids) // 8 for r in topk._packed(rows, 8, "shard").collect()]
    assert sum(blocks) == 4000 and len(blocks) == 8 and max(blocks) < 700


def test_only_sets_of_proposed_pairs_are_kept(spark):
    """Texts without a neighbour leave a sketch of fixed size, not their hashes; the sets of wanted texts are whole, one for each."""
    def bytes_kept():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared_folder(spark).removeprefix("file:")) for f in names)

    strangers = [(i, " ".join(f"w{i}x{j}" for j in range(5000))) for i in range(60)]
    pair = " ".join(f"p{j}" for j in range(300))
    documents = spark.createDataFrame([*strangers, (100, pair), (101, pair + " more"), (102, pair)], "doc_id long, text string")
    before = bytes_kept()
    found = {r.id: r.component for r in similar.grouped(documents, 5, 0.8, "doc_id", "text").collect()}
    assert found[100] == found[101] == found[102] and len(set(found.values())) == 61
    assert bytes_kept() - before < 60 * 5000 * 8 / 4

    rows = similar._sketches(documents, 5, "doc_id", "text")
    nodes = rows.groupBy("node").agg(F.min("digest").alias("digest"))
    sets = similar._sets(documents, nodes, rows.where("id >= 100").select("node").distinct(), 5, "text").collect()
    whole = sorted(sorted(np.unique(simhash.shingle_hashes(t.encode(), 5)).view(np.int64).tolist()) for t in (pair, pair + " more"))
    assert sorted(sorted(r.hashes) for r in sets) == whole
