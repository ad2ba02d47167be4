"""Vector search, embedding near-duplicates, chats and the pipeline against brute force."""

import json
import math
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare
from craterline.llm import chat, simhash, topk, vectors

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1, "x") for i in range(120)]
    rows += [(200 + i, [float(x) for x in np.array(rows[i][1]) + rng.normal(size=8) * 0.05], 1, "x") for i in range(60)]
    rows += [(300 + i, rows[3][1], 1, "x") for i in range(30)]
    rows += [(400, None, 1, "x"), (401, [], 1, "x"), (402, [0.0] * 8, 1, "x"), (403, [math.nan] + [1.0] * 7, 1, "x"), (404, [None] + [1.0] * 7, 1, "x"),
             (405, [math.inf] + [1.0] * 7, 1, "x"), (406, [1.0, 2.0], 1, "x"), (407, [1e200] * 8, 1, "x"), (408, [1e-200] * 8, 1, "x"), (None, rows[5][1], 1, "x"), rows[7]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int, kept string").repartition(3)


def test_top_k_equals_brute_force(odd_vectors, monkeypatch):
    small = odd_vectors.where("vec_id is null or vec_id <> 407")
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rows = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in small.collect()
            if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = Counter()
    for q, v in {q: v for q, v in sorted(rows) if q % 5 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for c, w in rows if c != q)[:5]
        want.update((q, rank, c, -s) for rank, (s, c) in enumerate(found, 1))
    assert Counter(map(tuple, topk.top_k(small, small.where("vec_id % 5 = 0")).collect())) == want


def test_maxscore_skips_only_what_cannot_win():
    rng = np.random.default_rng(3)
    shard, queries = rng.integers(-90, 90, (3000, 16)), rng.integers(-90, 90, (40, 16))
    shard[:2000] //= 10
    ids = rng.permutation(3000)
    for q, (query_id, found, scores) in zip(queries, topk.search_shard(np.arange(40) + 5000, queries, ids, shard, 7), strict=True):
        every = shard @ q
        best = np.lexsort((ids, -every))[:7]
        assert found.tolist() == ids[best].tolist() and scores.tolist() == every[best].tolist()


def test_scores_beyond_64_bits(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    more = [(500 + i, [x * 10.0 ** (4 * i), 1.0, -x, 0.5] * 2) for i in range(40) for x in (1.5, -2.5)] + [(600, [sys.float_info.max] * 8), (601, [-1e308] * 8)]
    every = odd_vectors.select("vec_id", "embedding").union(spark.createDataFrame(more, "vec_id long, embedding array<double>"))

    def whole(x):
        return math.floor(256 * x) if math.isfinite(256 * x) else int(math.copysign(sys.float_info.max, x))

    rows = [(r.vec_id, [whole(x) for x in r.embedding]) for r in every.collect()
            if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    asked = {}
    for q, v in sorted(rows):
        if q % 5 == 0:
            asked.setdefault(q, v)
    found = Counter()
    for r in topk.top_k(every, every.where("vec_id % 5 = 0")).collect():
        found[r.query_id] += 1
        scores = sorted((min(2**63 - 1, max(-2**63, sum(a * b for a, b in zip(asked[r.query_id], w, strict=False)))), -c) for c, w in rows if c != r.query_id)
        assert r.score == scores[-r["rank"]][0]
    assert found == Counter(dict.fromkeys(asked, 5))
    best = topk.top_k(every, every.where("vec_id = 407")).where("rank <= 2").orderBy("rank").collect()
    assert [r.vec_id for r in best] == [600, max((c for c, _ in rows if 500 <= c < 600), key=lambda c: max(sum(w) for i, w in rows if i == c))]


def test_top_k_with_few_candidates(spark, odd_vectors):
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(two.where("false"), two.where("false")).count() == 0


def test_embedding_near_duplicates_equal_brute_force(odd_vectors, monkeypatch):
    monkeypatch.setattr(vectors, "FILLED", 30)
    rows = odd_vectors.collect()
    units = []
    for r in rows:
        good = r.embedding is not None and len(r.embedding) == 8 and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)
        x = np.array(r.embedding) / max(map(abs, r.embedding)) if good else None
        units.append(x / np.linalg.norm(x) if good else None)
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and float(units[a] @ units[b]) >= 0.95:
                n[a] += 1
                n[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, r in enumerate(rows):
        if r.vec_id is not None:
            least[root(i)] = min(least.get(root(i), r.vec_id), r.vec_id)
    want = Counter((r.vec_id, n[i], least.get(root(i), r.vec_id)) for i, r in enumerate(rows))
    # With a margin that lets everyone visit every cell nothing can be missed, and no pair may count twice.
    got = vectors.near_duplicates(odd_vectors, margin=3.0, block=16).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    found = sum(r.n_links for r in vectors.near_duplicates(odd_vectors).collect())
    assert 0.9 * sum(n) <= found <= sum(n)
    exact = vectors.near_duplicates(odd_vectors, margin=None, block=16).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in exact) == want
    assert vectors.near_duplicates(odd_vectors.where("false")).count() == 0


def test_links_in_many_cells_of_many_dimensions(spark, monkeypatch):
    """Partners at cosines from 0.95 on in 64 dimensions and 20 cells: the bound loses none, a margin next to none, at far fewer products."""
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    topics = unit(rng.normal(size=(25, 64)))
    base = unit(topics[rng.integers(0, 25, 1500)] + 0.12 * rng.normal(size=(1500, 64)))
    away = rng.normal(size=(500, 64))
    away = unit(away - (away * base[:500]).sum(1, keepdims=True) * base[:500])
    cosine = np.linspace(0.9501, 0.999, 500)[:, None]
    rows = np.vstack([base, cosine * base[:500] + np.sqrt(1 - cosine ** 2) * away])
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>").repartition(4)
    close = unit(rows) @ unit(rows).T >= 0.95
    np.fill_diagonal(close, False)
    want = close.sum(1)
    products, real = [], vectors._found

    def counted(nodes, width, n, least, margin, block, filled):
        centres = vectors.spherical_k_means(rows, round(n / filled))
        placed = vectors._placed(nodes.select("node", "copies", "v"), centres, width, least, margin)
        sizes = placed.groupBy("cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("h"), F.count("*").alias("n")).collect()
        products.append(sum(r.h * (r.h - 1) // 2 + r.h * (r.n - r.h) for r in sizes))
        return real(nodes, width, n, least, margin, block, filled)

    monkeypatch.setattr(vectors, "_found", counted)
    exact = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame, filled=100, block=64).collect()}
    assert [exact[i] for i in range(2000)] == want.tolist()
    quick = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame, margin=0.05, filled=100, block=64).collect()}
    assert all(quick[i] <= exact[i] for i in quick) and sum(quick.values()) >= 0.97 * want.sum()
    assert products[1] < 0.2 * 2000 * 1999 / 2 and products[1] < products[0]


def test_embedding_recall_on_planted_copies(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    noisy = rows.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: (x + 0.035 * F.pmod(F.xxhash64("vec_id", i), F.lit(3)) - 0.035).cast("float")).alias("embedding"))
    both = rows.union(noisy)
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in both.collect()}
    ids = list(x)
    unit = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])
    true = int((np.triu(unit @ unit.T, 1) >= 0.95).sum())
    found = sum(r.n_links for r in vectors.near_duplicates(both).collect()) / 2
    assert true > 50 and 0.9 * true <= found <= true


SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}


def chats(spark):
    messages = spark.createDataFrame([(1, 0, "user", 'say "hi"\né'), (1, 0, "user", 'say "hi"\né'), (1, 9, "assistant", None), (None, None, None, None)],
                                     "conv long, turn long, role string, content string")
    calls = spark.createDataFrame([
        (1, 1, "x", "add", '{"b": 2.50, "a" : 1}', ["y"]),  # waits for a later call
        (1, 3, "y", "add", '{"a": "1", "b": 2, "c": 0}', None),
        (1, 5, "y", "add", "{}", []),  # the id again
        (1, 6, "p", "sub", "{}", ["q"]), (1, 7, "q", "add", "[1]", ["p"]),  # a circle
        (1, 8, "n", None, None, ["absent"]), (2, 1, "x", "add", "not json", [])],
        "conv long, turn long, call_id string, tool string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, 4, "y", "3"), (1, 2, "x", "early"), (1, 5, "none", "lost"), (1, 6, "y", "again")], "conv long, turn long, call_id string, content string")
    return messages, calls, results


def test_chats(spark):
    rows = chat.format_chats(*chats(spark), SCHEMAS).orderBy("conv", "position").collect()
    assert len(rows) == 3 + 7 + 4
    one = [r for r in rows if r.conv == 1]
    assert [r.position for r in one] == list(range(1, len(one) + 1))
    place = {(r.kind, r.turn, r.call_id): r for r in one}
    order = [(r.kind, r.turn, r.call_id) for r in one]
    assert order.index(("call", 3, "y")) < order.index(("result", 4, "y")) < order.index(("call", 1, "x")) < order.index(("result", 2, "x"))
    assert place["call", 1, "x"].json == '{"role":"assistant","tool_calls":[{"function":{"arguments":{"a":1,"b":2.5},"name":"add"},"id":"x","type":"function"}]}'
    assert place["call", 1, "x"].errors is None and place["call", 1, "x"].linked
    assert place["call", 3, "y"].errors == "unknown c; a is no integer" and place["call", 3, "y"].linked
    assert place["call", 5, "y"].errors == "missing a; missing b" and not place["call", 5, "y"].linked
    assert place["call", 6, "p"].errors == "unknown tool sub; waits in a circle" or place["call", 7, "q"].errors.endswith("waits in a circle")
    assert place["call", 7, "q"].errors.startswith("arguments are no JSON object")
    assert place["call", 8, "n"].errors == "no tool"
    assert place["result", 4, "y"].linked and not place["result", 6, "y"].linked and not place["result", 5, "none"].linked
    assert all(json.loads(r.json) is not None for r in rows)
    assert json.loads(place["message", 0, None].json) == {"content": 'say "hi"\né', "role": "user"}


def test_chats_empty_and_native(spark):
    messages, calls, results = (x.where("false") for x in chats(spark))
    df = chat.format_chats(messages, calls, results, SCHEMAS)
    assert df.count() == 0
    plan = chat.format_chats(*chats(spark), SCHEMAS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_places(calls):
    """Places by following every wait; a call that waits, at last, for a circle keeps its turn."""
    known = {(c, i): (t, r, a) for c, i, t, r, a in calls}
    placed = {}
    while True:
        ready = {}
        for (c, i), (turn, _, after) in known.items():
            needs = [(c, n) for n in after if (c, n) in known]
            if (c, i) not in placed and all(n in placed for n in needs):
                place = (turn, 0)
                for n in needs:
                    (at, step), result = placed[n], known[n][1]
                    place = max(place, (at, step + 1 + (result is not None)), (result, 1) if result is not None else place)
                ready[c, i] = place
        if not ready:
            return {(c, i): (*placed.get((c, i), (known[c, i][0], 0)), (c, i) not in placed) for c, i in known}
        placed |= ready


PLACED = "conv long, call_id string, turn long, result_turn long, after array<string>"


def places(spark, calls):
    return {(r.conv, r.call_id): (r["at"], r.step, r.circular) for r in chat.place_calls(spark.createDataFrame(calls, PLACED)).collect()}


def test_places_of_any_waits_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    calls = []
    for conv in range(60):
        n = int(rng.integers(1, 12))
        for i in range(n):
            after = sorted({str(x) for x in rng.integers(0, n + 1, rng.integers(0, 3)) if conv % 3 == 0 or x > i})
            calls.append((conv, str(i), int(rng.integers(0, 9)), int(rng.integers(0, 12)) if rng.random() < 0.6 else None, after))
    want = plain_places(calls)
    assert places(spark, calls) == want and {c for _, _, c in want.values()} == {True, False}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(chat, "stage", lambda df, keep=chat.stage: (staged.append(1), keep(df))[1])
    chain = [(1, str(i), i % 7, i if i % 3 == 0 else None, [str(i + 1)]) for i in range(2000)]
    circle = [(2, "p", 5, None, ["q"]), (2, "q", 6, 9, ["p"]), (2, "r", 1, None, ["q"])] + [(2, str(i), 1, None, [str(i + 1)]) for i in range(1000)]
    assert places(spark, chain + circle) == plain_places_of_chain(chain) | plain_places_of_chain(circle[3:]) | {(2, "p"): (5, 0, True), (2, "q"): (6, 0, True), (2, "r"): (1, 0, True)}
    assert len(staged) < 30  # two tables a round


def plain_places_of_chain(calls):
    found, before = {}, None
    for c, i, turn, result, _ in reversed(calls):
        place = (turn, 0)
        if before is not None:
            (at, step), other = before
            place = max(place, (at, step + 1 + (other is not None)), (other, 1) if other is not None else place)
        found[c, i], before = (*place, False), (place, result)
    return found


def test_long_texts_and_other_columns_of_chats(spark):
    messages, calls, results = chats(spark)
    long = messages.union(spark.createDataFrame([(3, 0, "user", 'x"' * 1_000_000)], messages.schema))
    want = Counter(map(tuple, chat.format_chats(long, calls, results, SCHEMAS).collect()))
    assert max(len(r[7]) for r in want) > 3_000_000
    clash = [x.withColumns({n: F.lit("z") for n in ("at", "step", "own", "needs", "position", "json")}) for x in (long, calls, results)]
    assert Counter(map(tuple, chat.format_chats(*clash, SCHEMAS).collect())) == want


def test_long_conversation_is_numbered_in_stretches(spark):
    messages = spark.range(3500).select(F.lit(1).cast("long").alias("conv"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("content"))
    _, calls, results = (x.where("false") for x in chats(spark))
    rows = chat.format_chats(messages, calls, results, SCHEMAS).orderBy("position").collect()
    assert [r.turn for r in rows] == list(range(3500)) and [r.position for r in rows] == list(range(1, 3501))


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op3_top_k_search", "op9_embedding_near_duplicates"])
def test_queries_equal_sql(spark, name):
    ok, text = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, text


def test_pipeline_stages(spark, odd_documents, no_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "best_fit_packing"]
    kept = docs
    for _, apply in corpus_pipeline.STAGES[:-1]:
        after = apply(spark, kept, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert not Counter(after.collect()) - Counter(kept.collect())
        kept = after.cache()
    ids = {r.doc_id for r in kept.collect()}
    assert 0.5 * docs.count() < len(ids)
    first = {r.doc_id for r in simhash.similar_documents(docs).where("doc_id = component_id").collect()}
    clean = {i for i in first if labels.get(i) == 0}
    assert len(clean - ids) <= 0.02 * len(clean)
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    for table in (odd_documents, no_documents):
        for _, apply in corpus_pipeline.STAGES:
            assert apply(spark, table, SF).count() >= 0


def test_held_out_rule(spark):
    from craterline.llm.common import is_rest
    rows = spark.range(50).select("id", is_rest("id", 7, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in rows)


def test_top_k_brings_no_block_to_the_driver(odd_vectors, monkeypatch):
    """The copies of a block, one for each shard, would all stand in a broadcast."""
    monkeypatch.setattr(topk, "SHARD", 40)
    rows = odd_vectors.where("vec_id < 400")
    found = topk.top_k(rows, rows.where("vec_id % 5 = 0"))
    assert found.count() == 5 * rows.where("vec_id % 5 = 0").select("vec_id").distinct().count()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [100, 2**15, 2**31, 2.0**80])
def test_blocks_keep_their_numbers_in_few_bytes(most):
    values = np.array([[most, -most], [0, 7]], dtype=np.float64)
    data = topk._narrow(values).tobytes()
    assert topk._values(data, 2, 2).tolist() == values.tolist() and len(data) == 4 * (2 if most < 2**15 else 4 if most < 2**31 else 8)
