"""One query for each operator of this subpackage, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from craterline.llm import (chat, fingerprints, language, packing, pitman_yor, resampling, sentencepiece_codec, simhash, spelling, token_count, topk, toxicity,
                           vectors)
from craterline.llm.common import is_rest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tools that the turns of a conversation are taken to call.
SCHEMAS = {"ask": {"query": ("string", True), "turn": ("integer", True), "limit": ("integer", False)},
           "say": {"query": ("string", True), "turn": ("string", True)}}


@query("""WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
asked AS (SELECT *, 'call_' || turn AS call_id, CASE WHEN turn % 4 < 2 THEN 'ask' WHEN turn % 4 = 2 THEN 'say' ELSE 'tell' END AS tool,
                 CASE turn % 10 WHEN 0 THEN turn + 2 WHEN 1 THEN turn + 2 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE turn - 2 END AS needs
          FROM turns WHERE role = 'user'),
said AS (SELECT *, 'call_' || (turn - 1) AS call_id FROM turns WHERE role = 'assistant'),
placed AS (SELECT a.*, s.turn IS NOT NULL AS linked, coalesce(s.turn, a.turn) AS own_done, s.turn AS result_turn,
                  CASE WHEN a.needs > a.turn AND n.turn IS NOT NULL THEN coalesce(ns.turn, n.turn) ELSE a.turn END AS place,
                  CASE WHEN a.needs > a.turn AND n.turn IS NOT NULL THEN 1 ELSE 0 END AS step
           FROM asked a LEFT JOIN said s ON s.conv_id = a.conv_id AND s.call_id = a.call_id
           LEFT JOIN asked n ON n.conv_id = a.conv_id AND n.turn = a.needs
           LEFT JOIN said ns ON ns.conv_id = a.conv_id AND ns.call_id = n.call_id),
rows AS (
  SELECT conv_id, turn, 'message' AS kind, NULL AS call_id, turn AS place, 0 AS step, NULL AS linked, NULL AS errors,
         '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text) || ',' END || '"role":"system"}' AS json
  FROM turns WHERE role NOT IN ('user', 'assistant')
  UNION ALL
  SELECT conv_id, turn, 'call', call_id, place, step, linked,
         CASE tool WHEN 'ask' THEN CASE WHEN turn % 8 = 5 THEN 'limit is no integer' END WHEN 'say' THEN 'turn is no string' ELSE 'unknown tool tell' END,
         '{"role":"assistant","tool_calls":[{"function":{"arguments":{' || CASE WHEN turn % 4 < 2 THEN '"limit":' || CASE WHEN turn % 8 = 5 THEN '"few"' ELSE '5' END || ',' ELSE '' END
         || '"query":' || to_json(text) || ',"turn":' || turn || '},"name":"' || tool || '"},"id":"' || call_id || '","type":"function"}]}'
  FROM placed
  UNION ALL
  SELECT s.conv_id, s.turn, 'result', s.call_id, CASE WHEN p.place >= s.turn THEN p.place ELSE s.turn END, CASE WHEN p.place >= s.turn THEN p.step + 1 ELSE 0 END, p.turn IS NOT NULL, NULL,
         '{' || CASE WHEN s.text IS NULL THEN '' ELSE '"content":' || to_json(s.text) || ',' END || '"role":"tool","tool_call_id":"' || s.call_id || '"}'
  FROM said s LEFT JOIN placed p ON p.conv_id = s.conv_id AND p.call_id = s.call_id)
SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY place, step, kind, turn, call_id, json) AS position, turn, kind, call_id, linked, errors, json
FROM rows""")
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as a log of tool calls: a user's turn calls a tool, the assistant's next turn is its result.

    A call uses the result of the call two turns before it, some of the call two turns after it.
    """
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    turn, last = F.col("turn"), F.col("turn") % 10
    asked, said = rows.where("role = 'user'"), rows.where("role = 'assistant'")
    limit = F.when(turn % 8 == 5, F.lit('"few"')).otherwise(F.lit("5"))
    # Keys are out of order on purpose; the operator puts them in order.
    arguments = F.concat(F.lit('{ "turn": '), turn.cast("string"), F.lit(', "query": '), F.coalesce(F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1), F.lit("null")),
                         F.when(turn % 4 < 2, F.concat(F.lit(', "limit":'), limit)).otherwise(F.lit("")), F.lit(" }"))
    needs = F.when(last < 2, turn + 2).when(last > 3, turn - 2)
    calls = asked.select("conv", "turn", F.concat(F.lit("call_"), turn).alias("call_id"),
                         F.when(turn % 4 < 2, "ask").when(turn % 4 == 2, "say").otherwise("tell").alias("tool"), arguments.alias("arguments"),
                         F.when(needs.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("call_"), needs))).alias("after"))
    results = said.select("conv", "turn", F.concat(F.lit("call_"), turn - 1).alias("call_id"), F.col("text").alias("content"))
    messages = rows.where("role not in ('user', 'assistant')").select("conv", "turn", "role", F.col("text").alias("content"))
    return chat.format_chats(messages, calls, results, SCHEMAS)


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


#: Components as floor(256 x), without vectors that are null or hold a null or a non-finite component.
_INTEGER = """
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


@query(f"""WITH vectors AS ({_INTEGER}),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5""")
def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256.0)


@query()
def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = is_rest("doc_id", 4, 2)
    model = language.learn(documents.where(~held_out))
    return language.identify(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op7_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pitman_yor.score(table(spark, sf_dir, "documents"), ~is_rest("doc_id", 7, 2))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), with_ids=False)


@query("""WITH RECURSIVE vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
           embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.usable AND b.usable AND a.vec_id <> b.vec_id
          AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM vectors UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = n.vec_id) AS BIGINT) AS n_links, n.component_id, n.vec_id = n.component_id AS kept
FROM named n""")
def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = is_rest("doc_id", 5, 0)
    lexicon = toxicity.learn(documents, labels.where(~held_out))
    return toxicity.score(documents, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: SQL for crc32: its table of 256 numbers, worked out bit by bit, and the check sum of a text's UTF-8 bytes.
_CRC = """crc_table AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"""


def _crc(text: str) -> str:
    data = f"hex(encode({text}))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({data}) // 2), lambda i: ('0x' || substr({data}, 2 * i + 1, 2))::BIGINT)), "
            "lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
counted AS (SELECT run, count(*) AS n, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc_table GROUP BY doc_id, run, crcs),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
          FROM counted GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS t(i)),
near AS (SELECT a.word AS word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.rest = words.word
         UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.rest = words.word),
ordered AS (SELECT near.word, other, words.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
                   row_number() OVER (PARTITION BY near.word ORDER BY words.n DESC, other) AS place FROM near JOIN words ON words.word = near.other),
formed AS (SELECT w.word, w.n, coalesce(o.n_near, 0) AS n_near, CASE WHEN o.other_n >= 10 * w.n THEN o.other END AS form,
                  CASE WHEN o.other_n >= 10 * w.n THEN o.other_n END AS form_n FROM words w LEFT JOIN ordered o ON o.word = w.word AND o.place = 1),
chain(word, last) AS (SELECT word, word FROM words UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.last AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed l ON l.word = c.last AND l.form IS NULL""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents"), every=31))


@query(f"""WITH {_CRC},
features AS (SELECT 0 AS side, doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
             UNION ALL SELECT 1, NULL, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
hashed AS (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM features), crc_table),
counted AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM features JOIN hashed USING (word) GROUP BY bucket),
total AS (SELECT CAST(sum(s) AS DOUBLE) AS ss, CAST(sum(t) AS DOUBLE) AS tt FROM counted),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS gain FROM counted, total),
weighed AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(w.n, 0) AS n_features, CAST(coalesce(w.weight, 0) AS BIGINT) AS weight,
                  CAST(coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
           FROM documents d LEFT JOIN weighed w ON w.doc_id = d.doc_id),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.place <= 10 * r.n // 100 THEN r.place END AS rank
FROM scored s LEFT JOIN ranks r ON r.doc_id = s.doc_id""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))
