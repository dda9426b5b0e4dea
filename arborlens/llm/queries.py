"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.llm import chat_format, embedding_dedup, exact_dedup, html_density, mixing, packing, sharding, sketch_join, toxicity, url_filter
from arborlens.llm.common import read_table

SHARD_BYTES = 1 << 20
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
MIX_TARGETS = {"source": 0.7, "lang": 0.8, "topic": 1.0}
MIX_BUDGET = 0.8


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_files() -> dict:
    """The tokenizer, and the same vocabulary as ranks."""
    import public_tokenizers

    return {"tokenizer": tokenizer_path(), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def topic(text):
    """The topic of a document without one: its form, by length."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < 400, "note").when(n < 4000, "article").otherwise("report")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(read_table(spark, sf_dir, "documents"), keep="max")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op4_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_join.near_duplicates(read_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_pages(read_table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), **tokenizer_files(), capacity=2048, end_id=1).drop("ids")


def planted_conversation(spark: SparkSession) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    return spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(planted_conversation(spark))
    back = chat_format.read_back(chat_format.format_chat(rows))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").withColumn("topic", topic(F.col("text")))
    mixed = mixing.sample_mix(docs, MIX_TARGETS, budget=MIX_BUDGET)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("rate", 6).alias("rate"), "copies")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), held_out_fold=0)
    scored = toxicity.score_texts(docs, model, keep=["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_exact_dedup, op2_sharding, op3_url_filter, op4_sketch_join, op5_html_extract, op6_packing, op7_chat_format, op8_mixing, op9_toxicity, op10_embedding_dedup, pipeline]
    return {f.__name__: f for f in found}


def _escaped(expr: str) -> str:
    for k, word in enumerate(chat_format.CONTROL):
        expr = f"replace({expr}, '{word}', '{chat_format.ESC}{k}')"
    return expr


def _chat_sql(budget=2048, history=512) -> str:
    start, end, per = len(chat_format.START), len(chat_format.END), chat_format.CHARS_PER_TOKEN
    return f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i,
    {start} + 1 + length(replace({_escaped('role')}, chr(10), '{chat_format.ESC}9')) AS hl, length({_escaped('text')}) AS bl FROM c),
k AS (
  SELECT *, hl + bl + {end + 1} AS len, CAST(ceil((hl + bl + {end + 1}) / {per}.0) AS BIGINT) AS k,
    CASE WHEN first_value(role) OVER (PARTITION BY conv_id ORDER BY i) = 'system' THEN 1 ELSE 0 END AS sys FROM t),
p AS (
  SELECT *, lag(k, 1) OVER w AS k1, lag(k, 2) OVER w AS k2, lag(len, 1) OVER w AS l1, lag(len, 2) OVER w AS l2,
    first_value(k) OVER w AS k0, first_value(len) OVER w AS l0 FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
g AS (SELECT *, CASE WHEN sys = 1 AND i > 0 AND k0 + k <= {budget} THEN 1 ELSE 0 END AS keep FROM p),
n AS (
  SELECT *, CASE WHEN i - sys >= 2 AND k1 + k2 <= {history} AND keep * k0 + k + k1 + k2 <= {budget} THEN 2
    WHEN i - sys >= 1 AND k1 <= {history} AND keep * k0 + k + k1 <= {budget} THEN 1 ELSE 0 END AS past FROM g),
h AS (SELECT *, CASE past WHEN 2 THEN k1 + k2 WHEN 1 THEN k1 ELSE 0 END AS hk, CASE past WHEN 2 THEN l1 + l2 WHEN 1 THEN l1 ELSE 0 END AS hlen FROM n),
r AS (
  SELECT conv_id, i, k AS used, CAST(0 AS BIGINT) AS extra FROM h WHERE i = 0
  UNION ALL
  SELECT h.conv_id, h.i, CASE WHEN r.used + h.k > {budget} THEN h.keep * h.k0 + h.hk + h.k ELSE r.used + h.k END,
    CAST(CASE WHEN r.used + h.k > {budget} THEN h.keep * h.l0 + h.hlen ELSE 0 END AS BIGINT)
  FROM r JOIN h ON h.conv_id = r.conv_id AND h.i = r.i + 1),
x AS (SELECT conv_id, sum(extra) AS extra FROM r GROUP BY conv_id),
a AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss, sum(len) AS chars FROM k GROUP BY conv_id)
SELECT a.conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars + extra AS BIGINT) AS formatted_chars FROM a JOIN x ON a.conv_id = x.conv_id"""


def _mix_sql(sweeps: int = 48) -> str:
    total = "sum(w) OVER (PARTITION BY {})"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) AS n_tokens,
    CASE WHEN length(coalesce(text, '')) < 400 THEN 'note' WHEN length(coalesce(text, '')) < 4000 THEN 'article' ELSE 'report' END AS topic FROM documents),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
s AS (SELECT *, tokens / sum(tokens) OVER () AS w FROM c),
g1 AS (SELECT source, power(sum(w), {MIX_TARGETS['source']}) AS g FROM s GROUP BY 1),
g2 AS (SELECT lang, power(sum(w), {MIX_TARGETS['lang']}) AS g FROM s GROUP BY 1),
g3 AS (SELECT topic, power(sum(w), {MIX_TARGETS['topic']}) AS g FROM s GROUP BY 1),
b AS (SELECT s.*, g1.g / (SELECT sum(g) FROM g1) AS t1, g2.g / (SELECT sum(g) FROM g2) AS t2, g3.g / (SELECT sum(g) FROM g3) AS t3
  FROM s JOIN g1 ON s.source IS NOT DISTINCT FROM g1.source JOIN g2 ON s.lang IS NOT DISTINCT FROM g2.lang JOIN g3 ON s.topic = g3.topic),
f AS (
  SELECT 0 AS step, * FROM b
  UNION ALL
  SELECT step + 1, source, lang, topic, tokens, coalesce(w * CASE step % 3 WHEN 0 THEN t1 WHEN 1 THEN t2 ELSE t3 END
    / nullif(CASE step % 3 WHEN 0 THEN {total.format('source')} WHEN 1 THEN {total.format('lang')} ELSE {total.format('topic')} END, 0), 0), t1, t2, t3
  FROM f WHERE step < {3 * sweeps}),
r AS (SELECT source, lang, topic, least(CASE WHEN tokens > 0 THEN w * sum(tokens) OVER () / tokens ELSE 1 END * {MIX_BUDGET}, 4.0) AS rate FROM f WHERE step = {3 * sweeps})
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(rate, 6) AS rate,
  CAST(floor(rate) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5('mix' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) / {float(1 << 52)!r} < rate - floor(rate) THEN 1 ELSE 0 END AS copies
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents""",
        "op2_sharding": f"""
WITH r AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents),
v AS (SELECT doc_id, n_bytes, d, substr(bits, 1, d) AS prefix, sum(n_bytes) OVER (PARTITION BY d, substr(bits, 1, d)) AS b FROM r, (SELECT unnest(range(0, 61)) AS d))
SELECT doc_id, n_bytes, arg_min(prefix, d) AS shard, CAST(min(d) AS BIGINT) AS depth, CAST(CASE WHEN min(b) > {SHARD_BYTES} THEN 1 ELSE 0 END AS BIGINT) AS overflow, CAST(arg_min(b, d) AS BIGINT) AS shard_bytes
FROM v WHERE b <= {SHARD_BYTES} OR d = 60 AND n_bytes > {SHARD_BYTES} GROUP BY doc_id, n_bytes""",
        "op4_sketch_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
    ELSE list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, k.b FROM c JOIN k ON c.b = k.a)
SELECT n.doc_id, n.n AS n_shingles, min(c.b) AS component_id FROM n JOIN c ON n.doc_id = c.a GROUP BY 1, 2""",
        "op7_chat_format": _chat_sql(),
        "op8_mixing": _mix_sql(),
        "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
k AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93),
c AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT c.a, k.b FROM c JOIN k ON c.b = k.a),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY 1), n AS (SELECT a, count(*) AS n FROM k GROUP BY 1)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, vec_id = m.component_id AS kept
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    }
