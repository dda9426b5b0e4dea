"""Queries of the library's own operators over the star-schema tables, each with its SQL twin where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.functions import symbols as S
from arborlens.operators import coding, contexts, frequencies, range_coder, recency, scopes, strings
from arborlens.operators.ordering import global_index
from arborlens.plans import analyses
from arborlens.schema import views
from arborlens.sources import tables as T
from arborlens.sources import store, trees

_Q: dict = {}
_O: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _Q[f.__name__] = f
        if sql:
            _O[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)


LINES = "numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


def _symbol_sql(o: str, li: str, doc_o: str, doc_l: str, line_from: str) -> str:
    """Symbols of order trees: the six sources with the contexts ``o`` and ``li``."""
    miss = "CASE WHEN {0} < {1} THEN CAST({0} AS VARCHAR) ELSE 'MISS' END"
    return f"""c AS (SELECT o.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders o),
s AS (
  SELECT {doc_o} AS doc_id, '{o}.status#OrderStatus' AS t, o_orderstatus AS sym FROM c UNION ALL
  SELECT {doc_o}, '{o}.priority#OrderPriority', o_orderpriority FROM c UNION ALL
  SELECT {doc_o}, '{o}.lines#arrayLength', {miss.format('n', 16)} FROM c UNION ALL
  SELECT {doc_l}, '{li}.linenumber#uint', {miss.format('l_linenumber', 8)} FROM {line_from} UNION ALL
  SELECT {doc_l}, '{li}.returnflag#ReturnFlag', l_returnflag FROM {line_from} UNION ALL
  SELECT {doc_l}, '{li}.linestatus#LineStatus', l_linestatus FROM {line_from})"""


SHALLOW = _symbol_sql("Order", "LineItem", "o_orderkey", "l_orderkey", "lineitem")


def _freq(spark, sf_dir, n: int, deep: bool) -> DataFrame:
    return frequencies.count_symbols(T.order_symbols(spark, sf_dir, [n], deep), ["suffix", "tag"], ["sym_index", "sym_name"])


_REPORT = """SELECT split_part(t, '#', 1) AS suffix, split_part(t, '#', 2) AS tag, sym, CAST(count(*) AS BIGINT) AS hits, CAST(sum(count(*)) OVER (PARTITION BY t) AS BIGINT) AS total_hits,
  round(count(*) / sum(count(*)) OVER (PARTITION BY t), 6) AS prob, round(-log2(count(*) / sum(count(*)) OVER (PARTITION BY t)), 6) AS bits FROM s GROUP BY t, sym"""


def _report(f: DataFrame) -> DataFrame:
    p = F.col("hits") / F.col("total_hits")
    return f.select("suffix", "tag", F.col("sym_name").alias("sym"), "hits", "total_hits", F.round(p, 6).alias("prob"), F.round(S.bits(p), 6).alias("bits"))


@query(f"WITH {SHALLOW} {_REPORT}")
def flagship_path_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_freq(spark, sf_dir, 1, False))


@query(f"WITH {_symbol_sql('Customer.orders.*/Order', 'Order.lines.*/LineItem', 'o_custkey', 'o_custkey', 'lineitem JOIN orders ON l_orderkey = o_orderkey')} {_REPORT}")
def path_suffix_len2(spark, sf_dir):
    return _report(_freq(spark, sf_dir, 2, True))


@query(f"WITH {_symbol_sql('X', 'Customer.orders.*/Order.lines.*/LineItem', 'o_custkey', 'o_custkey', 'lineitem JOIN orders ON l_orderkey = o_orderkey')}, z AS (SELECT 1) {_REPORT.replace('FROM s', chr(39).join(['FROM s WHERE t LIKE ', 'Customer%', ''])) }")
def path_suffix_len3(spark, sf_dir):
    return _report(_freq(spark, sf_dir, 3, True))


@query(f"WITH {SHALLOW} SELECT CASE WHEN grouping(doc_id) = 1 THEN 'ALL' ELSE 'doc' END AS scope, doc_id, split_part(t, '#', 1) AS suffix, split_part(t, '#', 2) AS tag, sym AS sym_name, CAST(count(*) AS BIGINT) AS hits FROM s GROUP BY GROUPING SETS ((doc_id, t, sym), (t, sym))")
def path_suffix_per_doc(spark, sf_dir):
    rows = T.order_symbols(spark, sf_dir, [1])
    return frequencies.count_by_doc_and_all(rows, "doc_id", ["suffix", "tag", "sym_name"])


@query(f"WITH {LINES} SELECT CASE WHEN n <= 4 THEN 'Order.lines.' || i || '-of-' || n WHEN i <= 4 THEN 'Order.lines.' || i || '-of-many' ELSE 'Order.lines.*' END AS suffix, CAST(count(*) AS BIGINT) AS hits FROM numbered GROUP BY 1")
def array_index_label(spark, sf_dir):
    lines = T.numbered_lines(T.table(spark, sf_dir, "lineitem"))
    path = F.array(T._step("$Root", iface="Order", node=True), T._step("lines"), T._step(idx=F.col("i"), n=F.col("n"), iface="LineItem", node=True)).cast(f"array<{T.STEP}>")
    return contexts.with_suffixes(lines.select(path.alias("path")), 1).groupBy("suffix").agg(F.count("*").alias("hits"))


@query("WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT CASE WHEN n < 16 THEN CAST(n AS VARCHAR) ELSE 'MISS' END AS sym, CAST(count(*) AS BIGINT) AS hits FROM c GROUP BY 1")
def array_length_hist(spark, sf_dir):
    return _freq(spark, sf_dir, 1, False).where("tag = 'arrayLength'").select(F.col("sym_name").alias("sym"), "hits")


@query("SELECT toxic AS sym_index, CAST(count(*) AS BIGINT) AS hits FROM labels GROUP BY 1")
def sym_bool(spark, sf_dir):
    return T.table(spark, sf_dir, "labels").groupBy(S.bool_index(F.col("toxic") == 1).alias("sym_index")).agg(F.count("*").alias("hits"))


@query("SELECT CAST(least(l_linenumber, 8) AS INT) AS sym_index, CAST(count(*) AS BIGINT) AS hits FROM lineitem GROUP BY 1")
def sym_uint(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").groupBy(S.uint_index(F.col("l_linenumber")).alias("sym_index")).agg(F.count("*").alias("hits"))


@query("SELECT CAST(CASE WHEN p_size - 5 BETWEEN -1 AND 6 THEN p_size - 4 ELSE 8 END AS INT) AS sym_index, CAST(count(*) AS BIGINT) AS hits FROM part GROUP BY 1")
def sym_int(spark, sf_dir):
    return T.table(spark, sf_dir, "part").groupBy(S.int_index(F.col("p_size") - 5).alias("sym_index")).agg(F.count("*").alias("hits"))


@query("SELECT CAST(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) - 1 AS INT) AS sym_index, o_orderpriority AS sym_name, CAST(count(*) AS BIGINT) AS hits FROM orders GROUP BY 1, 2")
def sym_enum(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").groupBy(S.enum_index(F.col("o_orderpriority"), T.PRIORITY).alias("sym_index"), F.col("o_orderpriority").alias("sym_name")).agg(F.count("*").alias("hits"))


def _status_by_day(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("day"), "o_orderstatus").agg(F.count("*").alias("hits"))
    alphabet = spark.createDataFrame(list(enumerate(T.STATUS)), "sym_index int, o_orderstatus string")
    return frequencies.zero_filled(o, alphabet, ["day"], "o_orderstatus").select("day", "sym_index", F.col("o_orderstatus").alias("sym"), "hits")


_ZERO = """f AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus AS sym, count(*) AS h FROM orders GROUP BY 1, 2),
z AS (SELECT d.day, a.i AS sym_index, a.sym, CAST(coalesce(h, 0) AS BIGINT) AS hits FROM (SELECT DISTINCT day FROM f) d CROSS JOIN (VALUES (0, 'F'), (1, 'O'), (2, 'P')) a(i, sym) LEFT JOIN f ON f.day = d.day AND f.sym = a.sym)"""


@query(f"WITH {_ZERO} SELECT * FROM z")
def zero_filled_hist(spark, sf_dir):
    return _status_by_day(spark, sf_dir)


@query(f"WITH {SHALLOW}, f AS (SELECT t, sym, count(*) AS hits FROM s GROUP BY 1, 2), r AS (SELECT *, sum(hits) OVER (PARTITION BY t) AS total, sum(hits) OVER (PARTITION BY t ORDER BY hits DESC, sym ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY t ORDER BY hits DESC, sym) AS rank FROM f) SELECT split_part(t, '#', 1) AS suffix, split_part(t, '#', 2) AS tag, sym, CAST(hits AS BIGINT) AS hits, floor(hits / total * 10000) / 100 AS prob_pct, round(-log2(hits / total), 6) AS bits, round(run / total, 9) AS accum, CAST(rank AS BIGINT) AS rank FROM r")
def ranked_report(spark, sf_dir):
    r = frequencies.ranked(_freq(spark, sf_dir, 1, False), ["suffix", "tag"], "sym_name")
    return r.select("suffix", "tag", F.col("sym_name").alias("sym"), "hits", (F.floor(F.col("prob") * 10000) / 100).alias("prob_pct"), F.round("bits", 6).alias("bits"), F.round("accum", 9).alias("accum"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_symbol_sql('Customer.orders.*/Order', 'Order.lines.*/LineItem', 'o_custkey', 'o_custkey', 'lineitem JOIN orders ON l_orderkey = o_orderkey')}, u AS (SELECT t, count(*) AS h FROM s GROUP BY 1 UNION ALL SELECT 'Customer.orders.*/Order.lines.*/LineItem' || substr(t, length('Order.lines.*/LineItem') + 1), count(*) FROM s WHERE t LIKE 'Order.lines%' GROUP BY 1 UNION ALL SELECT replace(t, 'Customer.orders.*/', ''), count(*) FROM s WHERE t LIKE 'Customer%' GROUP BY 1 UNION ALL SELECT replace(t, 'Order.lines.*/', ''), count(*) FROM s WHERE t LIKE 'Order.lines%' GROUP BY 1), x AS (SELECT split_part(t, '#', 1) AS suffix, split_part(t, '#', 2) AS tag, CAST(h AS BIGINT) AS hits, CAST(length(t) - length(replace(t, '/', '')) AS INT) AS slashes FROM u) SELECT *, CAST(row_number() OVER (ORDER BY slashes DESC, hits DESC, suffix, tag) AS INT) AS place FROM x")
def suffix_specificity_order(spark, sf_dir):
    rows = T.order_symbols(spark, sf_dir, [1, 2, 3], True)
    t = frequencies.by_specificity(rows.groupBy("suffix", "tag").agg(F.count("*").alias("hits")))
    return global_index(t, [-F.col("slashes"), -F.col("hits"), "suffix", "tag"], "place").withColumn("place", (F.col("place") + 1).cast("int"))


@query("SELECT 'LineItem.linestatus' AS suffix, CAST(count(*) AS BIGINT) AS hits FROM lineitem")
def singleton_alphabet_prune(spark, sf_dir):
    step = F.array(T._step("$Root", iface="LineItem", node=True), T._step("linestatus")).cast(f"array<{T.STEP}>")
    lone = T.table(spark, sf_dir, "lineitem").select(step.alias("path"), F.lit(0).alias("type_index"), F.lit("Enum<LineStatus>").alias("type_name"), F.lit(1).alias("type_set_size"), F.lit("LineStatus").alias("value_tag"), S.enum_index(F.col("l_linestatus"), T.LINE_STATUS).alias("value_index"), F.col("l_linestatus").alias("value_name"), F.lit(2).alias("value_alphabet_size"))
    return contexts.symbols(contexts.with_suffixes(lone, 1)).groupBy("suffix").agg(F.count("*").alias("hits"))


def _rank_sql(src: str, stream: str, order: str, sym: str) -> str:
    return f"""s AS (SELECT {stream} AS stream, {sym} AS sym, {order}, row_number() OVER (PARTITION BY {stream} ORDER BY {order}) AS pos FROM {src}),
n AS (SELECT *, lag(pos) OVER (PARTITION BY stream, sym ORDER BY pos) AS prv, lead(pos) OVER (PARTITION BY stream, sym ORDER BY pos) AS nxt FROM s),
d AS (SELECT a.stream, a.pos, a.sym, any_value(a.prv) AS prv, count(b.pos) AS dist FROM n a LEFT JOIN n b ON a.stream = b.stream AND b.pos > a.prv AND b.pos < a.pos AND (b.nxt IS NULL OR b.nxt > a.pos) GROUP BY 1, 2, 3),
r AS (SELECT stream, pos, sym, CASE WHEN prv IS NULL THEN -1 ELSE dist END AS dist FROM d)"""


EVENT_RANKS = _rank_sql("events", "user_id", "ts, event_id", "event_type")


@query(f"WITH {EVENT_RANKS} SELECT CAST(CASE WHEN dist >= 3 THEN -1 ELSE dist END AS INT) AS rank, CAST(count(*) AS BIGINT) AS hits FROM r GROUP BY 1")
def mtf_rank_events(spark, sf_dir):
    r = recency.mtf_ranks(T.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", limit=64, chunk=1 << 20)
    return r.groupBy(F.when(F.col("dist") >= 3, -1).otherwise(F.col("dist")).alias("rank")).agg(F.count("*").alias("hits"))


@query(f"WITH {_rank_sql('conversations', 'conv_id', 'turn', 'role')} SELECT stream AS conv_id, CAST(pos - 1 AS BIGINT) AS turn, sym AS role, CAST(dist AS INT) AS dist FROM r")
def mtf_rank_conversations(spark, sf_dir):
    return recency.mtf_ranks(T.table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")


def _windows_sql(sizes, more="0"):
    return f"""WITH {EVENT_RANKS}, w AS (SELECT unnest({sizes}) AS window_size),
f AS (SELECT window_size, CASE WHEN dist >= window_size THEN -1 ELSE dist END AS rank, count(*) + {more} AS c FROM r CROSS JOIN w GROUP BY 1, 2),
z AS (SELECT w.window_size, k.rank, coalesce(c, 0) AS c FROM w, LATERAL (SELECT unnest(range(-1, w.window_size)) AS rank) k LEFT JOIN f ON f.window_size = w.window_size AND f.rank = k.rank),
t AS (SELECT window_size, sum(c) AS t, sum(c) FILTER (WHERE rank >= 0) AS h FROM z GROUP BY 1),
o AS (SELECT window_size, CASE WHEN rank < 0 THEN 'MISSES' ELSE CAST(rank AS VARCHAR) END AS index, c FROM z UNION ALL SELECT window_size, 'HITS', h FROM t UNION ALL SELECT window_size, 'TOTAL', t FROM t)
SELECT CAST(o.window_size AS INT) AS window_size, index, CAST(c AS BIGINT) AS count, round(c / t, 9) AS prob FROM o JOIN t ON o.window_size = t.window_size"""


def _windows(spark, sf_dir, sizes, compat=False):
    r = recency.mtf_ranks(T.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    h = recency.window_histograms(r, sizes, compat=compat)
    return h.select("window_size", "index", F.col("count").cast("long").alias("count"), F.round("prob", 9).alias("prob"))


@query(_windows_sql([1, 2, 3, 5, 8]))
def string_window_multi(spark, sf_dir):
    return _windows(spark, sf_dir, [1, 2, 3, 5, 8])


@query(_windows_sql([3], "1"))
def string_window_compat(spark, sf_dir):
    return _windows(spark, sf_dir, [3], compat=True)


@query()
def string_window_documents(spark, sf_dir):
    r = recency.token_ranks(T.table(spark, sf_dir, "documents"), "doc_id", "text", recency.DEFAULT_WINDOW)
    return r.groupBy("rank").agg(F.sum("hits").alias("hits"))


@query("""WITH r AS (SELECT event_type AS value, 'ident' AS kind FROM events WHERE event_type IS NOT NULL UNION ALL SELECT props, 'raw' FROM events WHERE props IS NOT NULL UNION ALL SELECT source, 'prop' FROM documents WHERE source IS NOT NULL)
SELECT value, CAST(count(*) FILTER (WHERE kind = 'ident') AS BIGINT) AS ident_count, CAST(count(*) FILTER (WHERE kind = 'prop') AS BIGINT) AS prop_count, CAST(count(*) FILTER (WHERE kind = 'raw') AS BIGINT) AS raw_count, CAST(count(*) AS BIGINT) AS total_count FROM r GROUP BY 1""")
def global_string_counts(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").where("source is not null").select(F.lit("prop").alias("kind"), F.col("source").alias("value"))
    return strings.global_counts(T.event_refs(spark, sf_dir).select("kind", "value").unionByName(docs))


@query("WITH f AS (SELECT event_type, min((ts, event_id)) AS p, count(*) AS n FROM events GROUP BY 1) SELECT event_type, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY p, event_type) - 1 AS INT) AS idx FROM f")
def first_seen_index(spark, sf_dir):
    return recency.first_seen(T.table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"]).select("event_type", "n", F.col("idx").cast("int").alias("idx"))


_WORDS = "w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS value FROM documents), g AS (SELECT value, count(*) AS total_count FROM w GROUP BY 1), top AS (SELECT *, row_number() OVER (ORDER BY total_count DESC, value) - 1 AS id FROM g ORDER BY total_count DESC, value LIMIT 4096)"


def _words(spark, sf_dir):
    return T.document_words(spark, sf_dir)


@query(f"WITH {_WORDS} SELECT value, CAST(total_count AS BIGINT) AS total_count, CAST(id AS BIGINT) AS id FROM top")
def dictionary_top4096(spark, sf_dir):
    return strings.dictionary(_words(spark, sf_dir).groupBy("value").agg(F.count("*").alias("total_count")))


_TABLE = """e AS (SELECT *, max(CASE WHEN hits = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS esc, sum(hits) OVER (PARTITION BY k) AS tot FROM h),
p AS (SELECT *, CASE WHEN hits > 0 THEN greatest(1, CAST(floor(hits * (CAST(262144 - esc AS DOUBLE) / tot)) AS BIGINT)) ELSE 0 END AS size FROM e)
SELECT k AS key, i AS sym_index, CAST(hits AS BIGINT) AS hits, esc = 1 AS allow_escape, CAST(size AS BIGINT) AS size, CAST(coalesce(sum(size) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(sum(size) OVER (PARTITION BY k) + esc AS BIGINT) AS total FROM p"""


def _table_of(f: DataFrame, key: str) -> DataFrame:
    t = frequencies.prob_table(f, [key], "sym_index")
    return t.select(F.col(key).alias("key"), "sym_index", "hits", "allow_escape", "size", "offset", "total")


def _priority_hits(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("hits"))
    return o.withColumn("sym_index", S.enum_index(F.col("o_orderstatus"), T.STATUS))


@query(f"WITH h AS (SELECT o_orderpriority AS k, CAST(list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS INT) AS i, count(*) AS hits FROM orders GROUP BY 1, 2), {_TABLE}")
def prob_table(spark, sf_dir):
    return _table_of(_priority_hits(spark, sf_dir), "o_orderpriority")


@query(f"WITH {_ZERO}, h AS (SELECT day AS k, sym_index AS i, hits FROM z), {_TABLE}")
def prob_table_escape(spark, sf_dir):
    return _table_of(_status_by_day(spark, sf_dir), "day")


_COST = f"""h AS (SELECT o_orderpriority AS k, CAST(list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS INT) AS i, count(*) AS hits FROM orders GROUP BY 1, 2), m AS ({_TABLE.replace('e AS (', 'SELECT * FROM (WITH e AS (', 1)}))"""


def _costs(spark, sf_dir):
    model = F.broadcast(_table_of(_priority_hits(spark, sf_dir), "o_orderpriority").select(F.col("key").alias("model"), "sym_index", "size", "offset", "total", "allow_escape"))  # a row per symbol of two enums
    o = T.table(spark, sf_dir, "orders").withColumn("sym_index", S.enum_index(F.col("o_orderstatus"), T.STATUS)).withColumns({"model": F.col("o_orderpriority"), "bits": F.lit(None).cast("double"), "raw": F.lit(None).cast("binary")})
    return coding.costs(o, model)


@query(f"WITH {_COST} SELECT o_orderkey, round(log2(m.total / m.size), 6) AS bits FROM orders JOIN m ON m.key = o_orderpriority AND m.sym_index = list_position(['F', 'O', 'P'], o_orderstatus) - 1")
def symbol_cost(spark, sf_dir):
    return _costs(spark, sf_dir).select("o_orderkey", F.round("bits", 6).alias("bits"))


@query(f"WITH {_COST}, c AS (SELECT o_orderpriority AS c1, o_orderstatus AS c2, log2(m.total / m.size) AS bits FROM orders JOIN m ON m.key = o_orderpriority AND m.sym_index = list_position(['F', 'O', 'P'], o_orderstatus) - 1) SELECT 'sym' || CASE WHEN grouping(c1) = 0 THEN '/' || c1 ELSE '' END || CASE WHEN grouping(c2) = 0 THEN '/' || c2 ELSE '' END AS label, round(sum(bits), 4) AS bits, CAST(count(*) AS BIGINT) AS symbols FROM c GROUP BY ROLLUP (c1, c2)")
def category_rollup(spark, sf_dir):
    c = _costs(spark, sf_dir).select(F.col("o_orderpriority").alias("c1"), F.col("o_orderstatus").alias("c2"), "bits")
    return frequencies.category_rollup(c, ["c1", "c2"]).withColumn("bits", F.round("bits", 4))


def _varuint(compat):
    a, b = (0x20000, 28) if compat else (0x200000, 32)
    return f"CAST(CASE WHEN ref < 128 THEN 8 WHEN ref < 16384 THEN 16 WHEN ref < {a} THEN 24 ELSE {b} END AS INT)"


@query(f"WITH {_WORDS}, q AS (SELECT doc_id, string_split(text, ' ') AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS value, unnest(range(len(l))) AS pos FROM q), f AS (SELECT doc_id, value, min(pos) AS p FROM u GROUP BY 1, 2), x AS (SELECT f.*, id FROM f LEFT JOIN top ON top.value = f.value), y AS (SELECT doc_id, value, CAST(coalesce(id, 4096 + row_number() OVER (PARTITION BY doc_id, id IS NULL ORDER BY p, value) - 1) AS BIGINT) AS ref FROM x) SELECT doc_id, value, ref, {_varuint(False)} AS bits FROM y")
def escape_ref_varuint(spark, sf_dir):
    w = _words(spark, sf_dir)
    top = strings.dictionary(w.groupBy("value").agg(F.count("*").alias("total_count")))
    return strings.escape_references(w, top, "doc_id", "value", ["pos"]).select("doc_id", "value", "ref", "bits")


@query("WITH w AS (SELECT DISTINCT doc_id, value FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS value FROM documents)) SELECT doc_id, CAST(count(*) AS BIGINT) AS entries, CAST(sum(strlen(value) + CASE WHEN strlen(value) < 128 THEN 1 WHEN strlen(value) < 16384 THEN 2 WHEN strlen(value) < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS total_bytes FROM w GROUP BY 1")
def string_table_size(spark, sf_dir):
    return strings.string_table_size(_words(spark, sf_dir), "doc_id", "value")


@query("WITH o AS (SELECT o_orderkey FROM orders), r AS (SELECT o_orderkey, unnest(['root', 'status', 'lines']) AS place FROM o) SELECT CASE place WHEN 'status' THEN 'Order.status' ELSE 'Order.lines' END AS suffix, CAST(1 AS INT) AS suffix_len, CAST(count(*) AS BIGINT) AS hits FROM r WHERE place <> 'root' GROUP BY 1 UNION ALL SELECT 'Order.lines.*/LineItem.returnflag', 2, CAST(count(*) AS BIGINT) FROM lineitem")
def longest_context(spark, sf_dir):
    nodes = T.order_nodes(spark, sf_dir).where("value_tag in ('OrderStatus', 'arrayLength', 'ReturnFlag')")
    return contexts.longest_context(nodes, 2).groupBy("suffix", "suffix_len").agg(F.count("*").alias("hits"))


@query(r"SELECT doc_id, regexp_replace(source || '.js', '\.js$', '.json') AS result_path, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE regexp_matches(source, '^[-_a-zA-Z0-9./]*$') AND NOT list_has_any(string_split(source || '.js', '/'), ['', '.', '..', 'WRITABLE']) AND strlen(text) >= 1000")
def corpus_filter(spark, sf_dir, least_size: int = 1000):
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".js")).alias("path"), F.octet_length("text").cast("long").alias("size"))
    kept = d.where((F.col("size") >= least_size) & store.valid_subpath_column(F.col("path")) & F.col("path").endswith(".js"))
    return kept.select("doc_id", store.result_path(F.col("path"), ".json").alias("result_path"), "size")


@query("""SELECT event_id, 0 AS seq, 0 AS depth, '$Root' AS key_name, 'object' AS type_name, NULL AS value FROM events UNION ALL
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY k) AS INT), 1, k, 'number', json_extract_string(props, '$.' || k) FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def json_tree_nodes(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_id", "props")
    return trees.json_nodes(e, "event_id", "props").select("event_id", "seq", "depth", "key_name", "type_name", "value")


@query()
def html_tree_nodes(spark, sf_dir):
    n = trees.html_nodes(T.table(spark, sf_dir, "pages"), "page_id", "html")
    return n.groupBy("type_name").agg(F.count("*").alias("nodes"), F.max("depth").alias("deepest"))


@query("""WITH x AS (SELECT o_orderkey, '$Root: Order = {' || chr(10) || '    status: OrderStatus = {' || chr(10) || '        value = ' || o_orderstatus || chr(10) || '    }' || chr(10) || '    priority: OrderPriority = {' || chr(10) || '        value = ' || o_orderpriority || chr(10) || '    }' || chr(10) || '    lines: Array<LineItem> = {' || chr(10) AS head FROM orders),
l AS (SELECT l_orderkey, string_agg('        ' || i || ': LineItem = {' || chr(10) || '            value = ' || l_returnflag || l_linestatus || chr(10) || '        }' || chr(10), '' ORDER BY i) AS body FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS i FROM lineitem) GROUP BY 1)
SELECT o_orderkey, head || coalesce(body, '') || '    }' || chr(10) || '}' || chr(10) AS text FROM x LEFT JOIN l ON l_orderkey = o_orderkey""")
def pretty_print(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = T.numbered_lines(T.table(spark, sf_dir, "lineitem"))
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", F.concat("l_returnflag", "l_linestatus").alias("v")))).alias("items"))
    nl = "\n"
    body = F.concat_ws("", F.transform("items", lambda t: F.concat(F.lit("        "), t["i"].cast("string"), F.lit(f": LineItem = {{{nl}            value = "), t["v"], F.lit(f"{nl}        }}{nl}"))))
    head = F.concat(F.lit(f"$Root: Order = {{{nl}    status: OrderStatus = {{{nl}        value = "), "o_orderstatus", F.lit(f"{nl}    }}{nl}    priority: OrderPriority = {{{nl}        value = "), "o_orderpriority", F.lit(f"{nl}    }}{nl}    lines: Array<LineItem> = {{{nl}"))
    j = o.join(items, o["o_orderkey"] == items["l_orderkey"], "left")
    return j.select("o_orderkey", F.concat(head, F.coalesce(body, F.lit("")), F.lit(f"    }}{nl}}}{nl}")).alias("text"))


def _coded(spark, sf_dir):
    c = _costs(spark, sf_dir).select("o_custkey", "o_orderkey", "size", "offset", "total")
    return range_coder.encode_groups(c, "o_custkey", ["o_orderkey"]), c


@query()
def range_encode_size(spark, sf_dir):
    coded, _ = _coded(spark, sf_dir)
    return coded.select("o_custkey", "n_symbols", F.octet_length("coded").cast("long").alias("n_bytes"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_symbols, true AS same FROM orders GROUP BY 1")
def range_roundtrip(spark, sf_dir):
    coded, c = _coded(spark, sf_dir)
    want = c.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "size", "offset", "total"))), lambda t: F.struct(t["size"], t["offset"], t["total"])).alias("steps"))

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            same = []
            for data, steps in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                d, ok = range_coder.Reader(data), True
                for step in steps:
                    size, offset, total = step.values()
                    at = d.find(total)
                    ok = ok and offset <= at < offset + size
                    d.accept(size, offset, total)
                same.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], names=["o_custkey", "n_symbols", "same"])

    j = coded.join(want, "o_custkey").select("o_custkey", "n_symbols", "coded", "steps")
    return j.mapInArrow(decode, f"o_custkey {dict(c.dtypes)['o_custkey']}, n_symbols long, same boolean")


@query()
def gzip_ratio(spark, sf_dir):
    sizes = store.compressed_sizes(T.table(spark, sf_dir, "documents"), "doc_id", "text")
    return sizes.select("doc_id", F.col("size").alias("n_bytes"), "gzip_bytes")


# Typed trees


def _lengths_sql() -> str:
    both = ("o_custkey", "o_custkey", "lineitem JOIN orders ON l_orderkey = o_orderkey")
    parts = [(1, _symbol_sql("Order", "LineItem", *both), ""), (2, _symbol_sql("Customer.orders.*/Order", "Order.lines.*/LineItem", *both), ""), (3, _symbol_sql("X", "Customer.orders.*/Order.lines.*/LineItem", *both), " WHERE t LIKE 'Customer%'")]
    rows = " UNION ALL ".join(f"SELECT * FROM (WITH {s} SELECT {n} AS suffix_len, t, sym FROM s{w})" for n, s, w in parts)
    return f"SELECT CAST(suffix_len AS INT) AS suffix_len, split_part(t, '#', 1) AS suffix, split_part(t, '#', 2) AS tag, sym AS sym_name, CAST(count(*) AS BIGINT) AS hits FROM ({rows}) GROUP BY ALL"


@query(_lengths_sql())
def path_suffix_lengths(spark, sf_dir):
    rows = T.order_symbols(spark, sf_dir, [1, 2, 3], True)
    return rows.groupBy("suffix_len", "suffix", "tag", "sym_name").agg(F.count("*").alias("hits"))


_EVENT_TABLES = """b AS (SELECT 'Event.value' AS suffix, 'type' AS tag, CASE WHEN value IS NULL THEN 'null' ELSE 'f64' END AS sym FROM events UNION ALL
  SELECT 'Event.props', 'type', CASE WHEN props IS NULL THEN 'null' ELSE 'str' END FROM events UNION ALL SELECT 'Event.type', 'EventType', event_type FROM events),
a(suffix, tag, i, sym) AS (VALUES ('Event.value', 'type', 0, 'null'), ('Event.value', 'type', 1, 'f64'), ('Event.props', 'type', 0, 'null'), ('Event.props', 'type', 1, 'str'),
  ('Event.type', 'EventType', 0, 'Click'), ('Event.type', 'EventType', 1, 'Error'), ('Event.type', 'EventType', 2, 'Purchase'), ('Event.type', 'EventType', 3, 'Signup'), ('Event.type', 'EventType', 4, 'View')),
f AS (SELECT a.suffix, a.tag, a.i, a.sym, count(b.sym) AS h FROM a LEFT JOIN b ON a.suffix = b.suffix AND a.tag = b.tag AND lower(a.sym) = lower(b.sym) GROUP BY ALL)"""


@query(f"WITH {_EVENT_TABLES} SELECT suffix, tag, CAST(i AS INT) AS sym_index, sym AS sym_name, CAST(h AS BIGINT) AS hits, CAST(sum(h) OVER (PARTITION BY suffix, tag) AS BIGINT) AS total_hits, (SELECT CAST(4 * count(*) AS BIGINT) FROM events) AS total_symbols FROM f")
def typed_path_suffix(spark, sf_dir):
    """Type and value tables of event trees, zeros included, with the number of all locations."""
    freq = analyses.path_suffix(T.event_trees(spark, sf_dir), T.table_schema(), 1, "event_id").where("scope = 'ALL'")
    return freq.select("suffix", "tag", "sym_index", "sym_name", "hits", "total_hits", "total_symbols")


@query("""SELECT 'Event' AS bound, 'Iface<Event>' AS type_name, CAST(0 AS INT) AS type_index, CAST(1 AS INT) AS type_set_size, CAST(count(*) AS BIGINT) AS n FROM events UNION ALL
SELECT 'EventType', 'Enum<EventType>', 0, 1, count(*) FROM events UNION ALL
SELECT 'Union<null | f64>', CASE WHEN value IS NULL THEN 'null' ELSE 'f64' END, CASE WHEN value IS NULL THEN 0 ELSE 1 END, 2, count(*) FROM events GROUP BY 2, 3 UNION ALL
SELECT 'Union<null | str>', CASE WHEN props IS NULL THEN 'null' ELSE 'str' END, CASE WHEN props IS NULL THEN 0 ELSE 1 END, 2, count(*) FROM events GROUP BY 2, 3""")
def resolve_type(spark, sf_dir):
    """The member of its declared type that every value has."""
    n = T.event_trees(spark, sf_dir).groupBy("bound", "type_name", "type_index", "type_set_size").agg(F.count("*").alias("n"))
    return n.withColumn("bound", F.regexp_replace("bound", "^Iface<(.*)>$", "$1"))


@query("""SELECT event_id, '$Root: Iface<Event> = {' || chr(10) || '    @ iface(Event)' || chr(10) || chr(10)
  || '    type: EventType = {' || chr(10) || '        @ enum(EventType)' || chr(10) || '    ' || chr(10) || '        value = EventType_' || upper(event_type[1]) || event_type[2:] || chr(10) || '    }' || chr(10)
  || '    value: Union<null | f64> = {' || chr(10) || '        @ ' || CASE WHEN value IS NULL THEN 'null' ELSE 'f64' END || chr(10) || '    ' || chr(10) || '        value = ' AS head,
  '    props: Union<null | str> = {' || chr(10) || '        @ ' || CASE WHEN props IS NULL THEN 'null' ELSE 'str' END || chr(10) || '    ' || chr(10) || '        value = ' || coalesce(props, 'null') || chr(10) || '    }' || chr(10) || '}' || chr(10) AS tail FROM events""")
def pretty_print_trees(spark, sf_dir):
    """Printed event trees, before and after the number, whose text differs between engines."""
    p = analyses.pretty_print(T.event_trees(spark, sf_dir), "event_id")
    head = F.regexp_extract("text", r"(?s)^(.*?    value: Union<null [|] f64> = \{\n        @ \w+\n    \n        value = )", 1)
    return p.select("event_id", head.alias("head"), F.regexp_extract("text", r"(?s)(    props: Union<null [|] str> = \{.*)$", 1).alias("tail"))


_TURNS = "t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text FROM conversations), r AS (SELECT conv_id, 3 * i AS pos, 'ident' AS kind, role AS str FROM t WHERE role IS NOT NULL UNION ALL SELECT conv_id, 3 * i + 1, 'raw', text FROM t WHERE text IS NOT NULL)"


@query(f"""WITH {_TURNS}, d AS (SELECT conv_id, str, count(*) FILTER (WHERE kind = 'ident') AS i, count(*) FILTER (WHERE kind = 'raw') AS r, count(*) AS n, min(pos) AS p FROM r GROUP BY 1, 2),
w AS (SELECT str, sum(i) AS i, sum(r) AS r, sum(n) AS n, min((CAST(conv_id AS VARCHAR), p)) AS f FROM d GROUP BY 1)
SELECT 'doc' AS scope, CAST(conv_id AS VARCHAR) AS conv_id, str, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY p, str) - 1 AS BIGINT) AS idx, CAST(i AS BIGINT) AS ident_count, CAST(0 AS BIGINT) AS prop_count, CAST(r AS BIGINT) AS raw_count, CAST(n AS BIGINT) AS total_count FROM d
UNION ALL SELECT 'ALL', '', str, CAST(row_number() OVER (ORDER BY f, str) - 1 AS BIGINT), CAST(i AS BIGINT), 0, CAST(r AS BIGINT), CAST(n AS BIGINT) FROM w""")
def global_strings_scoped(spark, sf_dir):
    """Counts of strings by kind with their order of appearance, per conversation and overall."""
    return analyses.global_strings(T.conversation_trees(spark, sf_dir), "conv_id")


def _scoped_windows_sql(sizes):
    ranks = _rank_sql("conversations", "conv_id", "turn, text", "role")
    return f"""WITH {ranks}, q AS (SELECT 'doc' AS scope, CAST(stream AS VARCHAR) AS conv_id, dist FROM r UNION ALL SELECT 'ALL', '', dist FROM r), w AS (SELECT unnest({sizes}) AS window_size),
f AS (SELECT scope, conv_id, window_size, CASE WHEN dist >= window_size THEN -1 ELSE dist END AS rank, count(*) AS c FROM q CROSS JOIN w GROUP BY ALL),
z AS (SELECT k.scope, k.conv_id, k.window_size, k.rank, coalesce(c, 0) AS c FROM (SELECT DISTINCT scope, conv_id, w.window_size, unnest(range(-1, w.window_size)) AS rank FROM q CROSS JOIN w) k LEFT JOIN f ON f.scope = k.scope AND f.conv_id = k.conv_id AND f.window_size = k.window_size AND f.rank = k.rank),
t AS (SELECT scope, conv_id, window_size, sum(c) AS t, sum(c) FILTER (WHERE rank >= 0) AS h FROM z GROUP BY ALL),
o AS (SELECT scope, conv_id, window_size, CASE WHEN rank < 0 THEN 'MISSES' ELSE CAST(rank AS VARCHAR) END AS index, c FROM z UNION ALL SELECT scope, conv_id, window_size, 'HITS', h FROM t UNION ALL SELECT scope, conv_id, window_size, 'TOTAL', t FROM t)
SELECT o.scope, o.conv_id, CAST(o.window_size AS INT) AS window_size, index, CAST(c AS BIGINT) AS count, round(c / t, 9) AS prob FROM o JOIN t ON o.scope = t.scope AND o.conv_id = t.conv_id AND o.window_size = t.window_size"""


@query(_scoped_windows_sql([2, 4]))
def string_window_scoped(spark, sf_dir):
    """Window histograms of the identifiers of conversation trees, per conversation and overall."""
    w = analyses.string_window(T.conversation_trees(spark, sf_dir), [2, 4], "conv_id").where("str_kind = 'ident'")
    return w.select("scope", "conv_id", "window_size", "index", F.col("count").cast("long").alias("count"), F.round("prob", 9).alias("prob"))


@query()
def entropy_code_conversations(spark, sf_dir):
    """Bits of every label, and the bytes, of conversation trees coded by the models of all."""
    nodes = T.conversation_trees(spark, sf_dir).withColumn("conv_id", F.col("conv_id").cast("string"))
    freq = analyses.path_suffix(nodes, T.table_schema(), 2, "conv_id").where("scope = 'ALL'")
    windows = analyses.string_window(nodes, [64], "conv_id").where("scope = 'ALL'")
    model = coding.table_model(freq).unionByName(coding.string_model(windows, 64))
    words = strings.dictionary(analyses.global_strings(nodes, "conv_id").where("scope = 'ALL'").select(F.col("str").alias("value"), "total_count"))
    costed = coding.costs(coding.symbol_rows(nodes, "conv_id", 64, words), model)
    bits = coding.rollup(costed, "conv_id").where("label = 'sym'").select("conv_id", F.round("bits", 4).alias("bits"), "symbols")
    return bits.join(coding.encode(costed, "conv_id").select("conv_id", F.octet_length("coded").cast("long").alias("n_bytes")), "conv_id")


# Schemas and scopes


@query("""WITH RECURSIVE alias(name, kind, part) AS (VALUES ('Event', 'iface', 'Event'), ('Turn', 'iface', 'Turn'), ('History', 'iface', 'History'), ('Conversation', 'iface', 'Conversation'), ('EventType', 'enum', 'EventType'), ('Kind', 'ident', 'ident')),
field(place, iface, name, part) AS (VALUES (0, 'Event', 'type', 'EventType'), (1, 'Event', 'value', 'null'), (1, 'Event', 'value', 'f64'), (2, 'Event', 'props', 'null'), (2, 'Event', 'props', 'str'), (0, 'Turn', 'role', 'null'), (0, 'Turn', 'role', 'Kind'), (1, 'Turn', 'text', 'null'), (1, 'Turn', 'text', 'str')),
prim(name, r) AS (VALUES ('null', 0), ('bool', 1), ('uint', 2), ('int', 3), ('f64', 4), ('str', 5)),
flat(iface, place, name, part, depth) AS (SELECT iface, place, name, part, 0 FROM field UNION SELECT f.iface, f.place, f.name, a.part, 1 FROM flat f JOIN alias a ON a.name = f.part AND f.depth = 0),
leaf AS (SELECT f.*, p.r, a.kind FROM flat f LEFT JOIN prim p ON p.name = f.part LEFT JOIN alias a ON a.part = f.part WHERE p.r IS NOT NULL OR f.depth = 1)
SELECT DISTINCT iface, name, CASE WHEN r IS NOT NULL THEN part WHEN kind = 'ident' THEN 'id(' || part || ')' WHEN kind = 'enum' THEN 'Enum<' || part || '>' ELSE 'Iface<' || part || '>' END AS member,
  CAST(dense_rank() OVER (PARTITION BY iface, name ORDER BY CASE WHEN r IS NOT NULL THEN 0 WHEN kind = 'ident' THEN 1 WHEN kind = 'iface' THEN 3 ELSE 4 END, r, part) - 1 AS INT) AS sym_index FROM leaf""")
def typeset_flatten(spark, sf_dir):
    """The members of the type sets of fields, in symbol order (fields without arrays)."""
    schema = T.table_schema()
    sets = views.alphabets(spark, schema).where("alphabet like 'type %'").withColumn("bound", F.substring("alphabet", 6, 1000))
    fields = views.fields(spark, schema).where("bound not like 'Array<%'")
    return fields.join(sets, "bound").select("iface", "name", F.col("sym_name").alias("member"), "sym_index")


_SCOPES = "(1, 'global', 0, 100, 0), (2, 'function', 10, 60, 1), (3, 'block', 20, 40, 2), (4, 'function', 25, 35, 3), (5, 'block', 70, 90, 1)"
_BOUND = "(1, 'x'), (1, 'y'), (2, 'x'), (3, 'z'), (4, 'w'), (5, 'y')"
_USED = "(5, 'x'), (15, 'x'), (22, 'x'), (30, 'x'), (30, 'y'), (30, 'z'), (30, 'w'), (45, 'z'), (75, 'y'), (80, 'x'), (95, 'q')"


@query(f"""WITH s(scope, kind, b, e, depth) AS (VALUES {_SCOPES}), n(scope, name) AS (VALUES {_BOUND}), u(pos, name) AS (VALUES {_USED}),
m AS (SELECT u.pos, u.name, arg_max(s.scope, s.depth) AS scope, max(s.depth) AS depth FROM u JOIN n ON n.name = u.name JOIN s ON s.scope = n.scope AND u.pos >= s.b AND u.pos < s.e GROUP BY 1, 2)
SELECT u.pos, u.name, m.scope, coalesce((SELECT bool_or(f.kind = 'function') FROM s f WHERE f.depth > m.depth AND u.pos >= f.b AND u.pos < f.e), false) AS captured FROM u LEFT JOIN m ON m.pos = u.pos AND m.name = u.name""")
def scope_capture(spark, sf_dir):
    """Uses of names, the nearest scope that binds them, and whether a function lies between."""
    s = spark.sql(f"select * from values {_SCOPES} as t(scope, kind, begin, end, depth)").withColumn("doc", F.lit(1))
    n = spark.sql(f"select * from values {_BOUND} as t(scope, name)").withColumn("doc", F.lit(1))
    u = spark.sql(f"select * from values {_USED} as t(pos, name)").withColumn("doc", F.lit(1))
    return scopes.resolve_uses(u, s, n, ["doc"]).select("pos", "name", "scope", "captured")
