"""The corpus operators bound to the whole given tables, and the SQL their rows must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat_format, decontaminate, embedding_dedup, hamming_search, importance, line_dedup, ngram_join, pieces, pii, prefix_trie, secrets, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM w d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""


_OP1 = r"""
WITH t AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
l AS (SELECT doc_id, line, trim(translate(s, chr(9) || chr(13), '  ')) AS h, len(regexp_extract_all(s, '\S+')) AS w FROM t),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY line)::BIGINT AS past FROM l WHERE w > 0),
f AS (
  SELECT doc_id, list(h) OVER a AS k, min(line) OVER a AS first, max(line) OVER a AS last, sum(w) OVER a AS words, 'f' AS kind FROM c
  WINDOW a AS (PARTITION BY doc_id ORDER BY past - w RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, list(h) OVER b, min(line) OVER b, max(line) OVER b, sum(w) OVER b, 'b' FROM c
  WINDOW b AS (PARTITION BY doc_id ORDER BY past RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, min((doc_id, first)) OVER (PARTITION BY kind, md5(array_to_string(k, chr(10)))) AS earliest FROM f WHERE words >= 50),
x AS (SELECT DISTINCT c.doc_id, c.line FROM g JOIN c ON c.doc_id = g.doc_id AND c.line BETWEEN g.first AND g.last WHERE g.earliest < (g.doc_id, g.first)),
y AS (SELECT l.doc_id, l.line, CASE WHEN l.w > 0 THEN x.line IS NOT NULL END AS gone FROM l LEFT JOIN x USING (doc_id, line)),
d AS (SELECT doc_id, line FROM (
  SELECT doc_id, line, last_value(gone IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS up, first_value(gone IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down FROM y) WHERE up AND down)
SELECT t.doc_id, count(*)::BIGINT AS n_lines, count(d.line)::BIGINT AS n_removed, coalesce(string_agg(t.s, chr(10) ORDER BY t.line) FILTER (WHERE d.line IS NULL), '') AS text
FROM t LEFT JOIN d USING (doc_id, line) GROUP BY t.doc_id
"""


@query("op1_line_dedup", _OP1)
def op1(spark, sf_dir):
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("row.doc_id", F.col("lines").cast("long").alias("n_lines"), F.col("removed").cast("long").alias("n_removed"), "text")


@query("op5_toxicity")
def op5(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = v.vec_id
"""


@query("op9_embedding_dedup", _OP9)
def op9(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


MODEL, VOCABULARY = "piece_bpe_32k.model", "byte_bpe_50k.json"


@query("op6_sentencepiece")
def op6(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


@query("op7_token_counts")
def op7(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op2_decontaminate")
def op2(spark, sf_dir):
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "edits")


@query("op4_ngram_jaccard", _OP4)
def op4(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_OP3 = """
WITH c AS (SELECT conv_id, turn, to_json({'chars': length(text), 'query': text, 'turn': turn})::VARCHAR AS json, text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL),
o AS (SELECT conv_id, turn, min(json) AS json, count(*) AS copies FROM c GROUP BY conv_id, turn),
r AS (SELECT conv_id, turn - 1 AS turn, count(*) AS results FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT o.conv_id, 'call_' || o.conv_id || '_' || o.turn AS call_id, o.turn, 0 AS level, o.copies::BIGINT AS copies, CASE WHEN r.results IS NULL THEN NULL ELSE o.turn + 1 END AS result_turn,
  coalesce(r.results, 0)::BIGINT AS results,
  concat_ws(',', CASE WHEN r.results IS NULL THEN 'no_result' END, CASE WHEN o.turn >= 2 AND p.conv_id IS NULL THEN 'unknown_need' END) AS errors, o.json
FROM o LEFT JOIN r USING (conv_id, turn) LEFT JOIN o p ON p.conv_id = o.conv_id AND p.turn = o.turn - 2
"""


@query("op3_chat_format", _OP3)
def op3(spark, sf_dir):
    calls, results = chat_format.calls_of_turns(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(chat_format.REPLY, "name string, field string, type string, required boolean")
    # Its SQL has the calls only, so results without a call (system turns among them) stay with the operator.
    linked = chat_format.linked_calls(calls, results, schemas).where("name IS NOT NULL")
    return linked.withColumn("errors", F.array_join("errors", ",")).drop("name", "result")


@query("op8_secret_scan")
def op8(spark, sf_dir):
    return secrets.secrets(table(spark, sf_dir, "documents"))


@query("op10_pii")
def op10(spark, sf_dir):
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


# The checksum of a feature's bytes, by a table of 256 registers; of an id's digits, bit by bit.
_OP12 = r"""
WITH k AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(0, 8), lambda a, j: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(0, 256) r(i))),
w AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
a AS (SELECT side, row_number() OVER () AS pos, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM w),
f AS (SELECT side, pos, g, count(*) AS c FROM (SELECT side, pos, unnest(flatten([list_transform(range(1, len(x) - n + 2), lambda i: array_to_string(x[i:i+n-1], ' ')) for n in [1, 2, 3]])) AS g FROM a) GROUP BY ALL),
u AS (SELECT g, xor(list_reduce([4294967295] || list_transform(range(1, length(h) // 2 + 1), lambda i: (instr('123456789ABCDEF', h[2*i-1]) * 16 + instr('123456789ABCDEF', h[2*i]))::BIGINT), lambda s, b: xor(tab[xor(s, b) % 256 + 1], s >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT g, hex(encode(g)) AS h FROM f), k),
n AS (SELECT bucket, coalesce(sum(c) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM f JOIN u USING (g) GROUP BY bucket),
z AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM n),
v AS (SELECT bucket, floor(1000 * ln((n.t + 1) * (z.all_s + 10000) / ((n.s + 1) * (z.all_t + 10000))))::BIGINT AS gain FROM n, z),
y AS (SELECT pos, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM f JOIN u USING (g) JOIN v USING (bucket) GROUP BY pos),
q AS (SELECT a.doc_id, len(x) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('42:' || a.doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM a LEFT JOIN y USING (pos) WHERE side = 'd'),
e AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))))::BIGINT AS score FROM q),
o AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place, (SELECT count(*) * 5 // 100 FROM q WHERE words >= 20) AS draws FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draws THEN place END::BIGINT AS rank FROM o
"""


@query("op12_importance_resampling", _OP12)
def op12(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP13 = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce([4294967295] || list_transform(range(0, 8 * length(s)), lambda j: CASE WHEN j % 8 = 0 THEN ascii(substr(s, (j // 8 + 1)::BIGINT, 1)) ELSE 0 END::BIGINT),
  lambda a, b: CASE WHEN xor(a, b) % 2 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END), 4294967295) % 6 AS h FROM i),
b AS (SELECT c.conv_id, t.pos AS d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h),
k AS (SELECT conv_id, count(*) AS n FROM b GROUP BY conv_id),
r AS (SELECT * FROM b UNION ALL SELECT t.conv_id, coalesce(k.n, 0) + t.pos - c.h, t.role, t.text FROM t JOIN c USING (conv_id) LEFT JOIN k USING (conv_id) WHERE t.pos > c.h),
p AS (SELECT conv_id, d, length(text) AS chars, list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r UNION ALL SELECT conv_id, 0, 0, [] FROM c),
m AS (SELECT conv_id, d, chars, min(conv_id) OVER (PARTITION BY path) AS rep FROM p),
n AS (SELECT rep, d, count(*) AS n, max(chars) AS chars FROM m GROUP BY rep, d),
x AS (SELECT n.*, u.rep AS up FROM n LEFT JOIN m u ON u.conv_id = n.rep AND u.d = n.d - 1),
y AS (SELECT x.*, coalesce(z.kids, 0) AS kids FROM x LEFT JOIN (SELECT up, d - 1 AS d, count(*) AS kids FROM x WHERE d > 0 GROUP BY ALL) z ON z.up = x.rep AND z.d = x.d),
s AS (SELECT m.rep, m.d, count(*) FILTER (WHERE y.kids = 0) AS leaves, sum((y.n - 1) * y.chars) AS saved FROM y JOIN m ON m.conv_id = y.rep AND m.d <= y.d GROUP BY m.rep, m.d),
e AS (SELECT m.rep, m.d, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ids FROM m JOIN (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id) l USING (conv_id, d) GROUP BY m.rep, m.d)
SELECT y.rep AS conv_id, y.d::BIGINT AS depth, y.up AS parent_conv_id, y.n::BIGINT AS n_convs, y.kids::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM y JOIN s ON s.rep = y.rep AND s.d = y.d LEFT JOIN e ON e.rep = y.rep AND e.d = y.d
"""


@query("op13_prefix_trie", _OP13)
def op13(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op11_hamming_search")
def op11(spark, sf_dir):
    return hamming_search.nearest(table(spark, sf_dir, "embeddings"))
