"""Scalar functions applied to whole tables: names in many spellings, document lines, URLs, pages, sizes, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind, sqlfn as s
from checks.bind import TEXT, with_views
from checks.registry import case
from weftline.functions import dates, facets, numbers, text
from weftline.sources import json_payloads


def over_names(key: str, column, sql: str):
    """Register a function of names.name over every name."""
    case(key, with_views(f"SELECT kind, k, v, {sql} AS out FROM names", "names"))(
        lambda spark, sf: bind.view(spark, sf, "names").select("kind", "k", "v", column().alias("out"))
    )


over_names("slugify", lambda: text.slugify(F.col("name")), s.slugify("name"))
over_names("strip_md_links", lambda: text.strip_md_links(F.col("name")), s.strip_links("name"))
over_names("model_key", lambda: text.model_key(F.col("name")), s.model_key("name"))
over_names("cluster_key", lambda: text.cluster_key(F.col("name")), s.cluster_key("name"))
over_names("enrich_norm_key", lambda: text.enrich_norm_key(F.col("name")), s.norm_key("name"))
over_names("candidate_keys", lambda: F.array_join(F.sort_array(text.candidate_keys(F.col("id"), F.col("name"))), ","), f"array_to_string({s.candidate_keys('id', 'name')}, ',')")
over_names("header_key", lambda: text.header_key(F.col("name")), s.alnum("name"))
over_names("alnum_key", lambda: text.alnum_key(F.col("id")), s.alnum("id"))
over_names("slug_name", lambda: text.slug_name(F.col("name")), s.trim(s.rep1("name", rf"(?i){s.W}*\({s.W}*La{s.W}+Plateforme{s.W}*\)")))
over_names("join_alias_resolve", lambda: text.canonical_slug(F.col("name")), s.canonical_slug("name"))
over_names("domain_from_name", lambda: text.domain_from_name(F.col("id")), s.domain_name("id"))
over_names("looks_like_raw_id", lambda: text.looks_like_raw_id(F.col("name")), "(contains(name, '/') OR starts_with(name, '@'))")

# Lines of all documents and conversations, with placeholders among them.
TEXT["short_lines"] = """
SELECT doc_id AS k, CASE doc_id % 6 WHEN 0 THEN ' n/a ' WHEN 1 THEN '—' WHEN 2 THEN '  ' || lang || ' ' WHEN 3 THEN '' WHEN 4 THEN 'None' ELSE text END AS line FROM {documents}
UNION ALL SELECT conv_id * 1000 + turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN chr(9) || role || chr(10) ELSE role END FROM {conversations}"""


def over_lines(key: str, column, sql: str):
    case(key, with_views(f"SELECT k, md5({sql}) AS out FROM short_lines", "short_lines"))(
        lambda spark, sf: bind.view(spark, sf, "short_lines").select("k", F.md5(column()).alias("out"))
    )


over_lines("clean_str", lambda: text.clean_str(F.col("line")), s.clean_str("line"))
over_lines("clean_modality", lambda: facets.clean_modality(F.col("line")), s.blank_null("line"))
over_lines("escape_xml", lambda: text.escape_xml(F.col("line")), "replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')")
over_lines("escape_cell", lambda: text.escape_cell(F.col("line")), "replace(replace(line, '|', '\\|'), chr(10), ' ')")


@case("free_limit_of", f"""
WITH t AS (SELECT doc_id AS k, text FROM documents UNION ALL SELECT 10000000 + conv_id * 1000 + turn, text FROM conversations
  UNION ALL SELECT 20000000 + p_partkey, CASE p_partkey % 12 WHEN 0 THEN '$' || p_size || ' of credit' WHEN 1 THEN '$5 sign-up credit' WHEN 2 THEN 'Get ~' || p_size || ' M free tokens / month now'
    WHEN 3 THEN p_size || 'K monthly credits daily' WHEN 4 THEN p_size || ',000 API calls per month' WHEN 5 THEN p_size || ',000 neurons' WHEN 6 THEN p_size || ' requests / day'
    WHEN 7 THEN p_size || ' RPM per IP' WHEN 8 THEN '~' || p_size || '+ permanently free models' WHEN 9 THEN 'Permanent plan' WHEN 10 THEN 'no signup at all' ELSE 'just ' || p_name END FROM part)
SELECT k, {s.free_limit('text')} AS free_limit FROM t""")
def _(spark, sf):
    docs = bind.table(spark, sf, "documents").select(F.col("doc_id").alias("k"), "text")
    talks = bind.table(spark, sf, "conversations").select((10000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    parts = bind.view(spark, sf, "claims").select((20000000 + F.col("k")).alias("k"), "text")
    rows = docs.unionByName(talks).unionByName(parts)
    return rows.select("k", numbers.free_limit_of(F.col("text")).alias("free_limit"))


TEXT["claims"] = """
SELECT p_partkey AS k, CASE p_partkey % 12 WHEN 0 THEN '$' || p_size || ' of credit' WHEN 1 THEN '$5 sign-up credit' WHEN 2 THEN 'Get ~' || p_size || ' M free tokens / month now'
  WHEN 3 THEN p_size || 'K monthly credits daily' WHEN 4 THEN p_size || ',000 API calls per month' WHEN 5 THEN p_size || ',000 neurons' WHEN 6 THEN p_size || ' requests / day'
  WHEN 7 THEN p_size || ' RPM per IP' WHEN 8 THEN '~' || p_size || '+ permanently free models' WHEN 9 THEN 'Permanent plan' WHEN 10 THEN 'no signup at all' ELSE 'just ' || p_name END AS text
FROM {part}"""


@case("safe_url", f"""SELECT page_id, {s.safe_url('url')} AS url, {s.safe_url("CASE page_id % 4 WHEN 0 THEN 'javascript:x(1)' WHEN 1 THEN '/rel' WHEN 2 THEN 'HTTP://h.example:80' ELSE replace(url, 'http', 'ftp') END")} AS odd FROM pages""")
def _(spark, sf):
    k = F.col("page_id") % 4
    odd = F.when(k == 0, "javascript:x(1)").when(k == 1, "/rel").when(k == 2, "HTTP://h.example:80").otherwise(F.replace("url", F.lit("http"), F.lit("ftp")))
    return bind.table(spark, sf, "pages").select("page_id", text.safe_url(F.col("url")).alias("url"), text.safe_url(odd).alias("odd"))


@case("domain_of", f"SELECT page_id, {s.domain_of('url')} AS domain FROM pages")
def _(spark, sf):
    return bind.table(spark, sf, "pages").select("page_id", text.domain_of(F.col("url")).alias("domain"))


@case("domain_for", with_views(f"SELECT source, slug, {s.domain_for('slug', 'name', 'url', 'base_url')} AS domain FROM p", "p"))
def _(spark, sf):
    d = text.domain_for(F.col("slug"), F.col("name"), F.col("url"), F.col("base_url"))
    return bind.view(spark, sf, "p").select("source", "slug", d.alias("domain"))


@case("decode_entities", f"SELECT page_id, md5({s.decode_numeric(s.decode('html'))}) AS out FROM (SELECT page_id, html || '&#' || (65 + page_id % 26) || ';&amp;lt;&#39;' AS html FROM pages)")
def _(spark, sf):
    html = F.concat("html", F.lit("&#"), (65 + F.col("page_id") % 26).cast("string"), F.lit(";&amp;lt;&#39;"))
    return bind.table(spark, sf, "pages").select("page_id", F.md5(text.decode_entities(html)).alias("out"))


@case("html_text_of", f"SELECT page_id, md5({s.text_of('html')}) AS out FROM pages")
def _(spark, sf):
    return bind.table(spark, sf, "pages").select("page_id", F.md5(text.html_text_of(F.col("html"))).alias("out"))


@case("has_markup_or_entity", f"SELECT 'page' AS kind, page_id AS k, {s.markup('html')} AS out FROM pages UNION ALL SELECT 'doc', doc_id, {s.markup('text')} FROM documents")
def _(spark, sf):
    pages = bind.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("k"), text.has_markup_or_entity(F.col("html")).alias("out"))
    docs = bind.table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("k"), text.has_markup_or_entity(F.col("text")).alias("out"))
    return pages.unionByName(docs)


@case("license_clean", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'MIT' END AS license FROM orders")
def _(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", "MIT").when(F.col("o_orderstatus") == "O", "NOASSERTION").otherwise("")
    return bind.table(spark, sf, "orders").select("o_orderkey", text.license_clean(raw).alias("license"))


# One JSON value per event: a number, a string, an object or null.
TEXT["dynamic"] = """
SELECT event_id, event_id % 4 AS pick, k, '{"k": ' || CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN '"' || k || 'K"' WHEN 2 THEN '{"a": 1}' ELSE 'null' END || '}' AS payload
FROM (SELECT event_id, regexp_extract(props, '[0-9]+', 0) AS k FROM {events}) e"""


def over_dynamic(key: str, fn, sql: str):
    case(key, with_views(f"SELECT event_id, {sql} AS out FROM dynamic", "dynamic"))(
        lambda spark, sf: bind.view(spark, sf, "dynamic").select("event_id", F.try_parse_json(F.col("payload")).alias("v")).select("event_id", fn(F.col("v"), "$.k").alias("out"))
    )


over_dynamic("scalar_or_null", json_payloads.scalar_or_null, "CASE pick WHEN 0 THEN nullif(k, '0') WHEN 1 THEN k || 'K' END")
over_dynamic("num_or_null", json_payloads.num_or_null, "CASE pick WHEN 0 THEN CAST(k AS DOUBLE) END")
over_dynamic("str_or_null", json_payloads.str_or_null, "CASE pick WHEN 1 THEN k || 'K' END")


def over_models(key: str, columns, sql: dict):
    """Register functions of the per-source model fields over every model row."""
    body = ", ".join(f"{v} AS {n}" for n, v in sql.items())
    case(key, with_views(f"SELECT source, slug, id, {body} FROM c", "c"))(
        lambda spark, sf: bind.view(spark, sf, "c").select("source", "slug", "id", *[c.alias(n) for n, c in columns().items()])
    )


over_models("ctx_num", lambda: {"n": numbers.ctx_num(F.col("context")), "r": numbers.ctx_num(F.col("rate_limit"))}, {"n": s.ctx_num("context"), "r": s.ctx_num("rate_limit")})
over_models("parse_context_tokens", lambda: {"n": numbers.parse_context_tokens(F.col("context")), "r": numbers.parse_context_tokens(F.col("rate_limit"))}, {"n": s.parse_ctx("context"), "r": s.parse_ctx("rate_limit")})
over_models(
    "clean_ctx_str", lambda: {"n": numbers.clean_ctx_str(F.concat(F.lit(" Up to "), F.regexp_replace(F.col("context"), "K", ".0 M")))},
    {"n": s.clean_ctx("(' Up to ' || replace(context, 'K', '.0 M'))")},
)
over_models(
    "facets_of", lambda: {"out": F.array_join(F.sort_array(facets.facets_of(F.col("modality"))), ",")},
    {"out": f"array_to_string(list_sort({s.facet_list(lambda f: s.facet('modality', f))}), ',')"},
)
over_models(
    "model_matches_facet", lambda: {f: facets.has_facet(F.col("modality"), f) for f in bind.FACETS}, {f: s.facet("modality", f) for f in bind.FACETS},
)
over_models("no_token_context", lambda: {"out": numbers.no_token_context(F.col("modality"), F.col("id"), F.col("name"))}, {"out": s.no_token("modality", "id", "name")})
over_models(
    "parse_rate_limit",
    lambda: {"raw": numbers.rate_limit_raw(F.col("rate_limit")), "per_day": numbers.rate_limit_per_day(F.col("rate_limit")), "unlimited": numbers.rate_limit_unlimited(F.col("rate_limit"))},
    {"raw": s.rl_raw("rate_limit"), "per_day": s.rl_day("rate_limit"), "unlimited": s.rl_unlimited("rate_limit")},
)
over_models(
    "rate_limit_score", lambda: {"score": F.least(numbers.rate_limit_score(F.col("rate_limit")), F.lit(1e12))},
    {"score": f"CASE WHEN {s.rl_unlimited('rate_limit')} THEN 1e12 ELSE coalesce({s.rl_day('rate_limit')}, -1.0) END"},
)
over_models(
    "score_linear", lambda: {"score": F.round(numbers.score_linear(F.col("modality"), F.col("context"), F.col("max_output"), F.col("rate_limit"), "text"), 6)},
    {"score": f"round({s.score('modality', 'context', 'max_output', 'rate_limit', 'text')}, 6)"},
)
over_models(
    "looks_like_context", lambda: {"ctx": numbers.looks_like_context(F.col("context")), "rate": numbers.looks_like_context(F.col("rate_limit")), "id_": numbers.looks_like_context(F.col("id"))},
    {"ctx": s.looks_ctx("context"), "rate": s.looks_ctx("rate_limit"), "id_": s.looks_ctx("id")},
)
over_models(
    "looks_like_rate_limit", lambda: {"ctx": numbers.looks_like_rate_limit(F.col("context")), "rate": numbers.looks_like_rate_limit(F.col("rate_limit"))},
    {"ctx": s.looks_rl("context"), "rate": s.looks_rl("rate_limit")},
)


@case("modality_from_array", """SELECT event_id, CASE event_type WHEN 'click' THEN 'Text' WHEN 'view' THEN 'Text + Vision' WHEN 'error' THEN 'Audio + Video' END AS modality FROM events""")
def _(spark, sf):
    words = {"click": ["text"], "view": ["image", "text"], "error": ["video", "audio", "file"], "signup": []}
    arr = F.lit(None).cast("array<string>")
    for kind, ws in words.items():
        arr = F.when(F.col("event_type") == kind, F.array(*[F.lit(w) for w in ws]).cast("array<string>")).otherwise(arr)
    return bind.table(spark, sf, "events").select("event_id", facets.modality_from_array(arr).alias("modality"))


@case("fmt_tokens", f"SELECT l_orderkey, l_linenumber, {s.fmt_tokens('n')} AS out, count(*) AS c FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_partkey * 1000 WHEN 1 THEN l_partkey * 1024 WHEN 2 THEN l_partkey * 1000000 ELSE l_partkey * 777 END AS n FROM lineitem) GROUP BY ALL")
def _(spark, sf):
    k, line = F.col("l_partkey"), F.col("l_linenumber") % 4
    n = F.when(line == 0, k * 1000).when(line == 1, k * 1024).when(line == 2, k * 1000000).otherwise(k * 777)
    rows = bind.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.fmt_tokens(n).alias("out"))
    return rows.groupBy("l_orderkey", "l_linenumber", "out").agg(F.count("*").alias("c"))


@case("fmt_context", f"SELECT o_orderkey, {s.fmt_context('n')} AS out FROM (SELECT o_orderkey, o_custkey * o_custkey * 7 AS n FROM orders)")
def _(spark, sf):
    n = F.col("o_custkey") * F.col("o_custkey") * 7
    return bind.table(spark, sf, "orders").select("o_orderkey", numbers.fmt_context(n).alias("out"))


@case("reconcile_more_note", with_views(f"SELECT source, slug, {s.more_note('more_models', '500')} AS note FROM p", "p"))
def _(spark, sf):
    return bind.view(spark, sf, "p").select("source", "slug", numbers.reconcile_more_note(F.col("more_models"), F.lit(500)).alias("note"))


_SHORT = "[" + ", ".join(f"'{m}'" for m in ["Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des"]) + "]"


@case("fmt_date", f"""
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'no date' ELSE day(j) || ' ' || ({_SHORT})[month(j)] || ' ' || year(j) END AS shown
FROM (SELECT event_id, ts, ts + INTERVAL 7 HOUR AS j FROM events)""")
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    odd = F.when(F.col("event_id") % 50 == 0, "no date").otherwise(iso)
    return bind.table(spark, sf, "events").select(
        "event_id", dates.fmt_date(odd, zone="Asia/Jakarta").alias("shown")
    )


@case("iso_day", "SELECT event_id, substr(CAST(ts AS VARCHAR), 1, 10) AS day FROM events")
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return bind.table(spark, sf, "events").select("event_id", dates.iso_day(iso).alias("day"))


@case("rfc822", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%a, %d %b %Y 00:00:00 GMT') AS published FROM orders")
def _(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return bind.table(spark, sf, "orders").select("o_orderkey", dates.rfc822(day).alias("published"))
