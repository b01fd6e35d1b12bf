"""Sources and sinks over documents derived row by row from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import bind, sqlfn as s
from checks.bind import TEXT, with_views
from checks.registry import case
from weftline.operators import changelog, clusters, export, rollups
from weftline.session import scratch_folder
from weftline.sources import html_tables, json_payloads, markdown, projects, snapshots

# One JSON document per part: good, duplicate, note and mistyped models, and broken documents.
TEXT["payloads"] = """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 17 = 0 THEN '[1, 2]' WHEN p_partkey % 19 = 0 THEN '{"items": []}'
  WHEN p_partkey % 23 = 0 THEN '{"providers": []}' ELSE
  '{"lastUpdated": "2026-01-0' || (1 + p_partkey % 9) || '", "providers": [{"name": "' || CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_brand END ||
  '", "country": "", "url": "' || CASE WHEN p_partkey % 2 = 0 THEN 'https://a.example/' ELSE '/rel/' END || p_partkey || '", "models": ' ||
  CASE WHEN p_partkey % 13 = 0 THEN '{"a": 1}' ELSE
  '[{"id": " p-' || p_partkey || ' ", "name": "' || p_name || '", "context": ' || (p_size * 1000) || ', "maxOutput": "' || p_size || 'K", "modality": "Text", "rateLimit": " — "},' ||
  '{"id": "' || CASE WHEN p_partkey % 2 = 0 THEN 'p-' ELSE 'q-' END || p_partkey || '", "name": "second", "context": "N/A", "maxOutput": 0, "modality": "", "rateLimit": {"x": 1}},' ||
  '{"id": null, "name": "+ ' || p_size || ' more"},' || '{"id": 5, "name": ' || CASE WHEN p_partkey % 3 = 0 THEN '"extra"' ELSE 'null' END || ', "context": true}]' END || '}]}' END AS payload
FROM {part}"""
GOOD_DOC = "p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 AND p_partkey % 23 <> 0"


def _payloads(spark, sf):
    return json_payloads.ingest_nested_json(bind.view(spark, sf, "payloads"))


@case("ingest_nested_json", f"""
WITH base AS (SELECT p_partkey AS doc_id, p_partkey % 2 AS odd, p_name, p_size, {s.canonical_slug('p_brand')} AS slug FROM part
  WHERE {GOOD_DOC} AND p_partkey % 11 <> 0),
ms AS (SELECT doc_id, slug, 0 AS pos, 'p-' || doc_id AS id, p_name AS name, CAST(p_size * 1000 AS VARCHAR) AS context, p_size || 'K' AS max_output,
    'Text' AS modality, NULL AS rate_limit FROM base WHERE doc_id % 13 <> 0
  UNION ALL SELECT doc_id, slug, 1, 'q-' || doc_id, 'second', NULL, NULL, NULL, NULL FROM base WHERE doc_id % 13 <> 0 AND odd = 1)
SELECT doc_id, slug, CAST(pos AS INTEGER) AS pos, id, name, context, max_output, modality, rate_limit,
  CASE WHEN doc_id % 13 <> 0 THEN (SELECT p_size || ' more' FROM base b WHERE b.doc_id = ms.doc_id) END AS more_models,
  CASE WHEN doc_id % 2 = 0 THEN 'https://a.example/' || doc_id END AS url FROM ms""")
def _(spark, sf):
    r = _payloads(spark, sf)
    return r.models.join(r.providers.select("doc_id", "entry", "more_models", "url"), ["doc_id", "entry"]).drop("entry")


@case("ingest_json_suffix_filter", f"""
WITH e AS (SELECT event_id, user_id, event_type || '/' || k || CASE WHEN user_id % 2 = 0 THEN ':free' ELSE '' END AS id, event_type, CAST(k AS BIGINT) AS k
  FROM (SELECT *, regexp_extract(props, '[0-9]+', 0) AS k FROM events)),
f AS (SELECT id, min(event_id) AS ord FROM e WHERE user_id % 2 = 0 GROUP BY id)
SELECT f.id, CASE WHEN user_id % 3 = 0 THEN f.id ELSE 'Event ' || event_type END AS name,
  {s.fmt_context('(CASE WHEN user_id % 5 <> 0 THEN k * 10417 END)')} AS context,
  {s.fmt_context('(CASE WHEN user_id % 7 <> 0 THEN k * 512 END)')} AS max_output,
  CASE event_type WHEN 'click' THEN 'Text' WHEN 'view' THEN 'Text + Vision' WHEN 'error' THEN 'Audio + Video' END AS modality,
  NULL AS rate_limit, ord FROM f JOIN e ON e.event_id = f.ord""")
def _(spark, sf):
    return json_payloads.ingest_json_suffix_filter(api_rows(spark, sf)).models


TEXT["api_rows"] = """
SELECT event_id AS ord, '{"id": "' || event_type || '/' || k || CASE WHEN user_id % 2 = 0 THEN ':free' ELSE '' END || '", "name": ' ||
  CASE WHEN user_id % 3 = 0 THEN '{"en": 1}' ELSE '"Event ' || event_type || '"' END || ', "context_length": ' ||
  CASE WHEN user_id % 5 = 0 THEN '"' || k || '"' ELSE CAST(CAST(k AS BIGINT) * 10417 AS STRING) END || ', "architecture": {"input_modalities": ' ||
  CASE event_type WHEN 'click' THEN '["text"]' WHEN 'view' THEN '["image", "text"]' WHEN 'error' THEN '["video", "audio", "file"]' WHEN 'signup' THEN '[]' ELSE '"text"' END ||
  '}, "top_provider": {"max_completion_tokens": ' || CASE WHEN user_id % 7 = 0 THEN 'null' ELSE CAST(CAST(k AS BIGINT) * 512 AS STRING) END || '}}' AS payload
FROM (SELECT *, regexp_extract(props, '[0-9]+', 0) AS k FROM {events}) e"""


def api_rows(spark, sf):
    return bind.view(spark, sf, "api_rows")


# One HTML page per part: columns in two orders, a page without the required column, one without a head.
TEXT["table_pages"] = """
SELECT p_partkey AS page_id, '<html><table class="t">' || CASE p_partkey % 4
  WHEN 0 THEN '<thead><tr><th>Provider</th><th>Model</th><th>Score</th><th class="x">Context</th><th>Modality</th><th>Rate Limit</th></tr></thead>'
  WHEN 1 THEN '<thead><tr><th>Provider</th><th>Model</th><th>Rate&nbsp;Limit</th><th>Max Out</th><th><b>Ctx</b></th></tr></thead>'
  WHEN 2 THEN '<thead><tr><th>Provider</th><th>Model</th><th>Score</th></tr></thead>' ELSE '' END || '<tbody id="b">' ||
  '<tr data-provider="' || p_brand || '" data-modality="text, vision,"><td><a>x</a></td><td><a class="model-link" href="#">' || p_name || ' &amp; co</a> new</td>' ||
  CASE WHEN p_partkey % 4 = 0 THEN '<td>81</td><td class="m">' || p_size || 'K</td><td>t</td><td>' || p_size || ' RPM</td>'
       ELSE '<td>' || p_size || ' RPM</td><td>0</td><td class="m">' || p_size || 'K</td>' END || '</tr>' ||
  '<tr data-provider="' || p_brand || '"><td></td><td>Legend</td><td>1</td><td>2</td><td>3</td></tr><tr><td>no attribute</td><td>row</td></tr>' ||
  '<tr data-provider="' || p_brand || '" data-modality=""><td></td><td> ' || upper(p_name) || ' &amp; CO </td><td>9</td></tr>' ||
  '<tr data-provider="' || p_brand || '" data-modality="audio"><td></td><td><a href="/m">Other ' || p_size || '</a></td>' ||
  CASE WHEN p_partkey % 4 = 0 THEN '<td>7</td><td>0</td><td>t</td><td>See  provider page</td>' ELSE '<td>See provider page</td><td>8K</td><td>—</td>' END ||
  '</tr></tbody></table></html>' AS html FROM {part}"""


@case("html_table_header_map", """
SELECT p_partkey AS page_id, CAST(CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 5 END AS BIGINT) AS context_at, CAST(CASE p_partkey % 4 WHEN 1 THEN 4 END AS BIGINT) AS max_output_at,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 3 END AS BIGINT) AS rate_limit_at,
  CASE p_partkey % 4 WHEN 2 THEN 'no-context-column' WHEN 3 THEN 'no-thead' END AS header_error FROM part""")
def _(spark, sf):
    pages = html_tables.html_table_header_map(bind.view(spark, sf, "table_pages"), html_tables.CATALOGUE_COLUMNS, "context")
    return pages.select("page_id", "context_at", "max_output_at", "rate_limit_at", "header_error")


@case("html_table_rows", f"""
WITH p AS (SELECT *, {s.canonical_slug('p_brand')} AS slug FROM part WHERE p_partkey % 4 < 2)
SELECT p_partkey AS page_id, p_brand AS provider, slug, {s.slugify("p_name || ' & co'")} AS id, 0 AS pos, p_name || ' & co' AS name, p_size || 'K' AS context,
  NULL AS max_output, 'text + vision' AS modality, p_size || ' RPM' AS rate_limit FROM p
UNION ALL SELECT p_partkey, p_brand, slug, 'other-' || p_size, 4, 'Other ' || p_size, NULL, CASE WHEN p_partkey % 4 = 1 THEN '8K' END, 'audio', NULL FROM p""")
def _(spark, sf):
    return html_tables.html_table_rows(bind.view(spark, sf, "table_pages"))


# One two-column table per part, columns swapped on every second one.
TEXT["simple_tables"] = """
SELECT p_partkey AS page_id, '<table><thead><tr>' || CASE WHEN p_partkey % 3 = 0 THEN '<th>MODEL</th>' WHEN p_partkey % 2 = 0 THEN '<th>Model Name</th><th>Model Limits</th>'
    ELSE '<th>Rate Limit</th><th>Model</th>' END || '</tr></thead><tbody>' ||
  CASE WHEN p_partkey % 3 = 0 THEN '<tr><td>' || p_name || '</td></tr>' WHEN p_partkey % 2 = 0 THEN '<tr><td><b>' || p_name || '</b></td><td>' || p_size || ' tokens/minute<br>20   requests/day</td></tr>'
    ELSE '<tr><td>' || p_size || ' tokens/minute<BR/>20 requests/day</td><td>' || p_name || '</td></tr>' END ||
  '<tr><td>Various open models</td><td>Various open models</td></tr></tbody></table>' AS table_html FROM {part}"""


@case("html_table_simple_rows", f"""
SELECT p_partkey AS page_id, 0 AS pos, {s.slugify('p_name')} AS id, p_name AS name,
  CASE WHEN p_partkey % 3 <> 0 THEN p_size || ' tokens/minute, 20 requests/day' END AS rate_limit FROM part""")
def _(spark, sf):
    return html_tables.html_table_simple_rows(bind.view(spark, sf, "simple_tables"), ["page_id"])


# Real list items of the crawled pages, the nearest thing to table rows there.
@case("page_list_items", f"""
WITH items AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li[^>]*>.*?</li>')) AS li FROM pages)
SELECT page_id, {s.text_of('li')} AS name, count(*) AS n FROM items WHERE {s.text_of('li')} <> '' GROUP BY ALL""")
def _(spark, sf):
    from weftline.functions import text

    items = bind.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<li[^>]*>.*?</li>"), F.lit(0))).alias("li"))
    return items.withColumn("name", text.html_text_of(F.col("li"))).where("name <> ''").groupBy("page_id", "name").agg(F.count("*").alias("n"))


# Every paragraph of every document becomes a section.
TEXT["md_docs"] = "SELECT doc_id, replace(text, chr(10), chr(10) || '## ') AS text FROM {documents}"


@case("markdown_sections", with_views("""
, parts AS (SELECT doc_id, unnest(a) AS part, generate_subscripts(a, 1) - 1 AS section FROM (SELECT doc_id, regexp_split_to_array(text, '(?m)^## ') AS a FROM md_docs))
SELECT doc_id, CAST(section AS INTEGER) AS section, CASE WHEN section = 0 THEN '__preamble__' ELSE trim(split_part(part, chr(10), 1)) END AS heading,
  length(CASE WHEN section = 0 THEN part ELSE substr(part, length(split_part(part, chr(10), 1)) + 1) END) AS body_chars FROM parts""", "md_docs"))
def _(spark, sf):
    parts = markdown.markdown_sections(bind.view(spark, sf, "md_docs"), ["doc_id"])
    return parts.select("doc_id", "section", "heading", F.length("body").cast("bigint").alias("body_chars"))


# One catalogue text per part: two provider blocks, one with bullets and one with a table.
TEXT["readmes"] = """
SELECT p_partkey AS doc_id, 'Intro of ' || p_name || chr(10) || chr(10) || '## Free Providers' || chr(10) || 'about' || chr(10) || chr(10) ||
  '### [' || p_brand || '](' || CASE WHEN p_partkey % 2 = 0 THEN 'https://b.example/' ELSE 'ftp://b.example/' END || p_partkey || ')' || chr(10) || chr(10) ||
  '> quote' || chr(10) || 'Models share one quota.' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Runs ' || p_name || ' for all.' || chr(10) END || chr(10) ||
  CASE p_partkey % 4 WHEN 0 THEN '**Limits:** ' || p_size || ' requests/minute<br>50 requests/day' || chr(10) || chr(10)
    WHEN 1 THEN '**Limits:**' || chr(10) || '[' || p_size || ' requests/minute<br>50 requests/day](https://l.example)' || chr(10)
    WHEN 2 THEN '**Limits**: —' || chr(10) || chr(10) ELSE '' END ||
  '- ' || p_name || '-7b' || chr(10) || '  * [' || p_type || ' ' || p_size || '](https://m.example)' || chr(10) || '- Open and proprietary ' || lower(p_type) || ' models' || chr(10) ||
  '- Currently paused' || chr(10) || '- ' || upper(p_name) || '-7B' || chr(10) || chr(10) ||
  '### Mistral (La Plateforme)' || chr(10) || '<table><thead><tr><th>Model Name</th><th>Model Limits</th></tr></thead><tbody><tr><td>' || p_name ||
  '</td><td>' || p_size || ' RPM</td></tr></tbody></table>' || chr(10) || chr(10) || '## Free providers with trial credits' || chr(10) || '### Other' || chr(10) || '- x-1' || chr(10) AS text
FROM {part}"""


def _blocks(spark, sf):
    sections = markdown.markdown_sections(bind.view(spark, sf, "readmes"), ["doc_id"])
    free = markdown.free_sections(sections, ["doc_id"]).select("doc_id", "body")
    return markdown.markdown_blocks(free, ["doc_id"])


_LIMIT = "CASE WHEN p_partkey % 4 < 2 THEN p_size || ' requests/minute, 50 requests/day' END"


@case("markdown_bullets", f"""
SELECT p_partkey AS doc_id, 1 AS block, {s.slugify("p_name || '-7b'")} AS id, p_name || '-7b' AS name, {_LIMIT} AS rate_limit FROM part
UNION ALL SELECT p_partkey, {s.slugify("p_type || ' ' || p_size")}, p_type || ' ' || p_size, {_LIMIT} FROM part
UNION ALL SELECT p_partkey, {s.slugify("p_name || '-7b'")}, upper(p_name) || '-7B', {_LIMIT} FROM part""")
def _(spark, sf):
    blocks = _blocks(spark, sf).withColumn("shared_limit", markdown.labelled_limits(F.col("body")))
    return markdown.markdown_bullets(blocks, ["doc_id"]).drop("pos")


@case("markdown_labelled_block", f"SELECT p_partkey AS doc_id, 1 AS block, {_LIMIT} AS limits FROM part UNION ALL SELECT p_partkey, 2, NULL FROM part")
def _(spark, sf):
    return _blocks(spark, sf).select("doc_id", "block", markdown.labelled_limits(F.col("body")).alias("limits"))


@case("heading_link_split", """
SELECT p_partkey AS doc_id, 1 AS block, p_brand AS name, CASE WHEN p_partkey % 2 = 0 THEN 'https://b.example/' || p_partkey END AS url FROM part
UNION ALL SELECT p_partkey, 2, 'Mistral', NULL FROM part""")
def _(spark, sf):
    h = F.col("heading")
    return _blocks(spark, sf).select("doc_id", "block", markdown.heading_name(h).alias("name"), markdown.heading_url(h).alias("url"))


@case("first_prose_line", f"""
WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
t AS (SELECT doc_id, pos, {s.trim('line')} AS line FROM l),
k AS (SELECT doc_id, min_by(line, pos) AS line FROM t WHERE line <> ''
  AND NOT {s.has('line', rf'(?i)^[*#<|>!-]|^Models{s.W}*share|<br|^Routes{s.W}+to')} GROUP BY doc_id)
SELECT d.doc_id, {s.clean_str('k.line')} AS line FROM documents d LEFT JOIN k USING (doc_id)""")
def _(spark, sf):
    return bind.table(spark, sf, "documents").select("doc_id", markdown.prose_line(F.col("text")).alias("line"))


@case("dispatch_by_format", f"""
SELECT p_partkey AS doc_id, 1 AS block, {s.slugify("p_name || '-7b'")} AS id, p_name || '-7b' AS name, {_LIMIT} AS rate_limit FROM part
UNION ALL SELECT p_partkey, 1, {s.slugify("p_type || ' ' || p_size")}, p_type || ' ' || p_size, {_LIMIT} FROM part
UNION ALL SELECT p_partkey, 2, {s.slugify('p_name')}, p_name, p_size || ' RPM' FROM part""")
def _(spark, sf):
    return markdown.dispatch_by_format(_blocks(spark, sf), ["doc_id", "block"]).drop("pos")


@case("markdown_provider_blocks", f"""
SELECT p_partkey AS doc_id, 1 AS block, {s.canonical_slug('p_brand')} AS slug, p_brand AS name,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://b.example/' || p_partkey END AS url, CASE WHEN p_partkey % 3 <> 0 THEN 'Runs ' || p_name || ' for all.' END AS description FROM part
UNION ALL SELECT p_partkey, 2, 'mistral-ai', 'Mistral', NULL, NULL FROM part""")
def _(spark, sf):
    return markdown.provider_blocks(_blocks(spark, sf), ["doc_id", "block"])


@case("keyed_fanout_coverage", """
WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders), h AS (SELECT k, c_custkey FROM k LEFT JOIN customer ON c_custkey = k AND c_acctbal > 0)
SELECT count(*) AS listed, count(c_custkey) AS matched, count(*) - count(c_custkey) AS skipped, CAST(ceil(count(*) * 0.5) AS BIGINT) AS floor,
  count(c_custkey) >= ceil(count(*) * 0.5) AS ok FROM h""")
def _(spark, sf):
    keys = bind.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    known = bind.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return projects.fanout_coverage(keys, known, "key").withColumn("floor", F.col("floor").cast("bigint"))


@case("keyed_fanout", """
SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)""")
def _(spark, sf):
    keys = bind.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    known = bind.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return projects.keyed_fanout(keys, known, "key")


@case("project_normalise", with_views("SELECT * REPLACE (array_to_string(topics, ',') AS topics) FROM projects", "projects"))
def _(spark, sf):
    return bind.projects(spark, sf).withColumn("topics", F.array_join("topics", ","))


PROVIDER_STATE = "slug string, name string, model_count bigint, max_context string, synced_at string"


def _published(spark, sf):
    """A run written to the shared folder of the session."""
    root = f"{scratch_folder(spark)}/published-{uuid.uuid4().hex}"
    p = bind.providers(spark, sf).select("slug", "name", F.col("model_count").cast("bigint").alias("model_count"), "max_context", "synced_at")
    snapshots.publish_run({"providers": p}, root, "2026-01-02")
    return root


@case("snapshot_read_fail_open", with_views("""
SELECT 'providers' AS table_name, count(*) AS n FROM g UNION ALL SELECT 'missing', 0 UNION ALL SELECT 'damaged', 0""", "g"))
def _(spark, sf):
    root = _published(spark, sf)
    here = snapshots.read_latest(spark, root, "providers", PROVIDER_STATE)
    gone = snapshots.read_latest(spark, root + "-none", "providers", PROVIDER_STATE)
    # One row more than was published, as a file of its own.
    other = _published(spark, sf)
    here.limit(1).write.mode("append").parquet(f"{other}/providers/run_id=2026-01-02")
    harmed = snapshots.read_latest(spark, other, "providers", PROVIDER_STATE)
    def counted(df, name):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
    return counted(here, "providers").unionByName(counted(gone, "missing")).unionByName(counted(harmed, "damaged"))


@case("snapshot_write", with_views("SELECT slug, name, model_count, max_context, synced_at FROM g", "g"))
def _(spark, sf):
    return snapshots.read_latest(spark, _published(spark, sf), "providers", PROVIDER_STATE)


@case("export_flat_models", with_views("""
SELECT g.slug AS provider, g.name AS provider_name, id, m.name, context, max_output, modality, rate_limit FROM m JOIN g ON m.slug = g.slug""", "m", "g"))
def _(spark, sf):
    return export.flat_models(bind.providers(spark, sf), bind.models(spark, sf))


@case("export_nested_catalog", with_views("""
SELECT slug, 0 AS row, CAST(to_json(struct_pack(slug := slug, name := name, category := category, max_context := max_context)) AS VARCHAR) AS json FROM g
UNION ALL SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY ord, id),
  CAST(to_json(struct_pack(id := id, name := name, context := context, max_output := max_output, modality := modality, rate_limit := rate_limit)) AS VARCHAR)
FROM m WHERE slug IN (SELECT slug FROM g)""", "m", "g"))
def _(spark, sf):
    return export.nested_catalog(bind.providers(spark, sf), bind.models(spark, sf))


_HAS = ", ".join(f"bool_or(nullif({c}, '') IS NOT NULL) AS has_{c}" for c, _ in export.OPTIONAL)


def _md_row(first: str, cell) -> str:
    cells = "".join(f" || CASE WHEN has_{c} THEN ' | ' || {cell(c, label)} ELSE '' END" for c, label in export.OPTIONAL)
    return f"'| ' || {first}{cells} || ' |'"


def _esc(x: str) -> str:
    return f"replace(replace({x}, '|', '\\|'), chr(10), ' ')"


@case("export_entity_markdown", with_views(f"""
, fl AS (SELECT slug, {_HAS} FROM m GROUP BY slug), u AS (
SELECT slug, 1 AS block, 0 AS pos, '## ' || name AS line FROM g UNION ALL SELECT slug, 1, 1, '' FROM g
UNION ALL SELECT slug, 2, 0, 'URL: ' || url FROM g WHERE url IS NOT NULL UNION ALL SELECT slug, 2, 1, 'Base URL: ' || base_url FROM g WHERE base_url IS NOT NULL
UNION ALL SELECT slug, 2, 2, '' FROM g WHERE url IS NOT NULL OR base_url IS NOT NULL
UNION ALL SELECT slug, 3, 0, description FROM g WHERE nullif(description, '') IS NOT NULL UNION ALL SELECT slug, 3, 1, '' FROM g WHERE nullif(description, '') IS NOT NULL
UNION ALL SELECT slug, 4, 0, 'Modalitas: ' || array_to_string(modalities, ', ') FROM g WHERE len(modalities) > 0 UNION ALL SELECT slug, 4, 1, '' FROM g WHERE len(modalities) > 0
UNION ALL SELECT slug, 5, 0, 'Gratis: ' || free_limit FROM g WHERE free_limit IS NOT NULL UNION ALL SELECT slug, 5, 1, '' FROM g WHERE free_limit IS NOT NULL
UNION ALL SELECT slug, 6, 0, {_md_row("'Model'", lambda c, l: f"'{l}'")} FROM fl UNION ALL SELECT slug, 6, 1, {_md_row("'---'", lambda c, l: "'---'")} FROM fl
UNION ALL SELECT m.slug, 7, ord, {_md_row(_esc('name'), lambda c, l: _esc(f"coalesce({c}, '-')"))} FROM m JOIN fl ON m.slug = fl.slug
UNION ALL SELECT slug, 8, 0, '' FROM fl
UNION ALL SELECT slug, 9, 0, more_models FROM g WHERE more_models IS NOT NULL UNION ALL SELECT slug, 9, 1, '' FROM g WHERE more_models IS NOT NULL
UNION ALL SELECT slug, 10, 0, 'Sumber:' FROM g UNION ALL SELECT slug, 12, 0, '' FROM g
UNION ALL SELECT slug, 11, prio, '- ' || name || ' (' || url || ') — synced ' || substr(synced_at, 1, 10) FROM refs)
SELECT slug, block, CAST(pos AS BIGINT) AS pos, line FROM u""", "m", "g", "refs"))
def _(spark, sf):
    return export.entity_markdown(bind.providers(spark, sf), bind.models(spark, sf))


@case("export_index_lines", with_views("""
SELECT slug, '- [' || name || '](https://catalogue.example/provider/' || slug || '): ' || model_count || ' model' ||
  CASE WHEN max_context IS NOT NULL THEN ', context maks ' || max_context ELSE '' END || '.' AS line FROM g""", "g"))
def _(spark, sf):
    return export.index_lines(bind.providers(spark, sf), "https://catalogue.example")


@case("export_url_inventory", with_views(f"""
, x AS (SELECT max(synced_at) AS last FROM g), ox AS (SELECT max(checked) AS last FROM offers),
fc AS (SELECT f.facet FROM g, unnest(modalities) AS f(facet) WHERE f.facet <> 'text' GROUP BY f.facet HAVING count(*) >= 3),
ck AS (SELECT DISTINCT {s.cluster_key('name')} AS key, slug FROM m WHERE length({s.cluster_key('name')}) >= 4),
cl AS (SELECT key FROM ck GROUP BY key HAVING count(*) >= 2),
r AS (SELECT '' AS path, 'daily' AS f, 1.0 AS p, last AS t FROM x UNION ALL SELECT '/opensource', 'daily', 0.9, '2026-01-02T00:00:00Z'
UNION ALL SELECT '/provider/' || slug, 'weekly', 0.7, coalesce(source_updated_at, synced_at) FROM g
UNION ALL SELECT '/gratis/' || facet, 'weekly', 0.6, (SELECT last FROM x) FROM fc UNION ALL SELECT '/model/' || key, 'weekly', 0.6, (SELECT last FROM x) FROM cl
UNION ALL SELECT '/changelog', 'daily', 0.5, last FROM x UNION ALL SELECT '/pilih', 'weekly', 0.8, last FROM x UNION ALL SELECT '/fallback', 'weekly', 0.7, last FROM x
UNION ALL SELECT '/modal-gratis', 'weekly', 0.9, last FROM ox UNION ALL SELECT '/modal-gratis/' || slug, 'monthly', 0.6, checked FROM offers)
SELECT 'https://catalogue.example' || path AS url, f AS change_frequency, CAST(p AS DOUBLE) AS priority, t AS last_modified FROM r""", "g", "m", "offers"))
def _(spark, sf):
    p, m = bind.providers(spark, sf), bind.models(spark, sf)
    return export.url_inventory(
        "https://catalogue.example", p, rollups.facet_eligibility(p), clusters.clusters(clusters.keyed_entries(p, m)),
        bind.offers(spark, sf), "2026-01-02T00:00:00Z",
    )


_KIND_COUNTS = ", ".join(f"count_if(kind = '{k}') AS {k}" for k in changelog.KINDS)
_TITLE = """concat_ws(', ', CASE WHEN model_added > 0 THEN model_added || ' model baru' END, CASE WHEN provider_added > 0 THEN provider_added || ' provider baru' END,
  CASE WHEN model_removed > 0 THEN model_removed || ' model hilang' END, CASE WHEN provider_removed > 0 THEN provider_removed || ' provider hilang' END)"""
_LINE = """CASE kind WHEN 'provider_added' THEN 'Provider baru: ' || name WHEN 'provider_removed' THEN 'Provider dihapus: ' || name
  WHEN 'model_added' THEN '+ ' || name || ' di ' || provider ELSE '− ' || name || ' dari ' || provider END"""
_RANK = "CASE kind WHEN 'provider_added' THEN 1 WHEN 'provider_removed' THEN 2 ELSE 3 END"


def _xml(x: str) -> str:
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")]:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@case("export_change_feed", with_views(f"""
, k AS (SELECT date, {_KIND_COUNTS} FROM changes GROUP BY date),
b AS (SELECT date, row_number() OVER (PARTITION BY date ORDER BY {_RANK}, CASE WHEN {_RANK} = 3 THEN slug END NULLS FIRST, kind, slug, id NULLS FIRST, {_LINE}) AS row, {_LINE} AS d FROM changes)
SELECT date, 0 AS row, {_xml(_TITLE)} AS title, strftime(CAST(date AS DATE), '%a, %d %b %Y 00:00:00 GMT') AS pub_date, NULL AS text FROM k
UNION ALL SELECT date, row, NULL, NULL, {_xml('d')} FROM b""", "changes"))
def _(spark, sf):
    return changelog.change_feed(bind.view(spark, sf, "changes"))


@case("list_orphan_files", """
SELECT '/logos/doc-' || doc_id || '.png' AS path, 'doc-' || doc_id AS slug FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    files = bind.table(spark, sf, "documents").select(F.concat(F.lit("/logos/doc-"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    active = bind.table(spark, sf, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"))
    return snapshots.list_orphan_files(files, active)
