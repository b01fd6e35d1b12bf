"""Filters, lookups, orderings and pages over the merged catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind, sqlfn as s
from checks.bind import TEXT, with_views
from checks.registry import case
from weftline.functions import fixed
from weftline.operators import listing, merge, parts, search, shape
from weftline.operators import rollups
from weftline.sources.registry import SourceSpec, union_sources

G_COLS = "slug, name, model_count, array_to_string(modalities, ',') AS modalities, max_context, free_limit"


def shown(df):
    """List columns with the facet array as text, for comparison."""
    return df.select("slug", "name", F.col("model_count").cast("bigint").alias("model_count"), F.array_join("modalities", ",").alias("modalities"), "max_context", "free_limit")


LIST_SQL = """, li AS (SELECT g.*, lower(g.name || ' ' || coalesce(t, '')) AS search_text FROM g LEFT JOIN
  (SELECT slug, string_agg(name || ' ' || id, ' ' ORDER BY pos, id) AS t FROM m GROUP BY slug) x USING (slug))"""


def list_items(spark, sf):
    return search.slim_list(bind.providers(spark, sf))


def text_rows(spark, sf):
    return bind.search_index(spark, sf)


@case("slim_list_projection", with_views(f"""
SELECT {G_COLS}, 0 AS row, lower(name) AS text FROM g
UNION ALL SELECT slug, NULL, NULL, NULL, NULL, NULL, row_number() OVER (PARTITION BY slug ORDER BY pos, id), lower(name || ' ' || id) FROM m WHERE slug IN (SELECT slug FROM g)""", "g", "m"))
def _(spark, sf):
    rows = text_rows(spark, sf).rows
    return shown(list_items(spark, sf)).withColumn("row", F.lit(0).cast("bigint")).join(rows, ["slug", "row"], "right").select(
        "slug", "name", "model_count", "modalities", "max_context", "free_limit", "row", "text")


@case("filter_search_across_models", with_views(LIST_SQL + f""", q AS (SELECT q FROM (SELECT lower(id || ' ' || nx) AS q FROM (
  SELECT slug, pos, id, lead(name) OVER (PARTITION BY slug ORDER BY pos, id) AS nx FROM m) WHERE nx IS NOT NULL ORDER BY slug, pos LIMIT 1))
SELECT {G_COLS} FROM li WHERE contains(search_text, (SELECT q FROM q))""", "g", "m"))
def _(spark, sf):
    """A query that begins in one model's text and ends in the next one's."""
    m = bind.models(spark, sf)
    a, b = m.orderBy("slug", "pos", "id").limit(2).collect()
    return shown(search.filter_list(list_items(spark, sf), text_rows(spark, sf), f"{a['id']} {b['name']}"))


@case("offer_list_projection", with_views("SELECT slug, name, vendor, domain, category, kind, credit_value, array_to_string(facets, ',') AS facets, id_indie, description, search_text FROM offers", "offers"))
def _(spark, sf):
    return search.offer_list(bind.offers(spark, sf)).withColumn("facets", F.array_join("facets", ","))


@case("filter_search_modalities", with_views(LIST_SQL + f" SELECT {G_COLS} FROM li WHERE contains(search_text, '777') AND list_contains(modalities, 'audio') AND list_contains(modalities, 'code')", "g", "m"))
def _(spark, sf):
    return shown(search.filter_list(list_items(spark, sf), text_rows(spark, sf), " 777 ", ["audio", "code"]))


@case("filter_only_free_info", with_views(f"SELECT {G_COLS} FROM g WHERE nullif(free_limit, '') IS NOT NULL", "g"))
def _(spark, sf):
    return shown(search.only_free_info(bind.providers(spark, sf)))


@case("filter_modality_exact", with_views(f"SELECT {G_COLS} FROM g WHERE list_contains(modalities, 'vision')", "g"))
def _(spark, sf):
    return shown(search.filter_modality(bind.providers(spark, sf), " Vision "))


@case("filter_min_context", with_views(f"SELECT {G_COLS} FROM g WHERE {s.parse_ctx('max_context')} >= 50000", "g"))
def _(spark, sf):
    return shown(search.filter_min_context(bind.providers(spark, sf), "50K"))


@case("lookup_by_slug", with_views(f"SELECT {G_COLS} FROM g WHERE slug = 'supplier-7'", "g"))
def _(spark, sf):
    return shown(search.lookup(bind.providers(spark, sf), "supplier-7"))


_MATCH = """, hit AS (SELECT slug, pos, id, name AS model_name FROM m WHERE contains(lower(name), 'gizmo') OR contains(lower(id), 'gizmo')),
ma AS (SELECT g.slug, contains(lower(g.name), 'gizmo') OR contains(g.slug, 'gizmo') AS provider_match, pos, id, model_name FROM g LEFT JOIN hit ON hit.slug = g.slug)"""


@case("search_with_matched_children", with_views(_MATCH + " SELECT * FROM ma WHERE provider_match OR id IS NOT NULL", "g", "m"))
def _(spark, sf):
    return search.search_matches(bind.providers(spark, sf), bind.models(spark, sf), "Gizmo ")


@case("search_result_preview", with_views(_MATCH + """, r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos, id) AS n FROM ma WHERE id IS NOT NULL)
SELECT slug, provider_match, string_agg(CASE WHEN n <= 10 THEN model_name END, ', ' ORDER BY n) AS shown, count(*) AS matched, greatest(count(*) - 10, 0) AS more FROM r GROUP BY slug, provider_match""", "g", "m"))
def _(spark, sf):
    return search.search_preview(search.search_matches(bind.providers(spark, sf), bind.models(spark, sf), "gizmo"))


@case("search_models_in_provider", with_views("SELECT slug, id, name FROM m WHERE slug = 'supplier-3' AND contains(lower(name || ' ' || id), 'ring 1')", "m"))
def _(spark, sf):
    return search.search_models(bind.models(spark, sf), "supplier-3", "Ring 1").select("slug", "id", "name")


_PROJECT_HIT = "(contains(lower(name), 'hot') OR contains(lower(owner), 'hot') OR coalesce(contains(lower(description), 'hot'), false) OR list_contains(list_transform(topics, lambda t: contains(lower(t), 'hot')), true))"


@case("search_projects", with_views(f"SELECT slug, name, language, stars FROM projects WHERE language = '2-HIGH' AND {_PROJECT_HIT}", "projects"))
def _(spark, sf):
    return search.search_projects(bind.projects(spark, sf), "HOT", "2-HIGH").select("slug", "name", "language", "stars")


@case("filter_offers_faceted", with_views("SELECT slug, category, kind FROM offers WHERE category = 'hosting' AND kind = 'trial' AND list_contains(facets, 'permanen') AND contains(full_text, 'gb')", "offers"))
def _(spark, sf):
    return search.filter_offers(bind.offers(spark, sf), "hosting", "trial", ["permanen"], "GB").select("slug", "category", "kind")


@case("eligible_vs_excluded", with_views("SELECT slug, name, base_url, model_count, base_url IS NOT NULL AND model_count > 0 AS eligible FROM g", "g"))
def _(spark, sf):
    return search.eligible_vs_excluded(bind.providers(spark, sf)).withColumn("model_count", F.col("model_count").cast("bigint"))


# Customers with all their orders: some have none.
TEXT["few"] = "SELECT c_name AS slug, count(o_orderkey) AS model_count FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_name"


@case("drop_zero_model_entities", with_views("SELECT slug, model_count, model_count = 0 AS dropped FROM few", "few"))
def _(spark, sf):
    kept, gone = search.drop_zero_model(bind.view(spark, sf, "few"))
    return kept.withColumn("dropped", F.lit(False)).unionByName(gone.select("slug", F.lit(0).cast("bigint").alias("model_count"), F.lit(True).alias("dropped")))


TEXT["odd_names"] = """
SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'Legend' WHEN 1 THEN 'See ' || p_name WHEN 2 THEN 'Many ' || p_name || ' models' WHEN 3 THEN p_name || '-7b models'
  WHEN 4 THEN 'Trial ' || p_name ELSE p_name END AS name FROM {part}"""


@case("reject_junk_names", with_views(f"SELECT k, name FROM odd_names WHERE NOT ({s.is_junk('name')}) AND NOT {s.is_note('name')} AND NOT {s.is_descriptor('name')}", "odd_names"))
def _(spark, sf):
    return search.reject_junk_names(bind.view(spark, sf, "odd_names"))


@case("row_assertions", with_views(f"""
, gm AS (SELECT m.slug, m.id, m.name, c.raw AS modality FROM m JOIN (SELECT slug, id, min_by(coalesce(modality, 'none'), ord) AS raw FROM c GROUP BY slug, id) c ON c.slug = m.slug AND c.id = m.id)
SELECT slug, NULL AS id, 'missing-sources' AS rule, 'error' AS severity FROM g WHERE n_sources < 3
UNION ALL SELECT slug, NULL, 'max-context-sentinel', 'error' FROM g WHERE country IS NULL
UNION ALL SELECT slug, NULL, 'invalid-category', 'error' FROM g WHERE substr(name, -1) = '3'
UNION ALL SELECT slug, NULL, 'incomplete-source-ref', 'error' FROM g WHERE url IS NULL
UNION ALL SELECT slug, id, 'section-descriptor', 'error' FROM gm WHERE contains(name, 'anvil')
UNION ALL SELECT slug, id, 'empty-modality', 'warn' FROM gm WHERE modality = ''""", "g", "m", "c"))
def _(spark, sf):
    """Broken rows are made by value: every rule sees all providers and all models."""
    p = bind.providers(spark, sf)
    p = p.withColumn("max_context", F.when(F.col("country").isNull(), "—").otherwise(F.col("max_context")))
    p = p.withColumn("category", F.when(F.col("name").endswith("3"), "other").otherwise(F.col("category")))
    blank = F.transform("sources", lambda x: F.struct(x["name"].alias("name"), F.lit("").alias("url"), x["synced_at"].alias("synced_at")))
    p = p.withColumn("sources", F.when(F.col("url").isNull(), blank).otherwise(F.col("sources")))
    p = p.withColumn("sources", F.when(F.size("sources") < 3, F.slice("sources", 1, 0)).otherwise(F.col("sources")))
    raw = bind.view(spark, sf, "c").groupBy("slug", "id").agg(F.min_by(F.coalesce("modality", F.lit("none")), "ord").alias("modality"))
    m = bind.models(spark, sf).drop("modality").join(raw, ["slug", "id"])
    m = m.withColumn("name", F.when(F.col("name").contains("anvil"), "Assorted anvil models").otherwise(F.col("name")))
    return shape.row_assertions(p, m)


_ACTIVE = ", ".join(f"CASE WHEN bool_or(nullif({c}, '') IS NOT NULL) THEN '{c}' END" for c in ["context", "max_output", "modality", "rate_limit"])


@case("active_columns", with_views(f"SELECT slug, id, concat_ws(',', {_ACTIVE}) AS columns FROM c GROUP BY slug, id", "c"))
def _(spark, sf):
    rows = bind.view(spark, sf, "c").withColumn("both", F.struct("slug", "id"))
    return rollups.active_columns(rows, "both").select("both.slug", "both.id", F.array_join("columns", ",").alias("columns"))


TEXT["submissions"] = """
SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN ' ' || c_name || '@Mail.example ' WHEN 1 THEN c_name WHEN 2 THEN 'a b@c.d' WHEN 3 THEN c_name || '@x' ELSE lower(c_mktsegment) || '@a.b.c' END AS email,
  CASE WHEN c_custkey % 7 = 0 THEN 'http://spam' WHEN c_custkey % 7 = 1 THEN '  ' END AS website FROM {customer}"""


@case("valid_email_filter", with_views(f"SELECT k, lower(trim(email)) AS email FROM submissions WHERE nullif(trim(website), '') IS NULL AND regexp_matches(lower(trim(email)), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')", "submissions"))
def _(spark, sf):
    return search.valid_submissions(bind.view(spark, sf, "submissions")).select("k", "email")


# Picks: one per order, some of unknown providers.
TEXT["picks"] = "SELECT o_orderkey AS pos, 'supplier-' || (o_custkey % 120) AS slug, o_orderpriority AS model_id FROM {orders}"


@case("chain_resolve", with_views("SELECT pos, slug, g.name, g.base_url, model_id FROM picks JOIN g USING (slug)", "picks", "g"))
def _(spark, sf):
    return search.chain_resolve(bind.view(spark, sf, "picks"), bind.providers(spark, sf))


TEXT["few_picks"] = "SELECT 'supplier-' || s_suppkey AS slug, s_suppkey AS pos FROM {supplier} WHERE s_acctbal >= 0"


@case("chain_candidates", with_views("SELECT slug, name FROM g WHERE slug NOT IN (SELECT slug FROM few_picks)", "few_picks", "g"))
def _(spark, sf):
    return search.chain_candidates(bind.view(spark, sf, "few_picks"), bind.providers(spark, sf)).select("slug", "name")


# --- orderings -------------------------------------------------------------------------------

# Every third supplier goes by the slug of a ranked provider, as far as there are some.
_RANKED = f"list_value({', '.join(chr(39) + x + chr(39) for x in fixed.POPULARITY)})"


@case("sort_popularity", with_views(f"""
, n AS (SELECT CASE WHEN k > 0 AND k % 3 = 0 AND k <= {3 * len(fixed.POPULARITY)} THEN {_RANKED}[k // 3] ELSE slug END AS slug FROM (SELECT slug, CAST(substr(slug, 10) AS BIGINT) AS k FROM g)),
r AS (SELECT slug, coalesce(list_position({_RANKED}, slug) - 1, {fixed.UNRANKED}) AS rank FROM n)
SELECT slug, CAST(rank AS INTEGER) AS rank, row_number() OVER (ORDER BY rank, slug) AS position FROM r""", "g"))
def _(spark, sf):
    k = F.substring("slug", 10, 20).cast("int")
    known = F.try_element_at(F.array(*[F.lit(x) for x in fixed.POPULARITY]), F.when((k > 0) & (k % 3 == 0), (k / 3).cast("int")))
    p = bind.providers(spark, sf).select(F.coalesce(known, "slug").alias("slug"))
    return parts.global_row_number(p, listing.provider_order("popular")).withColumn("rank", listing.popularity_rank(F.col("slug")).cast("int"))


@case("sort_context", with_views(f"SELECT slug, max_context, row_number() OVER (ORDER BY {s.ctx_num('max_context')} DESC, slug) AS position FROM g", "g"))
def _(spark, sf):
    p = bind.providers(spark, sf).select("slug", "max_context")
    return parts.global_row_number(p, listing.provider_order("context"))


@case("sort_models", with_views("SELECT slug, model_count, row_number() OVER (ORDER BY model_count DESC, slug) AS position FROM g", "g"))
def _(spark, sf):
    p = bind.providers(spark, sf).select("slug", F.col("model_count").cast("bigint").alias("model_count"))
    return parts.global_row_number(p, listing.provider_order("models"))


@case("sort_name", with_views("SELECT slug, name, row_number() OVER (ORDER BY lower(name), slug) AS position FROM g", "g"))
def _(spark, sf):
    return parts.global_row_number(bind.providers(spark, sf).select("slug", "name"), listing.provider_order("name"))


@case("list_position", with_views("SELECT slug, id, row_number() OVER (ORDER BY slug, id) AS position FROM m", "m"))
def _(spark, sf):
    return parts.global_row_number(bind.models(spark, sf).select("slug", "id"), [F.col("slug").asc(), F.col("id").asc()])


@case("sort_merged_models", with_views(f"SELECT slug, id, context, name, row_number() OVER (ORDER BY slug, {s.ctx_num('context')} DESC, lower(name), id) AS position FROM m", "m"))
def _(spark, sf):
    m = bind.models(spark, sf).select("slug", "id", "context", "name")
    return parts.global_row_number(m, [F.col("slug").asc(), *listing.model_order()])


@case("sort_projects", with_views("SELECT slug, stars, pushed_at, row_number() OVER (ORDER BY stars DESC, pushed_at DESC, slug) AS position FROM projects", "projects"))
def _(spark, sf):
    p = bind.projects(spark, sf).select("slug", "stars", "pushed_at")
    return parts.global_row_number(p, listing.project_order("batch"))


@case("paginate", with_views("SELECT slug, stars FROM projects ORDER BY stars DESC, slug LIMIT 20 OFFSET 40", "projects"))
def _(spark, sf):
    return listing.listed_page(spark, bind.project_listing(spark, sf), 3, 20)


@case("paginate_unpublished", with_views("SELECT slug, stars FROM projects ORDER BY stars DESC, slug LIMIT 20 OFFSET 40", "projects"))
def _(spark, sf):
    return listing.paginate(bind.projects(spark, sf).select("slug", "stars"), listing.project_order("stars"), 3, 20)


@case("paginate_first_page", with_views("SELECT slug, stars FROM projects ORDER BY stars DESC, slug LIMIT 20", "projects"))
def _(spark, sf):
    return listing.paginate(bind.projects(spark, sf).select("slug", "stars"), listing.project_order("stars"), -3, 20)


@case("paginate_last_page", with_views("SELECT slug, stars FROM projects ORDER BY stars DESC, slug OFFSET (SELECT (CAST(ceil(count(*) / 20) AS BIGINT) - 1) * 20 FROM orders)", "projects"))
def _(spark, sf):
    return listing.listed_page(spark, bind.project_listing(spark, sf), 10**9, 20)


@case("paginate_keyset", with_views("SELECT slug, stars FROM projects WHERE stars < 250000 ORDER BY stars DESC, slug LIMIT 20", "projects"))
def _(spark, sf):
    return listing.page_after(bind.projects(spark, sf).select("slug", "stars"), listing.project_order("stars"), F.col("stars") < 250000, 20)


@case("top_n_with_total", with_views("SELECT slug, model_count, (SELECT count(*) FROM g) AS total FROM g ORDER BY model_count DESC, slug LIMIT 5", "g"))
def _(spark, sf):
    p = bind.providers(spark, sf).select("slug", F.col("model_count").cast("bigint").alias("model_count"))
    return listing.top_n_with_total(p, listing.provider_order("models"))


# --- set operations --------------------------------------------------------------------------


@case("union_sources", with_views("""
SELECT 'src_' || prio AS source, prio, prio * 1099511627776 + pos AS ord, slug, pos, id, name, context, max_output, modality, rate_limit FROM c""", "c"))
def _(spark, sf):
    """The sources one by one, as separate readers deliver them, tagged by their registration."""
    p, c = bind.view(spark, sf, "p"), bind.view(spark, sf, "c").drop("source", "ord")
    specs = [SourceSpec(f"src_{k}", f"https://src-{k}.example.com", k, p.where(F.col("prio") == k), c.where(F.col("prio") == k).drop("prio"), f"2026-01-0{k + 1}T00:00:00.000Z") for k in range(3)]
    return union_sources(specs)[1]


@case("facet_union", with_views(f"SELECT slug, array_to_string({bind._MODS}, ',') AS facets FROM m GROUP BY slug", "m"))
def _(spark, sf):
    from weftline.functions import facets

    return bind.models(spark, sf).groupBy("slug").agg(facets.any_facets(F.col("modality")).alias("f")).select("slug", F.array_join("f", ",").alias("facets"))


@case("dedup_sources", with_views("SELECT slug, string_agg(name || '@' || synced_at, ',' ORDER BY prio) AS sources FROM refs GROUP BY slug", "refs"))
def _(spark, sf):
    refs = merge.source_refs(bind.view(spark, sf, "p"))
    return refs.select("slug", F.array_join(F.transform("sources", lambda r: F.concat(r["name"], F.lit("@"), r["synced_at"])), ",").alias("sources"))
