"""Counts, facets, first-per-key and best-per-group operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind, sqlfn as s
from checks.bind import with_views
from checks.q_search import LIST_SQL, list_items, text_rows
from checks.registry import case
from weftline.functions import fixed
from weftline.operators import changelog, clusters, listing, merge, quarantine, recommend, rollups, shape

BIG = "bigint"


def as_long(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast(BIG))
    return df


@case("count_entities_children", with_views("SELECT source, providers, models FROM (SELECT source, count(*) AS providers FROM p GROUP BY source) a JOIN (SELECT source, count(*) AS models FROM c GROUP BY source) b USING (source)", "p", "c"))
def _(spark, sf):
    return rollups.count_per_source(bind.view(spark, sf, "p"), bind.view(spark, sf, "c"))


@case("source_contribution_counts", with_views("SELECT name, min(url) AS url, count(*) AS count FROM refs GROUP BY name", "refs"))
def _(spark, sf):
    return rollups.source_contributions(bind.providers(spark, sf))


@case("max_synced_at", with_views("SELECT max(synced_at) AS last_updated FROM g", "g"))
def _(spark, sf):
    return rollups.last_updated(bind.providers(spark, sf))


@case("max_synced_per_entity", with_views("SELECT slug, synced_at FROM g", "g"))
def _(spark, sf):
    return bind.providers(spark, sf).select("slug", "synced_at")


@case("max_checked_at", with_views("SELECT max(checked) AS last_checked FROM offers", "offers"))
def _(spark, sf):
    return rollups.last_checked(bind.offers(spark, sf))


@case("category_counts", with_views("SELECT category, count(*) AS n FROM offers GROUP BY category", "offers"))
def _(spark, sf):
    return rollups.value_counts(bind.offers(spark, sf), "category")


@case("language_frequency", with_views("SELECT language, count(*) AS n FROM projects WHERE language IS NOT NULL GROUP BY language", "projects"))
def _(spark, sf):
    return rollups.value_counts(bind.projects(spark, sf), "language")


_ORD = "list_position([" + ", ".join(f"'{f}'" for f in fixed.MODALITY_ORDER) + "], facet)"


@case("facet_eligibility", with_views(f"SELECT facet, count(*) AS providers, CAST({_ORD} AS BIGINT) AS ord FROM g, unnest(modalities) AS f(facet) WHERE facet <> 'text' GROUP BY facet HAVING count(*) >= 3", "g"))
def _(spark, sf):
    return as_long(rollups.facet_eligibility(bind.providers(spark, sf)), "ord")


@case("facet_page", with_views(f"""
, per AS (SELECT slug, count(*) AS model_count, max_by(context, {s.ctx_num('context')} * 1e15 - ord) FILTER (WHERE {s.ctx_num('context')} > 0) AS max_context FROM m WHERE {s.facet('modality', 'audio')} GROUP BY slug)
SELECT slug, g.name, per.model_count, per.max_context, CAST(sum(per.model_count) OVER () AS BIGINT) AS total_models FROM g JOIN per USING (slug) WHERE list_contains(modalities, 'audio')""", "g", "m"))
def _(spark, sf):
    return rollups.facet_page(bind.providers(spark, sf), bind.models(spark, sf), "audio")


@case("facet_sources_latest", with_views("SELECT r.name, max(r.synced_at) AS synced_at, max(r.url) AS url FROM refs r JOIN g ON g.slug = r.slug WHERE list_contains(modalities, 'code') GROUP BY r.name", "refs", "g"))
def _(spark, sf):
    return rollups.facet_sources_latest(bind.providers(spark, sf), "code")


_AND = ", ".join(f"count_if(list_contains(modalities, '{f}')) AS p_{f}, count_if(list_contains(modalities, '{f}') AND kept) AS n_{f}" for f in fixed.MODALITY_ORDER)
_AND_ROWS = " UNION ALL ".join(f"SELECT '{f}' AS facet, n_{f} AS n FROM a WHERE p_{f} > 0" for f in fixed.MODALITY_ORDER)


@case("facet_counts_and", with_views(LIST_SQL + f""", b AS (SELECT *, contains(search_text, 'widget 11') AND list_contains(modalities, 'audio') AS kept FROM li),
a AS (SELECT {_AND}, count_if(kept AND nullif(free_limit, '') IS NOT NULL) AS n_free FROM b) {_AND_ROWS} UNION ALL SELECT 'free_info', n_free FROM a""", "g", "m"))
def _(spark, sf):
    return rollups.facet_counts_and(list_items(spark, sf), text_rows(spark, sf), "widget 11", ["audio"])


@case("facet_counts_leave_one_out", with_views("""
, b AS (SELECT *, category = 'hosting' AS c_ok, kind = 'trial' AS k_ok, list_contains(facets, 'permanen') AS f_ok, contains(full_text, 'gizmo') AS t_ok FROM offers)
SELECT 'category' AS grp, category AS value, count_if(k_ok AND f_ok AND t_ok) AS n FROM b GROUP BY category
UNION ALL SELECT 'kind', kind, count_if(c_ok AND f_ok AND t_ok) FROM b GROUP BY kind
UNION ALL SELECT 'facet', facet, count_if(c_ok AND k_ok AND f_ok AND t_ok) FROM b, unnest(facets) AS u(facet) GROUP BY facet""", "offers"))
def _(spark, sf):
    return rollups.offer_facet_counts(bind.offers(spark, sf), "hosting", "trial", ["permanen"], "gizmo")


@case("language_counts", with_views("SELECT language, count_if(contains(lower(name), '99') OR contains(lower(owner), '99') OR coalesce(contains(lower(description), '99'), false) OR list_contains(list_transform(topics, lambda t: contains(t, '99')), true)) AS n FROM projects WHERE language IS NOT NULL GROUP BY language", "projects"))
def _(spark, sf):
    return rollups.language_counts(bind.projects(spark, sf), "99")


def _place(group: list[str], col: str) -> str:
    return "list_position([" + ", ".join(f"'{v}'" for v in group) + f"], {col})"


@case("available_options", with_views(f"""
SELECT DISTINCT 'category' AS grp, category AS value, CAST({_place(fixed.OFFER_CATEGORIES, 'category')} AS BIGINT) AS ord FROM offers
UNION ALL SELECT DISTINCT 'kind', kind, {_place(fixed.OFFER_KINDS, 'kind')} FROM offers
UNION ALL SELECT DISTINCT 'facet', facet, {_place(fixed.OFFER_FACETS, 'facet')} FROM offers, unnest(facets) AS u(facet)""", "offers"))
def _(spark, sf):
    return as_long(rollups.available_options(bind.offers(spark, sf)), "ord")


@case("max_context_argmax", with_views("SELECT slug, max_context FROM m_roll", "m_roll"))
def _(spark, sf):
    return rollups.max_context_per_entity(bind.models(spark, sf))


@case("modalities_union", with_views("SELECT slug, array_to_string(modalities, ',') AS modalities FROM m_roll", "m_roll"))
def _(spark, sf):
    return merge.child_rollup(bind.models(spark, sf)).select("slug", F.array_join("modalities", ",").alias("modalities"))


@case("fill_rates", with_views(" UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS filled, count(*) AS total, round(count({f}) / count(*), 9) AS rate FROM c" for f in merge.CHILD_FIELDS), "c"))
def _(spark, sf):
    return rollups.fill_rates(bind.view(spark, sf, "c"), merge.CHILD_FIELDS).withColumn("rate", F.round("rate", 9))


@case("shape_stats", with_views("""
SELECT source, (SELECT count(*) FROM p WHERE p.source = c.source) AS providers, count(*) AS models, count(context) AS with_context, count(max_output) AS with_max_output,
  count(rate_limit) AS with_rate_limit, count(nullif(modality, '')) AS with_modality FROM c GROUP BY source""", "p", "c"))
def _(spark, sf):
    return shape.shape_stats(bind.view(spark, sf, "p"), bind.view(spark, sf, "c"), ["source"])


@case("run_totals", with_views("SELECT count(*) AS providers, CAST(sum(model_count) AS BIGINT) AS models, count(logo) AS with_logo, count_if(n_sources > 1) AS multi_source FROM g", "g"))
def _(spark, sf):
    return rollups.run_totals(bind.providers(spark, sf))


@case("home_totals", with_views("SELECT count(*) AS providers, CAST(sum(model_count) AS BIGINT) AS models FROM g", "g"))
def _(spark, sf):
    return rollups.home_totals(bind.providers(spark, sf))


@case("stars_total", with_views("SELECT count(*) AS projects, CAST(sum(stars) AS BIGINT) AS stars FROM projects", "projects"))
def _(spark, sf):
    return rollups.stars_total(bind.projects(spark, sf))


@case("stars_total_top3", with_views("SELECT full_name, stars, (SELECT CAST(sum(stars) AS BIGINT) FROM projects) AS total_stars FROM projects ORDER BY stars DESC, pushed_at DESC, slug LIMIT 3", "projects"))
def _(spark, sf):
    p = bind.projects(spark, sf)
    total = rollups.stars_total(p).select("stars").scalar()
    return p.orderBy(*listing.project_order("batch")).limit(3).select("full_name", "stars", total.alias("total_stars"))


_COUNTS = ", ".join(f"count_if(kind = '{k}') AS {k}" for k in changelog.KINDS)


@case("change_counts", with_views(f"SELECT date, {_COUNTS} FROM changes GROUP BY date", "changes"))
def _(spark, sf):
    return changelog.change_counts(bind.view(spark, sf, "changes"))


_ENTRY = f"""
, k AS (SELECT {s.cluster_key('name')} AS key, * FROM m), e AS (SELECT key, slug, arg_min(struct_pack(id := id, name := name, context := context, max_output := max_output, rate_limit := rate_limit, modality := modality), ord) AS x
  FROM k WHERE length(key) >= 4 GROUP BY key, slug),
en AS (SELECT key, e.slug, x.id, x.name, x.context, x.max_output, x.rate_limit, x.modality, g.name AS provider, 'src_0' AS source FROM e JOIN g ON g.slug = e.slug WHERE g.n_sources > 0),
nm AS (SELECT key, name, count(*) AS n FROM en GROUP BY key, name),
cl AS (SELECT key, first(name ORDER BY n DESC, (contains(name, '/') OR starts_with(name, '@')), name) AS display_name, CAST(sum(n) AS BIGINT) AS entries FROM nm GROUP BY key)"""


def _entries(spark, sf):
    return clusters.keyed_entries(bind.providers(spark, sf), bind.models(spark, sf))


@case("mode_name", with_views(_ENTRY + " SELECT key, display_name FROM cl", "m", "g"))
def _(spark, sf):
    return clusters.cluster_names(_entries(spark, sf)).select("key", "display_name")


@case("first_per_provider_key", with_views(_ENTRY + " SELECT * FROM en", "m", "g"))
def _(spark, sf):
    return _entries(spark, sf)


@case("cluster_cross_entity", with_views(_ENTRY + " SELECT en.*, display_name, entries, row_number() OVER (PARTITION BY key ORDER BY provider, slug) AS place FROM en JOIN cl USING (key) WHERE entries >= 2", "m", "g"))
def _(spark, sf):
    return clusters.cluster_entries(_entries(spark, sf))


@case("sort_clusters", with_views(_ENTRY + " SELECT key, entries, row_number() OVER (ORDER BY entries DESC, key) AS position FROM cl WHERE entries >= 2", "m", "g"))
def _(spark, sf):
    from weftline.operators import parts

    return parts.global_row_number(clusters.clusters(_entries(spark, sf)).select("key", "entries"), clusters.cluster_order())


@case("cluster_membership", with_views(_ENTRY + " SELECT en.key, en.name, entries AS providers FROM en JOIN cl USING (key) WHERE en.slug = 'supplier-5' AND entries >= 2", "m", "g"))
def _(spark, sf):
    return clusters.membership(_entries(spark, sf), "supplier-5")


@case("dedup_first_wins", with_views("SELECT slug, id, min(ord) AS ord, min_by(source, ord) AS source, arg_min(coalesce(context, ''), ord) AS context FROM c GROUP BY slug, id", "c"))
def _(spark, sf):
    c = bind.view(spark, sf, "c").withColumn("context", F.coalesce("context", F.lit("")))
    return merge.dedup_first(c, ["slug", "id"], F.col("ord"), ["ord", "source", "context"])


def _best_sql(wanted: str, floor: int) -> str:
    sc = s.score("modality", "context", "max_output", "rate_limit", wanted)
    return f""", ok AS (SELECT *, {sc} AS score FROM m WHERE (nullif(modality, '') IS NULL OR {s.facet('modality', wanted)}) AND nullif(context, '') IS NOT NULL AND {s.ctx_num('context')} >= {floor}),
rk AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score DESC, ord) AS n FROM ok), bst AS (SELECT * FROM rk WHERE n = 1)"""


BEST = recommend.Criteria("text", 8000)


@case("best_per_group", with_views(_best_sql("text", 8000) + " SELECT slug, ord, id, name, context, max_output, modality, rate_limit, round(score, 6) AS score FROM bst", "m"))
def _(spark, sf):
    return recommend.best_per_provider(bind.models(spark, sf), BEST).withColumn("score", F.round("score", 6))


@case("recommend_top_matches", with_views(_best_sql("audio", 32000) + """
SELECT bst.slug, id, g.name AS provider, round(score, 6) AS score, (SELECT count(*) FROM bst b JOIN g ON g.slug = b.slug WHERE list_contains(g.modalities, 'audio')) AS total
FROM bst JOIN g ON g.slug = bst.slug WHERE list_contains(g.modalities, 'audio') ORDER BY score DESC, bst.slug LIMIT 5""", "m", "g"))
def _(spark, sf):
    rows = recommend.matches(bind.providers(spark, sf), bind.models(spark, sf), recommend.Criteria("audio", 32000))
    rows = rows.select("slug", "id", "provider", F.round("score", 6).alias("score"))
    return listing.top_n_with_total(rows, [F.col("score").desc(), F.col("slug").asc()])


@case("explain_match", with_views(_best_sql("text", 8000) + f"""
SELECT slug, concat_ws('|', CASE WHEN nullif(modality, '') IS NOT NULL THEN 'Modality cocok — sumber tulis "' || modality || '" buat model ini.' END,
  'Context window ' || context || ' — memenuhi minimum ≥ 8K yang kamu pilih.',
  CASE WHEN {s.rl_unlimited('rate_limit')} THEN 'Rate limit: "' || rate_limit || '" — sumber sebut ga ada batas ketat.' WHEN rate_limit IS NOT NULL THEN 'Rate limit: ' || rate_limit || '.' END) AS reasons,
  concat_ws('|', CASE WHEN rate_limit IS NULL THEN 'Rate limit: sumber tidak menyebutkan.' END, CASE WHEN max_output IS NULL THEN 'Max output: sumber tidak menyebutkan.' END,
  CASE WHEN rate_limit IS NOT NULL AND NOT {s.rl_unlimited('rate_limit')} AND {s.rl_day('rate_limit')} IS NULL THEN 'Rate limit ditulis dalam bentuk non-standar — ga bisa dibandingin ke provider lain secara angka.' END) AS tradeoffs
FROM bst""", "m"))
def _(spark, sf):
    best = recommend.explain(recommend.best_per_provider(bind.models(spark, sf), BEST), BEST)
    return best.select("slug", F.array_join("reasons", "|").alias("reasons"), F.array_join("tradeoffs", "|").alias("tradeoffs"))


_FIRST = ", ".join(f"min_by({f}, ord) FILTER (WHERE nullif({f}, '') IS NOT NULL) AS {f}" for f in merge.CHILD_FIELDS)


@case("priority_first_non_null", with_views(f"SELECT slug, id, {_FIRST} FROM c GROUP BY slug, id", "c"))
def _(spark, sf):
    return merge.gap_fill(bind.view(spark, sf, "c"), ["slug", "id"], merge.CHILD_FIELDS, F.col("ord"))


@case("streak", with_views("""
, w AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY day) AS pk, lag(n) OVER (PARTITION BY user_id ORDER BY day) AS pn FROM runs),
i AS (SELECT *, sum(CASE WHEN coalesce(kind = pk AND abs(n - pn) / greatest(abs(pn), 1) <= 0.15, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day) AS island FROM w)
SELECT user_id, day, kind, n, row_number() OVER (PARTITION BY user_id, island ORDER BY day) AS streak FROM i""", "runs"))
def _(spark, sf):
    runs = bind.view(spark, sf, "runs").select("user_id", "day", "kind", "n")
    return quarantine.streaks(runs, "user_id", "day", "kind", "n")


@case("retain_latest_n", with_views("SELECT date, count(*) AS n FROM changes WHERE date IN (SELECT DISTINCT date FROM changes ORDER BY date DESC LIMIT 60) GROUP BY date", "changes"))
def _(spark, sf):
    return changelog.retain_latest(bind.view(spark, sf, "changes")).groupBy("date").agg(F.count("*").alias("n"))


@case("group_samples", with_views(f"""
, bad AS (SELECT source, slug, ord, rate_limit AS value FROM c WHERE nullif(rate_limit, '') IS NOT NULL AND {s.bare_size('rate_limit')}
  UNION ALL SELECT source, slug, ord, 'm:' || modality FROM c WHERE nullif(modality, '') IS NOT NULL AND len({s.facet_list(lambda f: s.facet('modality', f))}) = 0),
ct AS (SELECT source, slug, ord, context FROM c WHERE length(context) > 2 AND NOT {s.looks_ctx("replace(context, 'K', '')")}),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slug, ord) AS n FROM ct)
SELECT source, 'context-shape' AS rule, 'context' AS field, string_agg(replace(context, 'K', ''), ',' ORDER BY n) AS samples FROM r WHERE n <= 3 GROUP BY source""", "c"))
def _(spark, sf):
    """A column of bare numbers, as when a score column is read as context; one-digit sizes are left as they were."""
    c = bind.view(spark, sf, "c")
    broken = c.withColumn("context", F.when(F.length("context") > 2, F.replace("context", F.lit("K"), F.lit(""))).otherwise(F.col("context")))
    samples = shape.shape_samples(broken, ["source"])
    return samples.where("rule = 'context-shape'").select("source", "rule", "field", F.array_join("samples", ",").alias("samples"))
