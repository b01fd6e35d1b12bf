"""Joins, entity resolution, enrichment and the duplicate audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind, sqlfn as s
from checks.bind import RUN_AT, TEXT, with_views
from checks.registry import case
from weftline.functions import text
from weftline.operators import diff, duplicates, enrich, merge, quarantine

# Per-source models whose names and ids differ between sources, so that keys bridge.
TEXT["cx"] = bind.TEXT["c"].replace(
    "CAST(l_partkey AS STRING) AS id, p_name AS name,",
    """CASE WHEN prio = 1 AND l_partkey % 3 = 0 THEN 'vendor/' || l_partkey || ':free' ELSE CAST(l_partkey AS STRING) END AS id,
  CASE WHEN prio = 1 THEN 'Meta: ' || p_name || ' ' || l_partkey || ' (free)' WHEN prio = 2 AND p_size < 6 THEN p_brand || ' ' || p_type
       ELSE p_name || ' ' || (l_partkey - l_partkey % 2) || '-instruct' END AS name,""",
)
assert TEXT["cx"] != TEXT["c"]


@case("join_group_contributors", with_views("SELECT slug, count(*) AS contributors, string_agg(source, ',' ORDER BY prio) AS sources FROM p GROUP BY slug", "p"))
def _(spark, sf):
    p = bind.view(spark, sf, "p").where(text.null_if_empty(F.col("slug")).isNotNull())
    refs = merge.source_refs(p)
    return p.groupBy("slug").agg(F.count("*").alias("contributors")).join(refs, "slug").select(
        "slug", "contributors", F.array_join("sources.name", ",").alias("sources")
    )


@case("semi_authoritative", with_views("""
SELECT slug, id, context FROM m WHERE slug NOT IN ('supplier-1', 'supplier-2', 'supplier-3') OR (slug, id) IN (SELECT (slug, id) FROM c WHERE source = 'src_0')""", "m", "c"))
def _(spark, sf):
    live = bind.view(spark, sf, "c").where("slug IN ('supplier-1', 'supplier-2', 'supplier-3') and source = 'src_0'")
    return merge.keep_authoritative(bind.models(spark, sf).select("slug", "id", "context"), live)


@case("merge_children_dual_key", with_views(f"""
, k AS (SELECT slug, ord, id, name, 'a' || {s.model_key('name')} AS ka, 'b' || {s.slugify('id')} AS kb FROM cx),
pr AS (SELECT DISTINCT slug, ka, kb FROM k),
ed AS (SELECT slug, ka AS x, kb AS y FROM pr UNION SELECT slug, kb, ka FROM pr),
reach(slug, x, root) AS (SELECT DISTINCT slug, x, x FROM ed UNION SELECT r.slug, ed.y, r.root FROM reach r JOIN ed ON ed.slug = r.slug AND ed.x = r.x),
lab AS (SELECT slug, x, min(root) AS comp FROM reach GROUP BY slug, x),
z AS (SELECT k.*, comp FROM k JOIN lab ON lab.slug = k.slug AND lab.x = k.ka)
SELECT slug, min_by(id, ord) AS id, min_by(name, ord) AS name, min(ord) AS ord, count(*) AS members FROM z GROUP BY slug, comp""", "cx", recursive=True))
def _(spark, sf):
    return merge.merge_children(bind.view(spark, sf, "cx")).select("slug", "id", "name", "ord", F.col("members").cast("bigint").alias("members"))


# Values in fold order, said without a fold: two keys are one group from the smallest largest time on a path between them
# (``mm``). A value reaches the oldest key then or at its own time, whichever is later; values that wait for the same pair
# are told apart by when they reached the group that joined over it, and so on inwards (``e``).
@case("merge_children_values", with_views(f"""
, k AS (SELECT *, 'a' || {s.model_key('name')} AS ka, 'b' || {s.slugify('id')} AS kb FROM cx),
pr AS (SELECT slug, ka, kb, min(ord) AS t FROM k GROUP BY ALL),
ed AS (SELECT slug, ka AS x, kb AS y, t FROM pr UNION ALL SELECT slug, kb, ka, t FROM pr),
nd AS (SELECT slug, x, min(t) AS born FROM ed GROUP BY slug, x),
pt(slug, x, y, t) AS (SELECT slug, x, x, -1::BIGINT FROM nd UNION SELECT pt.slug, pt.x, ed.y, greatest(pt.t, ed.t) FROM pt JOIN ed ON ed.slug = pt.slug AND ed.x = pt.y),
mm AS (SELECT pt.slug, pt.x, y, min(t) AS t, min(born) AS born FROM pt JOIN nd ON nd.slug = pt.slug AND nd.x = y GROUP BY pt.slug, pt.x, y),
rt AS (SELECT slug, x, min((born, y)) AS r FROM mm GROUP BY slug, x),
vs AS (SELECT slug, ka, ord, unnest([{{'f': 'context', 'v': context}}, {{'f': 'max_output', 'v': max_output}}, {{'f': 'modality', 'v': modality}}, {{'f': 'rate_limit', 'v': rate_limit}}], recursive := true) FROM k),
go(slug, ka, ord, f, v, r, e, live) AS (
  SELECT vs.slug, ka, ord, f, v, r, CAST([] AS BIGINT[]), true FROM vs JOIN rt ON rt.slug = vs.slug AND rt.x = ka WHERE nullif(v, '') IS NOT NULL
  UNION ALL
  SELECT g.slug, g.ka, g.ord, g.f, g.v, (SELECT min((i.born, i.y)) FROM mm i WHERE i.slug = g.slug AND i.x = g.ka AND i.t < m.t OR i.slug = g.slug AND i.x = g.ka AND i.y = g.ka),
    g.e || [CASE WHEN g.ord >= m.t THEN 2 * g.ord + 1 ELSE 2 * m.t END], g.ord < m.t
  FROM go g JOIN mm m ON m.slug = g.slug AND m.x = g.ka AND m.y = g.r[2] WHERE g.live),
fv AS (SELECT go.slug, rt.r, f, min_by(v, e) AS v FROM go JOIN rt ON rt.slug = go.slug AND rt.x = ka WHERE NOT live GROUP BY go.slug, rt.r, f),
z AS (SELECT k.slug, r, min_by(id, ord) AS id, min_by(name, ord) AS name, min(ord) AS ord, count(*) AS members FROM k JOIN rt ON rt.slug = k.slug AND rt.x = ka GROUP BY k.slug, r),
w AS (SELECT slug, r, max(v) FILTER (WHERE f = 'context') AS c, max(v) FILTER (WHERE f = 'max_output') AS o, max(v) FILTER (WHERE f = 'modality') AS modality, max(v) FILTER (WHERE f = 'rate_limit') AS rate_limit FROM fv GROUP BY slug, r)
SELECT z.slug, ord, members, id, name, CASE WHEN NOT {s.no_token('modality', 'id', 'name')} THEN c END AS context, CASE WHEN NOT {s.no_token('modality', 'id', 'name')} THEN o END AS max_output, modality, rate_limit
FROM z LEFT JOIN w ON w.slug = z.slug AND w.r = z.r""", "cx", recursive=True))
def _(spark, sf):
    return merge.merge_children(bind.view(spark, sf, "cx")).withColumn("members", F.col("members").cast("bigint"))


# Same keys throughout, so that no row bridges and the first stated value decides.
_STAR = f"""
, k AS (SELECT *, {s.model_key('name')} AS ka FROM c),
v AS (SELECT slug, ka, min(ord) AS ord, min_by(id, ord) AS id, min_by(name, ord) AS name, count(*) AS members,
  min_by(context, ord) FILTER (WHERE nullif(context, '') IS NOT NULL) AS ctx, min_by(max_output, ord) FILTER (WHERE nullif(max_output, '') IS NOT NULL) AS mo,
  min_by(modality, ord) FILTER (WHERE nullif(modality, '') IS NOT NULL) AS modality, min_by(rate_limit, ord) FILTER (WHERE nullif(rate_limit, '') IS NOT NULL) AS rate_limit
  FROM k GROUP BY slug, ka),
mm AS (SELECT slug, ord, id, name, members, CASE WHEN NOT {s.no_token('modality', 'id', 'name')} THEN ctx END AS context,
  CASE WHEN NOT {s.no_token('modality', 'id', 'name')} THEN mo END AS max_output, modality, rate_limit FROM v)"""


@case("merge_models", with_views(_STAR + " SELECT * FROM mm", "c"))
def _(spark, sf):
    return merge.merge_children(bind.view(spark, sf, "c")).withColumn("members", F.col("members").cast("bigint"))


@case("merge_entities", with_views(_STAR + f"""
, roll AS (SELECT slug, count(*) AS n, {bind._MODS} AS mods, {s.clean_ctx(f"max_by(context, {s.ctx_num('context')} * 1e15 - ord) FILTER (WHERE {s.ctx_num('context')} > 0)")} AS mc FROM mm GROUP BY slug)
SELECT slug, name, category, country, flag, domain, logo, url, base_url, description, array_to_string(mods, ',') AS modalities, n AS model_count, mc AS max_context,
  free_limit, {s.more_note('(SELECT more_models FROM g0 WHERE g0.slug = g.slug)', 'n')} AS more_models, CAST(n_sources AS INTEGER) AS n_sources, synced_at, source_updated_at
FROM g JOIN roll USING (slug)""", "c", "g", "g0"))
def _(spark, sf):
    models = merge.merge_children(bind.view(spark, sf, "c"))
    return (
        merge.merge_entities(bind.view(spark, sf, "p"), models, RUN_AT)
        .withColumn("modalities", F.array_join("modalities", ","))
        .withColumn("n_sources", F.size("sources")).drop("sources")
    )


# --- enrichment ------------------------------------------------------------------------------

# Lookup entries: unique keys, vendor-prefixed keys and shared names that conflict.
TEXT["lookup_rows"] = """
SELECT p_brand AS provider, CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN 'vendor/' || p_partkey || ':free' ELSE '@' || p_name END AS model_key,
  CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE CAST(p_size * 1024 AS BIGINT) END AS context, CAST(p_size * 500 AS BIGINT) AS output, p_partkey AS k FROM {part}"""


def lookup(spark, sf):
    """The nested two-level map, one row per entry."""
    limit = F.struct(F.struct("context", "output").alias("limit"))
    inner = F.create_map(F.col("model_key"), limit)
    return bind.view(spark, sf, "lookup_rows").select(F.create_map(F.col("provider"), F.struct(inner.alias("models"))).alias("lookup"))


def _index(spark, sf):
    return enrich.build_unique_index(enrich.flatten_lookup(lookup(spark, sf)))


_INDEX = f"""
, ix AS (SELECT key, {s.fmt_tokens('c')} AS context, {s.fmt_tokens('o')} AS output FROM (SELECT {s.norm_key('model_key')} AS key,
  CASE WHEN count(DISTINCT coalesce(context, -1)) = 1 THEN max(context) END AS c, CASE WHEN count(DISTINCT coalesce(output, -1)) = 1 THEN max(output) END AS o FROM lookup_rows GROUP BY 1) WHERE key <> '')"""


@case("build_unique_index", with_views(_INDEX + " SELECT * FROM ix", "lookup_rows"))
def _(spark, sf):
    return _index(spark, sf)


_RESOLVED = _INDEX + f"""
, ky AS (SELECT DISTINCT id, name, unnest({s.candidate_keys('id', 'name')}) AS key FROM (SELECT DISTINCT id, name FROM m WHERE context IS NULL OR max_output IS NULL)),
rs AS (SELECT id, name, CASE WHEN count(DISTINCT context) = 1 THEN max(context) END AS fc, CASE WHEN count(DISTINCT output) = 1 THEN max(output) END AS fo FROM ky JOIN ix USING (key) GROUP BY id, name),
en AS (SELECT slug, m.id, m.name, coalesce(m.context, fc) AS context, coalesce(m.max_output, fo) AS max_output,
  CAST(m.context IS NULL AND fc IS NOT NULL AS INTEGER) + CAST(m.max_output IS NULL AND fo IS NOT NULL AS INTEGER) AS fills FROM m LEFT JOIN rs ON rs.id = m.id AND rs.name = m.name)"""


@case("join_enrich_lookup", with_views(_RESOLVED + " SELECT id, name, fc AS found_context, fo AS found_output FROM rs", "m", "lookup_rows"))
def _(spark, sf):
    gaps = bind.models(spark, sf).where("context is null or max_output is null")
    return enrich.resolve_candidates(gaps, _index(spark, sf))


def _enriched(spark, sf):
    return enrich.enrich_models(bind.models(spark, sf), _index(spark, sf))


@case("enrich_ambiguity_safe", with_views(_RESOLVED + " SELECT * FROM en", "m", "lookup_rows"))
def _(spark, sf):
    return _enriched(spark, sf).select("slug", "id", "name", "context", "max_output", "fills")


@case("enriched_sources", with_views(_RESOLVED + " SELECT g.slug, n_sources + CAST(coalesce(sum(fills) > 0, false) AS INTEGER) AS n_sources FROM g LEFT JOIN en ON en.slug = g.slug GROUP BY g.slug, n_sources", "m", "g", "lookup_rows"))
def _(spark, sf):
    p = enrich.enriched_sources(bind.providers(spark, sf), _enriched(spark, sf), "lookup", "https://lookup.example", RUN_AT)
    return p.select("slug", F.size("sources").cast("bigint").alias("n_sources"))


# --- snapshot joins --------------------------------------------------------------------------


@case("anti_disappeared", with_views("SELECT slug FROM prev_p WHERE slug NOT IN (SELECT slug FROM next_p)", "prev_p", "next_p"))
def _(spark, sf):
    prev, nxt = bind.snapshots(spark, sf)
    return diff.only_in(prev.providers.select("slug"), nxt.providers.select("slug"), ["slug"])


@case("anti_appeared", with_views("SELECT slug FROM next_p WHERE slug NOT IN (SELECT slug FROM prev_p)", "prev_p", "next_p"))
def _(spark, sf):
    prev, nxt = bind.snapshots(spark, sf)
    return diff.only_in(nxt.providers.select("slug"), prev.providers.select("slug"), ["slug"])


@case("join_prev_next_models", with_views("SELECT slug, id, a.context AS old_context, b.context AS new_context, a.rate_limit AS old_rate, b.rate_limit AS new_rate FROM prev_m a JOIN next_m b USING (slug, id)", "prev_m", "next_m"))
def _(spark, sf):
    rows = diff.matched_models(*bind.snapshots(spark, sf))
    return rows.select("slug", "id", F.col("old.context").alias("old_context"), F.col("nxt.context").alias("new_context"),
                       F.col("old.rate_limit").alias("old_rate"), F.col("nxt.rate_limit").alias("new_rate"))


_DELTA = """
, both_p AS (SELECT n.slug, n.name FROM next_p n JOIN prev_p USING (slug)), ad AS (SELECT slug, id, name FROM next_m ANTI JOIN prev_m USING (slug, id)), rm AS (SELECT slug, id, name FROM prev_m ANTI JOIN next_m USING (slug, id))"""


@case("outer_model_delta", with_views(_DELTA + " SELECT 'model_added' AS kind, slug, b.name AS provider, id, ad.name FROM ad JOIN both_p b USING (slug) UNION ALL SELECT 'model_removed', slug, b.name, id, rm.name FROM rm JOIN both_p b USING (slug)", "prev_p", "next_p", "prev_m", "next_m"))
def _(spark, sf):
    from weftline.operators import changelog

    return changelog.changelog_diff(*bind.snapshots(spark, sf)).where("kind like 'model%'")


@case("carry_forward", with_views("""
, h AS (SELECT slug FROM state WHERE kind <> 'churned'), held AS (SELECT slug FROM h WHERE slug IN (SELECT slug FROM prev_p))
SELECT slug, id, context FROM next_m WHERE slug NOT IN (SELECT slug FROM held) UNION ALL SELECT slug, id, context FROM prev_m WHERE slug IN (SELECT slug FROM held)""", "prev_p", "prev_m", "next_m", "state"))
def _(spark, sf):
    prev, nxt = bind.snapshots(spark, sf)
    held = bind.view(spark, sf, "state").where("kind <> 'churned'").select("slug")
    cols = ["slug", "id", "context"]
    return quarantine.carry_forward(nxt.models.select(*cols), prev.models.select(*cols), held)


@case("id_overlap", with_views("SELECT slug, prev_ids, next_ids, kept_ids, round(kept_ids / prev_ids, 9) AS overlap FROM st WHERE in_prev AND in_next", "st"))
def _(spark, sf):
    return diff.id_overlap(diff.provider_stats(*bind.snapshots(spark, sf))).withColumn("overlap", F.round("overlap", 9))


@case("id_difference", with_views("SELECT slug, id FROM next_m EXCEPT SELECT slug, id FROM prev_m", "prev_m", "next_m"))
def _(spark, sf):
    return diff.new_ids(*bind.snapshots(spark, sf))


# --- near duplicates -------------------------------------------------------------------------


def _near(src: str, group: str, k: int) -> str:
    on = f"a.{group} = b.{group} AND " if group else ""
    g = f"{group}, " if group else ""
    ag = f"a.{group}, " if group else ""
    return f"""ks AS (SELECT {g}key, count(*) AS n FROM ({src}) WHERE key <> '' GROUP BY {g}key)
SELECT {g}key, sum(eq)::BIGINT AS equal, count(o)::BIGINT AS containing, sum(p)::BIGINT AS pairs, coalesce(array_to_string(list_sort(list(o) FILTER (WHERE o IS NOT NULL))[1:3], ','), '') AS examples FROM (
  SELECT {g}key, n * (n - 1) / 2 AS eq, NULL AS o, 0 AS p FROM ks WHERE n > 1
  UNION ALL SELECT {ag}b.key, 0, a.key, a.n * b.n FROM ks a JOIN ks b ON {on}a.key <> b.key AND length(b.key) >= {k} AND contains(a.key, b.key)) GROUP BY {g}key"""


TEXT["brandish"] = """
SELECT 'supplier-' || l_suppkey AS slug, CAST(l_partkey AS STRING) AS id, CASE WHEN l_partkey % 3 = 0 THEN p_name || ' ' || p_brand ELSE p_name END AS name
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) l JOIN {part} ON l_partkey = p_partkey"""


@case("theta_near_dup_within", with_views(", " + _near(f"SELECT slug, {s.alnum('name')} AS key FROM brandish", "slug", 8), "brandish"))
def _(spark, sf):
    return duplicates.near_dup_within(bind.view(spark, sf, "brandish"))


TEXT["provider_names"] = "SELECT s_name AS name FROM {supplier} UNION ALL SELECT p_brand || CASE WHEN p_size % 5 = 0 THEN ' ' || p_type ELSE '' END FROM {part} UNION ALL SELECT n_name FROM {nation} UNION ALL SELECT r_name || ' ' || n_name FROM {nation} JOIN {region} ON r_regionkey = n_regionkey"


@case("theta_near_dup_global", with_views(", " + _near(f"SELECT {s.alnum('name')} AS key FROM provider_names", "", 5), "provider_names"))
def _(spark, sf):
    return duplicates.near_dup_global(bind.view(spark, sf, "provider_names"))


def _repeat(src: str, audit: int, slug: str, key: str, tag: str = "") -> str:
    group = "slug, " if slug == "slug" else ""
    label = f"'{tag}' || k" if tag else "k"
    return f"""SELECT {audit} AS audit, true AS hard, {'slug' if slug == 'slug' else 'k'} AS slug, {label if slug == 'slug' else 'NULL'} AS key, count(*) - 1 AS n
FROM (SELECT *, {key} AS k FROM {src}) WHERE k <> '' GROUP BY {group}k HAVING count(*) > 1"""


@case("audit_duplicates", with_views(f"""
, nw AS ({'WITH ' + _near(f"SELECT slug, {s.alnum('name')} AS key FROM brandish", 'slug', 8)}), ng AS ({'WITH ' + _near(f"SELECT {s.alnum('name')} AS key FROM p", '', 5)})
{_repeat('p', 1, '', 'slug')} UNION ALL {_repeat('brandish', 2, 'slug', s.model_key('name'))}
UNION ALL {_repeat('brandish', 3, 'slug', 'lower(trim(name))', 'name:')} UNION ALL {_repeat('brandish', 3, 'slug', 'lower(trim(id))', 'id:')}
UNION ALL SELECT 4, false, slug, key, equal + pairs FROM nw UNION ALL SELECT 5, false, NULL, key, equal + pairs FROM ng
UNION ALL SELECT 6, false, slug, {s.canonical_slug('name')}, 1 FROM p WHERE {s.canonical_slug('name')} <> slug""", "p", "brandish"))
def _(spark, sf):
    return duplicates.audit_duplicates(bind.view(spark, sf, "p"), bind.view(spark, sf, "brandish"))


