"""Views that read the driver tables as catalogue data.

``TEXT`` holds view definitions both engines run as they stand; they only rename and derive columns,
over all rows. Merged views are built by the library here and by plain SQL in ``MERGED``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqlfn as s
from weftline.functions import fixed
from weftline.operators import listing, merge, search
from weftline.operators.diff import Snapshot
from weftline.session import scratch_folder

RUN_AT = "2026-01-02T12:00:00.000Z"
PRIO = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"

TEXT: dict[str, str] = {}

# Models per source: provider = supplier, model = part, source = return flag.
TEXT["c"] = f"""
SELECT 'src_' || prio AS source, prio, 'supplier-' || l_suppkey AS slug, l_partkey AS pos,
  prio * 1000000000000 + l_partkey AS ord, CAST(l_partkey AS STRING) AS id, p_name AS name,
  CASE WHEN (l_partkey + prio) % 3 = 0 THEN NULL ELSE p_size || 'K' END AS context,
  CASE WHEN (l_partkey + 2 * prio) % 4 = 1 THEN NULL ELSE (p_size % 16 + 1) || 'K' END AS max_output,
  CASE WHEN (l_partkey + prio) % 4 = 0 THEN NULL
       WHEN p_type = 'ECONOMY' THEN 'Text' WHEN p_type = 'SMALL' THEN 'Text + Vision'
       WHEN p_type = 'MEDIUM' THEN 'Audio' WHEN p_type = 'PROMO' THEN 'Text + Code'
       WHEN p_type = 'STANDARD' THEN 'Embeddings' ELSE '' END AS modality,
  CASE WHEN (l_partkey + prio) % 5 = 0 THEN 'Unlimited' WHEN prio = 1 THEN NULL
       WHEN l_partkey % 7 = 0 THEN (p_size * 100) || ' requests/day, ' || p_size || ' RPM'
       WHEN l_partkey % 11 = 0 THEN 'fair use' ELSE p_size || ' RPM' END AS rate_limit
FROM (SELECT DISTINCT l_suppkey, l_partkey, {PRIO} AS prio FROM {{lineitem}}) l JOIN {{part}} ON l_partkey = p_partkey"""

# Providers per source.
TEXT["p"] = f"""
SELECT 'src_' || prio AS source, 'https://src-' || prio || '.example.com' AS source_url, prio, l_suppkey AS pos,
  'supplier-' || l_suppkey AS slug, CASE WHEN prio = 1 THEN s_name || ' Cloud' ELSE s_name END AS name,
  CASE WHEN prio = 1 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'provider_api' WHEN l_suppkey % 3 = 1 THEN 'inference_provider' END AS category,
  CASE WHEN (l_suppkey + prio) % 3 = 0 THEN NULL ELSE n_name END AS country,
  CASE WHEN (l_suppkey + prio) % 4 = 0 THEN '' ELSE substr(n_name, 1, 2) END AS flag,
  CASE WHEN (l_suppkey + prio) % 5 = 0 THEN NULL WHEN (l_suppkey + prio) % 5 = 1 THEN '/relative/' || l_suppkey
       ELSE 'https://www.' || lower(replace(s_name, '#', '-')) || '.example.co.id/keys' END AS url,
  CASE WHEN (l_suppkey + prio) % 2 = 0 OR l_suppkey % 10 = 3 THEN NULL ELSE 'https://api.supplier-' || l_suppkey || '.example.com/v1' END AS base_url,
  CASE (l_suppkey + prio) % 7 WHEN 0 THEN '' WHEN 1 THEN '$' || l_suppkey || ' one-time trial credit'
       WHEN 2 THEN 'About ' || l_suppkey || ' requests/day via [docs](https://docs.example.com)'
       WHEN 3 THEN '~' || l_suppkey || 'M tokens / month, see `plan`' WHEN 4 THEN 'Permanent free tier &amp; no card'
       WHEN 5 THEN '$' || l_suppkey || '.50 every month' END AS description,
  CASE WHEN prio = 0 AND l_suppkey % 2 = 0 THEN NULL ELSE substr(CAST(last_ship AS STRING), 1, 10) || 'T00:00:00.000Z' END AS source_updated_at,
  CASE WHEN prio = 1 THEN '+' || (l_suppkey * 10) || ' more models' WHEN prio = 2 THEN 'and several others' END AS more_models,
  '2026-01-0' || (prio + 1) || 'T00:00:00.000Z' AS synced_at
FROM (SELECT l_suppkey, {PRIO} AS prio, max(l_shipdate) AS last_ship FROM {{lineitem}} GROUP BY 1, 2) l
JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey"""

# Names in several spellings, from every part, customer and supplier.
_SPELLINGS = [
    "p_name", "'Meta: ' || p_name || ' (free)'", "'@cf/meta/' || p_name || '-instruct'", "p_brand || '/' || p_name || ':free'",
    "'  OpenAI ' || p_name || ' ' || p_size || 'B Chat '", "p_type || ' [' || p_name || '](https://x.example/' || p_partkey || ') `code`'",
]
TEXT["names"] = " UNION ALL ".join(
    f"SELECT 'part' AS kind, p_partkey AS k, {v} AS v, {name} AS name, "
    + ("p_brand || '/' || p_partkey" if v == 0 else "'m-' || p_partkey || ':free'") + " AS id FROM {part}"
    for v, name in enumerate(_SPELLINGS)
) + """ UNION ALL SELECT 'customer', c_custkey, 0, c_name, c_mktsegment || '/' || c_custkey FROM {customer}
UNION ALL SELECT 'supplier', s_suppkey, 0, s_name || ' (La Plateforme)', lower(s_name) || '.example.ai' FROM {supplier}"""

# Offers: one per part.
TEXT["offers_flat"] = """
SELECT 'offer-' || p_partkey AS slug, p_name AS name, p_brand AS vendor, lower(replace(p_brand, '#', '')) || '.example.com' AS domain,
  CASE p_type WHEN 'ECONOMY' THEN 'hosting' WHEN 'SMALL' THEN 'database' WHEN 'MEDIUM' THEN 'storage' WHEN 'PROMO' THEN 'email'
    WHEN 'STANDARD' THEN 'auth' ELSE 'devtool' END AS category,
  CASE p_size % 4 WHEN 0 THEN 'free_tier' WHEN 1 THEN 'credit' WHEN 2 THEN 'trial' ELSE 'program' END AS kind,
  'https://offers.example.com/' || p_partkey AS url, 'Offer of ' || p_brand || ' for ' || p_name AS description,
  p_size || ' GB' AS limit_1, (p_partkey % 9) || ' users' AS limit_2,
  CASE WHEN p_size % 4 = 1 THEN '$' || p_size ELSE NULL END AS credit_value,
  CASE WHEN p_partkey % 2 = 0 THEN 'permanen' END AS facet_1, CASE WHEN p_partkey % 3 = 0 THEN 'tanpa_kartu' END AS facet_2,
  CASE WHEN p_partkey % 5 = 0 THEN 'mahasiswa' END AS facet_3,
  CASE p_partkey % 3 WHEN 0 THEN 'bisa' WHEN 1 THEN 'tidak' ELSE 'belum_jelas' END AS id_indie,
  '2026-0' || (1 + p_size % 9) || '-1' || (p_partkey % 10) AS checked_1, '2025-0' || (1 + p_partkey % 9) || '-2' || (p_size % 9) AS checked_2
FROM {part}"""

# Projects: one per order.
TEXT["projects_flat"] = """
SELECT 'Own' || o_custkey || '/Order-' || o_orderkey AS full_name, 'Order-' || o_orderkey AS name, c_name AS owner, o_custkey AS owner_key,
  CASE WHEN o_orderkey % 3 = 0 THEN '  ' WHEN o_orderkey % 3 = 1 THEN NULL ELSE ' https://p.example/' || o_orderkey || ' ' END AS homepage,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Made for ' || c_mktsegment || ' ' END AS description,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS language,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS stars, o_custkey AS forks,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey END AS open_issues,
  CASE o_orderstatus WHEN 'F' THEN 'MIT' WHEN 'O' THEN 'NOASSERTION' ELSE '' END AS license,
  p_name AS topic_text, CAST(o_orderstatus AS STRING) = 'P' AS archived,
  substr(CAST(o_orderdate AS STRING), 1, 10) || 'T00:00:00Z' AS pushed_at, CAST(NULL AS STRING) AS created_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey LEFT JOIN {part} ON p_partkey = o_custkey"""

# Two snapshots of the whole catalogue. The next one renames, shrinks, re-keys and edits by value.
NEXT_SLUG = "CASE WHEN l_suppkey % 20 = 4 THEN 'supplier-new-' || l_suppkey ELSE 'supplier-' || l_suppkey END"
NEXT_ID = """CASE WHEN l_suppkey % 20 = 2 THEN l_partkey % 50 WHEN l_suppkey % 20 = 7 THEN l_partkey + 1000000000
  WHEN l_partkey % 50 = 1 THEN l_partkey + 500000000 ELSE l_partkey END"""


def _snapshot_models(slug: str, ident: str, edit: bool) -> str:
    grow = "CASE WHEN p_partkey % 5 < 2 THEN 1 ELSE 0 END" if edit else "0"
    mod = "CASE WHEN p_partkey % 5 = 4 THEN 'Text + Audio' ELSE 'Text' END" if edit else "'Text'"
    rate = "CASE WHEN p_partkey % 10 = 3 THEN 'fair use' ELSE p_size || ' RPM' END" if edit else "p_size || ' RPM'"
    return f"""
SELECT slug, id, min(pos) AS pos, min_by(name, pos) AS name, min_by(context, pos) AS context, min_by(max_output, pos) AS max_output,
  min_by(modality, pos) AS modality, min_by(rate_limit, pos) AS rate_limit
FROM (SELECT {slug} AS slug, CAST({ident} AS STRING) AS id, l_partkey AS pos, p_name AS name, (p_size + {grow}) || 'K' AS context,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size || 'K' END AS max_output, {mod} AS modality, {rate} AS rate_limit
  FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey) x GROUP BY slug, id"""


def _snapshot_providers(slug: str, edit: bool) -> str:
    text = "CASE WHEN l_suppkey % 5 < 2 THEN 'New text ' ELSE 'Text ' END" if edit else "'Text '"
    return f"""
SELECT {slug} AS slug, s_name AS name, {text} || l_suppkey AS description, 'https://api-' || l_suppkey || '.example.com' AS base_url,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey || ' RPM/IP' END AS free_limit, max(p_size) || 'K' AS max_context
FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{part}} ON l_partkey = p_partkey GROUP BY l_suppkey, s_name"""


TEXT["prev_m"] = _snapshot_models("'supplier-' || l_suppkey", "l_partkey", False)
TEXT["next_m"] = _snapshot_models(NEXT_SLUG, NEXT_ID, True)
TEXT["prev_p"] = _snapshot_providers("'supplier-' || l_suppkey", False)
TEXT["next_p"] = _snapshot_providers(NEXT_SLUG, True)

# Quarantine entries of every supplier.
TEXT["state"] = """
SELECT 'supplier-' || s_suppkey AS slug, CASE s_suppkey % 20 WHEN 4 THEN 'disappeared' WHEN 2 THEN 'shrunk' ELSE 'churned' END AS kind,
  CAST(CASE WHEN s_suppkey % 40 = 4 THEN 0 WHEN s_suppkey % 40 = 2 THEN 50 ELSE 500 END AS BIGINT) AS magnitude,
  'seen before' AS detail, CAST(1 + s_suppkey % 3 % 2 AS INT) AS streak,
  '2026-01-0' || (1 + s_suppkey % 5) || 'T00:00:00.000Z' AS first_seen, '2026-01-05T00:00:00.000Z' AS last_seen
FROM {supplier}"""

# Change log: one change per line item, dated by its shipping day.
TEXT["changes"] = """
SELECT DISTINCT substr(CAST(l_shipdate AS STRING), 1, 10) AS date,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'provider_added' WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'provider_removed'
    WHEN l_linestatus = 'O' THEN 'model_added' ELSE 'model_removed' END AS kind,
  'supplier-' || l_suppkey AS slug, 'Supplier <' || l_suppkey || '> & co' AS provider, CAST(l_partkey AS STRING) AS id,
  CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'N' THEN 'Supplier <' || l_suppkey || '> & co' ELSE 'part "' || l_partkey || '"' END AS name
FROM {lineitem}"""

# Events per user and day: a drop of more than 40 % from at least 3 is an anomaly.
TEXT["runs"] = """
SELECT user_id, day, n, before, CASE WHEN before >= 3 AND (before - n) * 100 > 40 * before THEN 'shrunk' END AS kind
FROM (SELECT user_id, day, n, lag(n) OVER (PARTITION BY user_id ORDER BY day) AS before
  FROM (SELECT user_id, substr(CAST(ts AS STRING), 1, 10) AS day, count(*) AS n FROM {events} GROUP BY 1, 2) d) e"""


def spark_text(text: str, sf: str) -> str:
    """Tables by their files; ``{{name}}`` stays as a place for a frame."""
    return re.sub(r"\{\{(\w+)\}\}|\{(\w+)\}", lambda m: f"{{{m[1]}}}" if m[1] else f"parquet.`{sf}/{m[2]}.parquet`", text)


def duck_text(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


#: Joined tables of more rows are not broadcast: in memory a row takes 50 to 100 bytes, in its file less than a tenth of that.
BROADCAST_ROWS = 500_000
_ROWS: dict[tuple[str, str], int] = {}


def _joined(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table that a view joins. Spark would broadcast it by the size of its compressed files; what counts is its rows."""
    key, df = (spark.sparkContext.applicationId, f"{sf}/{name}"), table(spark, sf, name)
    if key not in _ROWS:
        _ROWS[key] = df.count()
    return df.hint("merge") if _ROWS[key] > BROADCAST_ROWS else df


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    text = TEXT[name]
    joined = {t: _joined(spark, sf, t) for t in sorted(set(re.findall(r"JOIN \{(\w+)\}", text)))}
    return spark.sql(spark_text(re.sub(r"JOIN \{(\w+)\}", r"JOIN {{\1}}", text), sf), **joined)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- merged views, library side -------------------------------------------------------------


_PUBLISHED: dict[tuple[str, str], str] = {}


def _merge_models(spark: SparkSession, sf: str) -> DataFrame:
    """Models merged by id: the plain gap fill, without name keys."""
    # A model has a row for each source at most: rows are dealt out as they are and sorted once.
    c = view(spark, sf, "c").repartition("slug", "id")
    aggs = [merge.priority_first(F.col(f), F.col("ord")).alias(f) for f in ["name", *merge.CHILD_FIELDS]]
    return c.groupBy("slug", "id").agg(F.min("ord").alias("ord"), F.min("pos").alias("pos"), *aggs)


def published(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The catalogue as queries meet it: merged once per session and scale, then read as a table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PUBLISHED:
        root = f"{scratch_folder(spark)}/catalogue-{uuid.uuid4().hex}"
        _merge_models(spark, sf).write.parquet(f"{root}/models")
        merged = merge.merge_entities(view(spark, sf, "p"), spark.read.parquet(f"{root}/models"), RUN_AT)
        merged.write.parquet(f"{root}/providers")
        _PUBLISHED[key] = root
    return spark.read.parquet(f"{_PUBLISHED[key]}/{name}")


_INDEXED: dict[str, str] = {}


def _once(spark: SparkSession, sf: str, name: str, write) -> str:
    """Folder that a publishing step writes at its first use in a session and scale."""
    published(spark, sf, "providers")
    root = f"{_PUBLISHED[spark.sparkContext.applicationId, sf]}/{name}"
    if root not in _INDEXED:
        write(root)
        _INDEXED[root] = root
    return root


def search_index(spark: SparkSession, sf: str) -> search.SearchIndex:
    """The search index as it is published beside the catalogue."""
    return search.read_index(spark, _once(spark, sf, "search", lambda root: search.publish_index(providers(spark, sf), models(spark, sf), root)))


def project_listing(spark: SparkSession, sf: str) -> str:
    """The projects by stars, published as a listing."""
    return _once(spark, sf, "listing", lambda root: listing.publish_listing(projects(spark, sf).select("slug", "stars"), listing.project_order("stars"), root))


def models(spark: SparkSession, sf: str) -> DataFrame:
    return published(spark, sf, "models")


def providers(spark: SparkSession, sf: str) -> DataFrame:
    return published(spark, sf, "providers")


def offers(spark: SparkSession, sf: str) -> DataFrame:
    o = view(spark, sf, "offers_flat")
    refs = [F.struct(F.lit(f"page {i}").alias("name"), F.concat("url", F.lit(f"/{i}")).alias("url"), F.col(f"checked_{i}").alias("checked_at")) for i in (1, 2)]
    return o.withColumn("facets", F.array_compact(F.array("facet_1", "facet_2", "facet_3"))).withColumn(
        "limits", F.array("limit_1", "limit_2")
    ).withColumn("sources", F.array(*refs))


def raw_projects(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "projects_flat").withColumn("topics", F.split("topic_text", " "))


def projects(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.sources.projects import project_normalise

    return project_normalise(raw_projects(spark, sf))


def snapshots(spark: SparkSession, sf: str) -> tuple[Snapshot, Snapshot]:
    return (
        Snapshot(view(spark, sf, "prev_p"), view(spark, sf, "prev_m")),
        Snapshot(view(spark, sf, "next_p"), view(spark, sf, "next_m")),
    )


# --- merged views, SQL side -----------------------------------------------------------------

_FIRST = ", ".join(
    f"min_by({f}, ord) FILTER (WHERE nullif({f}, '') IS NOT NULL) AS {f}" for f in ["name", "context", "max_output", "modality", "rate_limit"]
)
_SCALARS = ", ".join(
    f"min_by({f}, prio) FILTER (WHERE nullif({f}, '') IS NOT NULL) AS {f}"
    for f in ["name", "category", "country", "flag", "url", "base_url", "description", "source_updated_at", "more_models"]
)
_MODS = s.facet_list(lambda f: f"bool_or({s.facet('modality', f)})")

DUCK: dict[str, tuple[list[str], str]] = {
    "m": (["c"], f"SELECT slug, id, min(ord) AS ord, min(pos) AS pos, {_FIRST} FROM c GROUP BY slug, id"),
    "m_roll": (["m"], f"""SELECT slug, count(*) AS model_count, {_MODS} AS modalities,
      {s.clean_ctx(f"max_by(context, {s.ctx_num('context')} * 1e15 - ord) FILTER (WHERE {s.ctx_num('context')} > 0)")} AS max_context
      FROM m GROUP BY slug"""),
    "refs": (["p"], "SELECT slug, source AS name, source_url AS url, min(prio) AS prio, min(synced_at) AS synced_at FROM p GROUP BY slug, source, source_url"),
    "g0": (["p"], f"SELECT slug, {_SCALARS} FROM p GROUP BY slug"),
    "g": (["g0", "m_roll", "refs"], f"""SELECT g0.slug, g0.name, category, country, flag,
      {s.domain_for('g0.slug', 'g0.name', 'url', 'base_url')} AS domain,
      CASE WHEN {s.domain_for('g0.slug', 'g0.name', 'url', 'base_url')} IS NOT NULL THEN '/logos/' || g0.slug || '.png' END AS logo,
      url, base_url, {s.strip_links('description')} AS description, coalesce(modalities, []) AS modalities,
      coalesce(model_count, 0) AS model_count, max_context, {s.free_limit(s.strip_links('description'))} AS free_limit,
      {s.more_note('more_models', 'coalesce(model_count, 0)')} AS more_models,
      greatest('{RUN_AT}', (SELECT max(synced_at) FROM refs r WHERE r.slug = g0.slug)) AS synced_at, source_updated_at,
      (SELECT count(*) FROM refs r WHERE r.slug = g0.slug) AS n_sources
      FROM g0 LEFT JOIN m_roll USING (slug)"""),
    "offers": (["offers_flat"], """SELECT *, list_filter([facet_1, facet_2, facet_3], lambda f: f IS NOT NULL) AS facets,
      [limit_1, limit_2] AS limits, greatest(checked_1, checked_2) AS checked,
      lower(name || ' ' || vendor || ' ' || limit_1 || ' ' || limit_2) AS search_text,
      lower(name || ' ' || vendor || ' ' || limit_1 || ' ' || limit_2 || ' ' || description) AS full_text FROM offers_flat"""),
    "projects": (["projects_flat"], """SELECT lower(full_name) AS slug, full_name, name, owner, nullif(trim(homepage), '') AS homepage,
      nullif(trim(description), '') AS description, language, coalesce(stars, 0) AS stars, forks, coalesce(open_issues, 0) AS open_issues,
      CASE WHEN license NOT IN ('NOASSERTION', 'NONE', '') THEN license END AS license,
      coalesce(string_split(topic_text, ' '), []) AS topics, archived, pushed_at, created_at FROM projects_flat"""),
    "st_ids": (["prev_m", "next_m"], """SELECT slug, id, sum(p) AS p, sum(n) AS n FROM
      (SELECT slug, id, 1 AS p, 0 AS n FROM prev_m UNION ALL SELECT slug, id, 0, 1 FROM next_m) GROUP BY slug, id"""),
    "st": (["st_ids", "prev_p", "next_p"], """SELECT slug, bool_or(ip) AS in_prev, bool_or(inx) AS in_next,
      coalesce(max(pm), 0) AS prev_models, coalesce(max(nm), 0) AS next_models, coalesce(max(pi), 0) AS prev_ids,
      coalesce(max(ni), 0) AS next_ids, coalesce(max(ki), 0) AS kept_ids
      FROM (SELECT slug, true AS ip, false AS inx FROM prev_p UNION ALL SELECT slug, false, true FROM next_p) h
      LEFT JOIN (SELECT slug, sum(p) AS pm, sum(n) AS nm, count_if(p > 0) AS pi, count_if(n > 0) AS ni, count_if(p > 0 AND n > 0) AS ki
        FROM st_ids GROUP BY slug) USING (slug) GROUP BY slug"""),
    "stk": (["st"], """SELECT *, CASE WHEN in_prev AND NOT in_next THEN 'disappeared'
      WHEN in_prev AND in_next AND prev_models >= 3 AND (prev_models - next_models) / prev_models * 100 > 40 THEN 'shrunk' END AS k1,
      coalesce(in_prev AND in_next AND prev_ids >= 3 AND kept_ids / prev_ids < 0.5, false) AS is_churned FROM st"""),
    "tot": (["stk"], """SELECT count_if(in_prev) AS prev_providers, count_if(in_next) AS next_providers, sum(prev_models) AS prev_models,
      sum(next_models) AS next_models, count_if(k1 = 'disappeared') AS n_disappeared, count_if(k1 = 'shrunk') AS n_shrunk,
      count_if(is_churned) AS n_churned FROM stk"""),
    "anom": (["stk"], """SELECT slug, coalesce(k1, 'churned') AS kind,
      CAST(CASE WHEN k1 = 'disappeared' THEN 0 WHEN k1 = 'shrunk' THEN next_models ELSE next_ids END AS BIGINT) AS magnitude,
      CASE WHEN k1 = 'disappeared' THEN 'provider hilang dari hasil merge'
        WHEN k1 = 'shrunk' THEN 'model ' || prev_models || ' -> ' || next_models || ' (-' ||
          CAST(floor((prev_models - next_models) / prev_models * 100 + 0.5) AS BIGINT) || '%)'
        ELSE 'id churn, overlap ' || CAST(floor(kept_ids / prev_ids * 100 + 0.5) AS BIGINT) || '% (' || prev_ids || ' -> ' || next_ids || ' id)' END AS detail
      FROM stk WHERE k1 IS NOT NULL OR is_churned"""),
}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """SQL with the named views and what they need in front; a body may go on with views of its own."""
    order: list[str] = []

    def need(n: str) -> None:
        if n in order:
            return
        for dep in DUCK[n][0] if n in DUCK else []:
            need(dep)
        order.append(n)

    for n in names:
        need(n)
    parts = [f"{n} AS ({DUCK[n][1] if n in DUCK else duck_text(TEXT[n])})" for n in order]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body if parts else body


FACETS = fixed.MODALITY_ORDER
