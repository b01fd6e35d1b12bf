"""Data-quality guards over the per-source catalogue and over two snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bind, sqlfn as s
from checks.bind import TEXT, with_views
from checks.q_sources import api_rows
from checks.registry import case
from weftline.operators import diff, gates, rollups, shape
from weftline.sources import json_payloads

# The per-source models with damage done by value: bare scores, swapped columns, markup, blank and repeated ids.
TEXT["cb"] = f"""
SELECT source, prio, slug, pos, ord, CASE WHEN pos % 29 = 0 THEN '' WHEN pos % 31 = 0 THEN '1' ELSE id END AS id,
  CASE WHEN pos % 37 = 0 THEN ' ' WHEN pos % 5 < 3 AND prio = 0 THEN '<b>' || name || '</b>' WHEN pos % 41 = 0 THEN name || ' &amp; co' ELSE name END AS name,
  CASE WHEN prio = 0 AND pos % 10 < 7 THEN replace(context, 'K', '') WHEN prio = 1 AND pos % 4 = 0 THEN '30 RPM' ELSE context END AS context,
  CASE WHEN prio = 2 THEN NULL WHEN pos % 3 = 0 THEN '$25/month' ELSE max_output END AS max_output,
  CASE WHEN pos % 6 = 1 THEN '81' ELSE modality END AS modality,
  CASE WHEN prio = 1 AND pos % 4 = 0 THEN '30 RPM' WHEN prio = 1 THEN NULL WHEN pos % 9 = 0 THEN '256K' ELSE rate_limit END AS rate_limit
FROM ({TEXT['c']}) c0"""


def stated(x: str) -> str:
    return f"{s.blank_null(x)} IS NOT NULL"


_MODEL_RULES = [
    ("context-shape", "context", stated("context"), f"NOT {s.looks_ctx('context')}"),
    ("maxoutput-shape", "maxOutput", stated("max_output"), f"NOT {s.looks_ctx('max_output')}"),
    ("column-swap-identical", "context/rateLimit", "context IS NOT NULL AND rate_limit IS NOT NULL", f"{stated('context')} AND trim(context) = trim(rate_limit)"),
    ("column-swap-context-looks-like-ratelimit", "context", stated("context"), f"{s.looks_rl('context')} AND NOT {s.looks_ctx('context')}"),
    ("ratelimit-is-bare-context-token", "rateLimit", stated("rate_limit"), s.bare_size("rate_limit")),
    ("modality-unrecognised", "modality", stated("modality"), f"len({s.facet_list(lambda f: s.facet('modality', f))}) = 0"),
    ("leftover-markup-entity", "name", stated("name"), s.markup("name")),
    ("leftover-markup-entity", "id", stated("id"), s.markup("id")),
    ("empty-id", "id", "true", f"NOT ({stated('id')})"),
    ("empty-name", "name", "true", f"NOT ({stated('name')})"),
]
_PROVIDER_RULES = [
    ("leftover-markup-entity", "name", stated("name"), s.markup("name")),
    ("leftover-markup-entity", "description", stated("description"), s.markup("description")),
    ("invalid-url", "url", stated("url"), f"{s.safe_url('url')} IS NULL"),
    ("invalid-url", "baseUrl", stated("base_url"), f"{s.safe_url('base_url')} IS NULL"),
]
_FIELD = {"maxOutput": "max_output", "rateLimit": "rate_limit", "baseUrl": "base_url"}


def _rule_rows(src: str, rules: list, collapse: list[str]) -> list[str]:
    out = [
        f"SELECT source, '{rule}' AS rule, '{field}' AS field, count_if(({t}) AND ({b})) AS count, count_if({t}) AS total FROM {src} GROUP BY source"
        for rule, field, t, b in rules
    ]
    out += [
        f"SELECT source, 'all-null-collapse', '{f}', CASE WHEN count_if({stated(_FIELD.get(f, f))}) = 0 AND count(*) >= 20 THEN count(*) ELSE 0 END, count(*) FROM {src} GROUP BY source"
        for f in collapse
    ]
    return out


_DUP = """SELECT source, 'duplicate-id-in-provider' AS rule, 'id' AS field, CAST(sum(n - 1) AS BIGINT) AS count, CAST(sum(n) AS BIGINT) AS total
  FROM (SELECT source, slug, id, count(*) AS n FROM cb GROUP BY source, slug, id) GROUP BY source"""
_COUNTS = f""", rw AS ({' UNION ALL '.join(_rule_rows('cb', _MODEL_RULES, ['context', 'maxOutput', 'modality', 'rateLimit']) + _rule_rows('p', _PROVIDER_RULES, ['url', 'baseUrl']) + [_DUP])}),
sc AS (SELECT source, rule, field, CAST(sum(count) AS BIGINT) AS count, CAST(sum(total) AS BIGINT) AS total FROM rw GROUP BY source, rule, field),
iss AS (SELECT *, CASE WHEN rule IN ('duplicate-id-in-provider', 'all-null-collapse') AND count > 0 THEN 'warn' ELSE {s.severity('count', 'total')} END AS severity FROM sc)"""


def _inputs(spark, sf):
    return bind.view(spark, sf, "p"), bind.view(spark, sf, "cb")


@case("shape_counts", with_views(_COUNTS + " SELECT * FROM sc", "p", "cb"))
def _(spark, sf):
    return shape.shape_counts(*_inputs(spark, sf), ["source"])


def _offending(src: str, rules: list, kind: int, place: str) -> list[str]:
    value = {"maxOutput": "max_output", "rateLimit": "rate_limit", "baseUrl": "base_url", "context/rateLimit": "context"}
    return [
        f"SELECT source, '{rule}' AS rule, '{field}' AS field, {kind} AS kind, slug, {place} AS o, {value.get(field, field)} AS v FROM {src} WHERE ({t}) AND ({b})"
        for rule, field, t, b in rules if not rule.startswith("empty-")
    ]


_SAMPLES = f""", of AS ({' UNION ALL '.join(_offending('p', _PROVIDER_RULES, 0, 'pos') + _offending('cb', _MODEL_RULES, 1, 'ord'))}),
nf AS (SELECT *, row_number() OVER (PARTITION BY source, rule, field ORDER BY kind, slug, o) AS n FROM of WHERE v IS NOT NULL),
sm AS (SELECT source, rule, field, string_agg(v, ' | ' ORDER BY n) AS samples FROM nf WHERE n <= 3 GROUP BY source, rule, field)"""


@case("shape_report", with_views(_COUNTS + _SAMPLES + """ SELECT source, rule, field, count, total, severity, round(count / total, 9) AS ratio,
  'Field "' || field || '": ' || count || '/' || total || ' (' || CAST(floor(count / total * 100 + 0.5) AS BIGINT) || '%) break rule ' || rule AS message, samples
  FROM iss LEFT JOIN sm USING (source, rule, field) WHERE severity IS NOT NULL""", "p", "cb"))
def _(spark, sf):
    report = shape.shape_report(*_inputs(spark, sf), ["source"])
    return report.withColumn("ratio", F.round("ratio", 9)).withColumn("samples", F.array_join("samples", " | "))


@case("shape_samples", with_views(_COUNTS + _SAMPLES + " SELECT * FROM sm", "p", "cb"))
def _(spark, sf):
    p, m = _inputs(spark, sf)
    return shape.shape_samples(m, ["source"], providers=p).withColumn("samples", F.array_join("samples", " | "))


@case("severity_by_ratio", with_views(_COUNTS + " SELECT severity, count(*) AS n FROM iss GROUP BY severity", "p", "cb"))
def _(spark, sf):
    counts = shape.shape_counts(*_inputs(spark, sf), ["source"])
    level = F.when(F.col("rule").isin(shape.ALWAYS_WARN) & (F.col("count") > 0), "warn").otherwise(shape.severity(F.col("count"), F.col("total")))
    return counts.groupBy(level.alias("severity")).agg(F.count("*").alias("n"))


def one_rule(key: str, rule: str, fields: list[str] | None = None):
    """A single rule over the damaged models."""
    rows = [r for r in _MODEL_RULES if r[0] == rule and (fields is None or r[1] in fields)]
    sql = " UNION ALL ".join(_rule_rows("cb", rows, []))
    case(key, with_views(f"SELECT *, {s.severity('count', 'total')} AS severity FROM ({sql})", "cb"))(
        lambda spark, sf: shape.rule_counts(bind.view(spark, sf, "cb").drop("description"), rule, ["source"])
    )


one_rule("shape_context", "context-shape")
one_rule("shape_max_output", "maxoutput-shape")
one_rule("shape_column_swap_identical", "column-swap-identical")
one_rule("shape_context_like_rate", "column-swap-context-looks-like-ratelimit")
one_rule("shape_rate_is_bare_size", "ratelimit-is-bare-context-token")
one_rule("shape_modality_unknown", "modality-unrecognised")


@case("shape_leftover_markup", with_views(f"""
SELECT *, {s.severity('count', 'total')} AS severity FROM ({' UNION ALL '.join(_rule_rows('p', [_PROVIDER_RULES[0], _PROVIDER_RULES[1]], []) + _rule_rows('cb', [r for r in _MODEL_RULES if r[0] == 'leftover-markup-entity' and r[1] == 'id'], []))})
UNION ALL SELECT 'pages', 'leftover-markup-entity', 'name', count_if({s.markup('html')}), count(*), CASE WHEN count_if({s.markup('html')}) > 0 THEN 'fatal' END FROM pages""", "p", "cb"))
def _(spark, sf):
    p = shape.rule_counts(bind.view(spark, sf, "p"), "leftover-markup-entity", ["source"])
    m = shape.rule_counts(bind.view(spark, sf, "cb").select("source", "id"), "leftover-markup-entity", ["source"])
    pages = bind.table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("html").alias("name"))
    w = shape.rule_counts(pages, "leftover-markup-entity", ["source"])
    return p.unionByName(m).unionByName(w)


@case("shape_empty_keys", with_views(f"SELECT *, {s.severity('count', 'total')} AS severity FROM ({' UNION ALL '.join(_rule_rows('cb', [r for r in _MODEL_RULES if r[0].startswith('empty-')], []))})", "cb"))
def _(spark, sf):
    cb = bind.view(spark, sf, "cb")
    return shape.rule_counts(cb, "empty-id", ["source"]).unionByName(shape.rule_counts(cb, "empty-name", ["source"]))


@case("shape_duplicate_ids", with_views(_DUP, "cb"))
def _(spark, sf):
    return shape.duplicate_ids(bind.view(spark, sf, "cb"), ["source"])


@case("shape_invalid_url", with_views(f"SELECT *, {s.severity('count', 'total')} AS severity FROM ({' UNION ALL '.join(_rule_rows('p', _PROVIDER_RULES[2:], []))})", "p"))
def _(spark, sf):
    return shape.rule_counts(bind.view(spark, sf, "p"), "invalid-url", ["source"])


@case("shape_all_null", with_views(_COUNTS + " SELECT source, field, count, total FROM sc WHERE rule = 'all-null-collapse' AND count > 0", "p", "cb"))
def _(spark, sf):
    return shape.shape_counts(*_inputs(spark, sf), ["source"]).where("rule = 'all-null-collapse' and count > 0").select("source", "field", "count", "total")


@case("scorelike_guard", with_views("""
SELECT source, count(nullif(context, '')) AS total, count_if(regexp_matches(context, '^[0-9]{1,3}$')) AS scorelike,
  count(nullif(context, '')) >= 20 AND count_if(regexp_matches(context, '^[0-9]{1,3}$')) / count(nullif(context, '')) > 0.5 AS failed FROM cb GROUP BY source""", "cb"))
def _(spark, sf):
    return shape.scorelike_guard(bind.view(spark, sf, "cb"), ["source"])


@case("entry_shape_guard", """
WITH e AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 AND p_partkey % 23 <> 0), g AS (SELECT k FROM e WHERE k % 11 <> 0 AND k % 13 <> 0)
SELECT (SELECT count(*) FROM e) AS entries, (SELECT count(*) FROM e WHERE k % 11 = 0 OR k % 13 = 0) AS bad_entries,
  4 * (SELECT count(*) FROM g) AS model_entries, 2 * (SELECT count(*) FROM g) AS with_id, (SELECT count(*) FROM g) AS with_context, (SELECT count(*) FROM g) AS with_modality,
  0 AS failed_rules""")
def _(spark, sf):
    stats = json_payloads.ingest_nested_json(bind.view(spark, sf, "payloads")).stats
    failed = json_payloads.nested_shape_guard(stats).agg(F.count("*").alias("n")).scalar()
    sums = [F.sum(c).alias(c) for c in ["entries", "bad_entries", "model_entries", "with_id", "with_context", "with_modality"]]
    return stats.agg(*sums).withColumn("failed_rules", failed)


# The documents of one kind alone: entries without a usable name or list, and models without a context or modality.
@case("entry_shape_guard_fires", """
SELECT rule, n AS entries, b AS bad_entries, r AS model_entries FROM (
  SELECT count(*) AS n, count_if(k % 11 = 0 OR k % 13 = 0) AS b, 4 * count_if(k % 11 <> 0 AND k % 13 <> 0) AS r
  FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 AND p_partkey % 23 <> 0 AND (p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 9 = 1))),
  (SELECT unnest(['entry-shape', 'fill-modality']) AS rule) WHERE rule = 'entry-shape' AND n >= 5 AND b / n > 0.5 OR rule = 'fill-modality' AND r >= 20""")
def _(spark, sf):
    raw = bind.view(spark, sf, "payloads").where("doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 9 = 1")
    bare = raw.withColumn("payload", F.regexp_replace("payload", '"modality": "Text"', '"modality": ""'))
    return json_payloads.nested_shape_guard(json_payloads.ingest_nested_json(bare).stats)


@case("suffix_feed_guard", """
WITH e AS (SELECT event_id, user_id, event_type || '/' || k AS id, event_type, CAST(k AS BIGINT) AS k FROM (SELECT *, regexp_extract(props, '[0-9]+', 0) AS k FROM events)),
f AS (SELECT id, min(event_id) AS ord FROM e WHERE user_id % 2 = 0 GROUP BY id), x AS (SELECT e.* FROM f JOIN e ON e.event_id = f.ord)
SELECT count(*) AS kept, count_if(user_id % 5 <> 0) AS with_context, count_if(event_type IN ('click', 'view', 'error')) AS with_modality, (SELECT count(*) FROM e) AS total FROM x""")
def _(spark, sf):
    return json_payloads.ingest_json_suffix_filter(api_rows(spark, sf)).stats


# Baselines: stored for one source, a fallback for the others, none for src_2.
TEXT["fallback"] = """
SELECT 'src_' || CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 9 END AS source, count(DISTINCT o_custkey) * 2 AS providers, count(*) * 20 AS models FROM {orders} GROUP BY o_orderstatus"""
TEXT["stored"] = "SELECT 'src_0' AS source, count(*) AS providers, count(*) * 300 AS models, '2026-01-01' AS updated_at FROM {supplier} UNION ALL SELECT 'src_1', NULL, count(*), '2026-01-01' FROM {supplier}"
_BASE = """
, base AS (SELECT source, providers, models FROM stored WHERE providers IS NOT NULL UNION ALL SELECT source, providers, models FROM fallback WHERE source NOT IN (SELECT source FROM stored WHERE providers IS NOT NULL)),
cn AS (SELECT * FROM (SELECT source, count(*) AS providers FROM p GROUP BY source) a JOIN (SELECT source, count(*) AS models FROM c GROUP BY source) b USING (source)),
fl AS (SELECT cn.*, b.providers AS base_providers, b.models AS base_models, CASE WHEN b.providers IS NULL THEN 'no-baseline' WHEN cn.providers < floor(b.providers * 0.5) THEN 'providers-below-floor'
  WHEN cn.models < floor(b.models * 0.5) THEN 'models-below-floor' ELSE 'ok' END AS reason FROM cn LEFT JOIN base b USING (source))"""


def _baselines(spark, sf):
    return gates.effective_baselines(bind.view(spark, sf, "stored"), bind.view(spark, sf, "fallback"))


def _counts(spark, sf):
    return rollups.count_per_source(bind.view(spark, sf, "p"), bind.view(spark, sf, "c"))


@case("source_floor", with_views(_BASE + " SELECT *, reason IN ('ok', 'no-baseline') AS ok FROM fl", "p", "c", "stored", "fallback"))
def _(spark, sf):
    return gates.source_floor(_counts(spark, sf), _baselines(spark, sf))


@case("baseline_roll", with_views(_BASE + f" SELECT source, cn.providers, CASE WHEN b.models > 0 THEN least(cn.models, CAST(ceil(b.models * 1.5) AS BIGINT)) ELSE cn.models END AS models, '{bind.RUN_AT}' AS updated_at FROM cn LEFT JOIN base b USING (source)", "p", "c", "stored", "fallback"))
def _(spark, sf):
    return gates.roll_baselines(_counts(spark, sf), _baselines(spark, sf), bind.RUN_AT)


@case("per_source_gate", with_views(_COUNTS + _BASE.replace("FROM c GROUP", "FROM cb GROUP") + """
SELECT source, providers, models, CAST(coalesce(fa, 0) AS BIGINT) AS fatal, CAST(coalesce(wa, 0) AS BIGINT) AS warnings, reason IN ('ok', 'no-baseline') AS floor_ok,
  CASE WHEN reason NOT IN ('ok', 'no-baseline') THEN 'sanity-floor' WHEN fa > 0 THEN 'shape-fatal' ELSE 'ok' END AS status
FROM fl LEFT JOIN (SELECT source, count_if(severity = 'fatal') AS fa, count_if(severity = 'warn') AS wa FROM iss GROUP BY source) USING (source)""", "p", "cb", "stored", "fallback"))
def _(spark, sf):
    return gates.source_gate(*_inputs(spark, sf), _baselines(spark, sf))


# --- snapshot diff ---------------------------------------------------------------------------

T = diff.Thresholds(min_providers=101)
_GATES = """, gt AS (SELECT *, (prev_models - next_models) / prev_models * 100 AS drop_pct, n_disappeared = 1 AND next_providers >= prev_providers AND (prev_models - next_models) / prev_models * 100 <= 15 AS benign_d,
  n_churned = 1 AND n_disappeared = 0 AND n_shrunk = 0 AND next_providers >= prev_providers AND next_models > prev_models AS benign_c FROM tot),
fi AS (SELECT 'disappeared' AS rule, slug, CASE WHEN (SELECT benign_d FROM gt) THEN 'warn' ELSE 'error' END AS severity, 0.0 AS value FROM stk WHERE k1 = 'disappeared'
  UNION ALL SELECT 'shrunk', slug, 'error', (prev_models - next_models) / prev_models * 100 FROM stk WHERE k1 = 'shrunk'
  UNION ALL SELECT 'churned', slug, CASE WHEN (SELECT benign_c FROM gt) THEN 'warn' ELSE 'error' END, kept_ids / prev_ids * 100 FROM stk WHERE is_churned
  UNION ALL SELECT 'total-drop', NULL, 'error', drop_pct FROM gt WHERE drop_pct > 15
  UNION ALL SELECT 'min-providers', NULL, 'error', next_providers FROM gt WHERE next_providers < 101)"""


def _stats(spark, sf):
    return diff.provider_stats(*bind.snapshots(spark, sf))


def found(df):
    return df.select("rule", "slug", "severity", F.round("value", 6).alias("value"))


def finding_case(key: str, rule: str, whole: bool = False):
    case(key, with_views(_GATES + f" SELECT rule, slug, severity, round(value, 6) AS value FROM fi WHERE rule = '{rule}'", "stk", "tot"))(
        lambda spark, sf: found((diff.global_findings if whole else diff.provider_findings)(_stats(spark, sf), T).where(F.col("rule") == rule))
    )


finding_case("diff_disappeared", "disappeared")
finding_case("diff_provider_shrink", "shrunk")
finding_case("diff_id_churn", "churned")
finding_case("diff_min_floor", "min-providers", whole=True)


@case("diff_total_drop", with_views("""
, h AS (SELECT * FROM tot) SELECT prev_providers, next_providers, CAST(prev_models AS BIGINT) AS prev_models, CAST(next_models AS BIGINT) AS next_models, n_disappeared, n_shrunk, n_churned,
  round((prev_models - next_models) / prev_models * 100, 6) AS total_drop_pct FROM h""", "tot"))
def _(spark, sf):
    t = diff.totals(_stats(spark, sf), diff.Thresholds())
    return t.select("prev_providers", "next_providers", "prev_models", "next_models", "n_disappeared", "n_shrunk", "n_churned", F.round("total_drop_pct", 6).alias("total_drop_pct"))


def _churn(level: str, src: str, fields: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{level}' AS level, '{f}' AS field, count_if(nullif(a.{f}, '') IS NOT NULL) AS eligible, count_if(nullif(a.{f}, '') IS NOT NULL AND nullif(b.{f}, '') IS NOT NULL AND a.{f} <> b.{f}) AS changed FROM {src}"
        for f in fields
    )


_FIELDS = f""", fc AS ({_churn('model', 'prev_m a JOIN next_m b USING (slug, id)', diff.MODEL_FIELDS)} UNION ALL {_churn('provider', 'prev_p a JOIN next_p b USING (slug)', diff.PROVIDER_FIELDS)}),
fp AS (SELECT *, CASE WHEN eligible > 0 THEN changed / eligible * 100 ELSE 0.0 END AS ratio_pct FROM fc),
fs AS (SELECT *, CASE WHEN eligible < (CASE level WHEN 'model' THEN 20 ELSE 10 END) THEN NULL WHEN ratio_pct > 35 THEN 'error' WHEN ratio_pct > 15 THEN 'warn' END AS severity FROM fp)"""


@case("diff_field_churn", with_views(_FIELDS + " SELECT level, field, eligible, changed, round(ratio_pct, 6) AS ratio_pct, severity FROM fs", "prev_m", "next_m", "prev_p", "next_p"))
def _(spark, sf):
    return diff.field_churn(*bind.snapshots(spark, sf), diff.Thresholds()).withColumn("ratio_pct", F.round("ratio_pct", 6))


@case("diff_churn_examples", with_views(" UNION ALL ".join(
    f"(SELECT slug, id, '{f}' AS field, a.{f} AS from_value, b.{f} AS to_value, CAST(row_number() OVER (ORDER BY slug, id) AS INTEGER) AS n FROM prev_m a JOIN next_m b USING (slug, id) WHERE nullif(a.{f}, '') IS NOT NULL AND nullif(b.{f}, '') IS NOT NULL AND a.{f} <> b.{f} ORDER BY slug, id LIMIT 3)"
    for f in diff.MODEL_FIELDS), "prev_m", "next_m"))
def _(spark, sf):
    return diff.churn_examples(*bind.snapshots(spark, sf))


@case("diff_report", with_views(_GATES + _FIELDS + " SELECT rule, slug, severity, round(value, 6) AS value FROM fi UNION ALL SELECT 'field-churn', NULL, severity, round(ratio_pct, 6) FROM fs WHERE severity IS NOT NULL", "stk", "tot", "prev_m", "next_m", "prev_p", "next_p"))
def _(spark, sf):
    return found(diff.diff_report(*bind.snapshots(spark, sf), T))


