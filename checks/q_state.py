"""State carried between runs: quarantine, change log, reports, the sliding limiter, whole runs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import bind, q_guards, q_merge, sqlfn as s
from checks.bind import TEXT, with_views
from checks.registry import case
from weftline.operators import changelog, diff, limiter, quarantine
from weftline.plans import browse, sync
from weftline.session import cut_lineage, scratch_folder
from weftline.sources.registry import SourceSpec
from weftline.streaming import limiter as stream_limiter
from weftline.streaming import runs as stream_runs

NOW = "2026-01-06T00:00:00.000Z"
LATE = "2026-01-20T00:00:00.000Z"
T = diff.Thresholds()


def _stats(spark, sf):
    return diff.provider_stats(*bind.snapshots(spark, sf))


def _anomalies(spark, sf):
    return quarantine.anomalies_from_stats(_stats(spark, sf), T)


@case("anomalies_from_diff", with_views("SELECT * FROM anom", "anom"))
def _(spark, sf):
    return _anomalies(spark, sf)


def _reconcile(spark, sf, now: str):
    stats = cut_lineage(_stats(spark, sf))
    total = stats.agg(F.count_if("in_prev").alias("n")).scalar()
    return quarantine.reconcile(bind.view(spark, sf, "state"), quarantine.anomalies_from_stats(stats, T), total, now)


_RECONCILE = f"""
, j AS (SELECT coalesce(a.slug, s.slug) AS slug, a.kind, a.magnitude, a.detail, s.kind AS sk, s.magnitude AS sm, s.detail AS sd, s.streak AS ss, s.first_seen AS sf, s.last_seen AS sl,
  CASE WHEN a.kind = s.kind AND (a.kind = 'disappeared' OR abs(a.magnitude - s.magnitude) / greatest(abs(s.magnitude), 1) <= 0.15) THEN s.streak + 1 ELSE 1 END AS ns
  FROM anom a FULL JOIN state s ON a.slug = s.slug)
SELECT slug, CASE WHEN kind IS NULL THEN 'cleared' WHEN ns >= 3 THEN 'accepted' ELSE 'held' END AS outcome, coalesce(kind, sk) AS kind, coalesce(magnitude, sm) AS magnitude,
  coalesce(detail, sd) AS detail, CASE WHEN kind IS NULL THEN ss ELSE ns END AS streak, coalesce(sf, '{NOW}') AS first_seen, CASE WHEN kind IS NULL THEN sl ELSE '{NOW}' END AS last_seen, NULL AS fatal FROM j"""


@case("quarantine_reconcile", with_views(_RECONCILE, "anom", "state"))
def _(spark, sf):
    return _reconcile(spark, sf, NOW)


@case("quarantine_mass_gate", with_views("""
SELECT count(*) AS anomalies, (SELECT count(*) FROM state s WHERE s.slug IN (SELECT slug FROM anom)) AS known,
  CASE WHEN count(*) / (SELECT count(*) FROM prev_p) > 0.3 THEN 'mass-anomaly' END AS fatal FROM anom""", "anom", "state", "prev_p"))
def _(spark, sf):
    a, state = _anomalies(spark, sf), bind.view(spark, sf, "state")
    total = bind.view(spark, sf, "prev_p").agg(F.count("*").alias("n")).scalar()
    known = state.join(a.select("slug"), "slug", "left_semi").agg(F.count("*").alias("n")).scalar()
    return quarantine.gate(state, a, total, NOW).select("anomalies", known.alias("known"), "fatal")


@case("quarantine_age_gate", with_views(f"""
, st7 AS (SELECT s.slug FROM state s JOIN anom a ON a.slug = s.slug WHERE epoch(CAST('{LATE}' AS TIMESTAMPTZ)) - epoch(CAST(first_seen AS TIMESTAMPTZ)) > 7 * 86400)
SELECT (SELECT count(*) FROM anom) AS anomalies, count(*) AS stale, CASE WHEN count(*) > 0 THEN 'stale-quarantine' END AS fatal FROM st7""", "anom", "state"))
def _(spark, sf):
    stats = cut_lineage(_stats(spark, sf))
    total = stats.agg(F.count_if("in_prev").alias("n")).scalar()
    return quarantine.gate(bind.view(spark, sf, "state"), quarantine.anomalies_from_stats(stats, T), total, LATE)


_SPLIT = """
, e AS (SELECT 'disappeared' AS rule, slug FROM stk WHERE k1 = 'disappeared' UNION ALL SELECT 'shrunk', slug FROM stk WHERE k1 = 'shrunk' UNION ALL SELECT 'churned', slug FROM stk WHERE is_churned
  UNION ALL SELECT 'min-providers', NULL FROM tot WHERE next_providers < 101 UNION ALL SELECT 'field-churn', NULL FROM
    (SELECT count_if(a.context <> b.context) / count(*) AS r FROM prev_m a JOIN next_m b USING (slug, id)) WHERE r > 0.35
  UNION ALL SELECT 'field-churn', NULL FROM (SELECT count_if(a.description <> b.description) / count(*) AS r FROM prev_p a JOIN next_p b USING (slug)) WHERE r > 0.35)
SELECT rule, slug, slug IS NULL OR slug NOT IN (SELECT slug FROM anom) AS is_global FROM e"""


@case("split_global_errors", with_views(_SPLIT, "stk", "tot", "anom", "prev_m", "next_m", "prev_p", "next_p"))
def _(spark, sf):
    # The providers, the comparison and its counts are read by several rules; each is written once.
    snapshots = [diff.Snapshot(cut_lineage(x.providers), x.models) for x in bind.snapshots(spark, sf)]
    both = cut_lineage(diff.compared_models(*snapshots))
    stats = cut_lineage(diff.provider_stats(*snapshots, both))
    findings = diff.diff_report(*snapshots, diff.Thresholds(min_providers=101), stats, both)
    return quarantine.split_errors(findings, quarantine.anomalies_from_stats(stats, T)).select("rule", "slug", "is_global")


_DIFF = """
, both_p AS (SELECT n.slug, n.name FROM next_p n JOIN prev_p USING (slug)),
dl AS (SELECT 'provider_added' AS kind, slug, name AS provider, NULL AS id, name FROM next_p WHERE slug NOT IN (SELECT slug FROM prev_p)
  UNION ALL SELECT 'provider_removed', slug, name, NULL, name FROM prev_p WHERE slug NOT IN (SELECT slug FROM next_p)
  UNION ALL SELECT 'model_added', slug, b.name, id, x.name FROM (SELECT * FROM next_m ANTI JOIN prev_m USING (slug, id)) x JOIN both_p b USING (slug)
  UNION ALL SELECT 'model_removed', slug, b.name, id, x.name FROM (SELECT * FROM prev_m ANTI JOIN next_m USING (slug, id)) x JOIN both_p b USING (slug))"""
_SNAP = ("prev_p", "next_p", "prev_m", "next_m")


@case("changelog_diff", with_views(_DIFF + " SELECT * FROM dl", *_SNAP))
def _(spark, sf):
    return changelog.changelog_diff(*bind.snapshots(spark, sf))


@case("changelog_upsert", with_views(_DIFF + """
, u AS (SELECT date, kind, slug, provider, id, name FROM changes WHERE date <> (SELECT max(date) FROM changes) UNION ALL SELECT (SELECT max(date) FROM changes), * FROM dl)
SELECT * FROM u WHERE date IN (SELECT DISTINCT date FROM u ORDER BY date DESC LIMIT 60)""", "changes", *_SNAP))
def _(spark, sf):
    log = bind.view(spark, sf, "changes")
    last = log.agg(F.max("date")).first()[0]
    return changelog.upsert(log, changelog.changelog_diff(*bind.snapshots(spark, sf)), last)


_LABEL = """CASE kind WHEN 'provider_added' THEN 'Provider baru: ' || name WHEN 'provider_removed' THEN 'Provider dihapus: ' || name
  WHEN 'model_added' THEN '+ ' || name || ' di ' || provider ELSE '− ' || name || ' dari ' || provider END"""


@case("changelog_flatten", with_views(f"SELECT *, CASE kind WHEN 'provider_added' THEN 1 WHEN 'provider_removed' THEN 2 ELSE 3 END AS ord, {_LABEL} AS line FROM changes", "changes"))
def _(spark, sf):
    return changelog.changelog_flatten(bind.view(spark, sf, "changes")).withColumn("ord", F.col("ord").cast("int"))


@case("sort_changelog", with_views(f"SELECT date, kind, slug, id, row_number() OVER (ORDER BY date DESC, CASE kind WHEN 'provider_added' THEN 1 WHEN 'provider_removed' THEN 2 ELSE 3 END, CASE WHEN kind LIKE 'model%' THEN slug END NULLS FIRST, kind, slug, id) AS position FROM changes", "changes"))
def _(spark, sf):
    from weftline.operators import parts

    order = [F.col("date").desc(), *changelog.line_order()]
    return parts.global_row_number(bind.view(spark, sf, "changes"), order).select("date", "kind", "slug", "id", "position")


# --- sliding limiter -------------------------------------------------------------------------

DAY, LIMIT, IDLE = 86_400, 5, 3 * 86_400
SPAN = f"CAST({DAY * 1_000_000} AS BIGINT)"


@case("sliding_rate_limit", f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, us, n, true AS accepted, [us] AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.us, e.n, len(list_filter(r.kept, lambda t: t > e.us - {SPAN})) < {LIMIT},
    CASE WHEN len(list_filter(r.kept, lambda t: t > e.us - {SPAN})) < {LIMIT} THEN list_append(list_filter(r.kept, lambda t: t > e.us - {SPAN}), e.us)
      ELSE list_filter(r.kept, lambda t: t > e.us - {SPAN}) END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, accepted FROM r""")
def _(spark, sf):
    return limiter.sliding_limit(bind.table(spark, sf, "events"), "user_id", "ts", "event_id", DAY, LIMIT)


@case("sliding_rate_limit_stream", f"""
WITH RECURSIVE t AS (SELECT user_id, event_id, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS lo, max(epoch_us(ts)) OVER () AS hi FROM events),
a AS (SELECT *, (us - lo) * 4 // (hi - lo + 1) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS arrival FROM t),
o AS (SELECT user_id, event_id, us, coalesce(us < max(us) OVER (PARTITION BY user_id ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
  OR coalesce(us < max(us) OVER (ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - CAST({IDLE * 1_000_000} AS BIGINT), false) AS late FROM a),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM o WHERE NOT late),
r AS (SELECT user_id, event_id, us, n, true AS accepted, [us] AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.us, e.n, len(list_filter(r.kept, lambda t: t > e.us - {SPAN})) < {LIMIT},
    CASE WHEN len(list_filter(r.kept, lambda t: t > e.us - {SPAN})) < {LIMIT} THEN list_append(list_filter(r.kept, lambda t: t > e.us - {SPAN}), e.us)
      ELSE list_filter(r.kept, lambda t: t > e.us - {SPAN}) END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, accepted, false AS late FROM r UNION ALL SELECT user_id, event_id, false, true FROM o WHERE late""")
def _(spark, sf):
    """The stateful stream over files that land one by one; every fiftieth event arrives a file too late."""
    events = bind.table(spark, sf, "events").withColumn("us", limiter.micros(bind.table(spark, sf, "events"), "ts"))
    lo, hi = events.agg(F.min("us"), F.max("us")).first()
    arrival = F.floor((F.col("us") - lo) * 4 / F.lit(hi - lo + 1)) + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)
    root = f"{scratch_folder(spark)}/limiter-{uuid.uuid4().hex}"
    for n in range(5):  # a batch is one folder of files, written by as many tasks as read it
        events.where(arrival == n).withColumn("arrival", F.lit(n)).drop("us").write.parquet(f"{root}/in/{n}")
    step = stream_limiter.limit_step(f"{root}/limited", "user_id", "ts", "event_id", DAY, LIMIT, IDLE, 1000)
    files = [f"{root}/in/{n}" for n in range(5)]
    schema = spark.read.parquet(files[0]).schema
    for n, folder in enumerate(files):  # each landing is a run of the stream over what is new
        landed = spark.readStream.schema(schema).parquet(folder)
        landed.writeStream.foreachBatch(lambda df, _, at=n: step(df, at)).option("checkpointLocation", f"{root}/ck/{n}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{root}/limited/decisions").parquet(f"{root}/limited/decisions").select("user_id", "event_id", "accepted", "late")


# --- runs ------------------------------------------------------------------------------------


def _specs(spark, sf, ident=None):
    """The three sources of the catalogue; ids and order inside a source are its own."""
    p, c = bind.view(spark, sf, "p"), bind.view(spark, sf, "c")
    out = []
    for prio in range(3):
        mine = p.where(F.col("prio") == prio)
        kids = c.where(F.col("prio") == prio).withColumn("modality", F.nullif(F.col("modality"), F.lit("")))
        if ident is not None:
            kids = kids.withColumn("id", ident)
        out.append(SourceSpec(f"src_{prio}", f"https://src-{prio}.example.com", prio, mine, kids, f"2026-01-0{prio + 1}T00:00:00.000Z"))
    return out


def _options(spark, sf, run: str, day: str):
    from weftline.operators.gates import BASELINE_SCHEMA

    return sync.SyncOptions(run_id=run, now=f"{day}T12:00:00.000Z", fallback_baselines=spark.createDataFrame([], BASELINE_SCHEMA), authoritative={"supplier-1": "src_0"})


@case("run_report", with_views("""
SELECT 'ok-with-warnings' AS outcome, 'source' AS section, source AS label, 'ok' AS status, providers, models FROM
  (SELECT source, count(*) AS providers FROM p GROUP BY source) a JOIN (SELECT source, count(*) AS models FROM c GROUP BY source) b USING (source)""", "p", "c"))
def _(spark, sf):
    root = f"{scratch_folder(spark)}/sync-{uuid.uuid4().hex}"
    result = sync.run_sync(spark, _specs(spark, sf), root, _options(spark, sf, "run-1", "2026-01-04"))
    return result.report.where("section = 'source'").select("outcome", "section", "label", "status", "providers", "models")


# What a run over the three sources reports: their sizes, the merged catalogue (one provider's models as its live source
# lists them), every shape rule over it with samples, and that nothing was there to compare with.
_RUN = q_merge._STAR + f""",
am AS (SELECT 'all' AS source, * FROM mm WHERE slug <> 'supplier-1' OR id IN (SELECT id FROM c WHERE slug = 'supplier-1' AND source = 'src_0')),
mp AS (SELECT 'all' AS source, slug, name, description, url, base_url, NULL AS pos FROM g WHERE slug IN (SELECT slug FROM am)),
rw AS ({' UNION ALL '.join(q_guards._rule_rows('am', q_guards._MODEL_RULES, ['context', 'maxOutput', 'modality', 'rateLimit']) + q_guards._rule_rows('mp', q_guards._PROVIDER_RULES, ['url', 'baseUrl']) + [q_guards._DUP.replace('cb', 'am')])}),
sc AS (SELECT source, rule, field, CAST(sum(count) AS BIGINT) AS count, CAST(sum(total) AS BIGINT) AS total FROM rw GROUP BY source, rule, field),
iss AS (SELECT *, CASE WHEN rule IN ('duplicate-id-in-provider', 'all-null-collapse') AND count > 0 THEN 'warn' ELSE {s.severity('count', 'total')} END AS severity FROM sc),
of AS ({' UNION ALL '.join(q_guards._offending('mp', q_guards._PROVIDER_RULES, 0, 'pos') + q_guards._offending('am', q_guards._MODEL_RULES, 1, 'ord'))}),
nf AS (SELECT *, row_number() OVER (PARTITION BY rule, field ORDER BY kind, slug, o) AS n FROM of WHERE v IS NOT NULL),
sm AS (SELECT rule, field, string_agg(v, ', ' ORDER BY n) AS samples FROM nf WHERE n <= 3 GROUP BY rule, field),
rr AS (
  SELECT 'source' AS section, source AS label, 'ok' AS status, providers, models, NULL AS detail FROM
    (SELECT source, count(*) AS providers FROM p GROUP BY source) a JOIN (SELECT source, count(*) AS models FROM c GROUP BY source) b USING (source)
  UNION ALL SELECT 'merged', NULL, NULL, (SELECT count(*) FROM mp), (SELECT count(*) FROM am), NULL
  UNION ALL SELECT 'dropped', slug, NULL, NULL, NULL, NULL FROM g WHERE slug NOT IN (SELECT slug FROM am)
  UNION ALL SELECT 'shape', rule || ' ' || field, severity, NULL, count,
    'Field "' || field || '": ' || count || '/' || total || ' (' || CAST(floor(count / total * 100 + 0.5) AS BIGINT) || '%) break rule ' || rule || coalesce('; e.g. ' || samples, '')
    FROM iss LEFT JOIN sm USING (rule, field) WHERE severity IS NOT NULL)"""


@case("run_report_rows", with_views(_RUN + " SELECT * FROM rr UNION ALL SELECT 'diff', 'no-previous', 'warn', NULL, NULL, 'no previous snapshot — guard skipped'", "p", "c", "g"))
def _(spark, sf):
    root = f"{scratch_folder(spark)}/sync-{uuid.uuid4().hex}"
    return sync.run_sync(spark, _specs(spark, sf), root, _options(spark, sf, "run-1", "2026-01-04")).report.drop("run_id", "outcome")


@case("run_report_summary", with_views(_RUN + """
SELECT 'run-2' AS run_id, 'ok-with-warnings' AS outcome, section, status, count(*) AS rows, CAST(sum(providers) AS BIGINT) AS providers, CAST(sum(models) AS BIGINT) AS models FROM rr GROUP BY section, status""", "p", "c", "g"))
def _(spark, sf):
    """Two runs one after the other; the second compares itself with the first and finds nothing to report."""
    root = f"{scratch_folder(spark)}/sync-{uuid.uuid4().hex}"
    sync.run_sync(spark, _specs(spark, sf), root, _options(spark, sf, "run-1", "2026-01-04"))
    second = sync.run_sync(spark, _specs(spark, sf), root, _options(spark, sf, "run-2", "2026-01-05"))
    return sync.report_summary(second.report)


@case("browse_page", with_views("SELECT slug, model_count FROM g WHERE list_contains(modalities, 'audio') AND nullif(free_limit, '') IS NOT NULL ORDER BY model_count DESC, slug LIMIT 8 OFFSET 8", "g"))
def _(spark, sf):
    from checks.q_search import list_items, text_rows

    request = browse.BrowseRequest(modalities=["audio"], only_free=True, sort="models", page=2, size=8)
    return browse.page(list_items(spark, sf), text_rows(spark, sf), request).select("slug", F.col("model_count").cast("bigint").alias("model_count"))

