"""Snapshot diff: what vanished, shrank, churned or changed value between two runs.

Child rows of both snapshots are tagged, unioned and compared per (slug, id) once; counts per provider,
churn, examples and the change log are read from that table. Global gates are one-row aggregates
read back as scalar subqueries, so no rows are collected and nothing is cross-joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.session import cut_lineage

MODEL_FIELDS = ["context", "max_output", "modality", "rate_limit"]
PROVIDER_FIELDS = ["description", "base_url", "free_limit", "max_context"]


@dataclass(frozen=True)
class Thresholds:
    total_drop_pct: float = 15
    provider_drop_pct: float = 40
    id_churn_pct: float = 50
    min_providers: int | None = None
    max_disappeared: int = 1
    field_churn_pct: float = 35
    warn_field_churn_pct: float = 15
    min_field_sample: int = 20
    min_provider_field_sample: int = 10


@dataclass
class Snapshot:
    """providers: slug, name and provider fields; models: slug, pos, id, name and model fields."""

    providers: DataFrame
    models: DataFrame


def compared_models(prev: Snapshot, next_: Snapshot) -> DataFrame:
    """Every model row of both snapshots beside what the other one has of its (slug, id).

    (slug, id, name, was, values, p, n, nxt, lead): ``was`` marks previous rows, p and n count the rows of the id in either
    snapshot, ``nxt`` has its values in the next one (a repeated id counts once, the last), ``lead`` marks one row of each
    id. Counts, churn and the change log all read this table, and one exchange by (slug, id) makes it. Rows without an id
    can be most of a provider: they meet the counts of their kind only, which are summed up before the shuffle.
    """
    def side(df: DataFrame, was: bool) -> DataFrame:
        return df.select("slug", "id", "name", F.lit(was).alias("was"), F.col("pos").cast("long").alias("pos"), F.struct(*MODEL_FIELDS).alias("values"))

    rows = side(prev.models, True).unionByName(side(next_.models, False))
    real = text.null_if_empty(F.col("id")).isNotNull()
    same = Window.partitionBy("slug", "id")
    last = F.max(F.when(~F.col("was"), F.struct("pos", "values"))).over(same)
    named = rows.where(real).select(
        "*", F.count_if("was").over(same).alias("p"), F.count_if(~F.col("was")).over(same).alias("n"), last["values"].alias("nxt"),
        (F.row_number().over(same.orderBy(F.col("was").desc(), "pos")) == 1).alias("lead"))
    blank = rows.where(~real)
    kinds = blank.groupBy(F.col("slug").alias("_slug"), F.col("id").alias("_id")).agg(F.count_if("was").alias("p"), F.count_if(~F.col("was")).alias("n"))
    met = blank.join(kinds, F.col("slug").eqNullSafe(F.col("_slug")) & F.col("id").eqNullSafe(F.col("_id"))).drop("_slug", "_id")
    return named.unionByName(met.withColumn("nxt", F.lit(None).cast(named.schema["nxt"].dataType)).withColumn("lead", F.lit(False))).drop("pos")


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other table does not have; null keys are equal."""
    same = None
    for k in keys:
        cond = left[k].eqNullSafe(right[k])
        same = cond if same is None else same & cond
    return left.join(right, same, "left_anti")


def new_ids(prev: Snapshot, next_: Snapshot) -> DataFrame:
    """(slug, id) that the next snapshot has and the previous one has not."""
    return compared_models(prev, next_).where("NOT was AND p = 0").select("slug", "id").distinct()


def provider_stats(prev: Snapshot, next_: Snapshot, models: DataFrame | None = None) -> DataFrame:
    """Per slug: presence, row counts, distinct ids and kept ids of both snapshots."""
    models = compared_models(prev, next_) if models is None else models
    once = F.col("lead")
    per = models.groupBy("slug").agg(
        F.count_if("was").alias("prev_models"), F.count_if(~F.col("was")).alias("next_models"),
        F.count_if(once & (F.col("p") > 0)).alias("prev_ids"),
        F.count_if(once & (F.col("n") > 0)).alias("next_ids"),
        F.count_if(once & (F.col("p") > 0) & (F.col("n") > 0)).alias("kept_ids"),
    )
    here = prev.providers.select("slug", F.lit(True).alias("p"), F.lit(False).alias("n")).unionByName(
        next_.providers.select("slug", F.lit(False).alias("p"), F.lit(True).alias("n"))
    ).groupBy("slug").agg(F.bool_or("p").alias("in_prev"), F.bool_or("n").alias("in_next"))
    return here.join(per, "slug", "left").na.fill(0)


def disappeared() -> Column:
    return F.col("in_prev") & ~F.col("in_next")


def drop_pct() -> Column:
    return F.when(F.col("prev_models") > 0, (F.col("prev_models") - F.col("next_models")) / F.col("prev_models") * 100)


def shrunk(t: Thresholds) -> Column:
    return F.col("in_prev") & F.col("in_next") & (F.col("prev_models") >= 3) & (drop_pct() > t.provider_drop_pct)


def overlap() -> Column:
    return F.when(F.col("prev_ids") > 0, F.col("kept_ids") / F.col("prev_ids"))


def churned(t: Thresholds) -> Column:
    return F.col("in_prev") & F.col("in_next") & (F.col("prev_ids") >= 3) & (overlap() < 1 - t.id_churn_pct / 100)


def totals(stats: DataFrame, t: Thresholds) -> DataFrame:
    """One row of global counts and the benign-change gates."""
    row = stats.agg(
        F.count_if("in_prev").alias("prev_providers"), F.count_if("in_next").alias("next_providers"),
        F.coalesce(F.sum("prev_models"), F.lit(0)).alias("prev_models"), F.coalesce(F.sum("next_models"), F.lit(0)).alias("next_models"),
        F.count_if(disappeared()).alias("n_disappeared"), F.count_if(shrunk(t)).alias("n_shrunk"), F.count_if(churned(t)).alias("n_churned"),
    ).withColumn("total_drop_pct", drop_pct())
    not_fewer = F.col("next_providers") >= F.col("prev_providers")
    in_bound = F.coalesce(F.col("total_drop_pct") <= t.total_drop_pct, F.lit(True))
    few = F.col("n_disappeared").between(1, t.max_disappeared)
    benign_churn = (
        F.col("n_churned").between(1, t.max_disappeared) & (F.col("n_disappeared") == 0) & (F.col("n_shrunk") == 0)
        & not_fewer & (F.col("next_models") > F.col("prev_models"))
    )
    return row.withColumn("benign_disappearance", few & not_fewer & in_bound).withColumn("benign_churn", benign_churn)


def _finding(df: DataFrame, rule: str, slug: Column, severity: Column, value: Column, message: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), slug.cast("string").alias("slug"), severity.alias("severity"),
        value.cast("double").alias("value"), message.alias("message"),
    )


def provider_findings(stats: DataFrame, t: Thresholds) -> DataFrame:
    """Vanished, shrunk and churned providers with their severity."""
    gates = totals(stats, t).select(F.struct("benign_disappearance", "benign_churn")).scalar()
    slug = F.col("slug")
    gone = _finding(
        stats.where(disappeared()), "disappeared", slug, F.when(gates["benign_disappearance"], "warn").otherwise("error"),
        F.lit(0), F.concat(F.lit('provider "'), slug, F.lit('" disappeared')),
    )
    small = _finding(
        stats.where(shrunk(t)), "shrunk", slug, F.lit("error"), drop_pct(),
        F.concat(F.lit('provider "'), slug, F.lit('" model count dropped ('), F.col("prev_models").cast("string"), F.lit(" → "), F.col("next_models").cast("string"), F.lit(")")),
    )
    new_ids = _finding(
        stats.where(churned(t)), "churned", slug, F.when(gates["benign_churn"], "warn").otherwise("error"), overlap() * 100,
        F.concat(F.lit('provider "'), slug, F.lit('" model ids churned ('), F.col("prev_ids").cast("string"), F.lit(" → "), F.col("next_ids").cast("string"), F.lit(" ids)")),
    )
    return gone.unionByName(small).unionByName(new_ids)


def global_findings(stats: DataFrame, t: Thresholds) -> DataFrame:
    """Total model drop and the provider floor."""
    row = totals(stats, t)
    none = F.lit(None).cast("string")
    drop = _finding(
        row.where(F.col("total_drop_pct") > t.total_drop_pct), "total-drop", none, F.lit("error"), F.col("total_drop_pct"),
        F.concat(F.lit("total model count dropped ("), F.col("prev_models").cast("string"), F.lit(" → "), F.col("next_models").cast("string"), F.lit(")")),
    )
    if t.min_providers is None:
        return drop
    floor = _finding(
        row.where(F.col("next_providers") < t.min_providers), "min-providers", none, F.lit("error"), F.col("next_providers"),
        F.concat(F.lit("next has "), F.col("next_providers").cast("string"), F.lit(f" providers, floor is {t.min_providers}")),
    )
    return drop.unionByName(floor)


def matched_models(prev: Snapshot, next_: Snapshot, models: DataFrame | None = None) -> DataFrame:
    """Previous model rows with the next row of the same (slug, id); a repeated next id counts once, the last."""
    models = compared_models(prev, next_) if models is None else models
    return models.where(F.col("was") & F.col("nxt").isNotNull()).select("slug", "id", F.col("values").alias("old"), "nxt")


def matched_providers(prev: Snapshot, next_: Snapshot) -> DataFrame:
    new = next_.providers.select("slug", F.struct(*PROVIDER_FIELDS).alias("nxt"))
    return prev.providers.select("slug", F.struct(*PROVIDER_FIELDS).alias("old")).join(new, "slug")


def _eligible(f: str) -> Column:
    return text.null_if_empty(F.col(f"old.{f}")).isNotNull()


def _changed(f: str) -> Column:
    """Both sides stated and different; a value appearing or vanishing is no change."""
    new = text.null_if_empty(F.col(f"nxt.{f}"))
    return F.coalesce(_eligible(f) & new.isNotNull() & (new != F.col(f"old.{f}")), F.lit(False))


def churn_counts(matched: DataFrame, level: str, fields: list[str]) -> DataFrame:
    """One aggregate, one row per field."""
    aggs = [c for f in fields for c in (F.count_if(_eligible(f)).alias(f"e_{f}"), F.count_if(_changed(f)).alias(f"c_{f}"))]
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").alias("eligible"), F.col(f"c_{f}").alias("changed")) for f in fields]
    return matched.agg(*aggs).select(F.lit(level).alias("level"), F.inline(F.array(*rows)))


def field_churn(prev: Snapshot, next_: Snapshot, t: Thresholds, models: DataFrame | None = None) -> DataFrame:
    """Changed share per field with its severity (NULL when within bounds or the sample is small)."""
    rows = churn_counts(matched_models(prev, next_, models), "model", MODEL_FIELDS).unionByName(
        churn_counts(matched_providers(prev, next_), "provider", PROVIDER_FIELDS)
    )
    pct = F.when(F.col("eligible") > 0, F.col("changed") / F.col("eligible") * 100).otherwise(F.lit(0.0))
    need = F.when(F.col("level") == "model", t.min_field_sample).otherwise(t.min_provider_field_sample)
    level = F.when(F.col("eligible") < need, None).when(F.col("ratio_pct") > t.field_churn_pct, "error").when(
        F.col("ratio_pct") > t.warn_field_churn_pct, "warn"
    )
    return rows.withColumn("ratio_pct", pct).withColumn("severity", level)


def churn_examples(prev: Snapshot, next_: Snapshot, n: int = 3, models: DataFrame | None = None) -> DataFrame:
    """First changed values per model field, at most n; the group limit prunes before the shuffle."""
    entries = [
        F.when(_changed(f), F.struct(F.lit(f).alias("field"), F.col(f"old.{f}").alias("from_value"), F.col(f"nxt.{f}").alias("to_value")))
        for f in MODEL_FIELDS
    ]
    rows = matched_models(prev, next_, models).select("slug", "id", F.inline(F.array_compact(F.array(*entries))))
    w = Window.partitionBy("field").orderBy("slug", "id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def diff_report(prev: Snapshot, next_: Snapshot, t: Thresholds, stats: DataFrame | None = None, models: DataFrame | None = None) -> DataFrame:
    """Every finding of every rule. An empty previous snapshot skips the guard with a note."""
    # The comparison is read by the counts and by the churn, the counts by every rule; both are written once.
    models = cut_lineage(compared_models(prev, next_)) if models is None else models
    stats = cut_lineage(provider_stats(prev, next_, models)) if stats is None else stats
    some = stats.agg(F.count_if("in_prev") > 0).scalar()
    churn = field_churn(prev, next_, t, models).where("severity is not null")
    none = F.lit(None).cast("string")
    fields = _finding(
        churn, "field-churn", none, F.col("severity"), F.col("ratio_pct"),
        F.concat(F.lit("field "), "level", F.lit("."), "field", F.lit(" changed in "), F.col("changed").cast("string"), F.lit("/"), F.col("eligible").cast("string")),
    )
    found = provider_findings(stats, t).unionByName(global_findings(stats, t)).unionByName(fields).where(some)
    note = _finding(
        stats.agg(F.count_if("in_prev").alias("n")).where("n = 0"), "no-previous", none, F.lit("warn"), F.lit(None),
        F.lit("no previous snapshot — guard skipped"),
    )
    return found.unionByName(note)


def id_overlap(stats: DataFrame) -> DataFrame:
    return stats.where("in_prev and in_next").select("slug", "prev_ids", "next_ids", "kept_ids", overlap().alias("overlap"))
