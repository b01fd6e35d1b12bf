"""Recommendation: the best model per provider for stated criteria, with its reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import facets, fixed, numbers, text

@dataclass(frozen=True)
class Criteria:
    modality: str | None = None
    min_context: int | None = None


def _stated(c: str) -> Column:
    return text.null_if_empty(F.col(c)).isNotNull()


def acceptable(criteria: Criteria) -> Column:
    """A stated modality must match; with a size floor an unstated context fails."""
    ok = F.lit(True)
    if criteria.modality:
        ok = ok & (~_stated("modality") | facets.has_facet(F.col("modality"), criteria.modality))
    if criteria.min_context:
        ok = ok & _stated("context") & (numbers.ctx_num(F.col("context")) >= criteria.min_context)
    return ok


def score(criteria: Criteria) -> Column:
    return numbers.score_linear(
        F.col("modality"), F.col("context"), F.col("max_output"), F.col("rate_limit"), criteria.modality
    )


def best_per_provider(models: DataFrame, criteria: Criteria) -> DataFrame:
    """Best acceptable model per provider; the first wins ties. An aggregate, so one large provider
    is reduced where its rows are."""
    kept = models.where(acceptable(criteria)).withColumn("score", score(criteria))
    cols = ["ord", "id", "name", "context", "max_output", "modality", "rate_limit", "score"]
    best = kept.groupBy("slug").agg(F.max_by(F.struct(*cols), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("slug", "b.*")


def matches(providers: DataFrame, models: DataFrame, criteria: Criteria) -> DataFrame:
    """One match per provider that carries the wanted modality."""
    carrying = providers
    if criteria.modality:
        carrying = providers.where(F.array_contains("modalities", criteria.modality))
    named = carrying.select("slug", F.col("name").alias("provider"))
    return best_per_provider(models, criteria).join(named, "slug")


def reasons(criteria: Criteria) -> Column:
    raw = numbers.rate_limit_raw(F.col("rate_limit"))
    unlimited = numbers.rate_limit_unlimited(F.col("rate_limit"))
    lines = []
    if criteria.modality:
        hit = _stated("modality") & facets.has_facet(F.col("modality"), criteria.modality)
        lines.append(F.when(hit, F.concat(F.lit(fixed.REASON_MODALITY[0]), "modality", F.lit(fixed.REASON_MODALITY[1]))))
    if criteria.min_context:
        label = fixed.THRESHOLD_LABELS.get(criteria.min_context, f"≥ {criteria.min_context}")
        ending = F.lit(fixed.REASON_CONTEXT_MEETS.format(label))
    else:
        ending = F.lit(".")
    lines.append(F.when(_stated("context"), F.concat(F.lit(fixed.REASON_CONTEXT), "context", ending)))
    lines.append(
        F.when(raw.isNotNull() & unlimited, F.concat(F.lit(fixed.REASON_UNLIMITED[0]), raw, F.lit(fixed.REASON_UNLIMITED[1])))
        .when(raw.isNotNull(), F.concat(F.lit(fixed.REASON_RATE), raw, F.lit(".")))
    )
    stated = F.array_compact(F.array(*lines))
    return F.when(F.size(stated) > 0, stated).otherwise(F.array(F.lit(fixed.REASON_ANY)))


def tradeoffs() -> Column:
    raw = numbers.rate_limit_raw(F.col("rate_limit"))
    odd = raw.isNotNull() & ~numbers.rate_limit_unlimited(F.col("rate_limit")) & numbers.rate_limit_per_day(F.col("rate_limit")).isNull()
    return F.array_compact(F.array(
        F.when(raw.isNull(), F.lit(fixed.TRADEOFF_RATE)),
        F.when(~_stated("context"), F.lit(fixed.TRADEOFF_CONTEXT)),
        F.when(~_stated("max_output"), F.lit(fixed.TRADEOFF_OUTPUT)),
        F.when(odd, F.lit(fixed.TRADEOFF_ODD_RATE)),
    ))


def explain(rows: DataFrame, criteria: Criteria) -> DataFrame:
    return rows.withColumn("reasons", reasons(criteria)).withColumn("tradeoffs", tradeoffs())


def recommend(providers: DataFrame, models: DataFrame, criteria: Criteria) -> DataFrame:
    """All matches, best first."""
    return explain(matches(providers, models, criteria), criteria).orderBy(F.col("score").desc(), "slug")
