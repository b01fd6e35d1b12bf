"""Registered sources: a name, a priority and the frames a reader delivered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTIAL_COLUMNS = [
    "source", "source_url", "prio", "pos", "slug", "name", "category", "country", "flag", "url", "base_url", "description",
    "source_updated_at", "more_models", "synced_at",
]
MODEL_COLUMNS = ["source", "prio", "slug", "pos", "ord", "id", "name", "context", "max_output", "modality", "rate_limit"]
# Positions of one source stay below this, so priority decides before position.
SOURCE_SPAN = 1 << 40


@dataclass(frozen=True)
class SourceSpec:
    """One source. Lower priority numbers win; frames may lack optional columns."""

    name: str
    url: str
    priority: int
    providers: DataFrame
    models: DataFrame
    synced_at: str


def _fit(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = {"prio": "int", "pos": "bigint", "ord": "bigint"}
    have = set(df.columns)
    return df.select(*[
        (F.col(c) if c in have else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in columns
    ])


def union_sources(specs: list[SourceSpec]) -> tuple[DataFrame, DataFrame]:
    """All partials and all models of the registered sources, tagged with source and priority."""
    partials, models = None, None
    for spec in specs:
        tags = {"source": F.lit(spec.name), "prio": F.lit(spec.priority)}
        p = _fit(spec.providers.withColumns({**tags, "source_url": F.lit(spec.url), "synced_at": F.lit(spec.synced_at)}), PARTIAL_COLUMNS)
        m = _fit(spec.models.withColumns({**tags, "ord": F.lit(spec.priority * SOURCE_SPAN) + F.col("pos")}), MODEL_COLUMNS)
        partials = p if partials is None else partials.unionByName(p, allowMissingColumns=True)
        models = m if models is None else models.unionByName(m, allowMissingColumns=True)
    return partials, models
