"""Clusters: the same model offered by several providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.session import cut_lineage

MIN_KEY_LENGTH = 4
MODEL_COLUMNS = ["id", "name", "context", "max_output", "rate_limit", "modality"]


def keyed_entries(providers: DataFrame, models: DataFrame) -> DataFrame:
    """First model per (key, provider); providers without a source are left out.

    A key several times in one provider is reduced on the map side before anything meets per key.
    """
    name_first = F.coalesce(text.null_if_empty(F.col("name")), F.col("id"))
    keyed = models.withColumn("key", text.cluster_key(name_first)).where(F.length("key") >= MIN_KEY_LENGTH)
    first = keyed.groupBy("key", "slug").agg(F.min_by(F.struct(*MODEL_COLUMNS), "ord").alias("m")).select("key", "slug", "m.*")
    sourced = providers.where(F.size("sources") > 0).select(
        "slug", F.col("name").alias("provider"), F.try_element_at("sources", F.lit(1)).getField("name").alias("source")
    )
    return first.join(sourced, "slug")


def cluster_names(entries: DataFrame) -> DataFrame:
    """Most frequent name per key; then one that is no raw id, then the alphabetically first."""
    counted = entries.groupBy("key", "name").agg(F.count("*").alias("n"))
    rank = F.struct(-F.col("n"), F.when(text.looks_like_raw_id(F.col("name")), 1).otherwise(0), "name")
    return counted.groupBy("key").agg(F.min_by("name", rank).alias("display_name"), F.sum("n").alias("entries"))


def clusters(entries: DataFrame) -> DataFrame:
    """Keys offered by at least two providers; entries are one per provider, so the count is distinct."""
    return cluster_names(entries).where("entries >= 2")


def cluster_entries(entries: DataFrame) -> DataFrame:
    """Entry rows of real clusters with their place by provider name; a cluster has one entry per provider.

    Keys are computed once, for the count and for the rows.
    """
    entries = cut_lineage(entries)
    place = F.row_number().over(Window.partitionBy("key").orderBy("provider", "slug"))
    return entries.join(clusters(entries), "key").withColumn("place", place)


def cluster_order() -> list:
    return [F.col("entries").desc(), F.col("key").asc()]


def membership(entries: DataFrame, slug: str) -> DataFrame:
    """Clusters holding one provider, with how many providers offer the model."""
    entries = cut_lineage(entries)
    mine = entries.where(F.col("slug") == slug).select("key", F.col("name").alias("name"))
    return mine.join(clusters(entries).select("key", F.col("entries").alias("providers")), "key")
