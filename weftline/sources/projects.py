"""Project metadata: a curated key list resolved against a metadata table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text


def keyed_fanout(keys: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Metadata of the listed keys; unlisted metadata and unmatched keys fall away."""
    return metadata.join(keys.select(key).distinct(), key, "left_semi")


def fanout_coverage(keys: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """One row: listed, matched, skipped, the floor of half the list and whether it holds."""
    listed = keys.select(key).distinct()
    matched = F.count("hit")
    hits = metadata.select(key).distinct().withColumn("hit", F.lit(1))
    return listed.join(hits, key, "left").agg(
        F.count("*").alias("listed"),
        matched.alias("matched"),
        (F.count("*") - matched).alias("skipped"),
        F.ceil(F.count("*") * 0.5).alias("floor"),
        (matched >= F.ceil(F.count("*") * 0.5)).alias("ok"),
    )


def project_normalise(raw: DataFrame) -> DataFrame:
    """Raw records to the project schema; blank text and empty licences are NULL, counts default to 0."""
    return raw.select(
        F.lower(text.text_or_empty(F.col("full_name"))).alias("slug"),
        F.col("full_name"), F.col("name"),
        text.text_or_empty(F.col("owner")).alias("owner"),
        text.blank_to_null(F.col("homepage")).alias("homepage"),
        text.blank_to_null(F.col("description")).alias("description"),
        text.null_if_empty(F.col("language")).alias("language"),
        F.coalesce("stars", F.lit(0)).alias("stars"),
        F.coalesce("forks", F.lit(0)).alias("forks"),
        F.coalesce("open_issues", F.lit(0)).alias("open_issues"),
        text.license_clean(F.col("license")).alias("license"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
        "pushed_at", "created_at",
    )
