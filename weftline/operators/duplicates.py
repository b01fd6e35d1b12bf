"""Duplicate audit, with an exact containment join that never forms all pairs of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text


def _grams(c: Column, k: int) -> Column:
    """Start positions (1-based) of every k-gram."""
    return F.when(F.length(c) >= k, F.sequence(F.lit(1), F.length(c) - k + 1))


def containment_pairs(keys: DataFrame, group: list[str], k: int, key: str = "key", n: str = "n") -> DataFrame:
    """Pairs of distinct keys where one contains the other and both have at least k characters.

    ``keys`` is distinct per group with a row count ``n``. Exact without candidate caps:

    1. the contained keys are summed up as (group, first k characters) -> lengths present, one row
       per prefix however many keys share it;
    2. each key looks up its k-grams there and, on a hit, emits one substring per length;
    3. a substring is a match when it equals a key of the group.

    A key yields at most (its length) x (lengths present) substrings, so the cost follows text length
    and never the number of keys sharing a prefix.
    """
    long = keys.where(F.length(key) >= k)
    prefixes = long.groupBy(*group, F.substring(key, 1, k).alias("gram")).agg(F.collect_set(F.length(key)).alias("lengths"))
    starts = long.select(*group, key, n, F.explode(_grams(F.col(key), k)).alias("at")).withColumn(
        "gram", F.substr(F.col(key), F.col("at"), F.lit(k))
    )
    fits = F.filter("lengths", lambda x: (x + F.col("at") - 1 <= F.length(key)) & (x < F.length(key)))
    parts = (
        starts.join(prefixes, [*group, "gram"])
        .select(*group, key, n, "at", F.explode(fits).alias("len"))
        .select(*group, key, n, F.substr(F.col(key), F.col("at"), F.col("len")).alias("inner_key"))
        .distinct()
    )
    inner = long.select(*group, F.col(key).alias("inner_key"), F.col(n).alias("inner_n"))
    return parts.join(inner, [*group, "inner_key"]).select(
        *group, F.col(key).alias("outer_key"), "inner_key", (F.col(n) * F.col("inner_n")).alias("pairs")
    )


def near_duplicates(rows: DataFrame, name: Column, group: list[str], k: int, shown: int = 3) -> DataFrame:
    """One row per suspect key: (key, equal, containing, pairs, examples).

    ``equal``: row pairs of that very key, n * (n - 1) / 2; ``containing``: other keys that hold it, ``pairs``: row pairs
    with those, ``examples``: the first few. The rows grow with the keys, never with the pairs.
    """
    keys = (
        rows.withColumn("key", text.alnum_key(name)).where("key <> ''").groupBy(*group, "key").agg(F.count("*").alias("n"))
    )
    pairs = containment_pairs(keys, group, k)
    counted = pairs.groupBy(*group, F.col("inner_key").alias("key")).agg(F.count("*").alias("containing"), F.sum("pairs").alias("pairs"))
    # The group limit prunes each task's rows before the shuffle.
    place = F.row_number().over(Window.partitionBy(*group, "inner_key").orderBy("outer_key"))
    first = pairs.withColumn("place", place).where(F.col("place") <= shown).groupBy(*group, F.col("inner_key").alias("key")).agg(
        F.array_sort(F.collect_list("outer_key")).alias("examples"))
    equal = keys.where("n > 1").select(*group, "key", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("equal"))
    both = equal.join(counted, [*group, "key"], "full").join(first, [*group, "key"], "left")
    zero = F.lit(0).cast("bigint")
    return both.select(*group, "key", F.coalesce("equal", zero).alias("equal"), F.coalesce("containing", zero).alias("containing"),
                       F.coalesce("pairs", zero).alias("pairs"), F.coalesce(F.array_join("examples", ","), F.lit("")).alias("examples"))


def near_dup_within(models: DataFrame) -> DataFrame:
    """Near-duplicate models inside a provider."""
    return near_duplicates(models, F.coalesce(text.null_if_empty(F.col("name")), F.col("id")), ["slug"], 8)


def near_dup_global(names: DataFrame) -> DataFrame:
    """Near-duplicate provider names (column ``name``) over the whole catalogue."""
    return near_duplicates(names, F.col("name"), [], 5)


def audit_duplicates(providers: DataFrame, models: DataFrame) -> DataFrame:
    """Six audits as one issue table: audit, hard, slug, key, n (extra rows or suspect pairs)."""
    def issues(df: DataFrame, audit: int, hard: bool, slug: Column, key: Column, n: Column) -> DataFrame:
        return df.select(
            F.lit(audit).alias("audit"), F.lit(hard).alias("hard"), slug.alias("slug"), key.alias("key"), n.cast("bigint").alias("n")
        )

    def repeats(df: DataFrame, group: list[str], key: Column) -> DataFrame:
        return (
            df.withColumn("_k", key).where("_k is not null and _k <> ''")
            .groupBy(*group, "_k").agg(F.count("*").alias("n")).where("n > 1")
        )

    none = F.lit(None).cast("string")
    slugs = repeats(providers, [], F.col("slug"))
    name_first = F.coalesce(text.null_if_empty(F.col("name")), F.col("id"))
    keys = repeats(models, ["slug"], text.model_key(name_first))
    names = repeats(models, ["slug"], text.trim_all(F.lower("name")))
    ids = repeats(models, ["slug"], text.trim_all(F.lower("id")))
    wrong = providers.withColumn("want", text.canonical_slug(F.col("name"))).where("want <> slug")
    within, overall = near_dup_within(models), near_dup_global(providers)
    return (
        issues(slugs, 1, True, F.col("_k"), none, F.col("n") - 1)
        .unionByName(issues(keys, 2, True, F.col("slug"), F.col("_k"), F.col("n") - 1))
        .unionByName(issues(names, 3, True, F.col("slug"), F.concat(F.lit("name:"), "_k"), F.col("n") - 1))
        .unionByName(issues(ids, 3, True, F.col("slug"), F.concat(F.lit("id:"), "_k"), F.col("n") - 1))
        .unionByName(issues(within, 4, False, F.col("slug"), F.col("key"), F.col("equal") + F.col("pairs")))
        .unionByName(issues(overall, 5, False, none, F.col("key"), F.col("equal") + F.col("pairs")))
        .unionByName(issues(wrong, 6, False, F.col("slug"), F.col("want"), F.lit(1)))
    )
