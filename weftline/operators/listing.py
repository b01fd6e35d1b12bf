"""Orderings, pages and top lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import fixed, numbers
from weftline.operators.parts import global_row_number


def by_name(c: str) -> Column:
    """Dictionary order (a A b B), not byte order."""
    return F.collate(F.col(c), "UNICODE").asc()


def popularity_rank(slug: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(s) for s in fixed.POPULARITY]), slug)
    return F.when(place > 0, place - 1).otherwise(F.lit(fixed.UNRANKED))


def provider_order(key: str) -> list[Column]:
    lead = {
        "popular": popularity_rank(F.col("slug")).asc(),
        "context": numbers.ctx_num(F.col("max_context")).desc(),
        "models": F.col("model_count").desc(),
        "name": by_name("name"),
    }[key]
    return [lead, F.col("slug").asc()]


def sort_providers(items: DataFrame, key: str) -> DataFrame:
    return items.orderBy(*provider_order(key))


def project_order(key: str) -> list[Column]:
    lead = {
        "stars": [F.col("stars").desc()],
        "pushed": [F.col("pushed_at").desc()],
        "name": [by_name("name")],
        "batch": [F.col("stars").desc(), F.col("pushed_at").desc_nulls_last()],
    }[key]
    return [*lead, F.col("slug").asc()]


def sort_projects(projects: DataFrame, key: str = "batch") -> DataFrame:
    return projects.orderBy(*project_order(key))


def model_order() -> list[Column]:
    """Largest context first, then name."""
    return [numbers.ctx_num(F.col("context")).desc(), by_name("name"), F.col("id").asc()]


def _clamped(page: int, size: int, total: int) -> int:
    return min(max(page, 1), max(1, math.ceil(total / size)))


def paginate(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page; the page number is clamped to the pages there are. Only the count reaches the driver.

    The first page is a plain list of the first rows. Positions of others come from sorted ranges and their counts, so a
    page, however deep, is picked from the ranges that hold it and no task sees the rows before it. A list that is paged
    through often is published once (``publish_listing``).
    """
    if page <= 1:
        return df.orderBy(*order).limit(size)
    placed = global_row_number(df, order, "_position")
    current = _clamped(page, size, placed.count())
    return placed.where(F.col("_position").between((current - 1) * size + 1, current * size)).orderBy("_position").drop("_position")


def publish_listing(df: DataFrame, order: list[Column], root: str) -> None:
    """Write a list once in its order: a folder for each range of positions, and how many rows each has."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    placed.write.partitionBy("_part").parquet(f"{root}/rows")
    if df.isEmpty():
        df.withColumn("_at", F.lit(0).cast("bigint")).withColumn("_part", F.lit(0)).write.mode("overwrite").parquet(f"{root}/rows")
    spark.read.parquet(f"{root}/rows").groupBy("_part").agg(F.count("*").alias("rows")).coalesce(1).write.parquet(f"{root}/parts")


def listed_page(spark: SparkSession, root: str, page: int, size: int) -> DataFrame:
    """A page of a published list; of its folders only those that hold the page are read.

    The driver reads a row for each folder, as many as the ranges it was written in.
    """
    sizes = sorted((r["_part"], r["rows"]) for r in spark.read.parquet(f"{root}/parts").collect())
    current = _clamped(page, size, sum(n for _, n in sizes))
    low, high, before, at = (current - 1) * size + 1, current * size, {}, 0
    for part, n in sizes:
        if at < high and at + n >= low:
            before[part] = at
        at += n
    if not before:
        return spark.read.parquet(f"{root}/rows").drop("_part", "_at")
    rows = spark.read.option("basePath", f"{root}/rows").parquet(*[f"{root}/rows/_part={part}" for part in before])
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part").cast("int"))
    placed = rows.withColumn("_position", F.col("_at") + offset)
    return placed.where(F.col("_position").between(low, high)).orderBy("_position").drop("_part", "_at", "_position")


def page_after(df: DataFrame, order: list[Column], beyond: Column, size: int) -> DataFrame:
    """Keyset page: rows beyond the last one shown; cost does not grow with the page number."""
    return df.where(beyond).orderBy(*order).limit(size)


def top_n_with_total(df: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """First n rows and the size of the whole result on each: one aggregate and one top list over the same input."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total", total)
