"""Directory search: slim projections, filters, lookups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.numbers import parse_context_tokens
from weftline.operators.parts import global_row_number

#: Characters of a gram, and what stands behind the end of a text.
GRAM, END = 3, "\x01"
#: Rows of a block of the search index: two to the power of this.
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
LIST_COLUMNS = ["slug", "name", "model_count", "modalities", "max_context", "free_limit"]


def needle(query: str) -> str:
    return query.strip().lower()


def model_text(name: Column, model_id: Column) -> Column:
    return F.lower(F.concat_ws(" ", name, model_id))


def slim_list(providers: DataFrame) -> DataFrame:
    """Slim list columns, one row per entity."""
    return providers.select(*LIST_COLUMNS)


def search_rows(providers: DataFrame, models: DataFrame) -> DataFrame:
    """(slug, row, text, block): an entity's search text as ordered rows, its own name at 0 and each model from 1 on.

    The text of an entity is its rows joined by blanks. It has no size bound, so it stays rows at every size. All rows are
    sorted once; a block is a run of up to ``BLOCK`` rows that follow each other in that order.
    """
    own = providers.select("slug", F.lit(True).alias("own"), F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("id"), F.lower("name").alias("text"))
    named = models.join(providers.select("slug"), "slug").select("slug", F.lit(False).alias("own"), F.col("pos").cast("bigint").alias("pos"), "id", model_text(F.col("name"), F.col("id")).alias("text"))
    placed = global_row_number(own.unionByName(named), [F.col("slug").asc(), F.col("own").desc(), F.col("pos").asc(), F.col("id").asc()])
    first = placed.where("not own").groupBy("slug").agg(F.min("position").alias("first"))
    row = F.when(F.col("own"), 0).otherwise(F.col("position") - F.col("first") + 1).cast("bigint")
    return placed.join(first, "slug", "left").select("slug", row.alias("row"), "text", F.shiftright(F.col("position") - 1, BLOCK_BITS).alias("block"))


@dataclass(frozen=True)
class SearchIndex:
    """Search text as rows (slug, row, text, block) and the blocks in which each run of three characters occurs (gram, block)."""

    rows: DataFrame
    postings: DataFrame


def _grams(q: str) -> list[str]:
    return sorted({q[k : k + GRAM] for k in range(len(q) - GRAM + 1)})


def postings_of(rows: DataFrame) -> DataFrame:
    """Every run of ``GRAM`` characters of a block's rows once; marks behind the end make runs of the last ones too.

    A block's rows lie in one or two files, so nearly all repeats go before the shuffle.
    """
    marked = F.concat("text", F.lit(END * (GRAM - 1))).alias("text")
    places = rows.where(F.length("text") > 0).select("block", marked, F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    return places.select(F.substring("text", F.col("at"), F.lit(GRAM)).alias("gram"), "block").distinct()


def publish_index(providers: DataFrame, models: DataFrame, root: str) -> None:
    """Write the index of a catalogue once: rows with their blocks, postings by gram, so that a query reads the files of its grams."""
    spark = providers.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    search_rows(providers, models).write.parquet(f"{root}/search_rows")
    postings = postings_of(spark.read.parquet(f"{root}/search_rows"))
    postings.repartitionByRange(parts, "gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{root}/search_grams")


def read_index(spark: SparkSession, root: str) -> SearchIndex:
    return SearchIndex(spark.read.parquet(f"{root}/search_rows"), spark.read.parquet(f"{root}/search_grams"))


def _candidates(index: SearchIndex, q: str, ends: bool) -> DataFrame:
    """Rows of the blocks that may hold the string, or rows that end with it: those with all its grams; a shorter one begins some gram."""
    grams = _grams(q + END * (GRAM - 1) if ends else q)
    if not grams:
        found = index.postings.where(F.col("gram").startswith(q)).select("block").distinct()
    else:
        found = index.postings.where(F.col("gram").isin(grams)).groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return index.rows.join(found, "block", "left_semi").select("slug", "row", "text")


def text_hits(rows: DataFrame | SearchIndex, query: str) -> DataFrame:
    """Slugs whose search text holds the query, inside one row or across rows that follow each other.

    A query with s blanks reaches over s + 1 rows at most, and its first row ends with what stands before one of the
    blanks: only such rows are joined, by position, with the ones that follow. With an index only blocks that have the grams
    of the query, or of what stands before a blank, are looked at.
    """
    q = needle(query)
    whole = (rows.rows if isinstance(rows, SearchIndex) else rows).select("slug", "row", "text")
    near = _candidates(rows, q, False) if isinstance(rows, SearchIndex) else whole
    inside = near.where(F.col("text").contains(q)).select("slug")
    blanks = [k for k, c in enumerate(q) if c == " "]
    if not blanks:
        return inside.distinct()
    if isinstance(rows, SearchIndex):
        parts = [_candidates(rows, q[:k], True).where(F.col("text").endswith(q[:k])) for k in blanks]
        joined = reduce(DataFrame.unionByName, parts).distinct()
    else:
        begins = reduce(lambda a, b: a | b, [F.col("text").endswith(q[:k]) for k in blanks])
        joined = whole.where(begins)
    for step in range(1, len(blanks) + 1):
        after = whole.select("slug", (F.col("row") - step).alias("row"), F.col("text").alias("_next"))
        joined = joined.join(after, ["slug", "row"], "left").select("slug", "row", F.concat_ws(" ", "text", "_next").alias("text"))
    return inside.union(joined.where(F.col("text").contains(q)).select("slug")).distinct()


def has_all(values: Column, wanted: list[str]) -> Column:
    """Every wanted value is present; nothing wanted means no filter."""
    out = F.lit(True)
    for w in wanted:
        out = out & F.array_contains(values, w)
    return out


def filter_list(items: DataFrame, rows: DataFrame | SearchIndex, search: str = "", modalities: list[str] | None = None) -> DataFrame:
    """Entities whose search text (``rows``) holds the query and that carry every selected modality."""
    kept = items.where(has_all(F.col("modalities"), modalities or []))
    if needle(search):
        kept = kept.join(text_hits(rows, search), "slug", "left_semi")
    return kept.select(*LIST_COLUMNS)


def only_free_info(items: DataFrame) -> DataFrame:
    return items.where(text.null_if_empty(F.col("free_limit")).isNotNull())


def filter_modality(providers: DataFrame, modality: str | None) -> DataFrame:
    if not modality:
        return providers
    wanted = needle(modality)
    return providers.where(F.exists("modalities", lambda m: F.lower(m) == wanted))


def filter_min_context(providers: DataFrame, min_context: str | None) -> DataFrame:
    """A threshold that is no size filters nothing; entities without a size never pass."""
    floor = parse_context_tokens(F.lit(min_context))
    return providers.where(floor.isNull() | F.coalesce(parse_context_tokens(F.col("max_context")) >= floor, F.lit(False)))


def lookup(df: DataFrame, slug: str) -> DataFrame:
    return df.where(F.col("slug") == slug)


def search_matches(providers: DataFrame, models: DataFrame, query: str) -> DataFrame:
    """One row per matched model, and one without a model for each entity that matches by itself.

    Columns: slug, provider_match, id, name, pos. A blank query finds nothing.
    """
    q = needle(query)
    own = F.lower(F.coalesce("name", F.lit(""))).contains(q) | F.lower("slug").contains(q)
    child = F.lower(F.coalesce("name", F.lit(""))).contains(q) | F.lower(F.coalesce("id", F.lit(""))).contains(q)
    flagged = providers.select("slug", (own & F.lit(bool(q))).alias("provider_match"))
    hits = models.where(child & F.lit(bool(q))).select("slug", "pos", "id", F.col("name").alias("model_name"))
    return flagged.join(hits, "slug", "left").where(F.col("provider_match") | F.col("id").isNotNull())


def search_preview(matches: DataFrame, shown: int = 10) -> DataFrame:
    """First matched models per entity and how many more there are."""
    hits = matches.where("id is not null")
    totals = hits.groupBy("slug").agg(F.count("*").alias("matched"))
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("pos", "id"))).where(F.col("n") <= shown)
    lines = first.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("n", "model_name"))).alias("xs"))
    entities = matches.select("slug", "provider_match").distinct()
    return entities.join(totals, "slug", "left").join(lines, "slug", "left").select(
        "slug", "provider_match",
        F.array_join(F.col("xs.model_name"), ", ").alias("shown"),
        F.coalesce("matched", F.lit(0)).alias("matched"),
        F.greatest(F.coalesce("matched", F.lit(0)) - shown, F.lit(0)).alias("more"),
    )


def search_models(models: DataFrame, slug: str, query: str) -> DataFrame:
    return models.where((F.col("slug") == slug) & model_text(F.col("name"), F.col("id")).contains(needle(query)))


def search_projects(projects: DataFrame, query: str = "", language: str | None = None) -> DataFrame:
    q = needle(query)
    out = projects if not language else projects.where(F.col("language") == language)
    return out.where(project_matches(q))


def project_matches(q: str) -> Column:
    if not q:
        return F.lit(True)
    described = F.coalesce(F.lower("description").contains(q), F.lit(False))
    return (
        F.lower("name").contains(q) | F.lower("owner").contains(q) | described
        | F.exists("topics", lambda t: F.lower(t).contains(q))
    )


def offer_text(full: bool = False) -> Column:
    """Searchable text of an offer; the full form also holds the description."""
    parts = [F.col("name"), F.col("vendor"), F.array_join("limits", " ")]
    if full:
        parts.append(F.col("description"))
    return F.lower(F.concat_ws(" ", *parts))


OFFER_LIST_COLUMNS = [
    "slug", "name", "vendor", "domain", "category", "kind", "credit_value", "facets", "id_indie", "description",
]


def offer_list(offers: DataFrame) -> DataFrame:
    return offers.select(*OFFER_LIST_COLUMNS, offer_text().alias("search_text"))


def offer_predicates(category: str | None, kind: str | None, facets: list[str], query: str) -> dict[str, Column]:
    q = needle(query)
    yes = F.lit(True)
    return {
        "category": F.col("category") == category if category else yes,
        "kind": F.col("kind") == kind if kind else yes,
        "facet": has_all(F.col("facets"), facets),
        "text": offer_text(full=True).contains(q) if q else yes,
    }


def filter_offers(offers: DataFrame, category: str | None = None, kind: str | None = None,
                  facets: list[str] | None = None, query: str = "") -> DataFrame:
    out = offers
    for cond in offer_predicates(category, kind, facets or [], query).values():
        out = out.where(cond)
    return out


def fallback_eligible() -> Column:
    return F.coalesce(text.null_if_empty(F.col("base_url")).isNotNull() & (F.col("model_count") > 0), F.lit(False))


def eligible_vs_excluded(providers: DataFrame) -> DataFrame:
    return providers.select("slug", "name", "base_url", "model_count", fallback_eligible().alias("eligible"))


def drop_zero_model(providers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with models, and the dropped ones for the report."""
    return providers.where("model_count > 0"), providers.where("model_count = 0").select("slug")


def reject_junk_names(rows: DataFrame, name: str = "name") -> DataFrame:
    c = F.col(name)
    return rows.where(~text.is_junk_name(c) & ~text.is_note(c) & ~text.is_section_descriptor(c))


def valid_submissions(rows: DataFrame, email: str = "email", honeypot: str = "website") -> DataFrame:
    """Submissions with a well-formed address; rows that fill the hidden field are left out."""
    cleaned = rows.withColumn(email, F.lower(text.trim_all(text.text_or_empty(F.col(email)))))
    return cleaned.where(text.is_blank(F.col(honeypot)) & text.valid_email(F.col(email)))


def chain_resolve(selections: DataFrame, providers: DataFrame) -> DataFrame:
    """Ordered (pos, slug, model_id) picks with their entity; unknown entities drop out."""
    return selections.join(providers.select("slug", "name", "base_url"), "slug").select("pos", "slug", "name", "base_url", "model_id")


def chain_candidates(selections: DataFrame, providers: DataFrame) -> DataFrame:
    return providers.join(selections.select("slug"), "slug", "left_anti")
