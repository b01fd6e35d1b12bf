"""Counts, maxima and facet statistics of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import facets, fixed, numbers, text
from weftline.operators.merge import max_context
from weftline.operators.search import SearchIndex, has_all, needle, offer_predicates, project_matches, text_hits
from weftline.session import cut_lineage

MIN_FACET_PROVIDERS = 3
EXCLUDED_FACETS = ["text"]


def count_per_source(partials: DataFrame, models: DataFrame) -> DataFrame:
    """Entities and children each source delivers."""
    p = partials.groupBy("source").agg(F.count("*").alias("providers"))
    m = models.groupBy("source").agg(F.count("*").alias("models"))
    return p.join(m, "source", "left").select("source", "providers", F.coalesce("models", F.lit(0)).alias("models"))


def source_contributions(providers: DataFrame) -> DataFrame:
    """Entities per source name with the URL of the first entity that names it."""
    refs = providers.select("slug", F.posexplode("sources").alias("at", "s"))
    return refs.groupBy(F.col("s.name").alias("name")).agg(
        F.min_by("s.url", F.struct("slug", "at")).alias("url"), F.count("*").alias("count")
    )


def last_updated(providers: DataFrame) -> DataFrame:
    return providers.agg(F.max("synced_at").alias("last_updated"))


def last_checked(offers: DataFrame) -> DataFrame:
    """Latest check over all nested sources, per row first so nothing is exploded."""
    return offers.agg(F.max(F.array_max(F.transform("sources", lambda s: s["checked_at"]))).alias("last_checked"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per stated value."""
    return df.where(text.null_if_empty(F.col(col)).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def _facet_rows(df: DataFrame, aggs: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over df, then one row per facet: aggs maps facet to its named aggregates."""
    flat = [c.alias(f"{f}_{n}") for f, named in aggs.items() for n, c in named.items()]
    names = list(next(iter(aggs.values())))
    rows = [F.struct(F.lit(f).alias("facet"), *[F.col(f"{f}_{n}").alias(n) for n in names]) for f in aggs]
    return df.agg(*flat).select(F.inline(F.array(*rows)))


def facet_eligibility(providers: DataFrame) -> DataFrame:
    """Facets with enough entities, in canonical order; the widest facet is left out."""
    counted = _facet_rows(providers, {
        f: {"providers": F.count_if(F.array_contains("modalities", f))} for f in fixed.MODALITY_ORDER if f not in EXCLUDED_FACETS
    })
    return counted.where(F.col("providers") >= MIN_FACET_PROVIDERS).withColumn("ord", facets.facet_position(F.col("facet")))


def facet_page(providers: DataFrame, models: DataFrame, facet: str) -> DataFrame:
    """Entities carrying an eligible facet: matching children, their largest context, the grand total."""
    eligible = facet_eligibility(providers).where(F.col("facet") == facet).agg(F.count("*") > 0).scalar()
    carrying = providers.where(F.array_contains("modalities", facet) & eligible).select("slug", "name")
    num = numbers.ctx_num(F.col("context"))
    per = (
        models.where(facets.has_facet(F.col("modality"), facet))
        .groupBy("slug")
        .agg(F.count("*").alias("model_count"),
             F.max_by("context", F.when(num > 0, F.struct(num, -F.col("ord")))).alias("max_context"))
    )
    rows = cut_lineage(carrying.join(per, "slug"))
    total = rows.agg(F.sum("model_count").alias("n")).scalar()
    return rows.withColumn("total_models", total)


def facet_sources_latest(providers: DataFrame, facet: str) -> DataFrame:
    """Per source name the most recently synced reference over the entities carrying a facet."""
    refs = providers.where(F.array_contains("modalities", facet)).select("slug", F.posexplode("sources").alias("at", "s"))
    return refs.groupBy(F.col("s.name").alias("name")).agg(F.max("s.synced_at").alias("synced_at"), F.max_by("s.url", "s.synced_at").alias("url"))


def facet_counts_and(items: DataFrame, rows: DataFrame | SearchIndex, search: str = "", modalities: list[str] | None = None) -> DataFrame:
    """Facet counts inside the current result, zero-filled for facets the whole list carries; ``rows`` is the search text."""
    keep = has_all(F.col("modalities"), modalities or [])
    entities = items.withColumn("kept", keep)
    if needle(search):
        found = text_hits(rows, search).withColumn("hit", F.lit(True))
        entities = items.join(found, "slug", "left").withColumn("kept", keep & F.coalesce("hit", F.lit(False)))
    carries = {f: F.array_contains("modalities", f) for f in fixed.MODALITY_ORDER}
    aggs = {f: {"present": F.count_if(c), "n": F.count_if(c & F.col("kept"))} for f, c in carries.items()}
    aggs["free_info"] = {
        "present": F.count("*"), "n": F.count_if(F.col("kept") & text.null_if_empty(F.col("free_limit")).isNotNull()),
    }
    return _facet_rows(entities, aggs).where("present > 0").select("facet", "n")


def offer_facet_counts(offers: DataFrame, category: str | None = None, kind: str | None = None,
                       facet_list: list[str] | None = None, query: str = "") -> DataFrame:
    """Counts per filter value. A single-choice group leaves its own filter out; facets count the full result."""
    ok = offer_predicates(category, kind, facet_list or [], query)

    def entry(group: str, value: Column, *conds: Column) -> Column:
        cond = F.lit(True)
        for c in conds:
            cond = cond & c
        return F.struct(F.lit(group).alias("grp"), value.alias("value"), cond.alias("counted"))

    singles = F.array(
        entry("category", F.col("category"), ok["kind"], ok["facet"], ok["text"]),
        entry("kind", F.col("kind"), ok["category"], ok["facet"], ok["text"]),
    )
    everything = [ok["category"], ok["kind"], ok["facet"], ok["text"]]
    many = F.transform("facets", lambda f: entry("facet", f, *everything))
    rows = offers.select(F.inline(F.concat(singles, many)))
    return rows.where("value is not null").groupBy("grp", "value").agg(F.count_if("counted").alias("n"))


def language_counts(projects: DataFrame, query: str = "") -> DataFrame:
    """Projects per language matching the query; the language filter itself is left out."""
    return (
        projects.where(text.null_if_empty(F.col("language")).isNotNull())
        .groupBy("language").agg(F.count_if(project_matches(needle(query))).alias("n"))
    )


def available_options(offers: DataFrame) -> DataFrame:
    """Values present per filter group, with their place in the defined order."""
    rows = offers.select(F.inline(F.concat(
        F.array(F.struct(F.lit("category").alias("grp"), F.col("category").alias("value")),
                F.struct(F.lit("kind").alias("grp"), F.col("kind").alias("value"))),
        F.transform("facets", lambda f: F.struct(F.lit("facet").alias("grp"), f.alias("value"))),
    )))
    defined = {"category": fixed.OFFER_CATEGORIES, "kind": fixed.OFFER_KINDS, "facet": fixed.OFFER_FACETS}
    place = F.coalesce(*[
        F.when(F.col("grp") == g, F.array_position(F.array(*[F.lit(v) for v in vs]), F.col("value"))) for g, vs in defined.items()
    ])
    return rows.distinct().withColumn("ord", place).where("ord > 0")


def fill_rates(models: DataFrame, fields: list[str]) -> DataFrame:
    """Share of rows with a value, per field."""
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("filled"), F.col("total")) for f in fields]
    counted = models.agg(F.count("*").alias("total"), *[F.count(f).alias(f"n_{f}") for f in fields])
    return counted.select(F.inline(F.array(*rows))).withColumn("rate", F.col("filled") / F.col("total"))


def run_totals(providers: DataFrame) -> DataFrame:
    return providers.agg(
        F.count("*").alias("providers"),
        F.sum("model_count").alias("models"),
        F.count("logo").alias("with_logo"),
        F.count_if(F.size("sources") > 1).alias("multi_source"),
    )


def home_totals(providers: DataFrame) -> DataFrame:
    return providers.agg(F.count("*").alias("providers"), F.sum("model_count").alias("models"))


def stars_total(projects: DataFrame) -> DataFrame:
    return projects.agg(F.count("*").alias("projects"), F.sum("stars").alias("stars"))


def active_columns(models: DataFrame, group: str = "slug") -> DataFrame:
    """Optional columns that hold a value in any row of the group."""
    fields = ["context", "max_output", "modality", "rate_limit"]
    stated = [F.when(F.bool_or(text.null_if_empty(F.col(f)).isNotNull()), F.lit(f)) for f in fields]
    return models.groupBy(group).agg(F.array_compact(F.array(*stated)).alias("columns"))


def max_context_per_entity(models: DataFrame) -> DataFrame:
    return models.groupBy("slug").agg(max_context(F.col("context"), F.col("ord")).alias("max_context"))
