"""Directory browsing: filter, count facets, sort and page in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weftline.operators import listing, rollups, search

PAGE_SIZE = 100


@dataclass(frozen=True)
class BrowseRequest:
    search: str = ""
    modalities: list[str] = field(default_factory=list)
    only_free: bool = False
    sort: str = "popular"
    page: int = 1
    size: int = PAGE_SIZE


def results(items: DataFrame, rows: DataFrame | search.SearchIndex, request: BrowseRequest) -> DataFrame:
    found = search.filter_list(items, rows, request.search, request.modalities)
    return search.only_free_info(found) if request.only_free else found


def page(items: DataFrame, rows: DataFrame | search.SearchIndex, request: BrowseRequest) -> DataFrame:
    """Rows of the requested page; ``items`` is the published slim list, ``rows`` its search text."""
    return listing.paginate(results(items, rows, request), listing.provider_order(request.sort), request.page, request.size)


def chips(items: DataFrame, rows: DataFrame | search.SearchIndex, request: BrowseRequest) -> DataFrame:
    """Facet counts of the current result."""
    return rollups.facet_counts_and(items, rows, request.search, request.modalities)
