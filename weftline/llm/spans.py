"""Places of regex matches as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: leftmost non-overlapping matches of a pattern that never matches nothing.

    Places are code points, the end exclusive. What lies between the matches and the matches themselves alternate,
    so the places are sums of their lengths. A null text has none.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.coalesce(F.when(text.rlike(pattern), F.aggregate(pairs, begin, step, lambda a: a["out"])), none)


def before(text: Column, start: Column, count: int = 2, chars: int = 96) -> Column:
    """The last ``count`` words before a place (``^`` where the text begins), lower-cased, digits as 0, at most ``chars`` characters back."""
    left = F.substring(text, F.greatest(start - chars, F.lit(0)) + 1, F.least(start, F.lit(chars)))
    words = F.filter(F.split(F.lower(F.regexp_replace(left, "[0-9]", "0")), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(F.concat(F.array_repeat(F.lit("^"), count), words), -count, count), " ")
