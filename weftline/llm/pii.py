"""Personal data: four base kinds by pattern and check, and more by bootstrapped contexts.

Base findings (email, ip, card, phone) are the seeds. Every other token that looks like an identifier (an ``@`` or at
least four digits) is a candidate. The two words before a finding or candidate are its lexical pattern. In rounds, a
pattern scores the share of its distinct instances that are known to be of one kind, and instances of patterns with
enough support and score become known themselves; candidates of accepted patterns, and other occurrences of instances
that they made known, are added to the spans. Rounds go on until one adds nothing: known instances only grow in number,
and with them the scores of patterns, so this ends and leaves no accepted pattern out. Base spans always stay, added ones never overlap them.

All of it is column expressions and joins. Possessive patterns with a guard at their start read texts of any length in
one go: a match can only begin where a run of its characters begins or the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.spans import before, matches
from weftline.session import cut_lineage, release

# What the base kinds match, in the order in which they are listed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?:(?<![0-9])|\G)[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: Tokens that may be identifiers.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Distinct known instances that a pattern needs, and the share of its instances that must be of the kind.
SUPPORT, CONFIDENCE = 5, 0.8
#: A safety stop: a chain of patterns and instances that has not settled after so many rounds is an error, never a shorter result.
MOST_ROUNDS = 500

_SPANS = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digit string passes the check sum."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p).between(1, 3), p.cast("int")).otherwise(0) <= 255))
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _base(text: Column) -> dict[str, Column]:
    # A finding of a kind needs its first characters somewhere: cheap tests come before the patterns.
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": text.contains("+")}
    none = F.array().cast(_SPANS)

    def passing(kind: str):
        return lambda s: _valid(kind, s["value"])

    return {k: F.filter(F.coalesce(F.when(may[k], matches(text, p)), none), passing(k)) for k, p in PATTERNS.items()}


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas; spans: (start, rank, end, kind)."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, base, candidates): base findings of all kinds, and other identifier-like tokens, with their contexts."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    found = rows.select("*", *[c.alias(f"_{k}") for k, c in _base(F.col("text")).items()])
    found = found.withColumn("base", F.concat(*[_tagged(F.col(f"_{k}"), k) for k in KINDS]))
    likely = F.filter(matches(F.col("text"), TOKEN), lambda s: s["value"].contains("@") | (F.length(_digits(s["value"])) >= 4))
    found = found.withColumn("free", F.filter(likely, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    return found.select(
        "doc_id", "text_key",
        F.transform("base", lambda s: s.withField("context", before(F.col("text"), s["start"]))).alias("base"),
        F.transform("free", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.rtrim(F.regexp_replace(s["value"], r"[.,;:!?)\"']+$", "")).alias("value"), before(F.col("text"), s["start"]).alias("context"))).alias("free"))


def bootstrap(known: DataFrame, unknown: DataFrame, most_rounds: int = MOST_ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(context, kind) of the accepted patterns and (value, kind) of the instances that they made known.

    ``known``: (context, value, kind) of seeds; ``unknown``: (context, value) of candidates. Each round scores the
    graph of patterns and instances anew with what the round before added, until one adds nothing; more than
    ``most_rounds`` raise an error.
    """
    seeds = known.select("context", "value", "kind").distinct()
    edges = cut_lineage(seeds.select("context", "value").union(unknown.select("context", "value")).distinct())
    labels = cut_lineage(seeds.groupBy("value").agg(F.min("kind").alias("kind")))
    sizes = cut_lineage(edges.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    for _ in range(most_rounds):
        scored = edges.join(labels, "value").groupBy("context", "kind").agg(F.count("*").alias("k")).where(F.col("k") >= support)
        accepted = scored.join(sizes, "context").where(F.col("k") >= confidence * (F.col("n") + 1)).select("context", "kind")
        accepted = accepted.groupBy("context").agg(F.min("kind").alias("kind"))
        added = edges.join(accepted, "context").join(labels.select("value"), "value", "left_anti").groupBy("value").agg(F.min("kind").alias("kind"))
        added = cut_lineage(added)
        if added.isEmpty():
            break
        grown = cut_lineage(labels.union(added))
        release(labels, added)
        labels = grown
    else:
        raise RuntimeError(f"contexts of personal data have not settled after {most_rounds} rounds")
    accepted, learned = cut_lineage(accepted), cut_lineage(labels.join(seeds.select("value").distinct(), "value", "left_anti"))
    release(edges, sizes)
    return accepted, learned


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, base, spans) per row: arrays of (start, rank, end, kind) in order.

    A null text is an empty one, without spans. Repeated rows get equal results, null ids pass through, other columns
    are ignored, an empty table gives an empty result. Among equal scores the alphabetically first kind is taken.
    """
    scanned = cut_lineage(scan(docs, text, doc_id))
    known = scanned.select(F.explode("base").alias("s")).select("s.context", "s.value", "s.kind")
    free = scanned.select("doc_id", "text_key", F.explode("free").alias("s")).select("doc_id", "text_key", "s.start", "s.end", "s.value", "s.context")
    accepted, learned = bootstrap(known, free)
    by_context = free.join(accepted, "context").select("doc_id", "text_key", "start", "end", "kind")
    by_value = free.join(learned, "value").select("doc_id", "text_key", "start", "end", "kind")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    more = by_context.union(by_value).groupBy("doc_id", "text_key", "start", "end").agg(F.min("kind").alias("kind"))
    more = more.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind")).alias("more"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    rows = scanned.select("doc_id", "text_key", F.array_sort(plain).alias("base")).join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    return rows.select("doc_id", "text_key", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans, and all spans as text."""
    def of(kind: str):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
