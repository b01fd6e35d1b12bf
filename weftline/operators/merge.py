"""Entity resolution: sources are merged by priority, gaps are filled, nothing is invented.

Children (models) of one entity are the same when they share a name key or an id key, also through
other children. Results follow the arrival order of rows (source priority, then position):

* the earliest row of a merged child owns id and name;
* a field keeps the first stated value of the group that absorbs; when a row joins two groups, the
  older group's values come first, then the younger group's, then the row's own.

The job works on aggregates, not on collected groups. Keys are counted first, by their checksums, and
a bitmap of those that occur more often goes to the rows: a row whose keys occur nowhere else is a
child already, one whose id key occurs nowhere else hangs on its name key. Of the others, rows with
the same key pair collapse, so copies cost one row. Keys that occur in one pair only hang on their
partner, which leaves a core of pairs between keys that each occur several times. There a key folds
into an older key over its earliest pair, and its values then count as arriving no earlier than that
pair. The fold is found by joins and pointer doubling, the same way for cores of any size and shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import facets, numbers, text
from weftline.operators.parts import global_row_number
from weftline.session import cut_lineage, release

CHILD_FIELDS = ["context", "max_output", "modality", "rate_limit"]
#: Places in the bitmap of repeated keys, at most 32 MB that are broadcast in rows of 2**15 places. Keys that share a place
#: with a repeated one count as repeated too.
PLACES, BUCKET = 1 << 27, 15
SCALARS = ["name", "category", "country", "flag", "url", "base_url", "description", "source_updated_at", "more_models"]


def priority_first(value: Column, order: Column) -> Column:
    """Aggregate: first stated value by order; partial per partition, so a hot group stays cheap."""
    stated = text.null_if_empty(value)
    return F.min_by(stated, F.when(stated.isNotNull(), order))


def gap_fill(partials: DataFrame, keys: list[str], fields: list[str], order: Column) -> DataFrame:
    return partials.groupBy(*keys).agg(*[priority_first(F.col(f), order).alias(f) for f in fields])


def dedup_first(rows: DataFrame, keys: list[str], order: Column, fields: list[str]) -> DataFrame:
    """First row per key in a given order, as an aggregate with partial results."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("_f")).select(*keys, "_f.*")


def child_keys(rows: DataFrame) -> DataFrame:
    """Adds name key ``ka`` and id key ``kb``; a row without one key gets a key of its own there.

    Rows with neither key are left out.
    """
    name_first = F.coalesce(text.null_if_empty(F.col("name")), F.col("id"))
    id_first = F.coalesce(text.null_if_empty(F.col("id")), F.col("name"))
    # A generated row, so that the filter below reads the keys instead of computing them again.
    keys = F.inline(F.array(F.struct(text.model_key(name_first).alias("a"), text.slugify(id_first).alias("b"))))
    a, b = F.col("a"), F.col("b")
    return rows.select("*", keys).where((a != "") | (b != "")).withColumn(
        "ka", F.when(a != "", F.concat(F.lit("a:"), a)).otherwise(F.concat(F.lit("a!"), b))
    ).withColumn(
        "kb", F.when(b != "", F.concat(F.lit("b:"), b)).otherwise(F.concat(F.lit("b!"), a))
    ).drop("a", "b")


def _when_stated(field: str) -> Column:
    stated = text.blank_to_null(F.col(field)) if field == "modality" else text.null_if_empty(F.col(field))
    return stated


def _first_stated(o: Column) -> list[Column]:
    """The stated value of each field with its time, else NULL."""
    values = [(f, _when_stated(f)) for f in CHILD_FIELDS]
    return [F.when(v.isNotNull(), F.struct(o.alias("at"), v.alias("v"))).alias(f) for f, v in values]


def key_pairs(rows: DataFrame, group: str, ord_col: str) -> DataFrame:
    """One row per distinct key pair: first arrival, members, and per field the first value with its time."""
    o = F.col(ord_col)
    keyed = rows if "ka" in rows.columns else child_keys(rows)
    fields = [F.min(v).alias(f) for f, v in zip(CHILD_FIELDS, _first_stated(o), strict=True)]
    aggs = [F.min(o).alias("t"), F.count("*").alias("members"), F.min_by(F.struct("id", "name"), o).alias("owner"), *fields]
    return keyed.groupBy(_sorted_by(group, "ka", "kb"), group, "ka", "kb").agg(*aggs).drop("_h")


def _sorted_by(*keys: str) -> Column:
    """Leading key of an aggregate that sorts: checksums are told apart at once, keys of one entity begin alike."""
    return F.xxhash64(*keys).alias("_h")


def _seen(group: str, *keys: str) -> list[Column]:
    return [F.xxhash64(group, k).alias("seen") for k in keys]


def repeated(seen: DataFrame) -> DataFrame:
    """(bucket, words): the places of the checksums ``seen`` that occur more than once, as bits; bounded in size.

    A word holds 4 bytes of a bucket's bitmap.
    """
    place = F.pmod("seen", F.lit(PLACES))
    often = seen.groupBy("seen").agg(F.count("*").alias("n")).where("n > 1")
    bits = often.groupBy(F.shiftright(place, BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(place % (1 << BUCKET)).alias("bits"))
    word = F.transform(F.sequence(F.lit(0), F.lit((1 << BUCKET - 5) - 1)), lambda i: F.conv(F.hex(F.substr("bits", i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    return cut_lineage(bits.select("bucket", word.alias("words")))


def _marked(rows: DataFrame, group: str, key: str, marks: DataFrame) -> DataFrame:
    """Adds ``<key>_more``: whether the key occurs more than once, or shares its place with one that does."""
    place = F.pmod(*_seen(group, key), F.lit(PLACES))
    placed = rows.withColumn("_place", place).join(F.broadcast(marks.select(F.col("bucket").alias("_bucket"), F.col("words").alias("_words"))), F.shiftright("_place", BUCKET) == F.col("_bucket"), "left")
    at = (F.col("_place") % (1 << BUCKET)).cast("int")
    # The first byte of a word is its highest.
    bit = F.expr("shiftright(_word, cast(_place % 8 + 8 * (3 - _place div 8 % 4) as int)) % 2 = 1")
    return placed.withColumn("_word", F.get("_words", F.shiftright(at, 5))).withColumn(f"{key}_more", F.coalesce(bit, F.lit(False))).drop("_place", "_bucket", "_words", "_word")


def _nodes(pairs: DataFrame, group: str, hung: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Keys that stay as nodes with the values of the pairs hanging on them, and the core pairs if there are some.

    A pair whose id key occurs in no other pair hangs on its name key, whatever that meets, like the rows ``hung``; only of
    the others it matters how often their name key occurs. A key that seems to occur more often than it does is a node more.
    """
    kept = [group, "t", "members", "owner", *CHILD_FIELDS]
    on_name = [F.struct(F.col("ka").alias("k"), F.lit(True).alias("holds")).alias("end"), F.lit(False).alias("core")]
    marks, edges = repeated(pairs.select(*_seen(group, "kb"))), None
    if marks.isEmpty():
        ends = pairs.select(*kept, *on_name)
    else:
        names = pairs.select(*_seen(group, "ka"))
        if hung is not None:
            names = names.unionByName(hung.select(*_seen(group, "ka")))
        met = _marked(_marked(pairs, group, "kb", marks), group, "ka", repeated(names))
        core = F.col("kb_more") & F.col("ka_more")
        own = F.struct(F.when(F.col("kb_more") & ~F.col("ka_more"), F.col("kb")).otherwise(F.col("ka")).alias("k"), F.lit(True).alias("holds"))
        both = F.when(core, F.array(own, F.struct(F.col("kb").alias("k"), F.lit(False).alias("holds")))).otherwise(F.array(own))
        ends = met.select(*kept, F.explode(both).alias("end"), core.alias("core"))
        edges = met.where(core).select(group, F.col("ka").alias("u"), F.col("kb").alias("v"), "t")
    if hung is not None:
        ends = ends.unionByName(hung.select(*kept, *on_name))
    holds = F.col("end.holds")
    nodes = ends.groupBy(_sorted_by(group, "end.k"), group, F.col("end.k").alias("k")).agg(
        F.min("t").alias("born"),
        F.min_by("owner", "t").alias("owner"),
        F.sum(F.when(holds, F.col("members")).otherwise(0)).alias("members"),
        F.bool_or("core").alias("core"),
        *[F.min(F.when(holds, F.col(f))).alias(f) for f in CHILD_FIELDS],
    ).drop("_h")
    return nodes, edges


def _numbered(nodes: DataFrame, edges: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Core keys under numbers that rise with their age within an entity, and the pairs as (old, young, t)."""
    nodes = cut_lineage(global_row_number(nodes, [F.col(group).asc(), F.col("born").asc(), F.col("k").asc()], "id"))
    names = nodes.select(group, "k", "id")
    met = edges.join(names.select(group, F.col("k").alias("u"), F.col("id").alias("iu")), [group, "u"]).join(names.select(group, F.col("k").alias("v"), F.col("id").alias("iv")), [group, "v"])
    return nodes, cut_lineage(met.select(F.least("iu", "iv").alias("old"), F.greatest("iu", "iv").alias("young"), "t"))


def _levels(claims: DataFrame) -> list[DataFrame]:
    """Pointer doubling: level i leads 2**i steps up from ``id``, over steps of time ``t`` at the latest."""
    levels = [cut_lineage(claims.select("id", "up", "t"))]
    while True:
        far = levels[-1].select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("t").alias("then"))
        further = cut_lineage(levels[-1].join(far, "up").select("id", F.col("far").alias("up"), F.greatest("t", "then").alias("t")))
        if further.isEmpty():
            release(further)
            return levels
        levels.append(further)


def _climb(points: DataFrame, column: str, levels: list[DataFrame], until: str | None) -> DataFrame:
    """The column moved up while the steps are no later than ``until``, or to the top without one."""
    for level in reversed(levels):
        step = level.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("t").alias("_t"))
        same = F.col(column) == F.col("_id")
        points = points.join(step, same if until is None else same & (F.col("_t") <= F.col(until)), "left").withColumn(column, F.coalesce("_up", column)).drop("_id", "_up", "_t")
    return points


def _fold_forest(pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, up, t): the key that absorbs each key and when, and the levels of that forest.

    Claims say that a key is no longer its own group at a time, as an older one is connected by then. The first claims are
    the earliest pairs with an older key. Both ends of every pair then climb the claims up to the pair's time; if they end
    at different keys, the pair is a claim on the younger one, and where several meet the same key in turn, on the younger
    of the newcomer and the oldest one met so far. Claims only get earlier, each holds in the sequential fold, and once all
    pairs end at one key nothing is missing: the claims are the fold. Pairs that agree are done, but a claim that gives way
    is a pair again, so a round reads what is left. A round takes logarithmically many steps of the longest path, and a
    chain takes a few rounds in whatever order its links come.
    """
    claims = pairs.groupBy(F.col("young").alias("id")).agg(F.min(F.struct("t", F.col("old").alias("up"))).alias("c")).select("id", "c.up", "c.t")
    while True:
        levels = _levels(claims)
        ends = _climb(_climb(pairs, "old", levels, "t"), "young", levels, "t").where("old <> young")
        left = cut_lineage(ends.select(F.least("old", "young").alias("old"), F.greatest("old", "young").alias("young"), "t"))
        if left.isEmpty():
            break
        before = Window.partitionBy("young").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
        met = left.withColumn("oldest", F.coalesce(F.min("old").over(before), F.col("young"))).where("old <> oldest")
        more = met.select(F.greatest("old", "oldest").alias("id"), F.struct("t", F.least("old", "oldest").alias("up")).alias("c"))
        so_far = levels[0].select("id", F.struct("t", "up").alias("c"))
        claims = cut_lineage(so_far.unionByName(more).groupBy("id").agg(F.min("c").alias("c")).select("id", "c.up", "c.t"))
        # A claim that gave way to an earlier one is a pair to be looked at again.
        late = so_far.join(claims, "id").where("c.t > t").select(F.col("c.up").alias("old"), F.col("id").alias("young"), F.col("c.t").alias("t"))
        pairs = left.unionByName(late)
    alive = _climb(levels[0].select("id", F.col("up").alias("at"), "t"), "at", levels, "t")
    forest = _levels(alive.select("id", F.col("at").alias("up"), "t"))
    release(*levels)
    return forest[0], forest


def _first_values(nodes: DataFrame, forest: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(id, field, v): the value of each field that reaches a key first, for the keys at the top.

    Times rise on the way up, so what a key hands on at time ``t`` arrives at the later of ``t`` and the earliest time in
    its whole subtree: one number for a path of any length. Each key points at the child or at itself, whichever is first,
    and the pointers from the top lead to the value.
    """
    stated = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"{f}.at").alias("at"), F.col(f"{f}.v").alias("v"))) for f in CHILD_FIELDS]))
    own = cut_lineage(nodes.select("id", F.inline(stated)))
    least = own.select("id", "field", "at")
    for level in levels:
        raised = least.join(level.select("id", "up"), "id").select(F.col("up").alias("id"), "field", "at")
        least = cut_lineage(least.unionByName(raised).groupBy("id", "field").agg(F.min("at").alias("at")))
    handed = least.join(forest, "id").select(
        F.col("up").alias("id"), "field", F.struct(F.greatest("at", "t").alias("at"), F.when(F.col("at") < F.col("t"), 0).otherwise(1).alias("phase"), F.col("id").alias("from")).alias("c"))
    mine = own.select("id", "field", F.struct("at", F.lit(1).alias("phase"), F.col("id").alias("from")).alias("c"))
    point = cut_lineage(mine.unionByName(handed).groupBy("id", "field").agg(F.min("c").alias("c")).select("id", "field", F.col("c.from").alias("src")))
    for _ in levels:
        on = point.select(F.col("id").alias("src"), "field", F.col("src").alias("further"))
        point = cut_lineage(point.join(on, ["src", "field"]).select("id", "field", F.col("further").alias("src")))
    top = point.join(forest.select("id"), "id", "left_anti")
    return top.join(own.select(F.col("id").alias("src"), "field", "v"), ["src", "field"]).select("id", "field", "v")


def _fold_core(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """Core keys folded into the groups they end in: owner, members and first values of each."""
    nodes, pairs = _numbered(nodes, edges, group)
    forest, levels = _fold_forest(pairs)
    tops = _climb(nodes.select("id", F.col("id").alias("top"), group, "k", "born", "owner", "members"), "top", levels, None)
    folded = tops.groupBy("top").agg(
        F.min_by(group, "id").alias(group), F.min_by("k", "id").alias("k"), F.min("born").alias("born"), F.min_by("owner", "id").alias("owner"), F.sum("members").alias("members"))
    values = _first_values(nodes, forest, levels).groupBy(F.col("id").alias("top")).agg(*[F.max(F.when(F.col("field") == f, F.col("v"))).alias(f) for f in CHILD_FIELDS])
    return folded.join(values, "top", "left").drop("top")


def merge_children(rows: DataFrame, group: str = "slug", ord_col: str = "ord") -> DataFrame:
    """Merged children: one row per distinct child of each entity.

    ``ord`` is unique and sortable within the group (source priority, then position).
    """
    keyed = cut_lineage(child_keys(rows).select(group, F.col(ord_col).alias("t"), "id", "name", *CHILD_FIELDS, "ka", "kb")).where(F.col(group).isNotNull())
    marks = repeated(keyed.select(F.explode(F.array(*_seen(group, "ka", "kb"))).alias("seen")))
    marked = _marked(_marked(keyed, group, "kb", marks), group, "ka", marks)
    pairs = cut_lineage(key_pairs(marked.where("kb_more"), group, "t"))
    single = marked.where("NOT kb_more").select(group, "ka", "ka_more", "t", F.lit(1).cast("long").alias("members"), F.struct("id", "name").alias("owner"), *_first_stated(F.col("t")))
    nodes, edges = _nodes(pairs, group, single.where("ka_more"))
    nodes = cut_lineage(nodes)
    plain = ["owner", "members", *[F.col(f"{f}.v").alias(f) for f in CHILD_FIELDS]]
    found = nodes.where("NOT core").select(group, "born", *plain).unionByName(single.where("NOT ka_more").select(group, F.col("t").alias("born"), *plain))
    if edges is not None and not edges.isEmpty():
        found = found.unionByName(_fold_core(nodes.where("core"), edges, group).drop("k"))
    flat = found.select(
        group, F.col("born").alias("ord"), "members",
        text.text_or_empty(F.col("owner.id")).alias("id"),
        text.text_or_empty(F.col("owner.name")).alias("name"),
        *CHILD_FIELDS,
    ).withColumn("modality", facets.clean_modality(F.col("modality")))
    windowless = numbers.no_token_context(F.col("modality"), F.col("id"), F.col("name"))
    return flat.withColumn("context", F.when(~windowless, F.col("context"))).withColumn(
        "max_output", F.when(~windowless, F.col("max_output"))
    )


def max_context(context: Column, order: Column) -> Column:
    """Aggregate: the largest context as written; the first one wins ties; NULL when none is a size."""
    num = numbers.ctx_num(context)
    return numbers.clean_ctx_str(F.max_by(context, F.when(num > 0, F.struct(num, -order))))


def source_refs(partials: DataFrame) -> DataFrame:
    """Distinct source references per entity in priority order; a handful per entity, one per source."""
    firsts = partials.groupBy("slug", "source").agg(F.min_by(F.struct("prio", "source_url", "synced_at"), F.struct("prio", "pos")).alias("r"))
    ref = F.struct(F.col("r.prio").alias("prio"), F.col("source").alias("name"), F.col("r.source_url").alias("url"), F.col("r.synced_at").alias("synced_at"))
    return firsts.groupBy("slug").agg(F.array_sort(F.collect_list(ref)).alias("refs")).select(
        "slug",
        F.transform("refs", lambda r: F.struct(r["name"].alias("name"), r["url"].alias("url"), r["synced_at"].alias("synced_at"))).alias("sources"),
    )


def max_synced_at(sources: Column, run_at: Column) -> Column:
    return F.greatest(run_at, F.array_max(F.transform(sources, lambda s: s["synced_at"])))


def child_rollup(models: DataFrame) -> DataFrame:
    """Per-entity facts derived from the merged children.

    Counts, flags and positions are hashed for each context an entity states; texts are compared once for each of them.
    """
    flags = facets.facet_flags(F.col("modality"))
    stated = models.groupBy("slug", "context").agg(F.count("*").alias("n"), F.min("ord").alias("ord"), *[F.bool_or(flag).alias(f"has_{f}") for f, flag in flags.items()])
    return stated.groupBy("slug").agg(
        F.sum("n").alias("model_count"),
        facets.ordered_facets({f: F.bool_or(f"has_{f}") for f in flags}).alias("modalities"),
        max_context(F.col("context"), F.col("ord")).alias("max_context"),
    )


def merge_entities(partials: DataFrame, models: DataFrame, run_at: str) -> DataFrame:
    """Canonical entities from per-source partials and already merged children.

    ``partials``: source, source_url, prio, pos, slug, synced_at and the scalar fields.
    """
    order = F.struct("prio", "pos")
    named = partials.where(text.null_if_empty(F.col("slug")).isNotNull())
    scalars = gap_fill(named, ["slug"], SCALARS, order)
    joined = scalars.join(child_rollup(models), "slug", "left").join(source_refs(named), "slug", "left")
    count = F.coalesce("model_count", F.lit(0))
    name = F.coalesce("name", "slug")
    description = text.strip_md_links(F.col("description"))
    domain = text.domain_for(F.col("slug"), F.col("name"), F.col("url"), F.col("base_url"))
    return (
        joined.withColumn("name", name)
        .withColumn("description", description)
        .withColumn("domain", domain)
        .select(
            "slug", "name", "category", "country", "flag", "domain",
            F.when(F.col("domain").isNotNull(), F.concat(F.lit("/logos/"), "slug", F.lit(".png"))).alias("logo"),
            "url", "base_url", "description",
            F.coalesce("modalities", F.array().cast("array<string>")).alias("modalities"),
            count.alias("model_count"), "max_context",
            numbers.free_limit_of(F.col("description")).alias("free_limit"),
            numbers.reconcile_more_note(F.col("more_models"), count).alias("more_models"),
            "sources", max_synced_at(F.col("sources"), F.lit(run_at)).alias("synced_at"), "source_updated_at",
        )
    )


def keep_authoritative(models: DataFrame, live: DataFrame) -> DataFrame:
    """Children of the entities in ``live`` (slug, id) that their live source lists; an entity without live ids keeps all.

    All entities at once: one join with the live ids, one with the few entities that have some.
    """
    ids = live.where("id IS NOT NULL").select("slug", "id").distinct()
    listed = ids.select("slug").distinct().withColumn("_ruled", F.lit(True))
    marked = models.join(listed, "slug", "left").join(ids.withColumn("_live", F.lit(True)), ["slug", "id"], "left")
    return marked.where("_ruled IS NULL OR _live").select(*models.columns)
