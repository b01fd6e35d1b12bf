"""Line dedup: of runs of lines that occur more than once, all but the first go.

Documents are read in order of their id, lines in their order; lines are compared trimmed, blank lines are looked through.
A run counts if it has ``min_words`` words. From each line on, the shortest run of that many words is a window, and so is
the shortest one that ends with each line. Both depend on the lines alone, so equal runs have equal windows, and

* the smallest line hash of a window, its fingerprint, is shared by all places where the window's lines occur: places
  whose fingerprint occurs once are dropped before anything else is compared;
* a line lies in a repeated run exactly if it lies in a window that occurs earlier: one that starts with or before the
  line reaches to the right as far as the match goes, one that ends with or after it reaches to the left. Joining
  windows to their first place and uniting those of a document therefore extends every match both ways, against all
  earlier places at once, without forming pairs of places.

Windows that a third of all documents share cost one row each: first places are minima, summed up before the shuffle,
and the join to them is a plain equality join with one row for each window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut_lineage, release

MIN_WORDS = 50


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, text_key, line, h, w): the lines that have words, each row of (id, text) once."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), F.posexplode(F.split(body, "\n")).alias("line", "s"))
    rows = rows.select("doc_id", "text_key", "line", F.xxhash64(F.trim(F.translate("s", "\t\r", "  "))).alias("h"), F.regexp_count("s", F.lit(r"\S+")).alias("w")).where("w > 0")
    return rows.repartition("doc_id", "text_key").dropDuplicates(["doc_id", "text_key", "line"])


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, first, last, seq, upto, key, mark, at): both windows of each line, with fingerprint and its place.

    first and last are line numbers, seq and upto the same places among the lines that have words.
    """
    own = Window.partitionBy("doc_id", "text_key")
    counted = lines.withColumn("past", F.sum("w").over(own.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumn("before", F.col("past") - F.col("w")).withColumn("seq", F.row_number().over(own.orderBy("line")))
    rows = counted
    for name, order, frame in (("f", "before", (0, min_words - 1)), ("b", "past", (1 - min_words, 0))):
        over = own.orderBy(order).rangeBetween(*frame)
        rows = rows.withColumn(name, F.struct(
            F.min("line").over(over).alias("first"), F.max("line").over(over).alias("last"), F.min("seq").over(over).alias("seq"), F.max("seq").over(over).alias("upto"), F.sum("w").over(over).alias("words"),
            F.xxhash64(F.lit(name), F.collect_list("h").over(over)).alias("key"), F.min(F.struct("h", "line")).over(over).alias("mark")))
    both = rows.select("doc_id", "text_key", F.explode(F.array("f", "b")).alias("x")).where(F.col("x.words") >= min_words)
    return both.select("doc_id", "text_key", "x.first", "x.last", "x.seq", "x.upto", "x.key", F.col("x.mark.h").alias("mark"), F.col("x.mark.line").alias("at"))


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, runs): for each document text with repeated runs, the disjoint ranges of line numbers to go, in order."""
    windows = cut_lineage(_windows(_lines(docs, text, doc_id), min_words))
    place = F.struct("doc_id", "text_key", "at")
    marks = windows.groupBy("mark").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("mark")
    kept = cut_lineage(windows.join(marks, "mark", "left_semi"))
    release(windows)
    first = kept.groupBy("mark", "key").agg(F.min(F.struct("doc_id", "first")).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = kept.join(first, ["mark", "key"]).where("earliest < struct(doc_id, first)").select("doc_id", "text_key", "first", "last", "seq", "upto")
    # Windows of a document that overlap, or between which no word is left, become one run.
    own = Window.partitionBy("doc_id", "text_key")
    reach = F.max("upto").over(own.orderBy("seq", "upto").rowsBetween(Window.unboundedPreceding, -1))
    starts = later.distinct().withColumn("new", F.when(reach + 1 >= F.col("seq"), 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("new").over(own.orderBy("seq", "upto").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "text_key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, lines, removed, text): each input row as a struct, its number of lines, how many go, and the text without them.

    A line is removed if it lies in a run of lines with at least ``min_words`` words that also occurs earlier: in a
    document with a smaller id (null ids are smallest) or further up in the same one; blank lines between two lines
    that go, go too. Rows of one id, or of none, count as one document read by line number, so repeated rows stay alike. A
    null text stays null and has no lines, an empty text has one; an empty table gives an empty result. Other columns, whatever their names,
    come through in ``row``.
    """
    runs = cut_lineage(repeated_runs(docs, text, doc_id, min_words))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    # The same plan at any size: documents are sorted to their runs, never the runs sent to all tasks.
    both = rows.join(runs.hint("merge"), rows["id"].eqNullSafe(runs["doc_id"]) & (rows["key"] == runs["text_key"]), "left")
    lines = F.split(F.col("row").getField(text), "\n")
    # What lies between two runs stays: one slice before each run and one after the last.
    kept = F.expr(
        "flatten(transform(sequence(0, size(runs)), k -> slice(parts,"
        " if(k = 0, 1, runs[greatest(k - 1, 0)].last + 2),"
        " if(k = size(runs), size(parts), runs[least(k, size(runs) - 1)].first) - if(k = 0, 0, runs[greatest(k - 1, 0)].last + 1))))")
    removed = F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0))
    out = both.withColumn("parts", F.when(F.col("runs").isNotNull(), lines))
    size = F.length(F.col("row").getField(text)) - F.length(F.replace(F.col("row").getField(text), F.lit("\n"), F.lit(""))) + 1
    cleaned = F.when(F.col("runs").isNull(), F.col("row").getField(text)).otherwise(F.array_join(kept, "\n"))
    return out.select("row", F.coalesce(size, F.lit(0)).alias("lines"), removed.alias("removed"), cleaned.alias("text"))
