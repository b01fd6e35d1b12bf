"""Secret scan: candidate tokens by pattern, false positives removed by a random forest.

A candidate is a run of at least 16 key characters, or a value of any length and characters that is assigned to a
secret's name (of two that begin at one place, the longer). Its features: length, changes between character classes, shares of
digits, upper case and distinct characters, entropy, coverage by a dictionary of letter triples counted over the words of
all documents, whether it or the document's path looks like a path, a test or an example, and words next to it. The
forest is trained on labelled findings, a bounded sample of them; where none are given, findings with a published key
format or an assignment to a secret's name are labelled true, and plain words, numbers and digests named as such false.
Everything is DataFrame functions and the JVM's own learner.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.spans import before, matches
from weftline.session import cut_lineage

PATTERN = r"(?:(?<![A-Za-z0-9+/_-])|\G)[A-Za-z0-9+/_-]{16,}+={0,2}+"
#: A secret's name, a sign of assignment, an opening quote; then the value, up to a blank or quote, closing signs left off.
ASSIGN = r"(?i)(?:pass(?:word|wd)?|secret|token|api_?key|access_?key|credential|auth)s?[\"']?\s{0,4}(?::=|=>|==?|:)\s{0,4}[\"'`]?"
VALUE = r"[^\s\"'`]*[^\s\"'`.,;:)\]}>]"
#: Labelled findings in the training sample, triples in the dictionary, trees and depth of the forest.
SAMPLE, TRIPLES, TREES, DEPTH = 20_000, 400, 20, 6
THRESHOLD = 0.5

# Published key formats, and words that speak for or against a secret.
KEY_FORMAT = r"^(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|xox[abp]-[0-9A-Za-z-]{20,}|sk_live_[0-9A-Za-z]{24,}|AIza[0-9A-Za-z_-]{35})$"
SECRET_NAME = r"(?i)(?:pass(?:word|wd)?|secret|token|api_?key|access_?key|credential|auth)\W*$"
DIGEST_NAME = r"(?i)(?:sha\d*|md5|checksum|digest|commit|uuid|revision|hash)\W*$"
EXAMPLE_NAME = r"(?i)(?:test|example|sample|dummy|fixture|docs?)\b"

FEATURES = ["size", "changes", "digits", "upper", "distinct", "entropy", "covered", "slashes", "named", "digest", "example", "assigned"]


def _share(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / F.length(value)


def triples(words: Column) -> Column:
    """Every three letters in a row; a shorter word is one. From the array of letters, so that a long word costs its length."""
    def of(letters: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(letters) - 2, F.lit(1))), lambda k: F.array_join(F.slice(letters, k, 3), ""))

    # Bound by an outer lambda: an expression inside one is worked out again for every element.
    return F.element_at(F.transform(F.array(F.split(words, "")), of), 1)


def _assigned(text: Column) -> Column:
    """array<struct<start, end, value>>: the values assigned to secrets' names."""
    def value(m: Column) -> Column:
        v = F.regexp_replace(m["value"], f"^{ASSIGN}", "")
        return F.struct((m["end"] - F.length(v)).alias("start"), m["end"].alias("end"), v.alias("value"))

    return F.transform(matches(text, ASSIGN + VALUE), value)


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = "source") -> DataFrame:
    """(doc_id, path, start, end, value, context): every candidate of every whole text.

    ``path`` names a column that tells where a text comes from; a table without it has no paths.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), where.alias("path"), body.alias("text"))
    both = rows.select("doc_id", "path", "text", matches(F.col("text"), PATTERN).alias("runs"), _assigned(F.col("text")).alias("values"))
    longer = F.filter("runs", lambda r: ~F.exists("values", lambda v: (v["start"] == r["start"]) & (v["end"] >= r["end"])))
    found = both.select("doc_id", "path", "text", F.explode(F.concat(longer, "values")).alias("m"))
    return found.select("doc_id", "path", "m.start", "m.end", "m.value", before(F.col("text"), F.col("m.start"), 3).alias("context"))


def dictionary(docs: DataFrame, text: str = "text", size: int = TRIPLES) -> list[str]:
    """The commonest letter triples of all words of all documents; a table of fixed size. Words are summed up first."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("w")).where(F.length("w") >= 3)
    counted = words.groupBy("w").agg(F.count("*").alias("n")).select("n", F.explode(triples(F.col("w"))).alias("t"))
    top = counted.groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(size)
    return [r["t"] for r in top.collect()]


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """The candidates with the columns of ``FEATURES``, all double."""
    v = F.col("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    letters = F.split(v, "")
    # Entropy of the characters, from the counts of the distinct ones.
    share = F.transform(F.array_distinct(letters), lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / F.length(v))
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    parts = triples(F.lower(v))
    covered = F.size(F.array_intersect(parts, F.array(*map(F.lit, words)).cast("array<string>"))) / F.size(F.array_distinct(parts))
    columns = {
        "size": F.length(v), "changes": F.length(kinds) / F.length(v), "digits": _share(v, "[0-9]"), "upper": _share(v, "[A-Z]"),
        "distinct": F.size(F.array_distinct(letters)) / F.length(v), "entropy": entropy, "covered": covered, "slashes": _share(v, "[/._]"),
        "named": F.col("context").rlike(SECRET_NAME), "digest": F.col("context").rlike(DIGEST_NAME),
        "example": F.concat_ws(" ", "path", "context").rlike(EXAMPLE_NAME), "assigned": F.col("context").rlike(r"[=:]\W*$"),
    }
    return found.select("*", *[c.cast("double").alias(k) for k, c in columns.items()])


def own_labels(featured: DataFrame) -> DataFrame:
    """Label 1 or 0 where the format or the neighbours decide, else null."""
    v = F.col("value")
    true = (v.rlike(KEY_FORMAT) & (F.col("example") == 0)) | ((F.col("named") == 1) & (F.col("digits") > 0) & (F.col("entropy") >= 3))
    false = (F.col("digits") == 0) | (F.col("digits") == 1) | (F.col("digest") == 1) | ((F.col("covered") >= 0.6) & (F.col("named") == 0))
    return featured.withColumn("label", F.when(true, 1.0).when(false, 0.0))


def scored(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", path: str | None = "source") -> DataFrame:
    """(doc_id, start, end, value, score) of every candidate.

    findings: (value, label) known from a review, label 1 for a secret. Without them the candidates label themselves.
    The training sample holds at most ``SAMPLE`` distinct findings of either label, chosen by hash. Where one label is
    missing there is nothing to learn and the score is the label, 0 if unknown. Null texts have no candidates, repeated
    rows give repeated findings, null ids pass through, an empty table gives an empty result; other columns are ignored.
    """
    found = cut_lineage(candidates(docs, text, doc_id, path))
    featured = cut_lineage(own_labels(with_features(found, dictionary(docs, text))))
    if findings is not None:
        known = findings.where("label IS NOT NULL").groupBy("value").agg(F.max("label").cast("double").alias("label"))
        featured = cut_lineage(featured.drop("label").join(known, "value", "left"))
    samples = []
    for label in (1.0, 0.0):
        own = featured.where(F.col("label") == label).groupBy("value").agg(F.min(F.struct(*FEATURES)).alias("f"))
        samples.append(own.orderBy(F.xxhash64("value"), "value").limit(SAMPLE).select("f.*", F.lit(label).alias("label")))
    sample = cut_lineage(samples[0].union(samples[1]))
    together = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    if sample.select("label").distinct().count() < 2:
        return featured.select("doc_id", "start", "end", "value", F.coalesce("label", F.lit(0.0)).alias("score"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, labelCol="label", featuresCol="features", subsamplingRate=1.0)
    # Bags and splits are drawn by partition and place, so the sample, bounded as it is, stands in one order whatever files it came from.
    model = forest.fit(together.transform(sample.coalesce(1).sortWithinPartitions("label", *FEATURES)))
    out = model.transform(together.transform(featured))
    return out.select("doc_id", "start", "end", "value", F.round(vector_to_array("probability")[1], 9).alias("score"))


def secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """(doc_id, start, end, value, score): the candidates that the forest keeps; places are code points, the end exclusive."""
    return scored(docs, findings, **columns).where(F.col("score") >= threshold)
