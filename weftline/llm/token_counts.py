"""Token counts of whole texts without a shuffle of pre-tokens, by a two-tier lookup.

A first pass over all texts keeps, in each task, the counts of its commonest pre-tokens in a table of fixed size; the
few thousand rows of each task are summed and the commonest overall become a compact table (pre-token to number of
tokens), broadcast with a fixed bound. The second pass looks each pre-token up there, else in the worker's own cache of
fixed size, else merges its bytes. Pre-tokens themselves never leave their task. The table is only a matter of speed:
counts do not depend on it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split before the merges, as this kind of vocabulary defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the broadcast table and of a task's summary; the longest pre-token in either (characters).
TABLE, SUMMARY, LONGEST = 16_384, 4_096, 32
#: Entries of a worker's cache, in each of its two generations.
CACHED = 300_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in such a vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


class ByteCounter:
    """Counts tokens as a byte-level vocabulary file (json) defines them, special strings in texts being one token each."""

    def __init__(self, vocabulary: str, table: dict[str, int] | None = None):
        with open(vocabulary, encoding="utf-8") as f:
            data = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.letters = byte_letters()
        special = [t["content"] for t in data.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.table = table or {}
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings lay between them."""
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return self.find(text), 0
        return [p for part in parts for p in self.find(part)], len(parts) - 1

    def merged(self, pre: str) -> int:
        """Tokens of one pre-token: the lowest-ranked pair merges first, all its places from the left."""
        parts = [self.letters[b] for b in pre.encode("utf-8")]
        if len(parts) > 64:
            return self._merged_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get((parts[k], parts[k + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts)

    def _merged_long(self, parts: list[str]) -> int:
        """The same with a heap over linked neighbours, for very long pre-tokens."""
        from heapq import heapify, heappop, heappush

        left, right = [*range(-1, len(parts) - 1)], [*range(1, len(parts)), -1]
        heap = [(self.rank[p], k, *p) for k in range(len(parts) - 1) if (p := (parts[k], parts[k + 1])) in self.rank]
        heapify(heap)
        n = len(parts)
        while heap:
            _, k, a, b = heappop(heap)
            j = right[k]
            if j < 0 or parts[k] != a or parts[j] != b:
                continue
            parts[k], parts[j], right[k] = a + b, "", right[j]
            n -= 1
            if right[k] >= 0:
                left[right[k]] = k
            for x in (left[k], k):
                if x >= 0 and right[x] >= 0 and (p := (parts[x], parts[right[x]])) in self.rank:
                    heappush(heap, (self.rank[p], x, *p))
        return n

    def miss(self, pre: str) -> int:
        n = self.cache.get(pre)
        if n is None:
            n = self.older.get(pre)
            if n is None:
                n = self.merged(pre)
            if len(pre) <= LONGEST:
                if len(self.cache) >= CACHED:  # what the last generation did not meet goes
                    self.older, self.cache = self.cache, {}
                self.cache[pre] = n
        return n

    def count(self, text: str) -> int:
        pres, total = self.split(text)
        lengths = [*map(self.table.get, pres)]
        if None in lengths:
            miss = self.miss
            lengths = [miss(p) if n is None else n for n, p in zip(lengths, pres, strict=True)]
        return total + sum(lengths)


_COUNTERS: dict[tuple[str, int], ByteCounter] = {}


def _counter(vocabulary: str, table: dict[str, int]) -> ByteCounter:
    key = (vocabulary, hash(frozenset(table.items())))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = ByteCounter(vocabulary, table)
    return _COUNTERS[key]


def frequent(texts: DataFrame, vocabulary: str, entries: int = TABLE) -> dict[str, int]:
    """Token numbers of the commonest pre-tokens of all texts (column ``text``), at most ``entries`` of them."""
    def rows(batches: Iterator[pa.RecordBatch]):
        c = _counter(vocabulary, {})
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(c.split(t.as_py())[0])
                if len(seen) > 32 * SUMMARY:  # rare ones go; what is common in the task comes up again
                    seen = Counter(dict(seen.most_common(16 * SUMMARY)))
        top = [(p, n) for p, n in seen.most_common(SUMMARY) if len(p) <= LONGEST]
        if top:
            yield pa.RecordBatch.from_pydict({"pre": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    top = texts.select("text").mapInArrow(rows, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    c = ByteCounter(vocabulary)
    return {r["pre"]: c.merged(r["pre"]) for r in top.orderBy(F.desc("n"), "pre").limit(entries).collect()}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row.

    A null text is an empty one: no bytes, no tokens. Repeated rows and null ids pass through as they are, other
    columns are ignored, an empty table gives an empty result.
    """
    rows_in = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent(rows_in, vocabulary))

    def rows(batches: Iterator[pa.RecordBatch]):
        c = _counter(vocabulary, shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": batch.column(1), "n_tokens": pa.array([c.count(t.as_py()) for t in batch.column(2)], pa.int64())})

    counted = rows_in.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
