"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are lower-cased and read as words: runs of letters, digits and marks, in scripts without blanks single characters.
A CGK embedding maps edit distance to Hamming distance: a pointer walks over a window's overlapping pairs of words, and at each step a random function of
the step and the pair under it says whether it moves on; the pairs it saw, step by step, are the embedding. Bit sampling
keeps a few steps of it. Windows of every item and of every document position, half as long as the item (rounded down to
a ladder), get ``REPEATS`` such keys from independent walks, so that an item is met from any of its many starts, also
where its first words are edited or its last ones missing. Equal keys make a candidate, and each candidate is verified
by the exact edit distance between the item and the best matching stretch of the document. Items of few words admit one
edit, which leaves three words in a row: their windows are any three words, and none of them is missed. Items of up to
``LEAST_PAIRS`` words are too short for edits and are met as whole sequences of words, none of them missed either.

Half of the repetitions sample the first third of the steps, so that stretches between two edits are found too; sampling
step 0 always lets a worker drop most positions at once. Documents never meet the benchmark itself in the search: the keys of all items are
broadcast as bitmaps of fixed size, at each step sampled, so a key of a document is sent on only if it may be an item's.
All that follows grows with the matches, not with the documents. A benchmark of any size works: its keys are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.hashing import ALNUM, mix, small_batches, text_buffer, words_of
from weftline.llm.memory import frugal
from weftline.session import cut_lineage

#: Independent walks, steps sampled of each, and log2 of a bitmap's size.
REPEATS, SAMPLED, MAP_BITS = 16, 4, 18
#: Items with fewer word pairs match as they are, without edits; window lengths rise by half from there.
LEAST_PAIRS = 5
#: Items of up to so many pairs have windows of ``SHORT`` pairs, which are walked pair by pair.
FEW_PAIRS, SHORT = 8, 2


#: A character that makes a text need ``_separated``: all but ASCII and the Latin letters up to U+024F. ASCII is passed over first.
UNUSUAL = r"[^\x00-\x7F](?<![\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F])"
#: Characters between words, and scripts whose characters are words of their own.
BETWEEN = r"[^\p{L}\p{N}\p{M}]+"
SINGLE = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def ladder(most: int) -> list[int]:
    sizes = [LEAST_PAIRS]
    while sizes[-1] * 3 // 2 <= most:
        sizes.append(sizes[-1] * 3 // 2)
    return sizes


def window_of(pairs: int) -> int:
    """Window length of an item of so many pairs."""
    return SHORT if pairs <= FEW_PAIRS else ladder(pairs // 2)[-1]


def longest(size: int) -> int:
    """Words of the longest item with windows of a length."""
    return FEW_PAIRS + 1 if size == SHORT else 2 * (size * 3 // 2)


def repeats_of(size: int) -> range:
    return range(1 if size == SHORT else REPEATS)


def steps_sampled(size: int, repeat: int) -> np.ndarray:
    """Sorted steps of one repetition, step 0 among them; half of the repetitions keep to the first third."""
    if size == SHORT:
        return np.arange(SAMPLED)
    rng = np.random.default_rng(size * 1009 + repeat)
    span = 2 * size if repeat % 2 else max(SAMPLED + 1, 2 * size // 3)
    return np.concatenate([[0], np.sort(rng.choice(np.arange(1, span), SAMPLED - 1, replace=False))])


def _walk(h: np.ndarray, at: np.ndarray, end: np.ndarray, size: int, repeat: int, keep) -> tuple[np.ndarray, np.ndarray]:
    """(indices into ``at``, keys) of the windows that begin at ``at``, end before ``end`` and pass ``keep``.

    ``keep(level, keys)`` tells which partial keys may go on; at the last level they are whole.
    """
    sampled = steps_sampled(size, repeat)
    place, alive = at.astype(np.int64), np.arange(len(at))
    key = mix(h[place] + np.uint64(size * 64 + repeat))
    step = 0
    seeds = mix(np.arange(sampled[-1] + 1, dtype=np.uint64) + np.uint64((size << 20) + (repeat << 12))) | np.uint64(1)
    for level in range(1, SAMPLED):
        while step < sampled[level]:
            now = h[place]
            place = place + (1 if size == SHORT else ((now * seeds[step]) >> np.uint64(63)).astype(np.int64))
            place = np.minimum(place, end)  # end: one past the window
            step += 1
        seen = np.where(place < end, h[np.minimum(place, len(h) - 1)], np.uint64(0))
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + seen)
        if (ok := keep(level, key)) is not None:
            alive, place, key, end = alive[ok], place[ok], key[ok], end[ok]
        if not len(alive):
            break
    return alive, key


def _separated(text: Column) -> Column:
    """Lower-cased text of which ``ALNUM`` finds the words of any script; plain Latin text has the same words without it."""
    apart = F.regexp_replace(F.regexp_replace(text, BETWEEN, " "), SINGLE, " $1 ")
    return F.when((F.octet_length(text) > F.char_length(text)) & text.rlike(UNUSUAL), F.concat(apart, F.lit("\n"))).otherwise(text)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, text_key): the separated text, and the hash of the lower-cased one."""
    lowered = df.select(F.col(key).cast("long").alias("key"), F.concat(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("\n")).alias("text"))
    return lowered.select("key", _separated(F.col("text")).alias("text"), F.xxhash64("text").alias("text_key"))


def _runs(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of each word with the ones that follow, so many in all; of no use where a text ends before."""
    key, ahead = mix(h + np.uint64(words)), h
    for _ in range(words - 1):
        ahead = np.append(ahead[1:], np.uint64(0))
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + ahead)
    return key


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one; of no use at the last word of a text."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + np.append(h[1:], np.uint64(0)))


def _words(batches: Iterator[pa.RecordBatch]):
    for batch in small_batches(batches, "text"):
        yield batch, *words_of(*text_buffer(batch.column(batch.schema.get_field_index("text"))), ALNUM)


def _index(items: DataFrame) -> DataFrame:
    """(key, item_id, size, level): the keys of all windows of all items; partial keys carry their level.

    An item of up to ``LEAST_PAIRS`` words has one key, of all its words; its size is their number, negative.
    """
    def rows(batches):
        for batch, words, first in _words(batches):
            h = np.append(_pairs(words), np.uint64(0))
            for item, s, e in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                n = e - s - 1
                if n < 0:
                    continue
                if n < LEAST_PAIRS:
                    size, parts = -(n + 1), [(0, _runs(words[s:e], n + 1)[:1])]
                else:
                    size = window_of(n)
                    at = np.arange(s, s + n - size + 1)
                    parts = [(0, np.unique(h[at]))]
                    for r in repeats_of(size):
                        def keep(level, keys, r=r):
                            parts.append((r * SAMPLED + level, np.unique(keys)))

                        _walk(h, at, at + size, size, r, keep)
                for level, keys in parts:
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array(keys.view(np.int64)), "item_id": pa.array([item] * len(keys), pa.int64()),
                        "size": pa.array([size] * len(keys), pa.int32()), "level": pa.array([level] * len(keys), pa.int32())})

    return items.mapInArrow(frugal(rows), "key long, item_id long, size int, level int")


def _bitmaps(index: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """A packed bitmap of 2**MAP_BITS bits for each window length and level, in which every key of the index is set.

    Only distinct bit numbers, summed up in 64-bit words, reach the driver: at most 2**MAP_BITS / 64 words a map, and
    the number of maps grows with the logarithm of the longest item.
    """
    slot = F.expr(f"key & {(1 << MAP_BITS) - 1}L")
    bits = index.select("size", "level", F.shiftright(slot, 5).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({(1 << MAP_BITS) - 1}L & key & 31L as int))").alias("b"))
    maps: dict[tuple[int, int], np.ndarray] = {}
    for r in bits.groupBy("size", "level", "w").agg(F.bit_or("b").alias("b")).collect():
        m = maps.setdefault((r["size"], r["level"]), np.zeros(1 << (MAP_BITS - 5), dtype=np.uint32))
        m[r["w"]] = r["b"]
    return {k: np.packbits(np.unpackbits(m.view(np.uint8), bitorder="little")) for k, m in maps.items()}


def candidates(docs: DataFrame, maps: dict[tuple[int, int], np.ndarray], percent: int) -> DataFrame:
    """(doc_id, text_key, size, keys, stretch): words around each cluster of hits, with the whole keys found in it.

    A stretch reaches as far to either side as an item with such windows can when words are added to it. Of the runs that
    may be a whole short item, each is sent on once for a document.
    """
    def rows(batches):
        flags = {(size, level): np.unpackbits(packed).view(bool) for (size, level), packed in maps.items()}
        sizes = sorted({s for s, _ in flags})
        low = np.uint64((1 << MAP_BITS) - 1)
        for batch, h, first in _words(batches):
            if not len(h):
                continue
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            ends = first[1:][owner] - 1
            padded = np.append(_pairs(h), np.uint64(0))
            slot = (padded[:-1] & low).astype(np.int64)
            found, out = [], []
            for size in sizes:
                if size < 0:
                    runs = _runs(h, -size)
                    start = np.flatnonzero(flags[size, 0][(runs & low).astype(np.int64)])
                    start = start[ends[start] - start >= -size - 1]
                    # Sorted by document and run: the first of each is kept.
                    start = start[np.lexsort((start, runs[start], owner[start]))]
                    new = np.r_[True, (owner[start[1:]] != owner[start[:-1]]) | (runs[start[1:]] != runs[start[:-1]])][: len(start)]
                    out += [(int(owner[k]), size, runs[k : k + 1].view(np.int64), h[k : k - size].view(np.int64)) for k in start[new].tolist()]
                    continue
                start = np.flatnonzero(flags[size, 0][slot])
                start = start[ends[start] - start >= size]
                if not len(start):
                    continue
                for r in repeats_of(size):
                    def keep(level, keys, r=r, size=size):
                        return flags[size, r * SAMPLED + level][(keys & low).astype(np.int64)]

                    alive, keys = _walk(padded, start, start + size, size, r, keep)
                    found.append((start[alive], keys, np.full(len(alive), size)))
            none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
            at, keys, size = (np.concatenate(x) for x in zip(none, *found, strict=True))
            order = np.lexsort((at, size, owner[at]))
            at, keys, size = at[order], keys[order], size[order]
            doc = owner[at]
            cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (size[1:] != size[:-1]) | (at[1:] - at[:-1] > size[1:])][: len(at)])
            edges = [*cut.tolist(), len(at)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                d, w = int(doc[s]), int(size[s])
                reach = longest(w) * (200 - percent) // 100 + 1
                lo, hi = max(int(first[d]), int(at[s]) - reach), min(int(first[d + 1]), int(at[e - 1]) + reach)
                out.append((d, w, np.unique(keys[s:e]).view(np.int64), h[lo:hi].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).take(pa.array([o[0] for o in out])), "text_key": batch.column(2).take(pa.array([o[0] for o in out])),
                    "size": pa.array([o[1] for o in out], pa.int32()),
                    "keys": pa.array([o[2] for o in out], pa.list_(pa.int64())), "stretch": pa.array([o[3] for o in out], pa.list_(pa.int64()))})

    return docs.mapInArrow(frugal(rows), "doc_id long, text_key long, size int, keys array<long>, stretch array<long>")


def fitting_distance(item: np.ndarray, stretch: np.ndarray) -> int:
    """Least number of word edits between the item and any run of words in the stretch."""
    ramp = np.arange(len(stretch) + 1)
    row = np.zeros(len(stretch) + 1, dtype=np.int64)
    for k, word in enumerate(item, 1):
        up = np.empty_like(row)
        up[0] = k
        up[1:] = np.minimum(row[:-1] + (stretch != word), row[1:] + 1)
        row = np.minimum.accumulate(up - ramp) + ramp
    return int(row.min())


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, text_key, item_id, item_words, edits): the items found in each document, one row per document text and item.

    An item is found where some run of the document's words is at most ``(100 - percent)`` percent of the item's
    words away from it in edits. ``text_key`` is the 64-bit hash of the text, so that rows with a repeated or null
    id stay apart; repeated rows are reported once. Items of up to ``LEAST_PAIRS`` words match only runs equal to them,
    one of a single word too; null and empty texts have no words; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    items = _texts(benchmark, item_id, item_text)
    index = cut_lineage(_index(items).distinct())
    shared = _bitmaps(index)
    if not shared:
        return spark.createDataFrame([], "doc_id long, text_key long, item_id long, item_words int, edits int")
    rows = _texts(docs, doc_id, text)
    near = cut_lineage(candidates(rows, shared, percent).withColumn("hit", F.xxhash64("doc_id", "text_key", "size", "stretch")))
    whole = index.where((F.col("level") % SAMPLED == SAMPLED - 1) | (F.col("size") < 0)).select("key", "size", "item_id").distinct()
    pairs = near.select("hit", "size", F.explode("keys").alias("key")).join(whole, ["key", "size"]).select("hit", "item_id").distinct()

    def tokens(batches):
        for batch, h, first in _words(batches):
            yield pa.RecordBatch.from_pydict({"item_id": batch.column(0), "item": pa.array([h[s:e].view(np.int64) for s, e in zip(first[:-1], first[1:], strict=True)], pa.list_(pa.int64()))})

    item_words = items.mapInArrow(frugal(tokens), "item_id long, item array<long>").distinct()

    def verify(batches):
        for batch in batches:
            both = [(i.values.to_numpy(), s.values.to_numpy()) for i, s in zip(batch.column(4), batch.column(3), strict=True)]
            # Every word of the item that the stretch lacks is an edit: most candidates need no more than this count.
            likely = [k for k, (i, s) in enumerate(both) if 100 * (len(i) - int(np.isin(i, s).sum())) <= (100 - percent) * len(i)]
            batch, item = batch.take(pa.array(likely, pa.int64())), [both[k][0] for k in likely]
            edits = [fitting_distance(*both[k]) for k in likely]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_key": batch.column(1), "item_id": batch.column(2), "item_words": pa.array([len(i) for i in item], pa.int32()), "edits": pa.array(edits, pa.int32())})

    both = near.select("hit", "doc_id", "text_key", "stretch").dropDuplicates(["hit"]).join(pairs, "hit").join(item_words, "item_id")
    checked = both.select("doc_id", "text_key", "item_id", "stretch", "item").mapInArrow(frugal(verify), "doc_id long, text_key long, item_id long, item_words int, edits int")
    return checked.where(F.expr(f"100 * edits <= {100 - percent} * item_words")).groupBy("doc_id", "text_key", "item_id").agg(F.max("item_words").alias("item_words"), F.min("edits").alias("edits"))
