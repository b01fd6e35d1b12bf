"""Importance resampling toward a target: hashed n-gram gains, Gumbel keys, a drawn share of the documents.

A document's weight is the sum of its features' gains, and the gain of a bucket says how much commoner it is in the
target texts than in the corpus. Both are counted over all texts. Texts are read twice and features never leave a task:
the first reading sends the task's bucket counts, the second the weight of each document.

The bucket of a feature is its CRC-32, and CRC-32 is affine: it is the XOR of one term for each byte, which depends on the
byte and its distance from the end only, and of one constant for the length. The terms come from a table of ``REACH``
distances and are folded with ``bitwise_xor.reduceat`` over the spans of all features at once. Longer spans are cut into
blocks of ``REACH`` bytes from their end; a block's value then moves over the zero bytes behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.hashing import small_batches, text_buffer, word_table
from weftline.operators.parts import global_row_number
from weftline.session import cut_lineage

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
#: Distances of the position table, bytes of text read at once, bytes of feature spans folded at once.
REACH, PIECE, FOLD = 64, 1 << 20, 1 << 20
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lowered: ASCII letters, digits and all beyond ASCII.
WORDS = word_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)), lower=True)
_BYTES = np.where(WORDS > 0, WORDS - np.uint64(1), np.uint64(32)).astype(np.uint8)
_SPACE = np.uint8(32)


@cache
def _positions() -> np.ndarray:
    """The term of each byte at each distance from the end, one row of 256 for a distance."""
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> np.uint32(1)) ^ np.uint32(0xEDB88320), rows >> np.uint32(1))
    out, byte = [rows], rows
    for _ in range(REACH - 1):
        out.append(byte[out[-1] & 0xFF] ^ (out[-1] >> np.uint32(8)))
    return np.concatenate(out)


@cache
def _moves(power: int) -> np.ndarray:
    """The move of a register over 2**power zero bytes, as a table for each of its four bytes."""
    if power == 0:
        byte = _positions()[:256]
        return np.stack([byte, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(3))])
    half = _moves(power - 1)
    return np.stack([_move(half, _move(half, np.arange(256, dtype=np.uint32) << np.uint32(8 * k))) for k in range(4)])


def _move(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 0xFF] ^ table[1][(v >> np.uint32(8)) & 0xFF] ^ table[2][(v >> np.uint32(16)) & 0xFF] ^ table[3][v >> np.uint32(24)]


def _over_zeros(v: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes each."""
    v = v.copy()
    for power in range(int(zeros.max(initial=0)).bit_length()):
        pick = np.flatnonzero((zeros >> power) & 1)
        v[pick] = _move(_moves(power), v[pick])
    return v


@cache
def _constants() -> np.ndarray:
    """What the start and the end of the checksum add for each length up to the table's reach."""
    return _over_zeros(np.full(REACH + 1, 0xFFFFFFFF, np.uint32), np.arange(REACH + 1)) ^ np.uint32(0xFFFFFFFF)


def _blocks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XOR of the terms of spans of 1 to ``REACH`` bytes."""
    table, size = _positions(), end - start
    out = np.empty(len(start), np.uint32)
    reach = np.cumsum(size)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + FOLD, side="right")))
        n = size[at:stop]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int32) + np.repeat((start[at:stop] - first).astype(np.int32), n)
        term = ((np.repeat(end[at:stop].astype(np.int32), n) - 1 - place) << 8) | data[place]
        out[at:stop] = np.bitwise_xor.reduceat(table[term], first)
        at = stop
    return out


def crc_of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans [start, end) of a byte array, each of one byte at least."""
    if not len(start):
        return np.zeros(0, np.uint32)
    size = end - start
    if size.max() <= REACH:
        return _blocks(data, start, end) ^ _constants()[size]
    count = (size + REACH - 1) // REACH
    first = np.cumsum(count) - count
    behind = (np.arange(int(count.sum())) - np.repeat(first, count)) * REACH
    stop = np.repeat(end, count) - behind
    value = _over_zeros(_blocks(data, np.maximum(np.repeat(start, count), stop - REACH), stop), behind)
    constant = _constants()[np.minimum(size, REACH)]
    far = np.flatnonzero(size > REACH)
    constant[far] = _over_zeros(np.full(len(far), 0xFFFFFFFF, np.uint32), size[far]) ^ np.uint32(0xFFFFFFFF)
    return np.bitwise_xor.reduceat(value, first) ^ constant


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts in pieces of about ``PIECE`` bytes that end between words: (words each with one blank behind, the text of
    each word, words carried over from the piece before).

    Texts lie back to back and each ends in a separator. A word longer than a piece widens it.
    """
    carried, owners = np.zeros(0, np.uint8), np.zeros(0, np.int64)
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        size = PIECE
        while True:
            stop = min(at + size, end)
            gaps = np.flatnonzero(WORDS[data[max(at, stop - 4096) : stop]] == 0)
            if len(gaps):
                stop = max(at, stop - 4096) + int(gaps[-1]) + 1
                break
            size *= 2
        part = data[at:stop]
        inside = WORDS[part] > 0
        close = np.zeros(len(part), bool)
        close[1:] = inside[:-1] & ~inside[1:]
        text = np.searchsorted(offsets, np.flatnonzero(close) + at, side="right") - 1
        words = np.concatenate([carried, _BYTES[part][inside | close]])
        owner = np.concatenate([owners, text])
        yield words, owner, len(owners)
        keep = min(LONGEST - 1, len(owner))
        blanks = np.flatnonzero(words == _SPACE)
        carried = words[blanks[-keep - 1] + 1 :] if len(blanks) > keep else words
        owners = owner[len(owner) - keep :]
        at = stop


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, CRC-32) of every run of one to ``LONGEST`` words, a bounded number at a time."""
    step = 1 << 16
    for words, owner, old in _pieces(data, offsets):
        ends = np.flatnonzero(words == _SPACE)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        for low in range(old, len(ends), step):
            last = np.arange(low, min(low + step, len(ends)))
            for n in range(1, LONGEST + 1):
                k = last[last >= n - 1]
                k = k[owner[k - n + 1] == owner[k]]
                yield owner[k], crc_of_spans(words, starts[k - n + 1], ends[k])


def _texts(table: DataFrame, text: str, *more) -> DataFrame:
    return table.select(*more, F.concat(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("\n")).alias("t"))


def bucket_counts(table: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket; a task sends a row for each bucket it met, the driver gets ``BUCKETS`` numbers."""
    def tally(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in small_batches(batches, "t"):
            for _, crc in features(*text_buffer(batch.column(0))):
                counts += np.bincount(crc % np.uint32(BUCKETS), minlength=BUCKETS)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int32()), "n": pa.array(counts[met], pa.int64())})

    rows = _texts(table, text).mapInArrow(tally, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of both smoothed shares, floors going down."""
    s, t = corpus.astype(np.float64) + 1, target.astype(np.float64) + 1
    ratio = t * float(corpus.sum() + BUCKETS) / (s * float(target.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, weight) for each row."""
    def weigh(batches: Iterator[pa.RecordBatch]):
        for batch in small_batches(batches, "t"):
            words, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            data, offsets = text_buffer(batch.column(1))
            for k, (owner, crc) in enumerate(features(data, offsets)):
                if len(owner):
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    weight[owner[first]] += np.add.reduceat(gain[crc % np.uint32(BUCKETS)], first)
                    if k % LONGEST == 0:
                        words[owner[first]] += np.diff(np.r_[first, len(owner)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(weight)], ["doc_id", "words", "weight"])

    return _texts(docs, text, F.col(doc_id).cast("long").alias("doc_id")).mapInArrow(weigh, "doc_id long, words long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; the drawn ones have a rank from 1.

    The score is the weight and a Gumbel term from the digest of seed and id, so the ``percent`` highest of the documents
    with ``least_words`` words are a draw without replacement by weight. Null and empty texts have no feature, weight 0
    and are not drawn; a null id draws as the empty id and comes last among ties. Ties go to the smaller id, and repeated
    rows are rows of their own. An empty corpus gives an empty result, an empty target counts nothing. Columns beyond the
    two read are ignored, whatever their names.
    """
    table = gains(bucket_counts(docs, text), bucket_counts(target, text))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    w = F.col("words")
    count = sum((F.greatest(w - n, F.lit(0)) for n in range(LONGEST)), F.lit(0)).cast("long")
    scored = cut_lineage(weights(docs, table, doc_id, text).select(
        "doc_id", "words", count.alias("n_features"), "weight", (F.col("weight") + F.floor(-1000 * F.ln(-F.ln(uniform)))).cast("long").alias("score")))
    able = scored.where(F.col("words") >= least_words)
    drawn = percent * able.count() // 100
    placed = global_row_number(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")], "rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(F.col("words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
