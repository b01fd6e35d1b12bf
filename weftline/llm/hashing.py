"""Word hashes of whole texts in numpy, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer word widens its own chunk.
CHUNK_BYTES = 1 << 20
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_table(separators: bytes, lower: bool) -> np.ndarray:
    """0 for a separator byte, else the byte's code (its value plus one), A-Z lowered if asked for."""
    table = np.arange(1, 257, dtype=np.uint64)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words of ``[^\x20\x09-\x0D]+``, A-Z lowered.
SPACED = word_table(bytes([32, *range(9, 14)]), lower=True)
#: Words of ASCII letters, digits and any character beyond ASCII.
ALNUM = word_table(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit words: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for name, base in (("p", _RADIX), ("i", _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["p"], _POWERS["i"]


def _hash_chunk(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words in a chunk that begins and ends between words."""
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = codes > 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first word (one more entry than texts).

    Texts lie back to back in ``data``; each must end in a separator, so that words end with their text.
    """
    hashes, places = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop, size = min(at + CHUNK_BYTES, end), CHUNK_BYTES
        while stop < end:  # back to the last separator; a word longer than the chunk widens it
            codes = table[data[at:stop]]
            gaps = np.flatnonzero(codes[-min(len(codes), 65536):] == 0)
            if len(gaps):
                stop -= min(len(codes), 65536) - int(gaps[-1]) - 1
                break
            size *= 2
            stop = min(at + size, end)
        h, starts = _hash_chunk(table[data[at:stop]])
        hashes.append(h)
        places.append(starts + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    where = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(where, offsets)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array, without a copy."""
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, so that temporaries stay small."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            stop = min(max(stop, at + 1), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
